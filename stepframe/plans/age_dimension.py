"""Age dimension: members, classes with labels in three languages, keys, load, export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepframe.functions.missing import missing_lt
from stepframe.functions.rules import ifc
from stepframe.functions.scalars import cats, catx, put_numeric
from stepframe.operators.joins import range_join
from stepframe.operators.load import align_to_schema, sentinel_members, table_load_replace
from stepframe.operators.ordered import surrogate_keys


def _field(name: str, dtype: T.DataType, label: str, length: int | None = None) -> T.StructField:
    meta = {"label": label} | ({"length": length} if length else {})
    return T.StructField(name, dtype, True, meta)


# Columns, lengths and labels of the dimension, its special members, the age from
# which a class is open-ended.
AGE_DIMENSION = T.StructType([
    _field("ID_AGE", T.LongType(), "Age dimension id"),
    _field("NM_AGE", T.LongType(), "Age"),
    _field("TX_AGE", T.StringType(), "Age", 24),
    _field("TX_AGE_NL", T.StringType(), "Leeftijd", 24),
    _field("TX_AGE_FR", T.StringType(), "Âge", 24),
    _field("TX_AGE_CLASS", T.StringType(), "Age Class", 24),
    _field("TX_AGE_CLASS_DESCR_NL", T.StringType(), "Leeftijdsklasse", 24),
    _field("TX_AGE_CLASS_DESCR_FR", T.StringType(), "Classe d'âge", 24),
])
SENTINELS = [
    {"ID_AGE": -1, "TX_AGE": "Not available", "TX_AGE_NL": "Niet beschikbaar",
     "TX_AGE_FR": "Non disponible", "TX_AGE_CLASS": "Not available",
     "TX_AGE_CLASS_DESCR_NL": "Niet beschikbaar", "TX_AGE_CLASS_DESCR_FR": "Non disponible"},
    {"ID_AGE": -2, "TX_AGE": "Unknown", "TX_AGE_NL": "Onbekend", "TX_AGE_FR": "Inconnu",
     "TX_AGE_CLASS": "Unknown", "TX_AGE_CLASS_DESCR_NL": "Onbekend",
     "TX_AGE_CLASS_DESCR_FR": "Inconnu"},
]
OPEN_FROM = 150


def with_age_classes(ages: DataFrame, classes: DataFrame, open_from: int = OPEN_FROM) -> DataFrame:
    """Ages (NM_AGE) with their class (NM_AGE_MIN, NM_AGE_MAX) as text in three languages.

    A class that reaches ``open_from`` is open-ended; one with a missing upper bound counts
    as closed, because missing is below every number.
    """
    text = put_numeric("NM_AGE", 8, "left")
    low, high = put_numeric("NM_AGE_MIN", 8), put_numeric("NM_AGE_MAX", 8)
    closed = missing_lt("NM_AGE_MAX", open_from)
    joined = range_join(ages, classes, "NM_AGE", "NM_AGE_MIN", "NM_AGE_MAX")
    return joined.select(
        "NM_AGE", text.alias("TX_AGE"), text.alias("TX_AGE_NL"), text.alias("TX_AGE_FR"),
        ifc(closed, catx("-", low, high), cats(F.trim(low), F.lit("+"))).alias("TX_AGE_CLASS"),
        ifc(closed, catx(" ", low, F.lit("t.e.m."), high, F.lit("jaar")),
            catx(" ", low, F.lit("jaar of ouder"))).alias("TX_AGE_CLASS_DESCR_NL"),
        ifc(closed, catx(" ", low, F.lit("à"), high, F.lit("ans")),
            catx(" ", low, F.lit("ans ou plus"))).alias("TX_AGE_CLASS_DESCR_FR"))


def age_dimension(ages: DataFrame, classes: DataFrame, target: DataFrame | None,
                  path: str | None = None, open_from: int = OPEN_FROM) -> DataFrame:
    """The whole load: classes, keys for new ages, replace load, special members.

    With ``path`` the loaded dimension is stored there and read back.  The export is
    ``labelled_export(result, path, drop=["TX_AGE", "TX_AGE_CLASS"])``.
    """
    classed = with_age_classes(ages, classes, open_from)
    keyed = surrogate_keys(classed, target, ["NM_AGE"], "ID_AGE", ["NM_AGE", "TX_AGE_CLASS"])
    loaded = sentinel_members(align_to_schema(keyed, AGE_DIMENSION), "ID_AGE", SENTINELS)
    return table_load_replace(loaded, AGE_DIMENSION, path) if path else loaded
