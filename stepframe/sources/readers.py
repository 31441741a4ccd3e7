"""Readers.  All return lazy DataFrames; projection and filters reach the scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepframe.functions.scalars import input_numeric
from stepframe.session import materialize


def library_read(spark: SparkSession, library: str, table: str) -> DataFrame:
    """A named table of a library.

    A library is a folder of parquet tables (``/path`` or ``scheme://path``; the member is
    ``table.parquet`` or a folder of that name below it) or the name of a catalog database.
    """
    if "/" in library:
        return spark.read.parquet(f"{library.rstrip('/')}/{table}.parquet")
    return spark.table(f"{library}.{table}")


def parse_fixed_width(lines: DataFrame, fields: Sequence[tuple[str, str, int, int]],
                      text: str = "value") -> DataFrame:
    """Columns cut from text lines.

    ``fields`` lists (name, kind, first, last) with 1-based inclusive column numbers; kind is
    "char" (blanks on both sides dropped, a single period is blank) or "num" (unreadable or
    blank gives missing).
    """
    out = []
    for name, kind, first, last in fields:
        piece = F.substring(text, first, last - first + 1)
        chars = F.trim(piece)
        value = F.when(chars == ".", F.lit("")).otherwise(chars) if kind == "char" else input_numeric(piece)
        out.append(value.alias(name))
    return lines.select(*out)


def fixed_width_read(spark: SparkSession, path: str,
                     fields: Sequence[tuple[str, str, int, int]]) -> DataFrame:
    """Text files with fixed columns."""
    return parse_fixed_width(spark.read.text(path), fields)


def sheet_import(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                 names_in_first_row: bool = True) -> DataFrame:
    """A sheet stored as CSV; the first row holds the names, types are guessed without a schema.

    Guessing reads the file once more; give a schema for large inputs.
    """
    reader = spark.read.option("header", names_in_first_row)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def csv_scan(spark: SparkSession, path: str) -> DataFrame:
    """A CSV folder read as it is: text columns ``_c0``, ``_c1``, …"""
    return spark.read.format("csv").load(path)


def preview_rows(df: DataFrame, order_by: Sequence[str | Column], n: int) -> DataFrame:
    """The first ``n`` rows in a stated order (a top-k plan, not a full sort)."""
    return df.orderBy(*order_by).limit(n)


def expand_loop(df: DataFrame, start, stop, out: str) -> DataFrame:
    """One row per loop value from ``start`` to ``stop`` (both included) for each input row.

    A loop whose start is above its stop gives no row.
    """
    start, stop = (x if isinstance(x, Column) else F.lit(x) for x in (start, stop))
    return df.where(start <= stop).withColumn(out, F.explode(F.sequence(start, stop)))


def generate_series(spark: SparkSession, start: int, stop: int, out: str) -> DataFrame:
    """Loop values from ``start`` to ``stop`` (both included) as a distributed range."""
    return spark.range(start, stop + 1).withColumnRenamed("id", out)


def read_scripts(spark: SparkSession, path: str) -> DataFrame:
    """Script files as (name, content) with binary content."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content")


def script_ingest(files: DataFrame, name: str = "name", content: str = "content",
                  suffix: str = ".sas") -> DataFrame:
    """Each uploaded file with its text and a status.

    'rejected_name' (wrong suffix), 'rejected_encoding' (not UTF-8), 'skipped_blank', or
    'accepted'.  Filter on ``status`` for the accepted and the quarantine table.
    """
    raw = F.col(content)
    valid = F.is_valid_utf8(raw.cast("string"))
    text = F.try_validate_utf8(raw.cast("string"))
    named = F.coalesce(F.col(name).endswith(suffix), F.lit(False))
    # Any character that is not white space, in the Unicode sense, makes a script.
    blank = ~F.coalesce(text.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))
    status = (F.when(~named, F.lit("rejected_name"))
              .when(~F.coalesce(valid, F.lit(True)), F.lit("rejected_encoding"))
              .when(blank, F.lit("skipped_blank"))
              .otherwise(F.lit("accepted")))
    return files.withColumns({"text": text, "status": status})


FILE, PLACE = "input_file", "input_row"


def read_in_order(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table with where each row stands: its file and its row in the file, from 0.

    The two columns are hidden file metadata, so nothing is sorted or numbered to get them, and a
    task that is run again gives them alike.  Files follow each other by path, as writers name them.
    """
    return spark.read.parquet(path).select(
        "*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(PLACE))


def stable_sort(df: DataFrame, by: Sequence[str | Column]) -> DataFrame:
    """Rows of ``read_in_order`` sorted by keys; rows with equal keys stay in the order of the input."""
    return df.orderBy(*by, FILE, PLACE).drop(FILE, PLACE)


def observation_numbers(df: DataFrame, out: str = "_n_") -> DataFrame:
    """The number of each row in the order of the input, from 1, among the rows of ``df``.

    Rows are counted per file and a file's rows start behind those of the files before.  Where a filter
    left gaps, the rows of each file are numbered anew in a window, one file to a task.
    """
    per_file = df.groupBy(FILE).agg(F.count(F.lit(1)).alias("_sf_rows"), F.max(PLACE).alias("_sf_last"))
    # One row per file.
    before = Window.orderBy(FILE).rowsBetween(Window.unboundedPreceding, -1)
    per_file = materialize(per_file.withColumn("_sf_before", F.coalesce(F.sum("_sf_rows").over(before), F.lit(0))), "files")
    place = F.col(PLACE) + 1
    if not per_file.where(F.col("_sf_last") + 1 != F.col("_sf_rows")).isEmpty():
        place = F.row_number().over(Window.partitionBy(FILE).orderBy(PLACE))
    numbered = df.withColumn("_sf_place", place).join(per_file, FILE)
    return numbered.select(*[F.col(f"`{c}`") for c in df.columns if c not in (FILE, PLACE, out)],
                           (F.col("_sf_before") + F.col("_sf_place")).cast("bigint").alias(out))


def first_in_input(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """The row of each key that comes first in the input, by one partial aggregate."""
    rest = [c for c in df.columns if c not in (*by, FILE, PLACE)]
    # With no other column there is nothing to choose.
    row = F.min_by(F.struct(F.lit(0).alias("_sf"), *[F.col(f"`{c}`") for c in rest]), F.struct(FILE, PLACE)).alias("_sf_row")
    kept = df.groupBy(*[F.col(f"`{c}`") for c in by]).agg(row)
    return kept.select(*[F.col(f"`{c}`") if c in by else F.col(f"_sf_row.`{c}`") for c in df.columns if c not in (FILE, PLACE)])


def merge_by_position(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of two inputs of ``read_in_order`` side by side, the first with the first and so on.

    Where the right table still has rows, its values take the place of left columns of the same name;
    the longer table's further rows have missing values in the other's columns.
    """
    names = [c for c in dict.fromkeys([*left.columns, *right.columns]) if c not in (FILE, PLACE)]
    pair = observation_numbers(left, "_sf_n").alias("l").join(
        observation_numbers(right, "_sf_n").alias("r"), F.col("l._sf_n") == F.col("r._sf_n"), "full")

    def value(c: str) -> Column:
        if c not in right.columns:
            return F.col(f"l.`{c}`")
        own = F.col(f"r.`{c}`")
        return F.when(F.col("r._sf_n").isNotNull(), own).otherwise(F.col(f"l.`{c}`")) if c in left.columns else own

    return pair.select(*[value(c).alias(c) for c in names])


def lines_with_status(lines: DataFrame, schema: T.StructType | str, line: str = "value", sep: str = ",") -> DataFrame:
    """Delimited lines with their columns, a ``status`` and a ``reason``; no line is lost.

    ``status`` is "accepted" or "rejected".  ``reason`` says why a line does not fit: "too few fields",
    "too many fields", "open quote", or "not a <type>: <column>" for the first value that can't be read as its type;
    such a line's columns are missing where they can't be read.  An empty field is missing and fits; a
    blank or missing line has no fields and is rejected.  The line itself stays in ``line``.
    """
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    # A mark behind the line is the field after the last one where all fields are there, an earlier one where some aren't.
    mark, n = "\x01", len(schema)
    texts = ", ".join([*[f"_f{i} string" for i in range(n + 1)], "_bad string"])
    cut = lines.withColumn("_sf_cut", F.from_csv(F.concat(line, F.lit(sep + mark)), texts, {
        "sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    field = [F.col(f"_sf_cut._f{i}") for i in range(n + 1)]
    blank = F.coalesce(F.trim(line) == "", F.lit(True))
    bad = F.col("_sf_cut._bad").isNotNull()
    early = F.exists(F.array(*field[:n]), lambda x: F.coalesce(x == mark, F.lit(False)))
    runs_on = F.exists(F.array(*field), lambda x: F.coalesce(x.endswith(sep + mark), F.lit(False)))
    columns, reason = {}, F.when(blank | bad & early, "too few fields").when(runs_on, "open quote").when(bad, "too many fields")
    for i, f in enumerate(schema.fields):
        given = F.when((field[i] != "") & ~field[i].endswith(mark), field[i])
        kind = f.dataType.simpleString()
        columns[f.name] = given if kind == "string" else F.trim(given).try_cast(f.dataType)
        if kind != "string":
            reason = reason.when(given.isNotNull() & columns[f.name].isNull(), F.lit(f"not a {kind}: {f.name}"))
    status = F.when(reason.isNull(), "accepted").otherwise("rejected")
    return cut.select(*[F.col(f"`{c}`") for c in lines.columns], *[c.alias(n) for n, c in columns.items()],
                      status.alias("status"), reason.alias("reason"))


def fixed_width_with_status(lines: DataFrame, fields: Sequence[tuple[str, str, int, int]],
                            text: str = "value") -> DataFrame:
    """``parse_fixed_width`` with a ``status`` and a ``reason`` per line, as ``lines_with_status`` has them.

    A line that ends before the last field begins is short; a number field must be blank, a period or readable.
    """
    reason = F.when(F.coalesce(F.length(text), F.lit(0)) < max(first for _, _, first, _ in fields), "too few fields")
    out = []
    for name, kind, first, last in fields:
        piece = F.substring(text, first, last - first + 1)
        chars = F.trim(piece)
        if kind == "char":
            out.append(F.when(chars == ".", F.lit("")).otherwise(chars).alias(name))
            continue
        number = input_numeric(piece)
        out.append(number.alias(name))
        reason = reason.when(~chars.isin("", ".") & number.isNull(), F.lit(f"not a number: {name}"))
    status = F.when(reason.isNull(), "accepted").otherwise("rejected")
    return lines.select(*[F.col(f"`{c}`") for c in lines.columns], *out, status.alias("status"), reason.alias("reason"))
