"""Airline cost rating: read, band, filter, summarise."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepframe.functions.rules import band_ladder
from stepframe.operators.ordered import having_remerge
from stepframe.operators.summary import class_means, freq_oneway
from stepframe.session import materialize
from stepframe.sources.readers import fixed_width_read

# The record layout, the currency columns and the bands.
LAYOUT = (
    ("Airline", "char", 1, 20),
    ("Length", "num", 22, 28),
    ("Speed", "num", 30, 36),
    ("Dailyflighttime", "num", 38, 44),
    ("Populationserved", "num", 46, 52),
    ("TotalopCost", "num", 54, 60),
    ("Revenue", "num", 62, 68),
    ("Loadcap", "num", 70, 76),
    ("Availablecap", "num", 78, 84),
    ("Totalassets", "num", 86, 92),
    ("Investmentsfunds", "num", 94, 100),
    ("Adjustedassets", "num", 102, 108),
)
CURRENCY = ("Revenue", "Totalassets", "Investmentsfunds", "Adjustedassets")
COST_BOUNDS = (50, 100, 150, 200)
RATINGS = (5, 4, 3, 2, 1)


def airlines_read(spark: SparkSession, path: str) -> DataFrame:
    """The text file as a typed table; currency columns carry their display format."""
    df = fixed_width_read(spark, path, LAYOUT)
    for c in CURRENCY:
        df = df.withMetadata(c, {"format": "dollar9.2"})
    return df


@dataclass
class AirlinesResult:
    airlines: DataFrame
    airlines_p: DataFrame
    chart_hbar: DataFrame
    chart_vbar: DataFrame
    fastplane: DataFrame


def airlines_job(rows: DataFrame, name: str = "Airline", cost: str = "TotalopCost",
                 speed: str = "Speed", bounds=COST_BOUNDS, prefix: str = "P") -> AirlinesResult:
    """All five result tables, from the rated table stored once: the text is read and parsed one time."""
    rated = materialize(rows.withColumn("RATING", band_ladder(cost, bounds, RATINGS)), "rated")
    return AirlinesResult(
        airlines=rated,
        airlines_p=rated.where(F.col(name).startswith(prefix)),
        chart_hbar=class_means(rated, ["RATING"], {f"Mean_{cost}": ("mean", cost)}),
        chart_vbar=freq_oneway(rated, "RATING"),
        fastplane=having_remerge(rated.select(name, speed), speed),
    )
