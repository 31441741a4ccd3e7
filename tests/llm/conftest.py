import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_rows():
    """Nulls in every column, empty and long texts, repeated rows, ties, odd white space and characters."""
    rng = random.Random(5)
    vocabulary = ["alpha", "Béta", "gamma", "delta,", "eps.", "zêta", "eta", "theta", "iota", "kappa", "lambda", "mu"]
    say = lambda n: " ".join(rng.choice(vocabulary) + str(rng.randrange(40)) for _ in range(n))
    long = say(6000)
    rows = [(0, None, "en", "a", 0), (1, "", "en", "a", 0), (2, " \t\n\x0b ", None, None, None), (None, say(30), "en", None, 5),
            (None, None, None, None, None), (3, long, "en", "a", len(long)), (4, long + " end", "en", "b", 1),
            (5, "one two three four five six seven eight nine ten", "en", "b", 1), (5, "one two three four five six seven eight nine ten", "en", "b", 1),
            (6, "x y z w v x y z w v x y z w v\nfoo\nfoo\n foo\n\n", "en", "c", 1), (7, "a#b $c <d> | e%f & g*h\r\nZ z ▁q", "en", "é", 1),
            (-8, "All  Rights\treserved. CC-BY; all rights reserved cc by cc by general PUBLIC license!", "en", "c", 1),
            (9, "Licensed under the Apache License, Version 2.0.\nlicensed under the GNU general public license version 3", "en", "c", 1)]
    rows += [(100 + i, say(rng.randrange(1, 60)), "en", rng.choice("aabcd"), 1) for i in range(60)]
    rows += [(200, say(20), "en", "a", 1)] * 30
    rows += [(300 + i, "copy of one text that many rows hold, word for word here", "en", "a", 1) for i in range(20)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(4)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture
def run():
    """Run a registered query on tables of the test's own."""
    from stepframe.llm.registry import FUNCTIONS

    def call(key, **tables):
        return FUNCTIONS[key](lambda name: tables[name])
    return call


def crowded(df):
    """The table with extra columns whose names operators use inside or give out."""
    return df.select("*", *[F.lit("own").alias(n) for n in (
        "size", "rows", "block", "rank", "path", "copies", "line", "lines", "host", "doc", "n", "row", "token", "score", "class")])
