import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("stepframe")
    session = (SparkSession.builder.master("local[*]").appName("stepframe-tests")
               .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
               .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
               .config("spark.checkpoint.dir", str(folder / "checkpoints"))
               .config("spark.sql.warehouse.dir", str(folder / "warehouse")).getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session


def rows(df, *order):
    """Rows as plain tuples, sorted with missing values first."""
    out = [tuple(r) for r in df.collect()]
    return sorted(out, key=lambda r: tuple((v is not None, v if v is not None else 0) for v in r))


@pytest.fixture(scope="session")
def as_rows():
    return rows
