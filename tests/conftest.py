import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def sf():
    return SF


@pytest.fixture
def one(spark):
    """Evaluate a text rule on literal rows: one(rule, *texts) -> list of results."""
    from pyspark.sql import functions as F

    def run(rule, *texts):
        rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
        return [r[0] for r in rows.orderBy("i").select(rule(F.col("text"))).collect()]

    return run
