import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.maxMetadataStringLength", "10000")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from shelfmark.session import prepare

    yield prepare(session)
    session.stop()


@pytest.fixture
def column(spark):
    """Values of an expression over a list of one-column rows."""

    def run(values, ddl, expression):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {ddl}")
        rows = df.select("i", expression.alias("y")).orderBy("i").collect()
        return [row["y"] for row in rows]

    return run
