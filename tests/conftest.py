import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from veilspark import attach

    session = (
        SparkSession.builder.master("local[4]")
        .appName("veilspark-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield attach(session)
    session.stop()


@pytest.fixture
def frame(spark):
    """Rows as a DataFrame under a DDL schema."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
