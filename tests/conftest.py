import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))
DATA = os.environ.get("HEDDLE_TEST_DATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def column(spark):
    """Evaluate a column function on string arguments."""
    from pyspark.sql import functions as F

    def value(f, *args):
        df = spark.createDataFrame([args], ", ".join(f"c{k} string" for k in range(len(args))))
        return df.select(f(*(F.col(f"c{k}") for k in range(len(args))))).first()[0]

    return value
