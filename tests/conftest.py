import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "America/New_York").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def meas(spark):
    """Makes delivered rows from (id, time, value, flag, seq), seq counting up if left out."""

    def make(rows, extra=""):
        full = [(*r, k + 1) if len(r) == 4 else r for k, r in enumerate(rows)]
        return spark.createDataFrame(full, "id long, time long, value double, flag long, seq long" + extra)

    return make
