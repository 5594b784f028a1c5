import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    where = tmp_path_factory.mktemp("spark")
    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(where / "warehouse")).config("spark.checkpoint.dir", str(where / "shared")).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def tiny(spark, tmp_path_factory):
    """A lake of four small tables with nulls, ties and repeated rows."""
    from tidepool.sources.lake import Lake

    frames = {
        "alpha": spark.createDataFrame([("foo", 1.0), ("bar", 2.0), ("foo", None)], "a string, x double"),
        "beta": spark.createDataFrame([("foo", "10"), ("baz", "20")], "a string, y string"),
        "city": spark.createDataFrame([("Berlin", "Germany"), ("Paris", "France"), ("Rome", "Italy"), ("Paris", "France"), (None, "nan")], "City string, Country string"),
        "gamma": spark.createDataFrame([(i, chr(97 + i % 3), float(i)) for i in range(12)], "id int, k string, v double"),
    }
    return Lake(spark, frames, str(tmp_path_factory.mktemp("lake")))
