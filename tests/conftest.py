import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .appName("tablehealth-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def readings(spark):
    """Twelve sensors: one without a station, two with the same level."""
    from decimal import Decimal

    levels = "4.50 12.00 7.25 -1.50 30.00 4.50 8.10 9.99 15.75 22.40 3.05 18.60".split()
    rows = [
        (501 + i, None if i == 5 else 31 + i - (i > 5), ("live", "idle", "live", "off")[i % 4], Decimal(level))
        for i, level in enumerate(levels)
    ]
    return spark.createDataFrame(
        rows, "sensor_id int, station_id int, state string, level decimal(7,2)"
    ).coalesce(1)
