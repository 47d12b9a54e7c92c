import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def nulls(spark):
    """NULL, NaN and empty cells, a column without values, a constant one, every type class."""
    return spark.sql(
        """SELECT * FROM VALUES
        (1, 10L, 1.5D, cast(1 AS decimal(10,2)), 'a', true, date'2024-01-01', timestamp'2024-01-01 05:06:07', timestamp_ntz'2024-02-29 23:00:00', cast(NULL AS int), 7, 'x'),
        (2, NULL, cast('NaN' AS double), cast(2 AS decimal(10,2)), '', false, NULL, NULL, NULL, NULL, 7, 'x'),
        (NULL, 30L, NULL, NULL, NULL, NULL, date'2024-01-07', timestamp'2023-12-31 00:00:00', timestamp_ntz'2024-03-03 00:00:00', NULL, 7, 'y'),
        (5, 40L, 4.0D, cast(4 AS decimal(10,2)), 'a', true, date'2024-01-07', timestamp'2023-12-31 00:00:00', timestamp_ntz'2024-03-03 00:00:00', NULL, 7, NULL)
        AS t(i, l, d, dec, s, b, dt, ts, tn, none, one, y)"""
    )
