import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from spoorlog.session import prepare  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
    session.stop()


@pytest.fixture
def lines(spark):
    """Lines of text as one session's numbered lines."""

    def make(texts, session_id="s"):
        rows = [(session_id, i + 1, t) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "session_id string, line_num int, raw_line string")

    return make
