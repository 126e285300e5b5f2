import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from checks.scratch import ensure_scratch  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("cellweave-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # Plans are checked as text: show pushed filters in full.
        .config("spark.sql.maxMetadataStringLength", "10000")
        .getOrCreate()
    )
    ensure_scratch(session).sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
