"""A scratch folder for sessions that name none: tests, benches and the checks on one machine."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession


def ensure_scratch(spark: SparkSession) -> SparkSession:
    """Where ``spark.checkpoint.dir`` is unset and Spark runs in this process, a folder that goes at its end."""
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and not context.getCheckpointDir():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="cellweave-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return spark
