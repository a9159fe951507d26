"""Session settings that the operators rely on."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def prepared(spark: SparkSession) -> SparkSession:
    """Sets what a program of this library needs; operators never change the session.

    That is UTC, which the timestamp functions assume, Arrow batches of a few
    MB, so that a Python worker holds few texts at a time, and a path by which
    Python workers import this package.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    root, env = str(Path(__file__).parents[1]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark
