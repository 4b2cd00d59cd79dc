"""A local Spark session for the command line and the tool server."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

HOME = "ORRERY_HOME"


def home() -> Path:
    return Path(os.environ.get(HOME) or Path.home() / ".orrery")


def local_session() -> SparkSession:
    """The running session, or a small local one that keeps standard output free."""
    spark = SparkSession.builder.appName("orrery").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
