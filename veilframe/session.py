"""Sessions: local ones for tests and benchmarks, and this package on the executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("veilframe")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def send_package(spark: SparkSession) -> None:
    """Send this package's source to the executors, once for each Spark context, for the Python functions that run there."""
    context, package = spark.sparkContext, Path(__file__).parent
    if getattr(context, "_veilframe_sent", False) or not package.is_dir():
        return
    folder = tempfile.mkdtemp(prefix="veilframe-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(shutil.make_archive(f"{folder}/veilframe", "zip", package.parent, package.name))
    context._veilframe_sent = True
