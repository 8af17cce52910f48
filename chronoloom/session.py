"""Session settings shared by tests, the bench and local runs."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", memory: str = "12g", partitions: int = 8, folder: str | None = None) -> SparkSession:
    """A local session; on a cluster the caller brings its own. folder: for intermediate tables; by default one that is removed at
    the end."""
    if folder is None:
        path = tempfile.mkdtemp(prefix="chronoloom-")
        atexit.register(shutil.rmtree, path, True)
        folder = f"file://{path}"
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("chronoloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.checkpoint.dir", folder)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
