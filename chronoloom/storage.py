"""Tables, and intermediate results written to the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, only a local session, as in tests, may have a folder of this machine; on
    a cluster the executors could not read it, so that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="chronoloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@contextmanager
def _tidied(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind; else they stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with _tidied(spark):
        df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._chronoloom_path = path  # noqa: SLF001
    return back


def materialize_measured(df: DataFrame, label: str, **figures: Column) -> tuple[DataFrame, dict]:
    """The same, with aggregates over the rows, taken while they are written: an iteration needs no job of its own to see whether it
    is done. Aggregates: null over no rows, unless they are counts."""
    watch = Observation()
    seen = df.observe(watch, *(c.alias(k) for k, c in figures.items()))
    back = materialize(seen, label)
    return back, watch.get


def release(df: DataFrame) -> None:
    """Delete what materialize() wrote for df, once nothing reads it any more."""
    path = getattr(df, "_chronoloom_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm  # noqa: SLF001
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)  # noqa: SLF001


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = f"_{name}"
    return name
