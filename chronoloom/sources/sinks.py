"""Sinks: Parquet keyed by a hash of the parameters, appended logs of results, CSV tables, data of plots."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def cache_path(folder: str, name: str, **parameters: object) -> str:
    """A path that differs with the dataset and with every parameter."""
    key = hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:16]
    return f"{folder.rstrip('/')}/{name}-{key}.parquet"


def cached(spark: SparkSession, folder: str, name: str, make, refresh: bool = False, **parameters: object) -> DataFrame:
    """The table under the cache path, made and written if it is not there yet."""
    path = cache_path(folder, name, **parameters)
    jvm = spark.sparkContext._jvm  # noqa: SLF001
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if refresh or not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):  # noqa: SLF001
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def csv_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def joined_numbers(values: Column, separator: str, missing: str) -> Column:
    return F.array_join(F.transform(values, lambda x: F.when(x.isNull() | F.isnan(x), F.lit(missing)).otherwise(x.cast("string"))), separator)


def arff_rows(df: DataFrame, path: str, order: str) -> None:
    """series and label_name as the data lines of a relational ARFF file, in the order of a column; part files sort by it too."""
    body = F.array_join(F.transform("series", lambda c: joined_numbers(F.coalesce(c, F.array().cast("array<double>")), ",", "?")), "\\n")
    line = F.concat(F.lit("'"), body, F.lit("',"), F.col("label_name"))
    df.repartitionByRange(order).sortWithinPartitions(order).select(line.alias("value")).write.mode("overwrite").text(path)
