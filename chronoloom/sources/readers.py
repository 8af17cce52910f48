"""Readers of the file layouts of time-series collections, each giving split, sample_id, series, label_name, label or their parts.

Text is read with the JVM's readers, which split large files and pack small ones, and taken apart by expressions. The place of a line in
its file comes from the block it lies in, the lines of the blocks before it, and its rank inside the block, never from reading a
file as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.functions.numbers import parse_number
from chronoloom.operators.density import numbered
from chronoloom.operators.series import encoded, stratified

#: Columns of the parameter file.
PARAMETER_SCHEMA = "dataset string, width int, stride int, lamb double, beta double, diff_threshold double, slope_threshold double, maxIters int, dimension_reduce boolean, CumulativeEnergySaving int, k_nearest int, k_dis_low double, k_dis_high double, maxIters_ADMM int"
#: Collections whose own split is kept; those of others are pooled and split anew.
OWN_SPLIT = ("BasicMotions", "Cricket", "Epilepsy", "JapaneseVowels", "DuckDuckGeese", "EigenWorms", "ERing", "EthanolConcentration", "FingerMovements")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 0 within the file), value."""
    meta = F.col("_metadata")
    raw = spark.read.text(path).select(meta.file_path.alias("file"), meta.file_block_start.alias("_block"), F.monotonically_increasing_id().alias("_at"), "value")
    sizes = raw.groupBy("file", "_block").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("file").orderBy("_block")) - F.col("_n")).drop("_n")  # one row per block
    rank = F.row_number().over(Window.partitionBy("file", "_block").orderBy("_at")) - 1
    return raw.withColumn("_r", rank).join(before, ["file", "_block"]).select("file", (F.col("_r") + F.col("_before")).alias("line_no"), "value")


def doubles(text: Column, separator: str) -> Column:
    """Numbers of a separated text; what is no number ("?", empty) is null."""
    return F.transform(F.split(F.trim(text), separator), lambda x: F.when(F.trim(x).isin("?", "", "NaN", "nan"), None).otherwise(F.trim(x).try_cast("double")))


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, series (channels x steps), label_name of a relational ARFF file: data lines are one quoted field, in which a literal
    backslash-n parts the channels, and the class. Comments, blank lines and the header are passed over; the class may be
    quoted; a line without a quoted field is read as one channel."""
    lines = numbered_lines(spark, path).filter(~F.col("value").rlike(r"^\s*(%|@|$)"))
    quoted = r"^\s*(['\"])(.*)\1\s*,\s*(.*?)\s*$"
    is_quoted = F.col("value").rlike(quoted)
    body = F.when(is_quoted, F.regexp_extract("value", quoted, 2)).otherwise(F.regexp_extract("value", r"^(.*),[^,]*$", 1))
    label = F.when(is_quoted, F.regexp_extract("value", quoted, 3)).otherwise(F.regexp_extract("value", r",([^,]*)$", 1))
    channels = F.transform(F.split(body, r"\\n"), lambda c: doubles(c, ","))
    return lines.select("file", "line_no", channels.alias("series"), F.regexp_replace(F.trim(label), r"^['\"]|['\"]$", "").alias("label_name"))


def resplit(df: DataFrame, label: str = "label", share: float = 0.5) -> DataFrame:
    """df (sample_id, ...) with a split of its own: `share` of each label's samples train, the others test."""
    return stratified(df, "sample_id", [label], share).withColumn("split", F.when(F.col("in_part"), "train").otherwise("test")).drop("in_part")


def arff_dataset(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """split, sample_id (train first, in file order), series, label_name, label (alphabetical over both splits)."""
    parts = [read_arff(spark, f"{folder}/{name}/{name}_{s}.arff").withColumn("split", F.lit(s.lower())).withColumn("_s", F.lit(k)) for k, s in enumerate(("TRAIN", "TEST"))]
    both = numbered(parts[0].unionByName(parts[1]), ["_s", "file", "line_no"], "sample_id")
    return encoded(both, "label_name", "label", trim=False).select("split", "sample_id", "series", "label_name", "label")


def har_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """split, sample_id (train first, in file order), series, label of the six-channel activity layout: one file per channel and split, one sample per line,
    joined by line number."""
    files = numbered_lines(spark, f"{folder}/*/*/*.txt").unionByName(numbered_lines(spark, f"{folder}/*/y_*.txt"))
    name = F.regexp_extract("file", r"([^/]+)\.txt$", 1)
    rows = files.select("line_no", "value", F.regexp_extract(name, r"^(.*)_(train|test)$", 1).alias("channel"), F.regexp_extract(name, r"_(train|test)$", 1).alias("split")).filter("split <> ''")
    labels = rows.filter("channel = 'y'").select("split", "line_no", F.trim("value").try_cast("int").alias("label"))
    values = rows.filter("channel <> 'y'").groupBy("split", "line_no").agg(F.array_sort(F.collect_list(F.struct("channel", doubles(F.col("value"), r"\s+").alias("v")))).alias("c"))
    both = values.select("split", "line_no", F.col("c.v").alias("series")).join(labels, ["split", "line_no"], "left").withColumn("_s", F.col("split") == "test")
    return numbered(both, ["_s", "line_no"], "sample_id").select("split", "sample_id", "series", "label")


def dsa_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """sample_id (in the order of the folders), activity, person, segment, series (channels x steps), label (activity - 1) and a split made
    here, by label, of folders aNN/pN/sNN.txt of comma-separated rows."""
    rows = numbered_lines(spark, f"{folder}/a*/p*/s*.txt").select(*(F.regexp_extract("file", r"a(\d+)/p(\d+)/s(\d+)\.txt$", k).cast("int").alias(c) for k, c in ((1, "activity"), (2, "person"), (3, "segment"))), "line_no", doubles(F.col("value"), ",").alias("v"))
    steps = rows.groupBy("activity", "person", "segment").agg(F.array_sort(F.collect_list(F.struct("line_no", "v"))).alias("s"))
    width = F.size(F.col("s")[0]["v"])
    series = F.transform(F.sequence(F.lit(0), width - 1), lambda k: F.transform(F.col("s"), lambda r: F.get(r["v"], k)))
    rows = steps.select("activity", "person", "segment", series.alias("series"), (F.col("activity") - 1).alias("label"))
    return resplit(numbered(rows, ["activity", "person", "segment"], "sample_id"))


def eeg_readings(spark: SparkSession, path: str) -> DataFrame:
    """file_name, class_code (0 if the 4th character is c, else 1), trail_num, sensor_pos, sample_num, sensor_val of space-separated files
    with comment lines."""
    lines = numbered_lines(spark, path).filter(~F.col("value").startswith("#"))
    part = F.split(F.trim("value"), r"\s+")
    name = F.regexp_extract("file", r"([^/]+)$", 1)
    code = F.when(F.substring(name, 4, 1) == "c", 0).otherwise(1)
    return lines.filter(F.size(part) >= 4).select(name.alias("file_name"), code.alias("class_code"), part[0].try_cast("int").alias("trail_num"), part[1].alias("sensor_pos"), part[2].try_cast("int").alias("sample_num"), parse_number(part[3]).alias("sensor_val"))


def eeg_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """sample_id, file_name, trail_num, sensors, series, label (class_code) and a split made here, by label, of the files in those subfolders
    whose names begin with c."""
    lines = eeg_series(eeg_readings(spark, f"{folder}/c*/*"))
    rows = numbered(lines.withColumnRenamed("class_code", "label"), ["file_name", "trail_num"], "sample_id")
    return resplit(rows)


def eeg_series(readings: DataFrame) -> DataFrame:
    """file_name, trail_num, class_code, series in the alphabetical order of sensors."""
    one = F.array_sort(F.collect_list(F.struct("sample_num", "sensor_val")))
    per = readings.groupBy("file_name", "trail_num", "class_code", "sensor_pos").agg(one.alias("s"))
    both = F.array_sort(F.collect_list(F.struct("sensor_pos", F.col("s.sensor_val").alias("v"))))
    return per.groupBy("file_name", "trail_num", "class_code").agg(both.alias("c")).select("file_name", "trail_num", "class_code", F.col("c.sensor_pos").alias("sensors"), F.col("c.v").alias("series"))


def point_set(spark: SparkSession, path: str) -> DataFrame:
    """id (position), vec of x and y, num (class, if there is one) of tab-separated files with a header."""
    part = F.split(F.trim("value"), r"\s+")
    lines = numbered_lines(spark, path).filter("line_no > 0").filter(F.size(part) >= 2)
    return numbered(lines, ["file", "line_no"], "id").select("id", F.array(part[0].try_cast("double"), part[1].try_cast("double")).alias("vec"), F.get(part, F.lit(2)).try_cast("int").alias("num"))


def parameters(spark: SparkSession, path: str) -> DataFrame:
    """One row of hyper-parameters per dataset; names in lower case."""
    df = spark.read.csv(path, header=True, schema=PARAMETER_SCHEMA)
    return df.select(*(F.col(c).alias(c.lower()) for c in df.columns))


def get_dataset(spark: SparkSession, name: str, folder: str) -> DataFrame:
    """Dispatch by name, as a user asks for a collection: HAR, DSA, EEG, Fake_<length>_<n>_<channels>, or an ARFF dataset."""
    from chronoloom.sources.synthetic import named_set

    if name.startswith("Fake_"):
        return named_set(spark, name)
    special = {"HAR": lambda s, f: resplit(har_dataset(s, f)), "DSA": dsa_dataset, "EEG": eeg_dataset}
    if name in special:
        return special[name](spark, folder)
    rows = arff_dataset(spark, folder, name)
    return rows if name in OWN_SPLIT else resplit(rows)
