"""Entity-attribute-value readings: name resolution, number parsing, latest row per cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.numbers import parse_number


def sensor_names(sensors: DataFrame) -> DataFrame:
    """name_key (upper case, no outer blanks) -> sensor_pos with its bounds and its place among the sorted names, from 0; alternative
    names lead to the same sensor. A key that is both a name and another sensor's alternative name is taken as the name."""
    sensors = sensors.filter("sensor_pos is not null").withColumn("place", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("sensor_pos")) - 1)  # the sensors, which become columns
    cols = ["sensor_pos", "place", "phys_lo", "phys_hi"]
    own = sensors.select(F.upper(F.trim("sensor_pos")).alias("name_key"), F.lit(0).alias("pref"), *cols)
    other = sensors.filter(F.col("alt_name").isNotNull()).select(F.upper(F.trim("alt_name")).alias("name_key"), F.lit(1).alias("pref"), *cols)
    return own.unionByName(other).groupBy("name_key").agg(F.min_by(F.struct(*cols), F.struct("pref", "sensor_pos")).alias("s")).select("name_key", "s.*")


def known_readings(readings: DataFrame, sensors: DataFrame) -> DataFrame:
    """Rows of known sensors: rec_id, trail_num, sensor_pos (as in sensors), sample_num, sensor_val as it is, val double or null, loaded_at,
    place, phys_lo, phys_hi. Rows with unknown or null names, or with a null key, are left out; other columns are dropped."""
    cast = readings.withColumn("_cast", F.col("sensor_val").try_cast("double"))
    keyed = cast.filter(F.col("rec_id").isNotNull() & F.col("trail_num").isNotNull() & F.col("sample_num").isNotNull()).select(
        "rec_id", "trail_num", "sample_num", "sensor_val", F.upper(F.trim("sensor_pos")).alias("name_key"), parse_number(F.col("sensor_val"), F.col("_cast")).alias("val"), "loaded_at"
    )
    return keyed.join(sensor_names(sensors), "name_key").drop("name_key")
