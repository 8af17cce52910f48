"""Queries over the events table as a stream, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.storage import materialize, table
from chronoloom.streaming.windows import run_once, sliding_covariances, windowed_rates

WIDTH, STRIDE = 6, 3


def _streamed(df: DataFrame, files: int) -> DataFrame:
    """A table as a stream of files, some per batch."""
    held = materialize(df, "streamed")
    return df.sparkSession.readStream.schema(held.schema).option("maxFilesPerTrigger", files).parquet(held._chronoloom_path)  # noqa: SLF001


def stream_rates(spark: SparkSession, d: str) -> DataFrame:
    """Count and sum of events per type in windows of two hours, hour by hour."""
    events = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    out = run_once(windowed_rates(_streamed(events, 4), "ts", "2 hours", "1 hour", "1 day", "event_type", value="value"), "complete")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select(text("start"), text("end"), "event_type", "n", (F.round("total", 4) + F.lit(0.0)).alias("total"))


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Covariances of value and length of the text in windows of a user's events, which come in no order."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = table(spark, d, "events").filter("user_id is not null").select(F.col("user_id").alias("sample_id"), place.alias("t"), F.array(F.coalesce("value", F.lit(0.0)), F.coalesce(F.length("props"), F.lit(0)).cast("double")).alias("vec"))
    out = run_once(sliding_covariances(_streamed(rows.withColumn("t", F.col("t").cast("long")).repartition(6, "t"), 2), WIDTH, STRIDE))
    return out.select("sample_id", "win_id", F.posexplode("cov").alias("idx", "cov")).withColumn("cov", F.round("cov", 4) + F.lit(0.0))


QUERIES = {f.__name__: f for f in (stream_rates, stream_windows)}

ORACLE = {
    "stream_rates": """WITH w AS (SELECT date_trunc('hour', ts) - to_hours(k) AS s, event_type, value FROM events, range(2) r(k) WHERE ts IS NOT NULL)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, strftime(s + to_hours(2), '%Y-%m-%d %H:%M:%S') AS "end", event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM w GROUP BY s, event_type""",
    "stream_windows": f"""WITH r AS (SELECT user_id AS sample_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, coalesce(value, 0) AS a, coalesce(length(props), 0)::DOUBLE AS b FROM events WHERE user_id IS NOT NULL),
n AS (SELECT sample_id, count(*) AS n FROM r GROUP BY 1),
w AS (SELECT r.*, unnest(range(greatest(0, ceil((t - {WIDTH} + 1) / {STRIDE})::INT), least((n - {WIDTH}) // {STRIDE}, t // {STRIDE}) + 1)) AS win_id FROM r JOIN n USING (sample_id) WHERE n >= {WIDTH}),
c AS (SELECT sample_id, win_id, covar_samp(a, a) AS aa, covar_samp(a, b) AS ab, covar_samp(b, b) AS bb FROM w GROUP BY ALL)
SELECT sample_id, win_id, idx, round(CASE idx WHEN 0 THEN aa WHEN 1 THEN ab ELSE bb END, 4) + 0.0 AS cov FROM c, (SELECT unnest([0, 1, 2])::INT AS idx)""",
}
