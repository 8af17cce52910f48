"""Queries of the cleaning operators (problems 2, 4 and 6) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators.hotdeck import hot_deck, masked_error
from chronoloom.operators.spikes import implausible_readings
from chronoloom.operators.widen import empty_readings, reading_cells, wide_table
from chronoloom.storage import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return implausible_readings(table(spark, d, "eeg_readings"), table(spark, d, "sensors"), table(spark, d, "samples"), table(spark, d, "channels"))


def p2_rolling(spark: SparkSession, d: str) -> DataFrame:
    """The same with a rolling median of 15 readings, for sources whose level drifts: cases per origin, dataset (null for EEG
    readings, which have none) and channel, and in how many series."""
    cases = implausible_readings(table(spark, d, "eeg_readings"), table(spark, d, "sensors"), table(spark, d, "samples"), table(spark, d, "channels"), window=15)
    which = table(spark, d, "samples").select(F.lit("samples").alias("origin"), F.col("sample_id").alias("rec_key"), "dataset").distinct()
    named = cases.join(which, ["origin", "rec_key"], "left")
    return named.groupBy("origin", "dataset", "chan").agg(F.count("*").alias("n_cases"), F.countDistinct("rec_key", "trail_num").alias("n_samples"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return empty_readings(table(spark, d, "eeg_readings"), table(spark, d, "sensors"))


def p4_wide(spark: SparkSession, d: str) -> DataFrame:
    """One row per recording, trial and sample with a column per sensor of the sensor table, of the type that the sensor's unit has."""
    sensors = table(spark, d, "sensors")
    kinds = {"": "string"}  # a unit makes a number; what has none stays text
    rows = sensors.groupBy("sensor_pos").agg(F.max(F.coalesce("unit", F.lit(""))).alias("unit")).orderBy("sensor_pos").collect()  # the columns to be
    return wide_table(reading_cells(table(spark, d, "eeg_readings"), sensors), {r.sensor_pos: kinds.get(r.unit, "double") for r in rows if r.sensor_pos is not None})


def p6_filled(spark: SparkSession, d: str) -> DataFrame:
    return hot_deck(table(spark, d, "samples"), table(spark, d, "channels"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_filled(spark, d).select("sample_id", "field_name", "var_id", "t_pos")


def p6_quality(spark: SparkSession, d: str) -> DataFrame:
    """Error of the filled values where known readings are hidden, beside that of the channel's mean."""
    return masked_error(table(spark, d, "samples"), table(spark, d, "channels"))


QUERIES = {"p2_found": p2_found, "p2_rolling": p2_rolling, "p4_found": p4_found, "p4_wide": p4_wide, "p6_found": p6_found, "p6_filled": p6_filled, "p6_quality": p6_quality}

#: Readings of known sensors with the number each row states.
KNOWN_SQL = r"""
names AS (SELECT upper(trim(sensor_pos)) AS name_key, sensor_pos, phys_lo, phys_hi FROM sensors
          UNION SELECT upper(trim(alt_name)), sensor_pos, phys_lo, phys_hi FROM sensors
          WHERE alt_name IS NOT NULL AND upper(trim(alt_name)) NOT IN (SELECT upper(trim(sensor_pos)) FROM sensors)),
bare AS (SELECT rec_id, trail_num, sample_num, loaded_at, upper(trim(sensor_pos)) AS name_key,
                replace(regexp_replace(trim(sensor_val), '(?i)\s*[uµμ]v$', ''), ',', '.') AS t FROM eeg_readings),
known AS (SELECT rec_id, trail_num, sensor_pos, sample_num, loaded_at, phys_lo, phys_hi,
                 CASE WHEN regexp_full_match(t, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') THEN try_cast(t AS DOUBLE) END AS val
          FROM bare JOIN names USING (name_key)),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rec_id, trail_num, sensor_pos, sample_num
                                   ORDER BY loaded_at DESC, val IS NOT NULL DESC, val DESC) AS rn FROM known) WHERE rn = 1)"""

#: Cells of the samples: one row per present or missing position of each stored channel.
CELLS_SQL = """
once AS (SELECT DISTINCT ON (sample_id) sample_id, dataset, series, device, site FROM samples ORDER BY sample_id, loaded_at),
vars AS (SELECT sample_id, dataset, unnest(range(len(series)))::INT AS var_id, unnest(series) AS vals FROM once),
cells AS (SELECT sample_id, dataset, var_id, unnest(range(len(vals)))::INT AS pos, unnest(vals) AS v FROM vars),
read AS (SELECT c.sample_id, c.dataset, c.var_id, c.pos, k.phys_lo, k.phys_hi,
                CASE WHEN c.v IS NOT NULL AND NOT isnan(c.v) AND c.v IS DISTINCT FROM k.missing_code THEN c.v END AS val
         FROM cells c LEFT JOIN channels k ON c.dataset = k.dataset AND c.var_id = k.var_id)"""

ORACLE = {
    "p2_rolling": f"""WITH {KNOWN_SQL}, {CELLS_SQL},
readings AS (
  SELECT 'eeg_readings' AS origin, NULL AS dataset, rec_id AS rec_key, trail_num, sensor_pos AS chan, sample_num AS pos, val, phys_lo, phys_hi FROM newest WHERE val IS NOT NULL
  UNION ALL SELECT 'samples', dataset, sample_id, -1, var_id::VARCHAR, pos, val, phys_lo, phys_hi FROM read WHERE val IS NOT NULL),
numbered AS MATERIALIZED (SELECT *, row_number() OVER w AS n, lag(val) OVER w AS before, median(val) OVER (w ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS m
  FROM readings WINDOW w AS (PARTITION BY origin, rec_key, trail_num, chan ORDER BY pos)),
dev AS (SELECT a.origin, a.rec_key, a.trail_num, a.chan, a.n, 1.4826 * median(abs(b.val - a.m)) AS s FROM numbered a JOIN numbered b
  ON a.origin = b.origin AND a.rec_key = b.rec_key AND a.trail_num = b.trail_num AND a.chan = b.chan AND b.n BETWEEN a.n - 7 AND a.n + 7 GROUP BY ALL),
flag AS (SELECT numbered.*, abs(val - m) > 8 * s AS far FROM numbered JOIN dev USING (origin, rec_key, trail_num, chan, n)),
runs AS (SELECT *, sum(CASE WHEN before = val THEN 0 ELSE 1 END) OVER (PARTITION BY origin, rec_key, trail_num, chan ORDER BY n) AS same,
                n - row_number() OVER (PARTITION BY origin, rec_key, trail_num, chan, far ORDER BY n) AS stretch FROM flag),
lens AS (SELECT *, count(*) OVER (PARTITION BY origin, rec_key, trail_num, chan, same) AS equal_len,
                count(*) OVER (PARTITION BY origin, rec_key, trail_num, chan, far, stretch) AS far_len FROM runs)
SELECT origin, dataset, chan, count(*) AS n_cases, count(DISTINCT (rec_key, trail_num)) AS n_samples FROM lens
WHERE val < phys_lo OR val > phys_hi OR (far AND far_len <= 3) OR equal_len >= 8 GROUP BY ALL""",
    "p2_found": f"""WITH {KNOWN_SQL}, {CELLS_SQL},
readings AS (
  SELECT 'eeg_readings' AS origin, rec_id AS rec_key, trail_num, sensor_pos AS chan, sample_num AS pos, val, phys_lo, phys_hi FROM newest WHERE val IS NOT NULL
  UNION ALL SELECT 'samples', sample_id, -1, var_id::VARCHAR, pos, val, phys_lo, phys_hi FROM read WHERE val IS NOT NULL),
m AS (SELECT origin, rec_key, trail_num, chan, median(val) AS m FROM readings GROUP BY ALL),
dev AS (SELECT r.*, m.m, abs(val - m.m) AS dv FROM readings r JOIN m USING (origin, rec_key, trail_num, chan)),
s AS (SELECT origin, rec_key, trail_num, chan, 1.4826 * median(dv) AS s FROM dev GROUP BY ALL),
flag AS (SELECT d.*, d.dv > 8 * s.s AS far,
                row_number() OVER w AS n, lag(val) OVER w AS before FROM dev d JOIN s USING (origin, rec_key, trail_num, chan)
         WINDOW w AS (PARTITION BY origin, rec_key, trail_num, chan ORDER BY pos)),
runs AS (SELECT *, sum(CASE WHEN before = val THEN 0 ELSE 1 END) OVER (PARTITION BY origin, rec_key, trail_num, chan ORDER BY n) AS same,
                n - row_number() OVER (PARTITION BY origin, rec_key, trail_num, chan, far ORDER BY n) AS stretch FROM flag),
lens AS (SELECT *, count(*) OVER (PARTITION BY origin, rec_key, trail_num, chan, same) AS equal_len,
                count(*) OVER (PARTITION BY origin, rec_key, trail_num, chan, far, stretch) AS far_len FROM runs)
SELECT origin, rec_key, trail_num, chan, pos FROM lens
WHERE val < phys_lo OR val > phys_hi OR (far AND far_len <= 3) OR equal_len >= 8""",
    "p4_found": f"""WITH {KNOWN_SQL},
entities AS (SELECT DISTINCT rec_id, trail_num, sample_num FROM newest),
wanted AS (SELECT DISTINCT rec_id, trail_num, sensor_pos FROM newest WHERE val IS NOT NULL)
SELECT e.rec_id, e.trail_num, e.sample_num, w.sensor_pos FROM entities e JOIN wanted w USING (rec_id, trail_num)
LEFT JOIN newest v ON v.rec_id = e.rec_id AND v.trail_num = e.trail_num AND v.sample_num = e.sample_num AND v.sensor_pos = w.sensor_pos
WHERE v.val IS NULL""",
    "p4_wide": f"""WITH {KNOWN_SQL}
SELECT rec_id, trail_num, sample_num, {', '.join(f"max(val) FILTER (sensor_pos = '{s}') AS {s}" for s in ('AF3', 'AF4', 'C3', 'C4', 'CZ', 'F3', 'F4', 'F7', 'F8', 'FC5', 'FC6', 'FP1', 'FP2', 'FZ', 'O1', 'O2', 'OZ', 'P3', 'P4', 'P7', 'P8', 'PZ', 'T7', 'T8'))}
FROM newest GROUP BY ALL""",
    "p6_found": f"""WITH {CELLS_SQL},
grid AS (SELECT o.sample_id, k.var_id, unnest(range(k.series_len))::INT AS pos FROM once o JOIN channels k USING (dataset))
SELECT g.sample_id, 'x' AS field_name, g.var_id, g.pos AS t_pos FROM grid g
LEFT JOIN read r ON r.sample_id = g.sample_id AND r.var_id = g.var_id AND r.pos = g.pos WHERE r.val IS NULL
UNION ALL SELECT sample_id, f, -1, -1 FROM (SELECT sample_id, unnest(['device', 'site']) AS f, unnest([device, site]) AS w FROM once)
WHERE w IS NULL OR lower(trim(w)) IN ('', '-', '?', 'n/a', 'na', 'nan', 'nil', 'none', 'null', 'unknown', 'not known', 'unk', 'unspecified', 'missing', 'tbd')""",
}
