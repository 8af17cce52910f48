"""Samples whose label shares match a plan's targets.

Each label of a plan has an acceptance probability, from its target and what was observed, slightly raised. Rows are accepted
independently by a hash of plan and sample. Then counts are made exact: the hash range of a label is cut into steps whose counts
are known, whole steps are kept, and only the step in which the quota is reached is ranked, so that no label's rows come
together in one task. Labels short by bad luck are topped up from the rows not accepted.

Defined results: a sample_id counts once (rows that repeat it are the same); rows with null id, dataset or label are not usable;
a label without records has available 0 and gets nothing; a dataset without records has quota 0 for all its labels, and only
the minimum can fail; ties of the hash are broken by sample_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.storage import materialize

STEPS = 1024


def usable_samples(samples: DataFrame) -> DataFrame:
    rows = samples.filter(F.col("sample_id").isNotNull() & F.col("dataset").isNotNull() & F.col("label").isNotNull())
    return rows.groupBy("sample_id").agg(F.min(F.struct("dataset", "label")).alias("r")).select("sample_id", "r.*")


def plan_quotas(samples: DataFrame, targets: DataFrame, slack: float = 0.02) -> DataFrame:
    """One row per plan and label: usable and available rows, wanted (not rounded), quota (the least whole number that
    satisfies target and minimum, as far as there are rows) and the probability."""
    per_label = usable_samples(samples).groupBy("dataset", "label").agg(F.count("*").alias("available"))
    per_set = per_label.groupBy("dataset").agg(F.sum("available").alias("usable"))
    plan = targets.join(per_set, "dataset", "left").join(per_label, ["dataset", "label"], "left").fillna(0, ["usable", "available"])
    wanted = F.col("target_share") * F.col("sample_frac") * F.col("usable")
    quota = F.least("available", F.greatest(F.ceil("wanted").cast("long"), F.when(F.col("usable") > 0, F.col("min_rows")).otherwise(0).cast("long")))
    chance = F.least(F.lit(1.0), (F.col("quota") * (1 + slack) + 4 * F.sqrt("quota") + 4) / F.greatest("available", F.lit(1)))
    return (
        plan.withColumn("wanted", wanted)
        .withColumn("quota", quota)
        .withColumn("chance", chance)
        .select("plan_id", "dataset", "label", "label_name", "target_share", "min_rows", "usable", "available", "wanted", "quota", "chance")
    )


def _uniform(seed: int) -> Column:
    h = F.xxhash64(F.lit(seed), F.col("plan_id"), F.col("sample_id"))
    return F.pmod(h, F.lit(1 << 52)) / F.lit(float(1 << 52))


def _first(rows: DataFrame, step: Column) -> DataFrame:
    """The first `quota` rows of each plan and label by (u, sample_id)."""
    keys = ["plan_id", "label"]
    rows = rows.withColumn("step", step)
    counts = rows.groupBy(*keys, "step").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("step")) - F.col("n")
    counts = counts.withColumn("before", before).drop("n")
    rank = F.row_number().over(Window.partitionBy(*keys, "step").orderBy("u", "sample_id"))
    whole = rows.join(counts, [*keys, "step"]).filter("before < quota")
    return whole.withColumn("rank", rank).filter(F.col("before") + F.col("rank") <= F.col("quota")).drop("step", "before", "rank")


def draw(samples: DataFrame, targets: DataFrame, seed: int = 7, quotas: DataFrame | None = None) -> DataFrame:
    """plan_id, dataset, label, sample_id of the rows drawn; exactly quota of each label. quotas: of plan_quotas, if made already."""
    quotas = materialize(plan_quotas(samples, targets), "quotas") if quotas is None else quotas
    rows = usable_samples(samples).join(quotas.filter("quota > 0").select("plan_id", "dataset", "label", "quota", "chance"), ["dataset", "label"]).withColumn("u", _uniform(seed))
    taken = rows.filter(F.col("u") < F.col("chance"))
    first = _first(taken, F.floor(F.col("u") / F.col("chance") * STEPS).cast("int"))
    got = first.groupBy("plan_id", "label").agg(F.count("*").alias("got"))
    short = quotas.filter("quota > 0").join(got, ["plan_id", "label"], "left").withColumn("rest", F.col("quota") - F.coalesce("got", F.lit(0))).filter("rest > 0").select("plan_id", "label", "rest")
    more = rows.filter(F.col("u") >= F.col("chance")).join(short, ["plan_id", "label"]).withColumn("quota", F.col("rest")).drop("rest")
    cols = ["plan_id", "dataset", "label", "sample_id"]
    return first.select(*cols).unionByName(_first(more, F.floor(F.col("u") * STEPS).cast("int")).select(*cols))


def draw_report(samples: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """Per plan and label: wanted, quota, drawn, actual share, rows short of the target and of the minimum, failed."""
    quotas = materialize(plan_quotas(samples, targets), "quotas")
    drawn = draw(samples, targets, seed, quotas).groupBy("plan_id", "label").agg(F.count("*").alias("drawn"))
    plan = quotas.join(drawn, ["plan_id", "label"], "left").fillna(0, ["drawn"])
    total = F.sum("drawn").over(Window.partitionBy("plan_id"))
    failed = (F.col("drawn") < F.col("wanted")) | (F.col("drawn") < F.col("min_rows"))
    gap = F.greatest(F.col("wanted") - F.col("drawn"), F.col("min_rows") - F.col("drawn"), F.lit(0.0))
    return plan.withColumn("failed", failed).withColumn("actual_share", F.when(total > 0, F.col("drawn") / total)).withColumn("short", gap).drop("chance")
