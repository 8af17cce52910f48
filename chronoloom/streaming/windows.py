"""The same windows on streams: count-based hops per sample with state, and event-time windows with watermarks."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.series import packed


def sliding_covariances(stream: DataFrame, width: int, stride: int, idle: str | None = None) -> DataFrame:
    """sample_id, win_id, cov of count-based windows over rows (sample_id, t, vec), t = 0, 1, 2, ... per sample. Rows may come in any
    order, also across batches: a row waits in the state until those before it have come, and a row that came already is ignored.
    A window is emitted when its last row is there. State of a sample: the last width rows and those that wait. idle ("1 hour"), for
    streams that go on: a sample without rows for that time is forgotten, and its numbers are then taken to begin anew; such a stream
    has batches without data, so it does not end by itself."""
    limit = pd.Timedelta(idle) // pd.Timedelta("1ms") if idle else 0

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        if state.hasTimedOut:
            state.remove()
            return
        done, held, early = pickle.loads(state.get[0]) if state.exists else (0, None, {})  # noqa: S301
        for f in frames:
            early |= {int(t): np.asarray(v, float) for t, v in zip(f.t, f.vec, strict=True) if t >= done}
        new = []
        while done + len(new) in early:
            new.append(early.pop(done + len(new)))
        out = []
        if new:
            rows = np.stack(new) if held is None else np.vstack([held, new])
            first, end = done - (0 if held is None else len(held)), done + len(new)
            win = max(0, -(-first // stride))
            while win * stride + width <= end:
                if win * stride + width > done:
                    a = win * stride - first
                    out.append((key[0], win, packed(np.cov(rows[a : a + width].T).reshape(rows.shape[1], -1)).tolist()))
                win += 1
            done, held = end, rows[-width:]
        state.update((pickle.dumps((done, held, early)),))
        if limit:
            state.setTimeoutDuration(limit)
        yield pd.DataFrame(out, columns=["sample_id", "win_id", "cov"])

    return stream.groupBy("sample_id").applyInPandasWithState(step, "sample_id long, win_id long, cov array<double>", "held binary", "append", "ProcessingTimeTimeout" if limit else "NoTimeout")


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Everything the stream's source holds now, through the stream, as a table in the shared folder. mode: append, or complete for
    aggregates that are not final."""
    from chronoloom.storage import shared_dir

    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = stream.writeStream.trigger(availableNow=True).outputMode(mode).option("checkpointLocation", f"{folder}/state")
    if mode == "append":
        query = out.format("parquet").option("path", f"{folder}/rows").start()
    else:
        query = out.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/rows")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def windowed_rates(stream: DataFrame, time: str, size: str, slide: str, late: str, *keys: str, value: str) -> DataFrame:
    """Count and sum per event-time window and keys; rows later than the watermark are left out on a stream."""
    w = F.window(time, size, slide)
    return stream.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")
