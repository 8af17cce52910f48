"""python tests/standin.py SF_DIR: seconds of plain single-process numpy and pandas for the work of some headline queries, as a stand-in for
published figures, of which there are none. Reading the tables is counted, as it is in bench.py."""

from __future__ import annotations

import sys
import time

import numpy as np
import pyarrow.parquet as pq


def embeddings(d: str) -> tuple[np.ndarray, np.ndarray]:
    t = pq.read_table(f"{d}/embeddings.parquet")
    return np.stack(t["embedding"].to_numpy()).astype(float), t["label"].to_numpy()


def distances(x: np.ndarray) -> np.ndarray:
    return np.stack([np.abs(x - row).sum(1) for row in x])


def percentile_eps(d: str) -> None:
    m = distances(embeddings(d)[0])
    np.percentile(m[m != 0], 8)


def kdist_curve(d: str) -> None:
    np.sort(np.sort(distances(embeddings(d)[0]), axis=1)[:, 5])


def silhouette(d: str) -> None:
    x, label = embeddings(d)
    m = distances(x)
    sums = np.stack([m[:, label == c].sum(1) for c in np.unique(label)], axis=1)
    assert sums.shape[0] == len(x)


def dbscan_quality(d: str) -> None:
    x, label = embeddings(d)
    m = distances(x)
    near = m <= np.percentile(m[m != 0], 0.5)
    core = near.sum(1) >= 3
    of = np.full(len(x), -1)
    for i in np.flatnonzero(core):
        if of[i] < 0:
            todo, of[i] = [i], i
            while todo:
                for j in np.flatnonzero(near[todo.pop()] & (of < 0)):
                    of[j] = i
                    if core[j]:
                        todo.append(j)
    np.unique(np.stack([of, label]), axis=1, return_counts=True)


def dpc_centers(d: str) -> None:
    m = distances(embeddings(d)[0])
    rho = np.exp(-((m / 8.0) ** 2)).sum(1)
    delta = np.where(rho[None, :] > rho[:, None], m, np.inf).min(1)
    np.argsort(-rho * np.where(np.isfinite(delta), delta, m.max()))[:6]


def fill_na(d: str) -> None:
    import pandas as pd

    for series in pq.read_table(f"{d}/samples.parquet", columns=["series"])["series"].to_pylist():
        for channel in series or []:
            pd.Series(channel or [], dtype=float).ffill().bfill()


def p4_wide(d: str) -> None:
    import pandas as pd

    t = pq.read_table(f"{d}/eeg_readings.parquet").to_pandas()
    t["name"], t["val"] = t.sensor_pos.str.strip().str.upper(), pd.to_numeric(t.sensor_val.str.strip(), errors="coerce")
    t.sort_values("loaded_at").drop_duplicates(["rec_id", "trail_num", "sample_num", "name"], keep="last").pivot(index=["rec_id", "trail_num", "sample_num"], columns="name", values="val")


if __name__ == "__main__":
    for f in (percentile_eps, kdist_curve, silhouette, dbscan_quality, dpc_centers, fill_na, p4_wide):
        start = time.time()
        f(sys.argv[1])
        print(f.__name__, round(time.time() - start, 2), flush=True)
