"""python tests/compare.py SF_DIR [NAME...]: each query beside its SQL in DuckDB: rows, columns and values."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings hyper_parameters channels sensors recordings eeg_readings samples ctrans label_targets eval_items mix_targets".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return "[" + ",".join(plain(x) for x in v) + "]"
    if isinstance(v, (int, float)) or type(v).__name__.startswith(("int", "float", "uint")):
        return f"{float(v):.6g}" if float(v) else "0"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def duck(sf_dir, sql):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    return [c[0] for c in cur.description], cur.fetchall()


def compare(spark, sf_dir, name, f, sql):
    t = time.time()
    df = f(spark, sf_dir)
    got = df.collect()
    took = time.time() - t
    if sql is None:
        return f"{name}: {len(got)} rows, {took:.1f} s, no SQL; {df.columns}", None
    t = time.time()
    columns, want = duck(sf_dir, sql)
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    same = sorted(df.columns) == sorted(columns) and a == b
    text = f"{name}: {'same' if same else 'DIFFERENT'}, {len(a)} and {len(b)} rows, {took:.1f} s and {time.time() - t:.1f} s"
    if not same:
        x, y = set(a), set(b)
        text += f"\n   {sorted(df.columns)} {sorted(columns)}\n   only ours {sorted(x - y)[:4]}\n   only SQL {sorted(y - x)[:4]}"
    return text, same


if __name__ == "__main__":
    import __spark_entry__ as e

    from chronoloom.session import local_session

    spark = local_session(8)
    q, o = e.queries(), e.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or q:
        try:
            text, same = compare(spark, sys.argv[1], name, q[name], o.get(name))
        except Exception as x:  # noqa: BLE001
            text, same = f"{name}: FAILED {type(x).__name__} {str(x)[:1500]}", False
        bad += same is False
        print(text, flush=True)
    print("bad", bad)
