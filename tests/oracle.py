"""Run a registered query and its DuckDB oracle on the same tables and compare them as the driver does."""

from __future__ import annotations

import datetime
import decimal
import math
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, decimal.Decimal):
        return float(f"{float(x):.9g}") + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    if isinstance(x, dict):
        return tuple(sorted((plain(k), plain(v)) for k, v in x.items()))
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def duck_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.sql(f"create view {t} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    r = con.sql(sql)
    order = sorted(range(len(r.columns)), key=lambda i: r.columns[i])
    return [r.columns[i] for i in order], Counter(tuple(plain(row[i]) for i in order) for row in r.fetchall())


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, Counter(tuple(plain(row[c]) for c in cols) for row in df.select(*[f"`{c}`" for c in cols]).collect())


def compare(df, sql: str, sf_dir: str) -> str:
    """Empty if both agree, else what differs."""
    t = time.time()
    cols, got = spark_rows(df)
    spent = time.time() - t
    want_cols, want = duck_rows(sql, sf_dir)
    if cols != want_cols:
        return f"columns {cols} / {want_cols}"
    if got != want:
        return f"{sum(got.values())} / {sum(want.values())} rows; only here {list((got - want).items())[:3]}; only oracle {list((want - got).items())[:3]}"
    print(f"same {sum(got.values())} rows, spark {spent:.1f} s, duckdb {time.time() - t - spent:.1f} s")
    return ""


if __name__ == "__main__":
    import os
    import sys

    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from severa.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in [n for n in queries if not sys.argv[1:] or any(n.startswith(a) for a in sys.argv[1:])]:
        try:
            t = time.time()
            df = queries[name](spark, sf)
            said = compare(df, oracles[name], sf) if name in oracles else f"no oracle; {df.count()} rows in {time.time() - t:.1f} s"
            if said and name in oracles:
                bad += 1
            if said or len(sys.argv) > 1:
                print(name, said, flush=True)
        except Exception as e:  # the next query is still of use
            bad += 1
            print(name, "FAILED", str(e)[:900], flush=True)
    print(f"{len(queries)} queries, {bad} bad")
