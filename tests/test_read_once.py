"""Queries that read the joined notices several times join them once; pairs of one case are joined by what the case wants."""

from severa.operators import dedup
from severa.plans import registry

from conftest import TINY

registry.queries()  # modules of queries read one another's SQL, in its order


def plan(df):
    return df._jdf.queryExecution().toString()


def test_pairs_of_one_case(spark):
    """the case's own keys join, with nulls as the case counts them."""
    rows = spark.sql("""SELECT id AS notice_id, 'CA' AS state, CASE WHEN id % 7 = 0 THEN ' Acme' ELSE 'acme' END AS employer, CASE WHEN id % 31 <> 0 THEN date_add(DATE '2020-01-01', CAST(id % 11 % 2 AS INT)) END AS notice_date,
        CASE WHEN id % 4 <> 0 THEN id % 3 END AS layoff_count, TIMESTAMP '2020-01-01' + make_interval(0, 0, 0, 0, CAST(id % 5 AS INT)) AS scraped_at,
        CASE WHEN id % 5 <> 1 THEN concat('street ', id % 2) END AS address, CASE WHEN id % 6 <> 2 THEN concat('town ', id % 2) END AS city, CASE WHEN id % 3 <> 1 THEN concat('zip', id % 2) END AS zip FROM range(150)""")
    every = dedup.supersession_pairs(rows).collect()
    for case in range(4):
        got = sorted(map(tuple, dedup.pairs_of_case(rows, case).collect()))
        assert got and got == sorted((r.o_id, r.k_id) for r in every if r["case"] == case)


def test_cross_check_joins_notices_once(spark):
    """F33."""
    from severa.plans import merging

    assert "lineitem" not in plan(merging.cross_check(spark, TINY))


def test_snapshots_join_notices_once(spark, monkeypatch):
    """F23."""
    from severa.plans import ingest

    seen, write = [], ingest.sinks.snapshot
    monkeypatch.setattr(ingest.sinks, "snapshot", lambda rows, *a: (seen.append(plan(rows)), write(rows, *a)))
    ingest.snapshots(spark, TINY).collect()
    assert len(seen) == 3 and not any("lineitem" in p for p in seen)
