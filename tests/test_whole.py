"""Operators on tables whose large or odd groups a cut would lose."""

import random

import pandas as pd
from pyspark.sql import functions as F

from severa.operators import linkage


def test_key_pairs(spark):
    rows = spark.createDataFrame([(i, "hot" if i < 1201 else f"k{i // 2}", f"n{i}") for i in range(1300)] + [(1, "hot", "n1"), (2000, None, "x")], "id long, key string, name string")
    got = linkage.key_pairs(rows, "id", "key", "name").select("a", "b", F.col("x.name").alias("na"), F.col("y.name").alias("nb")).collect()
    want = {(a, b) for a in range(1201) for b in range(a + 1, 1201)} | {(a, a + 1) for a in range(1202, 1300, 2)}
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want and all((r.na, r.nb) == (f"n{r.a}", f"n{r.b}") for r in got)


def test_hot_group_keeps_its_pairs(spark, tmp_path):
    """Over 1,000 companies of one parent: the pairs are those of the oracle's SQL."""
    from oracle import compare
    from severa.plans import registry

    spark.range(0, 1400 * 97, 97).selectExpr("id as c_custkey", "concat('Customer#', id) as c_name", "'M' as c_mktsegment", "cast(1 as int) as c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    for t in ("lineitem", "orders", "supplier", "part", "nation", "region", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        spark.range(1).write.parquet(f"{tmp_path}/{t}.parquet")
    for name in ("ml27_weak_labels", "ml30_merge_suggestions"):
        assert not compare(registry.queries()[name](spark, str(tmp_path)), registry.oracle_sql()[name], str(tmp_path))


def test_linkage_constraints(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9, -1), (2, 3, 0.95, None), (1, 3, 0.9, None), (4, 5, 0.0, 1), (5, 6, 0.9, None), (4, 6, 0.9, None), (7, 8, 0.9, 1), (7, 8, None, -1), (8, 9, 0.3, None)], "a long, b long, score double, link int")
    for most in (2000, 1):
        got = {r.node: r.cluster for r in linkage.cluster_pairs(pairs, most=most).collect()}
        assert got == {1: 1, 2: 2, 3: 2, 4: 4, 5: 4, 6: 4, 7: 7, 8: 8, 9: 9}


def test_average_linkage_by_hand():
    from severa.operators.linkage import _agglomerate

    rnd = random.Random(5)
    for _ in range(150):
        n, tau = rnd.randint(2, 9), rnd.choice([0.4, 0.6, 0.8])
        pairs = {(a, b): (rnd.randint(1, 10) / 10, rnd.choice([0] * 8 + [-1, 1])) for a in range(n) for b in range(a + 1, n) if rnd.random() < 0.7} or {(0, 1): (0.5, 0)}
        pairs = {p: (1.0 if k > 0 else s, k) for p, (s, k) in pairs.items()}
        groups = {i: {i} for p in pairs for i in p}
        ban = lambda x, y: any(pairs.get((min(i, j), max(i, j)), (0, 0))[1] < 0 for i in groups[x] for j in groups[y])  # noqa: B023, E731
        where = lambda i: next(g for g, m in groups.items() if i in m)  # noqa: B023, E731
        join = lambda x, y: groups[x].update(groups.pop(y))  # noqa: B023, E731
        for p in sorted(p for p, (_, k) in pairs.items() if k > 0):
            x, y = sorted(map(where, p))
            if x != y and not ban(x, y):
                join(x, y)
        while True:
            mean = {(x, y): sum(pairs.get((min(i, j), max(i, j)), (0, 0))[0] for i in groups[x] for j in groups[y]) / len(groups[x]) / len(groups[y]) for x in groups for y in groups if x < y and not ban(x, y)}
            # Equal means that sum in another order may differ in the last bit.
            best = max(mean, key=lambda p: (round(mean[p], 9), -p[0], -p[1]), default=None)
            if best is None or mean[best] < tau - 1e-9:
                break
            join(*best)
        rows = pd.DataFrame([(a, b, s, k) for (a, b), (s, k) in pairs.items()], columns=["a", "b", "score", "link"])
        out = _agglomerate(tau - 1e-9)(rows)
        assert dict(zip(out["node"], out["cluster"], strict=True)) == {i: g for g, m in groups.items() for i in m}


def test_blocking_families(spark):
    hot = [(i, f"Acme Regional Distribution Works {i % 30}", ["S1"]) for i in range(150)]
    rows = [*hot, (500, "Zyx Quorum Inc", []), (501, "Other Quorum", ["S2"]), (502, "Brill Tools", ["S3", "S4"]), (503, "Brill Yard Machines", ["S4"]), (504, "Kmart Corporation", ["S5"]), (505, "K-Mart Corporation", ["S6"]), (506, None, ["S7"])]
    got = {(r.a, r.b) for r in linkage.candidate_pairs(spark.createDataFrame(rows, "node long, name string, states array<string>")).collect()}
    assert {(500, 501), (502, 503), (504, 505)} <= got
    # The words of 150 names are too common; their trigrams still join each to its ten nearest.
    assert {i for p in got for i in p} >= set(range(150))


def test_whole_tables(spark):
    """The queries beside those whose SQL keeps a subset see every row."""
    from conftest import TINY
    from severa.plans import registry

    lines = spark.read.parquet(f"{TINY}/lineitem.parquet").select("l_suppkey", "l_partkey").distinct().collect()
    nodes = {r.l_suppkey for r in lines} | {r.l_partkey + 1_000_000_000_000 for r in lines}
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in lines:
        x, y = sorted((find(r.l_suppkey), find(r.l_partkey + 1_000_000_000_000)))
        root[y] = x
    run = registry.queries()
    assert {r.node: r.root for r in run["fn31_all_components"](spark, TINY).collect()} == {n: find(n) for n in nodes}
    sqls = registry.oracle_sql()
    for name, whole in (("jn42_subscription_matches", "jn42_all_subscriptions"), ("str01_since_watermark", "str01_all_subscriptions"), ("src13_by_synonyms", "src13_all_by_synonyms"), ("agg47_empty_years", "agg47_all_empty_years")):
        assert sqls[whole] == sqls[name]


def _random_pairs(rnd, n, share):
    pairs = [(a, b, rnd.randint(0, 10) / 10, rnd.choice([None] * 20 + [-1, 1])) for a in range(n) for b in range(a + 1, n) if rnd.random() < share]
    return pairs + [(a, b, None, -1) for a, b, *_ in pairs[::40]]


def test_clusters_do_not_depend_on_size(spark):
    """a component has the same clusters by average linkage whether a task holds it or it is joined by rounds; a
    chain, which single linkage would join, is not one cluster."""
    rnd = random.Random(8)
    rows = _random_pairs(rnd, 40, 0.3) + [(i, i + 1, 0.9, None) for i in range(100, 120)]
    rows += [(a, b, 1.0, None) for a in range(200, 206) for b in range(a + 1, 206)]
    pairs = spark.createDataFrame(rows, "a long, b long, score double, link int").repartition(3)
    held, joined = ({r.node: r.cluster for r in linkage.cluster_pairs(pairs, 0.6, 0.2, most).collect()} for most in (2000, 1))
    assert held == joined and set(held) == {x for a, b, s, k in rows if (1 if k == 1 else s or 0) >= 0.2 for x in (a, b)}
    assert len({held[i] for i in range(100, 121)}) > 5 and {held[i] for i in range(200, 206)} == {200}


def test_dense_and_sparse_agree(monkeypatch):
    rnd = random.Random(9)
    for _ in range(60):
        rows = _random_pairs(rnd, rnd.randint(2, 30), rnd.choice((0.2, 0.6, 1))) or [(0, 1, 0.5, None)]
        columns = {c: [r[i] or 0 for r in rows] for i, c in enumerate(("a", "b", "score", "link"))}
        tau, got = rnd.choice((0.4, 0.7, 1.0)), []
        for dense in (0, 2000):
            monkeypatch.setattr(linkage, "DENSE", dense)
            monkeypatch.setattr(linkage, "FILL", 0)
            got.append({c: v.tolist() for c, v in linkage._agglomerate(tau)(columns).items()})
        assert got[0] == got[1]


def test_clusters_of_names(spark):
    """a key clustered from its nodes has the clusters of all its pairs, however few nodes a task may hold."""
    rnd = random.Random(10)
    names = [f"Customer#{rnd.choice((rnd.randrange(10**9), i // 3)):09d}" for i in range(90)] + ["", None]
    rows = [(i, name, rnd.choice([None, None, f"U{i // 2}"]), None if i % 30 == 29 else f"g{i % 4}") for i, name in enumerate(names)]
    df = spark.createDataFrame(rows, "node long, name string, uid string, key string")
    pairs = linkage.key_pairs(df, "node", "key", "name", "uid")
    link = F.when(F.col("x.uid") == F.col("y.uid"), 1).when(F.expr("x.uid is not null and y.uid is not null"), -1)
    scored = pairs.select("a", "b", linkage.name_similarity("x.name", "y.name").alias("score"), link.alias("link"))
    want = {tuple(r) for r in linkage.cluster_pairs(scored, 0.97, 0.9).collect()}
    assert len({c for _, c in want}) < len(want)
    for most in (2000, 10):
        got = [tuple(r) for r in linkage.cluster_names(df, "key", 0.97, 0.9, most).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert "MapInArrow" in linkage.cluster_names(df, "key", 0.97, 0.9)._jdf.queryExecution().toString()
