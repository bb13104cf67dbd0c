"""Vector operators against brute force: search, clustering and hard negatives."""

import hashlib
from itertools import pairwise

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from severa.llm import hard_negatives, vectors
from severa.llm.centroid_clustering import cluster_vectors
from severa.llm.hard_negatives import hilbert, mine
from severa.llm.queries import QUERIES
from severa.llm.vector_search import nearest

MIDDLE = "/root/testdata/sf0.1"
NAN, INF = float("nan"), float("inf")


def read(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    return np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)


def top(ids, v, asked, k):
    out = {}
    for q in np.flatnonzero(asked):
        score = (v * v[q]).sum(1)
        order = [i for i in np.lexsort((ids, -score)) if i != q][:k]
        out[int(ids[q])] = [(int(ids[i]), score[i]) for i in order]
    return out


def recall(df, want):
    got = {}
    for r in df.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, len(found) + 1))
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in pairwise(found))
        hits += len({i for _, i, _ in found} & {i for i, _ in want[q]})
    return hits / sum(len(x) for x in want.values())


@pytest.mark.parametrize("sf", [SMALL, MIDDLE])
def test_search_recall_of_the_query(spark, sf):
    ids, v = read(spark, sf)
    want = top(ids, v, ids % 20 == 0, 20)
    df = QUERIES["op11_vector_search"](spark, sf)
    assert recall(df, want) >= 0.93
    scores = {(q, i): s for q, x in top(ids, v, ids % 20 == 0, len(ids)).items() for i, s in x}
    assert all(abs(scores[r["query_id"], r["vec_id"]] - r["score"]) < 1e-12 for r in df.collect())


def test_search_of_clustered_vectors_with_a_hot_one(spark, monkeypatch):
    """Lengths differ, a third of the rows is one vector, and parts are small, so that its bucket is many parts."""
    monkeypatch.setattr(vectors, "LEAST_PART", 256)
    monkeypatch.setattr("severa.llm.vector_search.part_count", lambda n: -(-n // 256))
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 16))
    v = centres[rng.integers(0, 40, 3000)] * rng.uniform(0.5, 2, (3000, 1)) + 0.1 * rng.standard_normal((3000, 16))
    v[:1000] = v[0]
    ids = np.arange(3000)
    df = spark.createDataFrame([(int(i), x) for i, x in zip(ids, v.tolist(), strict=True)], "vec_id long, embedding array<double>").repartition(5)
    asked = ids % 20 == 7
    want = top(ids, v, asked, 10)
    got = nearest(df, F.col("vec_id") % 20 == 7, k=10, most_queries=40)
    assert recall(got, want) >= 0.9
    hot = {r["rank"]: r["vec_id"] for r in got.where("query_id = 7").collect()}
    if want[7][0][0] == 0:
        assert [hot[i + 1] for i in range(10)] == [i for i, _ in want[7]]


def test_search_of_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [NAN, 1.0]), (5, [INF, 1.0]), (6, [None, 1.0]), (None, [3.0, 3.0]), (7, [2.0]), (8, [1.0, 1.0]), (8, [1.0, 1.0]), (9, [1.0, 1.0]), (10, []), (-20, [0.5, 0.5])]
    df = spark.createDataFrame([(i, v, "x", 0.5) for i, v in rows], "vec_id long, embedding array<double>, score string, rank double")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in nearest(df, F.col("vec_id").isin(1, 8, -20, 3), k=20).collect()}
    assert [got[1, i] for i in range(1, 5)] == [(7, 2.0), (8, 1.0), (9, 1.0), (-20, 0.5)]
    assert [got[8, i][0] for i in range(1, 5)] == [7, 9, -20, 1] or [got[8, i] for i in range(1, 5)] == [(7, 2.0), (9, 2.0), (-20, 1.0), (1, 1.0)]
    assert (1, 5) not in got and not any(q == 3 for q, _ in got)
    assert nearest(df.limit(0), F.lit(True)).count() == 0
    assert nearest(df, F.lit(None).cast("boolean")).columns == ["query_id", "rank", "vec_id", "score"]
    assert nearest(df.where("vec_id = 1"), F.lit(True)).count() == 0


def plain_clusters(ids, v, k, rounds, seed=2):
    """v: rows of Python integers."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, hashlib.sha256(f"{seed}:{ids[i]}".encode()).hexdigest(), v[i]))
    c = [list(v[i]) for i in order[:k]]
    for r in range(rounds + 1):
        far = [[sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) for y in c] for x in v]
        own = [f.index(min(f)) for f in far]
        if r < rounds:
            for j in range(len(c)):
                of = [v[i] for i in range(len(v)) if own[i] == j]
                c[j] = [sum(x) // len(of) for x in zip(*of, strict=True)] if of else c[j]
    dist = [f[o] for f, o in zip(far, own, strict=True)]
    return sorted((i is None, i or 0, o, d, sum(x for x, p in zip(dist, own, strict=True) if p == o), sum(dist), hashlib.sha256(",".join(map(str, c[o])).encode()).hexdigest()) for i, o, d in zip(ids, own, dist, strict=True))


def told(df):
    return sorted((r["vec_id"] is None, r["vec_id"] or 0, r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect())


def test_clusters_of_odd_rows(spark):
    """Nulls, repeats, wrong lengths, ties, large components; fewer vectors than centroids; more centroids than places."""
    rng = np.random.default_rng(3)
    good = [(i, [float(x) for x in rng.integers(-3, 4, 3)]) for i in range(60)] + [(None, [1.0, 2.0, 3.0]), (5, [9.0, 9.0, 9.0]), (5, [9.0, 9.0, 9.0]), (77, [60000.0, -60000.0, 0.001])]
    bad = [(100, None), (101, [1.0, 2.0]), (102, [1.0, None, 2.0]), (103, [NAN, 0.0, 0.0]), (104, [0.0, -INF, 0.0]), (105, [])]
    df = spark.createDataFrame([(i, v, 1, "c") for i, v in good + bad], "vec_id long, embedding array<double>, cluster int, v string").repartition(3)
    v = [[int(np.floor(256 * x)) for x in e] for _, e in good]
    for k in (7, 40, 100):
        assert told(cluster_vectors(df, k=k, rounds=4, width=3)) == plain_clusters([i for i, _ in good], v, k, 4)
    assert cluster_vectors(df, width=9).count() == 0 and cluster_vectors(df.limit(0), width=3).count() == 0
    with pytest.raises(Exception, match="65536"):
        cluster_vectors(spark.createDataFrame([(1, [1e6])], "vec_id long, embedding array<double>"), width=1).count()


def test_hilbert_curve_goes_by_single_steps():
    for axes, bits in ((2, 4), (3, 3)):
        n = 1 << bits
        places = np.stack(np.meshgrid(*[np.arange(n)] * axes, indexing="ij"), -1).reshape(-1, axes)
        key = hilbert(places, bits)
        assert sorted(key.tolist()) == list(range(n**axes))
        assert (np.abs(np.diff(places[np.argsort(key)], axis=0)).sum(1) == 1).all()


def plain_mine(ids, labels, v, asked, pos=5, neg=10):
    out = set()
    for a in np.flatnonzero(asked):
        score = v @ v[a]
        order = [i for i in np.lexsort((ids, -score)) if i != a]
        for p in [i for i in order if labels[i] == labels[a]][:pos]:
            fits = [i for i in order if labels[i] != labels[a] and 30 * score[p] <= 100 * score[i] <= 90 * score[p]][:neg]
            out |= {(int(ids[a]), int(ids[p]), r + 1, int(ids[n]), int(score[p]), int(score[n])) for r, n in enumerate(fits)}
    return out


COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def test_hard_negatives_of_clusters(spark, monkeypatch):
    """Many parts and slices, a hot label and a hot vector."""
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    monkeypatch.setattr(hard_negatives, "part_count", lambda n: 7)
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((30, 12)) * 2
    of = rng.integers(0, 30, 1500)
    v = centres[of] + 0.02 * rng.standard_normal((1500, 12))
    v[:300] = v[0]
    labels = np.where(rng.random(1500) < 0.4, 3, of % 10)
    ids = rng.permutation(5000)[:1500]
    df = spark.createDataFrame([(int(i), int(x), e) for i, x, e in zip(ids, labels, v.tolist(), strict=True)], "vec_id long, label int, embedding array<double>").repartition(4)
    asked = ids % 50 == 0
    got = mine(df, F.col("vec_id") % 50 == 0, most_anchors=12)
    assert {tuple(r[c] for c in COLUMNS) for r in got.collect()} == plain_mine(ids, labels, np.floor(256 * v).astype(int), asked)


def test_bounds_choose_blocks():
    """One anchor beside its own cluster: the far cluster's block is not read."""
    import pyarrow as pa

    near, far = np.full((1, 4), 100), np.full((1, 4), -100)
    zones = pa.table({"part": [0, 0], "block": [0, 1], "n": [50, 50], "label_lo": [1, 1], "label_hi": [1, 1], "lo": (np.concatenate([near, far]) - 5).tolist(), "hi": (np.concatenate([near, far]) + 5).tolist()})
    anchors = pa.table({"slice": [0], "vec_id": [9], "label": [1], "v": near.tolist()})
    need = hard_negatives._needed(4, 5)(anchors, zones)
    assert need.column("block").to_pylist() == [0]
    asking = pa.table({"slice": [0], "vec_id": [9], "label": [2], "v": near.tolist(), "positives": pa.array([[{"positive_id": 3, "positive_score": 40_000}]])})
    assert hard_negatives._needed(4, 10, 30, 100)(asking, zones).column("block").to_pylist() == [0]
    assert not len(hard_negatives._needed(4, 10, 30, 90)(asking, zones)) and hard_negatives._needed(4, 5)(anchors, zones.slice(0, 0)).num_rows == 0


def test_hard_negatives_of_odd_rows(spark):
    rows = [(0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.4]), (2, 2, [0.5, 0.5]), (3, 2, [0.9]), (4, None, [1.0, 1.0]), (5, 1, None), (6, 2, [NAN, 1.0]), (7, 2, [None, 1.0]), (8, 3, []), (9, 2, [0.5, 0.5]), (9, 2, [0.5, 0.5]), (None, 2, [0.7, 0.7]), (100, 4, [1.0, 1.0]), (200, 3, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, v string, rank int")
    good = [(0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.4]), (2, 2, [0.5, 0.5]), (3, 2, [0.9, 0]), (8, 3, [0, 0]), (9, 2, [0.5, 0.5]), (100, 4, [1.0, 1.0]), (200, 3, [-1.0, 0.0])]
    ids, labels, v = np.array([r[0] for r in good]), np.array([r[1] for r in good]), np.floor(256 * np.array([r[2] for r in good], float)).astype(int)
    got = mine(df, F.col("vec_id") % 100 == 0)
    assert {tuple(r[c] for c in COLUMNS) for r in got.collect()} == plain_mine(ids, labels, v, ids % 100 == 0)
    assert mine(df.limit(0), F.lit(True)).count() == 0 and mine(df, F.lit(False)).columns == list(COLUMNS)
