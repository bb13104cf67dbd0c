"""Permutation importance and the choice between models against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from severa import staging
from severa.operators import importance, models
from severa.operators.ranking import row_numbers


def _precision(rows):
    """rows (score, label, weight): step integral at distinct scores, null scores last."""
    pos = sum(y * w for _, y, w in rows)
    if not pos:
        return None
    out, tp, k = 0.0, 0, 0
    for s in sorted({s for s, _, _ in rows}, key=lambda s: (s is None, -(s or 0))):
        p, n = sum(y * w for t, y, w in rows if t == s), sum(w for t, _, w in rows if t == s)
        tp, k = tp + p, k + n
        out += p / pos * tp / k if k else 0
    return out


def test_precision_within(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice(["a", "b", "hot", "hot", "hot", None]), rnd.choice([None, *range(12)]), rnd.choice([0, 0, 1, None]), rnd.randint(0, 3)) for _ in range(900)]
    rows += [("none", 1, 0, 1), ("none", 2, 0, 1), ("one", 1, 1, 1)]
    df = spark.createDataFrame(rows, "key string, s int, y int, w int")
    got = {r.key: r.average_precision for r in importance.precision_within(df, ["key"], "s", "y", "w").collect()}
    want = {k: _precision([(s, y, w) for q, s, y, w in rows if q == k and y is not None and w]) for k in ("a", "b", "hot", "none", "one")}
    assert set(got) == set(want) and all(got[k] == pytest.approx(v) if v is not None else got[k] is None for k, v in want.items())
    assert importance.precision_within(df.limit(0), ["key"], "s", "y").collect() == []


def test_dealt_is_a_permutation(spark):
    rows = spark.range(500).select("id", (F.col("id") % 7).alias("a"), F.col("id").alias("b")).repartition(6)
    got = importance.dealt(rows, "id", ("a", "b"), 3).select("id", "repeat", "dealt.*").collect()
    again = importance.dealt(rows.repartition(3), "id", ("a", "b"), 3).select("id", "repeat", "dealt.*").collect()
    assert sorted(got) == sorted(again) and len(got) == 1500
    for repeat in range(3):
        own = {r.id: r.b for r in got if r.repeat == repeat}
        assert sorted(own.values()) == list(range(500)) == sorted(own)
        assert sum(k == v for k, v in own.items()) < 20
        assert all(r.a == r.b % 7 for r in got)
    assert len({tuple(r.b for r in sorted(got) if r.repeat == k) for k in range(3)}) == 3
    other = importance.dealt(rows, "id", ("a", "b"), 3, seed=1).select("id", "repeat", "dealt.*").collect()
    assert sorted(got) != sorted(other)


def test_importance(spark):
    rnd = random.Random(2)
    rows = [(i, y := int(rnd.random() < 0.3), float(y), y + rnd.gauss(0, 1), rnd.random(), None) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, label int, copied double, weak double, unused double, missing double")
    score = lambda d: d.withColumn("score", 5 * F.col("copied") + F.col("weak") + F.coalesce("missing", F.lit(0.0)))
    got = {r.feature: r for r in importance.permutation_importance(df, score, "id", ("copied", "weak", "unused", "missing"), "label").collect()}
    assert got["unused"].mean == 0 and got["unused"].std == 0 and got["missing"].mean == 0
    assert got["copied"].mean > 0.3 and got["copied"].mean > got["weak"].mean > 0
    # One repeat against the permutation itself.
    one = importance.permutation_importance(df, score, "id", ("copied", "weak"), "label", repeats=1, seed=3)
    deal = {r.id: r for r in importance.dealt(df, "id", ("copied", "weak"), 1, 3).select("id", "dealt.*").collect()}
    whole = _precision([(5 * c + w, y, 1) for _, y, c, w, _, _ in rows])
    want = {"copied": whole - _precision([(5 * deal[i].copied + w, y, 1) for i, y, _, w, _, _ in rows]), "weak": whole - _precision([(5 * c + deal[i].weak, y, 1) for i, y, c, _, _, _ in rows])}
    assert {r.feature: pytest.approx(r["mean"]) for r in one.collect()} == want


def test_draws_are_the_weights(spark):
    rows = spark.range(300).select("id", F.xxhash64(F.col("id").cast("string")).alias("h"), *[models.poisson_weight(F.col("id"), F.lit(r)).alias(f"w{r}") for r in (1, 2, 200)]).toPandas()
    for r in (1, 2, 200):
        assert models.poisson_draws(rows["h"].to_numpy(), r).tolist() == rows[f"w{r}"].tolist()


def test_gain_over_ranges(spark, monkeypatch):
    """Ties, null scores and labels, and ranges of a few cells, against a plain count of every replicate."""
    rnd = random.Random(9)
    rows = [(rnd.randint(0, 40), rnd.choice([0, 0, 1, None]), rnd.choice([None, float("nan"), *range(6), rnd.random()]), rnd.random()) for _ in range(700)]
    rows = [(k, y, None if s is None else float(s), t) for k, y, s, t in rows]
    df = spark.createDataFrame(rows, "company int, label int, new double, old double")
    keys = spark.range(41)
    weights = {(r.id, i): r[f"w{i}"] for r in keys.select("id", *[models.poisson_weight(F.col("id").cast("int"), F.lit(i)).alias(f"w{i}") for i in range(1, 31)]).collect() for i in range(1, 31)}
    of = lambda at, w: _precision([(float("inf") if (s := r[at]) is not None and s != s else s, r[1], w(r[0])) for r in rows if r[1] is not None and w(r[0])])
    draws = sorted(of(2, w) - of(3, w) for w in ((lambda k, i=i: weights[k, i]) for i in range(1, 31)))
    whole = of(2, lambda k: 1) - of(3, lambda k: 1)
    for size in (100_000, 20):
        monkeypatch.setattr(importance, "RANGE", size)
        got = importance.precision_gain(df, "company", "new", "old", "label", 30).first()
        assert got.gain == pytest.approx(whole) and [got.low, got.high] == pytest.approx(np.percentile(draws, [2.5, 97.5]).tolist())
        same = importance.precision_gain(df, "company", "new", "new", "label", 30).first()
        assert same.gain == same.low == same.high == 0
    assert importance.precision_gain(df.limit(0), "company", "new", "old", "label", 3).first().gain is None


def test_gain_copies_no_row_for_a_replicate(spark):
    df = spark.range(4000).select((F.col("id") % 2000).alias("company"), (F.col("id") % 3 == 0).cast("int").alias("label"), F.rand(1).alias("new"), F.rand(2).alias("old"))
    mark = len(staging.staged_since())
    importance.precision_gain(df, "company", "new", "old", "label", 200).first()
    assert max(spark.read.parquet(p).count() for p in staging.staged_since(mark)) <= 8000


def test_choice(spark):
    rnd = random.Random(6)
    rows = [(i % 60, y := int(rnd.random() < 0.4), y + rnd.gauss(0, 0.3), y + rnd.gauss(0, 2)) for i in range(600)]
    df = spark.createDataFrame(rows, "company int, label int, good double, poor double")
    gain = importance.precision_gain(df, "company", "good", "poor", "label", 40)
    r = gain.first()
    assert r.gain == pytest.approx(_precision([(g, y, 1) for _, y, g, _ in rows]) - _precision([(p, y, 1) for _, y, _, p in rows]))
    assert 0 < r.low <= r.gain <= r.high
    back, same = (importance.precision_gain(df, "company", *p, "label", 40) for p in (("poor", "good"), ("good", "good")))
    assert same.first().low == same.first().high == 0
    assert {x.chosen for x in importance.choose(gain, "new", "old").collect()} == {"new"}
    for other in (back, same):
        assert {x.chosen for x in importance.choose(gain.unionByName(other), "new", "old").collect()} == {"old"}


def test_row_numbers_shuffle_rows_once(spark):
    """Numbers in the order, over many ranges; rows are not dealt out again to be numbered."""
    rows = spark.range(5000).select("id", F.md5(F.col("id").cast("string")).alias("h"))
    out = row_numbers(rows.repartition(7), [F.desc("h")], "n", ("h",))
    assert out.columns == ["id", "n"]
    assert "row_number()" not in out._jdf.queryExecution().toString()
    want = [r.id for r in rows.orderBy(F.desc("h")).collect()]
    assert [r.id for r in out.orderBy("n").collect()] == want and sorted(r.n for r in out.collect()) == list(range(1, 5001))
    assert row_numbers(rows.limit(0), [F.col("h")]).collect() == []
