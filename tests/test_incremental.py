"""Roll-ups and posts over batches, some of which die before they are committed."""

import random
from pathlib import Path

import pytest

from severa.streaming import posting
from severa.streaming.commits import Commits
from severa.streaming.rollup import Rollup

SCHEMA = "id long, version int, month string, state string, workers long, counts boolean"


def _plain(batches):
    """Sums over each key's highest version."""
    rows, sums = {}, {}
    for batch in batches:
        best = {}
        for r in batch:
            if r[0] is not None:
                best[r[0]] = max(best.get(r[0], r), r, key=lambda x: (x[1], x[2] or "", x[3] or "", x[4] or 0, bool(x[5])))
        for k, r in best.items():
            if k not in rows or r[1] > rows[k][1]:
                rows[k] = r
    for _, _, month, state, workers, counts in rows.values():
        if counts:
            n, w = sums.get((month, state), (0, 0))
            sums[month, state] = (n + 1, w + (workers or 0))
    return sums


def _read(spark, kept):
    return {(r.month, r.state): (r.n, r.workers) for r in kept.read(spark).collect()}


def test_rollup_is_a_full_computation(spark, tmp_path):
    rnd = random.Random(4)
    kept = Rollup(str(tmp_path), "id", "version", "month", ("state",), ("workers",), buckets=4, most_logs=3)
    batches = []
    for i in range(6):
        rows = [(rnd.choice([*range(60), None]), rnd.randint(1, 4), rnd.choice(["1999-01", "1999-02", "a/b=c d", "", None]), rnd.choice(["AL", "KY", None]), rnd.choice([None, 1, 5, 100]), rnd.choice([True, True, False, None])) for _ in range(40)]
        batches.append({(r[0], r[1]): r for r in rows}.values())  # ties of key and version: tested below
        kept.apply(spark.createDataFrame(list(batches[-1]), SCHEMA), i)
        assert _read(spark, kept) == _plain(batches), i
    assert len(Commits(spark, f"{tmp_path}/commits").last()[1]["rows"]) <= 3
    before = len(list(Path(tmp_path).glob("*/batch=*")))
    kept.clean(spark)
    assert len(list(Path(tmp_path).glob("*/batch=*"))) < before and _read(spark, kept) == _plain(batches)
    kept.apply(spark.createDataFrame([], SCHEMA), 6)
    assert _read(spark, kept) == _plain(batches)


def test_rollup_touches_changed_parts_only(spark, tmp_path):
    kept = Rollup(str(tmp_path), "id", "version", "month", ("state",), ("workers",))
    assert kept.apply(spark.createDataFrame([(i, 1, f"1999-0{i % 4 + 1}", "AL", 10, True) for i in range(40)], SCHEMA), 0) == sorted("p" + f"1999-0{m}".encode().hex().upper() for m in (1, 2, 3, 4))
    parts = Commits(spark, f"{tmp_path}/commits").last()[1]["parts"]
    # A row moves from the first month to the second, one is edited to what it was, one comes late with its old version.
    moved = [(0, 2, "1999-02", "AL", 7, True), (2, 2, "1999-03", "AL", 10, True), (3, 1, "1999-04", "AL", 99, True), (3, 0, "1999-04", "AL", 99, True)]
    assert len(kept.apply(spark.createDataFrame(moved, SCHEMA), 1)) == 2
    now = Commits(spark, f"{tmp_path}/commits").last()[1]["parts"]
    assert sorted(now) == sorted(parts) and sum(now[p] == parts[p] for p in parts) == 2
    assert _read(spark, kept) == {("1999-01", "AL"): (9, 90), ("1999-02", "AL"): (11, 107), ("1999-03", "AL"): (10, 100), ("1999-04", "AL"): (10, 100)}
    # All rows of a month are superseded: its files go. Equal key and version: the greatest row holds.
    kept.apply(spark.createDataFrame([(i, 3, "1999-04", "AL", 10, False) for i in range(3, 40, 4)] + [(1, 5, "1999-02", "AL", w, True) for w in (3, 4)], SCHEMA), 2)
    assert ("1999-04", "AL") not in _read(spark, kept) and _read(spark, kept)["1999-02", "AL"] == (11, 101)


def test_rollup_outlives_a_death(spark, tmp_path, monkeypatch):
    kept = Rollup(str(tmp_path), "id", "version", "month", ("state",), ("workers",))
    first, second = [(1, 1, "1999-01", "AL", 5, True)], [(1, 2, "1999-02", "AL", 6, True), (2, 1, "1999-01", "KY", 1, True)]
    with pytest.raises(FileNotFoundError):
        kept.read(spark)
    kept.apply(spark.createDataFrame(first, SCHEMA), 0)
    with monkeypatch.context() as m:
        m.setattr(Commits, "add", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            kept.apply(spark.createDataFrame(second, SCHEMA), 1)
    assert _read(spark, kept) == {("1999-01", "AL"): (1, 5)}
    for _ in range(2):  # once more, and once more after it is committed
        kept.apply(spark.createDataFrame(second, SCHEMA), 1)
        assert _read(spark, kept) == {("1999-02", "AL"): (1, 6), ("1999-01", "KY"): (1, 1)}


def test_rollup_as_a_stream(spark, tmp_path):
    """The same sums from a stream that dies inside a batch and goes on from its checkpoint."""
    kept = Rollup(f"{tmp_path}/kept", "id", "version", "month", ("state",), ("workers",))
    batches = [[(i, v, f"1999-0{(i + v) % 3 + 1}", "AL", i * v, i % 5 != v) for i in range(v, 30, v)] for v in (1, 2, 3)]
    die = {1}

    def take(batch, number):
        kept.apply(batch, number)
        if number in die:
            die.discard(number)
            raise RuntimeError("dies after its commit")

    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for _ in range(2):
            source = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
            run = source.writeStream.foreachBatch(take).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
            try:
                run.awaitTermination()
            except Exception:
                assert not die
    assert _read(spark, kept) == _plain(batches)


def test_posts(spark, tmp_path, monkeypatch):
    def refusing(platform, notice_id, key):
        assert key == f"{platform}:{notice_id}"
        return 429 if platform == "x" and notice_id == 3 else 404 if notice_id == 2 else 200

    def kind(platform, notice_id, key):
        return 200

    rows = [(i, p, 100 - i) for i in range(6) for p in ("x", "y")] + [(0, "x", 100), (None, "x", 5), (7, None, 5), (8, "x", None)]
    candidates = spark.createDataFrame(rows, "notice_id long, platform string, workers int")
    folder = str(tmp_path)
    read = lambda: sorted((r.platform, r.notice_id, r.status, r.run) for r in posting.ledger(spark, folder).collect())
    assert read() == []
    with monkeypatch.context() as m:
        m.setattr(Commits, "add", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            posting.post_run(candidates, refusing, folder, 0, "workers", 5)
    assert read() == []  # what the dead run wrote does not count
    assert posting.post_run(candidates, refusing, folder, 0, "workers", 5) == 8
    want = [("x", i, 404 if i == 2 else 200, 0) for i in range(3)] + [("y", i, 404 if i == 2 else 200, 0) for i in range(5)]
    assert read() == want
    assert posting.post_run(candidates, kind, folder, 0, "workers", 5) == 0 and read() == want
    assert posting.post_run(candidates, kind, folder, 1, "workers", 5) == 4
    assert read() == sorted(want + [("x", i, 200, 1) for i in (3, 4, 5)] + [("y", 5, 200, 1)])
    assert posting.post_run(candidates, kind, folder, 2, "workers", 5) == 0
