"""Every stage of the pipeline against what it must keep, each judged on its own input."""

import re

import pytest

import corpus_pipeline
from severa.staging import stage, staged_since

from test_jaccard_join import brute

SF = "/root/testdata/sf0.001"


def words13(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, SF), "test")
        out.append(docs)
    return [[r.asDict() for r in d.collect()] for d in out]


def test_stages_in_order(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near copies", "repeated passages", "decontamination", "mix"]
    for rows in steps[1:-1]:
        assert list(rows[0]) == ["doc_id", "text", "lang", "source", "n_chars"]


def test_toxicity(spark, steps):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in steps[1]}
    assert all(d in kept for d, toxic in labels.items() if not toxic)
    toxic = [d for d, t in labels.items() if t]
    assert len([d for d in toxic if d in kept]) <= len(toxic) / 2  # a hundred labels teach little
    assert {r["doc_id"] for r in steps[0]} - kept  # what is not labelled is judged too


def test_near_copies(steps):
    classes = brute([(r["doc_id"], r["text"]) for r in steps[1]])
    assert {r["doc_id"] for r in steps[2]} == {d for d, (c, _) in classes.items() if c == d}


def test_repeated_passages(steps):
    seen = set()
    got = {r["doc_id"]: r["text"] for r in steps[3]}
    assert len(got) == len(steps[2])
    for r in sorted(steps[2], key=lambda r: r["doc_id"]):
        w = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        gone = set()
        for i in range(len(w) - 19):
            t = tuple(w[i : i + 20])
            if t in seen:
                gone |= set(range(i, i + 20))
            seen.add(t)
        assert got[r["doc_id"]] == (" ".join(x for i, x in enumerate(w) if i not in gone) if gone else r["text"])


def test_decontamination(spark, steps):
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words13(r.text)
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12)) if w}
    want = set()
    for r in steps[3]:
        w = words13(r["text"])
        hit = {i + j for i in range(len(w) - 12) if tuple(w[i : i + 13]) in windows for j in range(13)}
        if not (hit and 20 * len(hit) >= len(w)):
            want.add(r["doc_id"])
    assert all(len(x) == 13 for x in windows)
    assert {r["doc_id"] for r in steps[4]} == want


def test_mix(steps):
    taken, target = {}, {}
    for r in steps[5]:
        assert 1 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 60 for s in target)  # a source of this size has ten documents
    assert {r["doc_id"] for r in steps[5]} <= {r["doc_id"] for r in steps[4]}


def test_stages_on_odd_rows(spark):
    """What each stage keeps of null, empty, repeated, nameless and very long rows; nothing of an empty table."""
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "x y z", "en", None, 5), (4, "w " * 30_000, "en", "a", 60_000), (5, "x y z", "en", "b", 5)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = {
        "toxicity": [None, 1, 2, 2, 4, 5],
        "near copies": [1, 2, 4, 5],  # a repeated row stays once, and of the copies the one with an id
        "repeated passages": [None, 1, 2, 2, 4, 5],
        "decontamination": [None, 1, 2, 2, 4, 5],
    }
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, odd, SF)
        ids = sorted((r.doc_id for r in out.collect()), key=lambda d: -1 if d is None else d)
        if name in want:
            assert ids == want[name] and out.columns == odd.columns, name
        else:
            assert set(ids) <= {None, 4, 5} and all(r.taken == r["size"] * r.copies > 0 for r in out.collect())
        if name == "repeated passages":
            texts = {r.doc_id: r.text for r in out.collect()}
            assert texts[1] is None and texts[2] == "" and texts[None] == texts[5] == "x y z" and texts[4] == "w"
        assert function(spark, odd.limit(0), SF).count() == 0


def test_stages_drop_what_they_staged(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    first = stage(corpus_pipeline.remove_contaminated(spark, docs, SF), "test")
    left = list(corpus_pipeline._LEFT)
    assert left and set(left) <= set(staged_since())
    corpus_pipeline.remove_repeated_passages(spark, first, SF).count()
    assert not set(left) & set(staged_since())
