"""The Jaccard join against brute force over all pairs, and its edge cases."""

from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from severa.llm.jaccard_join import depths, drop_near_copies, jaccard_join, least_similarity, prefix_length, recall

SCHEMA = "doc_id long, text string, label string, size int"


def grams(text):
    w = (text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """{doc_id: (class, links)} of distinct (doc_id, text) rows with distinct ids."""
    sets = {d: grams(t) for d, t in rows}
    holders = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    links, root = Counter(), {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, s in sets.items():
        for e, n in Counter(e for g in s for e in holders[g] if e > d).items():
            if 10 * n >= 8 * (len(s) + len(sets[e]) - n):
                links[d] += 1
                links[e] += 1
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return {d: (find(d), links[d]) for d in sets}


def result(df):
    return {r.doc_id: (r.class_id, r.n_links) for r in df.collect()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_same_as_brute_force(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert result(jaccard_join(docs)) == brute(rows)


def test_a_large_group_of_near_copies_is_counted_whole(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[: i % 50] + [f"x{i}"] + base[i % 50 + 1 :])) for i in range(700)] + [(1000 + i, " ".join(base)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert result(jaccard_join(docs)) == brute(rows)


def test_edges(spark):
    long = " ".join(f"v{i}" for i in range(30_000))
    rows = [(1, None, "a", 1), (2, "", "a", 1), (3, " \n ", "b", 1), (4, "one", None, 1), (5, "one", "c", 1), (6, "one two", "c", 1), (7, long, "c", 1), (8, long + " more", "c", 1), (9, "q w e r t y", "c", 1), (9, "q w e r t y", "c", 1), (9, "other words", "c", 1), (None, "q w e r t y", "c", 1), (None, None, "c", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = Counter((r.doc_id, r.class_id, r.n_links, r["first"]) for r in jaccard_join(docs).collect())
    assert out == Counter({(1, 1, 0, True): 1, (2, 2, 0, True): 1, (3, 3, 0, True): 1, (4, 4, 1, True): 1, (5, 4, 1, False): 1, (6, 6, 0, True): 1, (7, 7, 1, True): 1, (8, 7, 1, False): 1, (9, 9, 1, True): 2, (9, 9, 0, True): 1, (None, 9, 1, False): 1, (None, None, 0, True): 1})
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 4, 6, 7, 9, 9, None])
    assert jaccard_join(docs.limit(0)).count() == 0


def test_chain_of_weakly_similar_sets(spark):
    """Each text shares half of its words with the next: one long chain of candidates, no link, and the odd true pair."""
    rows = [(i, " ".join(f"w{j}" for j in range(i * 30, i * 30 + 90))) for i in range(800)]
    rows += [(2000 + i, rows[i * 40][1] + " tail") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert result(jaccard_join(docs)) == brute(rows)


def test_chain_of_links_is_one_class(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i * 3, i * 3 + 90))) for i in range(300)]
    got = result(jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute(rows) and {c for c, _ in got.values()} == {0}


def test_classes_that_meet_only_at_shorter_prefixes(spark):
    """Groups of near copies, with texts between them that are just over or under the threshold."""
    import random

    rnd = random.Random(9)
    rows = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(200)]
        for d in range(25):
            w = list(base)
            for at in rnd.sample(range(200), rnd.choice((0, 1, 2, 3, 4, 5, 6))):
                w[at] = f"x{rnd.random()}"
            rows.append((len(rows), " ".join(w)))
    assert result(jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_clashing_columns(spark):
    rows = [(1, "a b c d e f", 1, 2, "x", [1], "y", "z"), (2, "a b c d e f", 1, 2, "x", [1], "y", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k int, n int, id string, d0 array<int>, grams string, class string")
    assert result(jaccard_join(docs)) == {1: (1, 1), 2: (1, 1)}
    assert drop_near_copies(docs).collect() == [docs.collect()[0]]


def test_prefix_is_shortened_until_the_recall_is_reached():
    depth = prefix_length(0.8, 24, 8, 0.9999)
    assert recall(0.8, depth, 24) >= 0.9999 > recall(0.8, depth + 1, 24)
    assert depths(0.8, 24, 8, 0.9999) == [8, depth]
    # What is under the threshold is found less and less often, and verified away.
    assert recall(0.7, depth, 24) > 0.98 and recall(0.5, depth, 24) < 0.54 and recall(0.3, depth, 24) < 0.06


def test_least_similarity_of_a_size():
    for size in range(1, 40):
        want = min((Fraction(a, size + m - a) for m in range(1, 80) for a in range(1, min(size, m) + 1) if Fraction(a, size + m - a) >= Fraction(4, 5) and not a == size == m), default=Fraction(1))
        assert least_similarity(size, 0.8) == float(want)
    assert least_similarity(3, 0.8) == 1.0
