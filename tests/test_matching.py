"""Linkage and supersession against plain versions."""

import datetime
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from severa.functions import likeness
from severa.operators import dedup, linkage, models
from severa.operators.pair_features import FEATURES, features_of_key, least_distances, pair_features

D = datetime.date


def plain_jaro_winkler(s, t):
    if s == t:
        return 1.0
    reach, used, ours = max(0, max(len(s), len(t)) // 2 - 1), [False] * len(t), []
    for i, ch in enumerate(s):
        for j in range(max(0, i - reach), min(len(t), i + reach + 1)):
            if not used[j] and t[j] == ch:
                used[j] = True
                ours.append(ch)
                break
    if not ours:
        return 0.0
    theirs, m = [ch for ch, u in zip(t, used, strict=True) if u], len(ours)
    jaro = (m / len(s) + m / len(t) + (m - sum(x != y for x, y in zip(ours, theirs, strict=True)) // 2) / m) / 3
    same = next((i for i, (x, y) in enumerate(zip(s[:4], t[:4], strict=False)) if x != y), min(4, len(s), len(t)))
    return jaro + same * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def plain_common(s, t):
    row = [0] * (len(t) + 1)
    for x in s:
        new = [0]
        for j, y in enumerate(t):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_likeness_of_batches(monkeypatch):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdé 𝄞") for _ in range(rnd.randrange(0, 14)))
    pairs = [(word(), word()) for _ in range(600)] + [("", ""), ("", "a"), ("x" * 300, "x" * 299 + "y"), ("dixon", "dicksonx")]
    pairs += [(a, a[:3] + word()) for a, _ in pairs[:100]]
    for cells in (2_000_000, 300):
        monkeypatch.setattr(likeness, "CELLS", cells)
        a, b = (np.array(x, object) for x in zip(*pairs, strict=True))
        assert likeness.jaro_winkler(a, b) == pytest.approx([plain_jaro_winkler(x, y) for x, y in pairs], abs=1e-12)
        assert likeness.common_length(a, b).tolist() == [plain_common(x, y) for x, y in pairs]


def test_token_set_ratio(spark):
    rows = [("acme steel works", "works acme steel"), ("acme steel", "acme steel works"), ("acme steel", "apex steel"), ("abc", "abd"), ("", "a"), (None, "a"), ("new york mets", "new york yankees")]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").coalesce(1).select(likeness.token_set_ratio(F.col("a"), F.col("b"))).collect()]
    # acme / apex differ in 'cm' and 'px'; the words shared alone have 5 of 5 + 10 characters wrong.
    assert got[:6] == pytest.approx([1, 1, max(1 - 4 / 20, 1 - 5 / 15), 1 - 2 / 6, 0, 0]) and got[6] > 0.75


def haversine(p, q):
    a, b = math.radians(p[0]), math.radians(q[0])
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))


def test_least_distances_between_sets(spark):
    """Near, far, across the date line, at a pole, in one place, and sets of hundreds."""
    rnd = random.Random(2)
    sets = {n: [(rnd.uniform(-60, 80), rnd.uniform(-180, 180)) for _ in range(rnd.choice((1, 3, 400)))] for n in range(12)}
    sets |= {20: [(10.0, 179.999)], 21: [(10.0, -179.999), (50.0, 0.0)], 22: [(90.0, 0.0)], 23: [(89.9, 77.0)], 24: [(10.0, 179.999)], 25: []}
    points = spark.createDataFrame([(n, *p) for n, ps in sets.items() for p in ps] + [(25, None, 1.0)], "node long, lat double, lon double")
    pairs = [(a, b) for a in sets for b in sets if a < b]
    got = {(r.a, r.b): r.km for r in least_distances(spark.createDataFrame(pairs, "a long, b long"), points).collect()}
    want = {(a, b): min(haversine(p, q) for p in sets[a] for q in sets[b]) for a, b in pairs if sets[a] and sets[b]}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_features_of_hand_made_profiles(spark):
    point = [(40.0, -75.0)]
    rows = [
        (1, "Acme Steel Works #12", "acme steel works", "acme steel", None, ["S1", "S2"], ["X"], ["1"], ["S1d1", "S2d1"], point, D(2001, 1, 1), D(2001, 1, 10), 3, 100),
        (2, "ASW #13", "asw", "asw", "acme steel", ["S2"], ["Y"], ["1"], ["S2d1"], [], D(2001, 1, 20), D(2001, 1, 20), 1, 0),
        (3, None, None, None, None, None, None, None, None, None, None, None, None, None),
    ]
    schema = "node long, name string, canonical string, cleaned string, dba string, states array<string>, cities array<string>, zips array<string>, state_days array<string>, points array<struct<lat: double, lon: double>>, first date, last date, n_notices long, layoffs long"
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 2), (2, 9)], "a long, b long")
    got = {(r.a, r.b): r for r in pair_features(spark.createDataFrame(rows, schema), pairs).collect()}
    assert got.keys() == {(1, 2), (1, 3)}
    r = got[1, 2]
    assert (r.dba_cross, r.acronym_match, r.site_number_conflict, r.canonical_equal, r.shared_city, r.shared_zip, r.same_day_same_state) == (1, 1, 1, 0, 0, 1, 1)
    assert r.state_jaccard == 0.5 and r.date_overlap_frac == 0 and r.date_gap_days_log == pytest.approx(math.log1p(10)) and r.min_geo_km is None and r.layoff_ratio == 0
    assert (r.notices_min_log, r.notices_max_log) == pytest.approx((math.log(2), math.log(4))) and r.name_word_cos == 0 and r.shared_token_max_idf == 0
    r = got[1, 3]
    assert r.state_jaccard == 0 and r.date_gap_days_log is None and r.name_token_set == 0 and set(r.asDict()) == {"a", "b", *FEATURES}


def test_neighbours_of_all_against_brute_force(spark):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdef") for _ in range(5)) for _ in range(40)]
    names = [(i, " ".join(rnd.choices(words, k=3))) for i in range(300)] + [(300 + i, "hot name") for i in range(30)] + [(400, None)]
    terms = spark.createDataFrame(names, "id long, name string").select("id", F.explode(linkage.char_grams(F.col("name"))).alias("term"))
    w = linkage.tfidf(terms, "id")
    own: dict = {}
    for r in w.collect():
        own.setdefault(r.id, {})[r.term] = r.w
    for k, least in ((3, 0.5), (50, 0.3)):
        want = set()
        for a in own:
            dots = sorted((-round(sum(x * own[b].get(t, 0) for t, x in own[a].items()), 8), b) for b in own if b != a)
            want |= {(a, b, round(-d, 6)) for d, b in dots[:k] if -d >= least}
        assert {(r.node, r.other, round(r.cosine, 6)) for r in linkage.cosine_neighbours(w, w, "id", k, least).collect()} == want


def plain_greedy(pairs):
    gone, out = set(), set()
    for key, _, o, k in sorted(pairs):
        if (key, o) not in gone and (key, k) not in gone:
            gone.add((key, o))
            out.add((key, o, k))
    return out


def test_supersession_by_rounds(spark):
    rnd, pairs = random.Random(4), set()
    for key in "abc":
        for _ in range(150):
            o, k = rnd.sample(range(25), 2)
            pairs.add((key, rnd.randrange(3), ord(key) * 100 + o, ord(key) * 100 + k))
    got = dedup.resolve_supersession(spark.createDataFrame(sorted(pairs), "key string, case int, o_id long, k_id long"))
    assert {(chr(r.superseded_id // 100), r.superseded_id, r.by_id) for r in got.collect()} == plain_greedy(pairs)
    assert dedup.resolve_supersession(spark.createDataFrame([], "key string, case int, o_id long, k_id long")).count() == 0


_VERSION = "notice_id long, state string, employer string, notice_date date, city string, zip string, address string, layoff_count long, scraped_at timestamp"


def test_supersession_without_all_pairs(spark):
    rnd = random.Random(6)
    rows = [(i, "S1", rnd.choice((" Acme", "acme", "Bolt")), D(2001, 1, 1 + i % 2), rnd.choice(("X", "Y", None)), rnd.choice(("1", None)), rnd.choice(("a", "b", None)), rnd.choice((1, 2, 3, None)), datetime.datetime(2001, 1, 1, rnd.randrange(6))) for i in range(160)]
    table = spark.createDataFrame([*rows, (900, None, "Acme", D(2001, 1, 1), "X", "1", "a", 1, None)], _VERSION)
    whole = lambda df: {(r.superseded_id, r.by_id, r.case) for r in df.collect()}
    assert whole(dedup.supersede(table)) == whole(dedup.resolve_supersession(dedup.supersession_pairs(table)))


def test_supersession_of_a_hot_key(spark):
    """100,000 notices of one employer and day, two of every worksite: ten thousand million pairs if all met."""
    i = F.col("id")
    at = F.concat(F.lit("C"), (i % 50_000).cast("string"))
    rows = spark.range(100_000).select(i.alias("notice_id"), F.lit("S1").alias("state"), F.lit("Acme").alias("employer"), F.lit(D(2001, 1, 1)).alias("notice_date"), at.alias("city"), F.when(i < 50_000, "1").alias("zip"), at.alias("address"), F.lit(5).cast("long").alias("layoff_count"), F.lit("2001-01-01").cast("timestamp").alias("scraped_at"))
    got = dedup.supersede(rows)
    assert got.count() == 50_000 and got.where("superseded_id - 50000 = by_id and case = 0").count() == 50_000


def test_labels_by_both_rules(spark):
    rows = [(1, "acme", "U1", "a.com"), (2, "other", "U1", None), (3, "acme", "U2", "a.com"), (4, "acme", "U3", ""), (5, "acme", None, "a.com"), (6, "", "U4", "a.com"), (7, "", "U5", "a.com")]
    pairs = list(itertools.combinations(range(1, 8), 2))
    got = {(r.a, r.b): r.label for r in linkage.weak_labels(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(rows, "node long, canonical string, unique_id string, domain string")).collect()}
    assert got == {(a, b): None if 5 in (a, b) else int((a, b) in {(1, 2), (1, 3)}) for a, b in pairs}


def test_cross_fit_never_sees_its_component(spark):
    """Unlabelled pairs teach nothing, components have one fold, and the calibrator is fitted on all out-of-fold scores."""
    rnd = random.Random(8)
    rows = []
    for c in range(60):
        ids = [c * 10 + i for i in range(4)]
        rows += [(a, b, 1, 0.8 + 0.3 * rnd.random()) for a, b in itertools.pairwise(ids)]
        rows += [(ids[0], (c * 10 + 10 + 4) % 600, 0, 0.5 * rnd.random() + 0.45), (ids[1], 7000 + c, None, rnd.random())]
    pairs = spark.createDataFrame([(a, b, n, float(x)) for a, b, n, x in rows], "a long, b long, label int, x double")
    dealt = models.by_component(pairs, F.col("label") == 1, 3)
    out = models.cross_fitted(dealt, ("x",), "label", "fold", 3).collect()
    assert len(out) == len(rows)
    assert len({(r.component, r.fold) for r in out}) == len({r.component for r in out}) and all(r.component == r.a // 10 * 10 for r in out)
    known = [r for r in out if r.label is not None]
    z = np.log(np.array([r.raw for r in known]) / (1 - np.array([r.raw for r in known])))
    y, w = np.array([r.label for r in known], float), np.zeros(2)
    for _ in range(50):  # Newton's method for the two numbers of Platt's scaling
        p = 1 / (1 + np.exp(-(w[0] * z + w[1])))
        X = np.column_stack([z, np.ones(len(z))])
        w += np.linalg.solve(X.T @ (X * (p * (1 - p))[:, None]) + 1e-12 * np.eye(2), X.T @ (y - p))
    want = 1 / (1 + np.exp(-(w[0] * z + w[1])))
    assert np.array([r.score for r in known]) == pytest.approx(want, abs=2e-3)
    # A fold's scores come from the rest: other labels in the fold change only the calibrator.
    flipped = dealt.withColumn("label", F.when((F.col("fold") == 0) & F.col("label").isNotNull(), 1 - F.col("label")).otherwise(F.col("label")))
    again = {(r.a, r.b): r.raw for r in models.cross_fitted(flipped, ("x",), "label", "fold", 3).where("fold = 0 and label is not null").collect()}
    assert again == pytest.approx({(r.a, r.b): r.raw for r in known if r.fold == 0}, abs=1e-6)
    with pytest.raises(ValueError, match="one label only"):
        models.cross_fitted(dealt.where("label = 1"), ("x",), "label", "fold", 3)


def test_suggestions_take_whole_groups(spark):
    members = [(1, 1, 10, 5), (2, 1, 10, 5), (3, 1, 20, 1), (4, 1, 30, 1), (5, 2, 30, 1), (6, 1, 40, 2), (7, 1, 40, None), (8, 3, 50, 1), (9, 3, 60, 1), (10, None, 70, 1)]
    pairs = [(1, 3, 0.9), (2, 3, 0.9), (1, 4, 1.0), (2, 4, 1.0), (1, 6, 1.0), (2, 6, 1.0), (1, 7, 1.0), (8, 9, 0.95), (3, 6, 1.0)]
    run = lambda ruled: {tuple(r) for r in linkage.merge_suggestions(spark.createDataFrame(members, "node long, cluster long, root long, n_notices long"), spark.createDataFrame(pairs, "a long, b long, score double"), spark.createDataFrame(ruled, "x long, y long"), 0.8).collect()}
    # 30 lies in two clusters; 40 has one pair of four without a score; 50 and 60 tie in notices, and the smaller root stays.
    assert run([]) == {(20, 10, 0.9), (60, 50, 0.95)}
    assert run([(10, 20)]) == {(60, 50, 0.95)} and run([(60, 50), (20, 10)]) == set()


def test_suggestions_at_just_the_least(spark):
    """Means of just `least` pass, whatever the order of their pairs: 0.75 + 0.8 + 0.85 is less than 2.4 in doubles."""
    members = [(1, 1, 10, 5), (2, 1, 20, 1), (3, 1, 20, 1), (4, 1, 20, 1)]
    for scores in ((0.75, 0.8, 0.85), (0.85, 0.8, 0.75), (0.7, 0.7, 1.0), (0.62, 0.79, 0.99)):
        pairs = [(1, b, x) for b, x in zip((2, 3, 4), scores, strict=True)]
        out = linkage.merge_suggestions(spark.createDataFrame(members, "node long, cluster long, root long, n_notices long"), spark.createDataFrame(pairs, "a long, b long, score double").coalesce(1), spark.createDataFrame([], "x long, y long"), 0.8).collect()
        assert [(r.company_id, r.target_company_id, round(r.score, 9)) for r in out] == [(20, 10, 0.8)]


def test_merge_suggestions_mean_of_just_four_fifths(spark, tmp_path):
    """Every mean of 0.8 or more is there, by whole hundredths."""
    from severa.plans import registry

    spark.range(3000).selectExpr("id as c_custkey", "concat('Customer#', id) as c_name", "'M' as c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    want = {}
    for a in range(3000):
        for b in range(a + 97, 3000, 97):  # one parent's companies
            pair = a - a % 3, b - b % 3
            if a % 4 and b % 4 and pair[0] != pair[1]:
                want.setdefault(pair, []).append((a + b) % 100)
    got = {(r.root, r.other): r.pairs for r in registry.queries()["ml30_merge_suggestions"](spark, str(tmp_path)).collect()}
    assert got == {k: len(v) for k, v in want.items() if sum(v) >= 80 * len(v)}


def test_all_labels_shuffle_no_pairs(spark, capsys):
    """Labels come from what pairs carry: the join of the blocks, with lo and hi, is the last."""
    from conftest import TINY
    from severa.plans import registry

    registry.queries()["ml27_all_labels"](spark, TINY).explain()
    plan = capsys.readouterr().out
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert "hi#" in joins[0] and not any("hi#" in line for line in joins[1:])


def test_neighbours_by_blocks_and_classes(spark):
    """Blocks of seven give what one block gives; of a name that thousands have, a node gets the smallest others."""
    rnd = random.Random(4)
    names = [(i, " ".join(rnd.choice(("red", "blue", "old", "tin")) for _ in range(2))) for i in range(90)] + [(1000 + i, "hot name") for i in range(3000)]
    terms = spark.createDataFrame(names, "id long, name string").select("id", F.explode(linkage.char_grams(F.col("name"))).alias("term"))
    w = linkage.tfidf(terms, "id")
    asked = w.where("id % 30 = 0")
    rows = [{tuple(r) for r in linkage.cosine_neighbours(asked, w, "id", 4, 0.4, block).collect()} for block in (7, None)]
    assert rows[0] == rows[1] and {r[0] for r in rows[0]} >= {0, 30, 60}
    assert {r[1:] for r in rows[0] if r[0] == 1020} == {(1000 + i, 1.0) for i in range(4)}


def test_features_of_a_key_shuffle_no_pair(spark):
    """Columns of all pairs of a key: names by their trigrams, and places one by one or, of a node of many, in cubes."""
    rnd = random.Random(5)
    places = {n: [(rnd.uniform(-60, 80), rnd.uniform(-180, 180)) for _ in range(rnd.choice((0, 1, 3, 20)))] for n in range(12)}
    few = spark.createDataFrame([(n, "k" if n % 5 else None, " ".join(rnd.choices(["acme", "steel", "iron", "zinc", "é𝄞"], k=3)), ps) for n, ps in places.items()], "node long, key string, canonical string, points array<struct<lat: double, lon: double>>")
    empty = {"string": ("name", "cleaned", "dba"), "array<string>": ("states", "cities", "zips", "state_days"), "date": ("first", "last"), "long": ("n_notices", "layoffs")}
    whole = lambda rows: rows.withColumns({c: F.lit(None).cast(t) for t, cs in empty.items() for c in cs})
    out = features_of_key(whole(few), "key")
    assert "hashpartitioning(a" not in out._jdf.queryExecution().toString()
    got = {(r.a, r.b): r for r in out.collect()}
    assert got.keys() == {(a, b) for a in places for b in places if a < b and a % 5 and b % 5}
    names = few.select("node", F.explode(linkage.char_grams(F.col("canonical"))).alias("term"))
    for r in linkage.pair_cosines(spark.createDataFrame(list(got), "a long, b long"), linkage.tfidf(names, "node"), "node").collect():
        assert got[r.a, r.b].name_char_cos == pytest.approx(r.cosine, abs=1e-12)

    def check(found, sets):
        for (a, b), r in found.items():
            want = min((haversine(p, q) for p in sets[a] for q in sets[b]), default=None)
            assert r.min_geo_km is None if want is None else abs(r.min_geo_km - want) < 1e-6

    check(got, places)
    places[1] = [(rnd.uniform(-60, 80), rnd.uniform(-180, 180)) for _ in range(300)] + places[3]
    many = few.where("node <> 1").union(spark.createDataFrame([(1, "k", "acme", places[1])], few.schema))
    check({(r.a, r.b): r for r in features_of_key(whole(many), "key").collect()}, places)


def test_features_hold_no_pairs_for_python(spark):
    """pairs pass through Python once, as batches; functions in a projection had Spark keep whole pairs on disk."""
    schema = "node long, name string, canonical string, cleaned string, dba string, states array<string>, cities array<string>, zips array<string>, state_days array<string>, points array<struct<lat: double, lon: double>>, first date, last date, n_notices long, layoffs long, key string"
    rows = spark.createDataFrame([(n, *["acme steel"] * 3, None, *[[]] * 5, None, None, 1, 1, "k") for n in range(3)], schema)
    for out in (features_of_key(rows, "key"), pair_features(rows, spark.createDataFrame([(0, 1)], "a long, b long"))):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan
    assert features_of_key(rows, "key", ("name_token_set", "min_geo_km")).columns == ["a", "b", *[c for c in FEATURES if c not in ("name_token_set", "min_geo_km")]]


def test_neighbours_send_no_table_of_nodes_to_the_driver(spark, monkeypatch):
    """tables that grow with the nodes are small by the compressed files they are read from, and are not broadcast."""
    from severa.staging import stage

    staged = []
    monkeypatch.setattr(linkage, "stage", lambda df, name: staged.append(df) or stage(df, name))
    rows = spark.createDataFrame([(i, f"red tin {i % 7} works", [f"S{i % 3}"]) for i in range(40)], "node long, name string, states array<string>")
    staged.append(linkage.candidate_pairs(rows))
    plans = [df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString() for df in staged]
    nodes = [line for plan in plans for line in plan.splitlines() if "BroadcastHashJoin" in line and any(f"[{c}#" in line for c in ("node", "rep", "other", "class", "word", "key"))]
    assert len(staged) >= 6 and not nodes
    w = linkage.tfidf(rows.select("node", F.explode(linkage.char_grams(F.col("name"))).alias("term")), "node")
    assert w._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2
