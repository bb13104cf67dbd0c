"""Each operator on hand-made rows: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from severa.llm import toxicity
from severa.llm.decontamination import decontaminate, drop_contaminated
from severa.llm.jaccard_join import jaccard_join
from severa.llm.quality_rules import quality_rules
from severa.llm.source_mix import fit, mix_sources
from severa.llm.substring_dedup import dedup_substrings
from severa.llm.token_counts import count_tokens, read_cache, splits_at_space
from severa.llm.url_filters import filter_urls, intervals, lookup_keys
from severa.llm.warc_revisits import canonical_url, resolve_revisits

LONG = " ".join(f"w{i}" for i in range(40_000))
#: Columns whose names the operators use inside.
CLASH = "doc_id long, text string, lang string, source string, size int, row int, n_words int, k int, score double, words string, doc string, kept boolean"


@pytest.fixture(scope="module")
def docs(spark):
    rest = (1, 2, 3, 4, 0.5, "x", "y", True)
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, " \t\n ", "en", "a"), (4, "one two three", "en", "a"), (5, LONG, "de", "a"), (6, "one two three", "en", "b"), (6, "one two three", "en", "b"), (6, "other words here", "en", "b"), (None, "no id", "en", None), (8, "ça va ça va ça va", "fr", "b")]
    return spark.createDataFrame([(*r, *rest) for r in rows], CLASH)


def test_substrings_against_brute_force(spark):
    import random

    rnd = random.Random(3)
    passages = [[f"p{j}_{i}" for i in range(rnd.randint(3, 12))] for j in range(6)]
    rows = []
    for d in range(60):
        words = []
        for _ in range(rnd.randint(0, 6)):
            words += rnd.choice(passages) if rnd.random() < 0.6 else [f"u{rnd.randint(0, 10**6)}" for _ in range(rnd.randint(1, 5))]
        rows.append((d, " ".join(words)))
    rows += [(100 + d, f"{' '.join(passages[0])} own{d}") for d in range(30)]  # a passage of many documents
    for width, flush in ((1, 2_000_000), (4, 2_000_000), (4, 60)):
        seen, want = set(), {}
        for d, t in rows:
            words = t.split()
            gone = set()
            for i in range(len(words) - width + 1):
                w = tuple(words[i : i + width])
                if w in seen:
                    gone |= set(range(i, i + width))
                seen.add(w)
            want[d] = (len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone))
        out = dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), width, flush=flush).collect()
        assert {r.doc.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in out} == want
        assert all(sum(s["last"] - s["first"] + 1 for s in r.spans) == r.n_removed for r in out)


def test_substrings_edges(docs):
    out = dedup_substrings(docs, 3).collect()
    got = Counter((r.doc.doc_id, r.n_words, r.n_removed) for r in out)
    assert got == Counter({(1, 0, 0): 1, (2, 0, 0): 1, (3, 0, 0): 1, (4, 3, 0): 1, (5, 40_000, 0): 1, (6, 3, 3): 2, (6, 3, 0): 1, (None, 2, 0): 1, (8, 6, 4): 1})
    assert out[0].doc.asDict().keys() == set(docs.columns) - {"text"}
    for flush in (1, 5):
        assert Counter((r.doc.doc_id, r.n_words, r.n_removed) for r in dedup_substrings(docs.repartition(2), 3, flush=flush).collect()) == got
    assert dedup_substrings(docs.limit(0)).count() == 0


def test_decontamination_edges(spark, docs):
    items = spark.createDataFrame([(10, "One, TWO three"), (11, "ça va"), (12, None), (13, "?!"), (14, "words"), (None, "no id"), (10, "One, TWO three"), (15, "w1 w2 w3 w5")], "item_id long, text string")
    out = Counter((r.doc.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in decontaminate(docs, items).collect())
    assert out == Counter({(1, 0, 0, (), False): 1, (2, 0, 0, (), False): 1, (3, 0, 0, (), False): 1, (4, 3, 3, ("10",), True): 1, (5, 40_000, 0, (), False): 1, (6, 3, 3, ("10",), True): 2, (6, 3, 1, ("14",), True): 1, (None, 2, 2, (), True): 1, (8, 6, 6, ("11",), True): 1})
    assert decontaminate(docs.limit(0), items).count() == 0
    kept = drop_contaminated(docs, items)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 5])
    assert decontaminate(docs, items.limit(0)).where("n_hit > 0").count() == 0


def test_decontamination_windows(spark):
    item = " ".join(f"i{n}" for n in range(20))
    rows = [(1, item), (2, " ".join(item.split()[2:15])), (3, " ".join(item.split()[:12])), (4, "x " * 300 + item.upper() + " y" * 300), (5, " ".join(item.split()[:13] + item.split()[:13]))]
    got = {r.doc.doc_id: (r.n_hit, r.contaminated) for r in decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: (20, True), 2: (13, True), 3: (0, False), 4: (20, False), 5: (26, True)}


@pytest.mark.parametrize("most", [0, 12])
def test_decontamination_beyond_broadcast(spark, docs, monkeypatch, most):
    """Tables above the limit are shuffled, each by its own size: same result, and no hint in the plan of the large one."""
    from severa.llm import decontamination

    passage = " ".join(f"w{i}" for i in range(100, 113))
    items = spark.createDataFrame([(i, passage) for i in range(40)] + [(100, "words"), (101, "one two three"), (102, "ça")], "item_id long, text string")
    show = lambda out: Counter((r.doc.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in out.collect())
    want = show(decontaminate(docs, items))
    asked = []
    near = decontamination._near
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", most)
    monkeypatch.setattr(decontamination, "_near", lambda large, small, broadcast, keys: asked.append((small.count(), broadcast)) or near(large, small, broadcast, keys))
    assert show(decontaminate(docs, items)) == want
    assert asked and all(n <= most for n, broadcast in asked if broadcast)
    assert any(r[0] == 5 and r[2] == 13 and len(r[3]) == 40 for r in want)


def test_mix_targets_and_copies(spark):
    rows = [(i, "w " * (i % 7 + 1), s) for s, n in (("a", 40), ("b", 400), ("c", 300), (None, 50)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mix_sources(docs).collect()
    sizes = Counter()
    for r in out:
        sizes[r.doc.source] += r.size
    total, weight = sum(sizes.values()), {"a": 5, "b": 2, "c": 1, None: 5}
    target, free = {}, set(weight)
    while free:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        target |= {s: 3.0 * sizes[s] for s in over} if over else share
        free = free - over if over else set()
    taken = Counter()
    for r in out:
        assert r.target == pytest.approx(target[r.doc.source]) and r.source_size == sizes[r.doc.source]
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r["size"]
        taken[r.doc.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    again = mix_sources(docs.repartition(9)).collect()
    assert Counter((r.doc, r.copies) for r in out) == Counter((r.doc, r.copies) for r in again)


def test_mix_edges(docs):
    out = mix_sources(docs).collect()
    assert len(out) == 10 and all(r.taken == 0 for r in out if r["size"] == 0)
    assert mix_sources(docs.limit(0)).count() == 0
    assert all(r.target == 0 for r in mix_sources(docs.where("doc_id = 2")).collect())


def test_fit_is_exact_where_a_sum_exists():
    import numpy as np

    lengths, counts = np.array([3, 5, 7, 1000, 20_000]), np.array([4, 2, 9, 50, 30])
    for budget in (0, 1, 3, 8, 99, 12_345, 300_000, 649_999):
        take = fit(lengths, counts, budget)
        assert (take <= counts).all() and (take >= 0).all()
        reach = {0}
        got = int((take * lengths).sum())
        assert got <= budget
        if budget <= 99:
            for n, c in zip(lengths.tolist(), counts.tolist(), strict=True):
                reach = {r + n * j for r in reach for j in range(c + 1) if r + n * j <= budget}
            assert got == max(reach)


def test_toxicity(spark, docs):
    words = [f"v{i}" for i in range(50)]
    rows = [(i, " ".join(words[(i * k) % 50] for k in range(1, 30)) + (" Horrid!" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(1000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    weights = toxicity.train(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    got = toxicity.score(table, weights).select("doc.toxic", "score").collect()
    assert sum((r.score >= 0.5) == (r.toxic == 1) for r in got) >= 0.99 * len(got)
    edge = toxicity.score(docs, weights)
    assert edge.count() == 10 and edge.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.drop_toxic(docs, weights).columns == docs.columns
    assert toxicity.score(docs.limit(0), weights).count() == 0
    assert toxicity.train(docs.limit(0), table.select("doc_id", "toxic")) == {}
    assert {r.score for r in toxicity.score(docs, {}).collect()} == {0.5}


def test_held_out_toxicity(spark):
    from severa.llm.queries import op3_toxicity

    sf = "/root/testdata/sf0.1"
    rows = op3_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("toxic", "predicted").collect()
    assert sum(r.toxic == r.predicted for r in rows) >= 0.96 * len(rows)
    assert sum(r.predicted for r in rows if r.toxic == 0) <= 0.01 * len(rows)


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(triples)
    hit = {i + j for i, t in enumerate(triples) if n[t] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_counts(spark, docs):
    extra = spark.createDataFrame([(20 + i, t, "en", "a") for i, t in enumerate(["a b a b a b c", "x\ny\n\nx\n x\n \n \n", "#1 <b> a|b & c", "e\x1cf\x85g h", "a a a a", "l\r\nl\r\nm", "foo bar \x85", "x \n\x85", "\x85 foo bar", "foo \u2028", "\u2028\u2029 x y \u2029", " \u2029\nfoo\n\u2029", "\u2028", " \x85 ", "a b c \x85\na b c \x85"])], "doc_id long, text string, lang string, source string")
    for table in (docs, extra):
        texts = Counter((r.doc_id, *brute_quality(r.text)) for r in table.collect())
        got = quality_rules(table).collect()
        assert Counter((r.doc.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == texts
        assert all(r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words) and not (r.kept and r.base_failed) for r in got)
    assert quality_rules(docs.limit(0)).count() == 0


def test_quality_keeps_clean_and_rejects_odd(spark):
    import random

    rnd = random.Random(1)
    clean = [(i, " ".join(f"word{rnd.randint(0, 10**6)}" for _ in range(rnd.randint(60, 300))), "en", f"s{i % 3}") for i in range(600)]
    odd = [(1000 + i, " ".join(f"w{rnd.randint(0, 10**6)}###" for _ in range(100)), "en", "s0") for i in range(5)]
    kept = {r.doc.doc_id for r in quality_rules(spark.createDataFrame(clean + odd, "doc_id long, text string, lang string, source string")).where("kept").collect()}
    assert kept == {i for i, *_ in clean}


def test_quality_fences_follow_their_source(spark):
    import random

    rnd = random.Random(2)
    word = lambda: f"word{rnd.randint(0, 10**6)}"
    with_symbols = lambda n: " ".join([word() for _ in range(100 - n)] + [f"{word()}#" for _ in range(n)])
    lines = lambda again: "\n".join(["a header of this very page"] * (again + 1) + [" ".join(word() for _ in range(10)) for _ in range(11 - again)])
    # Source tags writes up to 30 symbols in 100 words, source prose none; the same text is usual here and odd there.
    rows = [(i, with_symbols(rnd.randint(0, 30)), "en", "tags") for i in range(200)] + [(200 + i, with_symbols(0), "en", "prose") for i in range(200)]
    same = with_symbols(25)
    rows += [(400, same, "en", "tags"), (401, same, "en", "prose")]
    # Source pages repeats a line seldom, source forum up to five of twelve times: six in twelve fail by their lines alone.
    rows += [(500 + i, lines(0), "en", "pages") for i in range(200)] + [(700 + i, lines(rnd.randint(0, 5)), "en", "forum") for i in range(200)]
    copied = lines(4)
    rows += [(900, copied, "en", "pages"), (901, copied, "en", "forum")]
    out = {r.doc.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert out[400].kept and not out[401].kept and out[901].kept and not out[900].kept
    assert not any(out[i].base_failed for i in (400, 401, 900, 901)) and out[900].n_symbols == 0
    assert all(out[i].kept for i in range(400)) and all(out[i].kept for i in range(500, 900))


def test_token_counts(spark, docs, tmp_path):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    file, cache = path("word_bpe_49k.json"), f"file://{tmp_path}/cache"
    whole = Tokenizer.from_file(file)
    tricky = ["<|startoftext|>hi<|endoftext|>", "Don't we'll x y", "é ́x", "naïve ΣΑΣ z", "a\x1cb", "日本語 テスト 123,456", "İstanbul"]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(tricky)], "doc_id long, text string")
    table = docs.select("doc_id", "text").union(more)
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id") + 1000, "text")
    table = table.union(real)
    want = Counter((r.doc_id, len((r.text or "").encode()), len(whole.encode(r.text or "", add_special_tokens=False))) for r in table.collect())
    for _ in range(2):  # the second time all are hits
        got = count_tokens(table, file, cache).collect()
        assert Counter((r.doc.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
        size = read_cache(spark, cache).count()
        assert size == len({hashlib.sha256((r.text or "").encode()).digest() for r in table.collect()}) == spark.read.parquet(cache).count()
    assert count_tokens(docs.limit(0), file, cache).count() == 0


def test_one_encoding_a_text(spark, tmp_path):
    """Copies with null and repeated ids are encoded and appended once, as are texts known to the cache."""
    from public_tokenizers import path

    rows = [(None, "same text")] * 200 + [(7, t) for t in ("one", "two") for _ in range(50)] + [(None, None)] * 3 + [(8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    cache = f"file://{tmp_path}/cache"
    for more in (0, 1):
        table = docs.union(spark.createDataFrame([(9, "fresh")] * more, "doc_id long, text string")) if more else docs
        assert count_tokens(table, path("word_bpe_49k.json"), cache).count() == len(rows) + more
        assert spark.read.parquet(cache).count() == 4 + more


def test_tokenizers_that_join_words_get_whole_texts(spark, tmp_path):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    file = path("byte_bpe_50k.json")
    assert splits_at_space(path("word_bpe_49k.json")) and not splits_at_space(file)
    whole = Tokenizer.from_file(file)
    texts = ["two  words", " lead", "a\nb\n\nc", "", "x " * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc.doc_id: r.n_tokens for r in count_tokens(docs, file, f"file://{tmp_path}/c").collect()}
    assert got == {i: len(whole.encode(t, add_special_tokens=False)) for i, t in enumerate(texts)}


def test_ids_of_other_types_and_extreme_ones(spark):
    top = 2**63 - 1
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(top, base), (None, base), (None, base + " x"), (None, "other words"), (-(2**63), base)]
    longs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc.doc_id, r.n_removed) for r in dedup_substrings(longs, 20).collect()}
    assert got == {(-(2**63), 0), (top, 40), (None, 40), (None, 0)}
    links = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard_join(longs).collect())
    assert links == Counter({(top, -(2**63), 3): 1, (None, -(2**63), 3): 2, (None, None, 0): 1, (-(2**63), -(2**63), 3): 1})
    named = spark.createDataFrame([("a", base), ("b", base), ("c", "other words"), (None, base)], "doc_id string, text string")
    classes = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join(named).collect()}
    assert classes["a"] == classes["b"] and classes["a"][0] in "ab" and classes[None] == (classes["a"][0], 2) and classes["c"] == ("c", 0)
    assert sorted(r.n_removed for r in dedup_substrings(named, 20).collect()) == [0, 0, 40, 40]
    small = spark.createDataFrame([(1, "x"), (2, None)], "doc_id int, text string")
    assert {type(r.doc_id) for r in jaccard_join(small).collect()} == {int} and jaccard_join(small).schema["class_id"].dataType.simpleString() == "int"


def test_very_long_urls_headers_and_ties(spark):
    long = "http://e.com/" + "a/" * 3000 + "?q=" + "x" * 20_000
    entries = spark.createDataFrame([("l", "e.com/" + "a/" * 2999, "add", "2024-01-01")], "list string, pattern string, action string, at string").withColumn("at", F.col("at").cast("timestamp"))
    captures = spark.createDataFrame([(long, "2024-01-02"), (long, "2023-12-31")], "url string, fetched string").withColumn("fetched", F.col("fetched").cast("timestamp"))
    assert sorted(r.blocked for r in filter_urls(captures, entries).collect()) == [False, True]
    big = {"etag": '"a"', "x": "y" * 100_000}
    rows = [(1, long, "2024-01-01", "response", 200, big, "d"), (1, long, "2024-01-01", "response", 200, big, "d"), (2, long, "2024-01-02", "revisit", 304, {"etag": '"a"'}, None)]
    table = spark.createDataFrame(rows, "capture_id long, url string, fetched string, kind string, status int, headers map<string,string>, digest string").withColumn("fetched", F.col("fetched").cast("timestamp"))
    got = Counter((r.capture.capture_id, r.verdict, r.ref_id, len(r.headers["x"])) for r in resolve_revisits(table).collect())
    assert got == Counter({(1, "response", None, 100_000): 2, (2, "resolved", 1, 100_000): 1})


def test_canonical_urls(spark):
    pairs = [("HTTP://WWW.Ex.com:80/a/?utm_source=f&x=1#top", "ex.com/a?x=1"), ("https://ex.com/a", "ex.com/a"), ("https://ex.com", "ex.com"), ("ex.com/?ref=x", "ex.com"), ("http://m.ex.com/A.html", "m.ex.com/A.html"), (None, None)]
    rows = spark.createDataFrame(pairs, "url string, want string").select("want", canonical_url(F.col("url")).alias("got")).collect()
    assert [(r.want, r.got) for r in rows] == [(w, w) for _, w in pairs]


def test_revisits(spark):
    t = "2024-01-0{} 00:00:00".format
    full = {"etag": '"a"', "content-type": "x", "date": "1"}
    rows = [
        (1, "http://e.com/p", t(1), "response", 200, full, "d1"), (2, "https://www.e.com/p/", t(2), "revisit", 304, {"etag": 'W/"a"', "date": "2", "set-cookie": "c"}, None),
        (3, "http://e.com/p", t(3), "response", 500, {}, "d3"), (4, "http://e.com/p", t(4), "revisit", 304, {"etag": '"b"'}, None), (5, "http://e.com/p", t(5), "revisit", 304, None, "d1"),
        (6, "http://e.com/p", t(5), "revisit", 304, {}, None), (7, "http://e.com/q", t(5), "revisit", 304, full, None), (8, None, t(5), "revisit", 304, full, None), (9, "http://e.com/p", None, "revisit", 304, full, None),
        (10, "http://e.com/p", t(1), "revisit", 304, full, None), (0, "http://e.com/p", t(1), "revisit", 304, full, None), (10, "http://e.com/p", t(1), "revisit", 304, full, None),
    ]
    table = spark.createDataFrame(rows, "capture_id long, url string, fetched string, kind string, status int, headers map<string,string>, digest string").withColumn("fetched", F.col("fetched").cast("timestamp")).withColumn("block", F.lit("z"))
    out = resolve_revisits(table).collect()
    got = Counter((r.capture.capture_id, r.verdict, r.ref_id) for r in out)
    assert got == Counter({(1, "response", None): 1, (2, "resolved", 1): 1, (3, "response", None): 1, (4, "mismatch", None): 1, (5, "resolved", 1): 1, (6, "unvalidated", None): 1, (7, "no_response", None): 1, (8, "no_response", None): 1, (9, "no_response", None): 1, (10, "resolved", 1): 2, (0, "no_response", None): 1})
    assert next(r.headers for r in out if r.capture.capture_id == 2) == {"etag": 'W/"a"', "date": "2", "content-type": "x"}
    assert resolve_revisits(table.limit(0)).count() == 0


def test_url_filters(spark):
    day = "2024-01-{:02} 00:00:00".format
    entries = spark.createDataFrame([("l", "bad.com", "add", day(2)), ("l", "bad.com", "add", day(3)), ("l", "bad.com", "remove", day(5)), ("m", "a.bad.com/x/", "add", day(1)), ("m", "z.com", "remove", day(1)), ("m", None, "add", day(1)), ("l", "bad.com", "add", day(9)), ("l", "bad.com", "remove", day(9)), ("l", "bad.com", "add", day(2))], "list string, pattern string, action string, at string").withColumn("at", F.col("at").cast("timestamp"))
    assert sorted((r["list"], r.pattern, r.since.day, r.until and r.until.day) for r in intervals(entries).collect()) == [("l", "bad.com", 2, 5), ("m", "a.bad.com/x/", 1, None)]
    rows = [("http://A.bad.com/x/y", day(2)), ("http://bad.com", day(1)), ("http://bad.com/", day(5)), ("http://notbad.com/", day(3)), ("http://a.bad.com/x", day(4)), (None, day(3)), ("http://bad.com", None), ("", day(3)), ("http://bad.com", day(4)), ("http://bad.com", day(4))]
    captures = spark.createDataFrame(rows, "url string, fetched string").withColumn("fetched", F.col("fetched").cast("timestamp")).withColumn("row", F.lit(1)).withColumn("pattern", F.lit("p"))
    got = Counter((r.capture.url, r.n_active, ",".join(r.lists), r.blocked) for r in filter_urls(captures, entries).collect())
    assert got == Counter({("http://A.bad.com/x/y", 2, "l,m", True): 1, ("http://bad.com", 0, "", False): 2, ("http://bad.com/", 0, "", False): 1, ("http://notbad.com/", 0, "", False): 1, ("http://a.bad.com/x", 1, "l", True): 1, (None, 0, "", False): 1, ("", 0, "", False): 1, ("http://bad.com", 1, "l", True): 2})
    assert filter_urls(captures.limit(0), entries).count() == 0 and filter_urls(captures, entries.limit(0)).where("blocked").count() == 0
    keys = spark.range(1).select(lookup_keys(F.lit("https://a.b.com:8080/x/y.html?q#f")).alias("k")).first().k
    assert set(keys) == {"a.b.com", "b.com", "com", "a.b.com/", "a.b.com/x/"}


def thue_morse(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_of_thue_morse_letters_are_told_apart(spark, n):
    """Any polynomial of the letters modulo 2**64 is the same for such a word and its complement."""
    from severa.llm.license_scan import scan_licenses

    one, rest = thue_morse(n), " ".join(f"w{i}" for i in range(19))
    two = one.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{two} {rest}")], "doc_id long, text string")
    assert [r.n_removed for r in dedup_substrings(docs).select("n_removed").collect()] == [0, 0]
    words = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    assert sorted((r.class_id, r.n_links) for r in jaccard_join(words).collect()) == [(1, 0), (2, 0)]
    licence = "permission is hereby granted free of charge to any person obtaining a copy of this software"
    files = spark.createDataFrame([(1, "r", "a/x", licence), (2, "r", "b/x", f"{one} {two}")], "doc_id long, repo string, path string, text string")
    assert {r.doc_id: r.own for r in scan_licenses(files).select("file.doc_id", "own").collect()}[2] is None


def test_windows_with_one_hash_and_two_checks(spark, monkeypatch):
    """Equal hashes alone repeat nothing: here all windows have one hash, and the checks tell them apart."""
    from severa.llm import hashing
    from severa.llm.substring_dedup import _deal, _repeats, _unpack

    monkeypatch.setattr(hashing, "windows_of", lambda words, first, width: (np.full(len(words) - width + 1, 7, np.uint64), np.arange(len(words) - width + 1)))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([0]), pa.array(["a b c d a b c e"])], names=["k", "occ", "text"])
    dealt = pa.Table.from_batches(list(_deal(3, 1, 100)([batch])))
    late = _repeats(1)(dealt.filter(pc.equal(dealt["part"], 0)))
    assert [_unpack(*(late.column(c)[0].as_py() for c in ("keys", "occs", "counts", "gaps")))[2].tolist()] == [[4]]
