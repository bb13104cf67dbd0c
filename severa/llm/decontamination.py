"""Benchmark decontamination: a prefix-filtered set join, in DataFrame functions only.

Items become windows of consecutive words. A window's shingles (pairs of neighbouring words) are ordered by rarity in the
corpus; containment needs every shingle, so the rarest alone is a necessary prefix and the only one to join on. Its place
in the window gives the window's one possible place in the document: candidates that would begin before the text or end
beyond it are dropped, the rest are compared word for word over the window. With the prefixes broadcast, that happens where
the pair was found, and only true occurrences are shuffled, never a text.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from severa.staging import stage

from .common import ALNUM_WORD, keyed, text_of, without

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words: the characters that ALNUM_WORD leaves out.
BETWEEN = ALNUM_WORD.replace("[^", "[")
#: Shingles, one-word windows and windows with their items are each broadcast up to this many rows (about 100 bytes each);
#: beyond, they are shuffled.
BROADCAST_ROWS = 1_000_000


def normal(text: Column) -> Column:
    """Words of letters, digits and non-ASCII characters, A-Z in lower case, joined by a space."""
    return F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), BETWEEN, " "))


def _words(norm: Column) -> Column:
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(F.split(norm, " "))


def _windows(benchmark: DataFrame, width: int) -> DataFrame:
    """The windows of every item: window (their words joined by a space), words, item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), _words(normal(text_of())).alias("ws")).where(F.size("ws") > 0)
    places = F.sequence(F.lit(1), F.greatest(F.size("ws") - (width - 1), F.lit(1)))
    each = items.select("item", F.explode(F.transform(places, lambda i: F.slice("ws", i, width))).alias("words"))
    return each.select(F.array_join("words", " ").alias("window"), "words", "item")


def _shingles(words: str) -> Column:
    """at, (a, b): every pair of neighbouring words with the place of the first, from 0."""
    return F.posexplode(F.arrays_zip(F.slice(words, 1, F.size(words) - 1).alias("a"), F.slice(words, 2, F.size(words)).alias("b"))).alias("at", "pair")


def _few(table: DataFrame) -> bool:
    return table.count() <= BROADCAST_ROWS


def _near(large: DataFrame, small: DataFrame, broadcast: bool, keys: list[str]) -> DataFrame:
    return large.join(F.broadcast(small) if broadcast else small, keys)


def _occurrences(places: DataFrame, prefixes: DataFrame, texts: DataFrame, broadcast: bool, keys: list[str]) -> DataFrame:
    """places (row, words, at, keys) -> (row, start, len, window) of the windows that do occur."""
    inside = (F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.size("words"))
    same = F.array_join(F.slice("words", F.col("start") + 1, F.col("len")), " ") == F.col("window")
    start = (F.col("at") - F.col("offset")).alias("start")
    if broadcast:
        met = _near(places, prefixes, True, keys).select("row", "words", start, "len", "window")
    else:  # candidates first, without the texts; then the texts of the rows that have some
        met = places.drop("words").join(prefixes, keys).select("row", start, "len", "window").where("start >= 0").join(texts, "row")
    return met.where(inside & same).select("row", "start", "len", "window")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: float = 0.05) -> DataFrame:
    """documents (doc_id, text, any others) and benchmark (item_id, text) -> doc (a struct of the document's columns but
    text), n_words, n_hit (words inside an occurrence of an item's window), items (sorted ids of the items that occur, as
    strings), contaminated (n_hit > 0 and n_hit >= share * n_words).

    An item of fewer words than width, but not none, is one window. Null and empty texts have no words and are clean.
    Items without words match nothing; an item with a null id marks words but isn't listed. Repeated document rows each
    get their result; repeated items count once. Either table may be empty. Other columns ride along in `doc`."""
    owners = stage(_windows(benchmark, width), "windows")
    windows = owners.groupBy("window").agg(F.any_value("words").alias("words"))
    rows = stage(docs.select(F.monotonically_increasing_id().alias("row"), normal(text_of()).alias("norm"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("doc")), "normal")
    texts = rows.select("row", _words(F.col("norm")).alias("words"))

    pairs = stage(windows.where(F.size("words") > 1).select("window", F.size("words").alias("len"), _shingles("words")).select("window", "len", "at", "pair.a", "pair.b"), "shingles")
    small = _few(pairs)
    in_docs = texts.where(F.size("words") > 1).select("row", "words", _shingles("words")).select("row", "words", "at", "pair.a", "pair.b")
    wanted, seen = pairs.select("a", "b").distinct(), in_docs.select("a", "b")
    if small:
        counts = _near(seen, wanted, True, ["a", "b"]).groupBy("a", "b").count()
    else:  # counted before they are shuffled, so that a frequent pair is a row of every task
        counts = seen.groupBy("a", "b").count().join(wanted, ["a", "b"])
    rarest = (
        pairs.join(counts, ["a", "b"])  # a window with a shingle that no document has can't occur; see the next line
        .groupBy("window", "len").agg(F.count("*").alias("found"), F.min(F.struct("count", "a", "b", "at")).alias("rare"))
        .where(F.col("found") == F.col("len") - 1)
        .select("window", "len", "rare.a", "rare.b", F.col("rare.at").alias("offset"))
    )
    met = _occurrences(in_docs, stage(rarest, "prefixes"), texts, small, ["a", "b"])
    single = windows.where(F.size("words") == 1).select("window", F.lit(1).alias("len"), F.col("words")[0].alias("a"), F.lit(0).alias("offset"))
    if not single.isEmpty():
        ones = texts.select("row", "words", F.posexplode("words").alias("at", "a"))
        met = met.union(_occurrences(ones, single, texts, _few(single), ["a"]))
    found = stage(met, "found")

    spans = F.transform("met", lambda m: F.sequence(m["start"], m["start"] + m["len"] - 1))
    hits = found.groupBy("row").agg(F.collect_set(F.struct("start", "len")).alias("met")).select("row", F.size(F.array_distinct(F.flatten(spans))).cast("long").alias("n_hit"))
    holders = owners.where("item is not null").select("window", "item").distinct()
    named = _near(found.select("row", "window").distinct(), holders, _few(holders), ["window"])
    items = named.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    n_words = F.when(F.col("norm") == "", F.lit(0)).otherwise(F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit(""))) + 1).cast("long")
    out = rows.select("row", "doc", n_words.alias("n_words")).join(hits.join(items, "row", "left"), "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    part = Fraction(str(share))
    contaminated = (n_hit > 0) & (n_hit * part.denominator >= F.col("n_words") * part.numerator)
    return out.select("doc", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), contaminated.alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that `decontaminate` doesn't mark, unchanged; rows repeated with doc_id and text go or stay together."""
    marked = decontaminate(keyed(docs, F.col("text")), benchmark, **options).where("contaminated")
    return without(docs, marked.select("doc.k", "doc.occ"))
