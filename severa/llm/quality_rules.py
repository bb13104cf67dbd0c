"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each text's features are held against fences that its own language and source set. The fences come from quantile
sketches: per language, source and feature a histogram whose bins keep the six leading bits of the value, so that any
quantile is off by at most a 32nd of its value. Sketches merge by adding counts, exactly and in any order: Spark's
partial aggregation merges them, and a language's sketch is the sum of its sources'. A group too small for quantiles of
its own takes its language's, or else the corpus's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from severa.staging import stage

from .common import SPACE_WORD, text_of

BITS = 6
#: Groups of fewer documents take the next wider group's fences.
MIN_DOCS = 100
#: Features, each an integer share or mean per thousand, and the least distance from a quartile to its fence, which only
#: speaks where the quartiles of a group lie together: one symbol in 50 words, one line in four, 150 words in a thousand,
#: one character a word.
FEATURES = {"symbols": 20, "dup_lines": 250, "repeats": 150, "word_length": 1000}
#: Groups are broadcast to the documents up to so many rows of fences (under 100 bytes each); beyond, they are shuffled.
BROADCAST_ROWS = 500_000


def _bin(value: Column) -> Column:
    """The value with all but its leading bits cleared."""
    low = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, low), low)


def features(docs: DataFrame) -> DataFrame:
    """A row for each document: doc (struct of the other columns), n_words, word_chars, n_symbols, n_lines (those with a
    word), n_dup_lines, n_repeat_words, lang, source."""
    text = text_of()
    words = F.regexp_extract_all(text, F.lit(SPACE_WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.trim(F.translate(line, "\t\x0b\x0c\r", "    "))) > 0)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    base = docs.select(F.struct(*rest).alias("doc"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("text"), words.alias("words"), lines.alias("lines"))
    triples = F.when(
        F.size("words") > 2,
        F.transform(F.arrays_zip(F.slice("words", 1, F.size("words") - 2).alias("a"), F.slice("words", 2, F.size("words") - 2).alias("b"), F.slice("words", 3, F.size("words") - 2).alias("c")), lambda t: F.xxhash64(t)),
    ).otherwise(F.array().cast("array<bigint>"))
    base = base.select("doc", "lang", "source", "words", F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), triples.alias("triples"))
    # Texts without a repeated window are done with; in the others, sorting brings equal windows together.
    placed = F.array_sort(F.transform("triples", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    base = base.withColumn("placed", F.when(F.size(F.array_distinct("triples")) < F.size("triples"), placed))
    again = F.filter("placed", lambda x, k: ((k > 0) & (x["h"] == F.get("placed", k - 1)["h"])) | (x["h"] == F.get("placed", k + 1)["h"]))
    base = base.withColumn("begins", F.when(F.col("placed").isNotNull(), F.array_sort(F.transform(again, lambda x: x["i"]))))
    # A window adds three words, less those that the window before it has covered.
    covered = F.aggregate("begins", F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")), lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(i - s["last"], F.lit(3))).alias("n")), lambda s: s["n"])
    return base.select("doc", "lang", "source", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), "n_symbols", "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def shares(rows: DataFrame) -> DataFrame:
    """Adds the features that fences apply to: whole numbers per thousand words (dup_lines: per thousand lines with a
    word; word_length: per word)."""
    per = lambda c, of="n_words": F.when(F.col(of) > 0, F.expr(f"({c} * 1000) div {of}")).otherwise(F.lit(0)).cast("long")
    return rows.withColumns({"symbols": per("n_symbols"), "dup_lines": per("n_dup_lines", "n_lines"), "repeats": per("n_repeat_words"), "word_length": per("word_chars")})


def fences(rows: DataFrame, min_docs: int = MIN_DOCS, reach: int = 3) -> DataFrame:
    """rows of `shares` -> lang, source, and lo_f, hi_f for each feature f.

    hi is the upper quartile plus `reach` times the distance between the quartiles, or plus the feature's floor in
    FEATURES if that is more; lo the same below the lower quartile."""
    stacked = rows.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), _bin(F.col(f)).alias("bin")) for f in FEATURES])).alias("x"))
    own = stacked.groupBy("lang", "source", "x.feature", "x.bin").agg(F.count("*").alias("n"))
    own = stage(own, "sketches")
    groups = own.where(F.col("feature") == "symbols").groupBy("lang", "source").agg(F.sum("n").alias("docs"))
    lang_docs = groups.groupBy("lang").agg(F.sum("docs").alias("lang_docs"))
    level = F.when(F.col("docs") >= min_docs, 0).when(F.col("lang_docs") >= min_docs, 1).otherwise(2)
    groups = groups.alias("g").join(lang_docs.alias("l"), F.col("g.lang").eqNullSafe(F.col("l.lang"))).select("g.lang", "g.source", level.alias("level"))
    sketches = (
        own.select(F.lit(0).alias("level"), "lang", "source", "feature", "bin", "n")
        .union(own.groupBy("lang", "feature", "bin").agg(F.sum("n").alias("n")).select(F.lit(1), "lang", F.lit(None).cast("string"), "feature", "bin", "n"))
        .union(own.groupBy("feature", "bin").agg(F.sum("n").alias("n")).select(F.lit(2), F.lit(None).cast("string"), F.lit(None).cast("string"), "feature", "bin", "n"))
    )
    # A sketch has at most 32 bins for each power of two: a row.
    bins = sketches.groupBy("level", "lang", "source", "feature").agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").alias("total"))
    at = lambda q: F.aggregate("bins", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("v")), lambda s, b: F.struct((s["seen"] + b["n"]).alias("seen"), F.coalesce(s["v"], F.when((s["seen"] + b["n"]) * 4 >= F.col("total") * q, b["bin"])).alias("v")), lambda s: s["v"])
    room = F.create_map(*[F.lit(x) for f in FEATURES.items() for x in f])[F.col("feature")]
    wide = F.greatest((F.col("q3") - F.col("q1")) * reach, room)
    both = bins.withColumn("q1", at(1)).withColumn("q3", at(3)).select("level", "lang", "source", "feature", (F.col("q1") - wide).alias("lo"), (F.col("q3") + wide).alias("hi"))
    table = both.groupBy("level", "lang", "source").agg(*[F.max(F.when(F.col("feature") == f, F.col(c))).alias(f"{c}_{f}") for f in FEATURES for c in ("lo", "hi")])
    same = (F.col("g.level") == F.col("t.level")) & F.when(F.col("g.level") < 2, F.col("g.lang")).eqNullSafe(F.col("t.lang")) & F.when(F.col("g.level") < 1, F.col("g.source")).eqNullSafe(F.col("t.source"))
    return groups.alias("g").join(table.alias("t"), same).select("g.lang", "g.source", *[f"t.{c}_{f}" for f in FEATURES for c in ("lo", "hi")])


def quality_rules(docs: DataFrame, min_docs: int = MIN_DOCS, reach: int = 3) -> DataFrame:
    """documents (doc_id, text, lang, source, any others) -> doc (a struct of the columns but text), the counts of
    `features`, base_failed (under 50 words, or more than half of them in repeated three-word windows) and kept: not
    base_failed, and every share inside its group's fences.

    Null and empty texts have no words and fail. A null lang or source is a group like any other. Every row gets its own
    result, repeated ones too; an empty table gives no rows. Other columns ride along in `doc`."""
    rows = stage(shares(features(docs)), "features")
    limits = stage(fences(rows, min_docs, reach), "fences")
    small = limits.count() <= BROADCAST_ROWS
    near = (F.broadcast(limits) if small else limits).alias("t")
    joined = rows.alias("r").join(near, F.col("r.lang").eqNullSafe(F.col("t.lang")) & F.col("r.source").eqNullSafe(F.col("t.source")), "left")
    inside = F.lit(True)
    for f in FEATURES:
        inside = inside & F.col(f"r.{f}").between(F.col(f"t.lo_{f}"), F.col(f"t.hi_{f}"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return joined.select("doc", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & inside).alias("kept"))
