"""Mixing sources to target weights: subset-sum budget fitting over exact lengths.

A source's target is first met with whole passes over its documents. What remains is a budget smaller than one pass,
fitted on counts of documents by exact length: the same fraction of every length, then single documents while they fit,
then a bounded-knapsack dynamic programme over a grid of sums; if that leaves words open, it runs again over more of the
budget, then with documents of each length given back. Counts, not documents, go through it; the
documents of a length are then chosen in the order of a seeded hash, by hash bucket first, so that no task ranks all
documents of a frequent length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from severa.staging import stage

from .common import SPACE_WORD, has_repeats, keyed, text_of

WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
#: Words left to the first dynamic programme, which is enough for a source with many short documents.
LAST_WORDS = 1 << 14
#: Sums that the dynamic programme keeps.
GRID = 1 << 20
#: Hash buckets of the documents of one source and length.
BUCKETS = 1024


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size) -> with target: all sizes shared by weight, a target ending at three times its source's size.

    A row for each source, some millions at the most, is one task's. The shares that result from resharing the excess again
    and again are least(3 * size, level * weight) for one level.
    In the order of size / weight the capped sources come first, so the level follows from running sums over sources."""
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.row_number().over(ranked) - 1, F.lit(len(WEIGHTS))) + 1)
    rows = sources.withColumn("weight", weight.cast("double")).withColumn("most", F.lit(MOST_PASSES) * F.col("source_size").cast("double"))
    order = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    heavy = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / heavy).withColumn("at", F.row_number().over(order))
    # The first source in that order which its level doesn't cap has the level of all the uncapped.
    level = F.min_by("level", F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("at"))).over(whole)
    return rows.withColumn("level", F.coalesce(level, F.lit(0.0))).select("source", "source_size", F.least(F.col("most"), F.col("level") * F.col("weight")).alias("target"))


def _reach(lengths: np.ndarray, free: np.ndarray, rest: int) -> tuple[np.ndarray, int]:
    """At most free[i] documents of lengths[i] words whose words come near below `rest`, and what they leave of it.

    Sums are kept one to a cell of a grid over 0 to `rest`, in units of the lengths' greatest common divisor: with a cell
    for every sum the result is the best there is; with wider cells it is near, as the best sum is kept beside the grid."""
    more, use = np.zeros_like(free), np.flatnonzero((free > 0) & (lengths <= rest))
    if not len(use):
        return more, rest
    unit = int(np.gcd.reduce(lengths[use]))
    most = rest // unit
    width = most // GRID + 1
    cells = np.zeros(most // width + 1, bool)
    cells[0] = True
    # node: its sum, the node before it, and the length and copies that were added
    sums, before, item, copies = (np.zeros(len(cells), np.int64) for _ in range(4))
    n, best = 1, (0, 0, 0, 0)
    for i in use:
        length = int(lengths[i]) // unit
        left, piece = min(int(free[i]), most // length), 1
        while left > 0 and best[0] < most:
            piece = min(piece, left)
            new = sums[:n] + piece * length
            fits = np.flatnonzero(new <= most)
            new = new[fits]
            if len(new) and new.max() > best[0]:
                best = (int(new.max()), int(fits[new.argmax()]), int(i), piece)
            cell = new // width
            fresh = np.flatnonzero(~cells[cell])
            kept, first = np.unique(cell[fresh], return_index=True)
            fresh, cells[kept] = fresh[first], True
            to = slice(n, n + len(fresh))
            sums[to], before[to], item[to], copies[to] = new[fresh], fits[fresh], i, piece
            n, left, piece = n + len(fresh), left - piece, piece * 2
    total, at, i, piece = best
    more[i] += piece
    while at > 0:
        more[item[at]] += copies[at]
        at = before[at]
    return more, rest - total * unit


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, last_words: int = LAST_WORDS) -> np.ndarray:
    """How many of counts[i] documents of lengths[i] words to take so that their words come as near below the budget as
    the programme finds: the nearest possible if the budget is at most GRID units. Lengths are distinct, ascending and
    positive."""
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    share = (counts * (budget / total)).astype(np.int64) if total else np.zeros_like(counts)
    best, gap, back, room = np.zeros_like(counts), budget, 0, last_words
    while gap > 0:
        take = np.maximum(share - back, 0)
        rest = budget - int((lengths * take).sum())
        for i in np.argsort(-lengths, kind="stable"):
            if rest <= room or back:
                break
            extra = min(int(counts[i] - take[i]), max(0, rest - room // 2) // int(lengths[i]))
            take[i] += extra
            rest -= extra * int(lengths[i])
        # What wide cells leave open is filled by finer ones.
        while rest > 0:
            more, left = _reach(lengths, counts - take, rest)
            take, rest, moved = take + more, left, left < rest
            if not moved:
                break
        if rest < gap:
            best, gap = take, rest
        if room < GRID:
            room = GRID
            continue
        if not (share - back > 0).any():
            break
        # No exact fit beside the same fraction of every length: documents of each are given back, ever more.
        back = back * 2 or 1
    return best


def _fit_source(last_words: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """The counts by length of one source -> with take."""
        rows = rows.sort_values("size")
        budget = float(rows["target"].iloc[0]) - float(rows["passes"].iloc[0]) * float(rows["source_size"].iloc[0])
        return rows.assign(take=fit(rows["size"].to_numpy(), rows["n"].to_numpy(), max(0, round(budget)), last_words))[["source", "size", "take"]]

    return run


def mix_sources(docs: DataFrame, seed: int = 17, last_words: int = LAST_WORDS) -> DataFrame:
    """documents (doc_id, text, source, any others) -> doc (a struct of the columns but text), size (words), source_size,
    target, copies (0 to 3) and taken (size * copies). The knapsack programme fits the last `last_words` of a budget, and
    more of it where that leaves words open.

    Sources in code-point order, null last, weigh 5, 2, 1 and again; their targets share all sizes. A null or empty text
    has size 0 and is taken no times. Ties between documents of one length fall by a hash of seed and doc_id; rows alike
    in source, size and doc_id are interchangeable. Sources whose texts are all empty have target 0; an empty table gives
    no rows. Reruns agree. Other columns ride along in `doc`."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*rest).alias("doc"), F.col("source").cast("string").alias("source"), F.regexp_count(text_of(), F.lit(SPACE_WORD)).cast("long").alias("size"), F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")).alias("draw"), F.col("doc_id").alias("id"))
    rows = stage(rows.withColumn("bucket", F.pmod("draw", F.lit(BUCKETS)).cast("int")), "sizes")
    buckets = rows.where("size > 0").groupBy("source", "size", "bucket").agg(F.count("*").alias("n"))
    lengths = buckets.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sources = stage(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    sources = sources.withColumn("passes", F.when(F.col("source_size") > 0, F.least(F.lit(MOST_PASSES), F.floor(F.col("target") / F.col("source_size") + 1e-9))).otherwise(0).cast("int"))
    same = lambda a, b, *more: [F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")), *[F.col(f"{a}.{c}") == F.col(f"{b}.{c}") for c in more]]
    plan = lengths.alias("l").join(sources.alias("s"), same("l", "s")).select("l.source", "l.size", "l.n", "s.source_size", "s.target", "s.passes")
    # One row for each length of a source: at most as many as its longest text has words.
    takes = plan.groupBy("source").applyInPandas(_fit_source(last_words), "source string, size long, take long")
    running = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(running), F.lit(0))
    quota = stage(
        buckets.alias("b").join(takes.where("take > 0").alias("t"), same("b", "t", "size")).select("b.*", "t.take")
        .withColumn("quota", F.greatest(F.lit(0), F.least(F.col("n"), F.col("take") - before))).where("quota > 0").select("source", "size", "bucket", "n", "quota"),
        "quotas",
    )
    # Quotas grow with the documents and are far larger in memory than as files, so they are never broadcast.
    near = rows.alias("r").join(quota.hint("merge").alias("q"), same("r", "q", "size", "bucket"), "left").select("r.*", "q.n", "q.quota")
    split = near.where("quota < n").withColumn("rank", F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("draw", "id")))
    every = near.where("quota is null or quota >= n").withColumn("extra", F.when(F.col("quota").isNotNull(), 1).otherwise(0))
    drawn = every.select("doc", "source", "size", "extra").union(split.select("doc", "source", "size", F.when(F.col("rank") <= F.col("quota"), 1).otherwise(0)))
    copies: Column = F.when(F.col("d.size") > 0, F.col("s.passes") + F.col("d.extra")).otherwise(0)
    out = drawn.alias("d").join(sources.alias("s"), same("d", "s"))
    return out.select("d.doc", "d.size", "s.source_size", "s.target", copies.cast("int").alias("copies")).withColumn("taken", F.col("size") * F.col("copies"))


def draw_mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target, copies and taken beside their own columns. Keys go
    through the mix and meet the texts once; only where rows repeat in doc_id and text do the texts go along."""
    added = ["size", "source_size", "target", "copies", "taken"]
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    if has_repeats(docs):
        carried = mix_sources(docs.select("doc_id", "source", "text", whole), seed).where("copies > 0")
        return carried.select("doc.doc.*", *added)
    keys = mix_sources(keyed(docs, F.col("doc_id"), F.col("source"), F.col("text")), seed).where("copies > 0").select("doc.k", "doc.occ", *added)
    return keyed(docs, whole).join(keys, ["k", "occ"]).select("doc.*", *added)
