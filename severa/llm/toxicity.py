"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are hashed words, pairs of neighbours and pairs with one word between, present or not in a text. FTRL learns
one row after another, so it runs in one task, over a bounded sample of the labelled rows (models learnt apart and
averaged missed four times as many toxic texts). Per-coordinate rates and L1 leave a few hundred non-zero weights; they,
at most 2**bits, go to every task, and scoring takes all rows where they lie.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from severa.staging import stage

from . import hashing
from .common import small_batches, text_of

U64 = np.uint64
BITS = 20


def _features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and feature of every n-gram and skip-gram occurrence."""
    words, first = hashing.words_of(data, offsets)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    shift = U64(64 - bits)
    found, owner = [words >> shift], [doc]
    for gap in (1, 2):
        if len(words) > gap:
            pair = hashing.mix(words[:-gap] * U64(hashing.BASE + 2 * gap) + words[gap:])
            same = doc[:-gap] == doc[gap:]
            found.append(pair[same] >> shift)
            owner.append(doc[:-gap][same])
    return np.concatenate(owner), np.concatenate(found).astype(np.int32)


def plain_words(text):
    """Lower-cased words with everything but letters, digits and non-ASCII characters as a space."""
    return F.regexp_replace(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")


def sets(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of each text, one after the other, and where each text's begin, with the end last."""
    doc, found = _features(data, offsets, bits)
    once = np.unique((doc.astype(np.int64) << bits) | found)
    return (once & ((1 << bits) - 1)).astype(np.int32), np.searchsorted(once >> bits, np.arange(len(offsets)))


def ftrl(texts: Iterable[np.ndarray], labels: np.ndarray, bits: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features by FTRL-proximal; the last coordinate is the bias, which L1 doesn't touch."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(epochs):
        for features, y in zip(texts, labels, strict=True):
            own = np.append(features, size - 1)
            zi, ni = z[own], n[own]
            pull = np.sign(zi) * l1
            pull[-1] = 0
            w = np.where((np.abs(zi) <= l1) & (own < size - 1), 0.0, (pull - zi) / ((beta + np.sqrt(ni)) / alpha + l2))
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            z[own] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[own] = ni + g * g
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    w[-1] = -z[-1] / ((beta + np.sqrt(n[-1])) / alpha + l2)
    kept = np.flatnonzero(w)
    return kept, w[kept]


class _Texts:
    """Feature sets that can be gone through again and again, held as a few long arrays."""

    def __init__(self, column: pa.Array, bits: int):
        self.chunks = [sets(data, offsets, bits) for _, _, data, offsets in hashing.texts_of(column)]

    def __iter__(self) -> Iterator[np.ndarray]:
        return (found[a:b] for found, bounds in self.chunks for a, b in zip(bounds[:-1], bounds[1:], strict=True))


def _learn(bits: int, epochs: int, alpha: float, beta: float, l1: float, l2: float):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, [("draw", "ascending")])).combine_chunks()
        kept, w = ftrl(_Texts(rows.column("text").combine_chunks(), bits), rows.column("y").to_numpy(), bits, epochs, alpha, beta, l1, l2)
        return pa.table({"feature": pa.array(kept, pa.int64()), "weight": w})

    return run


def train(docs: DataFrame, labels: DataFrame, most: int = 20_000, most_bytes: int = 100 << 20, bits: int = BITS, epochs: int = 4, alpha: float = 2.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.0) -> dict[int, float]:
    """documents (doc_id, text) and labels (doc_id, toxic) -> the non-zero weights by feature.

    Learns from rows whose crc32(doc_id as text) mod 5 is not 0, about `most` labelled rows and `most_bytes` of text at the
    most, which is what one task holds: of more, a share by a hash of doc_id and text. A doc_id labelled more than once
    counts as toxic if any label says so; null labels and null doc_ids are left out; rows that repeat in doc_id and text
    are learnt from once. Without rows the model is empty and every score is a half."""
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    marked = stage(marked.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0), "labels")
    # First a share of the labelled ids, so that they can go to every task: of at most 4 * most, some 30 bytes each.
    some = _share(4 * most / max(1, marked.count()))
    chosen = F.broadcast(marked.where(F.pmod(F.xxhash64(F.lit(5), F.col("doc_id").cast("string")), F.lit(1 << 20)) < some))
    rows = docs.select("doc_id", text_of().alias("text")).join(chosen, "doc_id").withColumn("draw", F.xxhash64(F.lit(6), F.col("doc_id").cast("string"), "text"))
    held = rows.select("draw", F.octet_length("text").alias("size")).distinct().agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    share = _share(min(most / max(1, held["n"]), most_bytes / max(1, held["bytes"] or 0)))
    sample = rows.where(F.pmod("draw", F.lit(1 << 20)) < share).select(plain_words(F.col("text")).alias("text"), "y", "draw")
    once = sample.groupBy("draw").agg(F.any_value("text").alias("text"), F.any_value("y").alias("y"))
    learnt = once.groupBy().applyInArrow(_learn(bits, epochs, alpha, beta, l1, l2), "feature long, weight double")
    return {f: w for f, w in learnt.collect()}


def _share(part: float) -> int:
    """How many of 2**20 hash buckets make this part of the rows."""
    return round(min(1.0, part) * (1 << 20))


def score(docs: DataFrame, weights: dict[int, float], bits: int = BITS) -> DataFrame:
    """documents (doc_id, text, any others) -> doc (a struct of all its columns) and score, from 0 to 1.

    A null or empty text scores as the bias alone. Rows keep their number; other columns ride along in `doc`."""
    small_batches(docs.sparkSession)
    table = np.zeros((1 << bits) + 1)
    if weights:
        table[list(weights)] = list(weights.values())
    kept = np.flatnonzero(table)
    sent = docs.sparkSession.sparkContext.broadcast((kept.astype(np.int32), table[kept]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros((1 << bits) + 1)
        w[sent.value[0]] = sent.value[1]
        for batch in batches:
            for lo, hi, data, offsets in hashing.texts_of(batch.column(0)):
                doc, found = _features(data, offsets, bits)
                use = np.flatnonzero(w[found])
                once = np.unique((doc[use].astype(np.int64) << bits) | found[use])
                total = w[-1] + np.bincount(once >> bits, w[once & ((1 << bits) - 1)], minlength=hi - lo)
                own = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([own.column(1), pa.array(1 / (1 + np.exp(-np.clip(total, -700, 700))))], names=["doc", "score"])

    rows = docs.select(plain_words(text_of()).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, score double")


def drop_toxic(docs: DataFrame, weights: dict[int, float], threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold."""
    return score(docs, weights).where(F.col("score") < threshold).select("doc.*")
