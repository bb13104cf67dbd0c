"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled by the largest norm and get one more component that makes their length 1, and queries get length 1 and a
zero there, so that the largest inner product is the smallest Euclidean distance. Every table hashes with M Gaussian
projections, cut into slots of one width; the slots together name a bucket. A neighbour of a query is taken to lie normally
about the query's own projections, which gives every bucket an estimated success; buckets are visited in that order down to
a least success. That least success is learnt on a bounded sample of queries whose neighbours are found by brute force, so
that the share of them in visited buckets of some table reaches the target; all vectors are indexed and nothing else is
sampled. A query whose neighbours are hardly nearer than anything else needs most of the buckets, and gets them.

Buckets are dealt into parts of many buckets, a bucket of more vectors than a part holds into several parts, and a part
meets slices of the queries. A task so holds a part and a slice, whatever bucket is hot, and works on whole matrices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches
from .vectors import MOST_PART, Best, grid, one_per_id, part_count, usable

#: Queries whose true neighbours are looked up to learn the least success.
SAMPLE_QUERIES = 256
#: Share of the sample's neighbours that must lie in visited buckets. A little over what is asked of all queries.
TARGET = 0.95
#: A slot is four bits of a bucket's name; a slot's width is in standard deviations of a projection.
SLOT_BITS, SLOT_WIDTH = 4, 2.0
HALF = 1 << (SLOT_BITS - 1)
#: Vectors that a bucket would hold if projections were spread evenly. A projection tells some 1.6 bits.
BUCKET, BITS = 64, 1.6
#: Products are cut at this place to order candidates; the scores returned are summed in one order for all.
DIGITS, SPARE = 11, 12


@dataclass(frozen=True)
class Hashes:
    """The hash functions of all tables, the scale of vectors, and what the sample has taught."""

    width: int
    scale: float
    projections: np.ndarray  # table, component (one more than width), hash
    offsets: np.ndarray  # table, hash
    nearness: float = 1.0
    least: float = -np.inf

    @classmethod
    def drawn(cls, n: int, width: int, scale: float, tables: int, seed: int) -> Hashes:
        rng, m = np.random.default_rng(seed), int(min(15, max(2, round(log2(max(2, n / BUCKET)) / BITS))))
        return cls(width, scale, rng.standard_normal((tables, width + 1, m)), rng.uniform(0, SLOT_WIDTH, (tables, m)))

    def placed(self, v: np.ndarray) -> np.ndarray:
        """Candidates on the unit sphere."""
        v = v / self.scale
        return np.column_stack([v, np.sqrt(np.maximum(0.0, 1.0 - np.square(v).sum(1)))])

    def asked(self, v: np.ndarray) -> np.ndarray:
        """Queries on the unit sphere."""
        peak = np.abs(v).max(1, keepdims=True)
        v = v / peak
        return np.column_stack([v / np.sqrt(np.square(v).sum(1))[:, None], np.zeros(len(v))])

    def buckets(self, placed: np.ndarray, table: int) -> np.ndarray:
        slots = np.floor((placed @ self.projections[table] + self.offsets[table]) / SLOT_WIDTH)
        slots = (np.clip(slots, -HALF, HALF - 1) + HALF).astype(np.int64)
        return (slots << (SLOT_BITS * np.arange(slots.shape[1]))).sum(1)

    def success(self, asked: np.ndarray, buckets: np.ndarray, table: int) -> np.ndarray:
        """Logarithm of the estimated chance that a neighbour of each query lies in each bucket."""
        spread = max(1e-3, np.sqrt(1.0 - self.nearness**2))
        at = (asked @ self.projections[table]) * self.nearness + self.offsets[table]
        edges = np.concatenate([[-np.inf], np.arange(1 - HALF, HALF) * SLOT_WIDTH, [np.inf]])
        out = np.zeros((len(asked), len(buckets)))
        for i in range(at.shape[1]):
            chance = np.log(np.maximum(np.diff(_normal((edges - at[:, i : i + 1]) / spread), axis=1), 1e-12))
            out += chance[:, (buckets >> (SLOT_BITS * i)) & (2 * HALF - 1)]
        return out


def _normal(z: np.ndarray) -> np.ndarray:
    """The normal distribution function, to 1e-7 or so: a polynomial of Abramowitz and Stegun (26.2.17)."""
    t = 1.0 / (1.0 + 0.2316419 * np.abs(z))
    tail = np.exp(-np.square(z) / 2) * 0.3989422804014327 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(z >= 0, 1.0 - tail, tail)


def _exactly(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, equal rows giving equal sums."""
    return (a * b).sum(1)


def _add(best: Best, askers: np.ndarray, score: np.ndarray, ids: np.ndarray, first: int) -> None:
    """Scores (askers x ids) to what is kept; first: the place of ids[0]."""
    score = np.round(score, DIGITS)
    if score.shape[1] > best.k:
        kth = np.partition(score, -best.k, 1)[:, -best.k]
        best.least[askers] = np.maximum(best.least[askers], kth)
    q, c = np.nonzero((score >= best.least[askers][:, None]) & (score > -np.inf))
    best.add(askers[q], score[q, c], ids[c], first + c)


def _brute_force(ids: np.ndarray, queries: np.ndarray, hashes: Hashes, k: int):
    """Every vector of a task against the sample's queries -> the k best of each, their scores and buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held, own = Best(len(ids), k, -np.inf), [], 0
        for batch in batches:
            of, v = batch.column(0).to_numpy(), grid(batch.column(1), hashes.width)
            score = queries @ v.T
            score[ids[:, None] == of] = -np.inf
            _add(best, np.arange(len(ids)), score, of, own)
            held.append(v)
            own += len(v)
            if own > 1 << 15:
                asker, score, of, place = best.trim()
                kept, inverse = np.unique(place, return_inverse=True)
                held, own = [np.concatenate(held)[kept]], len(kept)
                best.found = [(asker, score, of, inverse)]
        asker, score, of, place = best.trim()
        if len(asker):
            placed = hashes.placed(np.concatenate(held)[place])
            names = np.column_stack([hashes.buckets(placed, t) for t in range(len(hashes.projections))])
            lists = pa.FixedSizeListArray.from_arrays(pa.array(names.reshape(-1), pa.int64()), names.shape[1]).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(asker, pa.int32()), pa.array(of, pa.int64()), pa.array(score, pa.float64()), lists], names=["asker", "id", "score", "buckets"])

    return run


def _learn(rows: DataFrame, hashes: Hashes, k: int, sample: int, target: float, seed: int) -> Hashes:
    """What the true neighbours of the sample's queries teach: how near they are, and the least success to visit."""
    some = rows.where("asked").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).select("id", "v").toArrow()
    ids, queries = some.column("id").to_numpy(), grid(some.column("v"), hashes.width)
    near = rows.select("id", "v").mapInArrow(_brute_force(ids, queries, hashes, k), "asker int, id long, score double, buckets array<long>")
    rank = F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("score"), "id"))
    near = near.withColumn("rank", rank).where(F.col("rank") <= k).select("asker", "score", "buckets").toArrow()
    if not len(near):
        return hashes
    asker = near.column("asker").to_numpy()
    cosine = near.column("score").to_numpy() / hashes.scale / np.sqrt(np.square(queries).sum(1))[asker]
    taught = Hashes(hashes.width, hashes.scale, hashes.projections, hashes.offsets, float(np.clip(np.median(cosine), 0.0, 1.0)))
    asked, names = taught.asked(queries)[asker], grid(near.column("buckets"), len(hashes.projections)).astype(np.int64)
    top = np.full(len(asker), -np.inf)
    for table in range(names.shape[1]):
        for lo in range(0, len(asker), 512):  # the diagonal of a block
            own = taught.success(asked[lo : lo + 512], names[lo : lo + 512, table], table)
            top[lo : lo + 512] = np.maximum(top[lo : lo + 512], own.diagonal())
    least = np.sort(top)[::-1][min(len(top), int(np.ceil(target * len(top)))) - 1]
    return Hashes(taught.width, taught.scale, taught.projections, taught.offsets, taught.nearness, float(least) - 1e-9)


def _names(hashes: Hashes):
    """Rows (id, v) -> a row for each table with the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            placed = hashes.placed(grid(batch.column(1), hashes.width))
            for table in range(len(hashes.projections)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), table), pa.int32()), pa.array(hashes.buckets(placed, table), pa.int64()), *batch.columns], names=["table", "bucket", "id", "v"])

    return run


def _search(hashes: Hashes, k: int, run_of: int = 1024):
    """A slice of queries (id, v) and a part (table, bucket, id, v) -> the k best of each query in the buckets it visits."""

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not len(left) or not len(right):
            return out.empty_table()
        queries, qids = grid(left.column("v"), hashes.width), left.column("id").to_numpy()
        bucket, ids = right.column("bucket").to_numpy(), right.column("id").to_numpy()
        v, table = grid(right.column("v"), hashes.width), int(right.column("table")[0].as_py())
        order = np.lexsort((ids, bucket))
        bucket, ids, v = bucket[order], ids[order], v[order]
        names, first, n = np.unique(bucket, return_index=True, return_counts=True)
        asked, best = hashes.asked(queries), Best(len(qids), k + SPARE, -np.inf)
        at = 0
        while at < len(names):  # runs of buckets with some 1,024 vectors; a bucket's own may be more
            to = max(at + 1, int(np.searchsorted(first, first[at] + run_of)))
            lo, hi = first[at], first[to - 1] + n[to - 1]
            for q in range(0, len(qids), 4096):
                visit = hashes.success(asked[q : q + 4096], names[at:to], table) >= hashes.least
                some = np.flatnonzero(visit.any(1))
                for a in range(lo, hi, 4 * run_of) if len(some) else ():
                    b = min(hi, a + 4 * run_of)
                    score = queries[q + some] @ v[a:b].T
                    score[~visit[some][:, np.searchsorted(names[at:to], bucket[a:b])]] = -np.inf
                    score[qids[q + some][:, None] == ids[a:b]] = -np.inf
                    _add(best, q + some, score, ids[a:b], a)
            at = to
        asker, _, found, place = best.trim()
        score = _exactly(queries[asker], v[place])
        order = np.lexsort((found, -score, asker))
        order = order[np.arange(len(order)) - np.searchsorted(asker[order], asker[order]) < k]
        return pa.table([qids[asker[order]], found[order], score[order]], schema=out)

    return search


def nearest(vectors: DataFrame, asked: Column, k: int = 20, tables: int = 2, sample: int = SAMPLE_QUERIES, target: float = TARGET, most_queries: int = MOST_PART, seed: int = 1) -> DataFrame:
    """vectors (vec_id, embedding, any others) -> query_id, rank (from 1), vec_id, score: the k rows found with the largest
    inner product to each asked row, in doubles, nearest first, ties to the smaller vec_id.

    A query's own row is no candidate; with fewer candidates all that are found are returned, and with at most k all are.
    Null vectors, zero ones and those with a null or non-finite component take no part, nor do rows without a vec_id; of
    rows that share a vec_id the one with the smallest vector stands for all. A shorter vector counts as ending in zeros.
    An empty table, or one without asked rows, gives no rows. Other columns are not read."""
    spark = vectors.sparkSession
    small_batches(spark)
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = vectors.where(usable(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)).select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v"), F.coalesce(asked, F.lit(False)).alias("asked"))
    rows = one_per_id(rows, "id", "v", "asked")
    size = rows.agg(F.count("*").alias("n"), F.count_if("asked").alias("asked"), F.max(F.size("v")).alias("width"), F.sqrt(F.max(length)).alias("scale")).first()
    out = "query_id long, vec_id long, score double"
    if not size["asked"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    hashes = Hashes.drawn(size["n"], size["width"], size["scale"], tables, seed)
    if size["n"] > k + 1:
        hashes = _learn(rows, hashes, k, sample, target, seed)
    parts, slices = part_count(size["n"]), max(1, -(-size["asked"] // most_queries))
    named = rows.select("id", "v").mapInArrow(_names(hashes), f"table int, bucket long, id long, v {rows.schema['v'].dataType.simpleString()}")
    # Buckets of more vectors than a part: at most as many as there are parts in each table.
    hot = named.groupBy("table", "bucket").agg(F.count("*").alias("n")).withColumn("pieces", F.ceil(F.col("n") * parts / F.lit(size["n"])).cast("int")).where("pieces > 1").select("table", "bucket", "pieces")
    piece = F.pmod(F.xxhash64("id"), F.coalesce("pieces", F.lit(1)))
    every = lambda n, c: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(c)
    index = named.join(F.broadcast(hot), ["table", "bucket"], "left").select("table", F.pmod(F.xxhash64("bucket") + piece, F.lit(parts)).cast("int").alias("part"), "bucket", "id", "v")
    index = index.select("*", every(slices, "slice"))
    queries = rows.where("asked").select(F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int").alias("slice"), "id", "v")
    queries = queries.select("*", every(tables, "table")).select("*", every(parts, "part"))
    keys = ["table", "part", "slice"]
    found = queries.groupBy(*keys).cogroup(index.groupBy(*keys)).applyInArrow(_search(hashes, k), out)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
