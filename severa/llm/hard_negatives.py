"""Hard negatives by zone maps over blocks of candidates in the order of a Hilbert curve.

Rows are ordered by label and by their place on a Hilbert curve through the components that vary most, and cut into blocks.
A staged Parquet table has a row for each block: its vectors, packed, and its zone map, which is the least and the largest
value of every component and of the label. Zone maps are read without the vectors. By interval arithmetic a block's scores
with an anchor lie between two bounds, so a block is read only for anchors whose best rows or windows it may hold: its
upper bound must reach the score that blocks known to hold enough rows have at least. Nothing else leaves a block out, so
results are exact; where components vary freely the bounds are wide, and most blocks are read.

Blocks belong to parts, anchors to slices, and a task holds one of each; labels and vectors of many rows are many blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from severa.staging import drop_staged, stage

from .common import small_batches
from .vectors import MOST_PART, Best, grid, lists, one_per_id, part_count, products, scaled, usable

#: Rows of a block; axes of the curve and bits on each.
BLOCK, AXES, AXIS_BITS = 256, 8, 7
#: Below any score.
_LOW = -(1 << 62)
_BLOCKS = "part int, block int, n int, label_lo long, label_hi long, lo array<int>, hi array<int>, wide int, rows binary"
_ZONES = ("part", "block", "n", "label_lo", "label_hi", "lo", "hi")


def hilbert(places: np.ndarray, bits: int) -> np.ndarray:
    """Rows of coordinates below 2**bits -> their place on the Hilbert curve (Skilling's transposed form, interleaved)."""
    x = places.astype(np.uint64).T.copy()
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q, p = one << np.uint64(b), (one << np.uint64(b)) - one
        for i in range(len(x)):
            hit = (x[i] & q) != 0
            swap = np.where(hit, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(hit, p, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> np.uint64(b)) & one, (one << np.uint64(b)) - one, np.uint64(0))
    x ^= turn
    out = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for axis in x:
            out = (out << one) | ((axis >> np.uint64(b)) & one)
    return out.astype(np.int64)


def _moments(width: int):
    """n, sums and sums of squares of each component, for the rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, one, two = 0, np.zeros(width), np.zeros(width)
        for batch in batches:
            v = grid(batch.column(0), width)
            n, one, two = n + len(v), one + v.sum(0), two + np.square(v).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), lists(one[None], pa.float64()), lists(two[None], pa.float64())], names=["n", "one", "two"])

    return run


def _curve(axes: np.ndarray, low: np.ndarray, step: np.ndarray, width: int):
    """Rows (vec_id, label, embedding) -> integer components and the place on the curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = scaled(grid(batch.column(2), width))
            cell = np.clip((v[:, axes] - low) / step, 0, (1 << AXIS_BITS) - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(v, pa.int32()), pa.array(hilbert(cell, AXIS_BITS), pa.int64())], names=["vec_id", "label", "v", "key"])

    return run


def _pack(width: int):
    """Ordered rows of a partition (vec_id, label, v) -> blocks with their zone maps."""

    def block(part: int, at: int, ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> list:
        top = int(np.abs(v).max(initial=0))
        wide = 2 if top < 1 << 15 else 4
        packed = ids.astype("<i8").tobytes() + labels.astype("<i8").tobytes() + v.astype(f"<i{wide}").tobytes()
        return [part, at, len(ids), int(labels.min()), int(labels.max()), v.min(0), v.max(0), wide, packed]

    def batch_of(rows: list[list]) -> pa.RecordBatch:
        part, at, n, low, high, lo, hi, wide, packed = zip(*rows, strict=True)
        int32 = pa.int32()
        return pa.RecordBatch.from_arrays(
            [pa.array(part, int32), pa.array(at, int32), pa.array(n, int32), pa.array(low, pa.int64()), pa.array(high, pa.int64()), lists(np.array(lo), int32), lists(np.array(hi), int32), pa.array(wide, int32), pa.array(packed, pa.binary())],
            names=["part", "block", "n", "label_lo", "label_hi", "lo", "hi", "wide", "rows"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        rest = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, width), np.int64)]
        for batch in batches:
            new = batch.column(0).to_numpy(), batch.column(1).to_numpy(), grid(batch.column(2), width).astype(np.int64)
            rest = [np.concatenate(x) for x in zip(rest, new, strict=True)]
            whole = len(rest[0]) // BLOCK
            if whole:
                yield batch_of([block(part, at + i, *(x[i * BLOCK : (i + 1) * BLOCK] for x in rest)) for i in range(whole)])
                at, rest = at + whole, [x[whole * BLOCK :] for x in rest]
        if len(rest[0]):
            yield batch_of([block(part, at, *rest)])

    return run


def _unpacked(n: int, wide: int, rows: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = np.frombuffer(rows, "<i8", n), np.frombuffer(rows, "<i8", n, 8 * n)
    return ids, labels, np.frombuffer(rows, f"<i{wide}", n * width, 16 * n).reshape(n, width).astype(np.int64)


def _reached(lower: np.ndarray, n: np.ndarray, sure: np.ndarray, k: int) -> np.ndarray:
    """By asker, a score that k rows of the blocks reach at least: lower bounds (asker x block) of the blocks that are sure
    to hold n rows each that count."""
    lower = np.where(sure, lower, _LOW)
    order = np.argsort(-lower, 1)
    enough = np.where(np.take_along_axis(sure, order, 1), n[order], 0).cumsum(1) >= k
    at = np.take_along_axis(order, enough.argmax(1)[:, None], 1)
    return np.where(enough.any(1), np.take_along_axis(lower, at, 1)[:, 0], _LOW)


def _bounds(v: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest inner product of every row with anything between lo and hi."""
    up, down = np.maximum(v, 0), np.minimum(v, 0)
    return products(up, lo) + products(down, hi), products(up, hi) + products(down, lo)


def _windows(pairs: pa.ChunkedArray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positives of each anchor -> the anchor's place, and the least and the largest negative score of each positive."""
    column = pairs.combine_chunks()
    n = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    score = column.flatten().field("positive_score").to_numpy()
    return np.repeat(np.arange(len(n)), n), -(-low * score // 100), high * score // 100


def _needed(width: int, k: int, low: int | None = None, high: int | None = None):
    """A slice of anchors and a part's zone maps -> which anchors each block is read for."""

    def run(anchors: pa.Table, zones: pa.Table) -> pa.Table:
        out = pa.schema([("slice", pa.int32()), ("part", pa.int32()), ("block", pa.int32()), ("anchors", pa.binary())])
        if not len(anchors) or not len(zones):
            return out.empty_table()
        ids, label, v = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy(), grid(anchors.column("v"), width).astype(np.int64)
        lo, hi = (grid(zones.column(c), width).astype(np.int64) for c in ("lo", "hi"))
        first, last, n = (zones.column(c).to_numpy() for c in ("label_lo", "label_hi", "n"))
        hits: list[list[np.ndarray]] = [[] for _ in range(len(zones))]
        for a in range(0, len(ids), 2048):
            own = label[a : a + 2048, None]
            lower, upper = _bounds(v[a : a + 2048], lo, hi)
            holds, pure = (first <= own) & (own <= last), (first == own) & (own == last)
            if low is None:  # one row of a block may be the anchor itself
                need = holds & (upper >= _reached(lower, n - 1, pure & (n > 1), k)[:, None])
            else:
                need = np.zeros(upper.shape, bool)
                of, least, most = _windows(anchors.column("positives").slice(a, 2048), low, high)
                for r in range(0, len(of), 2048):  # rows are windows
                    at, lo_w, hi_w = of[r : r + 2048], least[r : r + 2048, None], most[r : r + 2048, None]
                    inside = ~holds[at] & (lower[at] >= lo_w) & (upper[at] <= hi_w)
                    reach = np.maximum(lo_w, _reached(lower[at], n, inside, k)[:, None])
                    np.logical_or.at(need, at, ~pure[at] & (lower[at] <= hi_w) & (upper[at] >= reach) & (lo_w <= hi_w))
            for b in np.flatnonzero(need.any(0)):
                hits[b].append(a + np.flatnonzero(need[:, b]))
        some = [b for b, x in enumerate(hits) if x]
        name = {c: t.column(c)[0].as_py() for c, t in (("slice", anchors), ("part", zones))}
        block = zones.column("block").to_numpy()
        return pa.table([[name["slice"]] * len(some), [name["part"]] * len(some), block[some], [ids[np.concatenate(hits[b])].astype("<i8").tobytes() for b in some]], schema=out)

    return run


def _found(width: int, k: int, low: int | None = None, high: int | None = None):
    """A slice of anchors and the blocks read for them -> the best rows of each anchor, or of each of its windows."""

    def run(anchors: pa.Table, blocks: pa.Table) -> pa.Table:
        names = ["anchor_id", "positive_id", "vec_id", "score"]
        if not len(anchors) or not len(blocks):
            return pa.table([pa.array([], pa.int64())] * 4, names=names)
        order = np.argsort(anchors.column("vec_id").to_numpy())
        anchors = anchors.take(order)
        ids, label, v = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy(), grid(anchors.column("v"), width).astype(np.int64)
        if low is None:
            of, least, most = np.arange(len(ids)), None, None
        else:
            of, least, most = _windows(anchors.column("positives"), low, high)
            begin = np.searchsorted(of, np.arange(len(ids) + 1))
        best = Best(len(of), k, _LOW)
        for i in range(len(blocks)):
            n, wide, packed, readers = (blocks.column(c)[i].as_py() for c in ("n", "wide", "rows", "anchors"))
            own, labels, rows = _unpacked(n, wide, packed, width)
            readers = np.searchsorted(ids, np.frombuffer(readers, "<i8"))
            for a in range(0, len(readers), 4096):
                at = readers[a : a + 4096]
                score = products(v[at], rows)
                same = label[at][:, None] == labels
                if low is None:
                    asker, line = at, np.arange(len(at))
                    fits = same & (ids[at][:, None] != own)
                else:
                    count = begin[at + 1] - begin[at]
                    line = np.repeat(np.arange(len(at)), count)
                    asker = np.repeat(begin[at], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    score = score[line]
                    fits = ~same[line] & (score >= least[asker][:, None]) & (score <= most[asker][:, None])
                q, c = np.nonzero(fits & (score >= best.least[asker][:, None]))
                best.add(asker[q], score[q, c], own[c], c)
        asker, score, found, _ = best.trim()
        positive = np.zeros(len(of), np.int64) if low is None else anchors.column("positives").combine_chunks().flatten().field("positive_id").to_numpy()
        return pa.table([ids[of[asker]], positive[asker], found, score], names=names)

    return run


_FOUND = "anchor_id long, positive_id long, vec_id long, score long"


def _search(anchors: DataFrame, blocks: DataFrame, parts: int, slices: int, width: int, k: int, *window: int) -> DataFrame:
    """The k best of every anchor, or of each of its windows, over the blocks that their bounds choose."""
    every = lambda n, c: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(c)
    asking = anchors.select("*", every(parts, "part"))
    zones = blocks.select(*_ZONES, every(slices, "slice"))
    keys = ["slice", "part"]
    need = asking.groupBy(*keys).cogroup(zones.groupBy(*keys)).applyInArrow(_needed(width, k, *window), "slice int, part int, block int, anchors binary")
    read = need.join(blocks.select("part", "block", "n", "wide", "rows"), ["part", "block"])
    found = asking.groupBy(*keys).cogroup(read.groupBy(*keys)).applyInArrow(_found(width, k, *window), _FOUND)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(vectors: DataFrame, asked: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, most_anchors: int = MOST_PART) -> DataFrame:
    """vectors (vec_id, label, embedding, any others) -> anchor_id, positive_id, rank (from 1), negative_id, positive_score,
    negative_score. Asked rows are anchors; components become floor(256 * x) and a score is their inner product. An
    anchor's positives are the best other rows of its label; of each, the best rows of other labels are returned whose
    score is from `low` to `high` percent of the positive's. Larger scores come first, then smaller vec_ids.

    Null labels and vec_ids, null vectors and those with a null or non-finite component take no part; of rows that share a
    vec_id the one with the smallest label, then vector, stands for all. A shorter vector counts as ending in zeros. An
    anchor without positives, and a positive without negatives in its window (any of a score below 0), gives no rows, nor does
    an empty table. Labels are integers. Components beyond 65,536 are an error. Other columns are not read."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.where(F.col("label").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding", F.coalesce(asked, F.lit(False)).alias("asked"))
    rows = one_per_id(rows, "vec_id", "label", "embedding", "asked")
    size = rows.agg(F.count("*").alias("n"), F.count_if("asked").alias("asked"), F.max(F.size("embedding")).alias("width")).first()
    if not size["asked"]:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    width = max(1, size["width"])
    sums = rows.select("embedding").mapInArrow(_moments(width), "n long, one array<double>, two array<double>")
    total = sums.agg(*[F.sum(F.col("one")[i]).alias(f"a{i}") for i in range(width)], *[F.sum(F.col("two")[i]).alias(f"b{i}") for i in range(width)]).first()
    mean = np.array([total[f"a{i}"] for i in range(width)]) / size["n"]
    spread = np.sqrt(np.maximum(0.0, np.array([total[f"b{i}"] for i in range(width)]) / size["n"] - mean**2))
    axes = np.argsort(-spread, kind="stable")[:AXES]
    low_edge, step = 256 * (mean - 3 * spread)[axes], np.maximum(1e-9, 256 * 6 * spread[axes] / (1 << AXIS_BITS))
    kind = rows.schema["embedding"].dataType.simpleString()
    placed = lambda of: of.select("vec_id", "label", "embedding").mapInArrow(_curve(axes, low_edge, step, width), "vec_id long, label long, v array<int>, key long")
    parts, slices = part_count(size["n"]), max(1, -(-size["asked"] // most_anchors))
    along = ("label", "key", "vec_id")
    ordered = placed(rows).repartitionByRange(parts, *along).sortWithinPartitions(*along)
    blocks = stage(ordered.select("vec_id", "label", "v").mapInArrow(_pack(width), _BLOCKS), "blocks")
    anchors = placed(rows.where("asked")).repartitionByRange(slices, *along).select(F.spark_partition_id().alias("slice"), "vec_id", "label", "v")
    anchors = stage(anchors, "anchors")
    best = _search(anchors, blocks, parts, slices, width, positives)
    pair = F.struct(F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    pairs = best.groupBy("anchor_id").agg(F.sort_array(F.collect_list(pair)).alias("positives"))
    asking = stage(anchors.join(pairs.withColumnRenamed("anchor_id", "vec_id"), "vec_id").select("slice", "vec_id", "label", "v", "positives"), "anchors")
    drop_staged(anchors)
    mined = _search(asking, blocks, parts, slices, width, negatives, low, high)
    told = asking.select(F.col("vec_id").alias("anchor_id"), F.explode("positives").alias("p")).select("anchor_id", "p.*")
    return mined.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(told, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
