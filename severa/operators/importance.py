"""What features are worth to a score, by dealing their values anew, and whether one model may replace another."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from severa.operators.models import poisson_draws
from severa.operators.ranking import row_numbers, running_sums
from severa.staging import stage


def precision_within(rows: DataFrame, keys: list[str], score: str, label: str, weight: str | None = None) -> DataFrame:
    """keys, average_precision: the step integral of precision over recall at each key's distinct scores; null where no row
    has the label. Weights are whole numbers. The sums run over all keys in one order, dealt out by ranges of it, and a
    key's start is taken off: no task holds a key's rows. Null scores come last; rows with a null label or key take no part."""
    w = F.lit(1) if weight is None else F.col(weight)
    cells = rows.dropna(subset=[label, *keys]).groupBy(*keys, F.col(score).alias("s")).agg(F.sum(w * F.col(label)).cast("long").alias("p"), F.sum(w).cast("long").alias("n")).where("n > 0")
    order = [*map(F.asc, keys), F.desc_nulls_last("s")]
    curve = running_sums(cells, order, {"tp": "p", "k": "n"})
    totals = curve.groupBy(*keys).agg(F.sum("p").alias("pos"), (F.max("k") - F.sum("n")).alias("k0"), (F.max("tp") - F.sum("p")).alias("tp0"))
    joined = curve.join(totals, keys)
    precision = (F.col("tp") - F.col("tp0")) / (F.col("k") - F.col("k0"))
    return joined.groupBy(*keys).agg(F.sum(F.col("p") / F.nullif("pos", F.lit(0)) * precision).alias("average_precision"))


def dealt(rows: DataFrame, key: str, columns: tuple[str, ...], repeats: int, seed: int = 0) -> DataFrame:
    """rows with a unique key -> a row for each repeat, with `dealt`: the columns of the row whose values it gets. Rows are
    numbered in the order of two seeded digests, and the number in one is joined to that in the other, which is a
    permutation; all repeats are numbered at once, as each takes as many numbers. Digests are sorted and sent as 16 bytes,
    whose order is that of their text, and rows are staged before they are repeated."""
    each = stage(rows.select(key, F.struct(*columns).alias("dealt")), "repeats").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    text = F.col(key).cast("string")
    digest = lambda i: F.unhex(F.md5(F.concat_ws("|", F.lit(2 * seed + i), F.col("repeat"), text)))
    takers = row_numbers(each.select(key, "repeat", digest(0).alias("_h")), [F.col("repeat"), F.col("_h"), F.col(key)], "_at", ("_h",))
    givers = row_numbers(each.select(key, "dealt", "repeat", digest(1).alias("_h")), [F.col("repeat"), F.col("_h"), F.col(key)], "_at", (key, "repeat", "_h"))
    return rows.join(takers.join(givers, "_at").drop("_at"), key)


def permutation_importance(rows: DataFrame, score: Callable[[DataFrame], DataFrame], key: str, features: tuple[str, ...], label: str, repeats: int = 5, seed: int = 0) -> DataFrame:
    """feature, mean, std: how much average precision falls when the feature's values are dealt anew among the rows, over
    the repeats. `score` adds a column score to rows with the features, each row by itself. The key is unique; columns
    named dealt, repeat or feature are dropped."""
    rows = rows.drop("dealt", "repeat", "feature")
    whole = precision_within(score(rows).withColumn("all", F.lit(0)), ["all"], "score", label).select(F.col("average_precision").alias("whole"))
    one = dealt(rows, key, features, repeats, seed).withColumn("feature", F.explode(F.array(*map(F.lit, features))))
    changed = one.withColumns({f: F.when(F.col("feature") == f, F.col("dealt")[f]).otherwise(F.col(f)) for f in features}).drop("dealt")
    scored = score(changed)
    lost = precision_within(scored, ["feature", "repeat"], "score", label).join(F.broadcast(whole))
    fall = F.col("whole") - F.col("average_precision")
    return lost.groupBy("feature").agg(F.avg(fall).alias("mean"), F.stddev_pop(fall).alias("std"))


#: Cells of a range of scores; one task takes all replicates of a range.
RANGE = 100_000


def _by_score(cells: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, labelled and all rows of cells, the highest score first and null ones last, and where each score begins."""
    h, p, n = (cells.column(c).to_numpy() for c in ("h", "p", "n"))
    null, s = cells.column("s").is_null().to_numpy(), cells.column("s").fill_null(0.0).to_numpy()
    level = np.where(null, 2, np.where(np.isnan(s), 0, 1))  # Spark's order: what is no number lies over all numbers
    down = np.where(level == 1, -s, 0.0)
    order = np.lexsort((down, level))
    level, down = level[order], down[order]
    begins = np.flatnonzero(np.concatenate([[True], (level[1:] != level[:-1]) | (down[1:] != down[:-1])]))
    return h[order], p[order], n[order], begins


def _weight(h: np.ndarray, replicate: int) -> np.ndarray:
    return poisson_draws(h, replicate) if replicate else np.ones(len(h), np.int64)


def _range_sums(replicates: int):
    def run(cells: pa.Table) -> pa.Table:
        """Cells of a range -> labelled and all rows of it in every replicate."""
        h, p, n = (cells.column(c).to_numpy() for c in ("h", "p", "n"))
        drawn = [(w @ p, w @ n) for w in (_weight(h, i) for i in range(replicates + 1))]
        key = {c: pa.repeat(cells.column(c)[0], len(drawn)) for c in ("sign", "range")}
        return pa.table({**key, "replicate": pa.array(range(len(drawn)), pa.int32()), "p": [x for x, _ in drawn], "n": [x for _, x in drawn]})

    return run


def _range_precision(cells: pa.Table, before: pa.Table) -> pa.Table:
    """Cells of a range and the sums of those over it (replicate, tp0, k0) -> what the range adds to the precision times all
    labelled rows: in whole parts of 2**-20 and, of what is left, 2**-52, whose sums are exact in any order."""
    h, p, n, begins = _by_score(cells)
    out = []
    for r in before.to_pylist():
        w = _weight(h, r["replicate"])
        own_p, own_n = np.add.reduceat(w * p, begins), np.add.reduceat(w * n, begins)
        tp, k = r["tp0"] + np.cumsum(own_p), r["k0"] + np.cumsum(own_n)
        added = own_p * (tp / np.maximum(k, 1)) * 2.0**20
        high = np.floor(added)
        low = np.floor((added - high) * 2.0**32)
        out.append((r["replicate"], int(high.astype(np.int64).sum()), int(low.astype(np.int64).sum())))
    sign, replicate = pa.repeat(cells.column("sign")[0], len(out)), pa.array([x[0] for x in out], pa.int32())
    return pa.table({"sign": sign, "replicate": replicate, "high": [x[1] for x in out], "low": [x[2] for x in out]})


def precision_gain(rows: DataFrame, key: str, new: str, old: str, label: str, replicates: int = 200) -> DataFrame:
    """One row: gain in average precision of the score `new` over `old`, with a 95 % interval by drawing keys (companies), as
    in `clustered_bootstrap`; replicates without a labelled row give no draw.

    No row is copied for a replicate: cells (score, key) are dealt out by ranges of the score, and each range's sums in all
    replicates, of which there are few, begin the next one's. Cells of one score are one task's. Equal scores have equal
    precision to the last bit, so that a tie is one."""
    sides = F.explode(F.array(F.struct(F.lit(1).alias("sign"), F.col(new).cast("double").alias("s")), F.struct(F.lit(-1).alias("sign"), F.col(old).cast("double").alias("s"))))
    both = rows.dropna(subset=[label]).select(F.xxhash64(F.col(key).cast("string")).alias("h"), F.col(label).cast("long").alias("y"), sides.alias("x"))
    cells = stage(both.groupBy("x.sign", "x.s", "h").agg(F.sum("y").alias("p"), F.count("*").alias("n")), "cells")
    ranges = cells.count() // RANGE + 1
    ranged = cells.repartitionByRange(ranges, "sign", F.desc_nulls_last("s")).withColumn("range", F.spark_partition_id())
    ranged = stage(ranged, "ranges")
    by = ["sign", "range"]
    sums = stage(ranged.groupBy(*by).applyInArrow(_range_sums(replicates), "sign int, range int, replicate int, p long, n long"), "sums")
    upto = Window.partitionBy("sign", "replicate").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*by, "replicate", *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f) for c, f in (("p", "tp0"), ("n", "k0"))])
    parts = ranged.groupBy(*by).cogroup(before.groupBy(*by)).applyInArrow(_range_precision, "sign int, replicate int, high long, low long")
    added = parts.groupBy("sign", "replicate").agg(((F.sum("high") + F.sum("low") / 2.0**32) / 2.0**20).alias("added"))
    labelled = sums.groupBy("sign", "replicate").agg(F.nullif(F.sum("p"), F.lit(0)).alias("pos"))
    gains = added.join(labelled, ["sign", "replicate"]).groupBy("replicate").agg(F.sum(F.col("sign") * F.col("added") / F.col("pos")).alias("gain"))
    draw = F.when(F.col("replicate") > 0, F.col("gain"))
    return gains.agg(F.max(F.when(F.col("replicate") == 0, F.col("gain"))).alias("gain"), F.percentile(draw, 0.025).alias("low"), F.percentile(draw, 0.975).alias("high"))


def choose(gains: DataFrame, new: str, old: str) -> DataFrame:
    """gains (low, any others) with the choice: the new model only if the whole interval lies over 0 in every row. So the
    simpler one wins ties, and an odd year can't decide alone where one of the rows leaves it out."""
    least = gains.agg(F.min(F.coalesce("low", F.lit(0.0))).alias("_least"))
    return gains.join(F.broadcast(least)).withColumn("chosen", F.when(F.col("_least") > 0, new).otherwise(old)).drop("_least")
