"""Global row numbers and equal-frequency bins without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from severa.staging import stage


#: Bits of `monotonically_increasing_id` that number the rows of a partition.
_INSIDE = 33


def row_numbers(rows: DataFrame, order: list[Column], name: str = "row_number", leave_out: tuple[str, ...] = ()) -> DataFrame:
    """Adds the row's number in the order, and drops the columns left out. Rows are dealt out by ranges of it, and numbered
    where they were sorted, so that they are shuffled once; the counts of the ranges before, a row each, make up the rest.
    The ranges are staged, so a lost task can't redraw them."""
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = stage(sorted_.withColumn("_at", F.monotonically_increasing_id()).drop(*leave_out), "ranges")
    ranged = ranged.withColumns({"_range": F.shiftright("_at", _INSIDE), "_at": F.col("_at").bitwiseAND((1 << _INSIDE) - 1) + 1})
    sizes = ranged.groupBy("_range").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("_range", before.alias("_before")))
    return ranged.join(offsets, "_range").withColumn(name, F.col("_before") + F.col("_at")).drop(*{"_range", "_before", "_at"} - {name})


def running_sums(rows: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Adds, for each name, the sum of its column over the rows up to this one in the order, which has no ties. Rows are
    dealt out by ranges of it, as in `row_numbers`."""
    ranged = stage(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    offsets = F.broadcast(whole.select("_range", *[F.coalesce(F.sum(f"_{n}").over(upto), F.lit(0)).alias(f"_{n}") for n in sums]))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(offsets, "_range").withColumns({n: F.col(f"_{n}") + F.sum(c).over(inside) for n, c in sums.items()}).drop("_range", *[f"_{n}" for n in sums])


def equal_bins(rows: DataFrame, order: list[Column], bins: int, name: str = "bin") -> DataFrame:
    """Adds the bin, from 1, of equally many rows in the order; the first bins take one of the rows left over each."""
    numbered = row_numbers(rows, order, "_i")
    n = numbered.count()
    size, extra = divmod(n, bins)
    i = F.col("_i") - 1
    wide = F.floor(i / (size + 1)) + 1
    rest = F.floor((i - extra * (size + 1)) / max(1, size)) + extra + 1
    return numbered.withColumn(name, F.when(i < extra * (size + 1), wide).otherwise(rest).cast("int")).drop("_i")
