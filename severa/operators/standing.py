"""Standing queries: subscriptions with marks or filters against new rows, by sorting and equi-joins."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from severa.operators.ranking import running_sums

_LOWEST = -(1 << 62)


def since_marks(subscriptions: DataFrame, rows: DataFrame, at: str) -> DataFrame:
    """subscriptions (sub_id, seen) and new rows with their moment -> sub_id, fresh (rows after its mark) and next_seen (the
    last moment if any is after the mark, else null). A null mark has nothing after it, and a null moment is after none.

    Moments with their counts and the distinct marks are sorted together, from the last to the first; the sum of counts up
    to a mark is what is fresh. So a mark costs a row, whatever is new, and all marks may differ."""
    times = rows.where(F.col(at).isNotNull()).groupBy(F.col(at).alias("t")).agg(F.count("*").alias("n"))
    last = times.agg(F.max("t")).first()[0]
    marks = subscriptions.where("seen is not null").select(F.col("seen").alias("t")).distinct().select("t", F.lit(0).cast("long").alias("n"), F.lit(1).alias("mark"))
    both = times.select("t", "n", F.lit(0).alias("mark")).union(marks)
    # A mark comes before the moment equal to it, which it has seen.
    found = running_sums(both, [F.desc("t"), F.desc("mark")], {"fresh": "n"}).where("mark = 1").select(F.col("t").alias("seen"), "fresh")
    kind = rows.schema[at].dataType
    fresh = F.coalesce("fresh", F.lit(0))
    return subscriptions.join(found, "seen", "left").select("sub_id", fresh.alias("fresh"), F.when(fresh > 0, F.lit(last).cast(kind)).alias("next_seen"))


def filter_matches(subscriptions: DataFrame, rows: DataFrame, equal: dict[str, str], least: tuple[str, str], latest: str) -> DataFrame:
    """subscriptions (sub_id and filters) and rows -> sub_id, matches, latest, of subscriptions that match any row. equal
    names the row's column that each filter must equal, and `least` a filter and the column that must reach it; a null
    filter matches all, also null values.

    Rows are counted by what filters see, and each such count goes to every way of leaving filters open, 2 to the number of
    equal filters; what is left is an equi-join. Inside a way and its values, counts and the distinct thresholds are sorted
    by value and summed from the top, so a subscription costs a row and no filter meets rows that it doesn't match. A task
    holds the distinct values of one way."""
    low, value = least
    cells = rows.groupBy(*[F.col(c).alias(f) for f, c in equal.items()], F.coalesce(F.col(value).cast("long"), F.lit(_LOWEST)).alias("_v")).agg(F.count("*").alias("_n"), F.max(latest).alias("_latest"))
    open_ = lambda left: F.struct(F.lit("".join("01"[u] for u in left)).alias("_way"), *[F.when(F.lit(use), F.col(f)).alias(f) for use, f in zip(left, equal, strict=True)])
    ways = F.array(*[open_(left) for left in product((False, True), repeat=len(equal))])
    spread = cells.select(F.explode(ways).alias("_w"), "_v", "_n", "_latest")
    # A row whose column is null matches no filter that asks for a value.
    spread = spread.where(" and ".join(f"(substr(_w._way, {i + 1}, 1) = '0' or _w.{f} is not null)" for i, f in enumerate(equal)))
    keys = ["_way", *equal]
    spread = spread.groupBy(*[F.col(f"_w.{k}").alias(k) for k in keys], "_v").agg(F.sum("_n").alias("_n"), F.max("_latest").alias("_latest"))
    way = F.concat(*[F.when(F.col(f).isNull(), "0").otherwise("1") for f in equal])
    subs = subscriptions.select("sub_id", way.alias("_way"), *equal, F.coalesce(F.col(low).cast("long"), F.lit(_LOWEST)).alias("_v"))
    marks = subs.select(*keys, "_v").distinct().select("*", F.lit(0).cast("long").alias("_n"), F.lit(None).cast(rows.schema[latest].dataType).alias("_latest"), F.lit(1).alias("_mark"))
    both = spread.select(*keys, "_v", "_n", "_latest", F.lit(0).alias("_mark")).union(marks)
    down = Window.partitionBy(*keys).orderBy(F.desc("_v"), "_mark").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("matches", F.sum("_n").over(down)).withColumn("latest", F.max("_latest").over(down)).where("_mark = 1 and matches > 0").alias("m")
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"m.{c}")) for c in (*keys, "_v")]
    return subs.alias("s").join(met, same).select("sub_id", "matches", "latest")
