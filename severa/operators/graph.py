"""Connected components and roots of merge chains, as rounds of joins over staged edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from severa.staging import drop_staged, stage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Undirected edges (a, b) -> (node, root), root being the smallest node of its component.

    Alternating large-star and small-star steps: every round each node points its larger neighbours, then its smaller
    ones, at the smallest; edges only get fewer. Rounds end when a round changes nothing. Nulls and loops are dropped;
    nodes without an edge to another node are not returned. Minima are staged before they are joined, so that both sides of
    a join are plain exchanges, of which Spark splits the part with a hub's many edges."""
    pair = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    now = stage(pair.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    seen = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if mark == seen or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        seen = mark
        both = now.union(now.select("b", "a"))
        least = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "components")
        large = stage(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")), "components")
        minima = stage(large.groupBy("a").agg(F.min("b").alias("m")), "components")
        small = large.join(minima, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b")
        new = stage(small.distinct(), "components")
        drop_staged(now, least, large, minima)
        now = new
