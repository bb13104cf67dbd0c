"""URL filters: dated list entries become validity intervals; an as-of join finds those active when a URL was fetched.

In DataFrame functions only. A URL is looked up by every suffix of its host and every directory prefix of its path, so
the join has an equality on the pattern, and the interval bounds it in time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from severa.staging import stage

#: Intervals are broadcast up to so many rows (about 100 bytes each); beyond, they are shuffled by pattern.
BROADCAST_ROWS = 1_000_000


def intervals(entries: DataFrame) -> DataFrame:
    """entries (list, pattern, action 'add'|'remove', at timestamp) -> (list, pattern, since, until).

    An entry is active from the first add until the next remove; a second add before it changes nothing, as does a remove
    of what isn't listed. At one moment removes come last, so that an entry added and removed then is never active.
    until is null while an entry is active; nulls in list, pattern or at are left out."""
    change = F.when(F.col("action") == "add", 1).when(F.col("action") == "remove", 0)
    rows = entries.where("list is not null and pattern is not null and at is not null").select("list", F.lower("pattern").alias("pattern"), "at", change.alias("on")).where("on is not null").distinct()
    order = Window.partitionBy("list", "pattern").orderBy("at", F.desc("on"))
    turns = rows.withColumn("was", F.coalesce(F.lag("on").over(order), F.lit(0))).where("on <> was")
    spans = turns.withColumn("until", F.lead("at").over(order))
    return spans.where("on = 1 and (until is null or until > at)").select("list", "pattern", F.col("at").alias("since"), "until")


def lookup_keys(url: Column, labels_at_least: int = 1) -> Column:
    """The host, all its suffixes of so many whole labels or more, and the host with every prefix of the path that ends in a
    slash."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(F.trim(url), "[?#].*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", ""))
    host = F.regexp_replace(F.regexp_extract(bare, "^([^/]*)", 1), ":[0-9]+$", "")
    labels = F.split(host, "[.]")
    hosts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - (labels_at_least - 1), F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.split(F.regexp_extract(bare, "^[^/]*(/.*)?$", 1), "/")
    paths = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(host, F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))
    return F.array_distinct(F.concat(hosts, F.when(F.size(parts) > 1, paths).otherwise(F.array().cast("array<string>"))))


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (url, fetched timestamp, any others) and entries -> capture (a struct of all the columns), n_active (list
    entries active at the fetch), lists (their distinct lists, sorted), blocked (n_active > 0).

    Null URLs, those without a host, and null times match nothing. Entries that repeat count once; repeated captures each
    get a result. Either table may be empty."""
    rows = stage(captures.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in captures.columns]).alias("capture")), "captures")
    spans = stage(intervals(entries), "intervals")
    small = spans.count() <= BROADCAST_ROWS
    # Where no pattern is a single label, no capture asks for "com": a key that they would all share.
    least = 2 if spans.where("pattern not like '%.%' and pattern not like '%/%'").isEmpty() else 1
    asked = rows.where("capture.url is not null and capture.fetched is not null").select("row", F.col("capture.fetched").alias("fetched"), F.explode(lookup_keys(F.col("capture.url"), least)).alias("pattern"))
    met = asked.join(F.broadcast(spans) if small else spans, "pattern").where("fetched >= since and (until is null or fetched < until)")
    found = met.groupBy("row").agg(F.count("*").alias("n_active"), F.array_sort(F.collect_set("list")).alias("lists"))
    out = rows.join(found, "row", "left")
    n = F.coalesce("n_active", F.lit(0)).cast("long")
    return out.select("capture", n.alias("n_active"), F.coalesce("lists", F.array().cast("array<string>")).alias("lists"), (n > 0).alias("blocked"))
