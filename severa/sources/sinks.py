"""Sinks: mirrors, guarded snapshots, reports, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns by role; a public reader sees no contact data.
PRIVATE = ("address", "scraped_at")


def columns_for(role: str, columns: list[str]) -> list[str]:
    return [c for c in columns if role == "admin" or c not in PRIVATE]


def mirror(rows: DataFrame, path: str) -> None:
    """The same rows as Parquet and as compressed CSV."""
    rows.write.mode("overwrite").parquet(f"{path}/parquet")
    rows.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(f"{path}/csv")


def snapshot(rows: DataFrame, path: str, day: str, least_share: float = 0.9) -> int:
    """Add the day's partition, unless it has shrunk under a share of the last one before it. -> rows written."""
    spark = rows.sparkSession
    count = rows.count()
    before = [r for r in days(spark, path) if r[0] < day]
    if before and count < least_share * before[-1][1]:
        raise ValueError(f"{count} rows after {before[-1][1]}: not written")
    rows.withColumn("snapshot_date", F.lit(day)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(path)
    return count


def days(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        return []
    return sorted((str(r[0]), r[1]) for r in spark.read.parquet(path).groupBy("snapshot_date").count().collect())


def changed(fetched: DataFrame, cache: DataFrame) -> DataFrame:
    """Fetched pages (url, content) whose content the cache (url, content_hash) doesn't have."""
    rows = fetched.withColumn("content_hash", F.sha2("content", 256))
    return rows.join(cache.select("url", "content_hash"), ["url", "content_hash"], "left_anti")


def unposted(candidates: DataFrame, ledger: DataFrame, platform: str) -> DataFrame:
    """Candidates that the platform's ledger doesn't have."""
    return candidates.join(ledger.where(F.col("platform") == platform).select("notice_id"), "notice_id", "left_anti")


#: Rows that a role may export at once.
CAPS = {"public": 1000, "member": 50_000, "admin": None}


def capped(rows: DataFrame, role: str) -> DataFrame:
    """The columns and, of ordered rows, as many as the role may have: what an export iterates over."""
    own = rows.select(*columns_for(role, rows.columns))
    return own.limit(CAPS[role]) if CAPS[role] else own


def replace_json(rows: DataFrame, path: str, key: str) -> None:
    """Reports as JSON lines, dealt out by key, written beside the old ones and then put in their place."""
    spark = rows.sparkSession
    rows.repartition(key).write.mode("overwrite").json(f"{path}.new")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    old, new = hadoop.Path(path), hadoop.Path(f"{path}.new")
    files = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(old, True)
    if not files.rename(new, old):
        raise OSError(f"{path} was not replaced")


def feed_item(title: Column, guid: Column, day: Column) -> Column:
    """An item of a feed; the guid stays the same however the title changes."""
    safe = title
    for character, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(character), F.lit(reference))
    return F.concat(F.lit("<item><title>"), safe, F.lit('</title><guid isPermaLink="false">'), guid, F.lit("</guid><pubDate>"), F.date_format(day, "EEE, dd MMM yyyy"), F.lit(" 00:00:00 GMT</pubDate></item>"))


def gauge(name: str, value: Column, **labels: Column) -> Column:
    """A line of the text format that metrics are scraped in."""
    quoted = [F.concat(F.lit(f'{k}="'), F.regexp_replace(v, r'(["\\\\])', r"\\$1"), F.lit('"')) for k, v in labels.items()]
    return F.concat(F.lit(f"{name}{{"), F.concat_ws(",", *quoted), F.lit("} "), value.cast("string"))


def append_metrics(values: DataFrame, path: str, metric: str, version: int) -> None:
    values.select(F.lit(metric).alias("metric"), F.lit(version).alias("version"), "value").write.mode("append").parquet(path)


def post(candidates: DataFrame, path: str, platform: str) -> None:
    """Append to the ledger what the platform doesn't have: a run repeated appends nothing."""
    spark = candidates.sparkSession
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    new = candidates
    if there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        new = unposted(candidates, spark.read.parquet(path), platform)
    new.select("notice_id", F.lit(platform).alias("platform")).write.mode("append").parquet(path)
