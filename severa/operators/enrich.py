"""Rules of ingest, enrichment and alerting jobs over tables."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from severa.functions import names, text

_ENRICHERS: list[Callable[[DataFrame], DataFrame]] = []


def enricher(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Register a step notices -> notices that fills what it can; steps run in the order of their registration."""
    _ENRICHERS.append(f)
    return f


def apply_enrichers(rows: DataFrame, filled: list[str]) -> DataFrame:
    """All steps; a value that a row has is never replaced."""
    for step in _ENRICHERS:
        new = step(rows.withColumns({f"_{c}": F.col(c) for c in filled}))
        rows = new.withColumns({c: F.coalesce(f"_{c}", c) for c in filled}).drop(*[f"_{c}" for c in filled])
    return rows


@enricher
def _zip(rows: DataFrame) -> DataFrame:
    return rows.withColumn("zip", text.zip_from(F.col("zip"), text.zip_of_address(F.col("address"))))


@enricher
def _city(rows: DataFrame) -> DataFrame:
    return rows.withColumn("city", text.city_from_address(F.col("address")))


def dispatch(address: Column, patterns: dict[str, str], rest: str) -> Column:
    """The name of the first pattern that the address matches."""
    out = F.lit(rest)
    for pattern, name in reversed(patterns.items()):
        out = F.when(address.rlike(pattern), name).otherwise(out)
    return out


def batch_log(gate: DataFrame, keys: list[str]) -> DataFrame:
    """Batches judged by `validate.batch_gate` -> keys, rows, status of a backfill."""
    return gate.select(*keys, F.col("n").alias("rows"), F.when(F.col("n") == 0, "backfill_empty").when(F.col("passes"), "backfill_ok").otherwise("backfill_invalid").alias("status"))


def labelled_union(parts: dict[str, DataFrame], label: str = "origin") -> DataFrame:
    """Tables of one shape as one, each row with its table's name."""
    out = None
    for name, part in parts.items():
        part = part.withColumn(label, F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def fresh(rows: DataFrame, most_days: int = 183) -> DataFrame:
    """Rows found within so many days of their own date; undated ones and dates ahead are not."""
    return rows.where(F.datediff(F.col("scraped_at").cast("date"), "notice_date").between(0, most_days))


def post_states(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Attempts (keys, status) -> keys, done (posted, or refused for good: a status from 200 to 499), attempts."""
    return attempts.groupBy(*keys).agg(F.bool_or(F.col("status").between(200, 499)).alias("done"), F.count("*").alias("attempts"))


def changes(rows: DataFrame, keys: list[str], order: list[str], content: Column) -> DataFrame:
    """Rows whose content differs from their key's row before, the first included."""
    was = F.lag("_content").over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_content", content).withColumn("_was", was).where("not (_content <=> _was)").drop("_content", "_was")


def settled(days: DataFrame, day: str, delay: int) -> DataFrame:
    """Days that lie `delay` days or more before the last."""
    last = days.agg(F.max(day).alias("_last"))
    return days.join(F.broadcast(last)).where(F.col(day) <= F.date_sub("_last", delay)).drop("_last")


def streaks(rows: DataFrame, key: str, status: str, order: list[str]) -> DataFrame:
    """Each key's last status and how many of its last rows have it, from maxima alone: the last row of another status ends
    the streak."""
    at = F.struct(*order)
    last = rows.groupBy(key).agg(F.max_by(status, at).alias("_now"))
    joined = rows.join(last, key).withColumn("_at", at)
    other = joined.where(~F.col(status).eqNullSafe(F.col("_now"))).groupBy(key).agg(F.max("_at").alias("_other"))
    run = joined.join(other, key, "left").where(F.col("_other").isNull() | (F.col("_at") > F.col("_other")))
    return run.groupBy(key, F.col("_now").alias(status)).agg(F.count("*").alias("streak")).select(key, status, "streak")


def to_requeue(misses: DataFrame, first: datetime.date, last: datetime.date) -> DataFrame:
    """misses (missed_on, enriched, filed): companies still without data that missed in the window and have another name to
    be looked up by."""
    return misses.where(~F.col("enriched") & F.col("missed_on").between(F.lit(first), F.lit(last)) & (F.size(names.alternative_queries(F.col("filed"))) > 0))


def business_jobs(rows: DataFrame, ordinal: str) -> DataFrame:
    """Business-pattern rows (state, county, naics, emp) -> geoid, jobs: of all industries, with jobs, the first by ordinal."""
    whole = rows.where((F.col("naics") == "------") & (F.col("emp") > 0))
    return whole.groupBy(F.concat("state", "county").alias("geoid")).agg(F.min_by("emp", ordinal).alias("jobs"))
