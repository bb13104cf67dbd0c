"""Batch gates, insert rules and cleaning of implausible values."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from severa.functions.text import blank


def batch_gate(rows: DataFrame, keys: list[str], least: int, most: int, blank_share: float = 0.1) -> DataFrame:
    """One row for each batch: its size, the share of blanks in required fields, and whether it may be stored."""
    share = lambda c: F.avg(c.cast("int"))
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), share(blank(F.col("employer"))).alias("e"), share(F.col("notice_date").isNull()).alias("d"))
    passes = F.col("n").between(least, most) & (F.col("e") <= blank_share) & (F.col("d") <= blank_share)
    return out.select(*keys, "n", F.round("e", 6).alias("blank_employer"), F.round("d", 6).alias("blank_date"), passes.alias("passes"))


def insert_rules(rows: DataFrame, as_of: datetime.date) -> DataFrame:
    """On first insert: a notice dated after as_of is dated as_of and keeps its date as the effective one; other notices
    without an effective date take effect 60 days after their date."""
    date = F.col("notice_date")
    late = date > F.lit(as_of)
    effective = F.coalesce("effective_date", F.when(late, date).otherwise(F.date_add(date, 60)))
    return rows.withColumns({"effective_date": effective, "notice_date": F.least(date, F.lit(as_of))})


def missing_shares(rows: DataFrame, keys: list[str], required: list[str]) -> DataFrame:
    """The share of nulls in each required field, by batch."""
    return rows.groupBy(*keys).agg(*[F.round(F.avg(F.col(c).isNull().cast("double")), 6).alias(c) for c in required])


def blank_implausible(rows: DataFrame, back: int = 730, ahead: int = 1825) -> DataFrame:
    """Negative counts and effective dates more than `back` days before or `ahead` after the notice become null."""
    days = F.datediff("effective_date", "notice_date")
    return rows.withColumns({
        "layoff_count": F.when(F.col("layoff_count") >= 0, F.col("layoff_count")),
        "effective_date": F.when(days.isNull() | days.between(-back, ahead), F.col("effective_date")),
    })


def ml_clean(rows: DataFrame, placeholder_state: str, years: tuple[int, int], most: int = 50_000) -> DataFrame:
    """Training rows: counted categories, no placeholder years of one state, implausible counts null, one row an id."""
    rows = rows.where(~F.col("is_superseded") & ~F.col("closure_category").eqNullSafe("Non-WARN"))
    rows = rows.where(~((F.col("state") == placeholder_state) & F.coalesce(F.year("notice_date").between(*years), F.lit(False))))
    order = Window.partitionBy("notice_id").orderBy(F.col("layoff_count").asc_nulls_first(), "scraped_at")
    rows = rows.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")
    return rows.withColumn("layoff_count", F.when((F.col("layoff_count") > 0) & (F.col("layoff_count") <= most), F.col("layoff_count")))
