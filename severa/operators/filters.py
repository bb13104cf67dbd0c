"""Filters that every query over notices shares."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from severa.functions.naics import industry_filter


def active(notices: DataFrame) -> DataFrame:
    """Superseded versions never count."""
    return notices.where(~F.col("is_superseded"))


def counted(notices: DataFrame, category: str | None = None, after: datetime.date | None = None, before: datetime.date | None = None, state: str | None = None) -> DataFrame:
    """Active notices as statistics count them: all but Non-WARN (null stays), or one category; bounds are inclusive."""
    rows = active(notices)
    rows = rows.where(F.col("closure_category") == category if category else ~F.col("closure_category").eqNullSafe("Non-WARN"))
    rows = rows.where(F.col("notice_date") >= F.lit(after)) if after else rows
    rows = rows.where(F.col("notice_date") <= F.lit(before)) if before else rows
    return rows.where(F.col("state") == state.upper()) if state else rows


def listed(notices: DataFrame, state: str | None = None, employer: str | None = None, category: str | None = None, min_layoffs: int | None = None, after: datetime.date | None = None, before: datetime.date | None = None, industry: str | None = None, bbox: tuple | None = None) -> DataFrame:
    """Active notices as lists show them: Non-WARN stays; an employer pattern's % and _ are wildcards; a minimum of 0
    filters nothing; a box with a missing side is ignored."""
    rows = active(notices)
    tests: list[Column] = []
    if state:
        tests.append(F.col("state") == state.upper())
    if employer:
        tests.append(F.col("employer").ilike(f"%{employer}%"))
    if category:
        tests.append(F.col("closure_category") == category)
    if min_layoffs:
        tests.append(F.col("layoff_count") >= min_layoffs)
    if after:
        tests.append(F.col("notice_date") >= F.lit(after))
    if before:
        tests.append(F.col("notice_date") <= F.lit(before))
    if industry:
        tests.append(industry_filter(F.col("naics_code"), industry))
    if bbox and all(x is not None for x in bbox):
        west, south, east, north = bbox
        tests.append(F.col("lon").between(west, east) & F.col("lat").between(south, north))
    for t in tests:
        rows = rows.where(t)
    return rows


def totals() -> tuple[Column, Column]:
    """notice_count and layoff_total of a group: a notice without a count adds no workers."""
    return F.count("notice_id").alias("notice_count"), F.coalesce(F.sum("layoff_count"), F.lit(0)).cast("long").alias("layoff_total")


def plausible_dates(rows: DataFrame, as_of: datetime.date) -> DataFrame:
    """Drops dates before 1988 or over two years ahead; null dates stay."""
    return rows.where(F.col("notice_date").isNull() | F.year("notice_date").between(1988, as_of.year + 2))
