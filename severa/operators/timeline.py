"""Time buckets, pace projection, dense timelines and delta windows."""

from __future__ import annotations

import calendar
import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from severa.operators.filters import totals

#: Days back, null for all, and bucket of the ranges that a page offers.
PRESETS = {"30d": (30, "day"), "1y": (365, "month"), "5y": (1826, "month"), "all": (None, "year")}
PATTERNS = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}


def bucket_of(date: Column, bucket: str = "month") -> Column:
    """The ISO date's prefix; an unknown bucket means month."""
    return F.date_format(date, PATTERNS.get(bucket, "yyyy-MM"))


def over_time(rows: DataFrame, bucket: str = "month") -> DataFrame:
    """Dated notices by period: period, notice_count, layoff_total."""
    return rows.where(F.col("notice_date").isNotNull()).groupBy(bucket_of(F.col("notice_date"), bucket).alias("period")).agg(*totals())


def _span(as_of: datetime.date, bucket: str) -> tuple[datetime.date, int, int]:
    """First day, days and days passed of the month or year of as_of."""
    if bucket == "month":
        return as_of.replace(day=1), calendar.monthrange(as_of.year, as_of.month)[1], as_of.day
    return as_of.replace(month=1, day=1), 366 if calendar.isleap(as_of.year) else 365, as_of.timetuple().tm_yday


def pace(count: Column, as_of: datetime.date, bucket: str = "month") -> Column:
    """A count of the running month or year scaled to the whole of it, never less than reported; null if under a tenth has
    passed and on its last day."""
    _, days, elapsed = _span(as_of, bucket)
    live = bucket in ("month", "year") and elapsed < days and elapsed * 10 >= days
    return F.when(F.lit(live), F.greatest(count, F.bround(count * F.lit(days / elapsed)).cast("long")))


def page(rows: DataFrame, limit: int = 50, offset: int = 0, most: int = 500) -> DataFrame:
    """One page of ordered rows: from 1 to `most` of them."""
    return rows.offset(max(0, offset)).limit(min(max(1, limit), most))


def project_pace(periods: DataFrame, as_of: datetime.date, bucket: str = "month", after: datetime.date | None = None, before: datetime.date | None = None) -> DataFrame:
    """Adds projected_notices and projected_layoffs to the last row if it is the period of as_of: counts scaled to the
    whole period, never less than reported; null if under a tenth has passed, on its last day, or if a bound cuts it."""
    start, _, _ = _span(as_of, bucket)
    cut = (before is not None and before < as_of) or (after is not None and after > start)
    now = F.lit(as_of.isoformat()[: 7 if bucket == "month" else 4])
    # A row for each period.
    last = F.max("period").over(Window.partitionBy())
    scaled = lambda c: F.when(F.lit(not cut) & (F.col("period") == now) & (F.col("period") == last), pace(F.col(c), as_of, bucket))
    return periods.withColumns({"projected_notices": scaled("notice_count"), "projected_layoffs": scaled("layoff_total")})


def period_of(month: Column, bucket: str) -> Column:
    """'YYYY-MM' as its year, quarter (YYYY-Qn) or itself."""
    year = F.substring(month, 1, 4)
    if bucket == "year":
        return year
    return F.concat(year, F.lit("-Q"), F.ceil(F.substring(month, 6, 2).cast("int") / 3).cast("string")) if bucket == "quarter" else month


def month_spine(rows: DataFrame, date: str = "notice_date") -> DataFrame:
    """Every month from the first to the last: month (its first day)."""
    ends = rows.agg(F.trunc(F.min(date), "month").alias("a"), F.trunc(F.max(date), "month").alias("b")).where("a is not null")
    return ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))


def delta_windows(rows: DataFrame, as_of: datetime.date, days: int = 90) -> dict[str, tuple[datetime.date, datetime.date]]:
    """Inclusive windows up to as_of: current, the one before, the same a year (365 days) earlier, and rolling years."""
    day = datetime.timedelta(1)
    cur = (as_of - (days - 1) * day, as_of)
    prior = (cur[0] - days * day, cur[0] - day)
    season = (cur[0] - 365 * day, cur[1] - 365 * day)
    year = (as_of - 364 * day, as_of)
    before = (year[0] - 365 * day, year[0] - day)
    return {"cur": cur, "prior": prior, "season": season, "yoy_cur": year, "yoy_prior": before}


def window_totals(rows: DataFrame, windows: dict, keys: list[Column]) -> DataFrame:
    """Notices and workers of each window by key, in one pass over the rows that any window needs."""
    low, high = min(a for a, _ in windows.values()), max(b for _, b in windows.values())
    rows = rows.where(F.col("notice_date").between(F.lit(low), F.lit(high)))
    sums = []
    for name, (a, b) in windows.items():
        inside = F.col("notice_date").between(F.lit(a), F.lit(b))
        sums += [F.count_if(inside).alias(f"{name}_notices"), F.coalesce(F.sum(F.when(inside, F.col("layoff_count"))), F.lit(0)).cast("long").alias(f"{name}_layoffs")]
    return rows.groupBy(*keys).agg(*sums) if keys else rows.agg(*sums)


def pct_change(cur: Column, prior: Column) -> Column:
    """Percent change to one place, null on a zero base."""
    return F.when(prior != 0, F.bround((cur - prior) / prior * 100, 1))


def score(row: dict[str, Column]) -> Column:
    """0 (pressure doubled or all new) to 100 (gone): half layoffs, three tenths year on year, a fifth notices."""

    def component(cur: Column, prior: Column) -> Column:
        r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (cur - prior) / prior))
        return F.when(prior == 0, F.when(cur == 0, 50.0).otherwise(0.0)).otherwise(100.0 * (1.0 - r) / 2.0)

    parts = ((0.5, "cur_layoffs", "prior_layoffs"), (0.3, "yoy_cur_layoffs", "yoy_prior_layoffs"), (0.2, "cur_notices", "prior_notices"))
    total = sum((F.lit(w) * component(row[a], row[b]) for w, a, b in parts), F.lit(0.0))
    return F.bround(total).cast("int")


def grade(score: Column) -> Column:
    return F.when(score.isNull(), "N/A").when(score >= 80, "A").when(score >= 60, "B").when(score >= 40, "C").when(score >= 20, "D").otherwise("F")
