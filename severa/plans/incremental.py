"""Roll-ups and posts that go on from what earlier batches have committed (STR05, STR10, STR11)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from severa.operators import filters
from severa.plans.adapter import N, notices
from severa.plans.events import COUNTED
from severa.plans.registry import query
from severa.staging import shared_dir, stage
from severa.streaming import posting
from severa.streaming.rollup import Rollup


def batches(rows):
    """Notices in three batches: those found before 1996; the others, with the supersessions of the first; at last all
    that was edited, with old versions that come late."""
    first = F.col("scraped_at") < "1996-01-01"
    edited = F.col("is_superseded") | (F.col("notice_id") % 3 == 0)
    month = F.date_format("notice_date", "yyyy-MM").alias("month")
    counts = ~F.col("closure_category").eqNullSafe("Non-WARN")
    filed = lambda d: d.select("notice_id", F.lit(1).alias("version"), month, "state", (F.col("layoff_count") + F.when(F.col("notice_id") % 3 == 0, 5).otherwise(0)).alias("layoff_count"), counts.alias("counts"))
    final = lambda d: d.select("notice_id", F.lit(2).alias("version"), month, "state", "layoff_count", (counts & ~F.col("is_superseded")).alias("counts"))
    return [
        filed(rows.where(first)),
        filed(rows.where(~first)).union(final(rows.where(first & F.col("is_superseded")))),
        final(rows.where(edited)).union(filed(rows.where(first & F.col("is_superseded")))),
    ]


@query("str10_incremental_rollup", f"{N} SELECT strftime(notice_date, '%Y-%m') AS month, state, count(*) AS notice_count, CAST(coalesce(sum(layoff_count), 0) AS BIGINT) AS layoff_total FROM notices WHERE {COUNTED} GROUP BY ALL")
def incremental_rollup(spark, sf):
    """Months by state after three batches with late, edited and superseded rows: what a full computation gives."""
    kept = Rollup(f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}", "notice_id", "version", "month", ("state",), ("layoff_count",))
    rows = stage(notices(spark, sf).select("notice_id", "notice_date", "state", "layoff_count", "closure_category", "is_superseded", "scraped_at"), "notices")
    for number, batch in enumerate(batches(rows)):
        kept.apply(batch, number)
    return kept.read(spark).select("month", "state", F.col("n").alias("notice_count"), F.col("layoff_count").alias("layoff_total"))


def answer(platform: str, notice_id: int, key: str, run: int) -> int:
    if run == 0 and platform == "x" and notice_id % 13 == 4:
        return 429
    return 404 if notice_id % 11 == 3 else 200


@query("str05_committed_posts", f"""{N}, c AS (SELECT notice_id, platform, row_number() OVER (PARTITION BY platform ORDER BY layoff_count DESC, notice_id) AS k FROM notices, (SELECT unnest(['x', 'y']) AS platform) WHERE NOT is_superseded AND layoff_count >= 45),
  s AS (SELECT *, least(500, coalesce(min(CASE WHEN platform = 'x' AND notice_id % 13 = 4 THEN k END) OVER (PARTITION BY platform) - 1, 500)) AS k0 FROM c)
  SELECT notice_id, platform, CASE WHEN notice_id % 11 = 3 THEN 404 ELSE 200 END AS status, CASE WHEN k <= k0 THEN 0 ELSE 1 END AS run FROM s WHERE k <= k0 + 500""")
def committed_posts(spark, sf):
    """The ledger after two runs of at most 500 posts a platform, each started twice; one platform had refused at first."""
    folder = f"{shared_dir(spark)}/posts-{uuid.uuid4().hex}"
    rows = filters.active(notices(spark, sf)).where("layoff_count >= 45").select("notice_id", "layoff_count", F.explode(F.array(F.lit("x"), F.lit("y"))).alias("platform"))
    for run in (0, 0, 1, 1):
        posting.post_run(rows, lambda p, i, key, run=run: answer(p, i, key, run), folder, run, "layoff_count", 500)
    return posting.ledger(spark, folder)
