"""Trend tests, pooling, claims and forecasts (ML01-ML09, AGG45, FN29)."""

from __future__ import annotations

import datetime

import pandas as pd
from pyspark.sql import functions as F

from severa.operators import events as ev
from severa.operators import outlook as ol
from severa.operators.filters import counted
from severa.plans.adapter import N, companies, notices, table
from severa.plans.events import coverage_mask
from severa.plans.registry import query

AS_OF = datetime.date(2001, 7, 12)
COUNTED = "NOT is_superseded AND closure_category IS DISTINCT FROM 'Non-WARN'"


@query("ml02_series", f"{N}, m AS (SELECT state, date_trunc('month', notice_date)::DATE AS m, count(*) AS n FROM notices WHERE {COUNTED} AND notice_date < DATE '2001-07-01' GROUP BY ALL), r AS (SELECT state, min(m) AS a, max(m) AS b FROM m GROUP BY 1), s AS (SELECT state, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS m FROM r) SELECT state, strftime(s.m, '%Y-%m') AS month, coalesce(n, 0) AS n FROM s LEFT JOIN m USING (state, m)")
def series(spark, sf):
    """Complete months from a state's first to its last, zeros between."""
    rows = counted(notices(spark, sf)).where(F.col("notice_date") < F.lit(AS_OF.replace(day=1)))
    m = rows.groupBy("state", F.trunc("notice_date", "month").alias("m")).agg(F.count("*").alias("n"))
    spine = m.groupBy("state").agg(F.explode(F.sequence(F.min("m"), F.max("m"), F.expr("interval 1 month"))).alias("m"))
    return spine.join(m, ["state", "m"], "left").select("state", F.date_format("m", "yyyy-MM").alias("month"), F.coalesce("n", F.lit(0)).alias("n"))


@query("ml01_forecasts")
def forecasts(spark, sf):
    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("month")
        got = ol.forecast(rows["n"].tolist())
        return pd.DataFrame([(rows["state"].iloc[0], got[0], h + 1, *p) for h, p in enumerate(got[1])] if got else [], columns=["state", "model", "step", "point", "low", "high"])

    return series(spark, sf).groupBy("state").applyInPandas(fit, "state string, model string, step int, point long, low long, high long")


@query("ml04_thin_series", f"{N}, m AS (SELECT employer, date_trunc('month', notice_date) AS m, count(*) AS n FROM notices WHERE {COUNTED} AND notice_date IS NOT NULL GROUP BY ALL) SELECT employer, count(*) AS months, CAST(sum(n) AS BIGINT) AS total, count(*) >= 12 AND sum(n) >= 30 AS tested FROM m GROUP BY 1")
def thin_series(spark, sf):
    m = counted(notices(spark, sf)).where("notice_date is not null").groupBy("employer", F.trunc("notice_date", "month").alias("m")).agg(F.count("*").alias("n"))
    return m.groupBy("employer").agg(F.count("*").alias("months"), F.sum("n").alias("total"), ((F.count("*") >= 12) & (F.sum("n") >= 30)).alias("tested"))


def _state_trends(spark, sf):
    usable = coverage_mask(spark, sf).where("usable").select("state", "month", F.col("notices").alias("count"))
    return ol.trends(usable, "state")


@query("ml03_trend_fits")
def trend_fits(spark, sf):
    """The quasi-Poisson trend of each order priority's months, each a short series."""
    o = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("count"))
    return ol.trends(o, "priority")


@query("ml06_state_trends")
def state_trends(spark, sf):
    """Tested on usable months, with q-values over states and shrunken slopes."""
    fits = ev.benjamini_hochberg(_state_trends(spark, sf), "p")
    pooled = ol.pool(fits, "state").select("state", "posterior", "posterior_sd", "mu", "tau2")
    out = fits.join(pooled, "state").withColumn("claim", ol.claim(F.col("state"), F.col("coef"), F.col("q")))
    return out


@query("ml05_pooled", """WITH e AS (SELECT o_orderpriority AS k, avg(o_totalprice) / 100000 AS coef, stddev_samp(o_totalprice) / 100000 / sqrt(count(*)) AS se FROM orders GROUP BY 1), s AS (SELECT count(*) AS n, sum(1 / se / se) AS sw, sum(coef / se / se) AS swb, sum(coef * coef / se / se) AS swbb, sum(1 / se / se / se / se) AS sww FROM e), t AS (SELECT greatest(0, (swbb - swb * swb / sw - (n - 1)) / (sw - sww / sw)) AS tau2 FROM s), m AS (SELECT tau2, sum(coef / (se * se + tau2)) / sum(1 / (se * se + tau2)) AS mu FROM e, t GROUP BY 1) SELECT k, round(mu, 6) AS mu, round(CASE WHEN tau2 > 0 THEN (1 - se * se / (se * se + tau2)) * coef + se * se / (se * se + tau2) * mu ELSE mu END, 6) AS posterior FROM e, m""")
def pooled(spark, sf):
    e = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg((F.avg("o_totalprice") / 100000).alias("coef"), (F.stddev_samp("o_totalprice") / 100000 / F.sqrt(F.count("*"))).alias("se"))
    return ol.pool(e, "k").select("k", F.round("mu", 6).alias("mu"), F.round("posterior", 6).alias("posterior"))


@query("ml07_sector_share_trends")
def sector_share_trends(spark, sf):
    """A sector's share: its counts with all classified notices of the month as exposure."""
    c = companies(spark, sf).where("naics_code is not null").select("company_id", F.substring("naics_code", 1, 2).alias("sector"))
    rows = counted(notices(spark, sf)).where("notice_date is not null").join(c, "company_id").withColumn("month", F.date_format("notice_date", "yyyy-MM"))
    cells = rows.groupBy("sector", "month").agg(F.count("*").alias("count"))
    exposure = rows.groupBy("month").agg(F.count("*").alias("exposure"))
    return ol.trends(cells.join(F.broadcast(exposure), "month"), "sector", offset="exposure")


@query("ml08_unemployment_link")
def unemployment_link(spark, sf):
    """State counts against a monthly covariate, with the trend as a control."""
    cov = table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg((F.avg("o_totalprice") / 100000).alias("rate"))
    rows = coverage_mask(spark, sf).where("usable").select("state", "month", F.col("notices").alias("count")).join(F.broadcast(cov), "month")
    return ol.trends(rows, "state", covariate="rate")


@query("ml09_settled_months", f"{N} SELECT strftime(notice_date, '%Y-%m') AS month, count(*) AS n FROM notices WHERE {COUNTED} AND last_day(notice_date) <= DATE '2001-06-12' GROUP BY 1")
def settled_months(spark, sf):
    """Only months that ended 30 days ago or earlier."""
    rows = counted(notices(spark, sf)).where(F.last_day("notice_date") <= F.lit(AS_OF - datetime.timedelta(30)))
    return rows.groupBy(F.date_format("notice_date", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
