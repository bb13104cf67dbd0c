"""Events of companies, coverage masks, survival and ranking measures (WIN, ML09-ML22, FN11-FN18)."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from severa.operators import events as ev
from severa.operators.filters import counted
from severa.operators.ranking import equal_bins
from severa.plans.adapter import N, notices, table
from severa.plans.registry import oracle_of, query
from severa.plans.reports import panel

AS_OF = datetime.date(2001, 7, 12)
COUNTED = "NOT is_superseded AND closure_category IS DISTINCT FROM 'Non-WARN'"


@query("win04_anchored_events", """WITH RECURSIVE d AS (SELECT user_id, list_sort(list(DISTINCT CAST(ts AS DATE) - DATE '1970-01-01')) AS days FROM events GROUP BY 1),
  r AS (SELECT user_id, days[1] AS start, days FROM d UNION ALL SELECT user_id, list_filter(days, lambda x: x > start + 3)[1], days FROM r WHERE len(list_filter(days, lambda x: x > start + 3)) > 0) SELECT CAST(user_id AS BIGINT) AS user_id, CAST(start AS INT) AS start FROM r""")
def anchored_events(spark, sf):
    days = F.array_sort(F.collect_set(ev.day_number(F.col("ts").cast("date")).cast("int")))
    return table(spark, sf, "events").groupBy(F.col("user_id").cast("long").alias("user_id")).agg(days.alias("days")).select("user_id", F.explode(ev.anchored_starts(F.col("days"), 3)).alias("start"))


_EV = f"""{N.replace('WITH', 'WITH RECURSIVE', 1)}, x AS (SELECT company_id AS company, state, CAST(notice_date - DATE '1970-01-01' AS INT) AS day, layoff_count, closure_category FROM notices WHERE {COUNTED} AND notice_date <= DATE '2001-07-12'),
k AS (SELECT * FROM x WHERE company IS NOT NULL), dl AS (SELECT company, list_sort(list(DISTINCT day)) AS days FROM k GROUP BY 1),
st AS (SELECT company, days[1] AS day, days FROM dl UNION ALL SELECT company, list_filter(days, lambda z: z > day + 30)[1], days FROM st WHERE len(list_filter(days, lambda z: z > day + 30)) > 0),
e AS (SELECT company, day, row_number() OVER (PARTITION BY company ORDER BY day) - 1 AS prior_events, lead(day) OVER (PARTITION BY company ORDER BY day) - day AS next_gap_days FROM st)"""


@query("ml10_event_dataset", f"""{_EV}, m AS (SELECT company, day, arg_min(state, struct_pack(a := -c, b := state)) AS state FROM (SELECT company, day, state, count(*) AS c FROM k GROUP BY ALL) GROUP BY ALL),
  a AS (SELECT e.company, e.day, count(*) FILTER (k.day = e.day) AS day_notices, count(DISTINCT k.state) FILTER (k.day = e.day) AS day_states, CAST(coalesce(sum(layoff_count) FILTER (k.day = e.day), 0) AS BIGINT) AS day_layoffs, count(*) FILTER (k.day = e.day AND closure_category = 'Closure') AS day_closures,
    count(*) FILTER (k.day < e.day AND k.day > e.day - 365) AS prior_notices_1y, count(*) FILTER (k.day < e.day AND k.day > e.day - 1095) AS prior_notices_3y, CAST(coalesce(sum(layoff_count) FILTER (k.day < e.day), 0) AS BIGINT) AS prior_layoffs,
    count(DISTINCT k.state) FILTER (k.day < e.day) AS prior_states, e.day - max(k.day) FILTER (k.day < e.day) AS days_since_prev FROM e JOIN k ON k.company = e.company AND k.day <= e.day GROUP BY e.company, e.day),
  sd AS (SELECT state, day, count(*) AS n FROM x GROUP BY ALL), s9 AS (SELECT state, day, CAST(sum(n) OVER (PARTITION BY state ORDER BY day RANGE 89 PRECEDING) AS BIGINT) AS state_notices_90d FROM sd),
  nd AS (SELECT day, sum(n) AS n FROM sd GROUP BY 1), n9 AS (SELECT day, CAST(sum(n) OVER (ORDER BY day RANGE 89 PRECEDING) AS BIGINT) AS us_notices_90d FROM nd), f AS (SELECT state, min(day) AS first FROM x GROUP BY 1)
  SELECT e.*, m.state, a.* EXCLUDE (company, day), state_notices_90d, us_notices_90d, e.day - f.first AS state_days, e.day + 365 < 11515 AS labelled, CASE WHEN e.day + 365 < 11515 THEN CAST(coalesce(next_gap_days <= 365, false) AS INT) END AS label, least(11515, e.day + 365) - e.day AS followup_days
  FROM e JOIN a USING (company, day) JOIN m USING (company, day) JOIN s9 ON s9.state = m.state AND s9.day = e.day JOIN n9 ON n9.day = e.day JOIN f ON f.state = m.state""")
def event_dataset(spark, sf):
    return ev.build_events(counted(notices(spark, sf)).withColumnRenamed("company_id", "company"), AS_OF)


def _events(spark, sf):
    return event_dataset(spark, sf).select("company", "day", "state", "prior_events", "next_gap_days", "followup_days", "label", "labelled", "prior_notices_1y", "prior_layoffs")


_DUR = f"{_EV}, d AS (SELECT coalesce(next_gap_days, 11515 - day) AS t, next_gap_days IS NOT NULL AS o FROM e)"


@query("ml11_repeat_curve", f"{_DUR}, c AS (SELECT t, count(*) AS n, count(*) FILTER (o) AS events FROM d GROUP BY 1), r AS (SELECT *, sum(n) OVER (ORDER BY t DESC) AS at_risk FROM c), h AS (SELECT * FROM r WHERE events > 0) SELECT t AS time, CAST(at_risk AS BIGINT) AS at_risk, events, round(list_reduce(list(1 - events / at_risk) OVER (ORDER BY t), lambda a, b: a * b), 8) AS survival FROM h")
def repeat_curve(spark, sf):
    last = (AS_OF - ev.EPOCH).days
    rows = _events(spark, sf).select(F.coalesce("next_gap_days", F.lit(last) - F.col("day")).alias("t"), F.col("next_gap_days").isNotNull().alias("o"))
    return ev.kaplan_meier(rows, "t", "o").withColumn("survival", F.round("survival", 8))


@query("ml20_person_periods", f"{_EV}, p AS (SELECT company, day, least(11515, day + 365) - day AS followup, next_gap_days AS gap, unnest(range(0, 12)) AS k FROM e) SELECT k AS interval, count(*) AS at_risk, CAST(sum(CASE WHEN gap > k * 30 AND gap <= (k + 1) * 30 THEN 1 ELSE 0 END) AS BIGINT) AS events FROM p WHERE followup >= (k + 1) * 30 AND (gap IS NULL OR gap > k * 30) GROUP BY 1")
def person_periods(spark, sf):
    return ev.person_periods(_events(spark, sf)).groupBy("interval").agg(F.count("*").alias("at_risk"), F.sum("y").alias("events"))


@query("ml21_life_table", f"{_EV}, p AS (SELECT least(prior_events, 3) AS bucket, least(11515, day + 365) - day AS followup, next_gap_days AS gap, unnest(range(0, 12)) AS k FROM e), h AS (SELECT bucket, k, avg(CASE WHEN gap > k * 30 AND gap <= (k + 1) * 30 THEN 1.0 ELSE 0.0 END) AS h FROM p WHERE followup >= (k + 1) * 30 AND (gap IS NULL OR gap > k * 30) GROUP BY ALL) SELECT bucket, round(1 - list_reduce(list(1 - h ORDER BY k), lambda a, b: a * b), 8) AS repeat_by_360 FROM h GROUP BY 1")
def life_table(spark, sf):
    """Hazard by interval and number of earlier events, and the chance of a repeat that they add up to."""
    rows = ev.person_periods(_events(spark, sf).withColumn("bucket", F.least("prior_events", F.lit(3)).cast("long")))
    h = rows.groupBy("bucket", "interval").agg(F.avg("y").alias("h")).groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("interval", "h"))).alias("hs"))
    return h.select("bucket", F.round(ev.cumulative_product(F.transform("hs", lambda x: x["h"])), 8).alias("repeat_by_360"))


@query("win12_coverage_mask", f"""WITH p AS ({oracle_of("agg44_panel")}),
  l AS (SELECT *, median(notices) FILTER (seen) OVER (PARTITION BY state) AS lv, row_number() OVER (PARTITION BY state ORDER BY month DESC) AS back FROM p),
  c AS (SELECT *, CASE WHEN back <= 6 AND lv > 0 THEN ln(greatest(list_sum(list_transform(range(0, notices + 1), lambda i: exp(i * ln(lv) - lv - lgamma(i + 1)))), 1e-300)) END AS lc FROM l),
  t AS (SELECT *, sum(lc) OVER w AS s, bool_and(back <= 6 AND lv > 0 AND notices < lv) OVER w AS low FROM c WINDOW w AS (PARTITION BY state ORDER BY month DESC ROWS UNBOUNDED PRECEDING)),
  k AS (SELECT *, coalesce(max(CASE WHEN low AND s < ln(0.001) THEN back END) OVER (PARTITION BY state), 0) AS cut FROM t),
  z AS (SELECT *, seen AND back > cut AND notices = 0 AS zero FROM k),
  i AS (SELECT *, back - row_number() OVER (PARTITION BY state, zero ORDER BY month DESC) AS isl FROM z),
  n AS (SELECT *, count(*) OVER (PARTITION BY state, zero, isl) AS len FROM i)
  SELECT state, month, notices, seen AND back > cut AND NOT (zero AND lv > 0 AND -lv * len < ln(0.001)) AS usable FROM n""")
def coverage_mask(spark, sf):
    """Months of each state that are data rather than holes."""
    return ev.usable_months(panel(spark, sf), "state", "month", "notices", "seen").select("state", "month", "notices", "usable")


_SCORED = "s AS (SELECT l.quality AS y, CAST(d.n_chars % 97 AS INT) AS s, d.doc_id FROM documents d JOIN labels l USING (doc_id))"


def _scored(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 97).cast("int").alias("s"))
    return d.join(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")


@query("win16_average_precision", f"WITH {_SCORED}, c AS (SELECT s, sum(y) AS p, count(*) AS n FROM s GROUP BY 1), r AS (SELECT *, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS k, sum(p) OVER () AS pos, sum(n) OVER () AS total FROM c) SELECT round(sum(p / pos * tp / k), 9) AS average_precision, round(sum((n - p) * ((tp - p) + p / 2) / (pos * (total - pos))), 9) AS roc_auc FROM r")
def average_precision(spark, sf):
    out = ev.average_precision(_scored(spark, sf), "s", "y")
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query("win17_calibration_bins", f"WITH {_SCORED}, b AS (SELECT *, ntile(10) OVER (ORDER BY s, doc_id) AS bin FROM s) SELECT bin, count(*) AS n, round(avg(s / 97), 8) AS predicted, round(avg(y), 8) AS observed FROM b GROUP BY 1")
def calibration_bins(spark, sf):
    """Ten bins of equal frequency."""
    b = equal_bins(_scored(spark, sf), [F.col("s"), F.col("doc_id")], 10)
    return b.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg(F.col("s") / 97), 8).alias("predicted"), F.round(F.avg("y"), 8).alias("observed"))


@query("win18_precision_at_top", f"WITH {_SCORED}, r AS (SELECT *, row_number() OVER (ORDER BY s DESC, doc_id) AS i, count(*) OVER () AS n FROM s) SELECT count(*) AS k, round(avg(y), 9) AS precision FROM r WHERE i <= greatest(1, round_even(0.1 * n, 0))")
def precision_at_top(spark, sf):
    rows = _scored(spark, sf)
    k = max(1, round(0.1 * rows.count()))
    return rows.orderBy(F.desc("s"), "doc_id").limit(k).agg(F.count("*").alias("k"), F.round(F.avg("y"), 9).alias("precision"))


@query("win19_q_values", "WITH p AS (SELECT o_custkey AS id, (o_custkey * 7919 % 1000 + 1) / 1001.0::DOUBLE AS p FROM orders GROUP BY 1), r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, id) AS raw, row_number() OVER (ORDER BY p, id) AS i FROM p) SELECT id, p, round(least(1.0, min(raw) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 10) AS q FROM r")
def q_values(spark, sf):
    p = table(spark, sf, "orders").select(F.col("o_custkey").alias("id")).distinct().withColumn("p", (F.col("id") * 7919 % 1000 + 1) / F.lit(1001.0))
    return ev.benjamini_hochberg(p, "p").withColumn("q", F.round("q", 10))


@query("win20_autocorrelation", "WITH m AS (SELECT o_orderpriority AS series, date_trunc('month', o_orderdate) AS m, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY ALL), d AS (SELECT series, m, v - avg(v) OVER (PARTITION BY series) AS d FROM m), l AS (SELECT *, lag(d) OVER (PARTITION BY series ORDER BY m) AS b FROM d), r AS (SELECT series, count(*) AS n, greatest(0, sum(d * b) / sum(d * d)) AS rho FROM l GROUP BY 1), c AS (SELECT *, least(0.9, rho + (1 + 3 * rho) / n) AS rc FROM r) SELECT series, round((1 + rc) / (1 - rc), 8) AS inflation FROM c")
def autocorrelation(spark, sf):
    """Variance inflation of a slope under first-order autocorrelation, bias-corrected and never below none."""
    m = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("series"), F.trunc("o_orderdate", "month").alias("m")).agg(F.count("*").cast("double").alias("v"))
    w = Window.partitionBy("series")
    d = m.withColumn("d", F.col("v") - F.avg("v").over(w)).withColumn("b", F.lag("d").over(w.orderBy("m")))
    r = d.groupBy("series").agg(F.count("*").alias("n"), F.greatest(F.lit(0.0), F.sum(F.col("d") * F.col("b")) / F.sum(F.col("d") * F.col("d"))).alias("rho"))
    rc = F.least(F.lit(0.9), F.col("rho") + (1 + 3 * F.col("rho")) / F.col("n"))
    return r.select("series", F.round((1 + rc) / (1 - rc), 8).alias("inflation"))


@query("fn12_stability_index", "WITH a AS (SELECT value FROM events WHERE event_id % 2 = 0), b AS (SELECT value FROM events WHERE event_id % 2 = 1), e AS (SELECT quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM a), c AS (SELECT 'a' AS side, len(list_filter(q, lambda x: x < value)) AS bin FROM a, e UNION ALL SELECT 'b', len(list_filter(q, lambda x: x < value)) FROM b, e), p AS (SELECT bin, greatest(0.0001, count(*) FILTER (side = 'a') / (SELECT count(*) FROM a)) AS pa, greatest(0.0001, count(*) FILTER (side = 'b') / (SELECT count(*) FROM b)) AS pb FROM c GROUP BY bin) SELECT round(sum((pb - pa) * ln(pb / pa)), 8) AS psi FROM p")
def stability_index(spark, sf):
    """Population stability over the deciles of the reference half."""
    rows = table(spark, sf, "events").select((F.col("event_id") % 2 == 0).alias("ref"), "value")
    edges = rows.where("ref").agg(F.percentile("value", F.array(*[F.lit(i / 10) for i in range(1, 10)])).alias("q"))
    bins = rows.join(F.broadcast(edges)).select("ref", F.size(F.filter("q", lambda x: x < F.col("value"))).alias("bin"))
    c = bins.groupBy("bin").agg(F.count_if("ref").alias("a"), F.count_if(~F.col("ref")).alias("b"))
    share = lambda x: F.greatest(F.lit(1e-4), F.col(x) / F.sum(x).over(Window.partitionBy()))
    p = c.select(share("a").alias("pa"), share("b").alias("pb"))
    return p.agg(F.round(F.sum((F.col("pb") - F.col("pa")) * F.log(F.col("pb") / F.col("pa"))), 8).alias("psi"))


@query("fn18_rebased", "WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, o_orderpriority AS series, CAST(count(*) AS DOUBLE) AS v FROM orders WHERE NOT (o_orderpriority = (SELECT min(o_orderpriority) FROM orders) AND year(o_orderdate) = 1995) GROUP BY ALL), w AS (SELECT month FROM m GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT series) FROM m)), b AS (SELECT series, avg(v) AS base FROM m JOIN w USING (month) GROUP BY 1) SELECT month, series, round(v / base * 100, 6) AS v FROM m JOIN b USING (series)")
def rebased(spark, sf):
    """Series on the mean of their common window as 100."""
    o = table(spark, sf, "orders")
    first = o.agg(F.min("o_orderpriority").alias("f"))
    rows = o.join(F.broadcast(first)).where(~((F.col("o_orderpriority") == F.col("f")) & (F.year("o_orderdate") == 1995)))
    m = rows.groupBy(F.trunc("o_orderdate", "month").alias("month"), F.col("o_orderpriority").alias("series")).agg(F.count("*").cast("double").alias("v"))
    n = m.agg(F.count_distinct("series").alias("series_n"))
    common = m.groupBy("month").count().join(F.broadcast(n)).where("count = series_n").select("month")
    base = m.join(common, "month").groupBy("series").agg(F.avg("v").alias("base"))
    return m.join(base, "series").select("month", "series", F.round(F.col("v") / F.col("base") * 100, 6).alias("v"))


@query("ml12_folds", "WITH e AS (SELECT o_custkey, year(o_orderdate) AS y FROM orders) SELECT f AS year, count(*) FILTER (y < f) AS train, count(*) FILTER (y = f) AS test FROM e, (SELECT unnest([1997, 1998, 1999, 2000]) AS f) GROUP BY 1")
def folds(spark, sf):
    """Rolling origin: each test year learns from the years before it."""
    years = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("y")).count()
    out = years.withColumn("year", F.explode(F.array(*map(F.lit, (1997, 1998, 1999, 2000)))))
    return out.groupBy("year").agg(F.sum(F.when(F.col("y") < F.col("year"), F.col("count")).otherwise(0)).alias("train"), F.sum(F.when(F.col("y") == F.col("year"), F.col("count")).otherwise(0)).alias("test"))


@query("ml14_rule_baselines", f"{_EV} SELECT least(prior_events, 5) AS prior_events, count(*) AS n, round(avg(CASE WHEN next_gap_days <= 365 THEN 1.0 ELSE 0.0 END), 8) AS repeat_rate FROM e WHERE day + 365 < 11515 GROUP BY 1")
def rule_baselines(spark, sf):
    rows = _events(spark, sf).where("labelled")
    return rows.groupBy(F.least("prior_events", F.lit(5)).cast("long").alias("prior_events")).agg(F.count("*").alias("n"), F.round(F.avg("label"), 8).alias("repeat_rate"))
