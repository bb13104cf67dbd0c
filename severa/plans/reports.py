"""Delta windows, scorecards, audit, cadence, metrics and paging (AGG31-AGG57, TOP, VAL, SNK)."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from severa.functions import text
from severa.operators import filters, timeline
from severa.operators.filters import counted, totals
from severa.plans.adapter import NC, NL, RUNS, N, companies, locations, notices, runs, table, with_
from severa.plans.registry import oracle_of, query

AS_OF = datetime.date(2001, 7, 12)
COUNTED = "NOT is_superseded AND closure_category IS DISTINCT FROM 'Non-WARN'"
TOTALS = "count(notice_id) AS notice_count, CAST(coalesce(sum(layoff_count), 0) AS BIGINT) AS layoff_total"
WINDOWS = timeline.delta_windows(None, AS_OF)


def _sums(names=WINDOWS) -> str:
    return ", ".join(f"count(*) FILTER (notice_date BETWEEN DATE '{a}' AND DATE '{b}') AS {n}_notices, CAST(coalesce(sum(layoff_count) FILTER (notice_date BETWEEN DATE '{a}' AND DATE '{b}'), 0) AS BIGINT) AS {n}_layoffs" for n, (a, b) in ((n, WINDOWS[n]) for n in names))


LOW = min(a for a, _ in WINDOWS.values())
IN_ANY = f"{COUNTED} AND notice_date BETWEEN DATE '{LOW}' AND DATE '{AS_OF}'"
PCT = "CASE WHEN {p} <> 0 THEN round_even(({c} - {p}) / {p} * 100, 1) END"


@query("agg31_window_totals", f"{N} SELECT {_sums()} FROM notices WHERE {IN_ANY}")
def window_totals(spark, sf):
    return timeline.window_totals(counted(notices(spark, sf)), WINDOWS, [])


@query("agg32_closure_split", f"{N} SELECT coalesce(closure_category, 'Unspecified') AS category, {TOTALS} FROM notices WHERE {COUNTED} AND notice_date BETWEEN DATE '{WINDOWS['cur'][0]}' AND DATE '{AS_OF}' GROUP BY 1")
def closure_split(spark, sf):
    return counted(notices(spark, sf), after=WINDOWS["cur"][0], before=AS_OF).groupBy(F.coalesce("closure_category", F.lit("Unspecified")).alias("category")).agg(*totals())


@query("agg33_county_windows", f"{NL}, c AS (SELECT lower(trim(regexp_replace(regexp_replace(l.county, ' Co\\.?$', ' County'), '(?i) county$', ''))) AS key, l.county AS label, n.* FROM notices n JOIN locations l USING (location_id) WHERE {IN_ANY} AND l.county IS NOT NULL), v AS (SELECT key, label, count(*) AS k, {_sums(['cur', 'prior'])} FROM c GROUP BY ALL) SELECT key, arg_min(label, struct_pack(a := -k, b := label)) AS label, CAST(sum(cur_notices) AS BIGINT) AS cur_notices, CAST(sum(cur_layoffs) AS BIGINT) AS cur_layoffs, CAST(sum(prior_notices) AS BIGINT) AS prior_notices, CAST(sum(prior_layoffs) AS BIGINT) AS prior_layoffs FROM v GROUP BY key")
def county_windows(spark, sf):
    """The most cited spelling names the county."""
    place = locations(spark, sf).where("county is not null").select("location_id", F.lower(text.county_name(F.col("county"))).alias("key"), F.col("county").alias("label"))
    rows = counted(notices(spark, sf), after=LOW, before=AS_OF).join(place, "location_id")
    two = {n: WINDOWS[n] for n in ("cur", "prior")}
    votes = rows.groupBy("key", "label").agg(F.count("*").alias("k"))
    sums = timeline.window_totals(rows, two, [F.col("key")])
    names = votes.groupBy("key").agg(F.min_by("label", F.struct(-F.col("k"), F.col("label"))).alias("label"))
    return names.join(sums, "key", "left").fillna(0)


@query("agg34_sector_windows", f"{NC}, x AS (SELECT left(c.naics_code, 2) AS sector2, n.* FROM notices n JOIN companies c USING (company_id) WHERE {IN_ANY} AND c.naics_code IS NOT NULL) SELECT sector2, {_sums()} FROM x GROUP BY 1")
def sector_windows(spark, sf):
    c = companies(spark, sf).where("naics_code is not null").select("company_id", F.substring("naics_code", 1, 2).alias("sector2"))
    return timeline.window_totals(counted(notices(spark, sf)).join(c, "company_id"), WINDOWS, [F.col("sector2")])


@query("agg35_naics_coverage", f"{NC} SELECT state, count(*) AS n, round_even(count(c.naics_code) / count(*) * 100, 1) AS coverage FROM notices n LEFT JOIN companies c USING (company_id) WHERE {COUNTED} GROUP BY 1")
def naics_coverage(spark, sf):
    c = companies(spark, sf).select("company_id", F.col("naics_code").alias("code"))
    return counted(notices(spark, sf)).join(c, "company_id", "left").groupBy("state").agg(F.count("*").alias("n"), F.bround(F.count("code") / F.count("*") * 100, 1).alias("coverage"))


@query("agg36_monthly_by_state", f"{N} SELECT state, strftime(notice_date, '%Y-%m') AS month, {TOTALS} FROM notices WHERE {COUNTED} AND notice_date BETWEEN DATE '1995-08-01' AND DATE '2001-07-31' GROUP BY ALL")
def monthly_by_state(spark, sf):
    rows = counted(notices(spark, sf), after=datetime.date(1995, 8, 1), before=datetime.date(2001, 7, 31))
    return rows.groupBy("state", F.date_format("notice_date", "yyyy-MM").alias("month")).agg(*totals())


@query("agg38_state_report", f"{N}, w AS (SELECT state, {_sums()} FROM notices WHERE {IN_ANY} GROUP BY state) SELECT *, {PCT.format(c='cur_layoffs', p='prior_layoffs')} AS pct_layoffs, {PCT.format(c='cur_notices', p='prior_notices')} AS pct_notices, {PCT.format(c='cur_layoffs', p='season_layoffs')} AS pct_season, {PCT.format(c='yoy_cur_layoffs', p='yoy_prior_layoffs')} AS pct_year FROM w")
def state_report(spark, sf):
    rows = timeline.window_totals(counted(notices(spark, sf)), WINDOWS, [F.col("state")])
    pct = lambda a, b: timeline.pct_change(F.col(a), F.col(b))
    return rows.withColumns({"pct_layoffs": pct("cur_layoffs", "prior_layoffs"), "pct_notices": pct("cur_notices", "prior_notices"), "pct_season": pct("cur_layoffs", "season_layoffs"), "pct_year": pct("yoy_cur_layoffs", "yoy_prior_layoffs")})


@query("agg39_top_employers_by_state", f"{N}, e AS (SELECT state, employer, {TOTALS} FROM notices WHERE {COUNTED} AND notice_date BETWEEN DATE '2000-07-13' AND DATE '2001-07-12' GROUP BY ALL) SELECT state, employer, notice_count, layoff_total, rank FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY layoff_total DESC, notice_count DESC, employer) AS rank FROM e) WHERE rank <= 10")
def top_employers_by_state(spark, sf):
    each = counted(notices(spark, sf), after=datetime.date(2000, 7, 13), before=AS_OF).groupBy("state", "employer").agg(*totals())
    order = Window.partitionBy("state").orderBy(F.desc("layoff_total"), F.desc("notice_count"), "employer")
    return each.withColumn("rank", F.row_number().over(order)).where("rank <= 10")


_COMP = "CASE WHEN {p} = 0 THEN CASE WHEN {c} = 0 THEN 50.0 ELSE 0.0 END ELSE 100.0::DOUBLE * (1.0::DOUBLE - greatest(-1.0::DOUBLE, least(1.0::DOUBLE, ({c} - {p}) / {p}))) / 2.0::DOUBLE END"
_SCORE = f"CAST(round_even(0.0::DOUBLE + 0.5::DOUBLE * ({_COMP.format(c='cur_layoffs', p='prior_layoffs')}) + 0.3::DOUBLE * ({_COMP.format(c='yoy_cur_layoffs', p='yoy_prior_layoffs')}) + 0.2::DOUBLE * ({_COMP.format(c='cur_notices', p='prior_notices')}), 0) AS INT)"


@query("agg41_sector_scores", f"{NC}, x AS (SELECT left(c.naics_code, 2) AS sector2, n.* FROM notices n JOIN companies c USING (company_id) WHERE {IN_ANY} AND c.naics_code IS NOT NULL), w AS (SELECT sector2, {_sums()} FROM x GROUP BY 1), s AS (SELECT sector2, {_SCORE} AS score FROM w) SELECT *, CASE WHEN score >= 80 THEN 'A' WHEN score >= 60 THEN 'B' WHEN score >= 40 THEN 'C' WHEN score >= 20 THEN 'D' ELSE 'F' END AS grade, row_number() OVER (ORDER BY score, sector2) AS rank FROM s")
def sector_scores(spark, sf):
    rows = sector_windows(spark, sf)
    rows = rows.select("sector2", timeline.score({c: F.col(c) for c in rows.columns}).alias("score"))
    return rows.withColumn("grade", timeline.grade(F.col("score"))).withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").isNull(), "score", "sector2")))


@query("agg43_state_and_national_months", f"{N} SELECT state, strftime(notice_date, '%Y-%m') AS month, {TOTALS} FROM notices WHERE {COUNTED} AND notice_date IS NOT NULL GROUP BY GROUPING SETS ((state, strftime(notice_date, '%Y-%m')), (strftime(notice_date, '%Y-%m')))")
def state_and_national(spark, sf):
    rows = counted(notices(spark, sf)).where("notice_date is not null").withColumn("month", F.date_format("notice_date", "yyyy-MM"))
    return rows.groupingSets([[F.col("state"), F.col("month")], [F.col("month")]], "state", "month").agg(*totals())


@query("agg44_panel", f"{N}, m AS (SELECT state, date_trunc('month', notice_date)::DATE AS month, count(*) AS n FROM notices WHERE {COUNTED} AND notice_date IS NOT NULL GROUP BY ALL), s AS (SELECT state, min(month) AS first_seen FROM m GROUP BY 1), sp AS (SELECT unnest(generate_series((SELECT min(month) FROM m)::TIMESTAMP, (SELECT max(month) FROM m)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month) SELECT s.state, strftime(sp.month, '%Y-%m') AS month, coalesce(n, 0) AS notices, sp.month >= first_seen AS seen FROM s CROSS JOIN sp LEFT JOIN m ON m.state = s.state AND m.month = sp.month")
def panel(spark, sf):
    """A dense month vector for every state, marked from its first month on."""
    rows = counted(notices(spark, sf)).where("notice_date is not null")
    cells = rows.groupBy("state", F.trunc("notice_date", "month").alias("month")).agg(F.count("*").alias("n"))
    ends = cells.agg(F.sequence(F.min("month"), F.max("month"), F.expr("interval 1 month")).alias("months"))
    states = cells.groupBy("state").agg(F.min("month").alias("first_seen"))
    grid = states.join(F.broadcast(ends)).select("state", "first_seen", F.explode("months").alias("month"))
    return grid.join(cells, ["state", "month"], "left").select("state", F.date_format("month", "yyyy-MM").alias("month"), F.coalesce("n", F.lit(0)).alias("notices"), (F.col("month") >= F.col("first_seen")).alias("seen"))


_CHECKS = {
    "no_date": "notice_date IS NULL", "no_count": "layoff_count IS NULL", "no_company": "company_id IS NULL", "no_effective": "effective_date IS NULL",
    "no_category": "closure_category IS NULL", "no_address": "address IS NULL", "no_naics": "naics_code IS NULL", "superseded": "is_superseded",
    "non_warn": "closure_category = 'Non-WARN'", "eff_before_notice": "NOT is_superseded AND effective_date < notice_date", "large": "layoff_count >= 45",
    "late_scrape": "scraped_at > CAST(notice_date AS TIMESTAMP) + INTERVAL 60 DAY", "future": "notice_date > DATE '2001-07-12'",
}


@query("agg46_audit", f"{N}, a AS (SELECT state, count(*) AS n, " + ", ".join(f"count(*) FILTER ({c}) AS {k}" for k, c in _CHECKS.items()) + " FROM notices GROUP BY state) SELECT *, concat_ws(',', CASE WHEN no_date > 0.02 * n THEN 'dates' END, CASE WHEN no_count > 0.15 * n THEN 'counts' END, CASE WHEN no_company > 0.1 * n THEN 'companies' END) AS flags FROM a")
def audit(spark, sf):
    """All counters of a state in one pass."""
    rows = notices(spark, sf).groupBy("state").agg(F.count("*").alias("n"), *[F.count_if(F.expr(c)).alias(k) for k, c in _CHECKS.items()])
    flag = lambda c, s, name: F.when(F.col(c) > s * F.col("n"), name)
    return rows.withColumn("flags", F.concat_ws(",", flag("no_date", 0.02, "dates"), flag("no_count", 0.15, "counts"), flag("no_company", 0.1, "companies")))


@query("agg47_empty_years", f"{N}, y AS (SELECT DISTINCT state, year(notice_date) AS y FROM notices WHERE NOT is_superseded AND notice_date IS NOT NULL AND (CAST(substr(state, 2) AS INT) + year(notice_date)) % 4 <> 1), r AS (SELECT state, min(y) AS a, max(y) AS b FROM y GROUP BY 1), s AS (SELECT state, unnest(range(a, b + 1)) AS y FROM r) SELECT s.state, string_agg(CAST(s.y AS VARCHAR), ',' ORDER BY s.y) AS empty_years FROM s LEFT JOIN y USING (state, y) WHERE y.state IS NULL GROUP BY 1")
def empty_years(spark, sf):
    return _empty_years(notices(spark, sf))


@query("agg47_all_empty_years", oracle_of("agg47_empty_years"))
def all_empty_years(spark, sf):
    return _empty_years(notices(spark, sf))


def _empty_years(n):
    rows = filters.active(n).where("notice_date is not null and (cast(substr(state, 2) as int) + year(notice_date)) % 4 <> 1")
    years = rows.groupBy("state").agg(F.collect_set(F.year("notice_date")).alias("ys"))
    gaps = F.array_except(F.sequence(F.array_min("ys"), F.array_max("ys")), F.col("ys"))
    return years.withColumn("gaps", F.array_sort(gaps)).where("size(gaps) > 0").select("state", F.array_join(F.transform("gaps", lambda y: y.cast("string")), ",").alias("empty_years"))


@query("agg48_cadence", f"""{with_(RUNS)}, d AS (SELECT DISTINCT state, CAST(started_at AS DATE) AS d FROM runs WHERE status = 'ok' AND rows_new > 0), g AS (SELECT state, d - lag(d) OVER (PARTITION BY state ORDER BY d) AS gap FROM d), m AS (SELECT state, median(gap) AS med FROM g GROUP BY 1),
  r AS (SELECT state, count(*) AS runs, count(*) FILTER (status = 'ok') AS ok_runs, count(*) FILTER (status = 'ok' AND rows_new > 0) AS hits, max(started_at) FILTER (status = 'ok' AND rows_new > 0) AS last_new FROM runs GROUP BY 1)
  SELECT state, runs, ok_runs, hits, round_even(CASE WHEN ok_runs > 0 THEN hits / ok_runs ELSE 0 END, 3) AS hit_rate, med AS median_gap, CASE WHEN hits < 3 THEN 'insufficient_data' WHEN DATE '2024-02-01' - CAST(last_new AS DATE) > 20 THEN 'dormant' WHEN med <= 1 THEN 'hot' WHEN med <= 2 THEN 'steady' WHEN med <= 4 THEN 'slow' ELSE 'dormant' END AS tier FROM r LEFT JOIN m USING (state)""")
def cadence(spark, sf):
    """Hit rate and the median gap between the distinct days that brought rows."""
    rows = runs(spark, sf)
    hit = (F.col("status") == "ok") & (F.col("rows_new") > 0)
    days = rows.where(hit).select("state", F.col("started_at").cast("date").alias("d")).distinct()
    gaps = days.withColumn("gap", F.datediff("d", F.lag("d").over(Window.partitionBy("state").orderBy("d")))).groupBy("state").agg(F.median("gap").alias("median_gap"))
    out = rows.groupBy("state").agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "ok").alias("ok_runs"), F.count_if(hit).alias("hits"), F.max(F.when(hit, F.col("started_at"))).alias("last_new")).join(gaps, "state", "left")
    age = F.datediff(F.lit(datetime.date(2024, 2, 1)), F.col("last_new").cast("date"))
    med = F.col("median_gap")
    tier = F.when(F.col("hits") < 3, "insufficient_data").when(age > 20, "dormant").when(med <= 1, "hot").when(med <= 2, "steady").when(med <= 4, "slow").otherwise("dormant")
    return out.select("state", "runs", "ok_runs", "hits", F.bround(F.when(F.col("ok_runs") > 0, F.col("hits") / F.col("ok_runs")).otherwise(0.0), 3).alias("hit_rate"), "median_gap", tier.alias("tier"))


@query("agg49_metrics", f"{with_(RUNS)} SELECT 'runs_total' AS metric, state || ':' || status AS label, CAST(count(*) AS DOUBLE) AS value FROM runs GROUP BY ALL UNION ALL SELECT 'rows_new_total', state, CAST(sum(rows_new) AS DOUBLE) FROM runs GROUP BY state UNION ALL SELECT 'last_success_seconds', state, CAST(max(CAST(floor(epoch(started_at)) AS BIGINT)) AS DOUBLE) FROM runs WHERE status = 'ok' GROUP BY state")
def metrics(spark, sf):
    rows = runs(spark, sf)
    gauge = lambda df, name, label: df.select(F.lit(name).alias("metric"), label.alias("label"), F.col("v").cast("double").alias("value"))
    a = rows.groupBy("state", "status").agg(F.count("*").alias("v"))
    b = rows.groupBy("state").agg(F.sum("rows_new").alias("v"))
    c = rows.where("status = 'ok'").groupBy("state").agg(F.unix_timestamp(F.date_trunc("second", F.max("started_at"))).alias("v"))
    return gauge(a, "runs_total", F.concat_ws(":", "state", "status")).union(gauge(b, "rows_new_total", F.col("state"))).union(gauge(c, "last_success_seconds", F.col("state")))


@query("agg54_recategorised", r"WITH r AS (SELECT CASE l_linenumber % 4 WHEN 0 THEN 'Plant Closing' WHEN 1 THEN 'RIF' WHEN 2 THEN 'Layoff' ELSE 'other' END AS raw, l_returnflag FROM lineitem), c AS (SELECT *, CASE WHEN raw = 'Plant Closing' THEN 'Closure' WHEN raw IN ('RIF', 'Layoff') THEN 'Layoff' END AS category FROM r) SELECT l_returnflag AS was, category, count(*) AS n FROM c GROUP BY ALL")
def recategorised(spark, sf):
    k = F.col("l_linenumber") % 4
    raw = F.when(k == 0, "Plant Closing").when(k == 1, "RIF").when(k == 2, "Layoff").otherwise("other")
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("was"), text.closure_category(raw).alias("category")).agg(F.count("*").alias("n"))


@query("agg55_month_over_month", "WITH s AS (SELECT o_orderpriority AS series, strftime(o_orderdate, '%Y-%m') AS period, count(*) AS v FROM orders WHERE month(o_orderdate) <> 5 GROUP BY ALL), p AS (SELECT *, lag(v) OVER (PARTITION BY series ORDER BY period) AS before, row_number() OVER (PARTITION BY series ORDER BY period DESC) AS back FROM s) SELECT series, period, v, CASE WHEN before <> 0 THEN round_even((v - before) / before * 100, 1) END AS pct FROM p WHERE back <= 24")
def month_over_month(spark, sf):
    """Neighbouring months that are present, not calendar months."""
    s = table(spark, sf, "orders").where("month(o_orderdate) <> 5").groupBy(F.col("o_orderpriority").alias("series"), F.date_format("o_orderdate", "yyyy-MM").alias("period")).agg(F.count("*").alias("v"))
    w = Window.partitionBy("series")
    rows = s.withColumn("before", F.lag("v").over(w.orderBy("period"))).withColumn("back", F.row_number().over(w.orderBy(F.desc("period"))))
    return rows.where("back <= 24").select("series", "period", "v", timeline.pct_change(F.col("v"), F.col("before")).alias("pct"))


@query("agg56_pruned_scores", "WITH s AS (SELECT user_id AS company, CAST(ts AS DATE) AS t0, event_id % 4 AS version, event_id, value FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY company, t0 ORDER BY version, event_id) AS i FROM s) SELECT event_id, version FROM r WHERE version = 3 OR i = 1")
def pruned_scores(spark, sf):
    """The current version's scores, and the first ever of each event."""
    s = table(spark, sf, "events").select("event_id", (F.col("event_id") % 4).alias("version"), "user_id", F.col("ts").cast("date").alias("t0"))
    i = F.row_number().over(Window.partitionBy("user_id", "t0").orderBy("version", "event_id"))
    return s.withColumn("i", i).where("version = 3 or i = 1").select("event_id", "version")


@query("agg57_dataset_card", f"{N} SELECT count(*) AS notices, count(DISTINCT state) AS states, count(DISTINCT employer) AS employers, min(notice_date) AS first, max(notice_date) AS last, CAST(sum(layoff_count) AS BIGINT) AS workers FROM notices WHERE NOT is_superseded")
def dataset_card(spark, sf):
    return filters.active(notices(spark, sf)).agg(F.count("*").alias("notices"), F.count_distinct("state").alias("states"), F.count_distinct("employer").alias("employers"), F.min("notice_date").alias("first"), F.max("notice_date").alias("last"), F.sum("layoff_count").alias("workers"))


_LIST = "notice_id, state, employer, notice_date, layoff_count"


@query("top01_page", f"{N} SELECT {_LIST} FROM notices WHERE NOT is_superseded ORDER BY layoff_count DESC NULLS LAST, scraped_at DESC, notice_id LIMIT 50 OFFSET 100")
def page(spark, sf):
    rows = filters.active(notices(spark, sf)).orderBy(F.desc_nulls_last("layoff_count"), F.desc("scraped_at"), "notice_id").offset(100).limit(50)
    return rows.select(*_LIST.split(", "))


@query("top03_map_pins", f"{NL} SELECT notice_id, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, notice_date FROM notices JOIN locations USING (location_id) WHERE NOT is_superseded AND lat IS NOT NULL ORDER BY notice_date DESC NULLS LAST, notice_id LIMIT 50000")
def map_pins(spark, sf):
    place = locations(spark, sf).where("lat is not null").select("location_id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    rows = filters.active(notices(spark, sf)).select("notice_id", "location_id", "notice_date").join(place, "location_id")
    return rows.orderBy(F.desc_nulls_last("notice_date"), "notice_id").limit(50_000).select("notice_id", "lat", "lon", "notice_date")


@query("top04_search", r"""WITH q AS (SELECT ['  c','  0',' cu',' 00','cus','ust','sto','tom','ome','mer','er ','000','001','012','12 '] AS g), w AS (SELECT c_custkey, c_name, unnest(regexp_extract_all(lower(c_name), '[\p{L}\p{N}]+')) AS w FROM customer),
  t AS (SELECT c_custkey, c_name, list_distinct(flatten(list(list_transform(range(1, length(w) + 2), lambda i: ('  ' || w || ' ')[i:i + 2])))) AS g FROM w GROUP BY ALL)
  SELECT c_custkey, c_name, round(len(list_intersect(t.g, qq.g)) / (len(t.g) + len(qq.g) - len(list_intersect(t.g, qq.g))), 6) AS similarity FROM t, (SELECT list_distinct(flatten(list(list_transform(range(1, length(w) + 2), lambda i: ('  ' || w || ' ')[i:i + 2])))) AS g FROM (SELECT unnest(['customer', '000000123']) AS w)) qq ORDER BY similarity DESC, c_name LIMIT 8""")
def search(spark, sf):
    asked = text.trigrams(F.lit("Customer#000000123"))
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", F.round(text.similarity(text.trigrams(F.col("c_name")), asked), 6).alias("similarity"))
    return rows.orderBy(F.desc("similarity"), "c_name").limit(8)


@query("top05_radar", f"{N} SELECT notice_id, effective_date, layoff_count, effective_date - DATE '2001-01-01' AS days_until FROM notices WHERE NOT is_superseded AND effective_date >= DATE '2001-01-01' ORDER BY effective_date, layoff_count DESC NULLS LAST, scraped_at DESC, notice_id LIMIT 100")
def radar(spark, sf):
    day = F.lit(datetime.date(2001, 1, 1))
    rows = filters.active(notices(spark, sf)).where(F.col("effective_date") >= day)
    rows = rows.orderBy("effective_date", F.desc_nulls_last("layoff_count"), F.desc("scraped_at"), "notice_id").limit(100)
    return rows.select("notice_id", "effective_date", "layoff_count", F.datediff("effective_date", day).cast("long").alias("days_until"))


@query("top07_digest", f"{N}, r AS (SELECT state, notice_id, notice_date, row_number() OVER (PARTITION BY state ORDER BY notice_date DESC, notice_id) AS i FROM notices WHERE NOT is_superseded AND notice_date IS NOT NULL) SELECT state, notice_id, notice_date, i FROM r WHERE i <= 50")
def digest(spark, sf):
    order = Window.partitionBy("state").orderBy(F.desc("notice_date"), "notice_id")
    rows = filters.active(notices(spark, sf)).where("notice_date is not null")
    return rows.select("state", "notice_id", "notice_date", F.row_number().over(order).alias("i")).where("i <= 50")


@query("top08_largest_unposted", f"{N} SELECT notice_id, layoff_count FROM notices WHERE NOT is_superseded AND layoff_count IS NOT NULL AND notice_id % 3 <> 0 AND notice_date BETWEEN DATE '2001-06-12' AND DATE '2001-07-12' ORDER BY layoff_count DESC, notice_id LIMIT 20")
def largest_unposted(spark, sf):
    rows = filters.active(notices(spark, sf)).where("layoff_count is not null and notice_id % 3 <> 0").where(F.col("notice_date").between(F.lit(datetime.date(2001, 6, 12)), F.lit(AS_OF)))
    return rows.orderBy(F.desc("layoff_count"), "notice_id").limit(20).select("notice_id", "layoff_count")


@query("top10_feed", f"{N}, t AS (SELECT * FROM notices WHERE NOT is_superseded AND notice_date IS NOT NULL ORDER BY notice_date DESC, notice_id LIMIT 50) SELECT notice_id, employer || ' (' || state || '): ' || coalesce(CAST(layoff_count AS VARCHAR), 'unknown') || ' workers' AS title, sha256('notice:' || notice_id) AS guid FROM t")
def feed(spark, sf):
    rows = filters.active(notices(spark, sf)).where("notice_date is not null").orderBy(F.desc("notice_date"), "notice_id").limit(50)
    title = F.concat("employer", F.lit(" ("), "state", F.lit("): "), F.coalesce(F.col("layoff_count").cast("string"), F.lit("unknown")), F.lit(" workers"))
    return rows.select("notice_id", title.alias("title"), F.sha2(F.concat(F.lit("notice:"), F.col("notice_id").cast("string")), 256).alias("guid"))


@query("top11_recent_per_company", f"{N}, r AS (SELECT company_id, notice_id, row_number() OVER (PARTITION BY company_id ORDER BY notice_date DESC NULLS LAST, notice_id) AS i FROM notices WHERE company_id IS NOT NULL) SELECT * FROM r WHERE i <= 5")
def recent_per_company(spark, sf):
    order = Window.partitionBy("company_id").orderBy(F.desc_nulls_last("notice_date"), "notice_id")
    return notices(spark, sf).where("company_id is not null").select("company_id", "notice_id", F.row_number().over(order).alias("i")).where("i <= 5")


@query("snk06_sitemap_chunks", f"{N}, d AS (SELECT DISTINCT notice_id FROM notices WHERE NOT is_superseded) SELECT notice_id // 100000000000 AS chunk, count(*) AS n, min(notice_id) AS first, max(notice_id) AS last FROM d GROUP BY 1")
def sitemap_chunks(spark, sf):
    """Chunks by range of the id, so that no global numbering is needed."""
    d = filters.active(notices(spark, sf)).select("notice_id").distinct()
    return d.groupBy(F.expr("notice_id div 100000000000").alias("chunk")).agg(F.count("*").alias("n"), F.min("notice_id").alias("first"), F.max("notice_id").alias("last"))


@query("snk07_columnar_body", f"{N}, m AS (SELECT state, strftime(notice_date, '%Y') AS y, count(*) AS n FROM notices WHERE {COUNTED} AND notice_date IS NOT NULL GROUP BY ALL) SELECT state, '{{\"period\":[' || string_agg('\"' || y || '\"', ',' ORDER BY y) || '],\"notices\":[' || string_agg(CAST(n AS VARCHAR), ',' ORDER BY y) || ']}}' AS body FROM m GROUP BY state")
def columnar_body(spark, sf):
    m = counted(notices(spark, sf)).where("notice_date is not null").groupBy("state", F.date_format("notice_date", "yyyy").alias("y")).agg(F.count("*").alias("n"))
    cells = m.groupBy("state").agg(F.array_sort(F.collect_list(F.struct("y", "n"))).alias("c"))
    return cells.select("state", F.to_json(F.struct(F.transform("c", lambda c: c["y"]).alias("period"), F.transform("c", lambda c: c["n"]).alias("notices"))).alias("body"))


@query("fn19_heat_level", f"{NL}, p AS (SELECT location_id, count(*) AS n FROM notices WHERE NOT is_superseded GROUP BY 1) SELECT list_sort(list(n))[CAST(floor(0.95 * (count(*) - 1)) AS INT) + 1] AS p95 FROM p")
def heat_level(spark, sf):
    p = filters.active(notices(spark, sf)).groupBy("location_id").agg(F.count("*").alias("n"))
    return p.agg(F.element_at(F.array_sort(F.collect_list("n")), (F.floor(F.lit(0.95) * (F.count("*") - 1)) + 1).cast("int")).alias("p95"))


@query("cli04_state_bubbles", f"{NL} SELECT l.state, count(*) AS n, round(sum(lat) / count(lat), 6) AS lat, round(sum(lon) / count(lon), 6) AS lon FROM notices n JOIN locations l USING (location_id) WHERE NOT is_superseded AND lat IS NOT NULL GROUP BY 1")
def state_bubbles(spark, sf):
    place = locations(spark, sf).where("lat is not null").select("location_id", F.col("state").alias("s"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    return filters.active(notices(spark, sf)).join(place, "location_id").groupBy(F.col("s").alias("state")).agg(F.count("*").alias("n"), F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"))
