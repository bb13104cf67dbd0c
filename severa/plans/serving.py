"""Queries behind pages, queues and feeds: further joins, roll-ups, rankings, set operations and ordered folds."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from severa.functions import names, text
from severa.functions.naics import if_trusted
from severa.operators import dedup, events as ev, filters, linkage, models, places, staffing, timeline, validate
from severa.operators.filters import counted, totals
from severa.plans.adapter import COMPANIES, LOCATIONS, NC, NL, RUNS, N, companies, locations, notices, runs, table, with_
from severa.plans.events import _DUR, _EV, _events, coverage_mask, event_dataset, person_periods as _person_periods
from severa.plans.merging import _PAIRS, versions
from severa.plans.registry import oracle_of, query
from severa.plans.reports import panel
from severa.plans.stats import TOP
from severa.staging import stage

AS_OF = datetime.date(2001, 7, 12)
COUNTED = "NOT is_superseded AND closure_category IS DISTINCT FROM 'Non-WARN'"
TOTALS = "count(notice_id) AS notice_count, CAST(coalesce(sum(layoff_count), 0) AS BIGINT) AS layoff_total"
D = datetime.date

# --- joins -----------------------------------------------------------------------------------------------------------


@query("jn02_canonical_rollup", TOP.rsplit("ORDER BY", 1)[0])
def canonical_rollup(spark, sf):
    """All employers after rolling companies up, unlinked notices by their own name."""
    c = companies(spark, sf)
    rows = counted(notices(spark, sf)).join(c.select("company_id", "canonical_company_id"), "company_id", "left").withColumn("canon", F.coalesce("canonical_company_id", "company_id"))
    sums = rows.groupBy("canon", F.when(F.col("canon").isNull(), F.col("employer")).alias("own")).agg(F.min("employer").alias("any_employer"), *totals())
    named = sums.join(c.select(F.col("company_id").alias("canon"), F.col("name").alias("canon_name")), "canon", "left")
    return named.select(F.coalesce("canon_name", "any_employer").alias("employer"), "notice_count", "layoff_total")


@query("jn03_family_totals", f"{NC} SELECT k.parent_group_key AS family, count(DISTINCT k.company_id) AS members, {TOTALS} FROM notices n JOIN companies c USING (company_id) JOIN companies k ON k.company_id = coalesce(c.canonical_company_id, c.company_id) WHERE {COUNTED} AND k.parent_group_key NOT LIKE 'self:%' GROUP BY 1")
def family_totals(spark, sf):
    c = companies(spark, sf)
    of = c.select("company_id", F.coalesce("canonical_company_id", "company_id").alias("canon"))
    family = c.where("parent_group_key not like 'self:%'").select(F.col("company_id").alias("canon"), F.col("parent_group_key").alias("family"))
    sums = counted(notices(spark, sf)).join(of, "company_id").groupBy("canon").agg(*totals()).join(family, "canon")
    return sums.groupBy("family").agg(F.count("*").alias("members"), F.sum("notice_count").alias("notice_count"), F.sum("layoff_total").alias("layoff_total"))


@query("jn04_geocoded_notices", f"{NL} SELECT notice_id, city, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon FROM notices JOIN locations USING (location_id) WHERE NOT is_superseded AND lat IS NOT NULL AND lon IS NOT NULL")
def geocoded_notices(spark, sf):
    place = locations(spark, sf).where("lat is not null and lon is not null").select("location_id", "city", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    return filters.active(notices(spark, sf)).join(place, "location_id").select("notice_id", "city", "lat", "lon")


@query("jn07_companies_with_totals", f"{NC}, t AS (SELECT company_id, {TOTALS} FROM notices WHERE {COUNTED} GROUP BY 1) SELECT c.company_id, c.name, coalesce(notice_count, 0) AS notice_count, coalesce(layoff_total, 0) AS layoff_total FROM companies c LEFT JOIN t USING (company_id)")
def companies_with_totals(spark, sf):
    sums = counted(notices(spark, sf)).groupBy("company_id").agg(*totals())
    return companies(spark, sf).join(sums, "company_id", "left").select("company_id", "name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("notice_count", "layoff_total")])


for _case, _name in ((1, "jn09_amended_counts"), (2, "jn10_same_address"), (3, "jn11_locationless")):

    @query(_name, f'{_PAIRS} SELECT o_id, k_id FROM q WHERE "case" = {_case}')
    def pairs_of_case(spark, sf, case=_case):
        return dedup.pairs_of_case(stage(versions(spark, sf), "versions"), case)


@query("jn15_usage_today", "WITH k AS (SELECT DISTINCT user_id FROM events), u AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS calls FROM events GROUP BY ALL) SELECT k.user_id, coalesce(u.calls, 0) AS calls FROM k LEFT JOIN u ON u.user_id = k.user_id AND u.day = (SELECT max(CAST(ts AS DATE)) FROM events)")
def usage_today(spark, sf):
    """Every key with its calls on the last day: the day belongs to the join, so keys without any stay."""
    e = table(spark, sf, "events").withColumn("day", F.col("ts").cast("date"))
    usage = e.groupBy("user_id", "day").agg(F.count("*").alias("calls"))
    last = e.agg(F.max("day").alias("day"))
    today = usage.join(F.broadcast(last), "day").select("user_id", "calls")
    return e.select("user_id").distinct().join(today, "user_id", "left").select("user_id", F.coalesce("calls", F.lit(0)).alias("calls"))


@query("jn21_members", f"{NC} SELECT coalesce(c.canonical_company_id, c.company_id) AS head, c.company_id, count(notice_id) AS notice_count, CAST(coalesce(sum(layoff_count), 0) AS BIGINT) AS layoff_total FROM companies c LEFT JOIN notices n ON n.company_id = c.company_id AND NOT is_superseded GROUP BY ALL")
def members(spark, sf):
    own = filters.active(notices(spark, sf)).groupBy("company_id").agg(*totals())
    rows = companies(spark, sf).select("company_id", F.coalesce("canonical_company_id", "company_id").alias("head")).join(own, "company_id", "left")
    return rows.select("head", "company_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("notice_count", "layoff_total")])


_SITES = "sites AS (SELECT s_suppkey AS location_id, s_nationkey AS state, 'Town' || (s_suppkey % 3) AS city, CASE WHEN s_suppkey % 4 <> 0 THEN CAST(10000 + s_suppkey % 5 AS VARCHAR) END AS zip FROM supplier)"


def _sites(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(k.alias("location_id"), F.col("s_nationkey").alias("state"), F.concat(F.lit("Town"), k % 3).alias("city"), F.when(k % 4 != 0, (10000 + k % 5).cast("string")).alias("zip"))


@query("jn29_rebound_locations", f"WITH {_SITES}, f AS (SELECT location_id, state, city, coalesce(zip, CASE WHEN location_id % 8 = 0 THEN '10001' END) AS zip, CASE WHEN zip IS NOT NULL THEN location_id END AS had FROM sites) SELECT location_id, zip, CASE WHEN zip IS NULL THEN location_id ELSE coalesce(min(had) OVER w, min(location_id) OVER w) END AS target_id FROM f WINDOW w AS (PARTITION BY state, city, zip)")
def rebound_locations(spark, sf):
    sites = _sites(spark, sf)
    return places.rebind(sites, sites.where("location_id % 8 = 0").select("location_id", F.lit("10001").alias("zip")))


@query("jn37_graded_scores", "WITH s AS (SELECT l_orderkey, l_discount AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem) SELECT o_orderpriority AS slice, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS realised FROM s JOIN orders ON l_orderkey = o_orderkey WHERE i = 1 GROUP BY 1")
def graded_scores(spark, sf):
    """The score that each event was given first against what became of it."""
    rows = first_scores(spark, sf).join(table(spark, sf, "orders"), F.expr("event = o_orderkey"))
    return rows.groupBy(F.col("o_orderpriority").alias("slice")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.avg((F.col("o_orderstatus") == "F").cast("double")), 6).alias("realised"))


@query("jn39_county_jobs_join", f"{NL}, j AS (SELECT state, regexp_replace(county, ' (County|Co\\.)$', '') AS county, CAST(sum(1000 + location_id * 10) AS BIGINT) AS jobs FROM locations WHERE county IS NOT NULL AND location_id % 5 <> 2 GROUP BY ALL), g AS (SELECT l.state, regexp_replace(l.county, ' (County|Co\\.)$', '') AS county, {TOTALS} FROM notices n JOIN locations l USING (location_id) WHERE {COUNTED} AND l.county IS NOT NULL GROUP BY ALL) SELECT state, county, notice_count, layoff_total, jobs FROM g LEFT JOIN j USING (state, county)")
def county_jobs_join(spark, sf):
    place = locations(spark, sf).where("county is not null").select("location_id", F.col("state").alias("s"), text.county_name(F.col("county")).alias("county"))
    jobs = place.where("location_id % 5 <> 2").groupBy("s", "county").agg(F.sum(1000 + F.col("location_id") * 10).alias("jobs"))
    rows = counted(notices(spark, sf)).join(place, "location_id").groupBy("s", "county").agg(*totals())
    return rows.join(jobs, ["s", "county"], "left").withColumnRenamed("s", "state")


@query("jn40_relinked_cities", "WITH p AS (SELECT s_nationkey AS state, 'Town' || (s_suppkey % 7) AS city, min(s_suppkey) AS location_id FROM supplier GROUP BY ALL) SELECT s.s_suppkey AS notice, p.location_id, p.city FROM supplier s JOIN p ON p.state = s.s_nationkey AND p.city = 'Town' || (s.s_suppkey * 3 % 7) WHERE s.s_suppkey % 4 = 1")
def relinked_cities(spark, sf):
    """Notices whose location has no city, relinked to the location of the city that their address ends in."""
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    known = s.groupBy(F.col("s_nationkey").alias("state"), F.concat(F.lit("Town"), k % 7).alias("city")).agg(F.min("s_suppkey").alias("location_id"))
    rows = s.where("s_suppkey % 4 = 1").select(k.alias("notice"), F.col("s_nationkey").alias("state"), F.concat(k.cast("string"), F.lit(" Main St, Suite 4, TOWN"), k * 3 % 7).alias("address"))
    return places.city_from_tail(rows, "notice", "state", "address", known)


# --- aggregations ----------------------------------------------------------------------------------------------------


@query("agg26_radar_page", f"{N} SELECT notice_id, effective_date, CAST(count(*) OVER () AS BIGINT) AS total FROM notices WHERE NOT is_superseded AND effective_date >= DATE '2001-01-01' ORDER BY effective_date, layoff_count DESC NULLS LAST, scraped_at DESC, notice_id LIMIT 50 OFFSET 50")
def radar_page(spark, sf):
    """The second page of coming separations with the number of all."""
    rows = filters.active(notices(spark, sf)).where(F.col("effective_date") >= F.lit(D(2001, 1, 1)))
    page = rows.orderBy("effective_date", F.desc_nulls_last("layoff_count"), F.desc("scraped_at"), "notice_id").offset(50).limit(50)
    return page.select("notice_id", "effective_date").join(F.broadcast(rows.agg(F.count("*").alias("total"))))


@query("agg27_open_events", f"{_EV} SELECT company, max(day) AS day, max_by(prior_events, day) AS prior_events FROM e WHERE day + 365 >= 11515 GROUP BY 1")
def open_events(spark, sf):
    """Each company's latest event that a year has not yet passed since."""
    rows = _events(spark, sf).where("not labelled")
    return rows.withColumn("i", F.row_number().over(Window.partitionBy("company").orderBy(F.desc("day")))).where("i = 1").select("company", "day", "prior_events")


@query("agg37_state_deltas", f"{N}, w AS (SELECT state, count(*) FILTER (notice_date BETWEEN DATE '2001-04-14' AND DATE '2001-07-12') AS cur, count(*) FILTER (notice_date BETWEEN DATE '2001-01-14' AND DATE '2001-04-13') AS prior FROM notices WHERE {COUNTED} AND notice_date BETWEEN DATE '2001-01-14' AND DATE '2001-07-12' GROUP BY 1) SELECT state, cur, prior, cur - prior AS delta, CASE WHEN prior <> 0 THEN round_even((cur - prior) / prior * 100, 1) END AS pct FROM w")
def state_deltas(spark, sf):
    w = timeline.window_totals(counted(notices(spark, sf)), {"cur": (D(2001, 4, 14), D(2001, 7, 12)), "prior": (D(2001, 1, 14), D(2001, 4, 13))}, [F.col("state")])
    cur, prior = F.col("cur_notices"), F.col("prior_notices")
    return w.select("state", cur.alias("cur"), prior.alias("prior"), (cur - prior).alias("delta"), timeline.pct_change(cur, prior).alias("pct"))


@query("agg45_panel_series", f"WITH p AS ({oracle_of('agg44_panel')}) SELECT month, CAST(sum(notices) AS BIGINT) AS notices, count(*) AS states FROM p WHERE seen GROUP BY 1")
def panel_series(spark, sf):
    return panel(spark, sf).where("seen").groupBy("month").agg(F.sum("notices").alias("notices"), F.count("*").alias("states"))


@query("agg51_shared_names", f"""{with_(COMPANIES)}, r AS (SELECT company_id, name[1:16] AS key, unique_id, 'site' || (company_id % 2) AS domain FROM companies) SELECT key, count(*) AS n, count(DISTINCT unique_id) AS uids, count(DISTINCT domain) AS domains, count(DISTINCT unique_id) < 2 OR count(DISTINCT domain) = 1 AS one FROM r GROUP BY 1""")
def shared_names(spark, sf):
    """Names that several companies share are one company, unless unique ids and web domains say otherwise."""
    c = companies(spark, sf).select("company_id", F.substring("name", 1, 16).alias("name_key"), "unique_id", F.concat(F.lit("site"), F.col("company_id") % 2).alias("domain"))
    return dedup.shared_names(c, -F.col("company_id")).select(F.col("name_key").alias("key"), "n", "uids", "domains", "one")


# --- ordered folds ---------------------------------------------------------------------------------------------------


@query("win01_latest_rows", f"{with_(RUNS)} SELECT state, run_id, started_at FROM (SELECT *, rank() OVER (PARTITION BY state ORDER BY started_at DESC) AS r FROM runs) WHERE r = 1")
def latest_rows(spark, sf):
    """The latest run of each state; runs that began together are all latest."""
    ranked = runs(spark, sf).withColumn("r", F.rank().over(Window.partitionBy("state").orderBy(F.desc("started_at"))))
    return ranked.where("r = 1").select("state", "run_id", "started_at")


@query("win02_first_scores", "SELECT l_orderkey AS event, l_discount AS score FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) = 1")
def first_scores(spark, sf):
    """The score each event was given first: a minimum, so that no task sorts an event's scores."""
    order = F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("event")).agg(F.min_by("l_discount", order).alias("score"))


for _name, _columns in {
    "win03_event_states": ("state",), "win05_prior_events": ("prior_events",), "win06_next_gaps": ("next_gap_days",), "win07_trailing_counts": ("prior_notices_1y", "prior_notices_3y"),
    "win08_recent_counts": ("state_notices_90d", "us_notices_90d"), "win09_prior_totals": ("prior_layoffs", "prior_states"), "win10_days_since": ("days_since_prev",),
}.items():

    @query(_name, f"WITH RECURSIVE ds AS ({oracle_of('ml10_event_dataset')}) SELECT company, day, {', '.join(_columns)} FROM ds")
    def event_columns(spark, sf, columns=_columns):
        return event_dataset(spark, sf).select("company", "day", *columns)


@query("win11_uncovered", f"WITH p AS ({oracle_of('win12_coverage_mask')}) SELECT state, month, CAST(sum(CAST(usable AS INT)) OVER up AS BIGINT) AS covered_before, min(CASE WHEN NOT usable THEN month END) OVER down AS first_uncovered FROM p WINDOW up AS (PARTITION BY state ORDER BY month ROWS UNBOUNDED PRECEDING), down AS (PARTITION BY state ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")
def uncovered(spark, sf):
    """Months covered up to each, and the first from it on that isn't: whether a span is covered is then a comparison."""
    by = Window.partitionBy("state").orderBy("month")
    covered = F.sum(F.col("usable").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.min(F.when(~F.col("usable"), F.col("month"))).over(by.rowsBetween(0, Window.unboundedFollowing))
    return coverage_mask(spark, sf).select("state", "month", covered.alias("covered_before"), ahead.alias("first_uncovered"))


@query("win13_date_gaps", f"{N}, d AS (SELECT DISTINCT employer, notice_date FROM notices WHERE {COUNTED} AND notice_date IS NOT NULL) SELECT employer, notice_date, CAST(notice_date - lag(notice_date) OVER (PARTITION BY employer ORDER BY notice_date) AS INT) AS gap_days FROM d")
def date_gaps(spark, sf):
    days = counted(notices(spark, sf)).where("notice_date is not null").select("employer", "notice_date").distinct()
    return days.withColumn("gap_days", F.datediff("notice_date", F.lag("notice_date").over(Window.partitionBy("employer").orderBy("notice_date"))))


@query("win14_cumulative_risk", f"""WITH RECURSIVE p AS ({oracle_of('ml20_person_periods')}), h AS (SELECT interval, events / at_risk AS h FROM p) SELECT interval, round(1 - list_reduce(list(1 - h) OVER (ORDER BY interval), lambda a, b: a * b), 9) AS risk FROM h""")
def cumulative_risk(spark, sf):
    """The chance of a repeat by the end of each interval: one minus the product of what the hazards leave."""
    h = _person_periods(spark, sf).withColumn("h", F.col("events") / F.col("at_risk"))
    # A row for each interval of the horizon, twelve in all.
    upto = F.collect_list("h").over(Window.orderBy("interval").rowsBetween(Window.unboundedPreceding, 0))
    return h.select("interval", F.round(ev.cumulative_product(upto), 9).alias("risk"))


@query("win15_censoring_curve", f"{_DUR}, c AS (SELECT t, count(*) AS n, count(*) FILTER (NOT o) AS events FROM d GROUP BY 1), r AS (SELECT *, sum(n) OVER (ORDER BY t DESC) AS at_risk FROM c), h AS (SELECT * FROM r WHERE events > 0) SELECT t AS time, CAST(at_risk AS BIGINT) AS at_risk, events, round(list_reduce(list(1 - events / at_risk) OVER (ORDER BY t), lambda a, b: a * b), 8) AS survival FROM h")
def censoring_curve(spark, sf):
    """Kaplan-Meier of censoring: an event here is that follow-up ended without a repeat."""
    last = (AS_OF - ev.EPOCH).days
    rows = _events(spark, sf).select(F.coalesce("next_gap_days", F.lit(last) - F.col("day")).alias("t"), F.col("next_gap_days").isNull().alias("censored"))
    return ev.kaplan_meier(rows, "t", "censored").withColumn("survival", F.round("survival", 8))


@query("win21_concordance", f"""{_DUR.replace("FROM e)", ", least(prior_events, 20) AS r FROM e)")}, u AS (SELECT least(t, 365) AS t, o AND t < 365 AS o, r, count(*) AS n FROM d GROUP BY ALL),
  c AS (SELECT t, sum(n) AS n, sum(n) FILTER (NOT o) AS z FROM u GROUP BY 1), ar AS (SELECT *, sum(n) OVER (ORDER BY t DESC) AS at_risk FROM c),
  g AS (SELECT t, greatest(0.05, coalesce(exp(sum(ln(1 - coalesce(z, 0) / at_risk)) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1)) AS g FROM ar),
  p AS (SELECT i.n * j.n / (g * g) AS w, CASE WHEN i.r > j.r THEN 1.0 WHEN i.r = j.r THEN 0.5 ELSE 0.0 END AS c FROM u i JOIN g USING (t) JOIN u j ON j.t > i.t WHERE i.o) SELECT round(sum(w * c) / sum(w), 6) AS concordance FROM p""")
def concordance(spark, sf):
    """Uno's C of a rule that ranks companies by their earlier events."""
    last = (AS_OF - ev.EPOCH).days
    rows = _events(spark, sf).select(F.coalesce("next_gap_days", F.lit(last) - F.col("day")).alias("time"), F.col("next_gap_days").isNotNull().alias("observed"), F.least("prior_events", F.lit(20)).alias("risk"))
    return models.uno_concordance(rows, 365).select(F.round("concordance", 6).alias("concordance"))


@query("win22_year_pace", f"{N}, m AS (SELECT strftime(notice_date, '%Y') AS period, {TOTALS} FROM notices WHERE {COUNTED} AND notice_date <= DATE '2001-07-12' GROUP BY 1) SELECT *, CASE WHEN period = '2001' THEN greatest(notice_count, CAST(round_even(notice_count * (365 / 193.0::DOUBLE), 0) AS BIGINT)) END AS projected_notices, CASE WHEN period = '2001' THEN greatest(layoff_total, CAST(round_even(layoff_total * (365 / 193.0::DOUBLE), 0) AS BIGINT)) END AS projected_layoffs FROM m")
def year_pace(spark, sf):
    return timeline.project_pace(timeline.over_time(counted(notices(spark, sf), before=AS_OF), "year"), AS_OF, "year", before=AS_OF)


@query("fn01_pace_by_state", f"{N}, m AS (SELECT state, strftime(notice_date, '%Y-%m') AS period, {TOTALS} FROM notices WHERE {COUNTED} AND notice_date <= DATE '2001-07-12' GROUP BY ALL) SELECT state, notice_count, greatest(notice_count, CAST(round_even(notice_count * (31 / 12.0::DOUBLE), 0) AS BIGINT)) AS projected_notices FROM m WHERE period = '2001-07'")
def pace_by_state(spark, sf):
    """This month's notices of each state at the pace so far."""
    rows = counted(notices(spark, sf), after=AS_OF.replace(day=1), before=AS_OF).groupBy("state").agg(*totals())
    return rows.select("state", "notice_count", timeline.pace(F.col("notice_count"), AS_OF, "month").alias("projected_notices"))


# --- rankings, paging and sets ---------------------------------------------------------------------------------------


@query("top02_pages", f"{N} SELECT notice_id, notice_date FROM notices WHERE NOT is_superseded ORDER BY notice_date DESC NULLS LAST, scraped_at DESC, notice_id LIMIT 500 OFFSET 1000")
def pages_of_notices(spark, sf):
    """A page asked for with 900 rows has 500, the most that one has."""
    rows = filters.active(notices(spark, sf)).orderBy(F.desc_nulls_last("notice_date"), F.desc("scraped_at"), "notice_id")
    return timeline.page(rows, limit=900, offset=1000).select("notice_id", "notice_date")


@query("top06_enrichment_queue", f"{NC}, t AS (SELECT company_id, CAST(sum(layoff_count) AS BIGINT) AS impact, max(notice_date) AS latest FROM notices WHERE NOT is_superseded GROUP BY 1) SELECT c.company_id, coalesce(impact, 0) AS impact, latest FROM companies c LEFT JOIN t USING (company_id) WHERE NOT enriched ORDER BY coalesce(impact, 0) DESC, latest DESC NULLS LAST, c.company_id LIMIT 100")
def enrichment_queue(spark, sf):
    """The next companies to look up, those with most workers affected first."""
    own = filters.active(notices(spark, sf)).groupBy("company_id").agg(F.sum("layoff_count").alias("impact"), F.max("notice_date").alias("latest"))
    rows = companies(spark, sf).where("not enriched").join(own, "company_id", "left").select("company_id", F.coalesce("impact", F.lit(0)).alias("impact"), "latest")
    return rows.orderBy(F.desc("impact"), F.desc_nulls_last("latest"), "company_id").limit(100)


_WINDOWS = f"a AS (SELECT employer, {TOTALS} FROM notices WHERE {COUNTED} AND notice_date BETWEEN DATE '2001-04-14' AND DATE '2001-07-12' GROUP BY 1), b AS (SELECT employer, {TOTALS} FROM notices WHERE {COUNTED} AND notice_date BETWEEN DATE '2001-01-14' AND DATE '2001-04-13' GROUP BY 1)"


def _two_windows(spark, sf):
    return timeline.window_totals(counted(notices(spark, sf)), {"cur": (D(2001, 4, 14), D(2001, 7, 12)), "prior": (D(2001, 1, 14), D(2001, 4, 13))}, [F.col("employer")])


@query("top09_delta_rows", f"{N}, {_WINDOWS} SELECT employer, coalesce(a.layoff_total, 0) AS layoffs, coalesce(a.notice_count, 0) AS notices, coalesce(a.layoff_total, 0) - coalesce(b.layoff_total, 0) AS change FROM a FULL JOIN b USING (employer) ORDER BY layoffs DESC, notices DESC, employer LIMIT 20")
def delta_rows(spark, sf):
    rows = _two_windows(spark, sf).select("employer", F.col("cur_layoffs").alias("layoffs"), F.col("cur_notices").alias("notices"), (F.col("cur_layoffs") - F.col("prior_layoffs")).alias("change"))
    return rows.orderBy(F.desc("layoffs"), F.desc("notices"), "employer").limit(20)


@query("top12_link_sample", r"WITH p AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host FROM pages) SELECT host, page_id, url FROM p QUALIFY row_number() OVER (PARTITION BY host ORDER BY page_id DESC) <= 8")
def link_sample(spark, sf):
    """The eight newest links of every site, to be checked."""
    rows = table(spark, sf, "pages").select("page_id", "url", F.regexp_extract("url", "^[a-z]+://([^/?#:]*)", 1).alias("host"))
    return rows.withColumn("i", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("page_id")))).where("i <= 8").select("host", "page_id", "url")


@query("top13_pair_strata", "WITH p AS (SELECT c_custkey AS a, CAST(floor(abs(c_acctbal) / 1000) AS INT) % 5 AS band, c_custkey % 3 = 0 AS enriched, hash FROM (SELECT *, md5(CAST(c_custkey AS VARCHAR) || '|7') AS hash FROM customer)) SELECT a, band, enriched FROM p QUALIFY row_number() OVER (PARTITION BY band, enriched ORDER BY hash) <= 20")
def pair_strata(spark, sf):
    """Twenty seeded candidates of every score band, enriched or not."""
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(k.alias("a"), (F.floor(F.abs("c_acctbal") / 1000).cast("int") % 5).alias("band"), (k % 3 == 0).alias("enriched"))
    return linkage.stratified(rows, ["band", "enriched"], "a", 20, seed=7).select("a", "band", "enriched")


@query("set02_missing_and_extra", f"{N}, live AS (SELECT DISTINCT notice_id FROM notices WHERE location_id % 3 <> 0), stored AS (SELECT DISTINCT notice_id FROM notices WHERE location_id % 5 <> 0) SELECT notice_id, 'missing' AS kind FROM (FROM live EXCEPT FROM stored) UNION ALL SELECT notice_id, 'extra' FROM (FROM stored EXCEPT FROM live)")
def missing_and_extra(spark, sf):
    rows = notices(spark, sf)
    live, stored = rows.where("location_id % 3 <> 0").select("notice_id"), rows.where("location_id % 5 <> 0").select("notice_id")
    return live.subtract(stored).withColumn("kind", F.lit("missing")).union(stored.subtract(live).withColumn("kind", F.lit("extra")))


@query("set03_state_overlap", f"{NC}, s AS (SELECT c.parent_group_key AS family, list_sort(list(DISTINCT state)) AS a, list_sort(list(DISTINCT state) FILTER (closure_category = 'Closure')) AS b FROM notices n JOIN companies c USING (company_id) GROUP BY 1) SELECT family, round(len(list_intersect(a, coalesce(b, []))) / len(list_distinct(list_concat(a, coalesce(b, [])))), 9) AS jaccard, len(list_intersect(a, coalesce(b, []))) > 0 AS meets FROM s")
def state_overlap(spark, sf):
    """Of each family, the likeness of the states it filed in and those it closed sites in."""
    rows = notices(spark, sf).join(companies(spark, sf).select("company_id", "parent_group_key"), "company_id")
    sets = rows.groupBy(F.col("parent_group_key").alias("family")).agg(F.collect_set("state").alias("a"), F.collect_set(F.when(F.col("closure_category") == "Closure", F.col("state"))).alias("b"))
    return sets.select("family", F.round(text.similarity(F.col("a"), F.col("b")), 9).alias("jaccard"), F.arrays_overlap("a", "b").alias("meets"))


@query("set04_first_of_each", "SELECT l_orderkey, l_partkey, min(l_linenumber) AS first_line, count(*) AS rows FROM lineitem GROUP BY ALL")
def first_of_each(spark, sf):
    """Rows alike in their keys, the first in source order standing for all."""
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("first_line"), F.count("*").alias("rows"))


@query("set05_window_keys", f"{N}, {_WINDOWS} SELECT employer, a.employer IS NOT NULL AS in_current, b.employer IS NOT NULL AS in_prior FROM a FULL JOIN b USING (employer)")
def window_keys(spark, sf):
    return _two_windows(spark, sf).select("employer", (F.col("cur_notices") > 0).alias("in_current"), (F.col("prior_notices") > 0).alias("in_prior"))


# --- projections and values ------------------------------------------------------------------------------------------


@query("prj10_closure_labels", f"{N} SELECT closure_category, CASE closure_category WHEN 'Closure' THEN 'Closure' WHEN 'Layoff' THEN 'Mass layoff' ELSE 'WARN notice' END AS label, count(*) AS n FROM notices GROUP BY ALL")
def closure_labels(spark, sf):
    return notices(spark, sf).groupBy("closure_category", text.closure_label(F.col("closure_category")).alias("label")).agg(F.count("*").alias("n"))


@query("prj13_effective_defaults", f"{N} SELECT notice_id, coalesce(effective_date, CASE WHEN notice_date > DATE '2000-06-01' THEN notice_date ELSE notice_date + 60 END) AS effective_date FROM notices")
def effective_defaults(spark, sf):
    """A notice without an effective date takes effect 60 days after it, by its own date, on insert only."""
    return validate.insert_rules(notices(spark, sf), D(2000, 6, 1)).select("notice_id", "effective_date")


@query("prj15_trusted_codes", f"{with_(COMPANIES)} SELECT company_id, CASE WHEN confidence IS NULL OR confidence >= 1 THEN naics_code END AS naics FROM companies")
def trusted_codes(spark, sf):
    return companies(spark, sf).select("company_id", if_trusted(F.col("naics_code"), F.col("confidence")).alias("naics"))


@query("prj18_month_shifts", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate - INTERVAL 5 MONTH) AS DATE) AS five_back, strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m') AS next_month, len(generate_series(date_trunc('month', o_orderdate), TIMESTAMP '2001-12-01', INTERVAL 1 MONTH)) AS months_left FROM orders WHERE o_orderdate < TIMESTAMP '2001-12-01'")
def month_shifts(spark, sf):
    d = F.col("o_orderdate").cast("date")
    left = F.size(F.sequence(F.trunc(d, "month"), F.lit(D(2001, 12, 1)), F.expr("interval 1 month"))).cast("long")
    return table(spark, sf, "orders").where("o_orderdate < timestamp'2001-12-01'").select("o_orderkey", F.trunc(F.add_months(d, -5), "month").alias("five_back"), F.date_format(F.add_months(F.trunc(d, "month"), 1), "yyyy-MM").alias("next_month"), left.alias("months_left"))


def _filed(spark, sf):
    """Customers under names as filings write them."""
    k = F.col("c_custkey")
    seg = F.initcap("c_mktsegment")
    return table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.concat(seg, F.lit(" Works"), k % 10, F.lit(", Inc."), F.when(k % 3 == 0, F.concat(F.lit(" d/b/a Shop "), k % 7)).otherwise("")).alias("filed"))


_SEG = "upper(c_mktsegment[1]) || lower(c_mktsegment[2:])"


@query("prj22_trade_names", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Shop ' || (c_custkey % 7) END AS trade FROM customer")
def trade_names(spark, sf):
    return _filed(spark, sf).select("c_custkey", names.trade_name(F.col("filed")).alias("trade"))


@query("prj23_alternatives", f"SELECT c_custkey, concat_ws('|', CASE WHEN c_custkey % 3 = 0 THEN 'Shop ' || (c_custkey % 7) END, {_SEG} || ' Works' || (c_custkey % 10)) AS queries FROM customer")
def alternatives(spark, sf):
    return _filed(spark, sf).select("c_custkey", F.array_join(names.alternative_queries(F.col("filed")), "|").alias("queries"))


@query("prj24_consistent_matches", "SELECT c_custkey, c_custkey % 2 = 0 OR c_custkey % 5 = 0 AS consistent, c_custkey % 5 = 0 AS unsearchable FROM customer")
def consistent_matches(spark, sf):
    """Looked-up names that share a telling word with the one asked for; a fifth have no such word, and match as they are."""
    k = F.col("c_custkey")
    asked = F.when(k % 5 == 0, F.lit("the company")).otherwise(F.concat(F.lower("c_mktsegment"), F.lit(" a b services")))
    found = F.when(k % 5 == 0, F.lit("the company")).when(k % 2 == 0, F.concat(F.lit("new "), F.lower("c_mktsegment"))).otherwise(F.lit("harbor services"))
    return table(spark, sf, "customer").select("c_custkey", names.match_is_consistent(asked, found).alias("consistent"), names.is_unsearchable(asked).alias("unsearchable"))


@query("prj25_cleaned_keys", f"SELECT lower(c_mktsegment) || ' works' || (c_custkey % 10) AS key, count(*) AS n FROM customer GROUP BY 1")
def cleaned_keys(spark, sf):
    """Companies that share a comparison key once their names are cleaned."""
    return _filed(spark, sf).groupBy(text.company_key(names.search_name(F.col("filed"))).alias("key")).agg(F.count("*").alias("n"))


@query("prj27_fused_initials", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'abc ' || replace(p_name, ' ', ' xy ') ELSE replace(p_name, ' ', ' q ') END AS fused FROM part")
def fused_initials(spark, sf):
    tokens = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("a b c "), F.replace("p_name", F.lit(" "), F.lit(" x y ")))).otherwise(F.replace("p_name", F.lit(" "), F.lit(" q ")))
    return table(spark, sf, "part").select("p_partkey", F.array_join(names.fuse_initials(F.split(tokens, " ")), " ").alias("fused"))


@query("prj31_derived_cities", "SELECT s_suppkey, CASE WHEN s_nationkey = 0 THEN 'Washington' WHEN s_nationkey % 2 = 1 THEN n_name END AS city, CASE WHEN s_nationkey % 2 = 1 THEN s_name ELSE s_name || ' - ' || n_name END AS employer FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def derived_cities(spark, sf):
    """A district that is one city, and a state that writes the city into the employer's name."""
    t = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.expr("s_nationkey = n_nationkey"))
    rows = t.select("s_suppkey", F.col("s_nationkey").alias("state"), F.concat("s_name", F.lit(" - "), "n_name").alias("label"))
    known = table(spark, sf, "nation").where("n_nationkey % 2 = 1").select(F.col("n_nationkey").alias("state"), F.col("n_name").alias("city"))
    out = places.split_label(rows, "s_suppkey", "label", "state", known).join(rows.select("s_suppkey", "state"), "s_suppkey")
    return out.select("s_suppkey", F.when(F.col("state") == 0, F.lit("Washington")).otherwise(F.col("city")).alias("city"), "employer")


@query("prj33_filing_shares", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round_even(l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey) * 100, 1) AS share FROM lineitem")
def filing_shares(spark, sf):
    """Each occupation's share of its filing, in percent to one place."""
    whole = F.sum("l_quantity").over(Window.partitionBy("l_orderkey"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.bround(F.col("l_quantity") / whole * 100, 1).alias("share"))


@query("prj36_company_ids", "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey END AS company_id FROM customer")
def company_ids(spark, sf):
    """Keys of companies ('c123') as ids; keys of names have none."""
    k = F.col("c_custkey")
    key = F.when(k % 3 != 0, F.concat(F.lit("c"), k.cast("string"))).otherwise(F.concat(F.lit("n:c"), k.cast("string")))
    return table(spark, sf, "customer").select("c_custkey", F.regexp_extract(key, "^c([0-9]+)$", 1).try_cast("bigint").alias("company_id"))


@query("prj37_risk_tiers", "SELECT l_orderkey, max(l_discount) AS risk, CASE WHEN max(l_discount) >= 0.09 THEN 'high' WHEN max(l_discount) >= 0.05 THEN 'elevated' ELSE 'baseline' END AS tier FROM lineitem GROUP BY 1")
def risk_tiers(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_discount").alias("risk"))
    return rows.withColumn("tier", models.tier(F.col("risk"), {"high": 0.09, "elevated": 0.05}, "baseline"))


@query("flt05_impossible_dates", f"{N} SELECT count(*) AS rows, count(*) FILTER (effective_date IS NOT NULL) AS dated, CAST(coalesce(sum(CASE WHEN effective_date - notice_date NOT BETWEEN -30 AND 90 THEN 1 ELSE 0 END), 0) AS BIGINT) AS purged FROM notices")
def impossible_dates(spark, sf):
    """Rows before and after purging effective dates too far from the notice."""
    rows = notices(spark, sf)
    kept = validate.blank_implausible(rows, back=30, ahead=90)
    before = rows.agg(F.count("*").alias("rows"), F.count("effective_date").alias("dated"))
    return before.join(F.broadcast(kept.agg(F.count("effective_date").alias("left")))).select("rows", "dated", (F.col("dated") - F.col("left")).alias("purged"))


@query("val02_missing_fields", f"{N} SELECT state, " + ", ".join(f"round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS {c}" for c in ("notice_date", "layoff_count", "address")) + " FROM notices GROUP BY 1")
def missing_fields(spark, sf):
    return validate.missing_shares(notices(spark, sf), ["state"], ["notice_date", "layoff_count", "address"])


@query("fn02_employer_changes", f"{N}, {_WINDOWS} SELECT employer, CASE WHEN b.layoff_total <> 0 THEN round_even((coalesce(a.layoff_total, 0) - b.layoff_total) / b.layoff_total * 100, 1) END AS pct FROM a FULL JOIN b USING (employer)")
def employer_changes(spark, sf):
    return _two_windows(spark, sf).select("employer", timeline.pct_change(F.col("cur_layoffs"), F.col("prior_layoffs")).alias("pct"))


@query("fn07_token_cosine", """WITH t AS (SELECT p_partkey AS node, unnest(string_split(p_name || ' ' || lower(p_type) || ' ' || p_brand, ' ')) AS term FROM part), n AS (SELECT count(DISTINCT node) AS n FROM t), tf AS (SELECT node, term, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
  w AS (SELECT node, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), n), z AS (SELECT node, term, w / sqrt(sum(w * w) OVER (PARTITION BY node)) AS w FROM w)
  SELECT p_partkey, round(coalesce(sum(a.w * b.w), 0), 6) AS cosine FROM part LEFT JOIN z a ON a.node = p_partkey LEFT JOIN z b ON b.node = p_partkey + 1 AND b.term = a.term WHERE p_partkey < (SELECT max(p_partkey) FROM part) GROUP BY 1""")
def token_cosine(spark, sf):
    """Cosine of the words of every part and the one after it."""
    part = table(spark, sf, "part")
    words = F.split(F.concat_ws(" ", "p_name", F.lower("p_type"), "p_brand"), " ")
    w = linkage.tfidf(part.select(F.col("p_partkey").alias("node"), F.explode(words).alias("term")), "node")
    pairs = part.join(F.broadcast(part.agg(F.max("p_partkey").alias("last")))).where("p_partkey < last").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"))
    return linkage.pair_cosines(pairs, w, "node").select(F.col("a").alias("p_partkey"), F.round("cosine", 6).alias("cosine"))


@query("fn13_logits", "SELECT l_discount, round(ln(greatest(1e-6, least(1 - 1e-6, l_discount)) / (1 - greatest(1e-6, least(1 - 1e-6, l_discount)))), 9) AS logit, round(ln(1 + sum(l_quantity)), 9) AS log_total FROM lineitem GROUP BY 1")
def logits(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_discount").agg(F.sum("l_quantity").alias("q"))
    return rows.select("l_discount", F.round(models.logit(F.col("l_discount")), 9).alias("logit"), F.round(F.log1p("q"), 9).alias("log_total"))


@query("fn14_strict_json", """SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || ',"share":' || CASE WHEN event_type = 'error' THEN 'null' ELSE CAST(event_id % 8 * 0.5 AS VARCHAR) END || '}' AS body FROM events""")
def strict_json(spark, sf):
    """Metrics as JSON in which what is not a number is null."""
    share = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise((F.col("event_id") % 8) * 0.5)
    return table(spark, sf, "events").select("event_id", models.strict_json(F.get_json_object("props", "$.k").cast("long").alias("k"), share.alias("share")).alias("body"))


@query("fn20_quarters", f"{N} SELECT strftime(notice_date, '%Y') || '-Q' || quarter(notice_date) AS period, {TOTALS} FROM notices WHERE {COUNTED} AND notice_date IS NOT NULL GROUP BY 1")
def quarters(spark, sf):
    """Months rolled up to quarters."""
    months = timeline.over_time(counted(notices(spark, sf)))
    return months.groupBy(timeline.period_of(F.col("period"), "quarter").alias("period")).agg(F.sum("notice_count").alias("notice_count"), F.sum("layoff_total").alias("layoff_total"))


@query("fn22_range_presets", f"{N}, p AS (SELECT * FROM (VALUES ('30d', 30), ('1y', 365), ('5y', 1826), ('all', NULL)) t(preset, days)), x AS (SELECT preset, CASE preset WHEN '30d' THEN strftime(notice_date, '%Y-%m-%d') WHEN 'all' THEN strftime(notice_date, '%Y') ELSE strftime(notice_date, '%Y-%m') END AS period, layoff_count FROM notices JOIN p ON days IS NULL OR notice_date > DATE '2001-07-12' - days WHERE {COUNTED} AND notice_date <= DATE '2001-07-12') SELECT preset, period, count(*) AS notice_count FROM x GROUP BY ALL")
def range_presets(spark, sf):
    """Every preset's own range and bucket, from one pass over the notices."""
    rows = counted(notices(spark, sf), before=AS_OF)
    of = [F.when(F.lit(True) if days is None else F.col("notice_date") > F.lit(AS_OF - datetime.timedelta(days)), F.struct(F.lit(p).alias("preset"), timeline.bucket_of(F.col("notice_date"), b).alias("period"))) for p, (days, b) in timeline.PRESETS.items()]
    return rows.select(F.explode(F.array_compact(F.array(*of))).alias("x")).groupBy("x.preset", "x.period").agg(F.count("*").alias("notice_count"))


@query("cli06_industry_choice", f"{with_(COMPANIES)} SELECT company_id, coalesce(naics_code, sic) AS code, CASE WHEN naics_code IS NOT NULL THEN 'NAICS' WHEN sic IS NOT NULL THEN 'SIC' END AS kind FROM (SELECT *, CASE WHEN company_id % 2 = 0 THEN CAST(1000 + company_id % 900 AS VARCHAR) END AS sic FROM companies)")
def industry_choice(spark, sf):
    sic = F.when(F.col("company_id") % 2 == 0, (1000 + F.col("company_id") % 900).cast("string"))
    c = companies(spark, sf).withColumn("sic", sic)
    return c.select("company_id", F.coalesce("naics_code", "sic").alias("code"), F.when(F.col("naics_code").isNotNull(), "NAICS").when(F.col("sic").isNotNull(), "SIC").alias("kind"))


# --- occupations and crosswalks --------------------------------------------------------------------------------------

_PATTERNS = """pj AS (SELECT lpad(CAST(p_size AS VARCHAR), 2, '0') AS key, p_brand AS occupation, sum(p_partkey % 17 + 1) AS jobs FROM part GROUP BY ALL),
  pp AS (SELECT *, round_even(jobs / sum(jobs) OVER (PARTITION BY key) * 100, 1) AS pct FROM pj), pr AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pct DESC, occupation) AS i FROM pp)"""
_MIX = f"""{N}, {_PATTERNS}, ok AS (SELECT DISTINCT key FROM pr WHERE i <= 12 AND pct >= 0.5 AND key < '40'),
  nn AS (SELECT DISTINCT notice_id, layoff_count, naics_code, right(naics_code, 2) AS key, effective_date FROM notices WHERE NOT is_superseded)"""


def _mix(spark, sf):
    """Active notices with what they filed (a quarter of them one occupation) or what their code's parts suggest."""
    part = table(spark, sf, "part")
    jobs = part.select(F.lpad(F.col("p_size").cast("string"), 2, "0").alias("key"), F.col("p_brand").alias("occupation"), (F.col("p_partkey") % 17 + 1).alias("jobs"))
    patterns = staffing.staffing_patterns(jobs).where("key < '40'")
    rows = filters.active(notices(spark, sf)).select("notice_id", "layoff_count", "naics_code", "effective_date").distinct()
    brand = part.select(F.col("p_partkey").alias("pk"), F.col("p_brand").alias("occupation"))
    filed = rows.where("notice_id % 4 = 0").withColumn("pk", F.expr("notice_id div 100000 % 100000")).join(brand, "pk")
    filed = filed.groupBy("notice_id").agg(F.collect_set(F.struct("occupation", F.col("layoff_count").alias("n"))).alias("occupations"))
    return staffing.occupation_mix(rows, filed, patterns, F.right("naics_code", F.lit(2)))


@query("rad01_occupation_preview", f"""{_MIX}, tp AS (SELECT key, pct, occupation, i FROM pr WHERE i <= 3 AND pct >= 0.5 AND key < '40'),
  ty AS (SELECT n.notice_id, n.layoff_count, string_agg(occupation || coalesce(':' || CASE WHEN n.layoff_count > 0 THEN CAST(round_even(n.layoff_count * pct / 100, 0) AS BIGINT) END, ''), ',' ORDER BY i) AS p FROM nn n JOIN tp USING (key) GROUP BY ALL)
  SELECT n.notice_id, n.layoff_count, effective_date - DATE '2001-01-01' AS days_until, CASE WHEN n.notice_id % 4 = 0 THEN 'filed' ELSE 'typical' END AS source,
    CASE WHEN n.notice_id % 4 = 0 THEN p_brand || coalesce(':' || n.layoff_count, '') ELSE ty.p END AS preview
  FROM nn n JOIN part ON p_partkey = n.notice_id // 100000 % 100000 LEFT JOIN ty ON ty.notice_id = n.notice_id AND ty.layoff_count IS NOT DISTINCT FROM n.layoff_count
  WHERE effective_date >= DATE '2001-01-01' AND (n.notice_id % 4 = 0 OR ty.p IS NOT NULL)""")
def occupation_preview(spark, sf):
    """Coming separations with their three largest occupations."""
    rows = _mix(spark, sf).where((F.col("effective_date") >= F.lit(D(2001, 1, 1))) & F.col("source").isNotNull())
    shown = F.transform(F.slice("mix", 1, 3), lambda x: F.concat_ws(":", x["occupation"], x["workers"].cast("string")))
    return rows.select("notice_id", "layoff_count", F.datediff("effective_date", F.lit(D(2001, 1, 1))).cast("long").alias("days_until"), "source", F.array_join(shown, ",").alias("preview"))


@query("rad02_unavailable_mix", f"{_MIX} SELECT reason, count(*) AS n FROM (SELECT CASE WHEN notice_id % 4 = 0 OR key IN (SELECT key FROM ok) THEN 'none' WHEN naics_code IS NULL THEN 'no_naics' ELSE 'no_pattern' END AS reason FROM nn) GROUP BY 1")
def unavailable_mix(spark, sf):
    """Why notices have no occupations to show."""
    return _mix(spark, sf).groupBy(F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))


_SIC_SQL = " ".join(f"WHEN sic BETWEEN {a} AND {b} THEN '{s}'" for a, b, s in staffing.SIC_RANGES)


@query("dim08_voted_crosswalk", f"{with_(COMPANIES)}, c AS (SELECT CAST(100 + company_id * 37 % 9900 AS INT) // 50 * 50 AS sic, naics_code AS naics FROM companies), v AS (SELECT sic, naics, count(*) AS n FROM c WHERE naics IS NOT NULL GROUP BY ALL), b AS (SELECT sic, arg_min(naics, struct_pack(a := -n, b := naics)) AS naics FROM v GROUP BY 1) SELECT d.sic, coalesce(b.naics, CASE {_SIC_SQL.replace('sic', 'd.sic')} END) AS naics, b.naics IS NOT NULL AS exact FROM (SELECT DISTINCT sic FROM c) d LEFT JOIN b USING (sic)")
def voted_crosswalk(spark, sf):
    """Codes of the old scheme by what companies of both schemes have, else by the range they lie in."""
    c = companies(spark, sf).select(F.expr("cast(100 + company_id * 37 % 9900 as int) div 50 * 50").cast("int").alias("sic"), F.col("naics_code").alias("naics"))
    return staffing.to_naics(c.select("sic"), staffing.crosswalk(c), spark)
