"""Queries over notices by state, time, industry, employer, county and place (AGG01-AGG28, FN01, FN02)."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from severa.functions import naics, text
from severa.operators import filters, timeline
from severa.operators.filters import counted, totals
from severa.operators.ranking import row_numbers
from severa.plans.adapter import NC, NCL, NL, RUNS, N, companies, locations, notices, runs, table, with_
from severa.plans.registry import query

TOTALS = "count(notice_id) AS notice_count, CAST(coalesce(sum(layoff_count), 0) AS BIGINT) AS layoff_total"
COUNTED = "NOT is_superseded AND closure_category IS DISTINCT FROM 'Non-WARN'"
AS_OF = datetime.date(2001, 7, 12)
SECTOR = "CASE " + " ".join(f"WHEN {{c}} = '{p}' THEN '{s}'" for p, s in naics.PREFIXES.items()) + " END"
SECTOR_NAME = "CASE " + " ".join(f"WHEN sector = '{s}' THEN '{n}'" for s, n, _ in naics.SECTORS) + " END"


@query("agg01_by_state", f"{N} SELECT state, {TOTALS} FROM notices WHERE {COUNTED} GROUP BY state")
def by_state(spark, sf):
    return counted(notices(spark, sf)).groupBy("state").agg(*totals())


for _bucket, _chars in (("day", 10), ("month", 7), ("year", 4)):

    @query(f"agg02_over_time_{_bucket}", f"{N} SELECT left(CAST(notice_date AS VARCHAR), {_chars}) AS period, {TOTALS} FROM notices WHERE {COUNTED} AND notice_date IS NOT NULL GROUP BY 1")
    def over_time_by(spark, sf, bucket=_bucket):
        return timeline.over_time(counted(notices(spark, sf)), bucket)


@query("agg02_over_time", f"{N} SELECT strftime(notice_date, '%Y-%m') AS period, {TOTALS} FROM notices WHERE {COUNTED} AND notice_date IS NOT NULL GROUP BY 1")
def over_time(spark, sf):
    return timeline.over_time(counted(notices(spark, sf)))


@query(
    "agg03_by_month_projected",
    f"""{N}, m AS (SELECT strftime(notice_date, '%Y-%m') AS period, {TOTALS} FROM notices WHERE {COUNTED} AND notice_date <= DATE '2001-07-12' GROUP BY 1)
    SELECT *, CASE WHEN period = '2001-07' THEN greatest(notice_count, CAST(round_even(notice_count * (31 / 12.0::DOUBLE), 0) AS BIGINT)) END AS projected_notices,
      CASE WHEN period = '2001-07' THEN greatest(layoff_total, CAST(round_even(layoff_total * (31 / 12.0::DOUBLE), 0) AS BIGINT)) END AS projected_layoffs FROM m""",
)
def by_month(spark, sf):
    return timeline.project_pace(timeline.over_time(counted(notices(spark, sf), before=AS_OF)), AS_OF, before=AS_OF)


@query("agg04_over_time_filtered", f"{N} SELECT strftime(notice_date, '%Y') AS period, {TOTALS} FROM notices WHERE NOT is_superseded AND closure_category = 'Layoff' AND state = 'S03' AND notice_date >= DATE '1996-02-29' GROUP BY 1")
def over_time_filtered(spark, sf):
    return timeline.over_time(counted(notices(spark, sf), "Layoff", datetime.date(1996, 2, 29), state="s03"), "year")


@query(
    "agg05_indicators",
    "WITH m AS (SELECT strftime(o_orderdate, '%Y') AS period, o_orderpriority AS measure, round(avg(o_totalprice), 1) AS v FROM orders GROUP BY ALL) SELECT period, string_agg(measure || '=' || CAST(CAST(v AS DECIMAL(18,1)) AS VARCHAR), ';' ORDER BY measure) AS measures FROM m GROUP BY period",
)
def indicators(spark, sf):
    o = table(spark, sf, "orders")
    each = o.groupBy(F.date_format("o_orderdate", "yyyy").alias("period"), F.col("o_orderpriority").alias("measure")).agg(F.round(F.avg("o_totalprice"), 1).alias("v"))
    pivot = each.groupBy("period").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("measure", "v")))).alias("values"))
    text_of = lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("decimal(18,1)").cast("string"))
    return pivot.select("period", F.array_join(F.transform(F.map_entries("values"), text_of), ";").alias("measures"))


TOP = f"""{NC}, r AS (SELECT n.*, coalesce(c.canonical_company_id, n.company_id) AS canon FROM notices n LEFT JOIN companies c USING (company_id) WHERE {COUNTED})
SELECT coalesce(min(k.name), min(r.employer)) AS employer, {TOTALS} FROM r LEFT JOIN companies k ON r.canon = k.company_id
GROUP BY coalesce(CAST(canon AS VARCHAR), employer) ORDER BY layoff_total DESC, employer LIMIT 25"""


@query("agg06_top_employers", TOP)
def top_employers(spark, sf):
    """Ranked by workers after rolling companies up to their canonical one, a single hop."""
    c = companies(spark, sf)
    rows = counted(notices(spark, sf)).join(c.select("company_id", "canonical_company_id"), "company_id", "left")
    canon = F.coalesce("canonical_company_id", "company_id")
    names = c.select(F.col("company_id").alias("canon"), F.col("name").alias("canon_name"))
    rows = rows.withColumn("canon", canon).groupBy("canon", F.when(canon.isNull(), F.col("employer")).alias("own")).agg(F.min("employer").alias("any_employer"), *totals())
    rows = rows.join(names, "canon", "left")
    key = F.coalesce(F.col("canon").cast("string"), "own")
    top = rows.groupBy(key.alias("key")).agg(F.coalesce(F.min("canon_name"), F.min("any_employer")).alias("employer"), F.sum("notice_count").alias("notice_count"), F.sum("layoff_total").alias("layoff_total"))
    return top.orderBy(F.desc("layoff_total"), "employer").limit(25).drop("key")


_IND = f"""{NC}, s AS (SELECT left(c.naics_code, 3) AS code, {TOTALS} FROM notices n JOIN companies c USING (company_id) WHERE {COUNTED} AND c.naics_code IS NOT NULL GROUP BY 1),
t AS (SELECT *, {SECTOR.format(c='left(code, 2)')} AS sector FROM s)"""


def _subsectors(spark, sf):
    c = companies(spark, sf).where("naics_code is not null").select("company_id", F.substring("naics_code", 1, 3).alias("code"))
    rows = counted(notices(spark, sf)).join(c, "company_id").groupBy("code").agg(*totals())
    return rows.withColumn("sector", naics.sector_of(F.col("code"))).where("sector is not null and length(code) = 3")


@query("agg07_industries", f"""{_IND} SELECT sector, {SECTOR_NAME} AS name, CAST(sum(notice_count) AS BIGINT) AS notice_count, CAST(sum(layoff_total) AS BIGINT) AS layoff_total,
  string_agg(code || ':' || notice_count || ':' || layoff_total, ',' ORDER BY notice_count DESC, code) AS subsectors FROM t WHERE sector IS NOT NULL GROUP BY sector""")
def industries(spark, sf):
    sub = F.array_sort(F.collect_list(F.struct((-F.col("notice_count")).alias("less"), "code", "notice_count", "layoff_total")))
    rows = _subsectors(spark, sf).groupBy("sector").agg(F.sum("notice_count").alias("notice_count"), F.sum("layoff_total").alias("layoff_total"), sub.alias("subs"))
    return rows.select("sector", naics.sector_name(F.col("sector")).alias("name"), "notice_count", "layoff_total", F.array_join(F.transform("subs", lambda s: F.concat_ws(":", s["code"], s["notice_count"].cast("string"), s["layoff_total"].cast("string"))), ",").alias("subsectors"))


_INDM = f"""{NC}, x AS (SELECT strftime(notice_date, '%Y-%m') AS month, coalesce({SECTOR.format(c='left(c.naics_code, 2)')}, 'unclassified') AS sector, n.*
  FROM notices n LEFT JOIN companies c USING (company_id) WHERE {COUNTED} AND notice_date IS NOT NULL)"""


def _industry_months(spark, sf):
    c = companies(spark, sf).select("company_id", F.col("naics_code").alias("code"))
    rows = counted(notices(spark, sf)).where("notice_date is not null").join(c, "company_id", "left")
    sector = F.coalesce(naics.sector_of(F.col("code")), F.lit("unclassified"))
    return rows.groupBy(F.trunc("notice_date", "month").alias("first_day"), sector.alias("sector")).agg(*totals())


@query("agg08_industry_by_month", f"{_INDM} SELECT month, sector, {TOTALS} FROM x GROUP BY ALL")
def industry_months(spark, sf):
    return _industry_months(spark, sf).select(F.date_format("first_day", "yyyy-MM").alias("month"), "sector", "notice_count", "layoff_total")


@query("agg09_industry_timeline", f"""{_INDM}, m AS (SELECT month, sector, count(*) AS n FROM x GROUP BY ALL), q AS (SELECT strftime(d, '%Y-%m') AS month FROM
  (SELECT unnest(generate_series(CAST(min(month) || '-01' AS DATE), CAST(max(month) || '-01' AS DATE), INTERVAL 1 MONTH)) AS d FROM m))
  SELECT sector, string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY q.month) AS notices FROM q CROSS JOIN (SELECT DISTINCT sector FROM m) s LEFT JOIN m USING (month, sector) GROUP BY sector""")
def industry_timeline(spark, sf):
    """Each sector's series over the same months, zeros filled in: sectors times months is a small dense grid."""
    cells = _industry_months(spark, sf)
    months = cells.agg(F.sequence(F.min("first_day"), F.max("first_day"), F.expr("interval 1 month")).alias("months"))
    series = cells.groupBy("sector").agg(F.map_from_entries(F.collect_list(F.struct("first_day", "notice_count"))).alias("by_month"))
    dense = F.transform("months", lambda m: F.coalesce(F.try_element_at("by_month", m), F.lit(0)).cast("string"))
    return series.crossJoin(F.broadcast(months)).select("sector", F.array_join(dense, ",").alias("notices"))


@query("agg10_by_parent_group", f"""{NC}, r AS (SELECT coalesce(c.canonical_company_id, c.company_id) AS canon, {TOTALS} FROM notices n JOIN companies c USING (company_id) WHERE {COUNTED} GROUP BY 1),
  g AS (SELECT k.parent_group_key AS family, k.name, r.* FROM r JOIN companies k ON r.canon = k.company_id WHERE k.parent_group_key NOT LIKE 'self:%')
  SELECT family, count(*) AS members, arg_min(name, struct_pack(a := -layoff_total, b := name)) AS representative, CAST(sum(notice_count) AS BIGINT) AS notice_count, CAST(sum(layoff_total) AS BIGINT) AS layoff_total FROM g GROUP BY family HAVING count(*) >= 2""")
def by_parent_group(spark, sf):
    c = companies(spark, sf)
    canon = c.select("company_id", F.coalesce("canonical_company_id", "company_id").alias("canon"))
    own = counted(notices(spark, sf)).join(canon, "company_id").groupBy("canon").agg(*totals())
    named = own.join(c.select(F.col("company_id").alias("canon"), "name", F.col("parent_group_key").alias("family")), "canon").where("family not like 'self:%'")
    first = F.min_by("name", F.struct(-F.col("layoff_total"), F.col("name")))
    return named.groupBy("family").agg(F.count("*").alias("members"), first.alias("representative"), F.sum("notice_count").alias("notice_count"), F.sum("layoff_total").alias("layoff_total")).where("members >= 2")


@query("agg11_county_impact", f"""{NL}, g AS (SELECT l.state, trim(regexp_replace(regexp_replace(l.county, ' Co\\.?$', ' County'), '(?i) county$', '')) AS county, {TOTALS} FROM notices n JOIN locations l USING (location_id)
  WHERE {COUNTED} AND l.county IS NOT NULL AND notice_date >= DATE '2000-07-12' GROUP BY 1, 2),
  e AS (SELECT concat('S', lpad(CAST(n_nationkey AS VARCHAR), 2, '0')) AS state, 1000 + n_nationkey * 111 AS jobs FROM nation WHERE n_nationkey % 9 <> 4)
  SELECT state, county, notice_count, layoff_total, CAST(jobs AS BIGINT) AS employment_base, round_even(layoff_total / jobs * 100, 3) AS impact_pct FROM g JOIN e USING (state) WHERE layoff_total >= 10""")
def county_impact(spark, sf):
    """Workers as a share of a county's jobs over 365 days, by the worksite's state."""
    jobs = table(spark, sf, "nation").where("n_nationkey % 9 <> 4").select(F.concat(F.lit("S"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("state"), (1000 + F.col("n_nationkey") * 111).cast("long").alias("employment_base"))
    place = locations(spark, sf).where("county is not null").select("location_id", "state", text.county_name(F.col("county")).alias("county"))
    rows = counted(notices(spark, sf), after=AS_OF - datetime.timedelta(365)).drop("state").join(place, "location_id").groupBy("state", "county").agg(*totals())
    return rows.where("layoff_total >= 10").join(jobs, "state").withColumn("impact_pct", F.bround(F.col("layoff_total") / F.col("employment_base") * 100, 3))


_PLACE = f"""{NL}, p AS (SELECT round(lat, 4) AS la, round(lon, 4) AS lo, l.city, l.state AS loc_state, n.* FROM notices n JOIN locations l USING (location_id) WHERE lat IS NOT NULL AND lon IS NOT NULL AND NOT is_superseded)"""


def _placed(rows, spark, sf):
    spots = locations(spark, sf).where("lat is not null and lon is not null").select("location_id", F.round("lat", 4).cast("double").alias("lat"), F.round("lon", 4).cast("double").alias("lon"), "city", F.col("state").alias("loc_state"))
    return rows.join(spots, "location_id")


@query("agg12_map_places", f"{_PLACE} SELECT CAST(la AS DOUBLE) AS lat, CAST(lo AS DOUBLE) AS lon, min(city) || ', ' || min(loc_state) AS label, {TOTALS} FROM p GROUP BY la, lo")
def map_places(spark, sf):
    return _placed(filters.active(notices(spark, sf)), spark, sf).groupBy("lat", "lon").agg(F.concat(F.min("city"), F.lit(", "), F.min("loc_state")).alias("label"), *totals())


_CELLS = _PLACE + ", c AS (SELECT strftime(notice_date, '%Y-%m') AS month, dense_rank() OVER (ORDER BY la, lo) - 1 AS place, notice_id, layoff_count FROM p WHERE closure_category IS DISTINCT FROM 'Non-WARN' AND notice_date IS NOT NULL)"


def _cells(spark, sf):
    """Sparse place x month cells; places are numbered by position over the few distinct points, not over notices."""
    rows = _placed(counted(notices(spark, sf)).where("notice_date is not null"), spark, sf)
    cells = rows.groupBy("lat", "lon", F.date_format("notice_date", "yyyy-MM").alias("month")).agg(*totals())
    index = row_numbers(cells.select("lat", "lon").distinct(), [F.col("lat"), F.col("lon")], "number")
    return cells.join(index, ["lat", "lon"]).withColumn("place", F.col("number") - 1).drop("number")


@query("agg13_place_months", f"{_CELLS} SELECT place, month, {TOTALS} FROM c GROUP BY ALL")
def place_months(spark, sf):
    return _cells(spark, sf).select("place", "month", "notice_count", "layoff_total")


@query("agg14_place_timeline", f"{_CELLS}, y AS (SELECT left(month, 4) || '-Q' || CAST(ceil(CAST(month[6:7] AS INT) / 3) AS INT) AS period, place, {TOTALS} FROM c GROUP BY ALL) SELECT period, string_agg(CAST(place AS VARCHAR), ',' ORDER BY place) AS places, string_agg(CAST(notice_count AS VARCHAR), ',' ORDER BY place) AS notices FROM y GROUP BY period")
def place_timeline(spark, sf):
    rolled = _cells(spark, sf).groupBy(timeline.period_of(F.col("month"), "quarter").alias("period"), "place").agg(F.sum("notice_count").alias("n"))
    each = rolled.groupBy("period").agg(F.array_sort(F.collect_list(F.struct("place", "n"))).alias("cells"))
    column = lambda f: F.array_join(F.transform("cells", lambda c: c[f].cast("string")), ",")
    return each.select("period", column("place").alias("places"), column("n").alias("notices"))


@query("agg15_companies_by_layoffs", f"{NC}, t AS (SELECT company_id, {TOTALS} FROM notices WHERE {COUNTED} AND company_id IS NOT NULL GROUP BY 1) SELECT company_id, name, coalesce(notice_count, 0) AS notice_count, coalesce(layoff_total, 0) AS layoff_total FROM companies LEFT JOIN t USING (company_id) WHERE canonical_company_id IS NULL ORDER BY layoff_total DESC, company_id LIMIT 50")
def companies_list(spark, sf):
    own = counted(notices(spark, sf)).where("company_id is not null").groupBy("company_id").agg(*totals())
    rows = companies(spark, sf).where("canonical_company_id is null").select("company_id", "name").join(own, "company_id", "left").fillna(0, ["notice_count", "layoff_total"])
    return rows.orderBy(F.desc("layoff_total"), "company_id").limit(50)


@query("agg16_company_summary", f"""{NC}, r AS (SELECT coalesce(c.canonical_company_id, c.company_id) AS company, n.* FROM notices n JOIN companies c USING (company_id) WHERE {COUNTED})
  SELECT company, state, year(notice_date) AS year, CASE WHEN grouping(state) = 0 THEN 'state' WHEN grouping(year(notice_date)) = 0 THEN 'year' ELSE 'all' END AS level, {TOTALS}, min(notice_date) AS first_date, max(notice_date) AS last_date
  FROM r GROUP BY GROUPING SETS ((company), (company, state), (company, year(notice_date)))""")
def company_summary(spark, sf):
    c = companies(spark, sf).select("company_id", F.coalesce("canonical_company_id", "company_id").alias("company"))
    rows = counted(notices(spark, sf)).join(c, "company_id").withColumn("year", F.year("notice_date").cast("long"))
    sets = [[F.col("company")], [F.col("company"), F.col("state")], [F.col("company"), F.col("year")]]
    level = F.when(F.grouping("state") == 0, "state").when(F.grouping("year") == 0, "year").otherwise("all")
    return rows.groupingSets(sets, "company", "state", "year").agg(level.alias("level"), *totals(), F.min("notice_date").alias("first_date"), F.max("notice_date").alias("last_date"))


@query("agg17_company_members", f"{NC} SELECT coalesce(c.canonical_company_id, c.company_id) AS company, c.company_id AS member, count(n.notice_id) AS notice_count FROM companies c LEFT JOIN notices n ON n.company_id = c.company_id AND NOT n.is_superseded GROUP BY ALL")
def company_members(spark, sf):
    own = filters.active(notices(spark, sf)).groupBy("company_id").agg(F.count("notice_id").alias("notice_count"))
    rows = companies(spark, sf).select(F.coalesce("canonical_company_id", "company_id").alias("company"), F.col("company_id"))
    return rows.join(own, "company_id", "left").select("company", F.col("company_id").alias("member"), F.coalesce("notice_count", F.lit(0)).alias("notice_count"))


@query("agg18_scraper_status", f"{with_(RUNS)} SELECT state, count(*) AS runs, arg_max(status, struct_pack(a := started_at, b := run_id)) AS latest_status, max(started_at) AS latest, max(started_at) FILTER (status = 'ok') AS last_success, CAST(sum(rows_new) AS BIGINT) AS rows_new FROM runs GROUP BY state")
def scraper_status(spark, sf):
    latest = F.max_by("status", F.struct("started_at", "run_id"))
    return runs(spark, sf).groupBy("state").agg(F.count("*").alias("runs"), latest.alias("latest_status"), F.max("started_at").alias("latest"), F.max(F.when(F.col("status") == "ok", F.col("started_at"))).alias("last_success"), F.sum("rows_new").alias("rows_new"))


@query("agg19_coverage_start", f"""{N}, y AS (SELECT state, year(notice_date) AS y, min(notice_date) AS first FROM notices WHERE {COUNTED} AND notice_date IS NOT NULL GROUP BY 1, 2),
  w AS (SELECT *, lead(y) OVER (PARTITION BY state ORDER BY y) AS nxt FROM y) SELECT state, arg_min(first, y) AS coverage_start FROM w WHERE nxt IS NULL OR nxt = y + 1 GROUP BY state""")
def coverage_start(spark, sf):
    years = counted(notices(spark, sf)).where("notice_date is not null").groupBy("state", F.year("notice_date").alias("y")).agg(F.min("notice_date").alias("first"))
    after = F.lead("y").over(Window.partitionBy("state").orderBy("y"))
    return years.withColumn("nxt", after).where("nxt is null or nxt = y + 1").groupBy("state").agg(F.min_by("first", "y").alias("coverage_start"))


@query("agg20_state_badge", f"{N} SELECT state, CAST(coalesce(sum(layoff_count), 0) AS BIGINT) AS workers FROM notices WHERE NOT is_superseded AND scraped_at >= TIMESTAMP '2001-06-12' AND notice_date >= DATE '2001-01-10' GROUP BY state")
def state_badge(spark, sf):
    rows = filters.active(notices(spark, sf)).where(F.col("scraped_at") >= F.lit("2001-06-12").cast("timestamp")).where(F.col("notice_date") >= F.lit(AS_OF - datetime.timedelta(183)))
    return rows.groupBy("state").agg(F.coalesce(F.sum("layoff_count"), F.lit(0)).alias("workers"))


@query("agg21_state_card", f"{N}, y AS (SELECT state, year(notice_date) AS y, count(*) AS n FROM notices WHERE {COUNTED} AND year(notice_date) < 2001 GROUP BY ALL), s AS (SELECT state, string_agg(y || ':' || n, ',' ORDER BY y) AS series FROM y GROUP BY state) SELECT state, {TOTALS}, count(layoff_count) AS with_count, any_value(series) AS series FROM notices JOIN s USING (state) WHERE {COUNTED} GROUP BY state")
def state_card(spark, sf):
    rows = counted(notices(spark, sf))
    by_year = rows.groupBy("state", F.year("notice_date").alias("y")).agg(F.count("notice_id").alias("notice_count"), F.sum("layoff_count").alias("s"), F.count("layoff_count").alias("c"))
    shown = F.array_sort(F.collect_list(F.when(F.col("y") < 2001, F.struct("y", "notice_count"))))
    out = by_year.groupBy("state").agg(F.sum("notice_count").alias("notice_count"), F.coalesce(F.sum("s"), F.lit(0)).alias("layoff_total"), F.sum("c").alias("with_count"), shown.alias("shown"))
    return out.select("state", "notice_count", "layoff_total", "with_count", F.array_join(F.transform("shown", lambda x: F.concat_ws(":", x["y"].cast("string"), x["notice_count"].cast("string"))), ",").alias("series"))


@query("agg22_company_states", f"{N} SELECT company_id, count(DISTINCT state) AS states, count(DISTINCT location_id) AS sites, {TOTALS} FROM notices WHERE {COUNTED} AND company_id IS NOT NULL GROUP BY 1")
def company_states(spark, sf):
    return counted(notices(spark, sf)).where("company_id is not null").groupBy("company_id").agg(F.count_distinct("state").alias("states"), F.count_distinct("location_id").alias("sites"), *totals())


@query("agg23_sitemap_dates", f"{NC} SELECT 'state' AS kind, state AS key, max(notice_date) AS lastmod FROM notices WHERE NOT is_superseded GROUP BY state UNION ALL SELECT 'company', CAST(coalesce(canonical_company_id, company_id) AS VARCHAR), max(notice_date) FROM notices JOIN companies USING (company_id) WHERE NOT is_superseded GROUP BY 2")
def sitemap_dates(spark, sf):
    rows = filters.active(notices(spark, sf))
    canon = companies(spark, sf).select("company_id", F.coalesce("canonical_company_id", "company_id").cast("string").alias("key"))
    states = rows.groupBy(F.col("state").alias("key")).agg(F.max("notice_date").alias("lastmod")).select(F.lit("state").alias("kind"), "key", "lastmod")
    return states.union(rows.join(canon, "company_id").groupBy("key").agg(F.max("notice_date").alias("lastmod")).select(F.lit("company"), "key", "lastmod"))


@query("agg24_logo_queue", f"{NC}, r AS (SELECT coalesce(c.canonical_company_id, c.company_id) AS company, state, layoff_count, notice_id FROM notices n JOIN companies c USING (company_id) WHERE {COUNTED}) SELECT k.company_id, k.name, string_agg(DISTINCT state, ',' ORDER BY state) AS states, {TOTALS} FROM r JOIN companies k ON k.company_id = r.company WHERE k.website IS NOT NULL AND k.company_id % 2 = 1 GROUP BY ALL ORDER BY layoff_total DESC, k.company_id LIMIT 100")
def logo_queue(spark, sf):
    c = companies(spark, sf)
    canon = c.select("company_id", F.coalesce("canonical_company_id", "company_id").alias("company"))
    rows = counted(notices(spark, sf)).join(canon, "company_id").groupBy("company").agg(F.array_join(F.array_sort(F.collect_set("state")), ",").alias("states"), *totals())
    due = c.where("website is not null and company_id % 2 = 1").select(F.col("company_id").alias("company"), "name")
    return rows.join(due, "company").orderBy(F.desc("layoff_total"), "company").limit(100).select(F.col("company").alias("company_id"), "name", "states", "notice_count", "layoff_total")


@query("agg25_usage_per_key", "SELECT c_custkey AS key_id, count(event_id) AS calls FROM customer LEFT JOIN events ON user_id = c_custkey AND CAST(ts AS DATE) = DATE '2024-01-15' GROUP BY 1")
def usage_per_key(spark, sf):
    """The day belongs to the join, so keys without calls stay."""
    day = table(spark, sf, "events").where(F.col("ts").cast("date") == F.lit(datetime.date(2024, 1, 15))).groupBy(F.col("user_id").cast("long").alias("key_id")).agg(F.count("event_id").alias("calls"))
    return table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("key_id")).join(day, "key_id", "left").fillna(0, ["calls"])


@query("agg28_page_totals", f"{NL} SELECT count(*) AS total FROM notices n JOIN locations l USING (location_id) WHERE NOT is_superseded AND employer ILIKE '%1%' AND layoff_count >= 20 AND lon BETWEEN -115 AND -90 AND lat BETWEEN 26 AND 40")
def page_totals(spark, sf):
    rows = notices(spark, sf).join(locations(spark, sf).select("location_id", "lat", "lon"), "location_id")
    return filters.listed(rows, employer="1", min_layoffs=20, bbox=(-115, 26, -90, 40)).agg(F.count("*").alias("total"))


_TREE = f"{NCL}, x AS (SELECT l.state AS site_state, count(*) AS n FROM notices JOIN locations l USING (location_id) JOIN companies USING (company_id) WHERE {COUNTED} GROUP BY 1)"


@query("cli01_state_share", f"{_TREE} SELECT site_state, n AS notice_count, round_even(n / sum(n) OVER () * 100, 2) AS share, row_number() OVER (ORDER BY n DESC, site_state) AS rank FROM x")
def state_share(spark, sf):
    place = locations(spark, sf).select("location_id", F.col("state").alias("site_state"))
    rows = counted(notices(spark, sf)).join(place, "location_id").join(companies(spark, sf).select("company_id"), "company_id").groupBy("site_state").agg(F.count("*").alias("notice_count"))
    share = F.bround(F.col("notice_count") / F.sum("notice_count").over(Window.partitionBy()) * 100, 2)
    return rows.select("site_state", "notice_count", share.alias("share"), F.row_number().over(Window.orderBy(F.desc("notice_count"), "site_state")).alias("rank"))
