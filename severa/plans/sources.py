"""Parsing, dimension building, enrichment and sink queries (SRC, SNK, DIM, ENR, ATT, RAD, CLI, FN20-FN28, STR)."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from severa.operators import standing
from severa.operators.filters import active, counted
from severa.plans.adapter import COMPANIES, LOCATIONS, NC, NL, N, companies, locations, notices, table, with_
from severa.plans.registry import oracle_of, query
from severa.sources import letters, sinks, tables
from severa.staging import shared_dir

AS_OF = datetime.date(2001, 7, 12)
COUNTED = "NOT is_superseded AND closure_category IS DISTINCT FROM 'Non-WARN'"


@query("src03_changed_pages", "SELECT page_id, url FROM pages WHERE page_id % 3 <> 0 OR page_id % 6 = 3")
def changed_pages(spark, sf):
    """Pages whose content the cache lacks: the cache has a third of them, half of those with another content."""
    fetched = table(spark, sf, "pages").select("page_id", "url", F.concat(F.col("page_id").cast("string"), F.lit("|"), "html").alias("content"))
    stale = F.when(F.col("page_id") % 6 == 3, F.sha2(F.lit("old"), 256)).otherwise(F.sha2("content", 256))
    cache = fetched.where("page_id % 3 = 0").select("url", stale.alias("content_hash"))
    return sinks.changed(fetched, cache).select("page_id", "url")


@query("src05_html_links", r"""SELECT page_id, len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS links, array_to_string(regexp_extract_all(html, '<a href="([^"]*)"', 1), ' ') AS hrefs, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages""")
def html_links(spark, sf):
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return table(spark, sf, "pages").select("page_id", F.size(links).cast("long").alias("links"), F.array_join(links, " ").alias("hrefs"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("src05_html_tables", "SELECT p_partkey AS page_id, p_name AS employer, CAST(p_size AS VARCHAR) AS workers FROM part")
def read_html_tables(spark, sf):
    """Pages made of the parts' rows, read back through the HTML table parser."""
    page = F.concat(F.lit("<table><tr><td>List</td></tr><tr><th>Employer Name</th><th>Workers</th></tr><tr><td> "), "p_name", F.lit("</td><td>"), F.col("p_size").cast("string"), F.lit("</td></tr></table>"))
    rows = tables.read_html(table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), page.alias("html")))
    return rows.select("page_id", F.col("row")["employer name"].alias("employer"), F.col("row")["workers"].alias("workers"))


@query("src08_json_events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_events(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("src13_by_synonyms", "SELECT c_name AS employer, CAST(o_orderdate AS DATE) AS notice_date, CAST(1000 + o_orderkey AS BIGINT) AS layoff_count, CASE o_orderkey % 2 WHEN 0 THEN 'Closure' ELSE 'Layoff' END AS closure_category FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 5 <> 0")
def by_synonyms(spark, sf):
    return _by_synonyms(spark, sf, table(spark, sf, "orders"))


@query("src13_all_by_synonyms", oracle_of("src13_by_synonyms"))
def all_by_synonyms(spark, sf):
    return _by_synonyms(spark, sf, table(spark, sf, "orders"))


def _by_synonyms(spark, sf, orders):
    key = F.col("o_orderkey")
    raw = orders.join(table(spark, sf, "customer"), F.expr("o_custkey = c_custkey")).select(
        F.when(key % 5 != 0, F.concat(F.lit(" "), F.col("c_name"))).alias("Company  Name"), F.date_format("o_orderdate", "M/d/yyyy").alias("Date of Notice"),
        F.format_number(key + 1000, 0).alias("Number of Employees"), F.when(key % 2 == 0, "Plant Closing").otherwise("RIF").alias("Type"),
    )
    return tables.by_synonyms(raw, AS_OF).select("employer", "notice_date", "layoff_count", "closure_category")


@query("src16_series", "SELECT 'S' || n_nationkey AS series_id, '2024-0' || (n_regionkey + 1) AS period, CAST(n_nationkey AS DOUBLE) + 0.5 AS value FROM nation WHERE n_nationkey % 4 <> 3")
def series(spark, sf):
    k = F.col("n_nationkey")
    point = lambda p, v: F.concat(F.lit('{"year":"2024","period":"'), p, F.lit('","value":"'), v, F.lit('"}'))
    value = F.when(k % 4 == 3, "-").otherwise(F.concat(k.cast("string"), F.lit(".5")))
    body = F.concat(F.lit('{"Results":{"series":[{"seriesID":"S'), k.cast("string"), F.lit('","data":['), point(F.concat(F.lit("M0"), (F.col("n_regionkey") + 1).cast("string")), value), F.lit(","), point(F.lit("M13"), F.lit("9")), F.lit("]}]}}"))
    return table(spark, sf, "nation").select(F.explode(tables.series_rows(body)).alias("r")).select("r.*")


@query("src17_year_windows", "WITH s AS (SELECT s_suppkey, CAST(1980 + s_suppkey % 20 AS INT) AS a, 2024 AS b FROM supplier), w AS (SELECT s_suppkey, b, unnest(range(a, b + 1, 20)) AS y FROM s) SELECT s_suppkey, CAST(y AS INT) AS from_year, CAST(least(y + 19, b) AS INT) AS to_year FROM w")
def year_windows(spark, sf):
    first = (1980 + F.col("s_suppkey") % 20).cast("int")
    return table(spark, sf, "supplier").select("s_suppkey", F.explode(tables.year_windows(first, F.lit(2024), 20)).alias("w")).select("s_suppkey", "w.*")


@query("fn24_affected_workers", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_orderkey % 900 + 1 WHEN 1 THEN o_orderkey % 900 + 1 WHEN 2 THEN NULL WHEN 3 THEN 1000 + o_orderkey % 900 ELSE NULL END AS workers FROM orders")
def affected_workers(spark, sf):
    k, n = F.col("o_orderkey") % 5, (F.col("o_orderkey") % 900 + 1).cast("string")
    say = F.when(k == 0, F.concat(F.lit("We will lay off 7 employees, a total of "), n, F.lit(" employees.")))
    say = say.when(k == 1, F.concat(F.lit("This action will affect approximately\n"), n, F.lit(" hourly workers in May.")))
    say = say.when(k == 2, F.concat(F.lit("will affect 950 employees here and affect 951 employees there; "), n))
    say = say.when(k == 3, F.concat(F.lit("1,"), F.lpad((F.col("o_orderkey") % 900).cast("string"), 3, "0"), F.lit(" positions will be terminated."))).otherwise("Dear Sir, nothing is planned.")
    return table(spark, sf, "orders").select("o_orderkey", letters.affected_workers(say).alias("workers"))


@query("fn26_letter_fields", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS dated, CAST(10000 + o_orderkey % 80000 AS VARCHAR) AS zips FROM orders")
def letter_fields(spark, sf):
    letter = F.concat(F.lit("Re: plant, "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(". Site: 12 Main St, Town, OH "), (10000 + F.col("o_orderkey") % 80000).cast("string"), F.lit("-1234, effective January 1, 2030."))
    return table(spark, sf, "orders").select("o_orderkey", letters.first_date(letter).alias("dated"), F.array_join(letters.zip_codes(letter), ",").alias("zips"))


@query("dim01_county_jobs", f"{with_(LOCATIONS)}, e AS (SELECT s_suppkey AS i, concat('S', lpad(CAST(s_nationkey AS VARCHAR), 2, '0')) AS state, CAST(s_acctbal AS BIGINT) AS emp FROM supplier WHERE s_acctbal > 0) SELECT l.state, arg_min(emp, i) AS jobs FROM e JOIN locations l ON l.state = e.state GROUP BY 1")
def county_jobs(spark, sf):
    """The first positive count of each county in the source's order."""
    e = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("i"), F.concat(F.lit("S"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0")).alias("state"), F.round("s_acctbal").cast("long").alias("emp"))
    return e.join(locations(spark, sf).select("state"), "state").groupBy("state").agg(F.min_by("emp", "i").alias("jobs"))


@query("dim04_staffing", "WITH p AS (SELECT p_brand AS sector, p_type AS occ, count(*) AS n FROM part GROUP BY ALL), s AS (SELECT *, round(100.0 * n / sum(n) OVER (PARTITION BY sector), 4) AS pct FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY pct DESC, occ) AS i FROM s) SELECT sector, string_agg(occ, ',' ORDER BY i) AS top, count(*) AS n FROM r WHERE i <= 4 AND pct >= 0.5 GROUP BY 1")
def staffing(spark, sf):
    p = table(spark, sf, "part").groupBy(F.col("p_brand").alias("sector"), F.col("p_type").alias("occ")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("sector")
    s = p.withColumn("pct", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(w), 4))
    s = s.withColumn("i", F.row_number().over(w.orderBy(F.desc("pct"), "occ"))).where("i <= 4 and pct >= 0.5")
    return s.groupBy("sector").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "occ"))), lambda x: x["occ"]), ",").alias("top"), F.count("*").alias("n"))


@query("dim05_zip_centroids", "WITH g AS (SELECT c_nationkey AS zip, avg(c_acctbal) AS lat FROM customer GROUP BY 1), c AS (SELECT s_nationkey AS zip, max(s_acctbal) AS lat FROM supplier WHERE s_suppkey % 3 = 0 GROUP BY 1) SELECT zip, round(coalesce(c.lat, g.lat), 4) AS lat, CASE WHEN c.lat IS NOT NULL THEN 'census' ELSE 'names' END AS source FROM g FULL JOIN c USING (zip)")
def zip_centroids(spark, sf):
    g = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("zip")).agg(F.avg("c_acctbal").alias("g"))
    c = table(spark, sf, "supplier").where("s_suppkey % 3 = 0").groupBy(F.col("s_nationkey").alias("zip")).agg(F.max("s_acctbal").alias("c"))
    return g.join(c, "zip", "full_outer").select("zip", F.round(F.coalesce("c", "g"), 4).alias("lat"), F.when(F.col("c").isNotNull(), "census").otherwise("names").alias("source"))


@query("enr01_cascade", f"{with_(COMPANIES)}, sib AS (SELECT parent_group_key AS k, min(naics_code) AS code FROM companies WHERE enriched AND naics_code IS NOT NULL AND parent_group_key NOT LIKE 'self:%' GROUP BY 1 HAVING count(DISTINCT naics_code) = 1), dom AS (SELECT website AS w, min(naics_code) AS code FROM companies WHERE enriched AND naics_code IS NOT NULL AND website IS NOT NULL GROUP BY 1) SELECT company_id, coalesce(c.naics_code, sib.code, dom.code) AS code, CASE WHEN c.naics_code IS NOT NULL THEN 'own' WHEN sib.code IS NOT NULL THEN 'sibling' WHEN dom.code IS NOT NULL THEN 'domain' ELSE 'miss' END AS source FROM companies c LEFT JOIN sib ON sib.k = c.parent_group_key LEFT JOIN dom ON dom.w = c.website")
def cascade(spark, sf):
    """The first tier with an answer, and which it was; a miss is recorded, not enriched."""
    c = companies(spark, sf)
    known = c.where("enriched and naics_code is not null")
    sib = known.where("parent_group_key not like 'self:%'").groupBy("parent_group_key").agg(F.min("naics_code").alias("s"), F.count_distinct("naics_code").alias("k")).where("k = 1").drop("k")
    dom = known.where("website is not null").groupBy("website").agg(F.min("naics_code").alias("d"))
    rows = c.join(sib, "parent_group_key", "left").join(dom, "website", "left")
    source = F.when(F.col("naics_code").isNotNull(), "own").when(F.col("s").isNotNull(), "sibling").when(F.col("d").isNotNull(), "domain").otherwise("miss")
    return rows.select("company_id", F.coalesce("naics_code", "s", "d").alias("code"), source.alias("source"))


@query("enr03_reset_by_source", f"{with_(COMPANIES)} SELECT CASE WHEN company_id % 3 = 0 THEN 'edgar' ELSE 'provider' END AS source, count(*) AS n, count(*) FILTER (enriched) AS was, count(*) FILTER (enriched AND company_id % 3 <> 0) AS now FROM companies GROUP BY 1")
def reset_by_source(spark, sf):
    c = companies(spark, sf).withColumn("source", F.when(F.col("company_id") % 3 == 0, "edgar").otherwise("provider"))
    return c.groupBy("source").agg(F.count("*").alias("n"), F.count_if("enriched").alias("was"), F.count_if(F.col("enriched") & (F.col("source") != "edgar")).alias("now"))


@query("rad01_radar_rows", f"{NC}, o AS (SELECT p_type AS k, string_agg(p_brand, ',' ORDER BY p_brand) AS top FROM (SELECT DISTINCT p_type, p_brand FROM part WHERE p_brand LIKE '%1') GROUP BY 1) SELECT notice_id, effective_date - DATE '2001-07-12' AS days_until, CASE WHEN layoff_count % 2 = 0 THEN 'filed' WHEN n.naics_code IS NOT NULL THEN 'typical' ELSE 'none' END AS source FROM notices n WHERE NOT is_superseded AND effective_date >= DATE '2001-07-12'")
def radar_rows(spark, sf):
    """Occupations as filed win over what is typical of the industry."""
    rows = active(notices(spark, sf)).where(F.col("effective_date") >= F.lit(AS_OF))
    source = F.when(F.col("layoff_count") % 2 == 0, "filed").when(F.col("naics_code").isNotNull(), "typical").otherwise("none")
    return rows.select("notice_id", F.datediff("effective_date", F.lit(AS_OF)).cast("long").alias("days_until"), source.alias("source"))


@query("cli02_monthly_mean", f"{N}, m AS (SELECT strftime(notice_date, '%Y-%m') AS m, CAST(sum(layoff_count) AS DOUBLE) AS w FROM notices WHERE {COUNTED} AND notice_date IS NOT NULL GROUP BY 1) SELECT round(avg(w), 4) AS mean_workers, count(*) AS months FROM m")
def monthly_mean(spark, sf):
    m = counted(notices(spark, sf)).where("notice_date is not null").groupBy(F.date_format("notice_date", "yyyy-MM").alias("m")).agg(F.sum("layoff_count").alias("w"))
    return m.agg(F.round(F.avg("w"), 4).alias("mean_workers"), F.count("*").alias("months"))


@query("cli03_bounding_box", f"{NL} SELECT state, CAST(min(lat) AS DOUBLE) AS south, CAST(max(lat) AS DOUBLE) AS north, CAST(min(lon) AS DOUBLE) AS west, CAST(max(lon) AS DOUBLE) AS east FROM (SELECT n.state, l.lat, l.lon FROM notices n JOIN locations l USING (location_id) WHERE NOT is_superseded) GROUP BY 1")
def bounding_box(spark, sf):
    place = locations(spark, sf).select("location_id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    return active(notices(spark, sf)).join(place, "location_id").groupBy("state").agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"))


@query("fn21_states_reporting", f"{N}, s AS (SELECT state, min(notice_date) AS start FROM notices WHERE {COUNTED} AND location_id = 3 GROUP BY 1), y AS (SELECT unnest(range(1995, 2002)) AS y) SELECT y AS year, count(s.state) AS states FROM y LEFT JOIN s ON year(start) <= y GROUP BY 1")
def states_reporting(spark, sf):
    start = counted(notices(spark, sf)).where("location_id = 3").groupBy("state").agg(F.min("notice_date").alias("start"))
    by_year = start.groupBy(F.year("start").alias("y")).agg(F.count("*").alias("n"))
    years = by_year.agg(F.map_from_entries(F.collect_list(F.struct("y", "n"))).alias("m"))
    return years.select("m", F.explode(F.sequence(F.lit(1995), F.lit(2001))).alias("year")).select(F.col("year").cast("long").alias("year"), F.aggregate(F.map_values(F.map_filter("m", lambda k, _: k <= F.col("year"))), F.lit(0).cast("long"), lambda a, x: a + x).alias("states"))


@query("fn28_scope_labels", "SELECT s_suppkey, concat_ws(' · ', CASE WHEN s_suppkey % 2 = 0 THEN 'S' || s_nationkey END, CASE WHEN s_suppkey % 3 = 0 THEN 'Closure' END, CASE WHEN s_suppkey % 5 = 0 THEN '≥ ' || s_suppkey || ' workers' END, CASE WHEN s_suppkey % 30 NOT IN (0) AND s_suppkey % 2 <> 0 AND s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0 THEN 'All notices' END) AS label FROM supplier")
def scope_labels(spark, sf):
    k = F.col("s_suppkey")
    parts = [F.when(k % 2 == 0, F.concat(F.lit("S"), F.col("s_nationkey").cast("string"))), F.when(k % 3 == 0, "Closure"), F.when(k % 5 == 0, F.concat(F.lit("≥ "), k.cast("string"), F.lit(" workers")))]
    label = F.concat_ws(" · ", *parts)
    return table(spark, sf, "supplier").select("s_suppkey", F.when(label == "", "All notices").otherwise(label).alias("label"))


@query("ext05_public_columns", f"{N} SELECT notice_id, state, employer, notice_date, layoff_count FROM notices WHERE NOT is_superseded AND state = 'S01'")
def public_columns(spark, sf):
    rows = active(notices(spark, sf)).where("state = 'S01'").select("notice_id", "state", "employer", "notice_date", "layoff_count", "address")
    return rows.select(*sinks.columns_for("public", rows.columns))


@query("str01_since_watermark", f"{N}, s AS (SELECT s_suppkey AS sub_id, TIMESTAMP '2001-06-01' + to_days(CAST(s_suppkey % 30 AS INT)) AS seen FROM supplier) SELECT sub_id, count(notice_id) AS fresh, max(scraped_at) AS next_seen FROM s LEFT JOIN notices ON scraped_at > seen AND NOT is_superseded AND notice_date >= DATE '2001-01-10' GROUP BY 1")
def since_watermark(spark, sf):
    return _unseen(spark, sf, table(spark, sf, "supplier"))


@query("str01_all_subscriptions", oracle_of("str01_since_watermark"))
def all_since_watermark(spark, sf):
    return _unseen(spark, sf, table(spark, sf, "supplier"))


def _unseen(spark, sf, suppliers):
    """What each subscription has not yet seen, and the mark to move to."""
    subs = suppliers.select(F.col("s_suppkey").alias("sub_id"), F.timestamp_add("DAY", (F.col("s_suppkey") % 30).cast("int"), F.lit("2001-06-01").cast("timestamp")).alias("seen"))
    new = active(notices(spark, sf)).where(F.col("notice_date") >= F.lit(datetime.date(2001, 1, 10)))
    return standing.since_marks(subs, new, "scraped_at")


@query("str04_double_window", f"{N} SELECT notice_id FROM notices WHERE NOT is_superseded AND scraped_at BETWEEN TIMESTAMP '2000-07-01' AND TIMESTAMP '2000-07-12' AND notice_date >= DATE '2000-06-01'")
def double_window(spark, sf):
    rows = active(notices(spark, sf)).where(F.col("scraped_at").between(F.lit("2000-07-01").cast("timestamp"), F.lit("2000-07-12").cast("timestamp")))
    return rows.where(F.col("notice_date") >= F.lit(datetime.date(2000, 6, 1))).select("notice_id")


@query("str07_daily_counts", "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS calls FROM events GROUP BY ALL")
def daily_counts(spark, sf):
    """The streaming roll-up over the events as a table; tests run it as a stream."""
    from severa.streaming.streams import daily_counts as counts

    return counts(table(spark, sf, "events"), "user_id").select("user_id", F.col("day.start").cast("date").alias("day"), "calls")


_LIMIT = 3600 * 12
_LIMITED = f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
  r AS (SELECT user_id, i, event_id, true AS allowed, [t] AS times FROM e WHERE i = 1
    UNION ALL SELECT user_id, i, event_id, len(kept) < 2, CASE WHEN len(kept) < 2 THEN list_append(kept, t) ELSE kept END FROM (SELECT e.*, list_filter(r.times, lambda x: x > e.t - {_LIMIT}) AS kept FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1))
  SELECT CAST(user_id AS BIGINT) AS key, CAST(event_id AS BIGINT) AS event_id, allowed FROM r"""


def _calls(spark, sf):
    return table(spark, sf, "events").select("user_id", F.col("event_id").cast("long").alias("event_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))


@query("str06_rate_limiter", _LIMITED)
def rate_limiter(spark, sf):
    from severa.streaming.streams import limited

    return limited(_calls(spark, sf), "user_id", 2, _LIMIT)


@query("str06_limiter_stream", _LIMITED)
def limiter_stream(spark, sf):
    """The limiter as a stream that is stopped and started again from its checkpoint twice."""
    from severa.streaming.streams import limited, run_in_steps

    rows = _calls(spark, sf)
    ends = rows.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    third = F.least(F.lit(2), F.floor((F.col("t") - ends["a"]) / ((ends["b"] - ends["a"]) / 3)))
    folder = f"{shared_dir(spark)}/limiter-{uuid.uuid4().hex}"
    return run_in_steps([rows.where(third == i) for i in range(3)], lambda source: limited(source, "user_id", 2, _LIMIT), folder)
