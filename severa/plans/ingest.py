"""Queries over files as sources give them, the sinks' outputs read back, dimensions, streaming rules in table form, and
the evaluation of models (SRC, SNK, STR, EXT, DIM, ENR, ATT, ML)."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from severa.functions import text
from severa.operators import enrich, events as ev, filters, linkage, models, places, validate
from severa.operators.filters import counted, totals
from severa.operators.ranking import equal_bins
from severa.plans.adapter import COMPANIES, LOCATIONS, NC, RUNS, N, companies, locations, notices, runs, table, with_
from severa.plans.events import _EV, _SCORED, _events, _scored, average_precision, precision_at_top
from severa.plans.registry import oracle_of, query
from severa.sources import extracted, letters, sinks, tables
from severa.staging import shared_dir, stage

AS_OF = datetime.date(2001, 7, 12)
COUNTED = "NOT is_superseded AND closure_category IS DISTINCT FROM 'Non-WARN'"
TOTALS = "count(notice_id) AS notice_count, CAST(coalesce(sum(layoff_count), 0) AS BIGINT) AS layoff_total"


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- sources ---------------------------------------------------------------------------------------------------------

_FILED = "f AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day, o_orderkey % 900 + 1 AS n FROM orders)"


def _filed(spark, sf):
    """Filings of customers: the rows that files are made of."""
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"), (F.col("o_orderkey") % 900 + 1).alias("n"))


def _files(spark, sf):
    """A file for each customer: a page with a table for even ones, delimited text for odd ones."""
    name, day, n = F.concat(F.lit("Firm "), F.col("o_orderkey").cast("string")), F.date_format("day", "MM/dd/yyyy"), F.col("n").cast("string")
    html = F.concat(F.lit("<tr><td>"), name, F.lit("</td><td>"), day, F.lit("</td><td>"), n, F.lit("</td></tr>"))
    lines = F.concat_ws(",", F.concat(F.lit('"'), name, F.lit('"')), day, n)
    files = _filed(spark, sf).groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list(html)), "").alias("html"), F.array_join(F.array_sort(F.collect_list(lines)), "\n").alias("lines"))
    even = F.col("o_custkey") % 2 == 0
    page = F.concat(F.lit("<html><table><tr><th>Employer</th><th>Notice Date</th><th>Number Affected</th></tr>"), "html", F.lit("</table></html>"))
    content = F.when(even, page).otherwise(F.concat(F.lit("Employer,Notice Date,Number Affected\n"), "lines"))
    return files.select(F.when(even, "AL").otherwise("KY").alias("state"), F.col("o_custkey").cast("string").alias("path"), content.cast("binary").alias("content"))


@query("src01_parsed_files", f"WITH {_FILED} SELECT CASE WHEN o_custkey % 2 = 0 THEN 'AL' ELSE 'KY' END AS state, CAST(o_custkey AS VARCHAR) AS path, 'Firm ' || o_orderkey AS employer, day AS notice_date, n AS layoff_count FROM f")
def parsed_files(spark, sf):
    """Files of two formats, each through its state's parser, then typed."""
    rows = tables.parse_files(_files(spark, sf)).select("state", "path", F.col("row.employer").alias("employer"), F.col("row")["notice date"].alias("d"), F.col("row")["number affected"].alias("n"))
    return rows.select("state", "path", "employer", text.as_date(F.col("d"), AS_OF).alias("notice_date"), text.as_int(F.col("n")).alias("layoff_count"))


@query("src02_registry", f"WITH {_FILED} SELECT CASE WHEN o_custkey % 2 = 0 THEN 'AL' ELSE 'KY' END AS state, count(DISTINCT o_custkey) AS files, count(*) AS rows FROM f GROUP BY 1")
def registry_counts(spark, sf):
    rows = tables.parse_files(_files(spark, sf).where(F.col("state").isin(*tables.states())))
    return rows.groupBy("state").agg(F.count_distinct("path").alias("files"), F.count("*").alias("rows"))


@query("src04_kept_cache", f"{with_(RUNS)}, l AS (SELECT state, max_by(status, struct_pack(a := started_at, b := run_id)) AS status FROM runs GROUP BY 1) SELECT run_id FROM runs JOIN l USING (state) WHERE l.status <> 'parse_failed'")
def kept_cache(spark, sf):
    """What stays of a page cache after the pages of states whose last run failed are dropped."""
    rows = runs(spark, sf)
    failed = rows.groupBy("state").agg(F.max_by("status", F.struct("started_at", "run_id")).alias("last")).where("last = 'parse_failed'").select("state")
    return rows.join(failed, "state", "left_anti").select("run_id")


@query("src06_workbooks", f"WITH {_FILED} SELECT CAST(o_custkey AS VARCHAR) AS path, 'Firm ' || o_orderkey AS company, CAST(n AS VARCHAR) AS affected FROM f")
def workbooks(spark, sf):
    """Workbooks whose headers float under a title."""
    rows = _filed(spark, sf).select(F.col("o_custkey").cast("string").alias("path"), F.concat(F.lit("Firm "), F.col("o_orderkey").cast("string")).alias("Company"), F.col("n").cast("string").alias("Affected"))
    books = extracted.workbooks(rows, "path", ["Company", "Affected"], title="Notices received").withColumn("state", F.lit("CA"))
    return tables.parse_files(books).select("path", F.col("row.company").alias("company"), F.col("row.affected").alias("affected"))


@query("src07_delimited", f"WITH {_FILED} SELECT 'Firm; ' || o_orderkey AS employer, day AS notice_date, 1000 + n AS layoff_count FROM f")
def delimited(spark, sf):
    """Semicolon files with quoted separators and thousands commas, by the synonyms of their headers."""
    path = _folder(spark, "delimited")
    rows = _filed(spark, sf).select(F.concat(F.lit("Firm; "), F.col("o_orderkey").cast("string")).alias("Company Name"), F.date_format("day", "M/d/yyyy").alias("WARN Date"), F.concat(F.lit("1,"), F.lpad(F.col("n").cast("string"), 3, "0")).alias("Employees Affected"))
    rows.write.option("header", True).option("sep", ";").csv(path)
    return tables.read_delimited(spark, path, AS_OF, ";").select("employer", "notice_date", "layoff_count")


@query("src09_text_tables", f"WITH {_FILED} SELECT o_custkey AS page, 'Firm ' || o_orderkey AS company, day AS notice_date, n AS layoff_count FROM f")
def text_tables(spark, sf):
    """Tables of fixed columns in text taken out of documents, under a heading and with a running foot."""
    line = F.concat(F.rpad(F.concat(F.lit("Firm "), F.col("o_orderkey").cast("string")), 40, " "), F.rpad(F.date_format("day", "MM/dd/yyyy"), 16, " "), F.col("n").cast("string"))
    pages = _filed(spark, sf).groupBy(F.col("o_custkey").alias("page")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))
    head = F.concat(F.lit("WARN Notices received\n\n"), F.rpad(F.lit("Company"), 40, " "), F.rpad(F.lit("Notice Date"), 16, " "), F.lit("Affected\n"))
    rows = extracted.column_rows(pages.select("page", F.concat(head, "lines", F.lit("\nPage 1 of 1")).alias("text")), "page", "text", ("company", "notice date", "affected"))
    return rows.select("page", "company", text.as_date(F.col("notice date"), AS_OF).alias("notice_date"), text.as_int(F.col("affected")).alias("layoff_count")).where("notice_date is not null")


def _listing(spark, sf):
    """Search pages of a job board's notices, and detail pages of two thirds of them."""
    f = _filed(spark, sf)
    k = F.col("o_orderkey").cast("string")
    row = F.concat(F.lit('<tr><td><a href="/notice/'), k, F.lit('">Firm &amp; '), k, F.lit("</a></td><td>"), F.date_format("day", "MM/dd/yyyy"), F.lit("</td></tr>"))
    pages = f.groupBy(F.col("o_custkey").alias("page")).agg(F.concat(F.lit("<table><tr><th>Employer</th><th>Date</th></tr>"), F.array_join(F.collect_list(row), ""), F.lit("</table>")).alias("html"))
    detail = F.concat(F.lit("<dl><dt>Number of Employees Affected:</dt><dd> "), F.col("n").cast("string"), F.lit(" </dd><dt>City</dt><dd>Town"), F.col("o_custkey") % 7, F.lit("</dd></dl>"))
    details = f.where("o_orderkey % 3 <> 0").select(F.concat(F.lit("/notice/"), k).alias("url"), detail.alias("html"))
    return pages, details


@query("src10_listing_with_details", f"WITH {_FILED} SELECT '/notice/' || o_orderkey AS url, 'Firm & ' || o_orderkey AS employer, day AS notice_date, CASE WHEN o_orderkey % 3 <> 0 THEN n END AS layoff_count, CASE WHEN o_orderkey % 3 <> 0 THEN 'Town' || (o_custkey % 7) END AS city FROM f")
def listing_with_details(spark, sf):
    """Rows of search pages, filled in from their detail pages where there are some."""
    pages, details = _listing(spark, sf)
    fields = details.select("url", extracted.fields(F.col("html")).alias("f")).select("url", text.as_int(F.col("f")["number of employees affected"]).alias("layoff_count"), F.col("f.city").alias("city"))
    rows = extracted.listing(pages, "html").select("url", F.col("name").alias("employer"), text.as_date(F.col("cells")[0], AS_OF).alias("notice_date"))
    return rows.join(fields, "url", "left")


@query("src11_detail_fields", f"WITH {_FILED} SELECT '/notice/' || o_orderkey AS url, unnest([{{'k': 'city', 'v': 'Town' || (o_custkey % 7)}}, {{'k': 'number of employees affected', 'v': CAST(n AS VARCHAR)}}], recursive := true) FROM f WHERE o_orderkey % 3 <> 0")
def detail_fields(spark, sf):
    _, details = _listing(spark, sf)
    return details.select("url", F.explode(extracted.fields(F.col("html"))).alias("k", "v"))


@query("src12_bundles", "SELECT page_id // 50 AS bundle, 'p' || lpad(CAST(page_id AS VARCHAR), 8, '0') || '.html' AS member, CAST(strlen(html) AS BIGINT) AS bytes FROM pages")
def bundles(spark, sf):
    """Gzipped bundles of fifty pages each, and their members again."""
    pages = table(spark, sf, "pages").select((F.col("page_id") / 50).cast("long").alias("bundle"), F.concat(F.lit("p"), F.lpad(F.col("page_id").cast("string"), 8, "0"), F.lit(".html")).alias("member"), F.col("html").cast("binary").alias("content"))
    return extracted.members(extracted.bundle(pages, "bundle"), "bundle").select("bundle", "member", F.octet_length("content").cast("long").alias("bytes"))


@query("src14_backfill_log", f"{N} SELECT coalesce(CAST(year(notice_date) AS VARCHAR), 'undated') AS batch, count(*) AS rows, CASE WHEN avg(CASE WHEN notice_date IS NULL THEN 1.0 ELSE 0 END) > 0.1 THEN 'backfill_invalid' ELSE 'backfill_ok' END AS status FROM notices GROUP BY 1")
def backfill_log(spark, sf):
    """How each year's batch of history ends."""
    rows = notices(spark, sf).withColumn("batch", F.coalesce(F.year("notice_date").cast("string"), F.lit("undated")))
    return enrich.batch_log(validate.batch_gate(rows, ["batch"], 1, 10**9), ["batch"])


@query("src15_backfill_union", "SELECT 'bundled' AS origin, count(*) AS n FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT 'urls', count(*) FROM pages WHERE page_id % 2 = 1 UNION ALL SELECT 'year ' || year(o_orderdate), count(*) FROM orders GROUP BY year(o_orderdate)")
def backfill_union(spark, sf):
    """History from bundles, from a list of URLs and year by year, as one table."""
    p, o = table(spark, sf, "pages"), table(spark, sf, "orders")
    parts = {"bundled": p.where("page_id % 2 = 0").select(F.col("page_id").alias("id")), "urls": p.where("page_id % 2 = 1").select(F.col("page_id").alias("id"))}
    by_year = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("year "), F.year("o_orderdate").cast("string")).alias("origin"))
    return enrich.labelled_union(parts).unionByName(by_year).groupBy("origin").agg(F.count("*").alias("n"))


@query("src18_snapshot_rows", f"{NC} SELECT notice_id, employer, c.name AS company, c.naics_code AS naics FROM notices LEFT JOIN companies c USING (company_id)")
def snapshot_rows(spark, sf):
    """Notices with their company nested, through lines of JSON and back."""
    c = companies(spark, sf).select("company_id", F.struct("name", F.col("naics_code").alias("naics")).alias("company"))
    lines = notices(spark, sf).join(c, "company_id", "left").select(F.to_json(F.struct("notice_id", "employer", "company")).alias("line"))
    schema = "notice_id bigint, employer string, company struct<name:string, naics:string>"
    return lines.select(F.from_json("line", schema).alias("r")).select("r.notice_id", "r.employer", F.col("r.company.name").alias("company"), F.col("r.company.naics").alias("naics"))


@query("src19_notice_frame", f"{NC} SELECT notice_id, state, notice_date, layoff_count, c.parent_group_key AS family, c.confidence FROM notices LEFT JOIN companies c USING (company_id)")
def notice_frame(spark, sf):
    c = companies(spark, sf).select("company_id", F.col("parent_group_key").alias("family"), "confidence")
    return notices(spark, sf).join(c, "company_id", "left").select("notice_id", "state", "notice_date", "layoff_count", "family", "confidence")


@query("src20_json_dimension", f"{with_(LOCATIONS)} SELECT state || '|' || city AS key, 1000 + location_id AS jobs FROM locations")
def json_dimension(spark, sf):
    """A dimension kept as compressed JSON, one map a state, loaded as rows."""
    path = _folder(spark, "dimension")
    maps = locations(spark, sf).groupBy("state").agg(F.map_from_entries(F.collect_list(F.struct("city", 1000 + F.col("location_id")))).alias("jobs"))
    maps.write.option("compression", "gzip").json(path)
    return spark.read.schema("state string, jobs map<string,bigint>").json(path).select("state", F.explode("jobs").alias("city", "jobs")).select(F.concat_ws("|", "state", "city").alias("key"), "jobs")


# --- sinks -----------------------------------------------------------------------------------------------------------


@query("snk01_mirror", f"{N}, r AS (SELECT count(*) AS rows, CAST(sum(layoff_count) AS BIGINT) AS workers FROM notices) SELECT unnest(['csv', 'parquet']) AS format, rows, workers FROM r")
def mirror(spark, sf):
    """Both forms of the public mirror, read back."""
    path = _folder(spark, "mirror")
    rows = notices(spark, sf).select("notice_id", "employer", "layoff_count")
    sinks.mirror(rows, path)
    csv = spark.read.option("header", True).schema(rows.schema).csv(f"{path}/csv").withColumn("format", F.lit("csv"))
    both = csv.unionByName(spark.read.parquet(f"{path}/parquet").withColumn("format", F.lit("parquet")))
    return both.groupBy("format").agg(F.count("*").alias("rows"), F.sum("layoff_count").alias("workers"))


@query("snk02_snapshots", f"{N} SELECT '2001-07-11' AS day, count(*) AS rows FROM notices WHERE notice_id % 50 <> 1 UNION ALL SELECT '2001-07-12', count(*) FROM notices")
def snapshots(spark, sf):
    path = _folder(spark, "snapshots")
    rows = stage(notices(spark, sf).select("notice_id", "state"), "notices")  # read six times
    sinks.snapshot(rows.where("notice_id % 50 <> 1"), path, "2001-07-11")
    for _ in range(2):  # a day written again replaces itself
        sinks.snapshot(rows, path, "2001-07-12")
    return spark.read.parquet(path).groupBy(F.col("snapshot_date").cast("string").alias("day")).agg(F.count("*").alias("rows"))


@query("snk03_capped_rows", f"{N} SELECT notice_id, employer, notice_date FROM notices WHERE NOT is_superseded ORDER BY notice_date DESC NULLS LAST, notice_id LIMIT 1000")
def capped_rows(spark, sf):
    """The rows that a public export may stream: the newest thousand, without contact data."""
    rows = filters.active(notices(spark, sf)).select("notice_id", "employer", "notice_date", "address", "scraped_at")
    return sinks.capped(rows.orderBy(F.desc_nulls_last("notice_date"), "notice_id"), "public")


@query("snk04_report_files", f"{N} SELECT state, {TOTALS} FROM notices WHERE {COUNTED} GROUP BY 1")
def report_files(spark, sf):
    """A JSON report for each state, put in place whole, read back."""
    path = _folder(spark, "reports")
    report = counted(notices(spark, sf)).groupBy("state").agg(*totals())
    for _ in range(2):
        sinks.replace_json(report, path, "state")
    return spark.read.schema("state string, notice_count bigint, layoff_total bigint").json(path)


@query("snk05_feed_items", f"{N}, t AS (SELECT * FROM notices WHERE NOT is_superseded AND notice_date IS NOT NULL ORDER BY notice_date DESC, notice_id LIMIT 50) SELECT notice_id, '<item><title>' || employer || ' &amp; sites, ' || state || '</title><guid isPermaLink=\"false\">' || notice_id || '</guid><pubDate>' || strftime(notice_date, '%a, %d %b %Y') || ' 00:00:00 GMT</pubDate></item>' AS item FROM t")
def feed_items(spark, sf):
    rows = filters.active(notices(spark, sf)).where("notice_date is not null").orderBy(F.desc("notice_date"), "notice_id").limit(50)
    return rows.select("notice_id", sinks.feed_item(F.concat("employer", F.lit(" & sites, "), "state"), F.col("notice_id").cast("string"), F.col("notice_date")).alias("item"))


@query("snk08_gauges", f"""{with_(RUNS)} SELECT 'runs_total{{state="' || state || '",status="' || status || '"}} ' || count(*) AS line FROM runs GROUP BY state, status UNION ALL SELECT 'rows_new_total{{state="' || state || '"}} ' || CAST(sum(rows_new) AS BIGINT) FROM runs GROUP BY state""")
def gauges(spark, sf):
    """Grouped counts as the lines that a metrics scraper reads."""
    rows = runs(spark, sf)
    by_status = rows.groupBy("state", "status").agg(F.count("*").alias("v")).select(sinks.gauge("runs_total", F.col("v"), state=F.col("state"), status=F.col("status")).alias("line"))
    return by_status.union(rows.groupBy("state").agg(F.sum("rows_new").alias("v")).select(sinks.gauge("rows_new_total", F.col("v"), state=F.col("state")).alias("line")))


@query("snk09_metric_rows", f"{with_(RUNS)}, m AS (SELECT 'rate' AS metric, round(avg(CASE WHEN status = 'ok' THEN 1.0 ELSE 0.0 END), 9) AS value FROM runs) SELECT metric, 2 AS version, value FROM m")
def metric_rows(spark, sf):
    """Metrics of every training appended to a table; the latest version is what is served."""
    path = _folder(spark, "metrics")
    value = runs(spark, sf).agg(F.round(F.avg((F.col("status") == "ok").cast("double")), 9).alias("value"))
    for version in (1, 2):
        sinks.append_metrics(value, path, "rate", version)
    return spark.read.parquet(path).groupBy("metric").agg(F.max("version").alias("version"), F.max_by("value", "version").alias("value"))


@query("snk10_post_ledger", f"{N}, c AS (SELECT DISTINCT notice_id FROM notices WHERE NOT is_superseded AND layoff_count >= 45) SELECT 'a' AS platform, 0 AS left_to_post FROM c WHERE false UNION ALL SELECT 'b', count(*) FROM c")
def post_ledger(spark, sf):
    """After a run on one platform nothing is left to post there, and all on the other."""
    path = _folder(spark, "ledger")
    candidates = filters.active(notices(spark, sf)).where("layoff_count >= 45").select("notice_id").distinct()
    sinks.post(candidates, path, "a")
    sinks.post(candidates, path, "a")  # a second run adds nothing
    ledger = spark.read.parquet(path)
    left = [sinks.unposted(candidates, ledger, p).select(F.lit(p).alias("platform")) for p in ("a", "b")]
    return left[0].union(left[1]).groupBy("platform").agg(F.count("*").cast("int").alias("left_to_post"))


# --- streaming rules in table form -----------------------------------------------------------------------------------


@query("str03_recent_discoveries", f"{N} SELECT notice_id, scraped_at FROM notices WHERE NOT is_superseded AND CAST(scraped_at AS DATE) - notice_date BETWEEN 0 AND 60")
def recent_discoveries(spark, sf):
    """Notices found within 60 days of their date: late backfills alert nobody."""
    return enrich.fresh(filters.active(notices(spark, sf)), 60).select("notice_id", "scraped_at")


@query("str05_once_per_platform", "WITH a AS (SELECT user_id AS notice, CASE WHEN event_type = 'click' THEN 'x' ELSE 'y' END AS platform, CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 7 = 0 THEN 404 ELSE 200 END AS status, event_id FROM events) SELECT notice, platform, bool_or(status BETWEEN 200 AND 499) AS done, count(*) AS attempts FROM a GROUP BY ALL")
def once_per_platform(spark, sf):
    """A notice is done with on a platform once it was posted or refused for good; other failures are tried again."""
    e = table(spark, sf, "events")
    status = F.when(F.col("event_type") == "error", 500).when(F.col("event_id") % 7 == 0, 404).otherwise(200)
    rows = e.select(F.col("user_id").alias("notice"), F.when(F.col("event_type") == "click", "x").otherwise("y").alias("platform"), status.alias("status"))
    return enrich.post_states(rows, ["notice", "platform"])


@query("str08_changed_sources", "SELECT user_id, event_id FROM (SELECT user_id, event_id, md5(event_type) AS h, lag(md5(event_type)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) WHERE was IS DISTINCT FROM h")
def changed_sources(spark, sf):
    """Fetches of a source whose content differs from the one before."""
    return enrich.changes(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.md5("event_type")).select("user_id", "event_id")


@query("str09_settled_totals", "WITH l AS (SELECT max(CAST(ts AS DATE)) AS last FROM events) SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events, l WHERE CAST(ts AS DATE) <= last - 2 GROUP BY 1")
def settled_totals(spark, sf):
    """Days that ended two days or more before the newest event, as a watermark of two days would give them out."""
    days = table(spark, sf, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return enrich.settled(days, "day", 2)


@query("str11_run_streaks", f"{with_(RUNS)}, s AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY started_at DESC, run_id DESC) AS i FROM runs), f AS (SELECT state, max_by(status, -i) AS status, min(i) FILTER (status <> (SELECT x.status FROM s x WHERE x.state = s.state AND x.i = 1)) AS turn, count(*) AS n FROM s GROUP BY 1) SELECT state, status, coalesce(turn - 1, n) AS streak FROM f")
def run_streaks(spark, sf):
    """Each state's present status and how many runs have ended so in a row."""
    return enrich.streaks(runs(spark, sf), "state", "status", ["started_at", "run_id"])


@query("str12_company_events", f"{_EV} SELECT company, day FROM e")
def company_events(spark, sf):
    """Events of companies: days more than 30 after the event's own start, not after the last day, open the next."""
    known = counted(notices(spark, sf)).where(F.col("company_id").isNotNull() & (F.col("notice_date") <= F.lit(AS_OF)))
    days = known.groupBy(F.col("company_id").alias("company")).agg(F.array_sort(F.collect_set(ev.day_number(F.col("notice_date")).cast("int"))).alias("days"))
    return days.select("company", F.explode(ev.anchored_starts(F.col("days"), 30)).alias("day"))


@query("str12_event_stream", oracle_of("str12_company_events"))
def event_stream(spark, sf):
    """The same events from a stream over three spans of days, started again from its checkpoint for each."""
    from severa.streaming.streams import anchored_events, run_in_steps

    known = counted(notices(spark, sf)).where(F.col("company_id").isNotNull() & (F.col("notice_date") <= F.lit(AS_OF)))
    rows = known.select(F.col("company_id").alias("key"), F.unix_date("notice_date").cast("int").alias("day"))
    cuts = [int(x) for x in rows.agg(F.percentile_approx("day", [0.33, 0.66])).first()[0]]
    spans = [rows.where(F.col("day") <= cuts[0]), rows.where((F.col("day") > cuts[0]) & (F.col("day") <= cuts[1])), rows.where(F.col("day") > cuts[1])]
    out = run_in_steps(spans, lambda source: anchored_events(source, 30), _folder(spark, "events"))
    shift = (ev.EPOCH - datetime.date(1970, 1, 1)).days
    return out.select(F.col("key").alias("company"), (F.col("start") - shift).alias("day"))


# --- extension points, dimensions, enrichment, attachments -----------------------------------------------------------


@query("ext01_details_to_fetch", f"WITH {_FILED} SELECT '/notice/' || o_orderkey AS url FROM f WHERE o_orderkey % 3 = 0")
def details_to_fetch(spark, sf):
    """Listed notices whose details are not yet complete: the others are skipped."""
    pages, details = _listing(spark, sf)
    known = details.select("url", extracted.fields(F.col("html")).alias("f")).where("f['city'] is not null and f['number of employees affected'] is not null")
    return extracted.listing(pages, "html").select("url").join(known.select("url"), "url", "left_anti")


@query("ext02_enriched_notices", f"{N} SELECT notice_id, CASE WHEN address IS NOT NULL THEN 'Town' || regexp_extract(address, 'Town(\\d)', 1) END AS city, regexp_extract(address, '(\\d{{5}})$', 1) AS zip FROM notices WHERE address IS NOT NULL")
def enriched_notices(spark, sf):
    """Registered enrichers, one after another, each filling what is still missing."""
    rows = notices(spark, sf).where("address is not null").select("notice_id", "address", F.lit(None).cast("string").alias("city"), F.lit(None).cast("string").alias("zip"))
    return enrich.apply_enrichers(rows, ["city", "zip"]).select("notice_id", "city", "zip")


@query("ext03_parser_dispatch", r"SELECT page_id, CASE WHEN regexp_matches(url, '/fr/') THEN 'french' WHEN regexp_matches(url, '[?&]page=') THEN 'paged' ELSE 'plain' END AS parser FROM pages")
def parser_dispatch(spark, sf):
    """The parser of each address, by the first pattern that it matches."""
    return table(spark, sf, "pages").select("page_id", enrich.dispatch(F.col("url"), {r"/fr/": "french", r"[?&]page=": "paged"}, "plain").alias("parser"))


@query("dim02_business_counts", "WITH b AS (SELECT s_suppkey AS i, lpad(CAST(s_nationkey AS VARCHAR), 2, '0') || lpad(CAST(s_suppkey % 5 AS VARCHAR), 3, '0') AS geoid, CASE WHEN s_suppkey % 3 = 0 THEN '44----' ELSE '------' END AS naics, CAST(trunc(s_acctbal) AS BIGINT) AS emp FROM supplier) SELECT geoid, arg_min(emp, i) AS jobs FROM b WHERE naics = '------' AND emp > 0 GROUP BY 1")
def business_counts(spark, sf):
    """Jobs of a county by business patterns: rows of all industries, the first of a county by source order."""
    k = F.col("s_suppkey")
    rows = table(spark, sf, "supplier").select(k.alias("i"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0").alias("state"), F.lpad((k % 5).cast("string"), 3, "0").alias("county"), F.when(k % 3 == 0, "44----").otherwise("------").alias("naics"), F.col("s_acctbal").cast("long").alias("emp"))
    return enrich.business_jobs(rows, "i")


@query("dim03_gazetteer", "SELECT lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS geoid, n_name AS name, CAST(n_nationkey * 2 AS DOUBLE) AS lat FROM nation")
def gazetteer(spark, sf):
    """A tab-separated gazetteer whose headers carry blanks, by the names of its columns."""
    path = _folder(spark, "gazetteer")
    table(spark, sf, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("GEOID"), F.col("n_name").alias("NAME "), (F.col("n_nationkey") * 2).cast("string").alias(" INTPTLAT ")).write.option("header", True).option("sep", "\t").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return tables.read_trimmed(spark, path, "\t").select(F.col("geoid"), F.col("name"), F.col("intptlat").cast("double").alias("lat"))


@query("dim07_county_centroids", f"{with_(LOCATIONS)} SELECT state, regexp_replace(county, ' (County|Co\\.)$', '') AS county, round(avg(CAST(lat AS DOUBLE)), 6) AS lat, round(avg(CAST(lon AS DOUBLE)), 6) AS lon FROM locations WHERE county IS NOT NULL AND lat IS NOT NULL GROUP BY ALL")
def county_centroids(spark, sf):
    rows = locations(spark, sf).where("county is not null and lat is not null")
    return rows.groupBy("state", text.county_name(F.col("county")).alias("county")).agg(*[F.round(F.avg(F.col(c).cast("double")), 6).alias(c) for c in ("lat", "lon")])


@query("enr02_requeued_misses", f"{with_(COMPANIES)} SELECT company_id FROM companies WHERE NOT enriched AND company_id % 30 BETWEEN 5 AND 19 AND company_id % 3 = 0")
def requeued_misses(spark, sf):
    """Look-ups that missed in a window and have another name to try."""
    c = companies(spark, sf)
    missed = c.select("company_id", "enriched", F.date_add(F.lit(datetime.date(2001, 6, 1)), (F.col("company_id") % 30).cast("int")).alias("missed_on"), F.concat("name", F.when(F.col("company_id") % 3 == 0, F.lit(" dba Corner Shop")).otherwise("")).alias("filed"))
    return enrich.to_requeue(missed, datetime.date(2001, 6, 6), datetime.date(2001, 6, 20)).select("company_id")


@query("enr04_notice_context", f"{N}, r AS (SELECT company_id, notice_id, row_number() OVER (PARTITION BY company_id ORDER BY notice_date DESC NULLS LAST, notice_id) AS i FROM notices WHERE company_id IS NOT NULL) SELECT company_id, string_agg(CAST(notice_id AS VARCHAR), ',' ORDER BY i) AS context FROM r WHERE i <= 5 GROUP BY 1")
def notice_context(spark, sf):
    """The five newest notices of a company, in one row."""
    by = Window.partitionBy("company_id").orderBy(F.desc_nulls_last("notice_date"), "notice_id")
    top = notices(spark, sf).where("company_id is not null").select("company_id", F.col("notice_id").cast("string").alias("id"), F.row_number().over(by).alias("i")).where("i <= 5")
    return top.groupBy("company_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "id"))), lambda x: x["id"]), ",").alias("context"))


@query("att01_attachment_types", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'html' WHEN 1 THEN 'pdf' WHEN 2 THEN 'csv' ELSE 'zip' END AS type FROM pages")
def attachment_types(spark, sf):
    """The kind of an attachment by its first bytes, then by its name."""
    k = F.col("page_id") % 4
    content = F.when(k == 0, F.concat(F.lit("\n "), "html")).when(k == 1, F.concat(F.lit("%PDF-1.4 "), "url")).when(k == 2, F.lit("a,b\n1,2")).otherwise(F.lit("PK\x03\x04rest"))
    name = F.when(k == 2, F.lit("Report.CSV")).otherwise(F.lit("file"))
    return table(spark, sf, "pages").select("page_id", extracted.sniffed(content.cast("binary"), name).alias("type"))


@query("att02_page_texts", r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def page_texts(spark, sf):
    return table(spark, sf, "pages").select("page_id", extracted.html_text(F.col("html")).alias("text"))


@query("fn25_letter_occupations", "WITH l AS (SELECT l_orderkey, 'Role ' || chr(CAST(65 + l_linenumber AS INT)) || ' ' || l_partkey || 'x' || l_suppkey AS title, CAST(l_quantity AS BIGINT) AS n FROM lineitem), s AS (SELECT l_orderkey, sum(n) AS total FROM l GROUP BY 1) SELECT l_orderkey, title, n FROM l JOIN s USING (l_orderkey) WHERE l_orderkey % 4 <> 0")
def letter_occupations(spark, sf):
    """Titles and counts in a letter's list; a list that doesn't add up to the letter's total says nothing."""
    row = F.concat(F.lit("Role "), F.char(65 + F.col("l_linenumber")), F.lit(" "), F.col("l_partkey").cast("string"), F.lit("x"), F.col("l_suppkey").cast("string"), F.lit("    "), F.col("l_quantity").cast("long").cast("string"))
    each = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(row), "\n").alias("rows"), F.sum(F.col("l_quantity").cast("long")).alias("total"))
    wrong = F.when(F.col("l_orderkey") % 4 == 0, 1).otherwise(0)
    letter = F.concat(F.lit("Affected positions:\n"), "rows", F.lit("\nSincerely"))
    return each.select("l_orderkey", F.explode(letters.occupations(letter, F.col("total") + wrong)).alias("o")).select("l_orderkey", "o.title", "o.n")


@query("fn27_affected_fields", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 2 THEN o_orderkey % 5000 + 1000 END AS workers FROM orders")
def affected_fields(spark, sf):
    """The number after a form's own label."""
    n = F.col("o_orderkey") % 5000 + 1000
    said = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("County: X | Number Affected: "), n.cast("string"), F.lit(" | Union: none")))
    said = said.when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Total Number of Affected Workers:\t"), F.format_number(n, 0))).otherwise(F.lit("Number Affected: -----"))
    return table(spark, sf, "orders").select("o_orderkey", letters.labelled_count(said).alias("workers"))


@query("fn30_city_labels", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name || ' (Remote)' ELSE s_name END AS employer, CASE WHEN s_suppkey % 3 <> 0 THEN n_name END AS city FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def city_labels(spark, sf):
    """Employers with their city in the label: brackets that hold no city of the state stay."""
    t = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.expr("s_nationkey = n_nationkey"))
    label = F.when(F.col("s_suppkey") % 3 == 0, F.concat("s_name", F.lit(" (Remote)"))).when(F.col("s_suppkey") % 3 == 1, F.concat("s_name", F.lit(" - "), "n_name")).otherwise(F.concat("s_name", F.lit(" ("), "n_name", F.lit(")")))
    rows = t.select("s_suppkey", F.col("s_nationkey").alias("state"), label.alias("label"))
    return places.split_label(rows, "s_suppkey", "label", "state", table(spark, sf, "nation").select(F.col("n_nationkey").alias("state"), F.col("n_name").alias("city")))


# --- models ----------------------------------------------------------------------------------------------------------


@query("ml16_metrics", f"WITH {_SCORED}, b AS ({oracle_of('win17_calibration_bins')}), c AS ({oracle_of('win16_average_precision')}), t AS ({oracle_of('win18_precision_at_top')}), m AS (SELECT round(avg((s / 97 - y) * (s / 97 - y)), 8) AS brier FROM s), e AS (SELECT round(sum(n * abs(predicted - observed)) / sum(n), 6) AS ece FROM b) SELECT average_precision, roc_auc, brier, ece, precision AS precision_at_10 FROM c, m, e, t")
def metrics(spark, sf):
    """All measures of one score in a row."""
    rows = _scored(spark, sf).withColumn("p", F.col("s") / 97)
    bins = equal_bins(rows, [F.col("s"), F.col("doc_id")], 10).groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("p"), 8).alias("a"), F.round(F.avg("y"), 8).alias("b"))
    ece = bins.agg(F.round(F.sum(F.col("n") * F.abs(F.col("a") - F.col("b"))) / F.sum("n"), 6).alias("ece"))
    brier = rows.agg(F.round(F.avg(F.pow(F.col("p") - F.col("y"), 2)), 8).alias("brier"))
    top = precision_at_top(spark, sf).select(F.col("precision").alias("precision_at_10"))
    return average_precision(spark, sf).join(F.broadcast(brier)).join(F.broadcast(ece)).join(F.broadcast(top))


@query("ml18_slices", "WITH s AS (SELECT d.lang, l.quality AS y, CAST(d.n_chars % 97 AS INT) AS s FROM documents d JOIN labels l USING (doc_id)), c AS (SELECT lang, s, sum(y) AS p, count(*) AS n FROM s GROUP BY ALL), r AS (SELECT *, sum(p) OVER (PARTITION BY lang ORDER BY s DESC) AS tp, sum(n) OVER (PARTITION BY lang ORDER BY s DESC) AS k, sum(p) OVER (PARTITION BY lang) AS pos FROM c) SELECT lang AS slice, CAST(sum(n) AS BIGINT) AS n, round(sum(p / pos * tp / k), 9) AS average_precision, round(sum(p) / sum(n), 9) AS base FROM r GROUP BY 1")
def slices(spark, sf):
    """Average precision of every slice beside its base rate."""
    d = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("slice"), (F.col("n_chars") % 97).cast("int").alias("s"))
    rows = d.join(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")
    return models.precision_by_slice(rows, "slice", "s", "y")


@query("ml19_promotion", "WITH m AS (SELECT user_id AS model, count(*) AS rows, avg(value) AS v FROM events GROUP BY 1) SELECT model, concat_ws('; ', CASE WHEN rows < 150 THEN 'too few rows' END, CASE WHEN v > 10 THEN 'badly calibrated' END, CASE WHEN v < 9.5 THEN 'no better than the live model' END) AS reasons FROM m")
def promotion(spark, sf):
    """Why each candidate may not go live; empty where it may."""
    m = table(spark, sf, "events").groupBy(F.col("user_id").alias("model")).agg(F.count("*").alias("rows"), F.avg("value").alias("v"))
    return m.select("model", F.array_join(models.promotion_reasons(F.col("rows"), F.col("v"), F.col("v"), live=9.5, least_rows=150, most_ece=10.0), "; ").alias("reasons"))


@query("ml23_survival_backtest", f"{_EV}, y AS (SELECT unnest(range(1997, 2001)) AS fold), z AS (SELECT *, least(prior_events, 3) AS bucket, year(DATE '1970-01-01' + day) AS yr, CAST(coalesce(next_gap_days <= 365, false) AS INT) AS label FROM e WHERE day + 365 < 11515), h AS (SELECT fold, bucket, avg(label) AS risk FROM z JOIN y ON DATE '1970-01-01' + day + 365 < make_date(fold, 1, 1) GROUP BY ALL) SELECT CAST(fold AS INT) AS fold, count(*) AS n, round(avg((risk - label) * (risk - label)), 8) AS brier, round(avg(label), 8) AS base FROM z JOIN h ON h.fold = z.yr AND h.bucket = z.bucket GROUP BY 1")
def survival_backtest(spark, sf):
    """Risks by the number of earlier events, learnt only from events whose year had passed, judged on each year's."""
    rows = _events(spark, sf).where("labelled").select(F.least("prior_events", F.lit(3)).alias("bucket"), F.date_add(F.lit(ev.EPOCH), F.col("day")).alias("start"), F.col("label").cast("double").alias("label"))
    return models.rolling_backtest(rows, "bucket", "start", "label", 365, range(1997, 2001))


@query("ml32_feedback_pairs", "WITH s AS (SELECT o_orderkey AS suggestion, o_custkey AS root, o_orderpriority[1] AS p FROM orders WHERE o_orderpriority[1] IN ('1', '5')), m AS (SELECT s.suggestion, CASE WHEN p = '1' THEN 1 ELSE 0 END AS label, l_partkey AS a, l_suppkey AS b FROM s JOIN lineitem ON l_orderkey = suggestion) SELECT suggestion, a, b, label FROM (SELECT DISTINCT * FROM m) QUALIFY row_number() OVER (PARTITION BY suggestion ORDER BY md5(a || ':' || b || '|3'), a, b) <= 2")
def feedback_pairs(spark, sf):
    """Decided suggestions as labelled pairs, at most two of each by a seeded hash."""
    s = table(spark, sf, "orders").select(F.col("o_orderkey").alias("suggestion"), F.substring("o_orderpriority", 1, 1).alias("p")).where("p in ('1', '5')")
    m = s.join(table(spark, sf, "lineitem"), F.expr("l_orderkey = suggestion")).select("suggestion", (F.col("p") == "1").cast("int").alias("label"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    by = Window.partitionBy("suggestion").orderBy(F.md5(F.concat(F.col("a").cast("string"), F.lit(":"), F.col("b").cast("string"), F.lit("|3"))), "a", "b")
    return m.withColumn("i", F.row_number().over(by)).where("i <= 2").select("suggestion", "a", "b", "label")


@query("ml33_evaluation", f"WITH b AS ({oracle_of('fn16_b_cubed')}), p AS ({oracle_of('fn17_pair_agreement')}) SELECT b.*, round(\"both\" / pred_pairs, 8) AS pair_precision, round(\"both\" / gold_pairs, 8) AS pair_recall FROM b, p")
def evaluation(spark, sf):
    """A clustering against the true one, by mention and by pair."""
    m = table(spark, sf, "customer").select((F.col("c_custkey") % 211).alias("pred"), (F.col("c_custkey") % 422).alias("gold"))
    pairs = linkage.pair_agreement(m).select(F.round(F.col("both") / F.col("pred_pairs"), 8).alias("pair_precision"), F.round(F.col("both") / F.col("gold_pairs"), 8).alias("pair_recall"))
    return linkage.b_cubed(m).select("n", *[F.round(c, 8).alias(c) for c in ("precision", "recall", "f1")]).join(F.broadcast(pairs))
