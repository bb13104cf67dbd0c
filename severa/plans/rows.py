"""Row-level coercion, keys, categories and validation (PRJ, FLT, VAL)."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from severa.functions import naics, text
from severa.operators import filters, validate
from severa.plans.adapter import NC, NL, N, companies, locations, notices, table
from severa.plans.registry import query

AS_OF = datetime.date(2001, 7, 12)


@query("prj01_norm", r"SELECT c_custkey, trim(regexp_replace(lower('  ' || c_name || chr(9) || upper(c_mktsegment) || '  x '), '\s+', ' ', 'g')) AS norm FROM customer")
def norm(spark, sf):
    raw = F.concat(F.lit("  "), F.col("c_name"), F.lit("\t"), F.upper("c_mktsegment"), F.lit("  x "))
    return table(spark, sf, "customer").select("c_custkey", text.norm(raw).alias("norm"))


@query("prj02_is_blank", "SELECT (c_custkey % 4) AS kind, count(*) AS n, count(*) FILTER (s IS NULL OR trim(s) = '') AS blank FROM (SELECT *, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  ' ELSE c_name END AS s FROM customer) GROUP BY 1")
def is_blank(spark, sf):
    k = F.col("c_custkey") % 4
    s = F.when(k == 1, "").when(k == 2, "  ").when(k == 3, F.col("c_name"))
    return table(spark, sf, "customer").select(k.alias("kind"), text.blank(s).cast("int").alias("b")).groupBy("kind").agg(F.count("*").alias("n"), F.sum("b").alias("blank"))


@query("prj03_as_date", """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 5 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d FROM orders""")
def as_date(spark, sf):
    k, d = F.col("o_orderkey") % 7, F.col("o_orderdate")
    raw = F.when(k == 0, "n/a").when(k == 1, F.date_format(d, "yyyy-MM-dd")).when(k == 2, F.date_format(d, "M/d/yyyy")).when(k == 3, F.date_format(d, "MMMM d, yyyy")).when(k == 4, F.date_format(d, "yyyyMMdd")).when(k == 5, F.concat(F.lit("0225"), F.date_format(d, "-MM-dd"))).otherwise(F.concat(F.lit(" "), F.date_format(d, "yyyy-MM-dd"), F.lit(" ")))
    return table(spark, sf, "orders").select("o_orderkey", text.as_date(raw, AS_OF).alias("d"))


@query("prj04_as_int", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 1000 + o_orderkey % 1000 WHEN 1 THEN NULL WHEN 2 THEN o_orderkey WHEN 3 THEN o_orderkey ELSE NULL END AS n FROM orders")
def as_int(spark, sf):
    key = F.col("o_orderkey")
    raw = F.when(key % 5 == 0, F.concat(F.lit("1,"), F.lpad((key % 1000).cast("string"), 3, "0"))).when(key % 5 == 1, "50, 60").when(key % 5 == 2, F.concat(key.cast("string"), F.lit(".9"))).when(key % 5 == 3, F.concat(F.lit(" "), key.cast("string"))).otherwise("TBD")
    return table(spark, sf, "orders").select("o_orderkey", text.as_int(raw).alias("n"))


@query("prj05_as_str", "SELECT c_custkey, nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN '  ' ELSE ' ' || c_name || ' ' END), '') AS s FROM customer")
def as_str(spark, sf):
    raw = F.when(F.col("c_custkey") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("c_name"), F.lit(" ")))
    return table(spark, sf, "customer").select("c_custkey", text.as_str(raw).alias("s"))


@query("prj06_city_from_address", f"{N} SELECT notice_id, CASE WHEN len(string_split(address, ',')) >= 3 THEN trim(string_split(address, ',')[-2]) END AS city FROM notices")
def city_from_address(spark, sf):
    return notices(spark, sf).select("notice_id", text.city_from_address(F.col("address")).alias("city"))


@query("prj07_zip_from", rf"{N} SELECT notice_id, coalesce(nullif(regexp_extract(CASE WHEN location_id % 3 = 0 THEN '1' || (10000 + location_id) ELSE (20000 + location_id) || '-1234' END, '\b(\d{{5}})(?:-\d{{4}})?\b', 1), ''), nullif(regexp_extract(address, '\b(\d{{5}})(?:-\d{{4}})?\b', 1), '')) AS zip FROM notices")
def zip_from(spark, sf):
    loc = F.col("location_id")
    raw = F.when(loc % 3 == 0, F.concat(F.lit("1"), (10000 + loc).cast("string"))).otherwise(F.concat((20000 + loc).cast("string"), F.lit("-1234")))
    return notices(spark, sf).select("notice_id", text.zip_from(raw, F.col("address")).alias("zip"))


@query("prj08_notice_key", f"""{NL} SELECT n.notice_id, left(sha256(concat_ws('|', upper(n.state), lower(trim(employer)), coalesce(CAST(notice_date AS VARCHAR), ''), coalesce(lower(city), ''), coalesce(zip, ''))), 32) AS key FROM notices n JOIN locations l USING (location_id)""")
def notice_key(spark, sf):
    place = locations(spark, sf).select("location_id", "city", "zip")
    rows = notices(spark, sf).join(place, "location_id")
    return rows.select("notice_id", text.notice_key(F.col("state"), F.col("employer"), F.col("notice_date"), F.col("city"), F.col("zip")).alias("key"))


_RAW = "CASE o_orderkey % 12 WHEN 0 THEN 'Plant Closure' WHEN 1 THEN 'CL' WHEN 2 THEN 'Layoff and Closure' WHEN 3 THEN 'Red in Force' WHEN 4 THEN 'WR' WHEN 5 THEN 'Shut Down' WHEN 6 THEN '' WHEN 7 THEN 'lo' WHEN 8 THEN 'Furlough' WHEN 9 THEN 'clinic' WHEN 10 THEN NULL ELSE 'Downsizing' END"


@query("prj09_closure_category", rf"WITH r AS (SELECT o_orderkey, lower(trim({_RAW})) AS s FROM orders), f AS (SELECT *, regexp_matches(s, 'clos|shut|\bcl\b') AS c, regexp_matches(s, 'layoff|lay off|lay-off|reduction|in force|rif|downsiz|furlough|\b(lo|wr)\b') AS l FROM r) SELECT o_orderkey, CASE WHEN c AND NOT l THEN 'Closure' WHEN l AND NOT c THEN 'Layoff' END AS category, CASE WHEN c AND NOT l THEN 'Closure' WHEN l AND NOT c THEN 'Mass layoff' ELSE 'WARN notice' END AS label FROM f")
def closure_category(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", text.closure_category(F.expr(_RAW)).alias("category"))
    return rows.withColumn("label", text.closure_label(F.col("category")))


@query("prj11_clean_naics", rf"SELECT p_partkey, nullif(regexp_extract(p_size || 'x NAICS ' || (p_partkey * 7) || '.', '\b(\d{{2,8}})\b', 1), '') AS code FROM part")
def clean_naics(spark, sf):
    raw = F.concat(F.col("p_size").cast("string"), F.lit("x NAICS "), (F.col("p_partkey") * 7).cast("string"), F.lit("."))
    return table(spark, sf, "part").select("p_partkey", text.clean_naics(raw).alias("code"))


@query("prj12_insert_rules", f"{N} SELECT notice_id, least(notice_date, DATE '2000-01-01') AS notice_date, CASE WHEN notice_date > DATE '2000-01-01' THEN coalesce(effective_date, notice_date) ELSE coalesce(effective_date, notice_date + 60) END AS effective_date FROM notices WHERE notice_date IS NOT NULL")
def insert_rules(spark, sf):
    return validate.insert_rules(notices(spark, sf).where("notice_date is not null"), datetime.date(2000, 1, 1)).select("notice_id", "notice_date", "effective_date")


SECTOR = "CASE " + " ".join(f"WHEN left(naics_code, 2) = '{p}' THEN '{s}'" for p, s in naics.PREFIXES.items()) + " END"


@query("prj14_sectors", f"{NC} SELECT company_id, {SECTOR} AS sector, CASE WHEN {SECTOR} IS NOT NULL AND len(naics_code) >= 3 THEN left(naics_code, 3) END AS subsector, CASE WHEN confidence IS NULL OR confidence >= 1 THEN naics_code END AS trusted FROM companies")
def sectors(spark, sf):
    code = F.col("naics_code")
    return companies(spark, sf).select("company_id", naics.sector_of(code).alias("sector"), naics.subsector_of(code).alias("subsector"), naics.if_trusted(code, F.col("confidence")).alias("trusted"))


@query("prj19_county_name", r"""SELECT n_nationkey, 'St. Mary''s ' || (n_nationkey % 5) AS county FROM nation""")
def county_name(spark, sf):
    k = F.col("n_nationkey")
    base = F.concat(F.lit("St.  Mary’s "), (k % 5).cast("string"))
    raw = F.when(k % 4 == 0, F.concat(base, F.lit(" County"))).when(k % 4 == 1, F.concat(base, F.lit(" Co."))).when(k % 4 == 2, F.concat(base, F.lit(" (and others)"))).otherwise(F.concat(base, F.lit(" Parish - North")))
    return table(spark, sf, "nation").select("n_nationkey", text.county_name(raw).alias("county"))


@query("prj20_company_key", r"SELECT c_custkey, 'customer ' || regexp_extract(c_name, '(\d+)$', 1) AS key FROM customer")
def company_key(spark, sf):
    k, n = F.col("c_custkey") % 4, F.regexp_extract("c_name", r"(\d+)$", 1)
    raw = F.when(k == 0, F.concat(F.lit("The Customer#77 "), n, F.lit(", Inc."))).when(k == 1, F.concat(F.lit("(1045) CUSTOMER "), n, F.lit(" Co., LLC"))).when(k == 2, F.concat(F.lit("Customer  "), n)).otherwise(F.concat(F.lit("customer "), n, F.lit(" Corp")))
    return table(spark, sf, "customer").select("c_custkey", text.company_key(raw).alias("key"))


@query("prj26_website_domain", f"{NC} SELECT company_id, CASE WHEN website IS NULL THEN '' ELSE regexp_extract(website, 'www[.]([^/]+)', 1) END AS domain FROM companies")
def website_domain(spark, sf):
    return companies(spark, sf).select("company_id", text.website_domain(F.col("website")).alias("domain"))


@query("prj28_in_box", f"{NL} SELECT location_id, coalesce(lat BETWEEN 26 AND 38 AND lon BETWEEN -118 AND -95, false) AS inside FROM locations")
def in_box(spark, sf):
    return locations(spark, sf).select("location_id", F.coalesce(F.col("lat").between(26, 38) & F.col("lon").between(-118, -95), F.lit(False)).alias("inside"))


@query("prj29_geocode_tiers", f"{NL}, z AS (SELECT zip, avg(lat) AS lat FROM locations WHERE zip IS NOT NULL AND location_id % 3 <> 0 GROUP BY zip), c AS (SELECT state, avg(lat) AS lat FROM locations WHERE location_id % 2 = 0 GROUP BY state) SELECT location_id, CASE WHEN z.lat BETWEEN 26 AND 40 THEN 'zip' WHEN c.lat BETWEEN 26 AND 40 THEN 'city' END AS source, CASE WHEN z.lat BETWEEN 26 AND 40 THEN CAST(z.lat AS DOUBLE) WHEN c.lat BETWEEN 26 AND 40 THEN CAST(c.lat AS DOUBLE) END AS lat FROM locations l LEFT JOIN z USING (zip) LEFT JOIN c USING (state)")
def geocode_tiers(spark, sf):
    """The first tier with a point inside the state's box."""
    loc = locations(spark, sf)
    zips = loc.where("zip is not null and location_id % 3 <> 0").groupBy("zip").agg(F.avg("lat").cast("double").alias("zlat"))
    cities = loc.where("location_id % 2 = 0").groupBy("state").agg(F.avg("lat").cast("double").alias("clat"))
    rows = loc.join(zips, "zip", "left").join(cities, "state", "left")
    tiers = [("zip", "zlat"), ("city", "clat")]
    first = F.coalesce(*[F.when(F.col(c).between(26, 40), F.struct(F.lit(s).alias("source"), F.col(c).alias("lat"))) for s, c in tiers])
    return rows.select("location_id", first["source"].alias("source"), first["lat"].alias("lat"))


@query("prj32_occupation_estimates", f"{N} SELECT notice_id, CASE WHEN layoff_count > 0 THEN CAST(round_even(layoff_count * 12.5 / 100, 0) AS BIGINT) END AS estimate, round_even(layoff_count / sum(layoff_count) OVER (PARTITION BY employer) * 100, 1) AS share FROM notices")
def occupation_estimates(spark, sf):
    from pyspark.sql import Window

    n = F.col("layoff_count")
    return notices(spark, sf).select("notice_id", F.when(n > 0, F.bround(n * F.lit(12.5) / 100, 0).cast("long")).alias("estimate"), F.bround(n / F.sum("layoff_count").over(Window.partitionBy("employer")) * 100, 1).alias("share"))


@query("prj35_blank_implausible", f"{N} SELECT notice_id, CASE WHEN layoff_count - 5 >= 0 THEN layoff_count - 5 END AS layoff_count, CASE WHEN effective_date - notice_date BETWEEN -730 AND 1825 THEN effective_date WHEN notice_date IS NULL THEN effective_date END AS effective_date FROM notices")
def blank_implausible(spark, sf):
    rows = notices(spark, sf).withColumn("layoff_count", F.col("layoff_count") - 5)
    return validate.blank_implausible(rows).select("notice_id", "layoff_count", "effective_date")


@query("prj38_grades", "SELECT o_orderkey, o_orderkey % 101 AS score, CASE WHEN o_orderkey % 101 >= 80 THEN 'A' WHEN o_orderkey % 101 >= 60 THEN 'B' WHEN o_orderkey % 101 >= 40 THEN 'C' WHEN o_orderkey % 101 >= 20 THEN 'D' ELSE 'F' END AS grade FROM orders")
def grades(spark, sf):
    from severa.operators.timeline import grade

    return table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 101).alias("score")).withColumn("grade", grade(F.col("score")))


@query("prj39_series_ids", "SELECT n_nationkey, 'LAUST' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || repeat('0', 11) || '03' AS unemployment, 'SMS' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || repeat('0', 13) || '01' AS payroll FROM nation")
def series_ids(spark, sf):
    fips = F.lpad(F.col("n_nationkey").cast("string"), 2, "0")
    return table(spark, sf, "nation").select("n_nationkey", F.concat(F.lit("LAUST"), fips, F.lit("0" * 11 + "03")).alias("unemployment"), F.concat(F.lit("SMS"), fips, F.lit("0" * 13 + "01")).alias("payroll"))


@query("flt01_listed", f"{N} SELECT notice_id, state, notice_date FROM notices WHERE NOT is_superseded AND state = 'S05' AND employer ILIKE '%0_1%' AND closure_category = 'Layoff' AND layoff_count >= 10 AND notice_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'")
def listed(spark, sf):
    rows = filters.listed(notices(spark, sf), "s05", "0_1", "Layoff", 10, datetime.date(1996, 1, 1), datetime.date(2000, 12, 31))
    return rows.select("notice_id", "state", "notice_date")


@query("flt02_industry", f"{N} SELECT naics_code, count(*) AS n FROM notices WHERE NOT is_superseded AND left(naics_code, 2) IN ('31', '32', '33') GROUP BY 1")
def industry(spark, sf):
    return filters.listed(notices(spark, sf), industry="31-33").groupBy("naics_code").agg(F.count("*").alias("n"))


@query("flt03_window", f"{N} SELECT count(*) AS n, min(notice_date) AS first, max(notice_date) AS last FROM notices WHERE NOT is_superseded AND closure_category IS DISTINCT FROM 'Non-WARN' AND notice_date BETWEEN DATE '2001-04-14' AND DATE '2001-07-12'")
def window(spark, sf):
    rows = filters.counted(notices(spark, sf), after=datetime.date(2001, 4, 14), before=AS_OF)
    return rows.agg(F.count("*").alias("n"), F.min("notice_date").alias("first"), F.max("notice_date").alias("last"))


@query("flt04_plausible_dates", f"{N} SELECT count(*) AS n, count(*) FILTER (notice_date IS NULL) AS undated FROM (SELECT *, year(notice_date) - CASE WHEN location_id = 3 THEN 20 ELSE 0 END AS y FROM notices) WHERE y IS NULL OR y BETWEEN 1988 AND 2003")
def plausible_dates(spark, sf):
    rows = notices(spark, sf).withColumn("notice_date", F.when(F.col("location_id") == 3, F.add_months("notice_date", -240)).otherwise(F.col("notice_date")))
    return filters.plausible_dates(rows, AS_OF).agg(F.count("*").alias("n"), F.count_if(F.col("notice_date").isNull()).alias("undated"))


@query("flt06_ml_clean", f"{N}, d AS (SELECT *, row_number() OVER (PARTITION BY notice_id ORDER BY layoff_count NULLS FIRST, scraped_at) AS rn FROM notices WHERE NOT is_superseded AND closure_category IS DISTINCT FROM 'Non-WARN' AND NOT (state = 'S07' AND coalesce(year(notice_date) BETWEEN 1996 AND 1998, false))) SELECT state, count(*) AS n, CAST(sum(CASE WHEN layoff_count > 0 AND layoff_count <= 45 THEN layoff_count END) AS BIGINT) AS workers FROM d WHERE rn = 1 GROUP BY state")
def ml_clean(spark, sf):
    return validate.ml_clean(notices(spark, sf), "S07", (1996, 1998), 45).groupBy("state").agg(F.count("*").alias("n"), F.sum("layoff_count").alias("workers"))


@query("val01_batch_gate", f"{N} SELECT state, count(*) AS n, round(avg(CASE WHEN employer IS NULL OR trim(employer) = '' THEN 1 ELSE 0 END), 6) AS blank_employer, round(avg(CASE WHEN notice_date IS NULL THEN 1 ELSE 0 END), 6) AS blank_date, count(*) BETWEEN 100 AND 1000000 AND avg(CASE WHEN notice_date IS NULL THEN 1 ELSE 0 END) <= 0.1 AS passes FROM notices GROUP BY state")
def batch_gate(spark, sf):
    return validate.batch_gate(notices(spark, sf), ["state"], 100, 1_000_000)


@query("val03_complete_details", f"{N} SELECT DISTINCT employer FROM notices WHERE NOT is_superseded AND layoff_count IS NOT NULL AND effective_date IS NOT NULL AND address IS NOT NULL")
def complete_details(spark, sf):
    return filters.active(notices(spark, sf)).where("layoff_count is not null and effective_date is not null and address is not null").select("employer").distinct()
