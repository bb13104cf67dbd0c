"""The notice model derived from the driver's tables, once as DataFrames and once as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    n0 = (
        t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    )
    c = F.col
    sector = F.when(c("p_type") == "ECONOMY", "31").when(c("p_type") == "SMALL", "32").when(c("p_type") == "MEDIUM", "44").when(c("p_type") == "PROMO", "48").when(c("p_type") == "STANDARD", "52").otherwise("99")
    return n0.select(
        (c("l_orderkey") * 10000000000 + c("l_partkey") * 100000 + c("l_suppkey") * 10 + c("l_linenumber")).cast("long").alias("notice_id"),
        F.concat(F.lit("S"), F.lpad(c("c_nationkey").cast("string"), 2, "0")).alias("state"),
        c("c_name").alias("employer"),
        F.when(c("l_suppkey") % 50 != 0, c("o_orderdate").cast("date")).alias("notice_date"),
        F.when(c("l_partkey") % 9 != 0, c("l_shipdate").cast("date")).alias("effective_date"),
        F.when((c("l_partkey") + c("l_linenumber")) % 7 != 0, c("l_quantity").cast("long")).alias("layoff_count"),
        F.when(c("l_returnflag") == "A", "Closure").when(c("l_returnflag") == "R", "Layoff").when(c("l_linestatus") == "F", "Non-WARN").alias("closure_category"),
        ((c("l_orderkey") % 20 == 0) & (c("l_linenumber") > 1)).alias("is_superseded"),
        F.when(c("o_custkey") % 11 != 0, c("o_custkey")).cast("long").alias("company_id"),
        c("s_nationkey").cast("long").alias("location_id"),
        F.when(c("p_size") % 5 != 0, F.concat(sector, F.lpad(c("p_size").cast("string"), 2, "0"))).alias("naics_code"),
        F.timestamp_add("HOUR", (c("l_partkey") % 48).cast("int"), c("l_shipdate")).alias("scraped_at"),
        F.when(c("l_suppkey") % 3 != 0, F.concat(c("l_suppkey").cast("string"), F.lit(" Main St, Town"), (c("l_suppkey") % 7).cast("string"), F.lit(", ST 1"), F.lpad((c("l_suppkey") % 100).cast("string"), 4, "0"))).alias("address"),
    )


NOTICES = """
n0 AS (SELECT l.*, o.o_custkey, o.o_orderdate, c.c_name, c.c_nationkey, s.s_nationkey, p.p_type, p.p_size
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN part p ON l.l_partkey = p.p_partkey),
notices AS (SELECT l_orderkey * 10000000000 + l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS notice_id,
  concat('S', lpad(CAST(c_nationkey AS VARCHAR), 2, '0')) AS state, c_name AS employer,
  CASE WHEN l_suppkey % 50 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS notice_date,
  CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS effective_date,
  CASE WHEN (l_partkey + l_linenumber) % 7 = 0 THEN NULL ELSE CAST(l_quantity AS BIGINT) END AS layoff_count,
  CASE WHEN l_returnflag = 'A' THEN 'Closure' WHEN l_returnflag = 'R' THEN 'Layoff' WHEN l_linestatus = 'F' THEN 'Non-WARN' ELSE NULL END AS closure_category,
  (l_orderkey % 20 = 0 AND l_linenumber > 1) AS is_superseded,
  CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE CAST(o_custkey AS BIGINT) END AS company_id, CAST(s_nationkey AS BIGINT) AS location_id,
  CASE WHEN p_size % 5 = 0 THEN NULL ELSE concat(CASE p_type WHEN 'ECONOMY' THEN '31' WHEN 'SMALL' THEN '32' WHEN 'MEDIUM' THEN '44'
    WHEN 'PROMO' THEN '48' WHEN 'STANDARD' THEN '52' ELSE '99' END, lpad(CAST(p_size AS VARCHAR), 2, '0')) END AS naics_code,
  l_shipdate + to_hours(CAST(l_partkey % 48 AS INT)) AS scraped_at,
  CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE concat(l_suppkey, ' Main St, Town', l_suppkey % 7, ', ST 1', lpad(CAST(l_suppkey % 100 AS VARCHAR), 4, '0')) END AS address
  FROM n0)"""


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    naics = F.when(k % 5 != 0, F.concat(F.element_at(F.array(*map(F.lit, ("311", "325", "445", "484", "522", "72"))), (k % 6 + 1).cast("int")), F.lpad((k % 10).cast("string"), 2, "0")))
    return table(spark, sf_dir, "customer").select(
        k.cast("long").alias("company_id"), F.col("c_name").alias("name"),
        F.when(k % 3 != 0, k - k % 3).cast("long").alias("canonical_company_id"),
        F.when(k % 4 != 1, F.concat(F.lit("U"), (k - k % 4).cast("string"))).alias("unique_id"),
        naics.alias("naics_code"),
        F.when(k % 6 != 0, F.concat(F.lit("https://www.site"), (k % 200).cast("string"), F.lit(".com/about"))).alias("website"),
        F.when(k % 4 == 0, F.concat(F.lit("self:"), k.cast("string"))).otherwise(F.concat(F.lit("ult:"), F.col("c_mktsegment"), (k % 97).cast("string"))).alias("parent_group_key"),
        F.when(k % 7 == 0, None).when(k % 7 == 1, 0.7).otherwise(1.0).alias("confidence"),
        (k % 8 != 0).alias("enriched"),
    )


COMPANIES = """
companies AS (SELECT CAST(c_custkey AS BIGINT) AS company_id, c_name AS name,
  CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_custkey - c_custkey % 3 AS BIGINT) END AS canonical_company_id,
  CASE WHEN c_custkey % 4 <> 1 THEN concat('U', c_custkey - c_custkey % 4) END AS unique_id,
  CASE WHEN c_custkey % 5 <> 0 THEN concat(['311', '325', '445', '484', '522', '72'][c_custkey % 6 + 1], lpad(CAST(c_custkey % 10 AS VARCHAR), 2, '0')) END AS naics_code,
  CASE WHEN c_custkey % 6 <> 0 THEN concat('https://www.site', c_custkey % 200, '.com/about') END AS website,
  CASE WHEN c_custkey % 4 = 0 THEN concat('self:', c_custkey) ELSE concat('ult:', c_mktsegment, c_custkey % 97) END AS parent_group_key,
  CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 7 = 1 THEN 0.7 ELSE 1.0 END AS confidence, c_custkey % 8 <> 0 AS enriched
  FROM customer)"""


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        k.cast("long").alias("location_id"), F.concat(F.lit("S"), F.lpad(k.cast("string"), 2, "0")).alias("state"), F.col("n_name").alias("city"),
        F.when(k % 8 != 7, F.concat(F.lit("St. Mary's "), (k % 5).cast("string"), F.when(k % 2 == 0, " County").otherwise(" Co."))).alias("county"),
        F.when(k % 4 != 3, F.lpad((10000 + k * 37).cast("string"), 5, "0")).alias("zip"),
        F.when(k % 6 != 5, F.lit(25) + k * 0.75).cast("decimal(9,6)").alias("lat"), F.when(k % 6 != 5, F.lit(-120) + k * 1.5).cast("decimal(9,6)").alias("lon"),
    )


LOCATIONS = """
locations AS (SELECT CAST(n_nationkey AS BIGINT) AS location_id, concat('S', lpad(CAST(n_nationkey AS VARCHAR), 2, '0')) AS state, n_name AS city,
  CASE WHEN n_nationkey % 8 <> 7 THEN concat('St. Mary''s ', n_nationkey % 5, CASE WHEN n_nationkey % 2 = 0 THEN ' County' ELSE ' Co.' END) END AS county,
  CASE WHEN n_nationkey % 4 <> 3 THEN CAST(10000 + n_nationkey * 37 AS VARCHAR) END AS zip,
  CASE WHEN n_nationkey % 6 <> 5 THEN CAST(25 + n_nationkey * 0.75 AS DECIMAL(9,6)) END AS lat,
  CASE WHEN n_nationkey % 6 <> 5 THEN CAST(-120 + n_nationkey * 1.5 AS DECIMAL(9,6)) END AS lon FROM nation)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("long").alias("run_id"), F.col("user_id").cast("string").alias("state"), F.col("ts").alias("started_at"),
        F.when(F.col("event_type") == "error", "parse_failed").otherwise("ok").alias("status"), F.pmod(F.floor("value").cast("long"), F.lit(5)).alias("rows_new"),
    )


RUNS = """
runs AS (SELECT CAST(event_id AS BIGINT) AS run_id, CAST(user_id AS VARCHAR) AS state, ts AS started_at,
  CASE WHEN event_type = 'error' THEN 'parse_failed' ELSE 'ok' END AS status, ((CAST(floor(value) AS BIGINT) % 5) + 5) % 5 AS rows_new FROM events)"""


def with_(*parts: str) -> str:
    """WITH of the given CTEs; what follows may go on with a comma."""
    return "WITH " + ",".join(parts)


N, NC, NL, NCL = with_(NOTICES), with_(NOTICES, COMPANIES), with_(NOTICES, LOCATIONS), with_(NOTICES, COMPANIES, LOCATIONS)
