"""Which occupations a notice affects: those it filed, or what is typical of its industry; and industry codes of another
scheme."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ranges of SIC codes and the NAICS sector that most of each went to.
SIC_RANGES = [
    (100, 999, "11"), (1000, 1499, "21"), (1500, 1799, "23"), (2000, 3999, "31-33"), (4000, 4899, "48-49"), (4900, 4999, "22"),
    (5000, 5199, "42"), (5200, 5999, "44-45"), (6000, 6499, "52"), (6500, 6799, "53"), (7000, 8999, "81"), (9100, 9729, "92"),
]


def staffing_patterns(rows: DataFrame, most: int = 12, least_pct: float = 0.5) -> DataFrame:
    """rows (key, occupation, jobs) -> key, pattern: an array of (occupation, pct), the largest shares first, ties by name."""
    sums = rows.groupBy("key", "occupation").agg(F.sum("jobs").alias("jobs"))
    pct = F.bround(F.col("jobs") / F.sum("jobs").over(Window.partitionBy("key")) * 100, 1)
    ranked = sums.withColumn("pct", pct).withColumn("i", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("pct"), "occupation")))
    kept = ranked.where((F.col("i") <= most) & (F.col("pct") >= least_pct))
    return kept.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "occupation", "pct"))), lambda x: F.struct(x["occupation"], x["pct"])).alias("pattern"))


def occupation_mix(notices: DataFrame, filed: DataFrame, patterns: DataFrame, key: Column) -> DataFrame:
    """notices (notice_id, layoff_count, naics_code, any others), filed (notice_id, occupations: array of (occupation, n)),
    patterns by key -> the notices with occupations (array of (occupation, workers)), source 'filed' or 'typical', and
    reason, 'no_naics' or 'no_pattern', where there are none.

    What was filed wins; a typical share of an unknown number or of none is a null number of workers."""
    rows = notices.withColumn("key", key).join(filed, "notice_id", "left").join(patterns, "key", "left")
    share = lambda x: F.struct(x["occupation"].alias("occupation"), F.when(F.col("layoff_count") > 0, F.bround(F.col("layoff_count") * x["pct"] / 100)).cast("long").alias("workers"))
    typical = F.transform("pattern", share)
    given = F.transform("occupations", lambda x: F.struct(x["occupation"].alias("occupation"), x["n"].cast("long").alias("workers")))
    source = F.when(F.col("occupations").isNotNull(), "filed").when(F.col("pattern").isNotNull(), "typical")
    reason = F.when(source.isNull(), F.when(F.col("naics_code").isNull(), "no_naics").otherwise("no_pattern"))
    return rows.select(*notices.columns, F.coalesce(given, typical).alias("mix"), source.alias("source"), reason.alias("reason"))


def crosswalk(pairs: DataFrame) -> DataFrame:
    """(sic, naics) of companies that have both -> sic, naics: the commonest code of each, ties to the smaller."""
    votes = pairs.where("sic is not null and naics is not null").groupBy("sic", "naics").agg(F.count("*").alias("n"))
    return votes.groupBy("sic").agg(F.min_by("naics", F.struct(-F.col("n"), F.col("naics"))).alias("naics"))


def to_naics(codes: DataFrame, known: DataFrame, spark: SparkSession) -> DataFrame:
    """codes (sic int) and a crosswalk -> sic, naics, exact: the crosswalk's code, else the sector of the range that the code
    lies in, else null."""
    ranges = F.broadcast(spark.createDataFrame(SIC_RANGES, "low int, high int, sector string"))
    rows = codes.distinct().join(known, "sic", "left").join(ranges, F.col("sic").between(F.col("low"), F.col("high")), "left")
    return rows.select("sic", F.coalesce("naics", "sector").alias("naics"), F.col("naics").isNotNull().alias("exact"))
