"""Posts that go out once: rows and the run's number are committed together, and a platform that refuses is left alone."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from severa.streaming.commits import Commits

LEDGER = "notice_id long, platform string, status int, run int"
#: Answers that concern the platform as a whole, beside all from 500 on.
STOPS = (401, 403, 429)


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """What is done with: posted (status under 400), or refused for good."""
    _, entry = Commits(spark, f"{folder}/commits").last()
    paths = [f"{folder}/posts/{t}" for t in entry.get("posts", [])]
    return spark.read.schema(LEDGER).parquet(*paths) if paths else spark.createDataFrame([], LEDGER)


def post_run(candidates: DataFrame, send: Callable[[str, int, str], int], folder: str, run: int, size: str, most: int) -> int:
    """candidates (notice_id, platform, size) -> number of rows that the run adds to the ledger.

    Each platform gets what its ledger doesn't have, the largest first, ties by notice_id, `most` a run: that bound makes
    its rows one task's. `send(platform, notice_id, key)` returns a status; the key is the same whenever a post is tried
    again, so that a platform can drop what it got from a run that died before its commit. The first answer that concerns
    the whole platform ends its run and is not written: that row and those after it wait for the next. A candidate listed
    twice goes out once; a null id, platform or size takes no part. A run whose number is committed sends nothing."""
    spark = candidates.sparkSession
    commits = Commits(spark, f"{folder}/commits")
    last, entry = commits.last()
    if run <= last:
        return 0
    known = candidates.select(F.col("notice_id").cast("long").alias("notice_id"), "platform", F.col(size).cast("long").alias("size")).dropna()
    open_ = known.groupBy("notice_id", "platform").agg(F.max("size").alias("size")).join(ledger(spark, folder), ["notice_id", "platform"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("platform").orderBy(F.desc("size"), "notice_id"))
    due = open_.withColumn("_rank", rank).where(F.col("_rank") <= most)

    def of_platform(rows: pd.DataFrame) -> pd.DataFrame:
        done = []
        for r in rows.sort_values("_rank").itertuples():
            status = send(r.platform, r.notice_id, f"{r.platform}:{r.notice_id}")
            if status in STOPS or status >= 500:
                break
            done.append((r.notice_id, r.platform, status, run))
        return pd.DataFrame(done, columns=["notice_id", "platform", "status", "run"])

    token = uuid.uuid4().hex
    due.groupBy("platform").applyInPandas(of_platform, LEDGER).write.parquet(f"{folder}/posts/{token}")
    commits.add(run, {"posts": [*entry.get("posts", []), token]})
    return spark.read.schema(LEDGER).parquet(f"{folder}/posts/{token}").count()

