"""The training-text pipeline: stages over documents, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the
columns of documents. What a stage has staged on its way is deleted when the next begins, as its result is written by then.

Rows are judged one by one: null and empty texts have no words, so they are not toxic by the model's bias unless that says
so, are classes of their own, lose nothing, are clean and are never taken by the mix. Null doc_ids come last wherever a
smaller doc_id wins. Rows that repeat in doc_id and text are one document to the near copies, which keep one row; the other
stages treat them alike. An empty table passes every stage and gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from severa.llm import toxicity
from severa.llm.decontamination import drop_contaminated
from severa.llm.jaccard_join import drop_near_copies
from severa.llm.source_mix import draw_mix
from severa.llm.substring_dedup import dedup_substrings
from severa.staging import drop_paths, drop_staged, stage, staged_since

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Step = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Paths that the stage before has staged.
_LEFT: list[str] = []


def _clearing(step: Step) -> Step:
    @wraps(step)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_paths(spark, _LEFT)
        mark = len(staged_since())
        out = step(spark, docs, sf_dir)
        _LEFT[:] = staged_since(mark)
        return out

    return run


@_clearing
def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score a half or more go. The model learns from the labelled documents among them."""
    weights = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, weights).select(*COLUMNS)


@_clearing
def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id: five-word shingles, similarity 0.8 or more."""
    return drop_near_copies(docs, n=5, threshold=0.8).select(*COLUMNS)


@_clearing
def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by 20-word windows that occur earlier go; a text that loses none stays as it is. No document goes."""
    out = dedup_substrings(docs, width=20)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return out.select("doc.doc_id", text.alias("text"), "doc.lang", "doc.source", F.length(text).cast("long").alias("n_chars"))


@_clearing
def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more lies in 13-word windows of the benchmark go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=13).select(*COLUMNS)


@_clearing
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the number of copies and the words that makes."""
    return draw_mix(docs.select(*COLUMNS))


STAGES = [
    ("toxicity", remove_toxic),
    ("near copies", remove_near_copies),
    ("repeated passages", remove_repeated_passages),
    ("decontamination", remove_contaminated),
    ("mix", mix),
]

#: Learnt scores, hashed sketches and the knapsack have no SQL; tests/llm/test_pipeline.py holds each stage to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each staged in the shared folder, over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, function in STAGES:
        out = stage(function(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        if before is not None:
            drop_staged(before)
        docs = before = out
    return docs
