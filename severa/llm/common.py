"""Helpers that the operators share: row keys and word patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from severa.staging import stage

#: The word patterns of the contracts.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MAX_LONG = 2**63 - 1
#: occ of rows without a doc_id begins here, above that of any row with one.
NO_ID = 1 << 62
#: Keys are broadcast up to so many (16 bytes each, about 60 in a hash table); beyond, they are shuffled.
BROADCAST_KEYS = 500_000
#: Rows of an Arrow batch of texts. Spark's own 10,000 of a few KB each would take some hundred MB in every task.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows in an Arrow batch to BATCH_ROWS; a smaller setting stays."""
    if not 0 < int(spark.conf.get(_BATCH, "10000")) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def text_of(column: str | Column = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def keyed(docs: DataFrame, *columns: Column) -> DataFrame:
    """Rows with an order key (k long, occ long). k is an integer doc_id, of any width; a doc_id of another type is ordered
    by a hash of its text. Rows without a doc_id come last, each text of them a document of its own, after the largest id
    that a long can hold. Rows that share a doc_id but not the text get different occ, by the text's hash; rows equal in
    both are the same document and get the same result. Nothing is gathered by doc_id, so one may hold any share of the rows."""
    whole = isinstance(docs.schema["doc_id"].dataType, IntegralType)
    key = F.col("doc_id").cast("long") if whole else F.xxhash64(F.col("doc_id").cast("string"))
    key = F.when(F.col("doc_id").isNull(), F.lit(MAX_LONG)).otherwise(key).alias("k")
    by_text = F.xxhash64(text_of()).bitwiseAND(F.lit(NO_ID - 1))
    none = F.col("doc_id").isNull()
    repeated = docs.where(~none).select(key).groupBy("k").count().where("count > 1").select("k", F.lit(True).alias("again"))
    occ = F.when(none, by_text.bitwiseOR(F.lit(NO_ID)))
    if repeated.isEmpty():
        return docs.select(key, F.coalesce(occ, F.lit(0).cast("long")).alias("occ"), *columns)
    rows = docs.select(key, occ.alias("occ"), by_text.alias("th"), *columns)
    names = [c for c in rows.columns if c not in ("k", "occ", "th")]
    found = F.coalesce("occ", F.when(F.col("again"), F.col("th")), F.lit(0).cast("long"))
    return rows.join(repeated, "k", "left").select("k", found.alias("occ"), *names)


def has_repeats(docs: DataFrame) -> bool:
    """Whether two rows share their doc_id, or have none, and their text. Texts are read only if doc_ids repeat."""
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return False
    return not keyed(docs).groupBy("k", "occ").count().where("count > 1").isEmpty()


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs less the rows whose key (k, occ) of `keyed` is among keys. Up to BROADCAST_KEYS keys go to every task, and the
    texts stay where they lie; more are shuffled with them."""
    gone = stage(keys.select("k", "occ").distinct(), "gone")
    small = gone.count() <= BROADCAST_KEYS
    rows = keyed(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return rows.join(F.broadcast(gone) if small else gone, ["k", "occ"], "left_anti").select("doc.*")
