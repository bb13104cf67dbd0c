"""Token counts through a digest cache.

The cache is a Parquet table (digest, tokenizer, n_tokens). Documents join it by the digest of their content and the
tokenizer's version; only distinct contents that it lacks are encoded, and their counts are appended to it. Content is
normalised to UTF-8 with null as empty, nothing more: the tokenizer's own normaliser is part of its version, a digest of
its file. Where the tokenizer never joins text across white space (`splits_at_space` tries it), counts of whole
white-space words are remembered inside a task, and a word is encoded when it is first met; other tokenizers get whole
texts.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import product
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from severa.staging import stage

from .common import small_batches, text_of
from .hashing import Kept

CACHE = "digest binary, tokenizer string, n_tokens long"
#: Words remembered in a task, and new ones encoded at once.
REMEMBERED, AT_ONCE = 300_000, 20_000


_TOKENIZERS = Kept()


def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


def version(path: str) -> str:
    """A digest of the tokenizer's file."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()[:32]


def splits_at_space(path: str) -> bool:
    """Whether the tokenizer's pieces of two texts with one of the six white-space characters between them are those of
    each text, for letters, digits, marks, symbols and other scripts on either side; and no added token holds a space."""
    tokenizer = _tokenizer(path)
    if tokenizer.pre_tokenizer is None or any(t["content"].split() != [t["content"]] for t in json.loads(Path(path).read_text()).get("added_tokens", [])):
        return False

    def pieces(text: str) -> list[str]:
        text = tokenizer.normalizer.normalize_str(text) if tokenizer.normalizer else text
        return [p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    sides = ("a", "Bc", "7", "!", "'s", "_", "é", "e\u0301", "\u0301", "語", "я", "😀")
    return all(pieces(a + space + b) == pieces(a) + pieces(b) for a, b in product(sides, sides) for space in " \t\n\x0b\x0c\r")


def _encode(path: str, name: str, by_words: bool):
    """Rows (digest, text) -> rows of the cache."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, known = _tokenizer(path), {}
        for batch in batches:
            size = batch.num_rows
            counts, at = [], 0
            while at < size:
                # A run of texts is split into words, and the words not yet known are encoded together.
                words: list[list[bytes]] = []
                fresh: dict[bytes, None] = {}
                while at < size and len(fresh) < AT_ONCE:
                    text = batch.column(1)[at].as_py().encode()
                    words.append(text.split() if by_words else [text])
                    fresh.update((w, None) for w in words[-1] if w not in known)
                    at += 1
                if len(known) > REMEMBERED or not by_words:
                    known.clear()
                    fresh = dict.fromkeys(w for ws in words for w in ws)
                keys = list(fresh)
                for i in range(0, len(keys), AT_ONCE):
                    some = keys[i : i + AT_ONCE]
                    known.update(zip(some, map(len, tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)), strict=True))
                counts += [sum(map(known.__getitem__, ws)) for ws in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([name] * size, pa.string()), pa.array(counts, pa.int64())], names=["digest", "tokenizer", "n_tokens"])

    return run


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache's rows; none if it doesn't exist yet. A digest appended twice counts once."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(path).dropDuplicates(["digest", "tokenizer"])


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, limit: int = 2048) -> DataFrame:
    """documents (doc_id, text, any others) -> doc (a struct of the columns but text), n_bytes, n_tokens, over_limit.

    tokenizer is the path of a tokenizers file, the same on every executor; cache the path of the cache, in a folder that
    all executors share. Null and empty texts have no tokens. A text is encoded and appended once, however many rows hold
    it and whatever their doc_ids, and repeated rows each get their result; an empty table gives no rows and adds nothing
    to the cache. Other columns ride along in `doc`."""
    spark, name = docs.sparkSession, version(tokenizer)
    small_batches(spark)
    text = text_of()
    digest = F.unhex(F.sha2(text, 256)).alias("digest")
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    known = read_cache(spark, cache).where(F.col("tokenizer") == name).select("digest")
    # Each task hands on one row of a text, whatever the number of its copies, and the join finds them dealt out already.
    misses = docs.select(digest, text.alias("text")).groupBy("digest").agg(F.any_value("text").alias("text")).join(known, "digest", "left_anti")
    misses.mapInArrow(_encode(tokenizer, name, splits_at_space(tokenizer)), CACHE).write.mode("append").parquet(cache)
    # Staged, so that the join has two plain exchanges and Spark can split the digest of a large group of copies.
    counts = stage(read_cache(spark, cache).where(F.col("tokenizer") == name).select("digest", "n_tokens"), "token-counts")
    rows = docs.select(F.struct(*rest).alias("doc"), digest, F.octet_length(text).cast("long").alias("n_bytes"))
    out = rows.join(counts, "digest", "left")
    return out.select("doc", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
