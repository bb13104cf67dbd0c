"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest
ancestor directory.

A file's units are, for each template, all windows of as many words as the template has, an eighth of it apart (one word
apart for templates of under 16 words), so that headers count wherever they stand and however their lines are wrapped; and
the whole text. A word weighs its count in the unit by the logarithm of how few files hold it. A unit of cosine c holds
template words of at least c**2 of the template's squared weight (Cauchy-Schwarz), so a file with less of a template than
that needs no comparison with it: a bound that drops nothing.

Only words of templates are counted in the corpus; another word lengthens a unit by the weight of a word of one file. A
directory's licence is that of its licence files; files without one of their own take the nearest ancestor's, found by
joining each distinct directory's ancestor paths.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from severa.staging import stage

from . import hashing
from .common import small_batches, text_of
from .license_texts import TEMPLATES

U64 = np.uint64
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.-].*)?$"
#: Windows that are weighed at once.
WINDOWS = 2048
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Terms(NamedTuple):
    """Templates as vectors over the hashes of their words. vocab is sorted; vectors has a row a template."""

    names: list[str]
    lengths: np.ndarray
    vocab: np.ndarray
    counts: np.ndarray


def terms_of(templates: dict[str, tuple[str, ...]]) -> Terms:
    names, rows = [], []
    for name, texts in sorted(templates.items()):
        for text in texts:
            data = re.sub(_BETWEEN, " ", text.lower()).encode()
            words, _ = hashing.words_of(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
            names.append(name)
            rows.append(words)
    vocab = np.unique(np.concatenate(rows))
    counts = np.stack([np.bincount(np.searchsorted(vocab, r), minlength=len(vocab)) for r in rows])
    return Terms(names, np.array([len(r) for r in rows]), vocab, counts)


def _idf(held: np.ndarray | int, files: int) -> np.ndarray:
    return np.log((1.0 + files) / (1.0 + np.asarray(held))) + 1.0


def _found(vocab: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The place of each word among vocab, or -1."""
    at = np.minimum(np.searchsorted(vocab, words), len(vocab) - 1)
    return np.where(vocab[at] == words, at, -1)


def _count(terms: Terms):
    """Rows (text) -> (term, n): in how many of the texts each template word occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms.vocab), np.int64)
        for batch in batches:
            for lo, hi, data, offsets in hashing.texts_of(batch.column(0)):
                words, first = hashing.words_of(data, offsets)
                at, doc = _found(terms.vocab, words), np.repeat(np.arange(hi - lo), np.diff(first))
                once = np.unique(doc[at >= 0] * len(terms.vocab) + at[at >= 0])
                total += np.bincount(once % len(terms.vocab), minlength=len(terms.vocab))
        use = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(use, pa.int32()), pa.array(total[use])], names=["term", "n"])

    return run


class _Scorer:
    """Cosines of the units of one text."""

    def __init__(self, terms: Terms, held: np.ndarray, files: int):
        self.terms, self.idf, self.other = terms, _idf(held, files), float(_idf(1, files))
        weights = terms.counts * self.idf
        self.vectors = weights / np.sqrt(np.square(weights).sum(1))[:, None]
        self.squares = np.square(self.vectors).T

    def cosines(self, ids: np.ndarray, starts: np.ndarray, length: int, template: int) -> np.ndarray:
        """ids: of the text's words, from len(vocab) on for words of no template."""
        out = []
        width, v = int(ids.max()) + 1, len(self.terms.vocab)
        for a in range(0, len(starts), WINDOWS):
            some = starts[a : a + WINDOWS]
            keys = ids[some[:, None] + np.arange(length)] + np.arange(len(some))[:, None] * width
            key, n = np.unique(keys, return_counts=True)
            unit, word = key // width, key % width
            w = n * np.where(word < v, self.idf[np.minimum(word, v - 1)], self.other)
            dot = np.bincount(unit, np.where(word < v, w * self.vectors[template][np.minimum(word, v - 1)], 0.0), minlength=len(some))
            out.append(dot / np.sqrt(np.bincount(unit, w * w, minlength=len(some))))
        return np.concatenate(out)

    def best(self, ids: np.ndarray, template: int) -> float:
        length = int(self.terms.lengths[template])
        n = len(ids)
        if n <= length:
            return float(self.cosines(ids, np.zeros(1, int), n, template)[0])
        step = max(1, length // 8) if length >= 16 else 1
        starts = np.unique(np.append(np.arange(0, n - length + 1, step), n - length))
        # A window needs as much of the template as the whole text does.
        held = np.flatnonzero(ids < len(self.terms.vocab))
        held = held[self.terms.counts[template][ids[held]] > 0]
        inside = np.searchsorted(held, starts + length) - np.searchsorted(held, starts)
        starts = starts[inside > 0]
        whole = self.cosines(ids, np.zeros(1, int), n, template)[0]
        return float(max(whole, self.cosines(ids, starts, length, template).max(initial=0.0) if len(starts) else 0.0))


def _scan(terms: Terms, held: np.ndarray, files: int, least: float):
    """Rows (text, others) -> the others, own, cosine, evidence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, v = _Scorer(terms, held, files), len(terms.vocab)
        for batch in batches:
            for lo, hi, data, offsets in hashing.texts_of(batch.column(0)):
                words, first = hashing.words_of(data, offsets)
                at = _found(terms.vocab, words)
                doc = np.repeat(np.arange(hi - lo), np.diff(first))
                there = np.zeros((hi - lo, v), np.float32)
                there[doc[at >= 0], at[at >= 0]] = 1
                near = there @ scorer.squares >= least * least - 1e-6
                own: list[str | None] = [None] * (hi - lo)
                cosine: list[float | None] = [None] * (hi - lo)
                evidence: list[float | None] = [None] * (hi - lo)
                for d in np.flatnonzero(near.any(1)):
                    a, b = first[d], first[d + 1]
                    ids = at[a:b].copy()
                    strange = ids < 0
                    ids[strange] = v + np.unique(words[a:b][strange], return_inverse=True)[1]
                    ranked = []
                    for t in np.flatnonzero(near[d]):
                        c = round(scorer.best(ids, int(t)), 6)
                        if c >= least:
                            ranked.append((-round(c * int(terms.lengths[t]), 6), terms.names[t], -c))
                    if ranked:
                        e, own[d], c = min(ranked)
                        cosine[d], evidence[d] = -c, -e
                rest = batch.slice(lo, hi - lo).columns[1:]
                added = [pa.array(own, pa.string()), pa.array(cosine, pa.float64()), pa.array(evidence, pa.float64())]
                yield pa.RecordBatch.from_arrays([*rest, *added], names=[*batch.schema.names[1:], "own", "cosine", "evidence"])

    return run


def _ancestors(directory: Column) -> Column:
    """The directory and all above it; the root is the empty path."""
    parts = F.split(directory, "/")
    return F.when(directory == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.when(i == 0, "").otherwise(F.array_join(F.slice(parts, 1, i), "/"))))


def scan_licenses(files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, least: float = 0.75) -> DataFrame:
    """files (repo, path, text, any others) -> file (a struct of the columns but text), own (the licence of the template
    with the most evidence, which is its cosine, of `least` or more, times its number of words; ties to the smallest name),
    cosine, inherited (licence of the nearest directory, its own or above, that has a licence file with one), from_dir, and
    license (own, else inherited, else null).

    A directory with several licence files takes the most evidence, then the smallest name. Null and empty texts have no
    units; a null path lies in the root of its repo; a null repo is a repo. Repeated rows each get a result; an empty table
    gives no rows. Texts of any length are scanned whole. Other columns ride along in `file`."""
    small_batches(files.sparkSession)
    terms = terms_of(templates)
    words = F.regexp_replace(F.lower(text_of()), _BETWEEN, " ").alias("text")
    held = np.zeros(len(terms.vocab), np.int64)
    # As many rows as the templates have words.
    for r in files.select(words).mapInArrow(_count(terms), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        held[r.term] = r.n
    path = F.coalesce(F.col("path"), F.lit(""))
    base = F.struct(*[F.col(f"`{c}`") for c in files.columns if c != "text"]).alias("file")
    repo = F.coalesce(F.col("repo").cast("string"), F.lit("\x00")).alias("repo")
    rows = files.select(words, base, repo, F.regexp_replace(path, "/?[^/]*$", "").alias("dir"), F.regexp_extract(path, "[^/]*$", 0).rlike(LICENSE_FILE).alias("is_license"))
    kind = rows.schema["file"].dataType.simpleString()
    scanned = rows.mapInArrow(_scan(terms, held, files.count(), least), f"file {kind}, repo string, dir string, is_license boolean, own string, cosine double, evidence double")
    rows = stage(scanned, "own-licenses")

    licensed = rows.where("is_license and own is not null").groupBy("repo", "dir").agg(F.min(F.struct((-F.col("evidence")).alias("less"), "own")).alias("best")).select("repo", F.col("dir").alias("above"), F.col("best.own").alias("inherited"))
    places = rows.select("repo", "dir").distinct().select("repo", "dir", F.explode(_ancestors(F.col("dir"))).alias("above"))
    near = places.join(licensed, ["repo", "above"]).groupBy("repo", "dir").agg(F.max_by(F.struct("inherited", F.col("above").alias("from_dir")), F.length("above")).alias("up"))
    out = rows.join(near, ["repo", "dir"], "left")
    return out.select("file", "own", "cosine", "up.inherited", "up.from_dir", F.coalesce("own", "up.inherited").alias("license"))
