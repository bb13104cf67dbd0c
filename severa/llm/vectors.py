"""Helpers of the operators on vectors: usable rows, matrices of Arrow lists, exact products and the best of many."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components are floor(SCALE * x); beyond LARGEST a score or a distance might not fit a long, so such input is an error.
SCALE, LARGEST = 256.0, 1 << 24
#: Vectors of a part are held by one task: at least the first, at most the second number of them.
LEAST_PART, MOST_PART = 8192, 1 << 18


def usable(v: Column) -> Column:
    """Whether a vector is there and every component is a finite number."""
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))


def one_per_id(rows: DataFrame, id_: str, *columns: str) -> DataFrame:
    """Rows with an id. Of several rows with one id the smallest by the other columns, in their order, stands for them all.
    Only if ids repeat are the other columns shuffled."""
    rows = rows.where(F.col(id_).isNotNull()).select(id_, *columns)
    if rows.groupBy(id_).count().where("count > 1").isEmpty():
        return rows
    return rows.groupBy(id_).agg(F.min(F.struct(*columns)).alias("least")).select(id_, "least.*")


def part_count(n: int) -> int:
    """Parts that n vectors are dealt into: more of them first, then larger ones up to MOST_PART."""
    return max(1, -(-n // max(LEAST_PART, min(MOST_PART, n // 64))))


def grid(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of numbers without nulls as the rows of a matrix of doubles; shorter lists end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(n) and (n == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(n), width))
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)] = values
    return out


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """The rows of a matrix as an Arrow column."""
    at = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(rows.reshape(-1), kind))


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(256 * x) as integers."""
    out = np.floor(SCALE * x)
    if out.size and np.abs(out).max() > LARGEST:
        raise ValueError(f"components beyond {LARGEST / SCALE:.0f} make scores that a long may not hold")
    return out.astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exactly: in doubles while every sum stays below 2**53."""
    if int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


class Best:
    """The k best of each of n askers, added block by block: larger scores first, then smaller ids. At any time `least`
    is a score that the k-th best reaches at least."""

    def __init__(self, n: int, k: int, least: float | int, hold: int = 1 << 20) -> None:
        self.k, self.hold, self.size = k, hold, 0
        self.least = np.full(n, least)
        self.found: list[tuple[np.ndarray, ...]] = []

    def add(self, asker: np.ndarray, score: np.ndarray, id_: np.ndarray, place: np.ndarray) -> None:
        self.found.append((asker, score, id_, place))
        self.size += len(asker)
        if self.size > self.hold + len(self.least) * self.k:
            self.trim()

    def trim(self) -> tuple[np.ndarray, ...]:
        """asker, score, id and place of what is kept, in order."""
        if not self.found:
            return np.zeros(0, np.int64), self.least[:0], np.zeros(0, np.int64), np.zeros(0, np.int64)
        asker, score, id_, place = map(np.concatenate, zip(*self.found, strict=True))
        order = np.lexsort((id_, -score, asker))
        order = order[np.arange(len(order)) - np.searchsorted(asker[order], asker[order]) < self.k]
        kept = tuple(x[order] for x in (asker, score, id_, place))
        rank = np.arange(len(order)) - np.searchsorted(kept[0], kept[0])
        full = rank == self.k - 1
        self.least[kept[0][full]] = np.maximum(self.least[kept[0][full]], kept[1][full])
        self.found, self.size = [kept], len(order)
        return kept
