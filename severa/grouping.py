"""Many small groups, folded in Python."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a frame that a task sends on.
ROWS = 1000


def in_frames(rows: Iterable[tuple], columns: list[str], most: int = ROWS) -> Iterator[pd.DataFrame]:
    """Rows as frames of at most `most`, so that no more of them are held at a time. At least one frame."""
    rows, first = iter(rows), True
    while (part := list(islice(rows, most))) or first:
        yield pd.DataFrame(part, columns=columns)
        first = False


def whole_groups(frames: Iterable[pd.DataFrame], key: str) -> Iterator[dict[str, list]]:
    """Frames in the order of the key -> the columns of each group, also of one that goes on over frames."""
    held: dict[str, list] = {}
    for frame in frames:
        columns = {c: frame[c].tolist() for c in frame.columns}
        start = 0
        for value, run in groupby(None if pd.isna(k) else k for k in columns[key]):
            stop = start + sum(1 for _ in run)
            own = {c: v[start:stop] for c, v in columns.items()}
            start = stop
            own[key] = [value] * len(own[key])
            if held and held[key][0] == value:
                for c, v in own.items():
                    held[c] += v
                continue
            if held:
                yield held
            held = own
    if held:
        yield held


def fold_groups(rows: DataFrame, key: str, fold: Callable[[dict[str, list]], Iterable[tuple]], schema: str, columns: list[str]) -> DataFrame:
    """The rows that `fold` gives for the columns of each group of one key, as schema, whose names are `columns`.

    Like applyInPandas by the key, but a task's groups pass through one call in the order of the key: a call for each group
    costs milliseconds. A task holds one group, a frame of rows and what it sends on."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from in_frames((row for group in whole_groups(frames, key) for row in fold(group)), columns)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, key).sortWithinPartitions(key).mapInPandas(run, schema)


def array_groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[dict[str, np.ndarray]]:
    """Batches in the order of the key, which is never null -> the columns of each group as arrays, also of one that goes on
    over batches."""
    held: list[dict[str, np.ndarray]] = []
    joined = lambda: {c: np.concatenate([part[c] for part in held]) for c in held[0]}
    for batch in batches:
        columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        at = columns[key]
        cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)] if len(at) else []
        for start, stop in zip(cuts, cuts[1:], strict=False):
            if held and held[0][key][0] != at[start]:
                yield joined()
                held = []
            held.append({c: v[start:stop] for c, v in columns.items()})
    if held:
        yield joined()


def fold_arrays(rows: DataFrame, key: str, fold: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """`fold_groups` by arrays: for groups of millions of rows, that Python lists would not hold, and for many small ones. The
    key is never null. What groups give is sent on when it comes to ROWS, or at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = [], 0
        for group in array_groups(batches, key):
            out.append(fold(group))
            n += len(next(iter(out[-1].values())))
            if n >= ROWS:
                yield pa.RecordBatch.from_pydict({c: np.concatenate([part[c] for part in out]) for c in out[0]})
                out, n = [], 0
        if out:
            yield pa.RecordBatch.from_pydict({c: np.concatenate([part[c] for part in out]) for c in out[0]})

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # By a hash: rows that a join has already dealt by the key would stay as they are, in the few parts that their size asks for.
    return rows.repartition(parts, F.xxhash64(key)).sortWithinPartitions(key).mapInArrow(run, schema)
