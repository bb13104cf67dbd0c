"""Substring dedup: Rabin-Karp hashes of every fixed-length token window, counted in Spark.

Every window of `width` words is hashed. A task combines the windows of some FLUSH of them first: of equal ones only the
earliest goes on, and the others are marked at once, so that a window of every document sends one place a flush. What goes
on is dealt out by the value of the hash, many to a row, so that equal windows meet in one of many even groups, where all
but the earliest are marked. Marks go back to their documents, again many to a row, and merge into maximal removal
intervals. Windows are judged on the input. Words are told apart by 64-bit hashes,
windows by two hashes: 78 bits at 0.5 GB of text, 95 at 100 TB, as the bits that the part says are not sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import keyed, small_batches, text_of

#: Bytes of text whose windows make one group: some 1.3 million of them, of which a task holds the hashes.
GROUP_BYTES = 8 << 20
#: Windows that a task combines and packs at once. At 1 TB of text, 125,000 groups, a packed row still holds 16 windows.
FLUSH = 2_000_000


def _planes(values: np.ndarray) -> bytes:
    """Small non-negative integers as byte planes: the high planes are zeros, which the shuffle's codec drops."""
    wide = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([wide]) + np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T[:wide]).tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    wide = planes[0]
    out = np.zeros(((len(planes) - 1) // wide, 8), np.uint8)
    out[:, :wide] = np.frombuffer(planes, np.uint8, offset=1).reshape(wide, -1).T
    return out.reshape(-1).view("<u8").astype(np.int64)


_PLACES = "keys binary, occs binary, counts binary, gaps binary"


def _pack(keys: np.ndarray, occs: np.ndarray, new: np.ndarray, pos: np.ndarray) -> list[bytes]:
    """Places by document: keys in unsigned order and occs of the documents, `new` their first places, pos ascending
    within each."""
    gaps = np.diff(pos, prepend=0)
    gaps[new] = pos[new]
    step = np.diff(keys.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63), prepend=np.uint64(0))
    return [_planes(step), _planes(occs), _planes(np.diff(new, append=len(pos))), _planes(gaps)]


def _unpack(keys: bytes, occs: bytes, counts: bytes, gaps: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, occ and position of every place."""
    n, sums = _numbers(counts), _numbers(gaps)
    begin = np.cumsum(n) - n
    first = sums[begin]
    sums = np.cumsum(sums)
    key = (np.cumsum(_numbers(keys).view(np.uint64)) ^ np.uint64(1 << 63)).view(np.int64)
    return np.repeat(key, n), np.repeat(_numbers(occs), n), sums - np.repeat(sums[begin] - first, n)


def _batch(index: str, rows: list[list]) -> pa.RecordBatch:
    """rows: (index, binary columns ...)."""
    columns = list(zip(*rows, strict=True))
    names = [index, *(["hashes"] if len(columns) == 6 else []), "keys", "occs", "counts", "gaps"]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=names)


def _stored(hashes: np.ndarray, checks: np.ndarray, part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """What tells the windows of one part apart, in 64 and 8 bits: the part says the first bits of the hash, whose room the
    check takes, so that with more parts, and so more windows, as many more bits are told apart."""
    free, half = np.uint64(parts.bit_length() - 1), np.uint64(32)
    begin = ((part.astype(np.uint64) << half) + np.uint64(parts - 1)) // np.uint64(parts)
    word = (((hashes >> half) - begin) << (half + free)) | ((hashes & np.uint64(0xFFFFFFFF)) << free) | (checks & ((np.uint64(1) << free) - np.uint64(1)))
    return word, (checks >> free).astype(np.uint8)


def _parted(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The 64 and the 8 bits."""
    n = len(packed) // 9
    return np.frombuffer(packed, np.uint64, n), np.frombuffer(packed, np.uint8, n, 8 * n)


def _slot(hashes: np.ndarray, slots: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)


class _Held:
    """The windows of some documents of a task."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.occs: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.hashes: list[np.ndarray] = []
        self.checks: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray, occs: np.ndarray, counts: np.ndarray, hashes: np.ndarray, checks: np.ndarray) -> None:
        """counts: windows of each document, whose hashes follow one another."""
        for held, new in ((self.keys, keys), (self.occs, occs), (self.counts, counts), (self.hashes, hashes), (self.checks, checks.astype(np.uint32))):
            held.append(new)
        self.size += len(hashes)

    def pack(self, parts: int) -> pa.RecordBatch:
        """Rows by part of the hash space: each window's earliest place. From `parts` on, rows by group of documents: the
        places of windows that are here and start earlier here."""
        keys, occs, counts, hashes, checks = (np.concatenate(x) for x in (self.keys, self.occs, self.counts, self.hashes, self.checks))
        self.hashes, self.checks = [], []  # both are copied
        # Documents in order; a row that repeats a document has its place.
        rank = np.lexsort((occs, keys))
        keys, occs = keys[rank], occs[rank]
        new = np.ones(len(rank), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (occs[1:] != occs[:-1])
        begin, counts = (np.cumsum(counts) - counts)[rank], counts[rank]
        pos = (np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
        begin = np.repeat(begin, counts) + pos
        hashes = hashes[begin]
        checks = checks[begin]
        place = np.repeat((np.cumsum(new) - 1).astype(np.int32), counts)
        del begin
        keys, occs = keys[new], occs[new]
        # In this order the first of equal windows is the earliest. Where two windows share the hash and not the check, some
        # that are equal may both go on; `_repeats` finds them.
        order = np.argsort(hashes, kind="stable").astype(np.int32)
        again = np.zeros(len(order), bool)
        again[1:] = np.diff(hashes[order]) == 0
        again[1:] &= np.diff(checks[order]) == 0
        first = order[np.maximum.accumulate(np.where(again, 0, np.arange(len(order), dtype=np.int32)))]
        late = np.sort(order[again & ((place[order] != place[first]) | (pos[order] != pos[first]))])
        keep = np.sort(order[~again])
        del order, again, first
        hashes = hashes[keep]
        checks = checks[keep].astype(np.uint64)
        part = _slot(hashes, parts)
        stored = _stored(hashes, checks, part, parts)
        del hashes, checks
        rows = self._rows(part, keep, stored, keys, occs, place, pos)
        del part, keep, stored
        fresh = np.ones(len(late), bool)
        by_place = np.lexsort((pos[late], place[late]))
        late = late[by_place]
        fresh[1:] = (place[late][1:] != place[late][:-1]) | (pos[late][1:] != pos[late][:-1])
        late = late[fresh]
        rows += self._rows(parts + _slot(hashing.mix(keys[place[late]].view(np.uint64)), parts), late, None, keys, occs, place, pos)
        return _batch("part", rows)

    @staticmethod
    def _rows(part: np.ndarray, at: np.ndarray, stored: tuple[np.ndarray, np.ndarray] | None, keys: np.ndarray, occs: np.ndarray, place: np.ndarray, pos: np.ndarray) -> list[list]:
        order = np.argsort(part, kind="stable")
        part, at = part[order], at[order]
        words, bytes_ = (x[order] for x in stored) if stored else (None, None)
        bounds = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(at) else np.zeros(1, np.int64)
        rows = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            own = at[a:b]
            new = np.flatnonzero(np.diff(place[own], prepend=-1))
            ids = place[own[new]]
            rows.append([int(part[a]), words[a:b].tobytes() + bytes_[a:b].tobytes() if stored else b"", *_pack(keys[ids], occs[ids], new, pos[own])])
        return rows


def _deal(width: int, parts: int, flush: int):
    """Rows (k, occ, text) -> their windows as `_Held` packs them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in batches:
            keys, occs = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for lo, hi, data, offsets in hashing.texts_of(batch.column(2)):
                words, first = hashing.words_of(data, offsets)
                hashes, at = hashing.windows_of(words, first, width)
                held.add(keys[lo:hi], occs[lo:hi], np.maximum(np.diff(first) - width + 1, 0), hashes, hashing.checks_of(words, at, width))
                if held.size >= flush:
                    yield held.pack(parts)
                    held = _Held()
        if held.size:
            yield held.pack(parts)

    return run


def _repeats(parts: int):
    """All windows of one part -> the places of those that occur earlier, by group of documents. Marks made before pass."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        if part >= parts:
            return table.drop_columns(["part", "hashes"]).add_column(0, "docs", pa.array([part - parts] * len(table), pa.int32()))
        packed = table.column("hashes").to_pylist()
        h, c = map(np.concatenate, zip(*map(_parted, packed), strict=True))
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        rep = np.zeros(len(h), bool)
        rep[order[1:][same]] = rep[order[:-1][same]] = True
        # Only the places of windows that repeat are unpacked for good.
        ends = np.cumsum([len(x) // 9 for x in packed])
        found: list[tuple[np.ndarray, ...]] = []
        for i, (a, b) in enumerate(zip(np.append(0, ends[:-1]), ends, strict=True)):
            own = np.flatnonzero(rep[a:b])
            if len(own):
                k, o, p = _unpack(*(table.column(x)[i].as_py() for x in ("keys", "occs", "counts", "gaps")))
                found.append((h[a:b][own], c[a:b][own], k[own], o[own], p[own]))
        empty = pa.schema([("docs", pa.int32()), *((c, pa.binary()) for c in ("keys", "occs", "counts", "gaps"))]).empty_table()
        if not found:
            return empty
        h, c, k, o, p = map(np.concatenate, zip(*found, strict=True))
        order = np.lexsort((p, o, k, c, h))
        h, c, k, o, p = h[order], c[order], k[order], o[order], p[order]
        # A row that is an exact repeat of its doc_id's row has the same place: it is that place, not a later one.
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
        first = np.maximum.accumulate(np.where(again, 0, np.arange(len(h))))
        late = again & ~((k == k[first]) & (o == o[first]) & (p == p[first]))
        k, o, p = k[late], o[late], p[late]
        group = _slot(hashing.mix(k.view(np.uint64)), parts)
        order = np.lexsort((p, o, k, group))
        k, o, p, group = k[order], o[order], p[order], group[order]
        bounds = np.flatnonzero(np.diff(group, prepend=-1, append=parts)) if len(k) else np.zeros(1, np.int64)
        rows = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            new = np.flatnonzero(np.concatenate([[True], (k[a + 1 : b] != k[a : b - 1]) | (o[a + 1 : b] != o[a : b - 1])]))
            rows.append([int(group[a]), *_pack(k[a:b][new], o[a:b][new], new, p[a:b])])
        return pa.Table.from_batches([_batch("docs", rows)]) if rows else empty

    return run


def _gather(table: pa.Table) -> pa.Table:
    """All places of one group of documents -> a row for each document."""
    packed = zip(*(table.column(c).to_pylist() for c in ("keys", "occs", "counts", "gaps")), strict=True)
    k, o, p = map(np.concatenate, zip(*(_unpack(*x) for x in packed), strict=True))
    order = np.lexsort((p, o, k))
    k, o, p = k[order], o[order], p[order]
    new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])]))
    starts = pa.ListArray.from_arrays(pa.array(np.append(new, len(k)), pa.int32()), pa.array(p, pa.int32()))
    return pa.table({"k": pa.array(k[new], pa.int64()), "occ": pa.array(o[new], pa.int64()), "starts": starts})


def _cut(width: int):
    """Rows (text, starts, doc) -> with the kept words and what was removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("words", "removed", "spans", "kept")}
            for text, starts in zip(batch.column(0).cast(pa.large_binary()), batch.column(1), strict=True):
                words = (text.as_py() or b"").split()  # bytes split at the six ASCII white-space characters
                spans: list[dict] = []
                if starts.is_valid:
                    begin = np.unique(starts.values.to_numpy(zero_copy_only=False))
                    fresh = np.flatnonzero(np.diff(begin, prepend=-width - 1) > width)
                    ends = np.append(begin[fresh[1:] - 1], begin[-1]) + width
                    kept, at = [], 0
                    for a, b in zip(begin[fresh].tolist(), ends.tolist(), strict=True):
                        kept += words[at:a]
                        spans.append({"first": a, "last": b - 1})
                        at = b
                    kept += words[at:]
                else:
                    kept = words
                out["words"].append(len(words))
                out["removed"].append(len(words) - len(kept))
                out["spans"].append(spans)
                out["kept"].append(b" ".join(kept).decode())
            span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out["words"], pa.int64()), pa.array(out["removed"], pa.int64()), pa.array(out["spans"], span), pa.array(out["kept"], pa.string())], names=["text", "doc", "n_words", "n_removed", "spans", "kept_text"])

    return run


def dedup_substrings(docs: DataFrame, width: int = 20, group_bytes: int = GROUP_BYTES, flush: int = FLUSH) -> DataFrame:
    """documents (doc_id, text, any others) -> doc (a struct of the other columns), text (as it was), n_words, n_removed, spans
    (maximal intervals of removed words, both ends included) and kept_text (kept words joined by one space).

    A word goes if a window of `width` words over it also starts earlier: in a smaller doc_id (null is largest) or before
    in the same text. Null and empty texts, and those shorter than a window, lose nothing. A row repeated with its doc_id
    and text is the same document and gets the same result; other rows that share a doc_id are ordered by a hash of
    their text. An empty table gives no rows. Other columns, whatever their names, ride along in `doc`."""
    small_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(32, -(-size // group_bytes))
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = keyed(docs, F.col("text"), F.struct(*rest).alias("doc"))
    marks = (
        rows.select("k", "occ", text_of()).mapInArrow(_deal(width, parts, flush), f"part int, hashes binary, {_PLACES}")
        .groupBy("part").applyInArrow(_repeats(parts), f"docs int, {_PLACES}")
        .groupBy("docs").applyInArrow(_gather, "k long, occ long, starts array<int>")
    )
    joined = rows.join(marks, ["k", "occ"], "left").select("text", "starts", "doc")
    kind = joined.schema["doc"].dataType.simpleString()
    return joined.mapInArrow(_cut(width), f"text string, doc {kind}, n_words long, n_removed long, spans array<struct<first:int,last:int>>, kept_text string")
