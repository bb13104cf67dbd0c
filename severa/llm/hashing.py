"""Hashes of words, and Rabin-Karp hashes of windows of words, vectorised over a batch of texts.

A word is the sum of a pseudo-random term for each byte and its place in the word, so that words of one letter pattern,
such as Thue-Morse words, which collide in any polynomial modulo 2**64, differ like all others. Windows are polynomials in
those word hashes, modulo 2**64: with c[i] the sum of the first i terms t[j] * B**-j, a window from i of width w hashes to
(c[i + w] - c[i]) * B**i, whatever its place; B is odd and so has an inverse.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Texts of a batch are taken together up to so many bytes.
CHUNK_BYTES = 1 << 20


class Kept(dict):
    """Values that a process works out once. A pickled copy, as tasks get it, starts empty."""

    def __reduce__(self):
        return Kept, ()


_POWERS = Kept()


def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    if bits not in _POWERS:
        n = 1 << bits
        up, down = np.full(n, BASE, U64), np.full(n, pow(BASE, -1, 1 << 64), U64)
        up[0] = down[0] = 1
        _POWERS.clear()  # one size at a time
        _POWERS[bits] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[bits]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i for i below n at least."""
    return _powers(max(20, int(n).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over the word."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


#: Places in a word whose terms are looked up; those of later ones are worked out.
LOOKED_UP = 64
_TERMS = Kept()


def _term(place: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return mix(((place.astype(U64) << U64(8)) | byte.astype(U64)) * U64(BASE) + U64(0x2545F4914F6CDD1D))


def byte_terms(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A pseudo-random number for each byte at each place of a word."""
    if "table" not in _TERMS:
        _TERMS["table"] = _term(np.repeat(np.arange(LOOKED_UP), 256), np.tile(np.arange(256), LOOKED_UP))
    out = _TERMS["table"][(np.minimum(place, LOOKED_UP - 1) << 8) | data]
    late = np.flatnonzero(place >= LOOKED_UP)
    out[late] = _term(place[late], data[late])
    return out


def prefix(terms: np.ndarray) -> np.ndarray:
    out = np.zeros(len(terms) + 1, U64)
    np.cumsum(terms * powers(len(terms))[1][: len(terms)], out=out[1:])
    return out


def texts_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows (first, last + 1, bytes, offsets) of a string or binary column without nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    if not len(column):
        return
    places = np.frombuffer(places, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(places, places[at] + CHUNK_BYTES, "right")) - 1)
        yield at, to, data[places[at] : places[to]], places[at : to + 1] - places[at]
        at = to


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (split at ASCII white space) and the first word of each text, with the number of words last."""
    if not len(data):
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[0], before[1:] = True, space[:-1]
    after[-1], after[:-1] = True, space[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = True
    after[inner - 1] = True
    start, end = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    begins = np.zeros(len(data), np.int64)
    begins[start] = start
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(byte_terms(data, np.arange(len(data)) - np.maximum.accumulate(begins)), out=sums[1:])
    hashes = mix(sums[end] - sums[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))
    return hashes, np.searchsorted(start, offsets)


def windows_of(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of width words inside one text, and the index of its first word."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    text_end = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(len(words)) + width <= text_end)
    sums = prefix(words)
    return mix((sums[at + width] - sums[at]) * powers(len(words))[0][at]), at


def checks_of(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """32 more bits for the windows at these places, from another polynomial over other numbers for the words."""
    sums = prefix(mix(words ^ U64(0xA0761D6478BD642F)))
    return (mix((sums[at + width] - sums[at]) * powers(len(words))[0][at]) >> U64(32))
