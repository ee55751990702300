"""Words and word n-grams of many texts at once, as numpy arrays over Arrow buffers.

Hashes are 64 bits wide.  A word's hash is a polynomial over randomly coded bytes, mixed; an
n-gram's is a mixed combination of its words' hashes, so the order of words counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_MUL = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _codes(lower: bool) -> np.ndarray:
    byte = np.arange(256, dtype=np.uint64)
    if lower:
        byte[65:91] += np.uint64(32)
    return mix(byte + np.uint64(0x1234567))


_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POW[0]) < n:
        for k, base in enumerate((_MUL, _INV)):
            row = np.full(max(n, CHUNK_BYTES + 4096), base, np.uint64)
            row[0] = 1
            np.cumprod(row, out=row)
            _POW[k] = row
    return _POW


class Chunk(NamedTuple):
    """Some consecutive texts of a batch: rows first..last, their bytes, and where each starts
    (one more entry than texts)."""

    first: int
    data: np.ndarray
    starts: np.ndarray


def chunks(texts: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string column into pieces of about ``limit`` bytes; a longer text is a piece of
    its own.  Nulls count as empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"")
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, where, data = texts.buffers()
    starts = np.frombuffer(where, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + limit, "right")) - 1)
        yield Chunk(at, whole[starts[at] : starts[to]], starts[at : to + 1] - starts[at])
        at = to


class Words(NamedTuple):
    """Words in text order: byte start and end, hash, and for each text its first word's index
    (one more entry than texts)."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    of_text: np.ndarray


def words(chunk: Chunk, separator: np.ndarray, lower: bool) -> Words:
    """``separator``: 256 booleans, true for bytes that stand between words."""
    n = len(chunk.data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none.astype(np.uint64), np.zeros(len(chunk.starts), np.int64))
    inside = ~separator[chunk.data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = chunk.starts[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    power, inverse = _powers(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_codes(lower)[chunk.data] * power[:n], out=total[1:])
    found = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    return Words(start, end, found, np.searchsorted(start, chunk.starts))


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on, also across texts: the caller keeps those of one text."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, n, np.uint64)
    for k in range(n):
        out = mix(out + hashes[k : k + m]) * _MUL
    return mix(out)


BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
