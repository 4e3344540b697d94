"""Word positions and word hashes of whole Arrow columns, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# White space that separates words, and the bytes inside licence words.
SPACES = b" \t\n\x0b\x0c\r"
PIECE_BYTES = 4 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def byte_table(inside) -> np.ndarray:
    return np.array([bool(inside(b)) for b in range(256)])


NOT_SPACE = byte_table(lambda b: b not in SPACES)
ALPHANUMERIC = byte_table(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(size.astype(np.int64)) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of bytes, and where each begins and ends; null is empty."""
    filled = pc.fill_null(column, "").cast(pa.large_binary())
    if not len(filled):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    buffers = filled.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    raw = buffers[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and text number of every maximal run of bytes that are ``inside``."""
    if not len(data):
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    mask = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    joined = mask[1:] & mask[:-1] & ~edge[1:-1]
    begins, ends = mask.copy(), mask.copy()
    begins[1:] &= ~joined
    ends[:-1] &= ~joined
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(offsets, starts, side="right") - 1


@lru_cache(maxsize=2)
def _powers(length: int) -> np.ndarray:
    return np.cumprod(np.full(length, _BASE, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash per span: a polynomial over its bytes, then mixed. Equal spans, equal hashes."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    longest = 1 << int(lengths.max()).bit_length()
    values = (data[within + np.repeat(starts, lengths)].astype(np.uint64) + np.uint64(1)) * _powers(longest)[within]
    return mix(np.add.reduceat(values, first))


def per_text(doc: np.ndarray, texts: int) -> np.ndarray:
    """How many spans each text has, and so the bounds of its spans: ``texts + 1`` numbers."""
    return np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=texts)))).astype(np.int64)
