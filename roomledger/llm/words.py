"""Words and lines of a batch of texts as numpy arrays, without a Python loop per word.

A text column arrives from Spark as an Arrow array: one byte buffer and row offsets. A
*segment* is a maximal run of bytes that are not delimiters; words are the segments
between ``[\\x20\\x09-\\x0D]``, lines those between ``\\n``. Each gets a 64-bit hash from
a polynomial over its bytes, read off running sums, so the cost is a few passes over the
buffer. Two different segments share a hash with probability about 2**-64.

Memory: ``slices`` cuts a batch into runs of rows of bounded size, and the passes over
bytes work in blocks of ``BLOCK`` bytes, so only the word arrays of one slice are held.
A row larger than the slice is a slice of its own.

Null text counts as empty, and an empty text has no segments.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
BLOCK = 1 << 19

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NEWLINE = np.zeros(256, dtype=bool)
NEWLINE[0x0A] = True

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    out[0] = 1
    return np.multiply.accumulate(out)


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))
LOWER = np.arange(256)
LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE_LOWER = _BYTE[LOWER]
_TABLES: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_TABLES.get("up", ())) < n:
        _TABLES["up"], _TABLES["down"] = _powers(_BASE, n), _powers(_INVERSE, n)
    return _TABLES["up"], _TABLES["down"]


class Segments(NamedTuple):
    """``rows[i]:rows[i + 1]`` are the segments of row ``i``; starts and ends are bytes."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    rows: np.ndarray


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; nulls become empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    n, kind = len(texts), np.int64 if wide else np.int32
    if not n or offsets is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(n + 1, dtype=np.int64)
    at = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.zeros(0, dtype=np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about ``most`` bytes."""
    i = batch.schema.get_field_index(column)
    sizes = pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes, dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def segments(data: np.ndarray, at: np.ndarray, delimiter: np.ndarray = SPACE, lower: bool = False) -> Segments:
    """Segments of every row. ``lower`` hashes A-Z as a-z."""
    values = _BYTE_LOWER if lower else _BYTE
    first = np.zeros(len(data) + 1, dtype=bool)
    first[at] = True  # a row's first byte begins a segment of its own
    parts: list[tuple[np.ndarray, ...]] = []
    lo, size = 0, BLOCK
    while lo < len(data):
        hi = min(lo + size, len(data))
        inside = ~delimiter[data[lo:hi]]
        if hi < len(data) and inside[-1] and not first[hi]:
            # Cut at the last place where no segment is open.
            gaps = np.flatnonzero(~inside | first[lo:hi])
            gaps = gaps[gaps > 0]
            if not len(gaps):
                size *= 2
                continue
            hi = lo + int(gaps[-1])
            inside = inside[: hi - lo]
        parts.append(_block(data[lo:hi], inside, first[lo : hi + 1], values, lo))
        lo, size = hi, BLOCK
    if parts:
        start, end, hashed = (np.concatenate(x) for x in zip(*parts, strict=True))
    else:
        start = end = np.zeros(0, dtype=np.int64)
        hashed = np.zeros(0, dtype=_U)
    return Segments(start, end, hashed, np.searchsorted(start, at))


def _block(data, inside, first, values, lo):
    n = len(data)
    up, down = _power_tables(n)
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | first[1:n]
    closes[:-1] &= ~inside[1:] | first[1:n]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, dtype=_U)
        np.cumsum(values[data] * up[:n], out=total[1:])
        hashed = mix((total[end] - total[start]) * down[start] + (end - start).astype(_U))
    return start + lo, end + lo, hashed


def windows(hashes: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside a row, and the run's first word."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        out = hashes[: n - width + 1].copy()
        for k in range(1, width):
            out = out * _U(_BASE) + hashes[k : n - width + 1 + k]
    valid = np.ones(n + 1, dtype=bool)
    for k in range(1, width):
        last = rows[1:] - k
        valid[last[last >= rows[:-1]]] = False
    begin = np.flatnonzero(valid[: n - width + 1])
    return mix(out[begin]), begin


def row_of(rows: np.ndarray) -> np.ndarray:
    """The row of every segment."""
    return np.repeat(np.arange(len(rows) - 1), np.diff(rows))


def per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of set flags in each row."""
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Flags of the keys that occur twice or more."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), dtype=bool)
    place = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[place] == keys
