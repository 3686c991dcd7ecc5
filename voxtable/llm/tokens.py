"""Word tokens of whole text columns, hashed with numpy over the Arrow buffers.

A word is a maximal run of bytes other than space and 0x09-0x0D; A-Z count as a-z. Its 64-bit hash is a
polynomial over random byte codes modulo 2**64, then mixed. All bytes of a batch are handled at once, so
no Python object is made per word. Two different words share a hash with a chance of about 2**-63 per pair.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is one piece by itself. Scratch arrays hold some numbers per byte of a piece,
#: and a worker keeps its memory for the stages that follow.
PIECE = 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 1
_GAPS = np.array([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D], dtype=np.uint8)


def _codes() -> np.ndarray:
    codes = np.random.RandomState(20).randint(1, 1 << 62, 256, dtype=np.int64).astype(np.uint64)
    codes[65:91] = codes[97:123]
    codes[_GAPS] = 0
    return codes


_CODE = _codes()
#: Codes that tell all bytes apart.
PLAIN = np.random.RandomState(21).randint(1, 1 << 62, 256, dtype=np.int64).astype(np.uint64)
_GAP = np.isin(np.arange(256, dtype=np.uint8), _GAPS)
_POWER: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of them. Those of a piece are kept."""
    if "up" not in _POWER:
        _POWER["up"], _POWER["down"] = _listed_powers(PIECE + 1)
    return (_POWER["up"], _POWER["down"]) if n <= PIECE + 1 else _listed_powers(n)


def _listed_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        a = np.full(n, base, dtype=np.uint64)
        a[0] = 1
        out.append(np.cumprod(a))
    return tuple(out)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, which come by rising start. A hash depends on the range's bytes alone, so long data are handled in
    stretches of whole ranges."""
    if len(data) > PIECE and len(start) > 1:
        out, i = np.zeros(len(start), np.uint64), 0
        while i < len(start):
            lo = int(start[i])
            j = max(i + 1, int(np.searchsorted(start, lo + PIECE // 2)))
            wide = np.flatnonzero(end[i:j] - lo > PIECE)
            j = max(i + 1, i + int(wide[0])) if len(wide) else j
            out[i:j] = range_hash(data[lo:int(end[i:j].max())], start[i:j] - lo, end[i:j] - lo, codes)
            i = j
        return out
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(codes[data] * up[:len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


@dataclass
class Words:
    """hash, start and end byte (within ``data``) of each word; words of row i are first[i]:first[i + 1]."""

    data: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    rows: slice

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=wide)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets


def _words(data: np.ndarray, offsets: np.ndarray, rows: slice, gaps: np.ndarray) -> Words:
    lo, n = int(offsets[0]), int(offsets[-1] - offsets[0])
    part, edges = data[lo:lo + n], offsets - lo
    solid = np.zeros(n + 2, dtype=np.int8)
    solid[1:-1] = ~gaps[part]
    step = np.diff(solid)
    # A row's edge parts words, too.
    inner = edges[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    inner = np.unique(inner[(solid[inner] == 1) & (solid[inner + 1] == 1)])
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if len(inner):
        start, end = np.sort(np.concatenate([start, inner])), np.sort(np.concatenate([end, inner]))
    return Words(part, range_hash(part, start, end, _CODE), start, end, np.searchsorted(start, edges), rows)


def pieces(offsets: np.ndarray, size: int = PIECE) -> Iterator[slice]:
    """Consecutive rows of about so many bytes, at least one row each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1))
        yield slice(i, j)
        i = j


def words(column: pa.Array, size: int = PIECE, gaps: np.ndarray = _GAP) -> Iterator[Words]:
    """The words of a string column, for a few rows at a time. gaps: whether each byte parts words."""
    data, offsets = buffers(column)
    for rows in pieces(offsets, size):
        yield _words(data, offsets[rows.start:rows.stop + 1], rows, gaps)


def grams(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of so many words; the run that starts at word i is at i. Runs may span rows."""
    if len(h) < width:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(h) - width + 1, dtype=np.uint64)
    for k in range(width):
        out = out * np.uint64(_BASE) + h[k:len(h) - width + 1 + k]
    return mix(out)
