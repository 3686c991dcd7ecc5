"""Periodic runs in word sequences, by dyadic square catching.

A run is a stretch of words with smallest period q and a length of at least max(6, 4 q) that neither neighbour extends.

1. Words are appended from left to right. Level l keeps a catcher for every completed block of 2**l words (aligned). With
   each appended word, the one catcher of the level whose block lies 2**l to 2**(l + 1) - 1 words back compares it with the
   suffix of 2**l words: where they are equal, their distance d is the period of a square in the making. Which comparison
   a word sets off depends on earlier words alone, so those of all words of a piece are done at once, level by level, with
   hashes of 2**l words made from two of 2**(l - 1).
2. Every run of period d (2**l <= d < 2**(l + 1)) is at least 4 d long and holds two neighbouring blocks that are caught at
   distance d. Neighbouring catches of one distance merge into a chain; only chains of two or more are extended to
   both sides, by less than a block, comparing prefix hashes by halves.
3. Chains that extend to the same stretch are one run, whose period is the least of theirs: a stretch with smallest
   period q is found at q, at 2 q and so on, and by the theorem of Fine and Wilf at no other distance.

Work is n log n for n words, memory a few numbers per word. One pass over the table, no shuffle. Several short texts are
one piece, parted by words that occur once. Hashes have 64 bits that are mixed at each level; those of the extension are two
of 31 bits modulo primes, so words of regular build (Thue and Morse) do not make them collide.

Null or empty text: no words, no runs, hashes of the empty string. Repeated rows are reported each. A null doc_id counts as
the text 'null' where a number is drawn from it and stays null. Other columns are not read. An empty table gives no rows.
A text of 50 MB takes about 600 MB in its task."""
from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import table
from .tokens import PLAIN, mix, range_hash, words

SHORTEST, FACTOR = 6, 4
#: Words handled at once where an array is only needed in passing.
CHUNK = 1 << 18

_PRIMES = (2147483629, 2147483587)
_BASES = (1103515249, 1664525221)


class _Prefix:
    """Equality of two stretches of a sequence by prefix sums modulo two primes."""

    def __init__(self, h: np.ndarray):
        self.sums, self.power = [], []
        for p, b in zip(_PRIMES, _BASES):
            up = np.ones(len(h) + 1, np.uint64)
            k = 1
            while k < len(up):
                m = min(k, len(up) - k)
                up[k:k + m] = up[:m] * np.uint64(pow(b, k, p)) % np.uint64(p)
                k *= 2
            s = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(h % np.uint64(p) * up[:-1] % np.uint64(p), out=s[1:])
            self.sums.append(s % np.uint64(p))
            self.power.append(up)

    def same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the words a .. a + size equal those at b, a < b."""
        good = np.ones(len(a), bool)
        for p, s, up in zip(_PRIMES, self.sums, self.power):
            p = np.uint64(p)
            good &= (s[a + size] + p - s[a]) % p * up[b - a] % p == (s[b + size] + p - s[b]) % p
        return good


def _chains(caught: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last suffix start of each chain: catches a block apart from each other, two at least."""
    step = 1 << level
    x = np.flatnonzero(caught)
    before = np.zeros(len(x), bool)
    before[x >= step] = caught[x[x >= step] - step]
    after = np.zeros(len(x), bool)
    inside = x + step < len(caught)
    after[inside] = caught[x[inside] + step]
    head, tail = x[~before & after], x[before & ~after]
    # Along one residue heads and tails take turns.
    return head[np.lexsort((head, head % step))], tail[np.lexsort((tail, tail % step))]


def runs(h: np.ndarray, longest: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of a sequence of word hashes, by start and period. longest: no run is longer."""
    n = len(h)
    longest = n if longest is None else min(n, longest)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    prefix: _Prefix | None = None
    suffix, level = h.copy(), 0
    while FACTOR << level <= max(longest, FACTOR) and len(suffix) > 1 << level:
        step = 1 << level
        caught = np.zeros(len(suffix), bool)
        for lo in range(step, len(suffix), CHUNK):
            x = np.arange(lo, min(lo + CHUNK, len(suffix)))
            caught[x] = suffix[((x >> level) - 1) << level] == suffix[x]
        head, tail = _chains(caught, level)
        d = step + head % step
        good = tail - head + d + step + 2 * (step - 1) >= np.maximum(FACTOR * d, SHORTEST)
        if good.any():
            head, tail, d = head[good], tail[good], d[good]
            prefix = prefix or _Prefix(h)
            start, end = head - d, tail + step
            for k in range(level - 1, -1, -1):
                size = 1 << k
                room = np.flatnonzero(start >= size)
                room = room[prefix.same(start[room] - size, start[room] - size + d[room], size)]
                start[room] -= size
                room = np.flatnonzero(end + size <= n)
                room = room[prefix.same(end[room] - d[room], end[room], size)]
                end[room] += size
            keep = end - start >= np.maximum(FACTOR * d, SHORTEST)
            found.append((start[keep], end[keep] - start[keep], d[keep]))
        if len(suffix) <= step:
            break
        suffix = mix(suffix[:-step] * np.uint64(0x9E3779B97F4A7C15) + suffix[step:])
        level += 1
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, length, period = (np.concatenate(c).astype(np.int64) for c in zip(*found))
    by = np.lexsort((period, length, start))
    start, length, period = start[by], length[by], period[by]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[first], length[first], period[first]
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def looped(n: int, doc_id: int | None) -> np.ndarray | None:
    """For each word of a text of n words the original word that stands in its place; null if the text stays as it is."""
    h = zlib.crc32(str("null" if doc_id is None else doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    src = np.arange(n)
    src[a:] = a + (src[a:] - a) % p
    return src


def _kept(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Words that no run holds behind its first period."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start + period, 1)
    np.add.at(step, start + length, -1)
    return np.cumsum(step[:-1]) == 0


def _collapsed(raw: memoryview, start: np.ndarray, end: np.ndarray, keep: np.ndarray) -> str:
    """SHA-256 of the kept words, joined by spaces."""
    digest = hashlib.sha256()
    for lo in range(0, len(keep), CHUNK):
        part = keep[lo:lo + CHUNK]
        if (np.diff(part) == 1).all():
            parts = bytes(raw[start[part[0]]:end[part[-1]]]).split()
        else:
            parts = [raw[a:b] for a, b in zip(start[part].tolist(), end[part].tolist())]
        digest.update((b" " if lo else b"") + b" ".join(parts))
    return digest.hexdigest()


def _best(start: list[int], length: list[int], period: list[int]) -> tuple[int, int, int]:
    """The run of greatest length / period, exactly; of equal ones the first. Runs come by start and period."""
    b = 0
    for i in range(1, len(start)):
        if length[i] * period[b] > length[b] * period[i]:
            b = i
    return start[b], length[b], period[b]


_RESULT = ("doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string, "
           "n_words bigint, n_kept bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>")
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _finder(loops: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for w in words(batch.column(1)):
                yield _found(w, ids[w.rows.start:w.rows.stop], loops)
    return run


def _found(w, ids: list[int | None], loops: bool) -> pa.RecordBatch:
    """Runs of the texts of a piece."""
    h = range_hash(w.data, w.start, w.end, PLAIN)
    raw = memoryview(w.data)
    sizes = np.diff(w.first)
    source = [looped(int(n), i) if loops else None for n, i in zip(sizes, ids)]
    changed = h.copy()
    for a, src in zip(w.first, source):
        if src is not None:
            changed[a:a + len(src)] = h[a + src]
    # A word of its own behind each text.
    row = w.row
    sequence = mix(np.arange(1, len(h) + len(ids) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    sequence[np.arange(len(h)) + row] = changed
    first = w.first[:-1] + np.arange(len(ids))
    start, length, period = runs(sequence, int(sizes.max(initial=0)))
    edge = np.searchsorted(start, np.append(first, len(sequence)))
    out: list[tuple] = []
    for k, (i, n, src) in enumerate(zip(ids, sizes.tolist(), source)):
        s, m, q = start[edge[k]:edge[k + 1]] - first[k], length[edge[k]:edge[k + 1]], period[edge[k]:edge[k + 1]]
        words_at = w.first[k] + (np.arange(n) if src is None else src)
        keep = words_at if not len(s) else words_at[_kept(n, s, m, q)]
        listed = list(zip(s.tolist(), m.tolist(), q.tolist()))
        best = (*_best(*map(list, zip(*listed))),) if listed else (None,) * 3
        milli = 1000 * best[1] // best[2] if listed else None
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in listed)
        out.append((i, len(listed), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), _collapsed(raw, w.start, w.end, keep), n, len(keep),
                    [{"start": a, "length": b, "period": c} for a, b, c in listed]))
    names = [c.split()[0] for c in _RESULT.split(", ")]
    types = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.int64()] * 2 + [_RUNS]
    cols = list(zip(*out)) if out else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", loops: bool = False) -> DataFrame:
    """One row per text: counts of words, runs and words left when every run is cut to its first period, the run of
    greatest exponent, digests of the runs and of the text that is left, and all runs. loops: a tenth of the texts, drawn
    by doc_id, first become periodic from some word on."""
    plain = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return plain.mapInArrow(_finder(loops), _RESULT)


def op11_square_catching(spark, folder: str) -> DataFrame:
    return find_runs(table(spark, folder, "documents"), loops=True).drop("runs")
