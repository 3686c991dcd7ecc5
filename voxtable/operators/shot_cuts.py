"""Least-cost shots of a word stream, by min-plus products over blocks of words.

A shot that ends with word j begins at most the look-back before it (or is j alone), so what a block needs to know of
everything before it is the least cost of covering the words up to each boundary within that look-back. Costs are
whole billionths and add up exactly in any order.

1. A block is one row: its words as arrays, and before them the words that a shot ending in the block may begin with.
2. For every boundary it can be entered with, a block gives the least cost of each boundary it hands on: a matrix. All
   blocks of a batch are walked at once, word position by word position.
3. Along a clip entry costs times matrix give the next entry costs, in a stream of one small row per block.
4. Every block is then solved from its true entry costs, and each boundary points to the one its last shot begins at.
   The cuts are the path of pointers from the end of the clip."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import fixed
from ..functions.intervals import points_in
from ..functions.seq import BLOCK, fresh, neighbours
from ..functions.stage import spread, stage
from .paths import path

#: Words of a block, and blocks that are walked at once.
WORDS, TOGETHER = min(512, BLOCK), 64
NEVER = np.int64(1 << 60)
UNIT = 1e9


def blocks(q: DataFrame, size: int = WORDS) -> DataFrame:
    """(clip_id, b, base, final, next_head, i, start_us, end_us, bq): a row per block of words, with the words before it
    that a shot may begin with. q: dense words (clip_id, i, start_us, end_us, bq, last)."""
    look = fixed.SHOT_LOOKBACK_US
    q = stage(q.withColumn("b", F.expr(f"CAST(i DIV {size} AS BIGINT)")), "shot_words")
    spans = q.groupBy("clip_id", "b").agg(F.max("start_us").alias("lo"), (F.max("start_us") + look).alias("hi"))
    heads = stage(q.filter(F.col("i") % size == 0).select("clip_id", F.col("b").alias("to"), F.col("start_us").alias("head")), "shot_heads")
    near = points_in(heads, spans, "head", ("lo", "hi"), closed_end=True).filter("to > b")
    near = near.groupBy("clip_id", "b").agg(F.collect_list(F.struct("to", "head")).alias("near"))
    ahead = neighbours(heads.withColumnRenamed("to", "b"), "b", {"next_head": ("head", 1)}).drop("head")
    sent = q.join(fresh(near), ["clip_id", "b"], "left").withColumn("to", F.explode(F.expr(
        f"concat(array(b), transform(filter(coalesce(near, array()), x -> x.head <= start_us + {look}), x -> x.to))")))
    word = F.struct("i", "start_us", "end_us", "bq")
    rows = sent.groupBy("clip_id", "to").agg(F.array_sort(F.collect_list(word)).alias("w"), F.bool_or("last").alias("final")).withColumnRenamed("to", "b")
    rows = rows.join(fresh(ahead), ["clip_id", "b"], "left")
    return rows.select("clip_id", "b", (F.col("b") * size).alias("base"), "final", "next_head", F.col("w.i").cast("array<bigint>").alias("i"), "w.start_us", "w.end_us", "w.bq")


class _Batch:
    """Blocks side by side, their own words from position ``halo`` on."""

    def __init__(self, rows: list[dict]):
        self.rows, n = rows, len(rows)
        before = [int(np.searchsorted(r["i"], r["base"])) for r in rows]
        self.before, self.own = np.array(before), np.array([len(r["i"]) - b for r, b in zip(rows, before)])
        self.halo, self.width = int(self.before.max()), int(self.own.max())
        size = self.halo + self.width
        start, end, quality = (np.zeros((n, size), t) for t in (np.int64, np.int64, np.float64))
        reach = 1
        for k, r in enumerate(rows):
            at = slice(self.halo - before[k], self.halo + self.own[k])
            start[k, at], end[k, at], quality[k, at] = r["start_us"], r["end_us"], r["bq"]
            if r["final"]:
                quality[k, self.halo + self.own[k] - 1] = 0.0       # the end of the clip earns nothing
            first = np.searchsorted(r["start_us"], r["end_us"][before[k]:] - fixed.SHOT_LOOKBACK_US)
            reach = max(reach, int((np.arange(before[k], len(r["i"])) - first).max()) + 1)
        self.start = start
        # cost[position, block, words less one]; the latest beginning comes first and wins a tie
        position = self.halo + np.arange(self.width)
        begin = position[:, None] - np.arange(reach)[None, :]
        took = end[:, position].T[:, :, None] - start[:, np.maximum(begin, 0)].transpose(1, 0, 2)
        d = took / 1e6
        over, under = np.maximum(d - fixed.SHOT_MAX_S, 0.0), np.maximum(fixed.SHOT_MIN_S - d, 0.0)
        off = d - fixed.SHOT_TARGET_S
        cost = off * off + np.where(over > 0, 40 * (over * over) + 4, 0.0) + np.where(under > 0, 25 * (under * under) + 2, 0.0)
        cost = np.rint(cost * UNIT).astype(np.int64) - np.rint(quality[:, position].T * UNIT).astype(np.int64)[:, :, None]
        begin = begin[:, None, :]
        fits = (took <= fixed.SHOT_LOOKBACK_US) | (begin == position[:, None, None])
        fits &= (begin >= (self.halo - self.before)[None, :, None]) & (np.arange(self.width)[:, None] < self.own[None, :])[:, :, None]
        self.cost, self.reach = np.where(fits, cost, NEVER), reach

    def walk(self, entry: np.ndarray, pointers: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Least costs of all boundaries from entry costs (block, way in, words before the block), and how many words the
        last shot of each has."""
        n, ways, _ = entry.shape
        pad = max(0, self.reach - self.halo - 1)
        best = np.full((n, ways, pad + self.halo + self.width + 1), NEVER)
        zero = pad + self.halo
        best[:, :, zero - self.halo:zero + 1] = entry[:, :, ::-1]
        words = np.zeros((n, self.width), np.int64) if pointers else None
        for t in range(self.width):
            seen = best[:, :, zero + t - self.reach + 1:zero + t + 1][:, :, ::-1]
            total = seen + self.cost[t][:, None, :]
            least = total.min(axis=2)
            best[:, :, zero + t + 1] = np.minimum(least, NEVER)
            if pointers:
                words[:, t] = total[:, 0, :].argmin(axis=1) + 1
        return best[:, :, pad:], words

    def handed(self, k: int) -> int:
        """Boundaries the next block needs, from the end of this one backwards."""
        own = self.start[k, self.halo - self.before[k]:self.halo + self.own[k]]
        return 1 + len(own) - int(np.searchsorted(own, self.rows[k]["next_head"] - fixed.SHOT_LOOKBACK_US))


def least_cost_cuts(start_us: np.ndarray, end_us: np.ndarray, bq: np.ndarray, final: bool) -> list[int]:
    """The ends (exclusive) of the shots of one block of words that nothing comes before."""
    n = len(start_us)
    block = _Batch([{"i": np.arange(n), "base": 0, "start_us": start_us, "end_us": end_us, "bq": bq, "final": final, "next_head": None}])
    _, words = block.walk(np.zeros((1, 1, 1), np.int64), True)
    cuts, j = [], n
    while j:
        cuts.append(j)
        j -= int(words[0, j - 1])
    return cuts[::-1]


def _rows(batch: pa.RecordBatch) -> Iterator[list[dict]]:
    """Block rows as dicts with arrays, a few at a time."""
    lists = {c: batch.column(c) for c in ("i", "start_us", "end_us", "bq")}
    flat = {c: (np.asarray(x.offsets), np.asarray(x.values)) for c, x in lists.items()}
    rest = batch.drop_columns(list(lists)).to_pylist()
    for lo in range(0, len(rest), TOGETHER):
        yield [{**r, **{c: v[o[k]:o[k + 1]] for c, (o, v) in flat.items()}} for k, r in enumerate(rest[lo:lo + TOGETHER], lo)]


_MATRIX = "clip_id bigint, b bigint, ways int, costs array<bigint>"


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in _rows(batch):
            b = _Batch(rows)
            ways = b.halo + 1
            entry = np.full((len(rows), ways, ways), NEVER)
            entry[:, np.arange(ways), np.arange(ways)] = 0
            best, _ = b.walk(entry, False)
            out = []
            for k, r in enumerate(rows):
                if r["next_head"] is not None:
                    last = b.halo + b.own[k]
                    matrix = best[k, :b.before[k] + 1, last - b.handed(k) + 1:last + 1][:, ::-1]
                    out.append((r["clip_id"], r["b"], len(matrix), matrix.ravel()))
            if out:
                clip, at, n, costs = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(clip, pa.int64()), pa.array(at, pa.int64()), pa.array(n, pa.int32()), pa.array(costs, pa.list_(pa.int64()))], ["clip_id", "b", "ways", "costs"])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entry costs of the block behind each one; blocks of a clip come in order."""
    clip, entry = None, None
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if entry is None or r["clip_id"] != clip:
                clip, entry = r["clip_id"], np.zeros(1, np.int64)
            m = np.array(r["costs"], np.int64).reshape(r["ways"], -1)
            entry = np.minimum((entry[:, None] + m).min(axis=0), NEVER)
            out.append((clip, r["b"] + 1, entry.tolist()))
        if out:
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int64()))], ["clip_id", "b", "entry"])


_HOPS = "clip_id bigint, at bigint, nxt bigint, first_i bigint, last_i bigint, start_us bigint, end_us bigint"


def _pointers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in _rows(batch):
            b = _Batch(rows)
            entry = np.full((len(rows), 1, b.halo + 1), NEVER)
            for k, r in enumerate(rows):
                known = np.array([0] if r["entry"] is None else r["entry"], np.int64)
                entry[k, 0, :len(known)] = known
            _, words = b.walk(entry, True)
            for k, r in enumerate(rows):
                n = int(b.own[k])
                end = np.arange(n) + b.before[k]
                first = end + 1 - words[k, :n]
                i, cut = r["i"][first], r["i"][end] + 1
                nxt = pa.array(-i, mask=i == 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, r["clip_id"])), pa.array(-cut), nxt, pa.array(i), pa.array(cut - 1), pa.array(r["start_us"][first]), pa.array(r["end_us"][end])],
                                                 ["clip_id", "at", "nxt", "first_i", "last_i", "start_us", "end_us"])


def cut_shots(q: DataFrame, size: int = WORDS) -> DataFrame:
    """(clip_id, first_i, last_i, start_us, end_us) of the cheapest cover of each clip's words by shots. q: words with bq, how
    natural a cut behind them is, and last; i counts from 0."""
    rows = stage(blocks(q, size), "shot_blocks")
    costs = spread(rows.filter("next_head IS NOT NULL"), "clip_id", "b").mapInArrow(_matrices, _MATRIX)
    entries = spread(stage(costs, "shot_matrices"), "clip_id").sortWithinPartitions("clip_id", "b").mapInArrow(_chain, "clip_id bigint, b bigint, entry array<bigint>")
    known = spread(rows.join(fresh(stage(entries, "shot_entries")), ["clip_id", "b"], "left"), "clip_id", "b")
    hops = stage(known.mapInArrow(_pointers, _HOPS), "shot_hops")
    return hops.join(path(hops, "at", "nxt"), ["clip_id", "at"], "left_semi").drop("at", "nxt")
