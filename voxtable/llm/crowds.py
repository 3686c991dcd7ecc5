"""Links inside crowds: regions of the forest where more rows share a prefix than a window of neighbours can tell apart.

Texts of one template, say, resemble each other a little less than it takes to be linked, so that a pair that is linked
does not stand out among its neighbours in any sorted order. Such regions are searched whole:

1. A cell is all rows that share the first value in one of TREES orders; where that is more than CELL rows, those that share
   two values, and so on (adaptive depth). Cells of more rows than a window and of more than one component are crowded.
2. Only shingles that stand in more than one component of the crowd can be shared by a pair still to be linked. A document
   with fewer of them than three quarters of its own shingles has no such partner and is left out: so groups of copies and texts
   with much of their own go at once.
3. The rest of a cell is dealt into chunks, each two of which meet in one task. There the sizes of all intersections come from
   products of 0-1 matrices over the shared shingles, SIDE documents by SIDE at a time. These are exact counts on whole sets.
   Per pair of chunks at most one link per component is given (a spanning forest), since more would change nothing.

A pair of similarity 0.75 shares no cell of depth 1 with a chance of 0.25 ** TREES; at depth d, which takes crowds of
some CELL / 0.75 ** d rows or more, with (1 - 0.75 ** d) ** TREES."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxtable.functions.stage import spread, stage

from .common import only

TREES, DEPTH, CELL, CHUNK, SIDE = 8, 6, 8192, 2048, 256
#: Columns of a matrix.
COLUMNS = 1 << 14


def cells(grouped: DataFrame, values: int, window: int, cell: int = CELL) -> DataFrame:
    """(doc_id, tree, key, rows) of the crowded cells; grouped: (doc_id, group, signature of 4-byte values)."""
    step = values // TREES
    at = grouped.select("doc_id", "group", F.explode(F.expr(
        f"transform(sequence(0, {TREES - 1}), t -> named_struct('tree', t, 'order', substring(concat(signature, signature), t * {4 * step} + 1, {4 * DEPTH})))")).alias("x"))
    left = at.select("doc_id", "group", "x.tree", "x.order")
    out = None
    for depth in range(1, DEPTH + 1):
        keyed = stage(left.withColumn("key", F.expr(f"substring(order, 1, {4 * depth})")), "cells")
        size = keyed.groupBy("tree", "key").agg(F.count("*").alias("rows"), (F.min("group") != F.max("group")).alias("mixed")).where(f"mixed and rows > {window}").drop("mixed")
        size = stage(size, "cell-sizes")
        fit = size if depth == DEPTH else size.where(f"rows <= {cell}")
        found = keyed.join(fit, ["tree", "key"]).select("doc_id", "tree", "key", "rows")
        out = found if out is None else out.unionAll(found)
        large = size.where(f"rows > {cell}")
        if depth == DEPTH or large.isEmpty():
            return out
        left = keyed.join(large, ["tree", "key"], "left_semi").drop("key")


def _arrays(grams: pd.Series) -> list[np.ndarray]:
    return [np.asarray(g, np.int64) for g in grams]


def _shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of two lists of sets."""
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(flat_a, flat_b)
    out = np.zeros((len(a), len(b)), np.float32)
    for lo in range(0, len(both), COLUMNS):
        part = both[lo:lo + COLUMNS]
        sides = []
        for sets, flat in ((a, flat_a), (b, flat_b)):
            row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            at = np.minimum(np.searchsorted(part, flat), len(part) - 1)
            hit = part[at] == flat
            m = np.zeros((len(sets), len(part)), np.float32)
            m[row[hit], at[hit]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


class _Forest:
    """Which groups are tied."""

    def __init__(self, groups: np.ndarray):
        self.up = {int(g): int(g) for g in groups}

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def tie(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _tile(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between two chunks of a cell (or inside one)."""
    low, high = int(pdf["low"].iloc[0]), int(pdf["high"].iloc[0])
    forest, links = _Forest(pdf["group"].unique()), []
    sides = [pdf[pdf["chunk"] == c].sort_values("doc_id").reset_index(drop=True) for c in ((low, high) if low != high else (low,))]
    parts = [[s.iloc[k:k + SIDE] for k in range(0, len(s), SIDE)] for s in sides]
    pairs = [(x, y) for x in parts[0] for y in parts[1]] if low != high else [(x, y) for i, x in enumerate(parts[0]) for y in parts[0][i:]]
    for x, y in pairs:
        same = _shared(_arrays(x["grams"]), _arrays(y["grams"]))
        n, m = x["n"].to_numpy()[:, None], y["n"].to_numpy()[None, :]
        gx, gy = x["group"].to_numpy(), y["group"].to_numpy()
        good = (100 * same >= 75 * (n + m - same)) & (gx[:, None] != gy[None, :])
        ids = x["doc_id"].to_numpy(), y["doc_id"].to_numpy()
        for i, j in zip(*np.nonzero(good)):
            if forest.tie(int(gx[i]), int(gy[j])):
                links.append((min(ids[0][i], ids[1][j]), max(ids[0][i], ids[1][j])))
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def crowd_links(grouped: DataFrame, docs: DataFrame, sets, values: int, window: int, cell: int = CELL) -> DataFrame | None:
    """Links (a, b) between components inside crowds, or None if there is no crowd. grouped: (doc_id, group, signature); docs: (doc_id,
    text); sets: the function that maps Arrow batches of these to (doc_id, grams)."""
    at = stage(cells(grouped, values, window, cell), "crowded")
    if at.isEmpty():
        return None
    ids = stage(at.select("doc_id").distinct(), "crowd-ids")
    held = only(docs, ids, "doc_id").mapInArrow(sets, "doc_id bigint, grams array<bigint>").dropDuplicates(["doc_id"])
    held = stage(held.join(grouped.select("doc_id", "group"), "doc_id"), "crowd-sets")
    grams = held.select("doc_id", "group", F.size("grams").cast("bigint").alias("n"), F.explode("grams").alias("gram"))
    useful = grams.groupBy("gram").agg((F.min("group") != F.max("group")).alias("mixed")).where("mixed").select("gram")
    kept = grams.join(useful, "gram").groupBy("doc_id", "group", "n").agg(F.collect_list("gram").alias("grams")).where("100 * size(grams) >= 75 * n")
    kept = stage(kept, "crowd-kept")
    chunks = f"cast(ceil(rows / {CHUNK}) as int)"
    dealt = at.join(kept, "doc_id").withColumn("chunk", F.expr(f"cast(pmod(xxhash64(doc_id, tree), {chunks}) as int)")).withColumn("other", F.explode(F.expr(f"sequence(0, {chunks} - 1)")))
    dealt = dealt.select("tree", "key", "doc_id", "group", "n", "grams", "chunk", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"))
    return spread(dealt, "tree", "key", "low", "high").groupBy("tree", "key", "low", "high").applyInPandas(_tile, "a bigint, b bigint").distinct()
