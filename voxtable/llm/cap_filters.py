"""Similarity join of vectors by spherical-cap filters, with links verified in double precision.

1. Equal vectors form one class; only the class goes on, with its size.
2. Filters are directions from random product codes: the coordinates, after a random rotation, are cut into four
   blocks, every block has its own few random unit codewords, and any choice of one codeword per block is a filter.
   A vector belongs to every filter whose cap it lies in (inner product of at least alpha). All of them are listed
   by adding the scores of two blocks each, sorting the two halves and taking the pairs of sums that reach alpha.
   The number of codewords follows the number of vectors, so that caps hold a constant share of FILL vectors, and
   alpha is the height at which a cap covers LISTED filters per vector and code. A vector in few caps lowers its own
   alpha until it is in LEAST, which can only add meetings.
3. Vectors meet in the filters they share. A filter with many members is dealt out in tiles (pairs of chunks), so no
   task gets more than two chunks. A pair that meets in several filters counts in the least of them.
4. Output stays linear: a tile yields, for every vector, its number of partners and the least vector it is tied to.

Vectors that are null or zero, or hold null or non-finite components, link with nothing; so do vectors of different
lengths. Repeated vec_ids count as separate rows of one id (ids are expected to be unique). Null ids are dropped;
other columns are not read. An empty table gives no rows. Meetings are random: with two codes of 24 filters each a pair
at cosine 0.95 shares about 20 filters; recall is measured in the tests and in the README."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxtable.functions.stage import stage

from .common import BROADCAST_IDS, components, shuffle_partitions, table

COSINE = 0.95
BLOCKS, CODES, LISTED, LEAST, FILL, TILE = 4, 2, 24, 14, 48, 384


def _height(dim: int, share: float) -> float:
    """The inner product with a fixed direction that this share of the unit sphere exceeds."""
    t = np.linspace(-1, 1, 200_001)
    density = np.power(np.maximum(1 - t * t, 0), (dim - 3) / 2) if dim > 2 else np.ones_like(t)
    tail = np.cumsum(density[::-1])[::-1]
    return float(t[np.searchsorted(-tail, -share * tail[0])])


class Code:
    """A random product code for vectors of one length."""

    def __init__(self, dim: int, vectors: int, seed: int):
        r = np.random.RandomState(1000 * dim + seed)
        self.blocks = max(1, min(BLOCKS, dim // 2))
        filters = max(LISTED * 4, vectors * LISTED / FILL)
        self.words = max(2, int(np.ceil(filters ** (1 / self.blocks))))
        self.turn = np.linalg.qr(r.randn(dim, dim))[0]
        self.cut = np.array_split(np.arange(dim), self.blocks)
        books = [r.randn(self.words, len(c)) for c in self.cut]
        self.books = [b / np.linalg.norm(b, axis=1, keepdims=True) / np.sqrt(self.blocks) for b in books]
        self.alpha = _height(dim, min(0.5, LISTED / self.words ** self.blocks))

    def scores(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the scores of the first and of the last blocks, for every choice of codewords."""
        turned = unit @ self.turn
        parts = [turned[:, c] @ b.T for c, b in zip(self.cut, self.books)]
        half = (self.blocks + 1) // 2

        def sums(group):
            out = group[0]
            for g in group[1:]:
                out = (out[:, :, None] + g[:, None, :]).reshape(len(out), -1)
            return out
        return sums(parts[:half]), sums(parts[half:]) if parts[half:] else np.zeros((len(unit), 1))

    def lists(self, unit: np.ndarray) -> Iterator[np.ndarray]:
        """For each vector the numbers of the filters that hold it."""
        for left, right in zip(*self.scores(unit)):
            by = np.argsort(-right)
            down, alpha, wanted = -right[by], self.alpha, min(LEAST, left.size * right.size)
            while True:
                some = np.flatnonzero(left >= alpha - right[by[0]])
                n = np.searchsorted(down, left[some] - alpha, side="right")
                if n.sum() >= wanted:
                    break
                alpha -= 0.01
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(some, n) * right.size + by[at]


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _decoder(sizes: dict[int, int], full: bool):
    """sizes: classes of each vector length. Rows (rep, m, embedding) become a row per filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = {dim: [Code(dim, n, k) for k in range(CODES)] for dim, n in sizes.items()}
        for whole in batches:
            for o in range(0, len(whole), 512):
                batch = whole.slice(o, 512)
                reps, m, column = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
                dims = column.value_lengths().to_numpy()
                for dim in np.unique(dims):
                    rows = np.flatnonzero(dims == dim)
                    v = column.take(pa.array(rows)).flatten().to_numpy().astype(np.float64).reshape(len(rows), dim)
                    unit = _unit(v)
                    lists = [np.sort(np.concatenate([f * CODES + k for k, f in enumerate(fs)])) for fs in zip(*(c.lists(unit) for c in codes[dim]))]
                    n = [len(x) for x in lists]
                    out = [np.repeat(np.full(len(rows), dim), n).astype(np.int32), np.concatenate(lists).astype(np.int64)]
                    if full:
                        every = np.repeat(np.arange(len(rows)), n)
                        raw, own = pa.array([x.tobytes() for x in v], pa.binary()), pa.array([x.astype(np.int64).tobytes() for x in lists], pa.binary())
                        out += [reps[rows][every], m[rows][every], raw.take(pa.array(every)), own.take(pa.array(every))]
                    names = ["dim", "cap", "rep", "m", "raw", "own"]
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out], names[:len(out)])
    return run


def _links(cap: int, reps: np.ndarray, m: np.ndarray, raw: list[bytes], own: list[bytes], side: np.ndarray):
    """Links among the members of a tile: (rep, partners, least tied rep). side: 0 and 1 for the two chunks of a
    tile of different chunks, which are compared with each other only; all 0 for others."""
    v = np.frombuffer(b"".join(raw), np.float64).reshape(len(reps), -1)
    scaled = v / np.abs(v).max(axis=1, keepdims=True)
    norm = np.linalg.norm(scaled, axis=1)
    near = scaled @ scaled.T >= COSINE * norm[:, None] * norm[None, :]
    np.fill_diagonal(near, False)
    if side.any():
        near &= side[:, None] != side[None, :]
    rows = np.flatnonzero(near.any(axis=1))
    if not len(rows):
        return None
    near, reps, m = near[np.ix_(rows, rows)], reps[rows], m[rows]
    lists = [np.frombuffer(own[i], np.int64) for i in rows]
    lower = [x[x < cap] for x in lists]
    seen, at = np.unique(np.concatenate(lower), return_inverse=True)
    if len(seen):
        flags = np.zeros((len(rows), len(seen)), np.float32)
        flags[np.repeat(np.arange(len(rows)), [len(x) for x in lower]), at] = 1
        near &= flags @ flags.T == 0
    n = near @ m
    tied = reps.copy()
    while True:
        now = np.minimum(tied, np.where(near, tied[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (now == tied).all():
            break
        tied = now
    keep = n > 0
    return reps[keep], n[keep], tied[keep]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (dim, cap, x, y, rep, m, raw, own, side): runs of equal dim, cap, x, y are tiles."""
    held: pa.Table | None = None

    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        key = np.stack([t[c].to_numpy().astype(np.int64) for c in ("dim", "cap", "x", "y")])
        edges = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [t.num_rows]])
        reps, m, side = (t[c].to_numpy() for c in ("rep", "m", "side"))
        raw, own = t["raw"].to_pylist(), t["own"].to_pylist()
        out = []
        for a, b in zip(edges[:-1], edges[1:]):
            if b - a > 1 and (found := _links(int(key[1, a]), reps[a:b], m[a:b], raw[a:b], own[a:b], side[a:b])) is not None:
                out.append(found)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], ["rep", "n", "tied"])

    for batch in batches:
        t = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        last = [t[c][-1].as_py() for c in ("dim", "cap", "x", "y")]
        same = np.ones(t.num_rows, bool)
        for c, value in zip(("dim", "cap", "x", "y"), last):
            same &= t[c].to_numpy() == value
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield from solve(t.slice(0, cut))
        held = t.slice(cut)
    if held is not None and held.num_rows:
        yield from solve(held)


def vector_links(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per vector: (vec_id, n_links, component_id, kept)."""
    spark = vectors.sparkSession
    parts = shuffle_partitions(spark)
    plain = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).where("vec_id is not null")
    fit = F.coalesce(F.size("v") > 0, F.lit(False)) & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    keyed = plain.withColumn("fit", fit).withColumn("k1", F.xxhash64("v")).withColumn("k2", F.xxhash64(F.lit(1), "v"))
    classes = stage(keyed.where("fit").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.min_by("v", "vec_id").alias("v")), "classes")
    member = stage(keyed.where("fit").select("k1", "k2", "vec_id").join(classes.select("k1", "k2", "rep", "m"), ["k1", "k2"]).select("vec_id", "rep", "m"), "member")
    reps = classes.select("rep", "m", "v")
    # One row per vector length that occurs.
    sizes = {r[0]: r[1] for r in classes.groupBy(F.size("v")).count().collect()}
    caps = reps.mapInArrow(_decoder(sizes, False), "dim int, cap bigint")
    crowded = stage(caps.groupBy("dim", "cap").count().where(F.col("count") > TILE).select("dim", "cap", F.ceil(F.col("count") / TILE).cast("int").alias("chunks")), "crowded")
    if crowded.count() <= BROADCAST_IDS:
        crowded = F.broadcast(crowded)
    rows = reps.mapInArrow(_decoder(sizes, True), "dim int, cap bigint, rep bigint, m bigint, raw binary, own binary").join(crowded, ["dim", "cap"], "left")
    mine = F.pmod(F.xxhash64("rep", "cap"), F.col("chunks")).cast("int")
    dealt = (rows.withColumn("mine", F.coalesce(mine, F.lit(0)))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)))
             .select("dim", "cap", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "rep", "m", "raw", "own", (F.col("mine") > F.col("other")).cast("int").alias("side")))
    keys = ["dim", "cap", "x", "y"]
    found = stage(dealt.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(_meet, "rep bigint, n bigint, tied bigint"), "found")
    n = stage(found.groupBy("rep").agg(F.sum("n").alias("n")), "counts")
    comp = components(found.select(F.col("rep").alias("a"), F.col("tied").alias("b")))
    per = stage(n.join(comp.withColumnRenamed("id", "rep"), "rep", "left"), "per")
    linked = member.join(per, "rep", "left").select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    bare = keyed.where("not fit").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(bare).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op4_cap_filters(spark, folder: str) -> DataFrame:
    return vector_links(table(spark, folder, "embeddings"))
