"""Near-duplicate documents by an LSH forest of MinHash signatures, confirmed on whole shingle sets.

1. One pass hashes every 5-word shingle of a text and takes 64 minima: the signature. Texts of equal shingle sets
   (two hashes of the set and its size) form one class at once; only the least doc_id of a class goes on.
2. The forest: the same signature is written in 16 orders (tree t starts at value 4t). Each tree is one sorted
   sequence, range-partitioned, so a group of any size lies over as many partitions as it needs. In sorted order the
   neighbours of a row are those of the longest common prefix. Rows within 16 places that share at least the first
   value are candidates: where few texts share a value this is depth one, and where thousands do, the neighbours
   are those that agree deepest, so the depth adapts to the region. Rows beside a partition's edge are compared in a
   second, small pass. Candidates stay if half of the 64 values agree (a pair of similarity 0.75 misses that with a
   chance of about 1e-5).
3. Links are confirmed on the full sets: 100 * intersection >= 75 * union. The forest is searched twice. First each row
   names the most similar of its neighbours in every tree, and every document is compared with the best of these below
   it, which ties most groups together. The second search names all candidates whose ends are not yet in one
   component; a pair inside a component cannot change the result, so a large group of copies costs a link per member.
4. Where more rows share a prefix than the window holds, and they are not one component, the whole region is compared on full
   sets (see ``crowds``).

A pair of similarity 0.75 shares the first value in a tree with chance 0.75, so outside crowded regions it escapes all
16 trees with a chance below 1e-9; in crowds of up to CELL rows a cell it escapes with a chance of 2e-5.

Null or empty text: empty set, own component, kept. Fewer than five words: the whole word sequence is one shingle.
Repeated doc_ids are treated as one document of either text (ids are expected to be unique). Null doc_ids are dropped.
Other columns are not read. An empty table gives no rows."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.taskcontext import TaskContext

from voxtable.functions.stage import stage

from .common import components, only, shuffle_partitions, table
from .crowds import crowd_links
from .tokens import Words, grams, mix, words

WIDTH = 5
VALUES, TREES, PREFIX, WINDOW = 64, 16, 6, 16
AGREE = VALUES // 2

_FACTORS = (np.random.RandomState(5).randint(1, 1 << 62, VALUES, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)


def shingles(w: Words, width: int = WIDTH) -> list[np.ndarray]:
    """For each row the hashes of its shingles, in text order, repeats included."""
    g = grams(w.hash, width)
    out = []
    for a, b in zip(w.first[:-1], w.first[1:]):
        n = int(b - a)
        out.append(g[a:b - width + 1] if n >= width else grams(w.hash[a:b], n) if n else g[:0])
    return out


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for w in words(batch.column(1)):
            sets = shingles(w)
            n = np.zeros(len(sets), np.int64)
            key = np.zeros((len(sets), 2), np.uint64)
            for i, s in enumerate(sets):
                s = np.unique(s)
                n[i] = len(s)
                key[i] = s.sum(), mix(s ^ np.uint64(0x5BD1E995)).sum()
            full = np.flatnonzero(n)
            sig = np.zeros((len(full), VALUES), np.uint32)
            if len(full):
                flat = np.concatenate([sets[i] for i in full])
                at = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]]).astype(np.int64)
                for j in range(VALUES):
                    sig[:, j] = np.minimum.reduceat(((flat * _FACTORS[j]) >> np.uint64(32)).astype(np.uint32), at)
            packed: list[bytes | None] = [None] * len(sets)
            for k, i in enumerate(full):
                packed[i] = sig[k].tobytes()
            yield pa.RecordBatch.from_arrays(
                [ids.slice(w.rows.start, len(sets)), pa.array(n), pa.array(key[:, 0].view(np.int64)), pa.array(key[:, 1].view(np.int64)), pa.array(packed, pa.binary())],
                ["doc_id", "n_shingles", "k1", "k2", "signature"])


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each signature in every order: the first values as a sortable key, and a byte of every value to compare by."""
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, VALUES)
        sketch = pa.array([x.tobytes() for x in sig.astype(np.uint8)], pa.binary())
        for t in range(TREES):
            order = (np.arange(PREFIX) + t * (VALUES // TREES)) % VALUES
            keys = [x.tobytes() for x in sig[:, order].astype(">u4")]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, t, np.int32)), pa.array(keys, pa.binary()), batch.column(0), batch.column(1), sketch],
                                             ["tree", "prefix", "doc_id", "group", "sketch"])


class _Run:
    """Sorted rows of trees: tree and first value as one number, doc_id, group, sketch."""

    def __init__(self, tree, prefix, ids, group, sketch):
        head = np.frombuffer(b"".join(p[:4] for p in prefix), ">u4").astype(np.int64)
        self.head, self.ids, self.group = np.asarray(tree, np.int64) * (1 << 32) + head, np.asarray(ids, np.int64), np.asarray(group, np.int64)
        self.sketch = np.frombuffer(b"".join(sketch), np.uint8).reshape(-1, VALUES)


def _near(run: _Run, every: bool, skip: int = 0, until: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs of a later row (from skip on) with rows of other groups up to WINDOW before it (before until):
    every one, or the most similar one."""
    rows = np.arange(max(skip, 1), len(run.ids))
    best = np.zeros((2, len(run.ids)), np.int64)
    out = []
    for s in range(1, WINDOW + 1):
        rows = rows[rows >= s]
        rows = rows[run.head[rows] == run.head[rows - s]]
        if not len(rows):
            break
        take = rows[run.group[rows] != run.group[rows - s]]
        take = take if until is None else take[take - s < until]
        same = (run.sketch[take] == run.sketch[take - s]).sum(axis=1)
        good = same >= AGREE
        take, same = take[good], same[good]
        if every:
            out.append((take, take - s, same))
        else:
            better = same > best[0, take]
            best[:, take[better]] = same[better], take[better] - s
    if not every:
        take = np.flatnonzero(best[0])
        out.append((take, best[1, take], best[0, take]))
    later, earlier, same = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
    x, y = run.ids[later], run.ids[earlier]
    return np.minimum(x, y), np.maximum(x, y), same


def _record(pairs: tuple, edge: int | None = None, end: int | None = None, rows: list | None = None) -> pa.RecordBatch:
    """Pairs (edge null) and rows beside a partition's edge (a, b null)."""
    a, b, same = pairs
    n, rows = len(a), rows or []
    none, k = [None] * n, len(rows)
    tree, prefix, ids, group, sketch = zip(*rows) if rows else ((),) * 5
    cols = [([*a, *[None] * k], pa.int64()), ([*b, *[None] * k], pa.int64()), ([*same, *[None] * k], pa.int32()), (none + [edge] * k, pa.int32()), (none + [end] * k, pa.int32()),
            (none + list(range(k)), pa.int32()), (none + list(tree), pa.int32()), (none + list(prefix), pa.binary()), (none + list(ids), pa.int64()), (none + list(group), pa.int64()), (none + list(sketch), pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in cols], ["a", "b", "same", "edge", "side", "ord", "tree", "prefix", "doc_id", "group", "sketch"])


_FOUND = "a bigint, b bigint, same int, edge int, side int, ord int, tree int, prefix binary, doc_id bigint, group bigint, sketch binary"


def _scan(every: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        tail: list[tuple] = []
        head: list[tuple] = []
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            head += rows[:max(0, WINDOW - len(head))]
            joined = tail + rows
            if joined:
                yield _record(_near(_Run(*zip(*joined)), every, skip=len(tail)))
            tail = joined[-WINDOW:]
        if head:
            yield _record(((), (), ()), part - 1, 1, head)
            yield _record(((), (), ()), part, 0, tail)
    return run


def _seam(every: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Rows on both sides of one partition edge."""
        rows = rows.sort_values(["side", "ord"])
        before = int((rows["side"] == 0).sum())
        a, b, same = _near(_Run(*(rows[c].to_list() for c in ("tree", "prefix", "doc_id", "group", "sketch"))), every, skip=before, until=before)
        return pd.DataFrame({"a": a, "b": b, "same": same})
    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for w in words(batch.column(1)):
            sets = [np.unique(s).view(np.int64) for s in shingles(w)]
            edges = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(sets)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.rows.start, len(sets)), values], ["doc_id", "grams"])


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, k1, k2, signature): set size, two hashes of the set, and the 64 minima (null for empty sets)."""
    plain = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    return plain.mapInArrow(_signatures, "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, signature binary")


def candidates(signed: DataFrame, every: bool) -> DataFrame:
    """Pairs (a, b, same) of the forest, a < b, same = agreeing values, from (written) rows (doc_id, group, signature):
    pairs of different groups; all of them, or for each row and tree the most similar one."""
    # A partition holds many windows, so that a window reaches over one edge at most.
    parts = max(1, min(shuffle_partitions(signed.sparkSession), signed.count() * TREES // (50 * WINDOW)))
    trees = (signed.select("doc_id", "group", "signature").mapInArrow(_trees, "tree int, prefix binary, doc_id bigint, group bigint, sketch binary")
             .repartitionByRange(parts, "tree", "prefix", "doc_id").sortWithinPartitions("tree", "prefix", "doc_id"))
    found = stage(trees.mapInArrow(_scan(every), _FOUND), "found")
    edges = found.where("edge is not null").groupBy("edge").applyInPandas(_seam(every), "a bigint, b bigint, same int")
    return found.where("a is not null").select("a", "b", "same").unionAll(edges).groupBy("a", "b").agg(F.max("same").alias("same"))


def confirm(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the (written) pairs (a, b) whose full shingle sets reach the similarity; docs: (doc_id, text)."""
    ids = stage(pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select(F.col("b").alias("doc_id"))).distinct(), "ids")
    sets = only(docs, ids, "doc_id").mapInArrow(_sets, "doc_id bigint, grams array<bigint>")
    both = (pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("ga")), "a")
            .join(sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("gb")), "b"))
    shared = F.size(F.array_intersect("ga", "gb"))
    union = F.size("ga") + F.size("gb") - F.col("shared")
    return both.withColumn("shared", shared).where(100 * F.col("shared") >= 75 * union).select("a", "b")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: (doc_id, n_shingles, component_id, kept)."""
    plain = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    signed = stage(signatures(plain), "signed")
    # Equal sets: the class is named by its least doc_id. Empty sets stay by themselves.
    first = stage(signed.where("n_shingles > 0").groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep")), "first")
    member = stage(signed.where("n_shingles > 0").select("k1", "k2", "n_shingles", "doc_id").join(first, ["k1", "k2", "n_shingles"]).select("doc_id", "n_shingles", "rep"), "member")
    reps = signed.where("signature is not null").select("doc_id", "signature").join(first.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    reps = stage(reps.select("doc_id", F.col("doc_id").alias("group"), "signature"), "reps")
    closest = stage(candidates(reps, False).groupBy("b").agg(F.max_by("a", F.struct("same", -F.col("a"))).alias("a")).select("a", "b"), "closest")
    links = stage(confirm(closest, plain), "links")
    comp = stage(components(links), "components")
    grouped = stage(reps.join(comp.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "group").alias("group"), "signature"), "grouped")
    left = stage(candidates(grouped, True).select("a", "b").join(closest, ["a", "b"], "left_anti"), "left")
    if not left.isEmpty():
        more = stage(confirm(left, plain), "more")
        if not more.isEmpty():
            links = links.unionAll(more)
            comp = stage(components(links), "components")
            grouped = stage(reps.join(comp.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "group").alias("group"), "signature"), "grouped")
    inside = crowd_links(grouped, plain, _sets, VALUES, WINDOW)
    if inside is not None:
        inside = stage(inside, "inside")
        if not inside.isEmpty():
            comp = stage(components(links.unionAll(inside)), "components")
    named = member.join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    bare = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return named.unionAll(bare).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op5_minhash_forest(spark, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))
