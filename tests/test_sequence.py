"""The block-wise helpers against plain Python, with blocks small enough to have many seams."""
import random

from pyspark.sql import functions as F

from voxtable.functions.intervals import latest, merged, outside, overlap_join
from voxtable.functions.seq import neighbours, running, spaced
from voxtable.operators.paths import path
from voxtable.operators import automaton


def data(seed, clips=3, n=60):
    r = random.Random(seed)
    return [(c, i, r.randrange(-5, 9)) for c in range(clips) for i in range(n + 7 * c)]


def test_running_matches_prefixes(spark):
    d = data(1)
    df = spark.createDataFrame(d, "clip_id bigint, i bigint, v bigint")
    for reverse in (False, True):
        for exclusive in (False, True):
            got = {(r.clip_id, r.i): (r.s, r.m, r.l) for r in running(
                df, "i", {"s": ("sum", "v"), "m": ("max", "v"), "l": ("last", F.when(F.col("v") > 4, F.col("v")))},
                size=8, reverse=reverse, exclusive=exclusive).collect()}
            for c in range(3):
                seq = [(i, v) for k, i, v in d if k == c]
                seq = seq[::-1] if reverse else seq
                for n, (i, _) in enumerate(seq):
                    seen = [v for _, v in seq[:n if exclusive else n + 1]]
                    big = [v for v in seen if v > 4]
                    assert got[c, i] == (sum(seen), max(seen) if seen else None, big[-1] if big else None)


def test_neighbours_cross_seams(spark):
    df = spark.createDataFrame(data(2), "clip_id bigint, i bigint, v bigint")
    by = {(c, i): v for c, i, v in data(2)}
    for r in neighbours(df, "i", {"a": ("v", -3), "b": ("v", 2)}, size=4).collect():
        assert (r.a, r.b) == (by.get((r.clip_id, r.i - 3)), by.get((r.clip_id, r.i + 2)))


def test_spaced_is_the_greedy_choice(spark):
    r = random.Random(3)
    for gap, span in ((5, 7), (9, 20), (3, 100)):
        pts = [(c, t) for c in range(4) for t in sorted(r.choices(range(300), k=90))]
        got = sorted((x.clip_id, x.t) for x in spaced(spark.createDataFrame(pts, "clip_id bigint, t bigint"), "t", gap, span=span).collect())
        want = []
        for c in range(4):
            last = None
            for k, t in pts:
                if k == c and (last is None or t - last >= gap):
                    want.append((c, t))
                    last = t
        assert got == sorted(want)


def test_path_follows_pointers(spark):
    r = random.Random(4)
    hops = [(c, i, i + r.randrange(1, 9) if r.random() < 0.98 else None) for c in range(3) for i in range(100)]
    hops = [(c, i, n if n is not None and n < 100 else None) for c, i, n in hops]
    got = sorted((x.clip_id, x.i) for x in path(spark.createDataFrame(hops, "clip_id bigint, i bigint, n bigint"), "i", "n", size=8).collect())
    want, link = [], {(c, i): n for c, i, n in hops}
    for c in range(3):
        i = 0
        while i is not None:
            want.append((c, i))
            i = link[c, i]
    assert got == sorted(want)


def test_automaton_composes_blocks(spark):
    d = data(5)
    df = spark.createDataFrame([(c, i, v % 3) for c, i, v in d], "clip_id bigint, unit bigint, v bigint")
    import numpy as np

    def table(pdf):                       # state: sum modulo 5, doubled on v == 2
        s = np.arange(5)[None, :]
        v = pdf["v"].to_numpy()[:, None]
        return np.where(v == 2, (2 * s + 1) % 5, (s + v) % 5)
    got = {(r.clip_id, r.unit): r.state for r in automaton.run(df, "unit", table, 3, size=8).collect()}
    for c in range(3):
        s = 3
        for k, i, v in d:
            if k == c:
                s = (2 * s + 1) % 5 if v % 3 == 2 else (s + v % 3) % 5
                assert got[c, i] == s


def test_interval_algebra(spark, rows):
    spans = rows("clip_id bigint, a bigint, b bigint", (1, 0, 4), (1, 4, 6), (1, 10, 30), (1, 12, 14), (2, 5, 9))
    ext = rows("clip_id bigint, total bigint", (1, 40), (2, 9), (3, 7))
    got = sorted(tuple(r) for r in merged(spans, "a", "b", width=8).select("clip_id", "a", "b").collect())
    assert got == [(1, 0, 6), (1, 10, 30), (2, 5, 9)]
    free = sorted(tuple(r) for r in outside(spans, ext, "a", "b", "total", width=8).select("clip_id", "a", "b").collect())
    assert free == [(1, 6, 10), (1, 30, 40), (2, 0, 5), (3, 0, 7)]
    pts = rows("clip_id bigint, t bigint", (1, 3), (1, 11), (2, 4))
    last = sorted((r.clip_id, r.t, r.b) for r in latest(pts, spans, "t", "a", ["b"], width=8).collect())
    assert last == [(1, 3, 4), (1, 11, 30), (2, 4, None)]
    other = rows("clip_id bigint, c bigint, d bigint", (1, 3, 11), (2, 9, 12))
    hit = sorted((r.a, r.c) for r in overlap_join(spans, other, ("a", "b"), ("c", "d"), width=3).collect())
    assert hit == [(0, 3), (4, 3), (10, 3)]
    assert sorted(r.a for r in overlap_join(spans, other, ("a", "b"), ("c", "d"), width=3, how="left_anti").collect()) == [5, 12]
