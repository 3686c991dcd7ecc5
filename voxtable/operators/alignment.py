"""Two transcripts of one recording side by side: matched words, stretches that differ, and the in-step word count.

Words are dense (clip_id, i, t, ...) from 0 on each side. ``aligned`` gives the word pairs of a longest common subsequence. A
clip of up to PIECE words a side is aligned exactly. A longer one is first cut at runs of words that occur once on either
side and lie in order, pieces that are still longer at such runs of their own, with shorter runs, and what then is too long and
shares no such run at equal shares. Inside a piece one row of the table is one integer, a bit per word, and only every
so many rows are kept, so memory grows with the piece's length times the root of it, in bits."""
from __future__ import annotations

from math import isqrt

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import fixed, text
from ..functions.intervals import points_in
from ..functions.seq import BLOCK, fresh, neighbours, running
from ..functions.stage import spread, stage
from .paths import path

PIECE = max(64, 4 * BLOCK)
RUNS = (5, 3, 2, 1)
#: Words of a side that a walker out of step takes in one round.
STRIDE = min(1024, 8 * BLOCK)


def common(a: list[str], b: list[str]) -> tuple[list[int], list[int]]:
    """Index pairs of a longest common subsequence. Equal heads are paired; otherwise the first list gives way if that
    costs nothing.

    A row is kept as the set of places, from the end of b, where the length does not grow."""
    n, m = len(a), len(b)
    full, holds = (1 << m) - 1, {}
    for j, w in enumerate(b):
        holds[w] = holds.get(w, 0) | 1 << (m - 1 - j)
    strip = max(64, isqrt(n) + 1)

    def above(row: int, w: str) -> int:
        hit = row & holds.get(w, 0)
        return ((row + hit) | (row - hit)) & full if hit else row

    row, kept = full, {}
    for i in range(n, -1, -1):
        if i < n:
            row = above(row, a[i])
        if i % strip == 0 or i == n:
            kept[i] = row
    length = m - row.bit_count()
    left, right, rows, low = [], [], [], -1
    i = j = 0
    while i < n and j < m and length:
        if a[i] == b[j]:
            left.append(i)
            right.append(j)
            i, j, length = i + 1, j + 1, length - 1
        elif a[i] not in holds:
            i += 1
        else:
            if i // strip != low:
                low = i // strip
                top = min(n, (low + 1) * strip)
                rows = [kept[top]]
                for k in range(top - 1, low * strip, -1):
                    rows.append(above(rows[-1], a[k]))
                rows.reverse()                          # the row below row i is rows[i - low * strip]
            rest = m - j
            if rest - (rows[i - low * strip] & (full >> j)).bit_count() == length:
                i += 1
            else:
                j += 1
    return left, right


def _extent(a: DataFrame, b: DataFrame) -> DataFrame:
    n = a.groupBy("clip_id").agg(F.count("*").alias("a_hi")).join(fresh(b.groupBy("clip_id").agg(F.count("*").alias("b_hi"))), "clip_id", "full").na.fill(0)
    zero = F.lit(0).cast("bigint")
    return n.select("clip_id", zero.alias("a_lo"), "a_hi", zero.alias("b_lo"), "b_hi")


_KEY = ["clip_id", "a_lo", "b_lo"]


def _inside(words: DataFrame, pieces: DataFrame, side: str) -> DataFrame:
    spans = fresh(pieces.select(*_KEY, F.col(f"{side}_lo").alias("__lo"), F.col(f"{side}_hi").alias("__hi")))
    return points_in(words, spans, "i", ("__lo", "__hi"), width=4096).drop("__lo", "__hi")


def run_marks(a: DataFrame, b: DataFrame, pieces: DataFrame, width: int, every: int) -> DataFrame:
    """(key of the piece, ca, cb): places where a run of words begins that the piece holds once on each side, in one order on
    both; the first of so many words each."""
    def once(words, side, out):
        w = neighbours(words.select("clip_id", "i", "t"), "i", {f"t{k}": ("t", k) for k in range(1, width)}) if width > 1 else words.select("clip_id", "i", "t")
        last = f"t{width - 1}" if width > 1 else "t"
        w = _inside(w.filter(f"{last} IS NOT NULL"), pieces, side)
        run = F.concat_ws(" ", "t", *[f"t{k}" for k in range(1, width)])
        return w.groupBy(*_KEY, run.alias("run")).agg(F.count("*").alias("n"), F.min("i").alias(out)).filter("n = 1").drop("n")
    both = stage(once(a, "a", "ca").join(fresh(once(b, "b", "cb")), [*_KEY, "run"]).drop("run"), "runs")
    f = running(both, "ca", {"__max": ("max", "cb")}, keys=_KEY, exclusive=True)
    f = running(stage(f, "runs_up"), "ca", {"__min": ("min", "cb")}, keys=_KEY, exclusive=True, reverse=True)
    safe = f.filter("coalesce(__max, -1) < cb AND coalesce(__min, 9223372036854775807) > cb AND ca > a_lo AND cb > b_lo")
    return safe.groupBy(*_KEY, F.expr(f"ca DIV {every}").alias("__b")).agg(F.min_by("cb", "ca").alias("cb"), F.min("ca").alias("ca")).drop("__b")


def _split(pieces: DataFrame, marks: DataFrame) -> DataFrame:
    """Pieces cut at the marks inside them."""
    at = marks.select(*_KEY, "ca", "cb").unionByName(pieces.select(*_KEY, F.col("a_lo").alias("ca"), F.col("b_lo").alias("cb")))
    n = running(stage(at, "marks"), "ca", {"__n": ("last", F.struct("ca", "cb"))}, keys=_KEY, exclusive=True, reverse=True, order=["ca", "cb"])
    n = n.join(fresh(pieces), _KEY)
    return n.select("clip_id", F.col("ca").alias("a_lo"), F.coalesce("__n.ca", "a_hi").alias("a_hi"), F.col("cb").alias("b_lo"), F.coalesce("__n.cb", "b_hi").alias("b_hi"))


def pieces_of(a: DataFrame, b: DataFrame, size: int = PIECE) -> DataFrame:
    """(clip_id, a_lo, a_hi, b_lo, b_hi): stretches to align on their own, none longer than size on either side."""
    pieces = stage(_extent(a, b), "pieces")
    longest = F.greatest(F.col("a_hi") - F.col("a_lo"), F.col("b_hi") - F.col("b_lo"))
    for width in RUNS:
        large = pieces.filter(longest > size)
        if large.isEmpty():
            return pieces
        pieces = stage(pieces.filter(longest <= size).unionByName(_split(large, run_marks(a, b, large, width, max(1, size // 4)))), "pieces")
    parts = F.ceil(longest / size)
    share = lambda side, t: F.expr(f"{side}_lo + ({side}_hi - {side}_lo) * {t} DIV parts").alias
    cut = pieces.withColumn("parts", parts).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("parts"), F.lit(1)) - 1)))
    cut = cut.withColumn("parts", F.greatest(F.col("parts"), F.lit(1)))
    return stage(cut.select("clip_id", share("a", "k")("a_lo"), share("a", "(k + 1)")("a_hi"), share("b", "k")("b_lo"), share("b", "(k + 1)")("b_hi")), "pieces")


def aligned(a: DataFrame, b: DataFrame, size: int = PIECE) -> DataFrame:
    """(clip_id, ca, cb): the matched words."""
    a, b = (stage(w.select("clip_id", "i", "t"), "side") for w in (a, b))
    pieces = pieces_of(a, b, size)

    def match(key, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        x, y = x.sort_values("i"), y.sort_values("i")
        left, right = common(x["t"].tolist(), y["t"].tolist())
        return pd.DataFrame({"clip_id": key[0], "ca": x["i"].to_numpy()[left], "cb": y["i"].to_numpy()[right]}, columns=["clip_id", "ca", "cb"])

    sides = [spread(_inside(w, pieces, s), *_KEY).groupBy(*_KEY) for w, s in ((a, "a"), (b, "b"))]
    return stage(sides[0].cogroup(sides[1]).applyInPandas(match, "clip_id bigint, ca bigint, cb bigint"), "matches")


def transcript_drift(caption: DataFrame, heard: DataFrame, size: int = PIECE) -> DataFrame:
    """Stretches where captions and heard words disagree: (clip_id, kind, at_us, caption, heard): what lies between two matched
    words that follow each other."""
    sides = [stage(w.select("clip_id", F.col("i").cast("bigint").alias("i"), "text", "start_us", text.norm_surface("text").alias("t")), "drift_side") for w in (caption, heard)]
    pairs = aligned(*sides, size)
    ends = _extent(*sides).select("clip_id", F.explode(F.array(F.struct(F.lit(-1).cast("bigint").alias("ca"), F.lit(-1).cast("bigint").alias("cb")), F.struct(F.col("a_hi").alias("ca"), F.col("b_hi").alias("cb")))).alias("x"))
    marks = pairs.unionByName(ends.select("clip_id", "x.ca", "x.cb"))
    gaps = running(marks, "ca", {"__n": ("last", F.struct("ca", "cb"))}, exclusive=True, reverse=True)
    gaps = gaps.filter("__n.ca - ca > 1 OR __n.cb - cb > 1").select("clip_id", F.col("ca").alias("ga"), (F.col("ca") + 1).alias("a_lo"), F.col("__n.ca").alias("a_hi"), (F.col("cb") + 1).alias("b_lo"), F.col("__n.cb").alias("b_hi"))
    gaps = stage(gaps, "gaps")

    def held(words, side):
        spans = fresh(gaps.filter(f"{side}_hi > {side}_lo").select("clip_id", "ga", F.col(f"{side}_lo").alias("__lo"), F.col(f"{side}_hi").alias("__hi")))
        w = points_in(words, spans, "i", ("__lo", "__hi"), width=512)
        listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), " ")
        return w.groupBy("clip_id", "ga").agg(listed.alias(f"{side}_text"), F.min_by("start_us", "i").alias(f"{side}_at"))
    j = gaps.select("clip_id", "ga").join(fresh(held(sides[0], "a")), ["clip_id", "ga"], "left").join(fresh(held(sides[1], "b")), ["clip_id", "ga"], "left")
    kind = F.when(F.col("b_text").isNull(), "caption_not_heard").when(F.col("a_text").isNull(), "heard_not_captioned").otherwise("differs")
    return j.select("clip_id", kind.alias("kind"), F.coalesce("b_at", "a_at").alias("at_us"), F.coalesce("a_text", F.lit("")).alias("caption"), F.coalesce("b_text", F.lit("")).alias("heard"))


# ---- in-step walk -------------------------------------------------------------------------------
def _hop(x: list[str], y: list[str]) -> tuple[int, int, int, int]:
    """How far the walk moves on either side from unequal heads, and the words it counts as missing and extra: to the nearest
    place, up to LOOK_AHEAD words on, where one head meets its like on the other side (the second side's on a tie)."""
    far = fixed.LOOK_AHEAD + 1
    on_y = y.index(x[0], 1) if x[0] in y[1:] else far
    on_x = x.index(y[0], 1) if y[0] in x[1:] else far
    if on_x == on_y == far:
        return 1, 1, 1, 1
    return (0, on_y, 0, on_y) if on_y <= on_x else (on_x, 0, on_x, 0)


def walk(x: list[str], y: list[str], to_x: int, to_y: int, marks: set[tuple[int, int]]) -> tuple[int, int, int, int]:
    """From the heads of x and y: where the walk stops (at a mark, or where a side's end is reached) and missing and extra words."""
    a = b = missing = extra = 0
    see = fixed.LOOK_AHEAD + 1
    while a < to_x and b < to_y:
        if x[a] == y[b]:
            a, b = a + 1, b + 1
        else:
            da, db, m, e = _hop(x[a:a + see], y[b:b + see])
            a, b, missing, extra = a + da, b + db, missing + m, extra + e
        if (a, b) in marks:
            break
    return a, b, missing, extra


def word_diff(guess: DataFrame, heard: DataFrame, stride: int = STRIDE) -> DataFrame:
    """Missing and extra words per clip by an in-order walk with a small look-ahead, and whether the heard transcript is believed
    (60 % of the words): (clip_id, missing, extra, accepted).

    A state of the walk is a pair of places. Walkers start at every shared run and at the beginning, and each leads to the next
    such pair it comes upon, or to where it stops after ``stride`` words; walkers that stopped elsewhere go on from there in
    the next round. Every state then points to one further on, and the walk is the path from the first."""
    prep = lambda w: w.select("clip_id", F.col("i").cast("bigint").alias("i"), text.norm_match("text", contractions=False).alias("t"))
    g, h = stage(prep(guess), "diff_guess"), stage(prep(heard), "diff_heard")
    size = stage(_extent(g, h), "diff_counts")
    runs = run_marks(g, h, size, 5, 256).select("clip_id", "ca", "cb")
    marks = stage(runs.unionByName(size.select("clip_id", F.lit(0).cast("bigint").alias("ca"), F.lit(0).cast("bigint").alias("cb"))), "diff_marks")
    look = fixed.LOOK_AHEAD

    def ahead(states: DataFrame, words: DataFrame, at: str) -> DataFrame:
        spans = fresh(states.select("clip_id", F.col("ca").alias("c0"), F.col("cb").alias("h0"), F.col(at).alias("__lo"), (F.col(at) + stride + look).alias("__hi")))
        return points_in(words, spans, "i", ("__lo", "__hi"), width=stride).select("clip_id", "c0", "h0", "i", "t")

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        c0, h0 = int(pdf["c0"].iloc[0]), int(pdf["h0"].iloc[0])
        x, y = (pdf.loc[pdf["s"] == s, "t"].tolist() for s in (0, 1))
        near = pdf[pdf["s"] == 2]
        at = set(zip((near["i"] - c0).tolist(), (near["o"] - h0).astype("int64").tolist()))
        a, b, m, e = walk(x, y, min(stride, len(x)), min(stride, len(y)), at)
        return pd.DataFrame({"clip_id": [pdf["clip_id"].iloc[0]], "ca": [c0], "cb": [h0], "na": [c0 + a], "nb": [h0 + b], "missing": [m], "extra": [e]})

    states, edges = marks, None
    none = F.lit(None).cast("bigint")
    while True:
        m = fresh(marks.select("clip_id", F.col("ca").alias("i"), F.col("cb").alias("o")))
        near = points_in(m, fresh(states.select("clip_id", F.col("ca").alias("c0"), F.col("cb").alias("h0"), (F.col("ca") + 1).alias("__lo"), (F.col("ca") + stride + 1).alias("__hi"))), "i", ("__lo", "__hi"), width=stride)
        sides = ahead(states, g, "ca").select("*", F.lit(0).alias("s"), none.alias("o")).unionByName(ahead(states, h, "cb").select("*", F.lit(1).alias("s"), none.alias("o")))
        sides = sides.unionByName(near.select("clip_id", "c0", "h0", "i", F.lit(None).cast("string").alias("t"), F.lit(2).alias("s"), "o"))
        found = stage(spread(sides, "clip_id", "c0", "h0").groupBy("clip_id", "c0", "h0").applyInPandas(go, "clip_id bigint, ca bigint, cb bigint, na bigint, nb bigint, missing bigint, extra bigint"), "diff_edges")
        edges = found if edges is None else edges.unionByName(found)
        n = fresh(size.select("clip_id", "a_hi", "b_hi"))
        loose = found.join(n, "clip_id").filter("na < a_hi AND nb < b_hi").select("clip_id", F.col("na").alias("ca"), F.col("nb").alias("cb")).distinct()
        states = stage(loose.join(fresh(edges.select("clip_id", "ca", "cb")), ["clip_id", "ca", "cb"], "left_anti").join(fresh(marks), ["clip_id", "ca", "cb"], "left_anti"), "diff_states")
        if states.isEmpty():
            break
    # A state's number grows along the walk.
    number = lambda a, b: F.expr(f"shiftleft({a} + {b}, 21) + {a} % 2097152")
    hops = edges.join(fresh(size.select("clip_id", "a_hi", "b_hi")), "clip_id").withColumn("at", number("ca", "cb"))
    end = (F.col("na") >= F.col("a_hi")) | (F.col("nb") >= F.col("b_hi"))
    hops = stage(hops.withColumn("nxt", F.when(~end, number("na", "nb"))).withColumn("rest_a", F.when(end, F.col("a_hi") - F.col("na")).otherwise(0)).withColumn("rest_b", F.when(end, F.col("b_hi") - F.col("nb")).otherwise(0)), "diff_hops")
    used = hops.join(path(hops, "at", "nxt", size=BLOCK << 21), ["clip_id", "at"], "left_semi")
    sums = used.groupBy("clip_id").agg(F.sum(F.col("missing") + F.col("rest_a")).alias("missing"), F.sum(F.col("extra") + F.col("rest_b")).alias("extra"))
    ok = (F.col("b_hi") > 0) & (F.col("b_hi") >= F.col("a_hi") * fixed.HEARD_MIN_SHARE)
    return size.join(fresh(sums), "clip_id", "left").select("clip_id", F.coalesce("missing", "a_hi").alias("missing"), F.coalesce("extra", "b_hi").alias("extra"), ok.alias("accepted"))
