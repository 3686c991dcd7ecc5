"""Joins and algebra on time spans. Every join key carries a time bucket, so a long clip is spread."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .seq import running

SECOND = 1_000_000


def _buckets(lo: str, hi: str, width: int | str) -> Column:
    first, last = f"CAST(floor({lo} / {width}) AS BIGINT)", f"CAST(floor({hi} / {width}) AS BIGINT)"
    return F.expr(f"explode(sequence({first}, greatest({first}, {last})))")


def overlap_join(left: DataFrame, right: DataFrame, l_span, r_span, width: int | tuple[str, str] = 10 * SECOND,
                 keys=("clip_id",), closed=False, how: str = "inner", on: Column | None = None) -> DataFrame:
    """Pairs whose spans overlap (``closed`` also pairs spans that only touch).

    ``l_span``/``r_span`` are (low, high) column names, distinct between the sides. Each pair meets in
    the first bucket both sides share. ``how`` may be inner, left_semi or left_anti. ``width`` may name a column of
    each side instead, equal for rows that can meet."""
    ll, lh, rl, rh = *l_span, *r_span
    lw, rw = width if isinstance(width, tuple) else (width, width)
    b = "__bucket"
    first = F.expr(f"greatest(CAST(floor({ll} / {lw}) AS BIGINT), CAST(floor({rl} / {rw}) AS BIGINT))")
    op = (F.col(ll) <= F.col(rh)) & (F.col(rl) <= F.col(lh)) if closed else \
        (F.col(ll) < F.col(rh)) & (F.col(rl) < F.col(lh))
    lk = [f"__l_{k}" for k in keys]
    if how == "inner":
        a = left.select("*", _buckets(ll, lh, lw).alias(b))
        c = right.select("*", _buckets(rl, rh, rw).alias(b))
        cond = op & (F.col(b) == first)
        if on is not None:
            cond = cond & on
        return a.join(c, [*keys, b]).filter(cond).drop(b)
    tagged = left.withColumn("__row", F.struct(*[F.col(c) for c in left.columns]))
    pairs = overlap_join(tagged.select(*dict.fromkeys([*keys, ll, lh, *([lw] if isinstance(lw, str) else [])]), "__row"), right, l_span, r_span, width, keys, closed, on=on)
    hits = pairs.select("__row").distinct()
    return tagged.join(hits, "__row", how).drop("__row", *lk)


def points_in(points: DataFrame, spans: DataFrame, at: str, span, width: int = 10 * SECOND,
              keys=("clip_id",), closed_end=False) -> DataFrame:
    """Point rows joined with every span that holds them: low <= t < high (or <= high)."""
    lo, hi = span
    b = "__bucket"
    p = points.withColumn(b, F.expr(f"CAST(floor({at} / {width}) AS BIGINT)"))
    s = spans.select("*", _buckets(lo, hi, width).alias(b))
    end = F.col(at) <= F.col(hi) if closed_end else F.col(at) < F.col(hi)
    return p.join(s, [*keys, b]).filter((F.col(at) >= F.col(lo)) & end).drop(b)


def latest(points: DataFrame, starts: DataFrame, at: str, start: str, values, keys=("clip_id",),
           width: int = 60 * SECOND) -> DataFrame:
    """As-of: the last row of ``starts`` with start <= t, its ``values`` NULL when there is none."""
    p = points.select("*", F.col(at).alias("__t"), F.lit(1).alias("__kind"),
                      F.lit(None).cast(starts.select(F.struct(*values)).schema[0].dataType).alias("__v"))
    cols = [F.col(c) if c in keys else F.lit(None).cast(t).alias(c)
            for c, t in points.dtypes]
    s = starts.select(*cols, F.col(start).alias("__t"), F.lit(0).alias("__kind"), F.struct(*values).alias("__v"))
    both = running(p.unionByName(s), "__t", {"__v": ("last", "__v")}, keys, width, order=["__t", "__kind"])
    return both.filter("__kind = 1").select(*points.columns, *[F.col(f"__v.{v}").alias(v) for v in values])


def merged(spans: DataFrame, lo: str, hi: str, keys=("clip_id",), width: int = 60 * SECOND) -> DataFrame:
    """Union of spans as sorted disjoint ones; spans that touch are one."""
    r = running(spans, lo, {"__before": ("max", hi)}, keys, width, exclusive=True, order=[lo, hi], keep_block=True)
    r = r.withColumn("__new", F.when(F.col("__before") >= F.col(lo), 0).otherwise(1).cast("bigint"))
    r = running(r.drop("__before"), lo, {"__isle": ("sum", "__new")}, keys, width, order=[lo, hi])
    return r.groupBy(*keys, "__isle").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("__isle")


def outside(spans: DataFrame, extent: DataFrame, lo: str, hi: str, total: str, keys=("clip_id",),
            width: int | str = 60 * SECOND) -> DataFrame:
    """The parts of [0, total) that no span covers, as (low, high). ``extent`` has one row per clip.

    Works on overlapping spans: the covered end is a running maximum. ``width`` may be a column of the spans."""
    r = running(spans, lo, {"__end": ("max", hi)}, keys, width, order=[lo, hi], keep_block=True)
    r = running(r, lo, {"__next": ("last", lo)}, keys, width, exclusive=True, reverse=True, order=[lo, hi])
    after = (r.join(extent.select(*keys, total), list(keys))
              .select(*keys, F.col("__end").alias(lo), F.coalesce("__next", total).alias(hi)))
    head = (extent.join(spans.groupBy(*keys).agg(F.min(lo).alias("__first")), list(keys), "left")
                  .select(*keys, F.lit(0).cast("bigint").alias(lo), F.coalesce("__first", total).alias(hi)))
    return head.unionByName(after).filter(F.col(hi) > F.col(lo))
