"""Ordered computations that never put a whole clip in one task.

A clip may be arbitrarily long, so nothing here windows over ``clip_id`` alone. Rows are cut into
blocks of a fixed span of the ordering column (``clip_id, idx div size``):

* ``neighbours`` / ``framed``: rows near a block edge are also sent to the adjoining block, so
  lag, lead and bounded frames are exact inside every block after one shuffle;
* ``running``: the prefix inside the block plus the carry of the earlier blocks. Only one carry row
  per block is ordered per clip (1 row in ``size``).

``spaced`` is the greedy minimum-distance selection, cut into blocks of time in the same way: every
block reports where it ends for each possible hand-over, and the hand-overs are then chained.
"""
from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BLOCK = int(os.environ.get("VOXTABLE_BLOCK", "4096"))   # rows per block; tests shrink it
KEY = ("clip_id",)
_BLK, _OWN, _ORD = "__blk", "__own", "__ord"


def _block(idx: str, size: int) -> Column:
    return F.expr(f"CAST(floor({idx} / {size}) AS BIGINT)")


def halo(df: DataFrame, idx: str, back: int, fwd: int, size: int = BLOCK) -> DataFrame:
    """Adds block id and ownership; edge rows appear once more in the block that needs them."""
    if max(back, fwd) > size:
        raise ValueError("halo wider than a block")
    b = _block(idx, size)
    pos = F.expr(f"CAST({idx} - {size} * floor({idx} / {size}) AS BIGINT)")
    none = F.array().cast("array<bigint>")
    copies = F.concat(
        F.array(b),
        F.when(pos < fwd, F.array(b - 1)).otherwise(none),
        F.when(pos >= size - back, F.array(b + 1)).otherwise(none),
    )
    return (df.withColumn(_BLK, F.explode(copies))
              .withColumn(_OWN, F.col(_BLK) == _block(idx, size)))


def fresh(df: DataFrame) -> DataFrame:
    """The same rows under new column identities, for joining a table with something derived from it."""
    return df.toDF(*df.columns)


def block_window(keys=KEY):
    return W.partitionBy(*keys, _BLK)


def framed(df: DataFrame, idx: str, back: int, fwd: int, outs, keys=KEY, size: int = BLOCK,
           order=None, keep_block=False) -> DataFrame:
    """``outs(window)`` gives {name: column} using frames inside [-back, +fwd] positions of idx.

    ``keep_block`` leaves the block id in place, so a following ``running`` needs no new shuffle."""
    w = block_window(keys).orderBy(*(order or [idx]))
    out = halo(df, idx, back, fwd, size)
    for name, col in outs(w).items():
        out = out.withColumn(name, col)
    out = out.filter(F.col(_OWN)).drop(_OWN)
    return out if keep_block else out.drop(_BLK)


def neighbours(df: DataFrame, idx: str, specs: dict, keys=KEY, size: int = BLOCK, keep_block=False) -> DataFrame:
    """Adds lag/lead columns: {out: (column, offset)}, negative offsets look back. ``idx`` is dense."""
    back = max([-o for _, o in specs.values() if o < 0] or [0])
    fwd = max([o for _, o in specs.values() if o > 0] or [0])

    def outs(w):
        return {n: (F.lead(c, o) if o > 0 else F.lag(c, -o)).over(w) for n, (c, o) in specs.items()}
    return framed(df, idx, back, fwd, outs, keys, size, keep_block=keep_block)


def running(df: DataFrame, idx: str, outs: dict, keys=KEY, size: int = BLOCK, exclusive=False,
            reverse=False, order=None, keep_block=False) -> DataFrame:
    """Prefix aggregates in order of ``idx``: {out: (kind, expression)}, kind sum|max|min|last.

    ``reverse`` runs from the end (suffix), ``exclusive`` leaves the row itself out. ``order`` refines
    the order inside equal ``idx`` values. Carries are as many as blocks, so they are never sent through the driver:
    the rows are already dealt and sorted by block, as a merge join wants them. ``keep_block`` is that of ``framed``, for the same ``size``."""
    cols = [F.col(c) if isinstance(c, str) else c for c in (order or [idx])]
    asc = [c.desc() if reverse else c.asc() for c in cols]
    inner_w = block_window(keys).orderBy(*asc)
    frame = inner_w.rowsBetween(W.unboundedPreceding, -1 if exclusive else 0)
    agg = {"sum": F.sum, "max": F.max, "min": F.min}
    base = df if _BLK in df.columns else df.withColumn(_BLK, _block(idx, size))
    key = F.struct(*[(-c if reverse else c).alias(f"o{n}") for n, c in enumerate(cols)])
    inner, totals, carries = base, [], []
    blk_order = W.partitionBy(*keys).orderBy(F.col(_BLK).desc() if reverse else F.col(_BLK).asc())
    carry_frame = blk_order.rowsBetween(W.unboundedPreceding, -1)
    for n, (name, (kind, ex)) in enumerate(outs.items()):
        c = F.expr(ex) if isinstance(ex, str) else ex
        if kind == "last":
            inner = inner.withColumn(name, F.last(c, ignorenulls=True).over(frame))
            totals.append(F.max_by(c, F.when(c.isNotNull(), key)).alias(f"__t{n}"))
            carries.append(F.last(f"__t{n}", ignorenulls=True).over(carry_frame).alias(f"__c{n}"))
        else:
            inner = inner.withColumn(name, agg[kind](c).over(frame))
            totals.append(agg[kind](c).alias(f"__t{n}"))
            carries.append(agg[kind](f"__t{n}").over(carry_frame).alias(f"__c{n}"))
    carry = base.groupBy(*keys, _BLK).agg(*totals).select(*keys, _BLK, *carries)
    out = inner.join(carry.hint("merge"), [*keys, _BLK], "left")
    for n, (name, (kind, _)) in enumerate(outs.items()):
        here, before = F.col(name), F.col(f"__c{n}")
        both = {"sum": F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0)),
                "max": F.greatest(here, before), "min": F.least(here, before),
                "last": F.coalesce(here, before)}[kind]
        out = out.withColumn(name, both)
    return out.drop(*([] if keep_block else [_BLK]), *[f"__c{n}" for n in range(len(outs))])


def numbered(df: DataFrame, idx: str, out: str, keys=KEY, size: int = BLOCK, order=None) -> DataFrame:
    """Zero-based position in order of ``idx`` (sparse values allowed)."""
    return running(df, idx, {out: ("sum", F.lit(1).cast("bigint"))}, keys, size, order=order) \
        .withColumn(out, F.col(out) - 1)


def spaced(df: DataFrame, ts: str, gap: int, keys=KEY, span: int = 600_000_000,
           start: Column | None = None) -> DataFrame:
    """Greedy selection in time order: a row is chosen when it lies at least ``gap`` after the last one
    chosen. Equal times count once. Returns keys + ts of the chosen rows.

    Blocks of ``span`` time; a block's result depends on earlier blocks only through the last choice
    inside the ``gap`` before it, so each block is folded for every such hand-over."""
    span = max(span, gap)
    never = -(1 << 60)
    pts = df.select(*keys, F.col(ts).cast("bigint").alias("t")).distinct()
    own = F.expr(f"CAST(floor(t / {span}) AS BIGINT)")
    tail = F.expr(f"t - {span} * floor(t / {span}) > {span - gap}")
    rows = (pts.withColumn("tail", tail)
               .withColumn(_BLK, F.explode(F.when(F.col("tail"), F.array(own, own + 1)).otherwise(F.array(own))))
               .withColumn("mine", F.col(_BLK) == own))
    blocks = rows.groupBy(*keys, _BLK).agg(
        F.array_sort(F.collect_list(F.when(F.col("mine"), F.col("t")))).alias("ts"),
        F.array_sort(F.collect_list(F.when(~F.col("mine"), F.col("t")))).alias("entries"))
    step = ("IF(t - acc.last >= {gap}, named_struct('last', t, 'out', concat(acc.out, array(t))), acc)"
            .format(gap=gap))
    fold = ("aggregate(ts, named_struct('last', CAST({s} AS BIGINT), 'out', CAST(array() AS array<bigint>)),"
            " (acc, t) -> {step})")
    end_of = ("aggregate(ts, CAST({s} AS BIGINT), (acc, t) -> IF(t - acc >= {gap}, t, acc))")
    exits = blocks.withColumn("exits", F.expr(
        "transform(concat(array(CAST({n}L AS BIGINT)), entries), s -> named_struct('k', s, 'v', {e}))".format(
            n=never, e=end_of.format(s="s", gap=gap))))
    # chain the hand-overs: one small row per block of media time; a block that ends the same way
    # whatever came before starts a new chain
    grp = W.partitionBy(*keys).orderBy(_BLK)
    resets = F.expr("size(array_distinct(transform(exits, x -> x.v))) = 1")
    linked = (exits.select(*keys, _BLK, "exits")
              .withColumn("resets", resets)
              .withColumn("start", F.coalesce(F.lag(_BLK).over(grp) < F.col(_BLK) - 1, F.lit(True)) | F.lag("resets").over(grp))
              .withColumn("before", F.lag("exits").over(grp)))
    chains = linked.withColumn("chain", F.sum(F.col("start").cast("int")).over(grp))
    carried = "coalesce(try_element_at(filter(x.exits, y -> y.k = {v}), 1).k, {n}L)"
    first = carried.format(v="get(x.before, 0).v", n=never)
    following = carried.format(v="try_element_at(filter(x.before, z -> z.k = acc.s), 1).v", n=never)
    chained = (chains.groupBy(*keys, "chain")
        .agg(F.array_sort(F.collect_list(F.struct(F.col(_BLK).alias("b"), "exits", "before"))).alias("links"))
        .withColumn("links", F.expr(
            "aggregate(links, named_struct('s', CAST(NULL AS BIGINT), 'out', CAST(array() AS array<struct<b:bigint,s:bigint>>)),"
            " (acc, x) -> named_struct('s', IF(acc.s IS NULL, {f}, {g}), 'out',"
            " concat(acc.out, array(named_struct('b', x.b, 's', IF(acc.s IS NULL, {f}, {g}))))))".format(f=first, g=following)))
        .select(*keys, F.explode("links.out").alias("l"))
        .select(*keys, F.col("l.b").alias(_BLK), F.col("l.s").alias("entry")))
    entry = blocks.drop("entries").join(fresh(chained), [*keys, _BLK])
    chosen = entry.withColumn("t", F.explode(F.expr(fold.format(s="entry", step=step) + ".out")))
    return chosen.select(*keys, F.col("t").alias(ts))
