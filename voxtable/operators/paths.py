"""Sequential picks written as pointers: every row names the row the walk would visit next."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.seq import BLOCK, KEY, fresh
from ..functions.stage import spread, stage


def path(hops: DataFrame, idx: str, nxt: str, keys=KEY, size: int = BLOCK) -> DataFrame:
    """Rows visited from the smallest ``idx`` of each clip by following ``nxt`` (NULL ends the walk).

    Pointers only lead forward. Inside a block the walk is followed for the rows that an earlier block
    points to; only those few exits are ordered per clip; then each block is walked from its true entry."""
    ks = list(keys)
    types = dict(hops.dtypes)
    key_sql = ", ".join(f"{k} {types[k]}" for k in ks)
    h = hops.select(*ks, F.col(idx).cast("bigint").alias("at"), F.col(nxt).cast("bigint").alias("to"))
    h = h.withColumn("blk", F.expr(f"CAST(floor(at / {size}) AS BIGINT)"))
    head = h.groupBy(*ks).agg(F.min("at").alias("at"))
    crossing = h.filter(f"floor(to / {size}) > blk").select(*ks, F.col("to").alias("at")).distinct()
    entries = crossing.unionByName(head).distinct().withColumn("blk", F.expr(f"CAST(floor(at / {size}) AS BIGINT)"))

    def exits(key, block: pd.DataFrame, ent: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("at")
        at, to = block["at"].to_numpy(), block["to"].to_numpy(dtype="float64", na_value=np.nan)
        out = to.copy()
        pos = {int(a): n for n, a in enumerate(at)}
        for n in range(len(at) - 1, -1, -1):
            hop = pos.get(int(to[n])) if to[n] == to[n] else None
            if hop is not None:
                out[n] = out[hop]
        e = ent["at"].to_numpy()
        got = np.array([out[pos[int(a)]] if int(a) in pos else np.nan for a in e], dtype="float64")
        return pd.DataFrame({**{k: [v] * len(e) for k, v in zip(ks, key)}, "at": e,
                             "exit": pd.array([None if g != g else int(g) for g in got], dtype="Int64")})

    many = entries.groupBy(*ks).agg(F.count("*").alias("n"))
    long = many.filter("n > 1").drop("n")
    # only clips longer than a block need the exits of their blocks
    in_long = lambda d: fresh(d).join(fresh(long), ks, "left_semi")
    jumps = in_long(h).groupBy(*ks, "blk").cogroup(in_long(entries).groupBy(*ks, "blk")).applyInPandas(
        exits, f"{key_sql}, at bigint, exit bigint")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        link = {int(a): e for a, e in zip(pdf["at"], pdf["exit"])}
        here, used = int(pdf["at"].min()), []
        while here is not None:
            used.append(here)
            e = link.get(here)
            here = None if e is None or e != e or pd.isna(e) else int(e)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(used) for k in ks}, "at": used})

    # a clip inside one block has a single entry, its first row; only longer clips are chained
    single = head.join(many.filter("n = 1").drop("n"), ks, "left_semi")
    chained = jumps.groupBy(*ks).applyInPandas(
        chain, f"{key_sql}, at bigint")
    true_entry = single.unionByName(chained).withColumn("blk", F.expr(f"CAST(floor(at / {size}) AS BIGINT)"))

    def walk(key, block: pd.DataFrame, ent: pd.DataFrame) -> pd.DataFrame:
        link = dict(zip(block["at"].astype("int64"), block["to"]))
        used = []
        for here in ent["at"].astype("int64"):
            while here in link:
                used.append(here)
                t = link[here]
                if pd.isna(t):
                    break
                here = int(t)
        return pd.DataFrame({**{k: [v] * len(used) for k, v in zip(ks, key)}, idx: used})

    return stage(spread(h, *ks, "blk").groupBy(*ks, "blk").cogroup(spread(fresh(true_entry), *ks, "blk").groupBy(*ks, "blk")).applyInPandas(
        walk, f"{key_sql}, {idx} bigint"), "path")
