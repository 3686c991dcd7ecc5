"""Abandoned takes: spans of words that are said again soon after.

A candidate is a half-open word span (start_i, end_i) to remove, with a strength and a kind."""
from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed, text
from ..functions.intervals import overlap_join, points_in
from ..functions.seq import framed, fresh, neighbours, numbered, running
from ..functions.stage import stage
from .paths import path
from .segments import sentences

SPAN = ["clip_id", "start_i", "end_i", "strength", "kind"]


def marked(words: DataFrame, texts: bool = True) -> DataFrame:
    """words + token form, clause flags and the nearest take boundaries around every word. Without ``texts`` neither texts nor ends
    are carried, which only the context of a candidate shows.

    last_stop: largest b <= i where the word before b ends a sentence; last_gap: same for a pause of
    0.25 s; next_content: smallest content word at or after i."""
    w = words.select("clip_id", "i", "text", "start_us", "end_us", text.norm_match("text").alias("n"),
                     text.ends_sentence("text").alias("stop"), text.ends_comma("text").alias("comma"))
    w = neighbours(w, "i", {"pn": ("n", -1), "pstop": ("stop", -1), "pcomma": ("comma", -1), "pe": ("end_us", -1)},
                   keep_block=True)
    opens = F.coalesce(F.col("pstop") | F.col("pcomma"), F.lit(True))
    w = w.withColumn("opens", opens) \
         .withColumn("at_boundary", opens | (F.col("start_us") - F.col("pe") >= fixed.TAKE_BOUNDARY_US)) \
         .withColumn("__s", F.when(F.col("pstop"), F.col("i"))) \
         .withColumn("__g", F.when(F.col("start_us") - F.col("pe") >= fixed.TAKE_SNAP_US, F.col("i"))) \
         .withColumn("__c", F.when(text.is_content("n", "retake"), F.col("i"))) \
         .withColumn("__e", F.when(F.col("stop"), F.col("i")))
    w = w.drop("__blk", "comma", "pstop", "pcomma", "pe", *([] if texts else ["text", "end_us"]))
    w = stage(w, "word_marks")
    w = running(w, "i", {"last_stop": ("last", "__s"), "last_gap": ("last", "__g")}, keep_block=True)
    w = running(w, "i", {"next_content": ("last", "__c"), "next_stop": ("last", "__e")}, reverse=True)
    return w.drop("__s", "__g", "__c", "__e")


def equal_pairs(m: DataFrame, reach: int = fixed.RETAKE_WORDS + 1) -> DataFrame:
    """Pairs of equal tokens 2..reach words apart as (clip_id, d, i). The join key is (clip, token,
    block of ``reach`` words), so a frequent token meets only its neighbours."""
    a = m.select("clip_id", "n", "i", F.expr(f"i DIV {reach}").alias("b"))
    later = fresh(m.select("clip_id", "n", F.col("i").alias("j"),
                           F.explode(F.expr(f"array(i DIV {reach}, i DIV {reach} - 1)")).alias("b")))
    gap = F.col("j") - F.col("i")
    return a.join(later, ["clip_id", "n", "b"]).filter(gap.between(2, reach)).select(
        "clip_id", gap.alias("d"), "i", (F.col("n") == "").alias("blank"))


def equal_runs(pairs: DataFrame) -> DataFrame:
    """pairs + len: how many tokens match in a row from (i, i + d). Runs may be of any length."""
    live = pairs.withColumn("__k", F.when(~F.col("blank"), F.col("i")))
    f = framed(live, "i", 0, 1, lambda w: {"__nx": F.lead("__k").over(w)}, keys=("clip_id", "d"), keep_block=True)
    f = f.withColumn("__stop", F.when(F.coalesce(F.col("__nx") != F.col("i") + 1, F.lit(True)), F.col("i")))
    r = running(f, "i", {"__last": ("last", "__stop")}, keys=("clip_id", "d"), reverse=True)
    return r.select("clip_id", "d", "i", F.when(F.col("blank"), 0).otherwise(F.col("__last") - F.col("i") + 1).alias("len"))


def aligned_repeats(m: DataFrame) -> DataFrame:
    """Every start (i, j) whose aligned run has three matches (one slip forgiven): matched, len_i, end_i.

    A run is a stretch on one diagonal, then at most one slip (a substituted word, an extra word in
    either take), then a second stretch; both stretches are looked up among ``equal_runs``."""
    runs = stage(equal_runs(equal_pairs(m)), "equal_runs")
    at = lambda name: fresh(runs).toDF("clip_id", "d", "i", name)
    left = m.select("clip_id", "i", "pn", "start_us", "opens", "next_content")
    right = fresh(m.select("clip_id", F.col("i").alias("j"), F.col("pn").alias("j_pn"), F.col("start_us").alias("j_us"),
                           "last_stop", "last_gap"))
    p = runs.filter(F.col("d").between(3, fixed.RETAKE_WORDS) & (F.col("len") > 0)).join(left, ["clip_id", "i"])
    p = p.withColumn("j", F.col("i") + F.col("d")).join(right, ["clip_id", "j"])
    same_before = F.coalesce((F.col("pn") == F.col("j_pn")) & (F.col("pn") != ""), F.lit(False))
    p = p.filter((F.col("j_us") - F.col("start_us") <= fixed.RETAKE_US) & (~same_before | F.col("opens")))
    p = p.withColumn("inner", F.col("opens") & same_before).drop("pn", "j_pn", "start_us", "j_us")
    p = p.withColumnRenamed("len", "l1").withColumn("i0", F.col("i"))
    p = p.withColumn("d0", F.col("d")).withColumn("end1", F.col("i") + F.col("l1"))
    sub = p.withColumn("i", F.col("end1") + 1).join(at("l_sub"), ["clip_id", "d", "i"], "left")
    early = sub.withColumn("i", F.col("end1") + 1).withColumn("d", F.col("d0") - 1).join(at("l_early"), ["clip_id", "d", "i"], "left")
    late = early.withColumn("i", F.col("end1")).withColumn("d", F.col("d0") + 1).join(at("l_late"), ["clip_id", "d", "i"], "left")
    by_sub, by_early, by_late = F.coalesce(F.col("l_sub") > 0, F.lit(False)), F.col("l_early").isNotNull(), F.col("l_late").isNotNull()
    more = F.when(by_sub, F.col("l_sub")).when(by_early, F.col("l_early")).when(by_late, F.col("l_late")).otherwise(0)
    len_i = F.col("l1") + more + F.when(by_sub | by_early, 1).otherwise(0)
    r = late.select("clip_id", F.col("i0").alias("i"), F.col("d0").alias("d"), "j", "inner", "next_content", "last_stop", "last_gap",
                    (F.col("l1") + more).alias("matched"), len_i.alias("len_i"))
    floor = F.col("i") + F.col("len_i") - 1
    r = r.filter((F.col("matched") >= 3) & ((F.col("matched") >= 4) | (F.col("next_content") <= floor)))
    end = F.when(F.col("last_stop") > floor, F.col("last_stop")).when(F.col("last_gap") > floor, F.col("last_gap")).otherwise(F.col("j"))
    return r.select("clip_id", "i", "j", "d", "matched", "len_i", "inner", end.alias("end_i"))


def nearest_repeats(aligned: DataFrame) -> DataFrame:
    """For every start the nearest later take that qualifies."""
    best = F.min_by(F.struct("d", "matched", "len_i", "inner", "end_i"), "j")
    return aligned.groupBy("clip_id", "i").agg(best.alias("b")).select("clip_id", F.col("i").alias("start_i"), "b.*")


def dedupe_diagonals(raw: DataFrame) -> DataFrame:
    """Drops a repeat that begins inside a kept one on nearly the same diagonal, unless it opens a clause.

    Clause openers are always kept, so what they cover is settled with running maxima per diagonal;
    only the rest is folded, in stretches of overlapping runs."""
    raw = raw.withColumn("stop_i", F.col("start_i") + F.col("len_i"))
    # who covers whom among always-kept openers, for diagonals up to two apart
    probe = raw.select("clip_id", "start_i", "end_i", "stop_i", "d", "matched", "inner",
                       F.explode(F.sequence(F.col("d") - 2, F.col("d") + 2)).alias("diag"), F.lit(1).alias("probe"))
    cover = raw.filter("inner").select("clip_id", "start_i", "end_i", "stop_i", "d", "matched", "inner",
                                       F.col("d").alias("diag"), F.lit(0).alias("probe"))
    both = running(probe.unionByName(cover), "start_i", {"reach": ("max", F.when(F.col("probe") == 0, F.col("stop_i")))},
                   keys=("clip_id", "diag"), order=["start_i", "probe"])
    hit = both.filter("probe = 1").groupBy("clip_id", "start_i").agg(
        F.bool_or(F.coalesce(F.col("reach") > F.col("start_i"), F.lit(False))).alias("covered"),
        *[F.first(x).alias(x) for x in ("end_i", "stop_i", "d", "matched", "inner")])
    openers = hit.filter("inner")
    rest = hit.filter("NOT inner AND NOT covered")
    isle = running(rest, "start_i", {"__reach": ("max", "stop_i")}, exclusive=True, keep_block=True)
    isle = isle.withColumn("__new", F.when(F.col("__reach") > F.col("start_i"), 0).otherwise(1).cast("bigint"))
    isle = running(isle, "start_i", {"isle": ("sum", "__new")})
    folded = isle.groupBy("clip_id", "isle").agg(F.array_sort(F.collect_list(
        F.struct("start_i", "end_i", "stop_i", "d", "matched"))).alias("c"))
    keep = F.expr("""aggregate(c, slice(c, 1, 0), (kept, x) ->
        IF(exists(kept, k -> x.start_i < k.stop_i AND abs(x.d - k.d) <= 2), kept, concat(kept, array(x))))""")
    rest = folded.select("clip_id", F.explode(keep).alias("x")).select("clip_id", "x.start_i", "x.end_i", "x.matched")
    return openers.select("clip_id", "start_i", "end_i", "matched").unionByName(rest) \
        .select("clip_id", "start_i", "end_i", F.col("matched").cast("bigint").alias("strength"), F.lit("ngram").alias("kind"))


def sentence_retakes(words: DataFrame) -> DataFrame:
    """Neighbouring sentences with the same opening word that share half of the smaller content set."""
    w = words.withColumn("__n", text.norm_match("text"))
    s = sentences(w, "retake")
    second = words.select("clip_id", (F.col("i") - 1).alias("first_i"), text.norm_match("text").alias("second"))
    s = s.join(fresh(second), ["clip_id", "first_i"], "left").drop("text")
    s = s.withColumn("two", F.col("last_i") > F.col("first_i"))
    n = neighbours(s, "s_ord", {"b_head": ("head", 1), "b_second": ("second", 1), "b_two": ("two", 1),
                                "b_content": ("content", 1), "b_first": ("first_i", 1)})
    same_two = F.col("two") & F.col("b_two") & F.coalesce(F.col("second") == F.col("b_second"), F.lit(False))
    shared = F.size(F.array_intersect("content", "b_content"))
    small = F.least(F.size("content"), F.size("b_content"))
    return (n.filter((F.col("head") != "") & (F.col("head") == F.col("b_head")))
             .filter((small > 0) & (shared * 2 >= small) & (same_two | (small >= 2)))
             .select("clip_id", F.col("first_i").alias("start_i"), F.col("b_first").alias("end_i"),
                     (shared + F.when(same_two, 2).otherwise(1)).cast("bigint").alias("strength"), F.lit("sentence").alias("kind")))


def stutters(words: DataFrame) -> DataFrame:
    """A phrase of four, three or two words said twice at once; the longest wins and is stepped over."""
    w = words.select("clip_id", "i", text.norm_match("text").alias("n"), text.ends_sentence("text").alias("stop"))
    w = w.withColumn("c", text.is_content("n", "retake"))
    leads = {f"n{k}": ("n", k) for k in range(1, 8)}
    leads |= {f"c{k}": ("c", k) for k in (1,)} | {f"stop{k}": ("stop", k) for k in (1, 2)}
    w = neighbours(w, "i", leads)
    n = lambda k: F.col("n" if k == 0 else f"n{k}")

    def hit(size: int) -> Column:
        same = F.lit(True)
        for k in range(size):
            same = same & (n(k) != "") & (n(k) == n(k + size))
        stop = F.col("stop")
        for k in range(1, size - 1):
            stop = stop | F.col(f"stop{k}")
        ok = same & ~stop
        return F.coalesce(ok & (F.col("c") | F.col("c1")) if size == 2 else ok, F.lit(False))

    w = w.withColumn("len", F.when(hit(4), 4).when(hit(3), 3).when(hit(2), 2)).select("clip_id", "i", "len")
    w = running(w.withColumn("__h", F.when(F.col("len").isNotNull(), F.col("i"))), "i", {"nh": ("last", "__h")}, reverse=True)
    w = neighbours(w, "i", {f"nh{k}": ("nh", k) for k in (2, 3, 4)}).filter("len IS NOT NULL")
    hops = w.withColumn("nxt", F.when(F.col("len") == 2, F.col("nh2")).when(F.col("len") == 3, F.col("nh3")).otherwise(F.col("nh4")))
    hops = stage(hops.select("clip_id", F.col("i").cast("bigint").alias("i"), F.col("nxt").cast("bigint").alias("nxt"), "len"), "stutter_hops")
    on = path(hops, "i", "nxt")
    return hops.join(fresh(on), ["clip_id", "i"], "left_semi").select(
        "clip_id", F.col("i").alias("start_i"), (F.col("i") + F.col("len")).alias("end_i"),
        F.col("len").cast("bigint").alias("strength"), F.lit("stutter").alias("kind"))


def union_candidates(first: DataFrame, second: DataFrame) -> DataFrame:
    """Equal spans become one with the larger strength and the kind of the first table."""
    both = first.select(*SPAN, F.lit(0).alias("o")).unionByName(second.select(*SPAN, F.lit(1).alias("o")))
    return both.groupBy("clip_id", "start_i", "end_i").agg(F.max("strength").alias("strength"), F.min_by("kind", "o").alias("kind"))


def prune_candidates(cands: DataFrame, m: DataFrame) -> DataFrame:
    """Only spans that open at a clause or pause, and that do not contain two others."""
    at = m.filter("at_boundary").select("clip_id", F.col("i").alias("start_i"))
    s = cands.join(at, ["clip_id", "start_i"], "left_semi")
    o = fresh(s.select("clip_id", F.col("start_i").alias("o_start"), F.col("end_i").alias("o_end")))
    inside = (F.col("o_start") >= F.col("start_i")) & (F.col("o_end") <= F.col("end_i")) & \
        ((F.col("o_start") > F.col("start_i")) | (F.col("o_end") < F.col("end_i")))
    many = (overlap_join(s, o, ("start_i", "end_i"), ("o_start", "o_end"), width=64, on=inside)
            .groupBy("clip_id", "start_i", "end_i").agg(F.count("*").alias("n")).filter("n >= 2"))
    return s.join(fresh(many.drop("n")), ["clip_id", "start_i", "end_i"], "left_anti").select(*SPAN)


def find_retakes(words: DataFrame) -> DataFrame:
    """All retake candidates of a transcript."""
    m = stage(marked(words, texts=False), "marked")
    grams = dedupe_diagonals(stage(nearest_repeats(aligned_repeats(m)), "nearest"))
    pruned = prune_candidates(stage(union_candidates(grams, sentence_retakes(words)), "spans"), m)
    st = stutters(words)
    new = st.join(fresh(pruned.select("clip_id", "start_i", "end_i")), ["clip_id", "start_i", "end_i"], "left_anti")
    return pruned.unionByName(new.select(*SPAN))


def chain_candidates(cands: DataFrame) -> DataFrame:
    """candidates + chain (ordinal), chain_start, chain_end, chain_strength, chain_kind, n_members.

    Spans that overlap or touch form one chain."""
    r = running(cands, "start_i", {"__reach": ("max", "end_i")}, exclusive=True, order=["start_i", "end_i"], keep_block=True)
    r = r.withColumn("__new", F.when(F.col("__reach") >= F.col("start_i"), 0).otherwise(1).cast("bigint"))
    r = running(r.drop("__reach"), "start_i", {"chain": ("sum", "__new")}, order=["start_i", "end_i"]).drop("__new")
    g = r.groupBy("clip_id", "chain").agg(
        F.min("start_i").alias("chain_start"), F.max("end_i").alias("chain_end"), F.max("strength").alias("chain_strength"),
        F.min_by("kind", F.struct("start_i", "end_i")).alias("chain_kind"), F.count("*").alias("n_members"))
    return r.join(fresh(g), ["clip_id", "chain"])


def questions(chained: DataFrame) -> DataFrame:
    """What is asked: every chain of several links as a whole, and every link; numbered into requests."""
    whole = chained.filter("n_members > 1").select(
        "clip_id", "chain", F.col("chain_start").alias("start_i"), F.col("chain_end").alias("end_i"), F.lit(0).alias("link")).distinct()
    links = chained.select("clip_id", "chain", "start_i", "end_i", F.lit(1).alias("link"))
    q = numbered(whole.unionByName(links), "chain", "q_ord", order=["chain", "link", "start_i", "end_i"])
    return q.withColumn("batch_id", F.expr(f"q_ord DIV {fixed.QUESTIONS_PER_REQUEST}"))


def candidate_context(cands: DataFrame, m: DataFrame) -> DataFrame:
    """Text shown for a candidate: 24 words before and after, the span, and the sentence without it."""
    at = m.select("clip_id", F.col("i").alias("start_i"), F.coalesce("last_stop", F.lit(0)).alias("s0"))
    to = fresh(m.select("clip_id", F.col("i").alias("end_i"), F.col("next_stop").alias("e0")))
    c = cands.select("clip_id", "start_i", "end_i").join(at, ["clip_id", "start_i"]).join(to, ["clip_id", "end_i"], "left")
    far = fixed.RESULT_WORDS
    c = c.withColumn("s", F.greatest("s0", F.col("start_i") - far)) \
         .withColumn("e", F.least(F.coalesce(F.col("e0") + 1, F.col("end_i") + far), F.col("end_i") + far)) \
         .withColumn("lo", F.col("start_i") - far).withColumn("hi", F.col("end_i") + far)
    p = points_in(fresh(m.select("clip_id", "i", "text")), c, "i", ("lo", "hi"), width=64)
    i = F.col("i")
    txt = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("i", "text")))), lambda x: x["text"]), " ")
    return p.groupBy("clip_id", "start_i", "end_i").agg(
        txt((i >= F.col("start_i") - fixed.CONTEXT_WORDS) & (i < F.col("start_i"))).alias("before"),
        txt((i >= F.col("start_i")) & (i < F.col("end_i"))).alias("removed"),
        txt((i >= F.col("end_i")) & (i < F.col("end_i") + fixed.CONTEXT_WORDS)).alias("after"),
        txt(((i >= F.col("s")) & (i < F.col("start_i"))) | ((i >= F.col("end_i")) & (i < F.col("e")))).alias("result"))


def score_batches(asked: DataFrame, fn: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """Runs a user scorer once per request (at most 64 rows). A failing request yields NULL scores and
    the error's type and message."""
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[["clip_id", "start_i", "end_i", "link"]].copy()
        try:
            out["score"] = fn(pdf).astype("float64").to_numpy()
            out["error"] = None
        except Exception as e:
            out["score"] = pd.Series([None] * len(out), dtype="float64").to_numpy()
            out["error"] = f"{type(e).__name__}: {e}"
        return out
    return asked.groupBy("clip_id", "batch_id").applyInPandas(
        one, "clip_id bigint, start_i bigint, end_i bigint, link int, score double, error string")


def accept_retakes(chained: DataFrame, scores: DataFrame) -> DataFrame:
    """The whole chain at 0.4, else its links at 0.5; without (complete) scores only strong matches.

    Returns (clip_id, start_i, end_i, score, mode)."""
    bad = scores.groupBy("clip_id").agg(F.bool_and(F.col("score").isNotNull()).alias("scored"))
    c = chained.join(fresh(bad), "clip_id", "left").withColumn("scored", F.coalesce("scored", F.lit(False)))
    whole = scores.filter("link = 0").select("clip_id", F.col("start_i").alias("chain_start"), F.col("end_i").alias("chain_end"),
                                             F.col("score").alias("whole"))
    link = scores.filter("link = 1").select("clip_id", "start_i", "end_i", "score")
    c = c.join(fresh(whole), ["clip_id", "chain_start", "chain_end"], "left").join(fresh(link), ["clip_id", "start_i", "end_i"], "left")
    as_whole = F.coalesce((F.col("n_members") > 1) & (F.col("whole") >= fixed.CHAIN_ACCEPT), F.lit(False))
    strong = (F.col("strength") >= fixed.FALLBACK_STRENGTH) | ((F.col("kind") == "stutter") & (F.col("strength") >= fixed.FALLBACK_STUTTER))
    ok = c.withColumn("as_whole", as_whole & F.col("scored")).filter(
        F.when(F.col("scored"), F.col("as_whole") | F.coalesce(F.col("score") >= fixed.MEMBER_ACCEPT, F.lit(False))).otherwise(strong))
    return ok.select("clip_id", F.when(F.col("as_whole"), F.col("chain_start")).otherwise(F.col("start_i")).alias("start_i"),
                     F.when(F.col("as_whole"), F.col("chain_end")).otherwise(F.col("end_i")).alias("end_i"),
                     F.when(F.col("scored"), F.when(F.col("as_whole"), F.col("whole")).otherwise(F.col("score"))).alias("score"),
                     F.when(F.col("scored"), "scored").otherwise("fallback").alias("mode")).distinct()


def drop_contained(spans: DataFrame) -> DataFrame:
    """Spans that do not lie strictly inside another one."""
    o = fresh(spans.select("clip_id", F.col("start_i").alias("o_start"), F.col("end_i").alias("o_end")))
    outer = (F.col("o_start") <= F.col("start_i")) & (F.col("o_end") >= F.col("end_i")) & \
        ((F.col("o_start") < F.col("start_i")) | (F.col("o_end") > F.col("end_i")))
    return overlap_join(spans, o, ("start_i", "end_i"), ("o_start", "o_end"), width=64, on=outer, how="left_anti")


def removed_words(spans: DataFrame) -> DataFrame:
    """Word indices under the union of the spans."""
    return spans.select("clip_id", F.explode(F.expr("sequence(start_i, end_i - 1)")).alias("i")).distinct()


def filler_words(words: DataFrame, removed: DataFrame) -> DataFrame:
    """Spoken fillers with at least 30 ms of air on both sides, not removed already."""
    n = neighbours(words.select("clip_id", "i", "text", "start_us", "end_us"), "i", {"pe": ("end_us", -1), "ns": ("start_us", 1)})
    air = F.coalesce(F.col("start_us") - F.col("pe") >= fixed.FILLER_AIR_US, F.lit(True)) & \
        F.coalesce(F.col("ns") - F.col("end_us") >= fixed.FILLER_AIR_US, F.lit(True))
    f = n.filter(text.norm_match("text").isin(fixed.FILLER_SPOKEN) & air).select("clip_id", "i")
    return f.join(fresh(removed.select("clip_id", "i")), ["clip_id", "i"], "left_anti")
