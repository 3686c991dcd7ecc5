"""Cutting speech into sentences, phrases, captions, shots and sections."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed, text
from ..functions.intervals import points_in
from ..functions.seq import neighbours, running
from ..functions.stage import stage
from .shot_cuts import least_cost_cuts as _least_cost_cuts


def joined(col: str, order: str = "i", when: Column | None = None) -> Column:
    """Space-joined text in order, as an aggregate."""
    pair = F.struct(order, F.col(col).alias("v"))
    return F.array_join(F.transform(F.array_sort(F.collect_list(pair if when is None else F.when(when, pair))),
                                    lambda p: p["v"]), " ")


def sentence_numbers(words: DataFrame) -> DataFrame:
    """words + s_ord: one more than the sentence ends before the word."""
    end = F.when(text.ends_sentence("text"), 1).otherwise(0).cast("bigint")
    s = running(words.withColumn("__end", end), "i", {"s_ord": ("sum", "__end")}, exclusive=True)
    return s.drop("__end")


def sentences(words: DataFrame, purpose: str = "verify") -> DataFrame:
    """(clip_id, s_ord, first_i, last_i, start_us, end_us, text, content, head, second)."""
    norm = text.norm_surface("text") if purpose == "verify" else text.norm_match("text")
    w = sentence_numbers(words).withColumn("norm", norm)
    first = F.min_by("norm", "i")
    return w.groupBy("clip_id", "s_ord").agg(
        F.min("i").alias("first_i"), F.max("i").alias("last_i"),
        F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"),
        joined("text").alias("text"),
        F.array_sort(F.collect_set(F.when(text.is_content("norm", purpose), F.col("norm")))).alias("content"),
        first.alias("head"))


def phrases(words: DataFrame, gap_us: int = fixed.PHRASE_GAP_US) -> DataFrame:
    """Runs of words without a pause of ``gap_us``: (clip_id, p_ord, first_i, last_i, start_us, end_us)."""
    return (phrase_numbers(words, gap_us).groupBy("clip_id", "p_ord")
            .agg(F.min("i").alias("first_i"), F.max("i").alias("last_i"),
                 F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us")))


def phrase_numbers(words: DataFrame, gap_us: int = fixed.PHRASE_GAP_US) -> DataFrame:
    n = neighbours(words, "i", {"__pe": ("end_us", -1)}, keep_block=True)
    n = n.withColumn("__new", F.when(F.col("start_us") - F.col("__pe") >= gap_us, 1).otherwise(0).cast("bigint"))
    return running(n, "i", {"p_ord": ("sum", "__new")}).drop("__pe", "__new")


def packed_lines(words: DataFrame, recovered: DataFrame, gap_us: int = fixed.PHRASE_GAP_US) -> DataFrame:
    """One transcript line per phrase: times, every word with its index, a mark when all words were recovered."""
    rec = recovered.select("clip_id", "i", F.lit(True).alias("rec"))
    w = phrase_numbers(words, gap_us).join(rec, ["clip_id", "i"], "left")
    g = w.groupBy("clip_id", "p_ord").agg(
        F.min("start_us").alias("s"), F.max("end_us").alias("e"),
        F.bool_and(F.coalesce("rec", F.lit(False))).alias("quiet"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))),
                                 lambda p: F.concat(p["text"], F.lit("{"), p["i"].cast("string"), F.lit("}"))), " ").alias("body"))
    # one decimal, half away from zero on whole tenths of a second
    tenth = lambda c: F.concat(F.expr(f"CAST((({c} + 50000) DIV 100000) DIV 10 AS STRING)"), F.lit("."),
                               F.expr(f"CAST((({c} + 50000) DIV 100000) % 10 AS STRING)"))
    return g.select("clip_id", "p_ord", F.concat(
        F.lit("["), tenth("s"), F.lit("-"), tenth("e"), F.lit("] "),
        F.when(F.col("quiet"), "(quiet pickup) ").otherwise(""), "body").alias("line"))


def numbered_lines(units: DataFrame, words: DataFrame) -> DataFrame:
    """The numbered unit transcript: '1. text of the first shot'."""
    t = unit_words(units, words).groupBy("clip_id", "unit").agg(joined("text").alias("t"))
    return t.select("clip_id", "unit", F.concat((F.col("unit") + 1).cast("string"), F.lit(". "), "t").alias("line"))


def unit_words(units: DataFrame, words: DataFrame, width: int = 256) -> DataFrame:
    """Words of every unit through its inclusive index range."""
    u = units.withColumn("__hi", F.col("last_i") + 1)
    return points_in(words.select("clip_id", "i", "text", F.col("start_us").alias("w_start"), F.col("end_us").alias("w_end")),
                     u, "i", ("first_i", "__hi"), width).drop("__hi")


def break_quality(words: DataFrame) -> DataFrame:
    """words + bq: how natural a cut after the word is."""
    n = neighbours(words, "i", {"__nt": ("text", 1), "__ns": ("start_us", 1)})
    t = F.trim("text")
    base = (F.when(t.rlike("[.!?]" + text.CLOSE_ANY), 3.0)
             .when(t.rlike("[,;:—–-]" + text.CLOSE_ANY), 2.2)
             .when(text.norm_apos("__nt").isin(fixed.CLAUSE_STARTERS), 1.4).otherwise(0.0))
    gap = F.col("__ns") - F.col("end_us")
    air = F.when(gap >= 350_000, 1.2).when(gap >= 180_000, 0.6).otherwise(0.0)
    q = base + air
    q = q - F.when(text.norm_apos("text").isin(fixed.DANGLING) & (q < 2), 2.5).otherwise(0.0)
    return n.withColumn("bq", F.when(F.col("__ns").isNull(), 3.0).otherwise(q)).drop("__nt", "__ns")


def caption_chunks(words: DataFrame) -> DataFrame:
    """Captions of at most three words, broken at punctuation and at pauses over 0.35 s."""
    n = neighbours(words, "i", {"__pt": ("text", -1), "__pe": ("end_us", -1)}, keep_block=True)
    new = F.trim("__pt").rlike("[.,!?;:]$") | (F.col("start_us") - F.col("__pe") > fixed.CHUNK_GAP_US)
    n = n.withColumn("__at", F.when(F.coalesce(new, F.lit(True)), F.col("i")))
    r = running(n, "i", {"__from": ("last", "__at")})
    c = r.withColumn("__third", F.expr("(i - __from) DIV 3")).groupBy("clip_id", "__from", "__third").agg(
        F.min("i").alias("first_i"), F.max("i").alias("last_i"),
        F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))
    return c.drop("__from", "__third")


def emphasis_candidates(words: DataFrame, units: DataFrame) -> DataFrame:
    """Content words of a shot that may be emphasised; asked only where there are two or more."""
    n = text.norm_apos("text")
    c = unit_words(units, words).filter((n != "") & text.is_content(n, "emphasis"))
    enough = c.groupBy("clip_id", "unit").agg(F.count("*").alias("n")).filter("n >= 2")
    return c.join(enough.drop("n"), ["clip_id", "unit"], "left_semi").select("clip_id", "unit", "i", "text")


def giant_words(units: DataFrame, words: DataFrame, emphasis: DataFrame) -> DataFrame:
    """The word for a large title: the emphasised word when it is plain, else the longest plain one."""
    w = unit_words(units, words).join(emphasis.select("clip_id", "unit", F.col("i").alias("em_i")), ["clip_id", "unit"], "left")
    plain = text.plain_word("text")
    usable = plain.isNotNull() & ~text.norm_apos("text").isin(fixed.STOP_GIANT)
    is_em = F.col("i") == F.col("em_i")
    w = w.withColumn("p", F.when(usable, plain)).withColumn("em", F.coalesce(is_em, F.lit(False)))
    w = w.filter(F.col("p").isNotNull() & (F.col("em") | (F.length("p") >= 4)))
    return w.groupBy("clip_id", "unit").agg(
        F.max_by("p", F.struct("em", F.length("p"), -F.col("i"))).alias("word"))


def split_shots(words: DataFrame, size: int | None = None) -> DataFrame:
    """Shots of two to three seconds by least cost: (clip_id, shot_ord, first_i, last_i, start_us, end_us).

    size: words of a block of ``cut_shots``."""
    from .shot_cuts import WORDS, cut_shots
    q = neighbours(break_quality(words), "i", {"__ne": ("i", 1)})
    q = q.select("clip_id", "i", "start_us", "end_us", "bq", F.col("__ne").isNull().alias("last"))
    shots = cut_shots(q, size or WORDS)
    return _contiguous(stage(_fold_tail(stage(shots, "shots")), "shots_folded"))


def _fold_tail(shots: DataFrame) -> DataFrame:
    """Trailing shots that together last under a second join the shot before them."""
    ends = shots.groupBy("clip_id").agg(F.max("end_us").alias("__end"), F.min("first_i").alias("__head"))
    s = shots.join(ends, "clip_id")
    ok = (F.col("__end") - F.col("start_us") >= fixed.SHOT_TAIL_US) | (F.col("first_i") == F.col("__head"))
    at = s.filter(ok).groupBy("clip_id").agg(F.max("first_i").alias("__at"))
    s = s.join(at, "clip_id").withColumn("first_i", F.least("first_i", "__at"))
    return s.groupBy("clip_id", "first_i").agg(F.max("last_i").alias("last_i"), F.min("start_us").alias("start_us"),
                                               F.max("end_us").alias("end_us"))


def _contiguous(shots: DataFrame) -> DataFrame:
    s = running(shots, "first_i", {"shot_ord": ("sum", F.lit(1).cast("bigint"))})
    s = neighbours(s.withColumn("shot_ord", F.col("shot_ord") - 1), "shot_ord", {"__ns": ("start_us", 1)})
    return s.select("clip_id", "shot_ord", "first_i", "last_i",
                    F.when(F.col("shot_ord") == 0, 0).otherwise(F.col("start_us")).alias("start_us"),
                    F.coalesce("__ns", "end_us").alias("end_us"))


def sections(shots: DataFrame, words: DataFrame) -> DataFrame:
    """About eight seconds of shots, ending on a sentence, at most twelve; a short tail is folded back.

    From any shot the end of a section starting there lies within twelve seconds, so every shot gets a
    pointer to the next section start, and the sections are the path of pointers from the first shot."""
    from .paths import path
    last = words.select("clip_id", F.col("i").alias("last_i"), text.ends_sentence("text").alias("stop"))
    s = shots.join(last, ["clip_id", "last_i"])
    s = s.withColumn("__hi", F.col("start_us") + fixed.SECTION_MAX_US)
    # a closing shot e for a section that starts at s: long enough at a sentence end, or over the limit
    e = s.select("clip_id", F.col("shot_ord").alias("e_ord"), F.col("end_us").alias("e_end"), "stop",
                 F.col("start_us").alias("e_start"))
    pairs = points_in(e, s.select("clip_id", "shot_ord", F.col("start_us").alias("s_start"), "__hi"),
                      "e_start", ("s_start", "__hi"))
    dur = F.col("e_end") - F.col("s_start")
    closing = pairs.filter(((dur >= fixed.SECTION_TARGET_US) & F.col("stop")) | (dur >= fixed.SECTION_MAX_US))
    nxt = closing.groupBy("clip_id", "shot_ord").agg((F.min("e_ord") + 1).alias("nxt"))
    hops = stage(s.select("clip_id", "shot_ord").join(nxt, ["clip_id", "shot_ord"], "left"), "section_hops")
    starts = path(hops, "shot_ord", "nxt").withColumn("is_start", F.lit(1).cast("bigint"))
    m = s.select("clip_id", "shot_ord", "start_us", "end_us").join(starts, ["clip_id", "shot_ord"], "left")
    m = running(stage(m, "section_marks"), "shot_ord", {"sec_ord": ("sum", F.coalesce("is_start", F.lit(0).cast("bigint")))})
    agg = lambda d: d.groupBy("clip_id", "sec_ord").agg(
        F.min("shot_ord").alias("first_shot"), F.max("shot_ord").alias("last_shot"),
        F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))
    sec = agg(m.withColumn("sec_ord", F.col("sec_ord") - 1))
    tail = sec.groupBy("clip_id").agg(F.max("sec_ord").alias("__last"))
    sec = sec.join(tail, "clip_id")
    fold = (F.col("sec_ord") == F.col("__last")) & (F.col("sec_ord") > 0) & \
        (F.col("end_us") - F.col("start_us") < fixed.SECTION_TARGET_US // 2)
    return sec.withColumn("sec_ord", F.when(fold, F.col("sec_ord") - 1).otherwise(F.col("sec_ord"))) \
        .groupBy("clip_id", "sec_ord").agg(
            F.min("first_shot").alias("first_shot"), F.max("last_shot").alias("last_shot"),
            F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))
