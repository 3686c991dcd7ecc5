"""Gaps between words: sounds that are no words, untranscribed speech and its second hearing."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed, text
from ..functions.intervals import outside, overlap_join, points_in
from ..functions.seq import fresh, neighbours, numbered, running


def gaps(words: DataFrame, clips: DataFrame) -> DataFrame:
    """Lead-in, between-word and tail gaps: (clip_id, prev_i, next_i, gs, ge). Clips without words are one gap."""
    n = neighbours(words.select("clip_id", F.col("i").cast("bigint").alias("i"), "start_us", "end_us"), "i",
                   {"pe": ("end_us", -1), "ni": ("i", 1)})
    before = n.select("clip_id", (F.col("i") - 1).alias("prev_i"), F.col("i").alias("next_i"), F.coalesce("pe", F.lit(0)).alias("gs"), F.col("start_us").alias("ge"), F.lit(False).alias("tail"))
    last = n.filter("ni IS NULL").select("clip_id", F.col("i").alias("prev_i"), (F.col("i") + 1).alias("next_i"), F.col("end_us").alias("gs"))
    tail = clips.select("clip_id", F.col("duration_us").alias("ge")).join(fresh(last), "clip_id", "left").select(
        "clip_id", F.coalesce("prev_i", F.lit(-1)).alias("prev_i"), F.coalesce("next_i", F.lit(0)).alias("next_i"), F.coalesce("gs", F.lit(0)).alias("gs"), "ge", F.lit(True).alias("tail"))
    return before.unionByName(tail)


def voiced_in_gaps(gap: DataFrame, silences: DataFrame, clips: DataFrame) -> DataFrame:
    """Gaps minus silences: gaps + start_us, end_us of every voiced stretch."""
    loud = fresh(outside(silences, clips, "start_us", "end_us", "duration_us"))
    g = gap.filter("ge > gs")
    p = overlap_join(g, loud, ("gs", "ge"), ("start_us", "end_us"))
    return p.withColumn("start_us", F.greatest("start_us", "gs")).withColumn("end_us", F.least("end_us", "ge"))


def filler_sounds(gap: DataFrame, silences: DataFrame, clips: DataFrame) -> DataFrame:
    """Voiced stretches of 0.15 to 1.2 s that keep 50 ms from the words around them."""
    v = voiced_in_gaps(gap.filter(F.col("ge") - F.col("gs") >= fixed.FILLER_MIN_US), silences, clips)
    length = F.col("end_us") - F.col("start_us")
    after_word = (F.col("prev_i") >= 0) & (F.col("start_us") - F.col("gs") < fixed.FILLER_CLEAR_US)
    before_word = ~F.col("tail") & (F.col("ge") - F.col("end_us") < fixed.FILLER_CLEAR_US)
    no_words = F.col("tail") & (F.col("prev_i") < 0)
    return v.filter(~no_words & length.between(fixed.FILLER_MIN_US, fixed.FILLER_MAX_US) & ~after_word & ~before_word) \
        .select("clip_id", "start_us", "end_us")


def untranscribed(gap: DataFrame, silences: DataFrame, clips: DataFrame, min_us: int = fixed.RECOVER_MIN_US) -> DataFrame:
    """Voiced stretches of at least ``min_us`` that no word covers, with their neighbours."""
    v = voiced_in_gaps(gap.filter(F.col("ge") - F.col("gs") >= min_us), silences, clips)
    return v.filter(F.col("end_us") - F.col("start_us") >= min_us).select("clip_id", "start_us", "end_us", "prev_i", "next_i")


def batch_layout(spans: DataFrame, clips: DataFrame) -> DataFrame:
    """Padded spans laid end to end with one second between them: + src_start, src_end, batch_start."""
    s = spans.join(clips.select("clip_id", "duration_us"), "clip_id")
    s = s.withColumn("src_start", F.greatest(F.lit(0), F.col("start_us") - fixed.RECOVER_PAD_US).cast("bigint")) \
         .withColumn("src_end", F.least("duration_us", F.col("end_us") + fixed.RECOVER_PAD_US)).drop("duration_us")
    b = running(s, "start_us", {"batch_start": ("sum", f"src_end - src_start + {fixed.RECOVER_GAP_US}")}, size=60_000_000, exclusive=True)
    return b


def map_batch_words(heard: DataFrame, segments: DataFrame, words: DataFrame) -> DataFrame:
    """Words heard in the batch back on the source clock, without padding words and echoes of neighbours."""
    seg = fresh(segments).withColumn("lo2", F.col("batch_start") * 2).withColumn("hi2", (F.col("batch_start") + F.col("src_end") - F.col("src_start")) * 2)
    h = heard.select("clip_id", "text", F.col("start_us").alias("b0"), F.col("end_us").alias("b1")).withColumn("mid2", F.col("b0") + F.col("b1"))
    p = points_in(h, seg, "mid2", ("lo2", "hi2"), width=20_000_000)
    p = p.withColumn("s", F.col("src_start") + F.col("b0") - F.col("batch_start")).withColumn("e", F.col("src_start") + F.col("b1") - F.col("batch_start"))
    p = p.withColumn("m2", F.col("s") + F.col("e"))
    p = p.filter((F.col("m2") >= 2 * (F.col("start_us") - fixed.SPAN_SLACK_US)) & (F.col("m2") <= 2 * (F.col("end_us") + fixed.SPAN_SLACK_US)))
    side = lambda k, a, b: fresh(words.select("clip_id", F.col("i").cast("bigint").alias(k), text.norm_match("text").alias(f"{k}_n"), F.col(b).alias(a)))
    p = p.join(side("prev_i", "prev_end", "end_us"), ["clip_id", "prev_i"], "left").join(side("next_i", "next_start", "start_us"), ["clip_id", "next_i"], "left")
    n = text.norm_match("text")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    keep = no(F.col("m2") <= 2 * F.col("prev_end")) & no(F.col("m2") >= 2 * F.col("next_start")) & (n != "") & \
        no((F.col("prev_i_n") == n) & (F.col("s") - F.col("prev_end") < fixed.ECHO_US)) & \
        no((F.col("next_i_n") == n) & (F.col("next_start") - F.col("e") < fixed.ECHO_US))
    return p.filter(keep).select("clip_id", "text", F.greatest(F.lit(0), "s").cast("bigint").alias("start_us"), F.greatest("s", "e").alias("end_us"))


def merge_words(words: DataFrame, extra: DataFrame) -> DataFrame:
    """Extra words inserted in time order, all renumbered; ``extra`` marks them."""
    both = words.select("clip_id", "text", "start_us", "end_us", F.lit(0).alias("o"), F.col("i").cast("bigint").alias("was")).unionByName(
        extra.select("clip_id", "text", "start_us", "end_us", F.lit(1).alias("o"), F.lit(0).cast("bigint").alias("was")))
    m = numbered(both, "start_us", "i", size=60_000_000, order=["start_us", "end_us", "o", "was", "text"])
    return m.select("clip_id", "i", "text", "start_us", "end_us")


def recovered_indices(merged_words: DataFrame, added: DataFrame) -> DataFrame:
    """Where the added words ended up."""
    key = ["clip_id", "start_us", "end_us", "text"]
    return merged_words.join(fresh(added.select(*key)), key, "left_semi").select("clip_id", "i")


def protectable(spans: DataFrame, removed: DataFrame) -> DataFrame:
    """Wordless voiced spans of 1.2 s or more, unless both words around them are removed."""
    r = lambda k: fresh(removed.select("clip_id", F.col("i").cast("bigint").alias(k), F.lit(True).alias(f"{k}_out")))
    s = spans.filter(F.col("end_us") - F.col("start_us") >= fixed.PROTECT_MIN_US)
    s = s.join(r("prev_i"), ["clip_id", "prev_i"], "left").join(r("next_i"), ["clip_id", "next_i"], "left")
    return s.filter("NOT (coalesce(prev_i_out, false) AND coalesce(next_i_out, false))").drop("prev_i_out", "next_i_out")
