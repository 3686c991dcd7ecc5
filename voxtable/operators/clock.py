"""Source time to output time once kept ranges are joined end to end."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed
from ..functions.intervals import latest, overlap_join, points_in
from ..functions.seq import fresh, neighbours, numbered, running, spaced


def clocked_keeps(keeps: DataFrame) -> DataFrame:
    """keeps + out_us: output time at which each range begins."""
    return running(keeps, "k", {"out_us": ("sum", "end_us - start_us")}, exclusive=True)


def remap_time(points: DataFrame, keeps: DataFrame, at: str = "t_us") -> DataFrame:
    """points + out_us; a time inside a cut lands on the join."""
    k = clocked_keeps(keeps).select("clip_id", F.col("start_us").alias("k0"), F.col("end_us").alias("k1"), F.col("out_us").alias("k_out"))
    p = latest(points, fresh(k), at, "k0", ["k0", "k1", "k_out"])
    inside = F.least(F.col(at), F.col("k1")) - F.col("k0")
    return p.withColumn("out_us", F.coalesce(F.col("k_out") + inside, F.lit(0)).cast("bigint")).drop("k0", "k1", "k_out")


def best_overlap(words: DataFrame, keeps: DataFrame, min_us: int = fixed.MIN_OVERLAP_US) -> DataFrame:
    """words + k, k_start, k_end, k_out: the kept range sharing most time with the word, the first on a tie."""
    k = clocked_keeps(keeps).select("clip_id", "k", F.col("start_us").alias("k_start"), F.col("end_us").alias("k_end"), F.col("out_us").alias("k_out"))
    p = overlap_join(words, fresh(k), ("start_us", "end_us"), ("k_start", "k_end"))
    ov = F.least("end_us", "k_end") - F.greatest("start_us", "k_start")
    best = p.withColumn("ov", ov).groupBy("clip_id", "i").agg(F.max("ov").alias("ov"), F.max_by(F.struct("k", "k_start", "k_end", "k_out"), F.struct("ov", -F.col("k"))).alias("b"))
    return words.join(fresh(best.filter(F.col("ov") >= min_us).select("clip_id", "i", "b.*")), ["clip_id", "i"])


def centre_range(words: DataFrame, keeps: DataFrame) -> DataFrame:
    """The older rule: the kept range that holds the word's centre."""
    k = clocked_keeps(keeps).select("clip_id", "k", F.col("start_us").alias("k_start"), F.col("end_us").alias("k_end"), F.col("out_us").alias("k_out"))
    k = k.withColumn("lo2", F.col("k_start") * 2).withColumn("hi2", F.col("k_end") * 2)
    p = points_in(words.withColumn("mid2", F.col("start_us") + F.col("end_us")), fresh(k), "mid2", ("lo2", "hi2"), width=20_000_000, closed_end=True)
    b = p.groupBy("clip_id", "i").agg(F.min_by(F.struct("k", "k_start", "k_end", "k_out"), "k").alias("b"))
    return words.join(fresh(b.select("clip_id", "i", "b.*")), ["clip_id", "i"])


def remap_words(words: DataFrame, keeps: DataFrame, dropped: DataFrame | None = None) -> DataFrame:
    """Surviving words on the output clock, clamped to their range and renumbered.

    With ``dropped`` every other word that overlaps a range by 20 ms survives; without, its centre decides."""
    if dropped is not None:
        w = words.join(fresh(dropped.select("clip_id", "i")), ["clip_id", "i"], "left_anti")
        p = best_overlap(w, keeps)
    else:
        p = centre_range(words, keeps)
    p = p.withColumn("o0", F.col("k_out") + F.greatest("start_us", "k_start") - F.col("k_start")) \
         .withColumn("o1", F.col("k_out") + F.least("end_us", "k_end") - F.col("k_start"))
    n = numbered(p.withColumnRenamed("i", "src_i"), "src_i", "i")
    return n.select("clip_id", "i", "text", F.col("o0").alias("start_us"), F.col("o1").alias("end_us"))


def cut_points(keeps: DataFrame) -> DataFrame:
    """Joins worth a framing change: 0.2 s removed, and 1.5 s after the last one."""
    n = neighbours(clocked_keeps(keeps), "k", {"ns": ("start_us", 1)})
    at = n.filter(F.col("ns") - F.col("end_us") >= fixed.VISIBLE_CUT_US).select("clip_id", (F.col("out_us") + F.col("end_us") - F.col("start_us")).alias("at_us"))
    return spaced(at, "at_us", fixed.CUT_COLLAPSE_US)


def active_at(points: DataFrame, units: DataFrame, at: str = "t_us", unit: str = "unit") -> DataFrame:
    """points + unit active at the time; outside every unit the last one of the clip."""
    u = units.select("clip_id", F.col("start_us").alias("u0"), F.col("end_us").alias("u1"), F.col(unit).alias("__u"))
    p = latest(points, fresh(u), at, "u0", ["__u", "u1"])
    last = units.groupBy("clip_id").agg(F.max(unit).alias("__last"))
    p = p.join(fresh(last), "clip_id", "left")
    return p.withColumn(unit, F.when(F.col(at) < F.col("u1"), F.col("__u")).otherwise(F.col("__last"))).drop("__u", "u1", "__last")


def chunk_at(points: DataFrame, chunks: DataFrame, at: str = "t_us", hold_us: int = 600_000) -> DataFrame:
    """points + first_i of the caption on screen: from its start until the next one, at most 0.6 s past its end."""
    c = chunks.select("clip_id", F.col("start_us").alias("c0"), F.col("end_us").alias("c1"), F.col("first_i").alias("chunk"))
    p = latest(points, fresh(c), at, "c0", ["chunk", "c1"])
    return p.withColumn("chunk", F.when(F.col(at) <= F.col("c1") + hold_us, F.col("chunk"))).drop("c1")


def words_in_sections(words: DataFrame, sections: DataFrame) -> DataFrame:
    """Words whose start lies in a section of a style: (clip_id, style, i, text, start_us, end_us); blanks dropped."""
    w = words.withColumn("text", F.trim("text")).filter("text <> ''")
    p = points_in(w, fresh(sections.select("clip_id", F.col("start_us").alias("s0"), F.col("end_us").alias("s1"), "style")), "start_us", ("s0", "s1"))
    return p.select("clip_id", "style", "i", "text", "start_us", "end_us").distinct()
