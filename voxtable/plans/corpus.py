"""The corpus the registered queries run on, derived from the given tables.

One clip per conversation, turns in order; timing, levels, faces and classifier answers are integer
arithmetic on word positions. Tables are written once per session and folder (see ``stage``)."""
from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import fixed
from ..functions.seq import neighbours, running
from ..functions.stage import spread, stage
from ..operators.levels import FRAMES, PIECES, TOGETHER, _NULL, pieces, silences, unpacked


def talk(source: DataFrame) -> DataFrame:
    """(clip_id, turn, text) -> words with times. Positions and times are two-level prefix sums."""
    fillers = F.when((F.col("clip_id") + F.col("turn")) % 4 == 1, F.array(F.lit("um,"))).otherwise(F.array().cast("array<string>"))
    tokens = source.withColumn("a", F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    restart = F.when((F.col("clip_id") + F.col("turn")) % 3 == 0, F.slice("a", 1, 8)).otherwise(F.array().cast("array<string>"))
    tokens = tokens.select("clip_id", "turn", F.concat(fillers, restart, "a").alias("a"))
    based = running(tokens.withColumn("n", F.size("a").cast("bigint")), "turn", {"base": ("sum", "n")}, exclusive=True)
    words = based.select("clip_id", "base", F.posexplode("a").alias("pos", "text")) \
        .select("clip_id", (F.col("base") + F.col("pos")).cast("int").alias("i"), "text")
    timed = words.select(
        "*",
        (120_000 + 30_000 * F.least(F.length("text"), F.lit(12))).cast("bigint").alias("dur_us"),
        F.when(F.col("i") % 40 == 39, 3_000_000).when(F.col("text").rlike("[.!?]$"), 600_000)
         .when(F.col("text").rlike("[,;:]$"), 200_000)
         .otherwise(20_000 + 10_000 * (F.col("i") % 4)).cast("bigint").alias("gap_us"))
    at = running(timed, "i", {"start_us": ("sum", "dur_us + gap_us")}, exclusive=True)
    return at.select("clip_id", "i", "text", "start_us", (F.col("start_us") + F.col("dur_us")).alias("end_us"),
                     (F.col("start_us") + F.col("dur_us") + F.col("gap_us")).alias("next_us"))


def word_levels(batches):
    """Words -> packed levels of the frames from each word's start to the next one's: loud inside the word, some pauses not silent.

    Frames are counted up in numpy, so no row per frame is made. A level that hangs on a missing number is null. Words are taken
    together while their frames are few: a batch is bounded by words, and these may be followed by long pauses."""
    def some(b):
        clip, i, start, end, then = (b.column(k).fill_null(_NULL).to_numpy() for k in range(5))
        lo = -(-start // 10000)
        n = np.maximum(-(-then // 10000) - lo, 0)
        at = [0, *np.flatnonzero(np.diff(np.cumsum(n) // (4 * FRAMES))) + 1, len(n)]
        return ([x[a:z] for x in (clip, i, start, end, lo, n)] for a, z in zip(at, at[1:]))

    for clip, i, start, end, lo, n in (part for b in batches for part in some(b)):
        if not n.sum():
            continue
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        t, c, k, s, e = at * 10000, *(np.repeat(x, n) for x in (clip, i, start, end))
        word = (t >= s + 60000) & (t < e - 40000)
        noise = ~word & (k != _NULL) & (np.fmod(k, 40) == 39) & (t >= e + 700000) & (t < e + np.where(np.fmod(k, 80) == 79, 2200000, 1100000))
        db = np.where(word, -18 - np.fmod(k * 7, 13), np.where(noise, -25, -70 - np.fmod(at * 31 + c, 11))).astype("float64")
        missing = word & (k == _NULL) | ~word & ~noise & (c == _NULL)
        yield pieces(c, at, pa.array(db, mask=missing))


class Corpus:
    """Lazily written tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def words(self) -> DataFrame:
        turns = self.raw("conversations").select(F.col("conv_id").alias("clip_id"), "turn", "text")
        return stage(talk(turns), "words")

    @cached_property
    def document_words(self) -> DataFrame:
        docs = self.raw("documents").select((F.col("doc_id") + 1_000_000).alias("clip_id"),
                                            F.lit(0).cast("bigint").alias("turn"), "text")
        return stage(talk(docs), "document_words")

    @cached_property
    def clips(self) -> DataFrame:
        return stage(self.words.groupBy("clip_id").agg(F.max("next_us").alias("duration_us")).select(
            "clip_id", "duration_us", F.lit(1920).alias("width"), F.lit(1080).alias("height"),
            F.when(F.col("clip_id") % 5 == 0, 30000).otherwise(30).alias("fps_num"),
            F.when(F.col("clip_id") % 5 == 0, 1001).otherwise(1).alias("fps_den"),
            F.lit(48000).alias("sample_rate")), "clips")

    @cached_property
    def level_blocks(self) -> DataFrame:
        """Levels with consecutive frames in one row: numbers of frames, which hardly compress, are not written."""
        w = self.words.select(F.col("clip_id").cast("bigint").alias("clip_id"), F.col("i").cast("bigint").alias("i"), "start_us", "end_us", "next_us")
        return stage(w.dropna(subset=["start_us", "end_us", "next_us"]).mapInArrow(word_levels, PIECES), "levels", TOGETHER)

    @cached_property
    def levels(self) -> DataFrame:
        """A row per frame."""
        return unpacked(self.level_blocks)

    @cached_property
    def silences(self) -> DataFrame:
        return stage(silences(self.level_blocks, F.lit(-55.0)), "silences")

    @cached_property
    def faces(self) -> DataFrame:
        sec = self.clips.select("clip_id", F.explode(F.expr(
            "sequence(0L, CAST(floor(duration_us / 1000000) AS BIGINT) - 1)")).alias("sec"))
        f = sec.withColumn("k", F.explode(F.expr(
            "slice(array(0, 1), 1, CAST((clip_id * 7 + sec * 3) % 3 AS INT))")))
        return stage(f.select(
            "clip_id", F.col("sec").cast("int").alias("sec"), F.col("k").alias("face_ord"),
            (F.expr("30 + (clip_id * 3 + sec + k * 11) % 30").cast("double") / 100).alias("x"),
            (F.expr("10 + (sec * 7 + k) % 20").cast("double") / 100).alias("y"),
            (F.expr("10 + (sec * 5 + k * 13) % 15").cast("double") / 100).alias("w"),
            (F.expr("12 + (sec * 3 + k * 7) % 15").cast("double") / 100).alias("h")), "faces")

    @cached_property
    def menu(self) -> DataFrame:
        rows = [(q, n, label, o) for n, (q, labels) in enumerate(fixed.MENUS.items()) for o, label in enumerate(labels)]
        return self.spark.createDataFrame(rows, "question string, q bigint, label string, label_ord bigint")

    @cached_property
    def units(self) -> DataFrame:
        """Eight-word shots, contiguous, the first from 0."""
        u = self.words.groupBy("clip_id", F.expr("CAST(i DIV 8 AS BIGINT)").alias("unit")).agg(
            F.min("i").alias("first_i"), F.max("i").alias("last_i"), F.min("start_us").alias("s"), F.max("end_us").alias("e"))
        u = neighbours(u, "unit", {"nxt": ("s", 1)})
        return stage(u.select("clip_id", "unit", "first_i", "last_i",
                              F.when(F.col("unit") == 0, 0).otherwise(F.col("s")).alias("start_us"),
                              F.coalesce("nxt", "e").alias("end_us")), "units")

    @cached_property
    def answers(self) -> DataFrame:
        """One distribution per unit and question; weights are integers, so both engines agree.

        Units are a few bytes each in their files, so one task would make the rows of all of them; they are dealt first."""
        menus = F.array(*[F.struct(F.lit(q).alias("question"), F.lit(n).cast("bigint").alias("q"),
                                   F.array(*[F.lit(x) for x in labels]).alias("labels"))
                          for n, (q, labels) in enumerate(fixed.MENUS.items())])
        one = spread(self.units.select("clip_id", "unit"), "clip_id", "unit").select("clip_id", "unit", F.explode(menus).alias("m")).select("clip_id", "unit", "m.*")
        wgt = "transform(sequence(0L, size(labels) - 1L), o -> {w})".format(
            w="power(1 + (clip_id * 17 + unit * 29 + o * o * 13 + unit * o * 7 + q * 31) % 97, 3)")
        one = one.withColumn("wgt", F.expr(wgt)).withColumn("total", F.expr("aggregate(wgt, 0D, (a, x) -> a + x)"))
        return stage(one.select("clip_id", "unit", "question", F.posexplode("labels").alias("o", "label"), "wgt", "total")
                     .select("clip_id", "unit", "question", "label", F.col("o").cast("bigint").alias("label_ord"),
                             (F.get("wgt", F.col("o")) / F.col("total")).alias("prob")), "answers")

    @cached_property
    def keeps(self) -> DataFrame:
        """Kept ranges used by the clock operators: speech between pauses of 0.6 s or more."""
        from ..operators.segments import phrases
        p = phrases(self.words, 600_000)
        return stage(p.select("clip_id", F.col("p_ord").alias("k"), "start_us", "end_us"), "keeps")

    @cached_property
    def proposals(self) -> DataFrame:
        n = self.words.groupBy("clip_id").agg(F.count("*").alias("n"))
        p = n.withColumn("p", F.explode(F.expr("sequence(0L, n DIV 60)")))
        return stage(p.select("clip_id", F.col("p").alias("p_ord"),
                              F.expr("(clip_id * 13 + p * 59) % n").alias("from_i"),
                              F.expr("(clip_id * 13 + p * 59) % n + (p % 9) * 2").alias("to_i"),
                              F.concat(F.lit("proposal "), F.col("p")).alias("reason")), "proposals")


_open: dict = {}


def corpus(spark: SparkSession, folder: str) -> Corpus:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _open:
        _open[key] = Corpus(spark, folder)
    return _open[key]
