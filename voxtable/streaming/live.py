"""The live counterparts: phrases from a word stream, stage timings from progress events."""
from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import fixed


def stream_phrases(words: DataFrame, gap_us: int = fixed.PHRASE_GAP_US, delay: str = "30 seconds") -> DataFrame:
    """words (clip_id, i, text, ts TIMESTAMP, dur_us) -> phrases split at pauses of ``gap_us``.

    A session window stays open while the next word starts within its gap; the gap reaches from a word's
    start to one microsecond short of the pause, because equal distances would merge. A phrase is emitted
    once the watermark passes it, so state is bounded by the longest unbroken phrase."""
    gap = F.concat((F.col("dur_us") + gap_us - 1).cast("string"), F.lit(" microseconds"))
    s = words.withWatermark("ts", delay).groupBy("clip_id", F.session_window("ts", gap).alias("w"))
    return s.agg(F.min("i").alias("first_i"), F.max("i").alias("last_i"), F.min("ts").alias("start_ts"),
                 F.max(F.unix_micros("ts") + F.col("dur_us")).alias("end_us"), F.count("*").alias("n_words")) \
        .select("clip_id", "first_i", "last_i", F.unix_micros("start_ts").alias("start_us"), "end_us", "n_words")


_PHRASE = "clip_id bigint, first_i bigint, last_i bigint, start_us bigint, end_us bigint, n_words bigint"


def clip_phrases(words: DataFrame, gap_us: int = fixed.PHRASE_GAP_US) -> DataFrame:
    """words (clip_id, i, start_us, end_us) in any order -> every phrase of every clip, each when the pause behind it is known.

    Each clip has its own clock, the word index: words that come early wait until those before them are there. A row without times
    whose i is the number of words ends the clip. So nothing is late, and nothing is held back when the stream stops. State is
    the open phrase and the waiting words of a clip; it is dropped with the clip's end."""
    def advance(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, first, start, until, far, n, held = state.get if state.exists else (0, 0, 0, 0, 0, 0, "{}")
        waiting = {int(k): v for k, v in json.loads(held).items()}
        done, ended = [], False
        for pdf in batches:
            for i, a, b in zip(pdf["i"], pdf["start_us"], pdf["end_us"]):
                if i >= at:
                    waiting[int(i)] = None if pd.isna(a) else (int(a), int(b))
            while at in waiting:
                word = waiting.pop(at)
                if n and (word is None or word[0] - until >= gap_us):
                    done.append((key[0], first, at - 1, start, far, n))
                    n = 0
                if word is None:
                    ended = True
                    break
                if not n:
                    first, start, far = at, word[0], word[1]
                until, far, n, at = word[1], max(far, word[1]), n + 1, at + 1
        if ended:
            state.remove()
        else:
            state.update((at, first, start, until, far, n, json.dumps(waiting)))
        yield pd.DataFrame(done, columns=[c.split()[0] for c in _PHRASE.split(", ")])

    held = "at bigint, first bigint, start bigint, until bigint, far bigint, n bigint, held string"
    return words.select("clip_id", "i", "start_us", "end_us").groupBy("clip_id").applyInPandasWithState(advance, _PHRASE, held, "append", GroupStateTimeout.NoTimeout)


_TIMING = "run_id bigint, stage string, ts_us bigint, dur_us bigint, version bigint, ended boolean"
#: Events that end a run.
LAST_STAGES = ("done", "error")


def run_timings(events: DataFrame, delay: str = "1 hour", keep_ms: int = 86_400_000, last=LAST_STAGES) -> DataFrame:
    """events (run_id, stage, ts) in any order -> in update mode, whenever a run changes, all its stages: the time of the first
    event of each (by time, not by arrival), the time to the run's next stage, a version that grows with each change, and whether the
    run has ended. The rows of a run's highest version are what ``stage_timings`` gives for the events so far.

    State is one number per stage of a run; it goes when the watermark has passed the run's last event by ``keep_ms``. Events
    from before the watermark are late and left out, so a run that was dropped does not begin anew."""
    def advance(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        none = pd.DataFrame([], columns=[c.split()[0] for c in _TIMING.split(", ")])
        if state.hasTimedOut:
            state.remove()
            yield none
            return
        version, held, newest = state.get if state.exists else (0, "{}", 0)
        first, limit = json.loads(held), state.getCurrentWatermarkMs() * 1000
        before = dict(first)
        for pdf in batches:
            pdf = pdf[pdf["us"] >= limit]
            if len(pdf):
                newest = max(newest, int(pdf["us"].max()))
            for stage, us in pdf.groupby("stage")["us"].min().items():
                first[stage] = min(int(us), first.get(stage, int(us)))
        if not first:
            yield none
            return
        version += first != before
        state.update((version, json.dumps(first), newest))
        state.setTimeoutTimestamp(max(newest // 1000 + keep_ms, state.getCurrentWatermarkMs() + 1))
        if first == before:
            yield none
            return
        order = sorted(first.items(), key=lambda x: (x[1], x[0]))
        after = [b - a for (_, a), (_, b) in zip(order, order[1:])] + [None]
        ended = any(s in last for s in first)
        yield pd.DataFrame({"run_id": key[0], "stage": [s for s, _ in order], "ts_us": [t for _, t in order], "dur_us": pd.array(after, dtype="Int64"), "version": version, "ended": ended})

    e = events.withWatermark("ts", delay).select("run_id", "stage", "ts", F.unix_micros("ts").alias("us"))
    return e.groupBy("run_id").applyInPandasWithState(advance, _TIMING, "version bigint, held string, newest bigint", "update", GroupStateTimeout.EventTimeTimeout)


def newest(updates: DataFrame) -> DataFrame:
    """Of written updates the rows of each run's highest version."""
    top = updates.groupBy("run_id").agg(F.max("version").alias("version"))
    return updates.join(top, ["run_id", "version"], "left_semi")


def first_stage_events(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """events (run_id, stage, ts, label): the first event of every stage of a run, duplicates dropped within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["run_id", "stage"])


def stage_counts(events: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Events and errors per stage in tumbling windows."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "stage").agg(
        F.count("*").alias("n"), F.count_if(F.col("stage") == "error").alias("n_errors")) \
        .select(F.col("w.start").alias("from_ts"), "stage", "n", "n_errors")


def stage_timings(events: DataFrame) -> DataFrame:
    """Batch form, also used per micro-batch: first event per stage and the time to the run's next stage.

    A run has a dozen stages at most after reduction, so the window per run is small."""
    from pyspark.sql import Window as W
    first = events.groupBy("run_id", "stage").agg(F.min("ts").alias("ts"))
    w = W.partitionBy("run_id").orderBy("ts", "stage")
    nxt = F.lead("ts").over(w)
    return first.select("run_id", "stage", F.unix_micros("ts").alias("ts_us"), (F.unix_micros(nxt) - F.unix_micros("ts")).alias("dur_us"))


def error_rates(events: DataFrame) -> DataFrame:
    """Share of error events per run."""
    return events.groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(F.col("stage") == "error").alias("n_errors")) \
        .withColumn("error_rate", F.col("n_errors") / F.col("n"))
