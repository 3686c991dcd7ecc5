"""Streams in several micro-batches without order against the batch rules."""
import random

from pyspark.sql import functions as F

from voxtable.functions import fixed
from voxtable.streaming import live


def in_parts(spark, path, rows, schema, parts, seed):
    r = random.Random(seed)
    rows = list(rows)
    r.shuffle(rows)
    for k in range(parts):
        spark.createDataFrame(rows[k::parts], schema).coalesce(1).write.parquet(f"{path}/{k}")
    return spark.readStream.schema(spark.read.parquet(f"{path}/0").schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def test_phrases(spark, tmp_path):
    r, rows, want = random.Random(3), [], []
    for clip in (1, 2, 3):
        t, last, words = 0, None, []
        for i in range(r.choice([1, 40, 120])):
            start = t + r.choice([0, 100_000, fixed.PHRASE_GAP_US - 1, fixed.PHRASE_GAP_US])
            t = start + 200_000
            words.append((clip, i, start, t))
        rows += words + [(clip, len(words), None, None)]
        group = []
        for w in words:
            if group and w[2] - group[-1][3] >= fixed.PHRASE_GAP_US:
                want.append((clip, group[0][1], group[-1][1], group[0][2], group[-1][3], len(group)))
                group = []
            group.append(w)
        want.append((clip, group[0][1], group[-1][1], group[0][2], group[-1][3], len(group)))
    # a clip that has not ended holds its open phrase back, and only that one
    rows += [(4, 0, 0, 100_000), (4, 1, 5_000_000, 5_100_000)]
    want.append((4, 0, 0, 0, 100_000, 1))
    stream = live.clip_phrases(in_parts(spark, tmp_path / "words", rows, "clip_id bigint, i bigint, start_us bigint, end_us bigint", 5, 1))
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(p["numInputRows"] > 0 for p in q.recentProgress) == 5
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(want)


def test_timings(spark, tmp_path):
    r = random.Random(4)
    rows = [(run, r.choice(["probe", "clean", "decide", "film", "done"]), run * 1000 + r.randrange(900)) for run in range(6) for _ in range(12)]
    make = lambda df: df.select("run_id", "stage", F.timestamp_seconds("s").alias("ts"))
    schema = "run_id bigint, stage string, s bigint"
    out = tmp_path / "out"
    stream = live.run_timings(make(in_parts(spark, tmp_path / "events", rows, schema, 4, 2)), delay="30 days")
    q = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(lambda b, _: b.write.mode("append").parquet(str(out))).start()
    q.awaitTermination()
    written = spark.read.parquet(str(out))
    got = {tuple(x) for x in live.newest(written).select("run_id", "stage", "ts_us", "dur_us").collect()}
    assert got == {tuple(x) for x in live.stage_timings(make(spark.createDataFrame(rows, schema))).select("run_id", "stage", "ts_us", "dur_us").collect()}
    assert written.select("version").distinct().count() > 1
    ended = {x.run_id for x in live.newest(written).where("ended").collect()}
    assert ended == {run for run, stage, _ in rows if stage == "done"}
