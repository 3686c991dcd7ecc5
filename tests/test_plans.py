"""Joins of tables that have a row per second or per piece are not broadcast, however small their files are."""
import os

import numpy as np
from pyspark.sql import functions as F

from voxtable.functions.seq import fresh, running
from voxtable.functions.stage import stage
from voxtable.operators import automaton, framing as FR, keep, repeats, structure
from voxtable.plans.corpus import Corpus


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_faces_of_every_second_are_not_broadcast(spark, rows):
    faces = rows("clip_id bigint, sec int, face_ord int, x double, y double, w double, h double",
                 (1, 0, 0, 0.1, 0.2, 0.3, 0.3), (1, 0, 1, 0.2, 0.2, 0.3, 0.4), (1, 2, 0, 0.5, 0.5, 0.1, 0.1), (2, 0, 0, 0.5, 0.5, 0.1, 0.1))
    clips = rows("clip_id bigint, duration_us bigint", (1, 3_500_000), (2, 900_000), (3, 1_000_000))
    got = FR.largest_faces(stage(faces, "faces"), stage(clips, "clips"))
    assert "Broadcast" not in plan(got)
    assert sorted((r.clip_id, r.sec, r.x) for r in got.collect() if r.x) == [(1, 0, 0.2), (1, 2, 0.5)]
    assert sorted((r.clip_id, r.sec) for r in got.collect() if r.x is None) == [(1, 1), (3, 0)]


def test_states_of_every_row_are_not_broadcast(spark, rows):
    d = rows("clip_id bigint, n bigint", *((1, k) for k in range(5)))
    states = automaton.run(d, "n", lambda pdf: np.tile([1, 0], (len(pdf), 1)), 0)
    got = d.join(fresh(states.select("clip_id", "n", "state")), ["clip_id", "n"])
    assert "Broadcast" not in plan(got)
    assert [r.state for r in got.orderBy("n").collect()] == [1, 0, 1, 0, 1]


def test_carries_of_blocks_are_not_broadcast(spark, rows):
    d = stage(rows("clip_id bigint, n bigint", *((c, k) for c in (1, 2) for k in range(5))), "numbers")
    got = running(d, "n", {"total": ("sum", "n")}, size=2)
    assert "Broadcast" not in plan(got)
    assert sorted((r.clip_id, r.n, r.total) for r in got.collect()) == [(c, k, k * (k + 1) // 2) for c in (1, 2) for k in range(5)]


def test_files_count_for_more_than_their_size(spark):
    """A table whose rows are far larger than its file is not broadcast by the size of the file."""
    few = stage(spark.range(20_000).selectExpr("id DIV 100 AS clip_id", "id % 100 AS sec"), "seconds")
    size = sum(os.path.getsize(f.removeprefix("file://")) for f in few.inputFiles())
    known = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 2 * size)
    try:
        assert "Broadcast" not in plan(few.join(fresh(few), ["clip_id", "sec"]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", known)


def test_running_sums_in_turn_share_a_shuffle(spark, rows):
    d = rows("clip_id bigint, n bigint, v bigint", *((c, k, 1) for c in (1, 2) for k in range(9)))
    a = running(d, "n", {"x": ("sum", "v")}, size=4, keep_block=True)
    b = running(a, "n", {"y": ("sum", "x")}, size=4)
    again = running(a.drop("__blk"), "n", {"y": ("sum", "x")}, size=4)
    shuffles = lambda df: sum("Exchange hashpartitioning(clip_id" in x and "__blk" in x for x in plan(df).splitlines())
    assert b.columns == again.columns and sorted(b.collect()) == sorted(again.collect())
    assert shuffles(b) < shuffles(again)


def test_gaps_carry_no_texts_and_no_inputs(spark, rows):
    """What a gap's cut was computed from is not written with it; a sign that ends a phrase keeps its wider pads."""
    words = rows("clip_id bigint, i int, text string, start_us bigint, end_us bigint", *((1, k, t, k * 400_000, k * 400_000 + 200_000) for k, t in enumerate(("a.", "b", None, "d"))))
    edges = rows("clip_id bigint, i bigint, onset bigint, onset_quiet boolean, offset bigint, offset_quiet boolean", *((1, k, k * 40, True, k * 40 + 20, True) for k in range(4)))
    clips = rows("clip_id bigint, duration_us bigint, fps_num int, fps_den int", (1, 1_600_000, 30, 1))
    g = keep.plan_gaps(words, rows("clip_id bigint, i bigint"), edges, clips)
    assert not {"a_text", "a_quiet", "a_next", "b_quiet", "b_prev", "duration_us", "total", "lead", "tail"} & set(g.columns)
    # half of the 0.2 s of air would allow 0.1 s: 80 and 50 ms after a sign, 50 and 40 ms inside a phrase
    assert [(r.g, r.start // 60, r.end // 60) for r in g.orderBy("g").collect()] == [
        (0, 0, 0), (1, 280_000, 350_000), (2, 650_000, 760_000), (3, 1_050_000, 1_160_000), (4, 1_480_000, 1_600_000)]


def test_marks_carry_only_what_is_looked_up(spark, words):
    """Neighbours' flags are not written with the marks made from them, and texts only where they are shown."""
    w = words(("So,", 0, 0.2), ("we", 0.3, 0.5), ("go.", 0.5, 0.7), ("Then", 1.2, 1.4))
    full, bare = repeats.marked(w), repeats.marked(w, texts=False)
    assert set(full.columns) - set(bare.columns) == {"text", "end_us"}
    assert not {"comma", "pstop", "pcomma", "pe"} & set(full.columns)
    got = bare.select("i", "n", "pn", "opens", "at_boundary", "last_stop", "last_gap", "next_stop").orderBy("i").collect()
    assert [tuple(r) for r in got] == [(0, "so", None, True, True, None, None, 2), (1, "we", "so", True, True, None, None, 2),
                                       (2, "go", "we", False, False, None, None, 2), (3, "then", "go", True, True, 3, 3, None)]


def test_staged_tables_are_read_in_small_splits(spark):
    """Sixteen MB of a staged table make some hundred in memory; a task gets no more of them, whatever wrote the file."""
    t = stage(spark.range(0, 4_000_000, 1, 1).select(F.rand(1).alias("prob")), "wide")
    known = spark.conf.get("spark.sql.files.maxPartitionBytes")
    assert known != "134217728b"
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(16 << 20))
    try:
        shares = [n for n in t.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", known)
    assert len(shares) > 1 and sum(shares) == 4_000_000


def test_answers_are_made_by_several_tasks(spark, rows):
    """All units lie in one small file; their answers, sixty rows each, are not made by the task that reads it."""
    c = Corpus(spark, "")
    c.__dict__["units"] = stage(rows("clip_id bigint, unit bigint", *((1, k) for k in range(40))).coalesce(1), "few_units")
    assert len(c.units.inputFiles()) == 1
    assert len(c.answers.inputFiles()) > 1
    assert c.answers.select("unit").distinct().count() == 40
    assert c.answers.groupBy("unit", "question").agg(F.sum("prob").alias("p")).filter("abs(p - 1) > 1e-9").count() == 0


def test_opening_needs_only_the_best_full_template(spark, rows):
    """The opening's rule gives the same from the distribution and from its best template, and moves no distribution then."""
    d = lambda *p: [(k, t, x) for k, (t, x) in enumerate(p)]
    s = rows("clip_id bigint, unit bigint, start_us bigint, end_us bigint, has_visual boolean, template string, layout string, transition_in string, punch boolean, "
             "template_d array<struct<label_ord:bigint,label:string,prob:double>>",
             (1, 0, 0, 900, True, "versus", "split", "fade", True, d(("big_statement", 0.1), ("versus", 0.9))),
             (1, 1, 900, 900_000, True, "versus", "split", "fade", True, None),
             (1, 2, 900_000, 1_800_000, True, None, "full", "fade", False, d(("big_statement", 1.0))))
    hook = rows("clip_id bigint, hook_end_us bigint", (1, 500_000))
    lean = structure.apply_hook(structure.full_templates(s), hook)
    whole = structure.apply_hook(s, hook)
    same = [c for c in whole.columns if c != "template_d"]
    assert "template_d" not in lean.columns
    assert sorted(map(str, lean.select(*same).collect())) == sorted(map(str, whole.select(*same).collect()))


def test_a_staged_table_leaves_no_shuffle(spark):
    """What a write shuffled goes with it; the session's own setting stays."""
    import time
    _CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {n for n in (files.getAllFiles().apply(k).getName() for k in range(files.getAllFiles().size())) if n.startswith("shuffle_")}
    known, before = spark.conf.get(_CLEAN, None), shuffled()
    t = stage(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).agg(F.sum("id").alias("n")), "shuffled")
    for _ in range(20):
        if not shuffled() - before:
            break
        time.sleep(0.5)
    assert not shuffled() - before
    assert t.count() == 100 and spark.conf.get(_CLEAN, None) == known
