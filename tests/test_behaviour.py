"""Boundary cases with exact expected values."""
import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxtable.functions import fixed
from voxtable.operators import clock as K, decisions as D, framing as FR, gaps as G, keep as P, levels as LV, proposals as PR, repeats as R, segments as S, verify as V
from voxtable.sources import answers as AN, files as FI, speech as SP
from voxtable.streaming import live

S_ = 1_000_000
KEEPS = "clip_id bigint, k bigint, start_us bigint, end_us bigint"


def keeps_of(rows, *spans):
    return rows(KEEPS, *[(1, k, round(a * S_), round(b * S_)) for k, (a, b) in enumerate(spans)])


def level_table(spark, db, clip=1):
    return spark.createDataFrame([(clip, f, float(v)) for f, v in enumerate(db)], "clip_id bigint, frame int, db double")


def clip_table(rows, sec, clip=1):
    return rows("clip_id bigint, duration_us bigint, width int, height int, fps_num int, fps_den int, sample_rate int", (clip, round(sec * S_), 1920, 1080, 30, 1, 48000))


def test_time_remap(rows):
    keeps = keeps_of(rows, (0, 2), (5, 8), (10, 11))
    pts = rows("clip_id bigint, t_us bigint", *[(1, round(t * S_)) for t in (1, 5, 6.5, 10.5, 3)])
    got = {r.t_us / S_: r.out_us / S_ for r in K.remap_time(pts, keeps).collect()}
    assert got == {1: 1, 5: 2, 6.5: 3.5, 10.5: 5.5, 3: 2}


def test_centre_rule(rows, words):
    w = words(("a", .2, .6), ("b", 1.8, 2.3), ("c", 5.1, 5.5), ("d", 9, 9.4), ("e", 10.2, 10.6))
    got = K.remap_words(w, keeps_of(rows, (0, 2), (5, 8), (10, 11))).orderBy("i").collect()
    assert [r.text for r in got] == ["a", "c", "e"]
    assert (got[1].start_us, got[1].end_us) == (2_100_000, 2_500_000)


def test_cut_points(rows):
    got = sorted(r.at_us / S_ for r in K.cut_points(keeps_of(rows, (0, 4), (4.1, 6), (8, 10), (12, 13), (15, 16))).collect())
    assert got == [5.9, 7.9]


def test_voiced_spans_and_batch(rows, words):
    w = words(("one", 0, .9), ("two", 9.5, 10), ).withColumn("i", F.col("i"))
    w = rows("clip_id bigint, i int, text string, start_us bigint, end_us bigint",
             (1, 0, "a", 0, 300_000), (1, 1, "b", 300_000, 600_000), (1, 2, "c", 600_000, 900_000), (1, 3, "d", 9_500_000, 10_400_000))
    clips = clip_table(rows, 11)
    sil = rows("clip_id bigint, start_us bigint, end_us bigint", *[(1, round(a * S_), round(b * S_)) for a, b in ((.9, 3), (4.8, 7), (7.8, 9.5), (10.4, 11))])
    spans = G.untranscribed(G.gaps(w, clips), sil, clips)
    got = sorted((r.start_us / S_, r.end_us / S_, r.prev_i, r.next_i) for r in spans.collect())
    assert got == [(3.0, 4.8, 2, 3), (7.0, 7.8, 2, 3)]
    seg = sorted((r.start_us, r.batch_start) for r in G.batch_layout(spans, clips).collect())
    assert seg[1][1] == 3_400_000


def test_edge_threshold(rows):
    d = rows("p double", (-10.0,), (-70.0,), (-20.0,), (-25.0,))
    on = [r[0] for r in d.select(LV.edge_threshold("p", "onset")).collect()]
    off = [r[0] for r in d.select(LV.edge_threshold("p", "offset")).collect()]
    assert on[:3] == [-45, -55, -50] and [off[0], off[1], off[3]] == [-40, -52, -47]


def test_word_edges_follow_the_sound(spark, rows, words):
    db = [-80] * 100
    db[20:50] = [-25] * 30
    lv = level_table(spark, db)
    cores = LV.word_cores(lv, words(("word", .1, .7)), clip_table(rows, 1.0))
    e = LV.word_edges(lv, cores).collect()[0]
    assert (e.onset, e.offset, e.onset_quiet, e.offset_quiet) == (20, 50, True, True)
    loud = level_table(spark, [-20] * 100)
    e = LV.word_edges(loud, LV.word_cores(loud, words(("word", .1, .7)), clip_table(rows, 1.0))).collect()[0]
    assert (e.onset_quiet, e.offset_quiet) == (False, False)


def test_long_words_keep_soft_middles(spark, rows, words):
    db = [-80] * 200
    db[20:50] = [-20] * 30
    db[65:90] = [-30] * 25                # second half of a long word after 0.15 s of quiet
    db[150:170] = [-20] * 20
    lv = level_table(spark, db)
    w = words(("videoeditors", .2, .95), ("next", 1.5, 1.7))
    edges = LV.word_edges(lv, LV.word_cores(lv, w, clip_table(rows, 2.0)))
    assert {r.i: r.offset for r in edges.collect()}[0] == 50
    ext = {r.i: (r.onset, r.offset) for r in LV.extend_edges(edges, lv).collect()}
    assert ext[0] == (20, 90) and ext[1] == (150, 170)


def test_stutter_and_function_words(words):
    t = "we can work for and work for and then stop here.".split()
    w = words(*[(x, k * .3, k * .3 + .2) for k, x in enumerate(t)])
    got = [(r.start_i, r.end_i, r.strength) for r in R.stutters(w).collect()]
    assert got == [(2, 5, 3)]
    calm = words(*[(x, k * .3, k * .3 + .2) for k, x in enumerate("it is in the and it is on the way to it".split())])
    assert R.find_retakes(calm).count() == 0


def naive_run(n, i, j):
    m, err, a, b = 0, 0, i, j
    while a < b < len(n):
        if n[a] == n[b] and n[a]:
            m, a, b = m + 1, a + 1, b + 1
        elif err:
            break
        elif b + 1 < len(n) and n[a + 1] == n[b + 1] and n[a + 1] and a + 1 < b:
            err, a, b = 1, a + 1, b + 1
        elif a + 1 < b and n[a + 1] == n[b]:
            err, a = 1, a + 1
        elif b + 1 < len(n) and n[a] == n[b + 1]:
            err, b = 1, b + 1
        else:
            break
    return m, a - i


def test_aligned_runs_against_a_walk(words):
    r = random.Random(7)
    for _ in range(3):
        toks = [r.choice(["alpha", "beta", "gamma", "delta", "the", "--"]) for _ in range(90)]
        w = words(*[(x, k * .3, k * .3 + .25) for k, x in enumerate(toks)])
        n = ["" if x == "--" else x for x in toks]
        got = {(x.i, x.j): (x.matched, x.len_i) for x in R.aligned_repeats(R.marked(w)).collect()}
        want = {}
        for i, j in itertools.combinations(range(90), 2):
            if 3 <= j - i <= 60 and n[i] and n[i] == n[j] and (j - i) * .3 <= 30:
                if i and n[i - 1] == n[j - 1] and n[i - 1]:
                    continue
                m, length = naive_run(n, i, j)
                if m >= 4 or (m == 3 and any(len(x) >= 3 and x != "the" for x in n[i:i + length])):
                    want[i, j] = (m, length)
        assert {k: v for k, v in got.items() if k in want} == want
        assert set(got) - set(want) <= {(0, j) for j in range(90)}


def test_pause_log(rows):
    lines = rows("clip_id bigint, line_no bigint, line string", *[(1, k, x) for k, x in enumerate((
        "silence_start: 0", "silence_end: 0.4 | d", "silence_start: 5.2", "silence_end: 5.7", "silence_start: 9.8", "silence_end: 10"))])
    got = [(r.start_us, r.end_us) for r in SP.inner_pauses(lines, clip_table(rows, 10)).collect()]
    assert got == [(5_200_000, 5_700_000)]


def test_shots_cover_every_word(words):
    r = random.Random(5)
    t, out = 0.0, []
    for k in range(160):
        end = "." if k % 11 == 10 else "," if k % 7 == 6 else ""
        out.append((f"word{k}{end}", t, t + .28))
        t += .28 + (.4 if end == "." else .2 if end else .05) + (8.0 if k in (60, 61) else 0)
    shots = S.split_shots(words(*out)).orderBy("shot_ord").collect()
    assert shots[0].start_us == 0
    assert [x for s in shots for x in range(s.first_i, s.last_i + 1)] == list(range(160))
    assert all(a.end_us == b.start_us for a, b in zip(shots, shots[1:]))
    assert all(round(out[s.last_i][2] - out[s.first_i][1], 6) <= 3.35 for s in shots)


def test_shot_costs_are_least():
    r = np.random.default_rng(3)
    for _ in range(20):
        n = 9
        d, g = r.integers(200, 900, n) * 1000, r.integers(20, 700, n) * 1000
        s = np.concatenate([[0], np.cumsum(d + g)[:-1]])
        e, bq = s + d, r.choice([0, 1.4, 3.0, -2.5], n)

        def cost(cuts):
            total, a = 0.0, 0
            for b in cuts:
                x = (e[b - 1] - s[a]) / 1e6
                if x > 6.6 and b - a > 1:
                    return np.inf
                total += (x - 2.5) ** 2 + (40 * (x - 3) ** 2 + 4 if x > 3 else 0) + (25 * (1.4 - x) ** 2 + 2 if x < 1.4 else 0) - (bq[b - 1] if b < n else 0)
                a = b
            return total
        every = [list(c) + [n] for k in range(n) for c in itertools.combinations(range(1, n), k)]
        assert cost(S._least_cost_cuts(s, e, bq, True)) == pytest.approx(min(map(cost, every)), abs=1e-6)


def test_camera_pieces_only_the_middle_one_is_punched(rows):
    geo = FR.crop_geometry(clip_table(rows, 12), rows("clip_id bigint, x double, y double, w double, h double, n_sec bigint, n_face bigint, share double, reliable boolean",
                                                      (1, .45, .2, .1, .2, 12, 12, 1.0, True)))
    shots = rows("clip_id bigint, unit bigint, start_us bigint, end_us bigint, layout string, camera string",
                 (1, 0, 0, 5 * S_, "full", "base"), (1, 1, 5 * S_, 9 * S_, "full", "punch"), (1, 2, 9 * S_, 12 * S_, "full", "base"))
    none = rows("clip_id bigint, at_us bigint")
    got = FR.camera_pieces(shots, none, geo).orderBy("piece").collect()
    assert [(r.start_frame, r.end_frame, r.camera) for r in got] == [(0, 150, "base"), (150, 270, "punch"), (270, 360, "base")]
    cut = rows("clip_id bigint, at_us bigint", (1, 2 * S_), (1, 4 * S_))
    got = FR.camera_pieces(shots, cut, geo).orderBy("piece").collect()
    assert [r.camera for r in got] == ["base", "punch", "base", "punch", "base"]


def test_keep_plan_invariants(spark, rows, words):
    db = [-80] * 600
    w = [(f"w{k}{'.' if k % 3 == 2 else ''}", .3 + k * .55, .3 + k * .55 + .4) for k in range(9)]
    for _, a, b in w:
        db[round(a * 100):round(b * 100)] = [-20] * (round(b * 100) - round(a * 100))
    lv, ws, clips = level_table(spark, db), words(*w), clip_table(rows, 6)
    edges = LV.word_edges(lv, LV.word_cores(lv, ws, clips))
    removed = rows("clip_id bigint, i bigint, reason string", (1, 3, "retake"), (1, 4, "retake"))
    cuts, keeps = P.plan_keep(ws, removed, edges, rows("clip_id bigint, start_us bigint, end_us bigint"), lv, clips)
    cuts, keeps = cuts.orderBy("start_us").collect(), keeps.orderBy("start_us").collect()
    assert {c.reason for c in cuts} >= {"lead", "retake", "tail"} and " ".join(c.text for c in cuts).split() == ["w3", "w4"]
    for a, b in zip(keeps, keeps[1:]):
        assert a.end_us < b.start_us
    for k, (_, a, b) in enumerate(w):
        inside = any(x.start_us <= a * 1e6 + 1 and b * 1e6 - 1 <= x.end_us for x in keeps)
        assert inside == (k not in (3, 4))
    assert all(abs(x.start_us * 30 / 1e6 - round(x.start_us * 30 / 1e6)) < 1e-4 for x in keeps)


def test_proposals(rows, words):
    t = ("so the new camera works great now . " "um yes . " "so the new camera works great now today . " "and this is only said once by me .").split()
    w = words(*[(x, k * .4, k * .4 + .3) for k, x in enumerate(t)])
    none = rows("clip_id bigint, i int")
    f = PR.word_features(w, none, none)
    props = rows("clip_id bigint, p_ord bigint, from_i bigint, to_i bigint, reason string", (1, 0, 0, 7, "earlier take"), (1, 1, 20, 27, "only once"), (1, 2, 30, 90, "outside"), (1, 3, 2, 3, "inside the first"))
    got = {r.p_ord: (r.accepted, r.rejected) for r in PR.guard_proposals(props, f).collect()}
    assert got[1][0] is False and "last take" in got[1][1]
    assert got[2] == (False, PR.INVALID)
    assert got[3][0] is True
    assert got[0][0] is False or got[0] == (True, None)


def test_proposal_cap_is_sequential(rows, words):
    t = ("alpha beta gamma delta . " * 12).split()
    w = words(*[(x, k * .4, k * .4 + .3) for k, x in enumerate(t)])
    none = rows("clip_id bigint, i int")
    props = rows("clip_id bigint, p_ord bigint, from_i bigint, to_i bigint, reason string", *[(1, p, p * 5, p * 5 + 4, "again") for p in range(11)])
    got = PR.guard_proposals(props, PR.word_features(w, none, none)).orderBy("p_ord").collect()
    assert [r.p_ord for r in got if r.accepted] == [8, 9, 10]
    assert all("25% of the speech" in r.rejected for r in got if not r.accepted)


def test_overlays(rows):
    shots = rows("clip_id bigint, unit bigint, start_us bigint, end_us bigint, overlay string, graphic double, p_none double, p_card double, p_pill double, p_giant double, giant_word string",
                 *[(1, u, u * 2 * S_, (u + 1) * 2 * S_, "giant_word" if u in (4, 5, 9) else "card", .5 + u / 100, .2, .1, .0, .3 + u / 100, f"WORD{u}") for u in range(14)])
    hook = rows("clip_id bigint, hook_end_us bigint", (1, 3 * S_))
    got = {r.unit: r for r in D.plan_overlays(shots, hook, rows("clip_id bigint, duration_us bigint", (1, 28 * S_))).collect()}
    assert got[0].overlay == "none" and got[1].overlay == "none"
    assert [u for u in got if got[u].giant] == [9] or sorted(u for u in got if got[u].giant) == [4, 9]
    starts = sorted(got[u].unit * 2 for u in got if got[u].giant)
    assert all(b - a >= 8.5 for a, b in zip(starts, starts[1:]))
    card = sum(2 for u in got if got[u].overlay in ("card", "keyword_pill"))
    assert card / 25 <= fixed.COVERAGE_CAP or "density" in " ".join(x for u in got for x in got[u].log)


def test_asr_tokens(rows):
    doc = ('{"text":"","sentences":[{"text":"","start":0,"end":2,"tokens":[{"text":" Hel","start":0.1,"end":0.2},{"text":"lo","start":0.2,"end":0.3},'
           '{"text":".","start":1.4,"end":1.5}]},{"text":"","start":2,"end":3,"tokens":[{"text":"You","start":2.0,"end":2.2}]}]}')
    d = rows("clip_id bigint, text string", (1, doc))
    got = [(r.i, r.text, r.start_us, r.end_us) for r in SP.asr_words(d).orderBy("i").collect()]
    assert got == [(0, "Hello.", 100_000, 1_500_000), (1, "You", 2_000_000, 2_200_000)]
    assert SP.asr_words(d, precise_ends=True).orderBy("i").collect()[0].end_us == 300_000


def test_logs(rows):
    t = rows("clip_id bigint, text string", (1, "RMS_level=-inf\nx\nRMS_level=-12.5\nRMS_level=-120"), (2, "silence_start: -0.01\nsilence_end: 1.5\nsilence_start: 8"))
    lines = FI.lines(t)
    assert [r.db for r in SP.level_log(lines.filter("clip_id = 1")).orderBy("frame").collect()] == [-90, -12.5, -90]
    got = sorted((r.start_us, r.end_us) for r in SP.silence_log(lines.filter("clip_id = 2"), clip_table(rows, 10, 2)).collect())
    assert got == [(0, 1_500_000), (8_000_000, 10_000_000)]


def test_model_texts(rows):
    t = rows("clip_id bigint, text string", (1, '<think>{"drops":1}</think>```json\n{"drops":[{"from":1,"to":2,"reason":"r"}]}\n```'), (2, "nothing"), (3, '{"drops":5}'), (4, '{"drops":[{"from":1.5,"to":2}]}'))
    p, bad = AN.read_proposals(t)
    assert [(r.clip_id, r.from_i, r.to_i, r.reason) for r in p.orderBy("clip_id").collect()] == [(1, 1, 2, "r"), (4, None, 2, "")]
    assert sorted(r.clip_id for r in bad.collect()) == [2, 3]


def test_stream_phrase_boundary(spark, rows):
    w = rows("clip_id bigint, i bigint, text string, start_ms bigint, end_ms bigint", (1, 0, "a", 0, 300), (1, 1, "b", 800, 1000), (1, 2, "c", 1499, 1700), (1, 3, "d", 2300, 2500))
    w = w.select("clip_id", "i", "text", F.timestamp_millis("start_ms").alias("ts"), ((F.col("end_ms") - F.col("start_ms")) * 1000).alias("dur_us"))
    got = [(r.start_us // 1000, r.end_us // 1000) for r in live.stream_phrases(w).orderBy("start_us").collect()]
    assert got == [(0, 300), (800, 1700), (2300, 2500)]
