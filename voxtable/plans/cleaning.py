"""Queries on gaps, cuts, kept ranges and the output clock."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, text
from ..functions.intervals import merged
from ..functions.stage import stage
from ..operators import clock as K, gaps as G, keep as P, repeats as R, segments as S
from . import retakes, sound
from .oracle_tables import sql_list as L, table
from .registry import query
from .retakes import _lazy
from .sound import EDGES

gap_rows = _lazy("gap_rows", lambda c: G.gaps(c.words, c.clips))
spans = _lazy("voiced_spans", lambda c: G.untranscribed(gap_rows(c), c.silences, c.clips))

table("gap_rows", """SELECT clip_id, CAST(i - 1 AS BIGINT) AS prev_i, CAST(i AS BIGINT) AS next_i, coalesce(lag(end_us) OVER (PARTITION BY clip_id ORDER BY i), 0) AS gs, start_us AS ge, false AS tail FROM words
  UNION ALL SELECT clip_id, CAST(max(i) AS BIGINT), CAST(max(i) + 1 AS BIGINT), max(end_us), max(next_us), true FROM words GROUP BY clip_id""")
# gap minus silences: silences here are sorted and disjoint, so what is left lies between neighbours
table("gap_voiced", """SELECT * FROM (
  SELECT clip_id, prev_i, next_i, gs, ge, tail, gs AS start_us, coalesce(least(ge, q0), ge) AS end_us FROM (
     SELECT g.*, (SELECT min(s.start_us) FROM silences s WHERE s.clip_id = g.clip_id AND s.end_us > g.gs AND s.start_us < g.ge) AS q0 FROM gap_rows g)
  UNION ALL
  SELECT g.clip_id, prev_i, next_i, gs, ge, tail, s.end_us, least(ge, s.nxt) FROM gap_rows g
  JOIN (SELECT *, coalesce(lead(start_us) OVER (PARTITION BY clip_id ORDER BY start_us), 1000000000000000) AS nxt FROM silences) s ON s.clip_id = g.clip_id AND s.end_us > g.gs AND s.start_us < g.ge)
  WHERE end_us > start_us""")
table("sounds", """SELECT clip_id, start_us, end_us FROM gap_voiced WHERE end_us - start_us BETWEEN 150000 AND 1200000
  AND NOT (prev_i >= 0 AND start_us - gs < 50000) AND NOT (NOT tail AND ge - end_us < 50000)""")
table("vspans", "SELECT clip_id, start_us, end_us, prev_i, next_i FROM gap_voiced WHERE end_us - start_us >= 600000 AND ge - gs >= 600000")
table("layout", """SELECT *, CAST(coalesce(sum(src_end - src_start + 1000000) OVER (PARTITION BY clip_id ORDER BY start_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS batch_start FROM (
  SELECT v.*, greatest(0, start_us - 300000) AS src_start, least(duration_us, end_us + 300000) AS src_end FROM vspans v JOIN clips USING (clip_id))""")


@query("word_gaps", "SELECT * FROM gap_rows")
def word_gaps(c):
    return gap_rows(c)


@query("filler_sounds", "SELECT * FROM sounds")
def filler_sounds(c):
    return G.filler_sounds(gap_rows(c), c.silences, c.clips)


@query("untranscribed_spans", "SELECT * FROM vspans")
def untranscribed_spans(c):
    return spans(c)


layout = _lazy("batch_layout", lambda c: G.batch_layout(spans(c), c.clips))


@query("batch_layout", "SELECT * FROM layout")
def batch_layout(c):
    return layout(c)


table("batch_heard", """SELECT l.clip_id, CASE k WHEN 0 THEN p.text WHEN 1 THEN 'more' WHEN 2 THEN 'speech' ELSE coalesce(n.text, 'end') END AS text,
  batch_start + 200000 + k * 350000 AS start_us, batch_start + 500000 + k * 350000 AS end_us
  FROM layout l CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS k) LEFT JOIN words p ON p.clip_id = l.clip_id AND p.i = l.prev_i LEFT JOIN words n ON n.clip_id = l.clip_id AND n.i = l.next_i""")
table("recovered_words", """SELECT clip_id, text, CAST(greatest(0, s) AS BIGINT) AS start_us, CAST(greatest(s, e) AS BIGINT) AS end_us FROM (
  SELECT h.clip_id, h.text, x.nm, l.src_start + h.start_us - l.batch_start AS s, l.src_start + h.end_us - l.batch_start AS e, l.start_us AS v0, l.end_us AS v1, p.end_us AS pe, p.nm AS pn, n.start_us AS ns, n.nm AS nn
  FROM batch_heard h JOIN layout l ON l.clip_id = h.clip_id AND h.start_us + h.end_us >= 2 * l.batch_start AND h.start_us + h.end_us < 2 * (l.batch_start + l.src_end - l.src_start)
  LEFT JOIN (SELECT DISTINCT text, nm FROM nwords UNION SELECT * FROM (VALUES ('more', 'more'), ('speech', 'speech'), ('end', 'end'))) x ON x.text = h.text
  LEFT JOIN nwords p ON p.clip_id = l.clip_id AND p.i = l.prev_i LEFT JOIN nwords n ON n.clip_id = l.clip_id AND n.i = l.next_i)
  WHERE s + e BETWEEN 2 * (v0 - 200000) AND 2 * (v1 + 200000) AND NOT coalesce(s + e <= 2 * pe, false) AND NOT coalesce(s + e >= 2 * ns, false) AND nm <> ''
   AND NOT coalesce(pn = nm AND s - pe < 350000, false) AND NOT coalesce(nn = nm AND ns - e < 350000, false)""")


def batch_heard(c):
    """What a second pass hears in the batch: the neighbours' echoes and two new words per span."""
    w = lambda k, n: c.words.select("clip_id", F.col("i").cast("bigint").alias(k), F.col("text").alias(n)).toDF("clip_id", k, n)
    h = layout(c).join(w("prev_i", "pt"), ["clip_id", "prev_i"], "left").join(w("next_i", "nt"), ["clip_id", "next_i"], "left")
    h = h.select("clip_id", "batch_start", F.posexplode(F.array("pt", F.lit("more"), F.lit("speech"), F.coalesce("nt", F.lit("end")))).alias("k", "text"))
    return h.select("clip_id", "text", F.expr("batch_start + 200000 + k * 350000").alias("start_us"), F.expr("batch_start + 500000 + k * 350000").alias("end_us"))


recovered = _lazy("recovered_words", lambda c: G.map_batch_words(batch_heard(c), layout(c), c.words))


@query("recovered_words", "SELECT * FROM recovered_words")
def recovered_words(c):
    return recovered(c)


MERGED = """(SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY start_us, end_us, o, was, text) - 1 AS i, text, start_us, end_us, o FROM (
  SELECT clip_id, text, start_us, end_us, 0 AS o, i AS was FROM words UNION ALL SELECT clip_id, text, start_us, end_us, 1, 0 FROM recovered_words))"""
merged_words = _lazy("merged_words", lambda c: G.merge_words(c.words, recovered(c)))


@query("merged_words", f"SELECT clip_id, i, text, start_us, end_us FROM {MERGED}")
def merged_words_q(c):
    return merged_words(c)


@query("recovered_indices", f"""SELECT m.clip_id, m.i FROM {MERGED} m WHERE EXISTS (SELECT 1 FROM recovered_words r
  WHERE r.clip_id = m.clip_id AND r.start_us = m.start_us AND r.end_us = m.end_us AND r.text = m.text)""")
def recovered_indices(c):
    return G.recovered_indices(merged_words(c), recovered(c))


# ---- planner --------------------------------------------------------------------------------------
table("cut_words", f"""SELECT clip_id, CAST(i AS BIGINT) AS i, CASE WHEN i % 50 BETWEEN 10 AND 14 OR i % 50 = 17 THEN 'retake' ELSE 'filler' END AS reason FROM nwords
  WHERE i % 50 BETWEEN 10 AND 14 OR i % 50 = 17 OR nm IN {L(fixed.FILLER_SPOKEN)}""")


def cut_words(c):
    """Removed words by a position rule, with every spoken filler."""
    at = F.expr("i % 50 BETWEEN 10 AND 14 OR i % 50 = 17")
    return c.words.filter(at | text.norm_match("text").isin(fixed.FILLER_SPOKEN)).select(
        "clip_id", F.col("i").cast("bigint").alias("i"), F.when(at, "retake").otherwise("filler").alias("reason"))


PLAN = EDGES + """,
pw AS (SELECT w.clip_id, CAST(w.i AS BIGINT) AS i, w.text, w.start_us, w.end_us, e.onset * 10000 AS on_us, e.onset_quiet AS onq, e."offset" * 10000 AS off_us, e.offset_quiet AS offq,
  r.reason, lead(e.onset * 10000) OVER w AS next_on, lag(e."offset" * 10000) OVER w AS prev_off
  FROM words w JOIN edges e ON e.clip_id = w.clip_id AND e.i = w.i LEFT JOIN cut_words r ON r.clip_id = w.clip_id AND r.i = w.i WINDOW w AS (PARTITION BY w.clip_id ORDER BY w.i)),
pk AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY i) - 1 AS g FROM pw WHERE reason IS NULL),
pg0 AS (SELECT coalesce(a.clip_id, b.clip_id) AS clip_id, coalesce(b.g, a.g + 1) AS g, a.i AS a_i, a.text AS a_text, a.start_us AS a_start, a.end_us AS a_end, a.off_us AS a_off, a.offq AS aq, a.next_on AS a_next,
  b.i AS b_i, b.start_us AS b_start, b.end_us AS b_end, b.on_us AS b_on, b.onq AS bq, b.prev_off AS b_prev
  FROM pk a FULL JOIN pk b ON a.clip_id = b.clip_id AND b.g = a.g + 1),
pg1 AS (SELECT p.*, CAST(2 * c.fps_num AS BIGINT) AS k, CAST(2000000 AS BIGINT) * c.fps_den AS fr, c.duration_us AS dur, c.duration_us * 2 * c.fps_num AS total,
  a_i IS NOT NULL AND b_i IS NOT NULL AND NOT regexp_matches(coalesce(a_text, ''), '[.!?,;:]["'')\\]]*$') AS tight FROM pg0 p JOIN clips c USING (clip_id)),
pg2 AS (SELECT *, CASE WHEN a_i IS NULL THEN 'lead' WHEN b_i IS NULL THEN 'tail' WHEN b_on - a_off > 350000 THEN 'silence' END AS base,
  CASE WHEN a_i IS NULL THEN 0 WHEN aq THEN a_off * k + least((CASE WHEN tight THEN 50000 ELSE 80000 END) * k, greatest(0, greatest(a_off, coalesce(a_next, dur)) - a_off) * (k // 2)) ELSE a_off * k END AS st,
  CASE WHEN b_i IS NULL THEN total WHEN bq THEN b_on * k - least((CASE WHEN tight THEN 40000 ELSE 50000 END) * k, greatest(0, b_on - least(b_on, coalesce(b_prev, 0))) * (k // 2)) ELSE b_on * k END AS en FROM pg1),
pg3 AS (SELECT *, coalesce(base, 'silence') AS gap_reason, coalesce(a_end, 0) AS gs, coalesce(b_start, dur) AS ge,
  CASE WHEN a_i IS NULL THEN 0 WHEN ((st + fr // 2) // fr) * fr >= CASE WHEN aq THEN least(st, a_off * k + 30000 * k) ELSE st END THEN ((st + fr // 2) // fr) * fr ELSE ((st + fr - 1) // fr) * fr END AS s0,
  CASE WHEN b_i IS NULL THEN total WHEN ((en + fr // 2) // fr) * fr <= CASE WHEN bq THEN greatest(en, b_on * k - 30000 * k) ELSE en END THEN ((en + fr // 2) // fr) * fr ELSE (en // fr) * fr END AS e0 FROM pg2),
pit AS (SELECT p.clip_id, g.g, p.on_us AS s_us, greatest(p.on_us, p.off_us) AS e_us, p.reason, p.text, p.i AS o FROM pw p JOIN pg3 g ON g.clip_id = p.clip_id AND p.i > coalesce(g.a_i, -1) AND p.i < coalesce(g.b_i, 1000000000) WHERE p.reason IS NOT NULL
  UNION ALL SELECT s.clip_id, g.g, s.start_us, s.end_us, 'filler', '', 1000000000 FROM sounds s JOIN pg3 g ON g.clip_id = s.clip_id AND s.start_us >= g.gs AND s.end_us <= g.ge),
pg4 AS (SELECT g.*, x.f_us, x.l_us FROM pg3 g LEFT JOIN (SELECT clip_id, g, min(s_us) AS f_us, max(e_us) AS l_us FROM pit GROUP BY clip_id, g) x USING (clip_id, g)
  WHERE (base IS NOT NULL OR f_us IS NOT NULL) AND en - st >= 50000 * k),
loud AS (SELECT clip_id, CAST(min(frame) AS BIGINT) * 10000 AS q0, (CAST(max(frame) AS BIGINT) + 1) * 10000 AS q1 FROM (SELECT clip_id, frame, frame - row_number() OVER (PARTITION BY clip_id ORDER BY frame) AS h FROM levels WHERE db >= -45) GROUP BY clip_id, h),
pg5 AS (SELECT g.*, greatest(s0, coalesce((((re + 30000) * k + fr - 1) // fr) * fr, s0)) AS s1 FROM (
   SELECT g.*, CASE WHEN a_end - a_start >= 450000 THEN (SELECT CAST(max(least(q1, hi)) AS BIGINT) FROM loud q WHERE q.clip_id = g.clip_id AND q.q0 < hi AND q.q1 > lo AND least(q1, hi) - greatest(q0, lo) >= 30000) END AS re
   FROM (SELECT *, floor(a_off / 10000) * 10000 AS lo, ceil(least(a_end, coalesce(f_us, a_end), e0 / k) / 10000) * 10000 AS hi FROM pg4) g) g),
pg6 AS (SELECT * FROM (SELECT g.*, least(e0, coalesce((((rs - 30000) * k) // fr) * fr, e0)) AS e1 FROM (
   SELECT g.* EXCLUDE (lo, hi), CASE WHEN b_end - b_start >= 450000 THEN (SELECT CAST(min(greatest(q0, lo2)) AS BIGINT) FROM loud q WHERE q.clip_id = g.clip_id AND q.q0 < hi2 AND q.q1 > lo2 AND least(q1, hi2) - greatest(q0, lo2) >= 30000) END AS rs
   FROM (SELECT *, floor(greatest(b_start, coalesce(l_us, b_start), s1 / k) / 10000) * 10000 AS lo2, ceil(b_on / 10000) * 10000 AS hi2 FROM pg5) g) g) WHERE (e1 - s1) * 2 >= fr * 3),
pb AS (SELECT p.clip_id, p.g, s_us AS k0, o, 0 AS sub, gap_reason AS reason, '' AS text, ((s_us * k + fr // 2) // fr) * fr AS t, s1, e1 FROM pit p JOIN pg6 USING (clip_id, g)
  UNION ALL SELECT p.clip_id, p.g, s_us, o, 1, p.reason, p.text, ((e_us * k + fr // 2) // fr) * fr, s1, e1 FROM pit p JOIN pg6 USING (clip_id, g)
  UNION ALL SELECT clip_id, g, 1000000000000000, 0, 2, gap_reason, '', e1, s1, e1 FROM pg6),
pc AS (SELECT clip_id, g, least(e1, greatest(s1, coalesce(max(t) OVER (PARTITION BY clip_id, g ORDER BY k0, o, sub ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s1))) AS a,
   least(e1, greatest(s1, max(t) OVER (PARTITION BY clip_id, g ORDER BY k0, o, sub ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))) AS b, reason, text FROM pb),
pd AS (SELECT clip_id, g, min(a) AS a, max(b) AS b, any_value(reason) AS reason, coalesce(string_agg(text, ' ' ORDER BY a) FILTER (text <> ''), '') AS text FROM (
   SELECT *, sum(nw) OVER (PARTITION BY clip_id, g ORDER BY a) AS isle FROM (SELECT *, CASE WHEN reason = lag(reason) OVER (PARTITION BY clip_id, g ORDER BY a) THEN 0 ELSE 1 END AS nw FROM pc WHERE b > a)) GROUP BY clip_id, g, isle),
pe AS (SELECT clip_id, g, a, b, CASE WHEN reason = 'silence' AND lag(reason) OVER w = 'retake' AND lead(reason) OVER w = 'retake' THEN 'retake' ELSE reason END AS reason, text FROM pd WINDOW w AS (PARTITION BY clip_id, g ORDER BY a)),
pf AS (SELECT clip_id, g, min(a) AS a, max(b) AS b, any_value(reason) AS reason, coalesce(string_agg(text, ' ' ORDER BY a) FILTER (text <> ''), '') AS text FROM (
   SELECT *, sum(nw) OVER (PARTITION BY clip_id, g ORDER BY a) AS isle FROM (SELECT *, CASE WHEN reason = lag(reason) OVER (PARTITION BY clip_id, g ORDER BY a) THEN 0 ELSE 1 END AS nw FROM pe)) GROUP BY clip_id, g, isle),
cuts AS (SELECT clip_id, (a * 2 + k) // (2 * k) AS start_us, (b * 2 + k) // (2 * k) AS end_us, reason, text, a, b, k, total FROM pf JOIN (SELECT DISTINCT clip_id, k, total FROM pg1) USING (clip_id)),
kp AS (SELECT clip_id, coalesce(lag(b) OVER (PARTITION BY clip_id ORDER BY a), 0) AS ka, a AS kb, k FROM cuts UNION ALL SELECT clip_id, max(b), max(total), max(k) FROM cuts GROUP BY clip_id),
pkeeps AS (SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY ka) - 1 AS k, CAST((ka * 2 + k) // (2 * k) AS BIGINT) AS start_us, CAST((kb * 2 + k) // (2 * k) AS BIGINT) AS end_us FROM kp WHERE kb > ka)"""

sounds = _lazy("sounds", lambda c: G.filler_sounds(gap_rows(c), c.silences, c.clips))


def _plan(c):
    known = c.__dict__.setdefault("_lazy", {})
    if "plan" not in known:
        cuts, keeps = P.plan_keep(c.words, cut_words(c), sound.edges(c), sounds(c), c.level_blocks, c.clips)
        known["plan"] = (stage(cuts, "cuts"), stage(keeps, "plan_keeps"))
    return known["plan"]


@query("planned_cuts", "WITH RECURSIVE " + PLAN + " SELECT clip_id, start_us, end_us, reason, text FROM cuts")
def planned_cuts(c):
    return _plan(c)[0]


@query("planned_keeps", "WITH RECURSIVE " + PLAN + " SELECT * FROM pkeeps")
def planned_keeps(c):
    return _plan(c)[1]


@query("clean_stats", "WITH RECURSIVE " + PLAN + """
SELECT c.clip_id, c.duration_us AS before_us, CAST(coalesce((SELECT sum(end_us - start_us) FROM pkeeps p WHERE p.clip_id = c.clip_id), 0) AS BIGINT) AS after_us, (SELECT count(*) FROM pkeeps p WHERE p.clip_id = c.clip_id) AS n_keeps,
""" + ", ".join(f"CAST(coalesce(sum(x.end_us - x.start_us) FILTER (x.reason = '{r}'), 0) AS BIGINT) AS {r}_us" for r in ("retake", "silence", "filler", "lead", "tail")) + """,
count(*) FILTER (x.reason = 'filler') AS fillers_cut, count(x.reason) AS n_cuts FROM clips c LEFT JOIN cuts x ON x.clip_id = c.clip_id GROUP BY c.clip_id, c.duration_us""")
def clean_stats(c):
    cuts, keeps = _plan(c)
    return P.clean_stats(cuts, keeps, c.clips)


@query("protected_cuts")
def protected_cuts(c):
    """Cuts with the wordless voiced spans of 1.2 s or more taken out."""
    p = G.protectable(spans(c), cut_words(c))
    cuts, _ = P.plan_keep(c.words, cut_words(c), sound.edges(c), sounds(c), c.level_blocks, c.clips, p)
    return cuts


@query("protectable_spans", """SELECT v.* FROM vspans v LEFT JOIN cut_words a ON a.clip_id = v.clip_id AND a.i = v.prev_i LEFT JOIN cut_words b ON b.clip_id = v.clip_id AND b.i = v.next_i
WHERE v.end_us - v.start_us >= 1200000 AND NOT (a.i IS NOT NULL AND b.i IS NOT NULL)""")
def protectable_spans(c):
    return G.protectable(spans(c), cut_words(c))


table("prop_ranges", "SELECT p.clip_id, p_ord, from_i, to_i, reason FROM proposals p JOIN (SELECT clip_id, max(i) AS m FROM words GROUP BY clip_id) USING (clip_id) WHERE to_i <= m")


def drops(c):
    n = c.words.groupBy("clip_id").agg(F.max("i").alias("m"))
    p = c.proposals.join(n, "clip_id").filter("to_i <= m")
    d = p.select("clip_id", F.explode(F.expr("sequence(from_i, to_i)")).alias("i"), "reason", "p_ord")
    return d.groupBy("clip_id", "i").agg(F.min_by("reason", "p_ord").alias("reason"))


table("given_scores", """SELECT clip_id, g * 50 + 10 AS start_i, g * 50 + 15 AS end_i, CAST((clip_id * 7 + g * 13) % 100 AS DOUBLE) / 100 AS score FROM (
  SELECT clip_id, unnest(generate_series(0, (max(i) - 14) // 50)) AS g FROM words GROUP BY clip_id HAVING max(i) >= 14)""")


def given_scores(c):
    g = c.words.groupBy("clip_id").agg(F.max("i").alias("m")).filter("m >= 14").withColumn("g", F.explode(F.expr("sequence(0L, CAST((m - 14) DIV 50 AS BIGINT))")))
    return g.select("clip_id", F.expr("g * 50 + 10").alias("start_i"), F.expr("g * 50 + 15").alias("end_i"),
                    (F.expr("(clip_id * 7 + g * 13) % 100").cast("double") / 100).alias("score"))


PROV = PLAN + """,
dropw AS (SELECT clip_id, i, arg_min(reason, p_ord) AS reason FROM (SELECT clip_id, unnest(generate_series(from_i, to_i)) AS i, reason, p_ord FROM prop_ranges) GROUP BY clip_id, i),
rw AS (SELECT w.clip_id, w.i, w.start_us, w.end_us, s.i IS NOT NULL AS scored, d.reason AS dr FROM words w LEFT JOIN (SELECT * FROM cut_words WHERE reason = 'retake') s ON s.clip_id = w.clip_id AND s.i = w.i LEFT JOIN dropw d ON d.clip_id = w.clip_id AND d.i = w.i WHERE s.i IS NOT NULL OR d.i IS NOT NULL),
prov AS (SELECT x.clip_id, x.start_us, x.end_us, x.reason, x.text,
  CASE WHEN x.reason <> 'retake' THEN 'rule' WHEN a.by_score AND a.by_drop THEN 'scored+proposed' WHEN a.by_drop THEN 'proposed' ELSE 'scored' END AS source, a.why,
  CASE WHEN x.reason = 'retake' THEN (SELECT max(g.score) FROM given_scores g JOIN words f ON f.clip_id = g.clip_id AND f.i = g.start_i JOIN words l ON l.clip_id = g.clip_id AND l.i = g.end_i - 1
     WHERE g.clip_id = x.clip_id AND f.start_us >= x.start_us - 1000000 AND l.end_us <= x.end_us + 1000000) END AS score
  FROM cuts x LEFT JOIN (SELECT c.clip_id, c.start_us, bool_or(scored) AS by_score, bool_or(dr IS NOT NULL) AS by_drop,
     string_agg(DISTINCT dr, '; ') FILTER (dr IS NOT NULL) AS why FROM cuts c JOIN rw ON rw.clip_id = c.clip_id AND rw.start_us < c.end_us AND rw.end_us > c.start_us WHERE c.reason = 'retake' GROUP BY c.clip_id, c.start_us) a ON a.clip_id = x.clip_id AND a.start_us = x.start_us)"""


def provenance(c):
    removed = cut_words(c).filter("reason = 'retake'")
    return P.cut_provenance(_plan(c)[0], c.words, removed, drops(c), given_scores(c))


@query("cut_provenance", "WITH RECURSIVE " + PROV + " SELECT * EXCLUDE (why), why IS NOT NULL AS has_why FROM prov")
def cut_provenance(c):
    return provenance(c).withColumn("has_why", F.col("why").isNotNull()).drop("why")


@query("removed_rollup", "WITH RECURSIVE " + PROV + " SELECT reason, source, CAST(sum(end_us - start_us) AS BIGINT) AS removed_us, count(*) AS n_cuts FROM prov GROUP BY ROLLUP (reason, source)")
def removed_rollup(c):
    return P.removed_rollup(provenance(c))


table("dspans", "SELECT clip_id, from_i AS start_i, to_i + 1 AS end_i FROM proposals")


@query("merged_spans", """SELECT clip_id, min(start_i) AS start_i, max(end_i) AS end_i FROM (SELECT *, sum(nw) OVER (PARTITION BY clip_id ORDER BY start_i, end_i) AS isle FROM (
  SELECT *, CASE WHEN max(end_i) OVER (PARTITION BY clip_id ORDER BY start_i, end_i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= start_i THEN 0 ELSE 1 END AS nw FROM dspans)) GROUP BY clip_id, isle""")
def merged_spans(c):
    s = c.proposals.select("clip_id", F.col("from_i").alias("start_i"), (F.col("to_i") + 1).alias("end_i"))
    return merged(s, "start_i", "end_i", width=4096)


@query("frame_snaps", """SELECT w.clip_id, w.i, (start_us * fps_num * 2 + CAST(1000000 AS BIGINT) * fps_den) // (CAST(2000000 AS BIGINT) * fps_den) AS nearest,
  (start_us * fps_num) // (CAST(1000000 AS BIGINT) * fps_den) AS down, -((-(start_us * fps_num)) // (CAST(1000000 AS BIGINT) * fps_den)) AS up0,
  CAST(ceil(CAST(start_us AS DECIMAL(30,0)) * fps_num / (1000000 * fps_den)) AS BIGINT) AS up FROM words w JOIN clips USING (clip_id)""")
def frame_snaps(c):
    j = c.words.join(c.clips.select("clip_id", "fps_num", "fps_den"), "clip_id")
    return j.select("clip_id", "i", P.snap_frame("start_us").alias("nearest"), P.snap_frame("start_us", "floor").alias("down"),
                    P.snap_frame("start_us", "floor").alias("up0"), P.snap_frame("start_us", "ceil").alias("up"))


# ---- output clock ----------------------------------------------------------------------------------
table("ckeeps", "SELECT *, CAST(coalesce(sum(end_us - start_us) OVER (PARTITION BY clip_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS out_us FROM keeps")


@query("remapped_times", """SELECT w.clip_id, w.i, w.end_us + 50000 AS t_us, CAST(coalesce((SELECT max(k.out_us + least(w.end_us + 50000, k.end_us) - k.start_us) FROM ckeeps k WHERE k.clip_id = w.clip_id AND k.start_us <= w.end_us + 50000), 0) AS BIGINT) AS out_us FROM words w""")
def remapped_times(c):
    return K.remap_time(c.words.select("clip_id", "i", (F.col("end_us") + 50_000).alias("t_us")), c.keeps)


def shifted(c):
    """Words whose stated times drift past the kept ranges."""
    return c.words.select("clip_id", "i", "text", (F.col("start_us") + (F.col("i") % 5) * 40_000).alias("start_us"), (F.col("end_us") + (F.col("i") % 7) * 90_000).alias("end_us"))


table("shifted", "SELECT clip_id, i, text, start_us + (i % 5) * 40000 AS start_us, end_us + (i % 7) * 90000 AS end_us FROM words")
table("bestk", """SELECT * FROM (SELECT w.clip_id, w.i, w.text, w.start_us, w.end_us, k.k, k.start_us AS k_start, k.end_us AS k_end, k.out_us AS k_out, least(w.end_us, k.end_us) - greatest(w.start_us, k.start_us) AS ov
  FROM shifted w JOIN ckeeps k ON k.clip_id = w.clip_id AND k.start_us < w.end_us AND k.end_us > w.start_us QUALIFY row_number() OVER (PARTITION BY w.clip_id, w.i ORDER BY least(w.end_us, k.end_us) - greatest(w.start_us, k.start_us) DESC, k.k) = 1) WHERE ov >= 20000""")


@query("word_ranges", "SELECT clip_id, i, k FROM bestk")
def word_ranges(c):
    return K.best_overlap(shifted(c), c.keeps).select("clip_id", "i", "k")


@query("remapped_words", """SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY i) - 1 AS i, text, k_out + greatest(start_us, k_start) - k_start AS start_us, k_out + least(end_us, k_end) - k_start AS end_us
FROM bestk WHERE (clip_id, i) NOT IN (SELECT (clip_id, i) FROM cut_words)""")
def remapped_words(c):
    return K.remap_words(shifted(c), c.keeps, cut_words(c))


@query("centre_remapped_words", """SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY i) - 1 AS i, text, k_out + greatest(start_us, k_start) - k_start AS start_us, k_out + least(end_us, k_end) - k_start AS end_us
FROM (SELECT w.*, k.start_us AS k_start, k.end_us AS k_end, k.out_us AS k_out FROM shifted w JOIN ckeeps k ON k.clip_id = w.clip_id AND w.start_us + w.end_us BETWEEN 2 * k.start_us AND 2 * k.end_us QUALIFY row_number() OVER (PARTITION BY w.clip_id, w.i ORDER BY k.k) = 1)""")
def centre_remapped_words(c):
    return K.remap_words(shifted(c), c.keeps)


table("visible", """SELECT clip_id, out_us + end_us - start_us AS at_us, row_number() OVER (PARTITION BY clip_id ORDER BY k) AS rn FROM (SELECT *, lead(start_us) OVER (PARTITION BY clip_id ORDER BY k) AS ns FROM ckeeps) WHERE ns - end_us >= 200000""")
CUTPTS = """
cp AS (SELECT clip_id, rn, at_us AS last, true AS keep FROM visible WHERE rn = 1 UNION ALL
  SELECT v.clip_id, v.rn, CASE WHEN v.at_us - c.last >= 1500000 THEN v.at_us ELSE c.last END, v.at_us - c.last >= 1500000 FROM cp c JOIN visible v ON v.clip_id = c.clip_id AND v.rn = c.rn + 1),
cutpts AS (SELECT clip_id, last AS at_us FROM cp WHERE keep)"""


@query("cut_points", "WITH RECURSIVE " + CUTPTS + " SELECT * FROM cutpts")
def cut_points(c):
    return K.cut_points(c.keeps)


def ticks(c):
    """Times every 0.7 s over each clip and a little past its last word."""
    return c.clips.select("clip_id", F.explode(F.expr("sequence(0L, duration_us, 700000L)")).alias("t_us"))


table("ticks", "SELECT clip_id, unnest(generate_series(0, duration_us, 700000)) AS t_us FROM clips")


@query("active_units", """SELECT t.clip_id, t.t_us, coalesce((SELECT max(u.unit) FROM units u WHERE u.clip_id = t.clip_id AND t.t_us >= u.start_us AND t.t_us < u.end_us), (SELECT max(unit) FROM units u WHERE u.clip_id = t.clip_id)) AS unit FROM ticks t""")
def active_units(c):
    return K.active_at(ticks(c), c.units)


@query("active_captions", """SELECT t.clip_id, t.t_us, max(CASE WHEN t.t_us <= c.end_us + 600000 THEN c.first_i END) AS chunk FROM ticks t LEFT JOIN (SELECT *, coalesce(lead(start_us) OVER (PARTITION BY clip_id ORDER BY start_us), 1000000000000000) AS nx FROM chunks) c
  ON c.clip_id = t.clip_id AND t.t_us >= c.start_us AND t.t_us < c.nx GROUP BY t.clip_id, t.t_us""")
def active_captions(c):
    return K.chunk_at(ticks(c), S.caption_chunks(c.words))


table("style_secs", """SELECT clip_id, unit // 4 AS sec, min(start_us) AS start_us, max(end_us) AS end_us, CASE (clip_id + unit // 4) % 3 WHEN 0 THEN 'anton_karaoke' WHEN 1 THEN 'archivo_chip' ELSE 'inter_editorial' END AS style FROM units GROUP BY clip_id, unit // 4""")


def style_sections(c):
    s = c.units.groupBy("clip_id", F.expr("unit DIV 4").alias("sec")).agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))
    return s.withColumn("style", F.expr("CASE (clip_id + sec) % 3 WHEN 0 THEN 'anton_karaoke' WHEN 1 THEN 'archivo_chip' ELSE 'inter_editorial' END"))


@query("words_per_caption_style", """SELECT DISTINCT w.clip_id, s.style, w.i, trim(w.text) AS text, w.start_us, w.end_us FROM words w JOIN style_secs s ON s.clip_id = w.clip_id AND w.start_us >= s.start_us AND w.start_us < s.end_us WHERE trim(w.text) <> ''""")
def words_per_caption_style(c):
    return K.words_in_sections(c.words, style_sections(c))
