"""Queries on levels: thresholds, silences, voiced runs, word edges and word times."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import levels as LV
from .oracle_tables import table
from .registry import query
from .retakes import _lazy

table("thresholds", """SELECT clip_id, floor_db, speech_db, thr AS threshold_db, least(-48.0, thr + 10) AS edge_db FROM (
  SELECT *, least(-30.0, greatest(-60.0, floor_db + 0.25 * (speech_db - floor_db))) AS thr FROM (
    SELECT clip_id, min(db) FILTER (rn = least(CAST(floor(n * 0.1) AS BIGINT), n - 1)) AS floor_db, min(db) FILTER (rn = least(CAST(floor(n * 0.9) AS BIGINT), n - 1)) AS speech_db
    FROM (SELECT clip_id, db, row_number() OVER (PARTITION BY clip_id ORDER BY db) - 1 AS rn, count(*) OVER (PARTITION BY clip_id) AS n FROM levels) GROUP BY clip_id))""")


@query("silence_thresholds", "SELECT clip_id, CAST(floor_db AS DOUBLE) AS floor_db, CAST(speech_db AS DOUBLE) AS speech_db, CAST(threshold_db AS DOUBLE) AS threshold_db, CAST(edge_db AS DOUBLE) AS edge_db FROM thresholds")
def silence_thresholds(c):
    return LV.silence_threshold(c.level_blocks, c.clips)


@query("silences", "SELECT * FROM silences")
def silences(c):
    return LV.silences(c.level_blocks, F.lit(-55.0))


@query("adaptive_silences", """SELECT clip_id, CAST(min(frame) AS BIGINT) * 10000 AS start_us, (CAST(max(frame) AS BIGINT) + 1) * 10000 AS end_us
  FROM (SELECT clip_id, frame, frame - row_number() OVER (PARTITION BY clip_id ORDER BY frame) AS g FROM levels JOIN thresholds USING (clip_id) WHERE db < edge_db)
  GROUP BY clip_id, g HAVING count(*) >= 10""")
def adaptive_silences(c):
    return LV.clip_silences(c.level_blocks, LV.silence_threshold(c.level_blocks, c.clips), "edge_db")


@query("voiced_runs", """SELECT clip_id, i, CAST(min(frame) AS BIGINT) * 10000 AS run_start_us, (CAST(max(frame) AS BIGINT) + 1) * 10000 AS run_end_us FROM (
  SELECT l.clip_id, w.i, l.frame, l.frame - row_number() OVER (PARTITION BY l.clip_id, w.i ORDER BY l.frame) AS g
  FROM words w JOIN levels l ON l.clip_id = w.clip_id AND l.frame >= w.start_us // 10000 AND l.frame < (w.next_us + 9999) // 10000 WHERE l.db >= -45)
  GROUP BY clip_id, i, g HAVING count(*) >= 3""")
def voiced_runs(c):
    r = c.words.select("clip_id", "i", "start_us", "next_us")
    return LV.voiced_runs(LV.loud_runs(c.level_blocks, -45.0), r, "start_us", "next_us").select("clip_id", "i", "run_start_us", "run_end_us")


cores = _lazy("cores", lambda c: LV.word_cores(c.level_blocks, c.words, c.clips))
edges = _lazy("edges", lambda c: LV.word_edges(c.level_blocks, cores(c)))
long_edges = _lazy("long_edges", lambda c: LV.extend_edges(edges(c), c.level_blocks))

table("wcells", """SELECT clip_id, i, start_us, end_us, lo AS cell_lo, greatest(lo + 1, hi) AS cell_hi, (start_us + end_us + 10000) // 20000 AS mid_frame FROM (
  SELECT clip_id, CAST(i AS BIGINT) AS i, start_us, end_us,
    (greatest(start_us * 4, coalesce(lag(start_us) OVER w + lag(end_us) OVER w + start_us + end_us, 0)) + 20000) // 40000 AS lo,
    (least(end_us * 4, coalesce(lead(start_us) OVER w + lead(end_us) OVER w + start_us + end_us, end_us * 4)) + 20000) // 40000 AS hi
  FROM words WINDOW w AS (PARTITION BY clip_id ORDER BY i))""")
table("wtops", """SELECT c.*, coalesce(t.top, c.cell_lo) AS top, CAST(row_number() OVER (PARTITION BY c.clip_id ORDER BY c.i) AS BIGINT) AS rn, n.n_frames, least(n.n_frames, n.dur_frame) AS end_frame
  FROM wcells c LEFT JOIN (SELECT c.clip_id, c.i, arg_max(CAST(l.frame AS BIGINT), (l.db, -l.frame)) AS top FROM wcells c JOIN levels l ON l.clip_id = c.clip_id AND l.frame >= c.cell_lo AND l.frame < c.cell_hi GROUP BY c.clip_id, c.i) t USING (clip_id, i)
  JOIN (SELECT clip_id, max(n_frames) AS n_frames, max((duration_us + 5000) // 10000) AS dur_frame FROM clips JOIN (SELECT clip_id, max(frame) + 1 AS n_frames FROM levels GROUP BY clip_id) USING (clip_id) GROUP BY clip_id) n USING (clip_id)""")
# cores rise on this corpus except where cells collapse; the fix-up is written as a recursion
CORES = """
rise AS (SELECT clip_id, rn, top AS peak FROM wtops WHERE rn = 1
  UNION ALL SELECT t.clip_id, t.rn, CASE WHEN t.top <= r.peak THEN least(greatest(r.peak + 1, t.mid_frame), greatest(t.end_frame - 1, 0)) ELSE t.top END FROM rise r JOIN wtops t ON t.clip_id = r.clip_id AND t.rn = r.rn + 1),
cores AS (SELECT t.clip_id, t.i, t.start_us, t.end_us, r.peak, coalesce(l.db, -55.0) AS peak_db, CAST(t.n_frames AS BIGINT) AS n_frames, CAST(t.end_frame AS BIGINT) AS end_frame
  FROM wtops t JOIN rise r USING (clip_id, rn) LEFT JOIN levels l ON l.clip_id = t.clip_id AND l.frame = r.peak)"""


@query("word_cores", "WITH RECURSIVE " + CORES + " SELECT * FROM cores")
def word_cores(c):
    return cores(c)


EDGES = CORES + """,
quiet7 AS (SELECT clip_id, CAST(frame AS BIGINT) AS frame, db, max(db) OVER (PARTITION BY clip_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS nm FROM levels),
ct AS (SELECT *, least(-45.0, greatest(-55.0, peak_db - 30)) AS on_thr, least(-40.0, greatest(-52.0, peak_db - 22)) AS off_thr,
  lag(peak) OVER w AS pp, lead(peak) OVER w AS np FROM cores WINDOW w AS (PARTITION BY clip_id ORDER BY i)),
offs AS (SELECT c.clip_id, c.i, min(q.frame) FILTER (q.frame > c.peak AND q.frame + 6 <= coalesce(np, end_frame) - 1 AND q.nm < off_thr) AS f,
    arg_min(q.frame, (q.db, q.frame)) AS valley, max(q.frame) FILTER (q.frame > c.peak AND q.frame < end_frame AND q.db >= off_thr) AS loud
  FROM ct c JOIN quiet7 q ON q.clip_id = c.clip_id AND q.frame BETWEEN c.peak AND coalesce(c.np, c.end_frame) GROUP BY c.clip_id, c.i),
ons AS (SELECT c.clip_id, c.i, max(q.frame) FILTER (q.frame + 6 <= c.peak - 1 AND q.nm < on_thr) + 7 AS f,
    arg_min(q.frame, (q.db, q.frame)) AS valley, min(q.frame) FILTER (q.frame < c.peak AND q.db >= on_thr) AS loud
  FROM ct c JOIN quiet7 q ON q.clip_id = c.clip_id AND q.frame BETWEEN coalesce(c.pp, 0) AND c.peak GROUP BY c.clip_id, c.i),
edges AS (SELECT c.clip_id, c.i, c.start_us, c.end_us, c.peak, c.peak_db, c.end_frame,
  CAST(CASE WHEN n.f IS NOT NULL THEN n.f WHEN c.pp IS NOT NULL THEN n.valley WHEN c.peak > 0 AND coalesce(n.loud, c.peak) > 0 THEN coalesce(n.loud, c.peak) ELSE 0 END AS BIGINT) AS onset,
  n.f IS NOT NULL OR (c.pp IS NULL AND c.peak > 0 AND coalesce(n.loud, c.peak) > 0) AS onset_quiet,
  CAST(CASE WHEN o.f IS NOT NULL THEN o.f WHEN c.np IS NOT NULL THEN o.valley
    WHEN end_frame >= n_frames AND end_frame - 1 > c.peak AND coalesce(o.loud, c.peak) < end_frame - 1 THEN coalesce(o.loud, c.peak) + 1 ELSE end_frame END AS BIGINT) AS "offset",
  o.f IS NOT NULL OR (c.np IS NULL AND end_frame >= n_frames AND end_frame - 1 > c.peak AND coalesce(o.loud, c.peak) < end_frame - 1) AS offset_quiet
  FROM ct c LEFT JOIN offs o USING (clip_id, i) LEFT JOIN ons n USING (clip_id, i))"""


@query("word_edges", "WITH RECURSIVE " + EDGES + " SELECT * FROM edges")
def word_edges(c):
    return edges(c)


@query("extended_edges")
def extended_edges(c):
    return long_edges(c)


@query("snapped_words", "WITH RECURSIVE " + EDGES + """,
eo AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY i) AS rn, onset * 10000 AS o1, "offset" * 10000 AS o2 FROM edges),
sn AS (SELECT clip_id, rn, greatest(o1, 0) AS s, greatest(o2, greatest(o1, 0) + 40000) AS e FROM eo WHERE rn = 1
  UNION ALL SELECT x.clip_id, x.rn, greatest(x.o1, p.e), greatest(x.o2, greatest(x.o1, p.e) + 40000) FROM sn p JOIN eo x ON x.clip_id = p.clip_id AND x.rn = p.rn + 1)
SELECT clip_id, i, CAST(s AS BIGINT) AS start_us, CAST(e AS BIGINT) AS end_us FROM eo JOIN sn USING (clip_id, rn)""")
def snapped_words(c):
    return LV.snap_words(edges(c))


@query("refined_words", """
WITH RECURSIVE wq AS (SELECT w.clip_id, CAST(w.i AS BIGINT) AS i, w.start_us AS s0, w.end_us AS e0, q.start_us AS q0, q.end_us AS q1,
  row_number() OVER (PARTITION BY w.clip_id, w.i ORDER BY q.start_us) AS rn FROM words w LEFT JOIN silences q ON q.clip_id = w.clip_id AND q.start_us < w.end_us AND q.end_us > w.start_us),
st AS (SELECT clip_id, i, CAST(0 AS BIGINT) AS rn, s0, e0, s0 AS s, e0 AS e FROM wq WHERE rn = 1
  UNION ALL
  SELECT q.clip_id, q.i, q.rn, q.s0, q.e0,
   CASE WHEN q.q0 <= q.s0 + 20000 AND q.q1 >= q.e0 - 20000 AND q.q1 - q.s0 <= 600000 THEN q.q1 WHEN q.q0 <= q.s0 + 20000 AND q.q1 < q.e0 - 40000 AND q.q1 > t.s THEN q.q1 ELSE t.s END,
   CASE WHEN q.q0 <= q.s0 + 20000 AND q.q1 >= q.e0 - 20000 AND q.q1 - q.s0 <= 600000 THEN q.q1 + greatest(q.e0 - q.s0, 40000) WHEN q.q1 >= q.e0 - 20000 AND q.q0 > q.s0 + 40000 AND q.q0 < t.e THEN q.q0 ELSE t.e END
  FROM st t JOIN wq q ON q.clip_id = t.clip_id AND q.i = t.i AND q.rn = t.rn + 1 WHERE q.q0 IS NOT NULL),
ls AS (SELECT clip_id, i, CASE WHEN e - s < 40000 AND s = s0 THEN s0 ELSE s END AS s, CASE WHEN e - s < 40000 AND s = s0 THEN e0 ELSE e END AS e
  FROM st QUALIFY row_number() OVER (PARTITION BY clip_id, i ORDER BY rn DESC) = 1),
lo AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY i) AS rn FROM ls),
px AS (SELECT clip_id, rn, s, e FROM lo WHERE rn = 1
  UNION ALL SELECT x.clip_id, x.rn, greatest(x.s, p.e), CASE WHEN x.s < p.e THEN greatest(x.e, p.e + 40000) ELSE x.e END FROM px p JOIN lo x ON x.clip_id = p.clip_id AND x.rn = p.rn + 1)
SELECT lo.clip_id, lo.i, px.s AS start_us, px.e AS end_us FROM lo JOIN px USING (clip_id, rn)""")
def refined_words(c):
    return LV.refine_words(c.words, c.silences)
