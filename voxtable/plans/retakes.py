"""Queries on abandoned takes."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.stage import stage
from ..operators import repeats as R
from .corpus import Corpus
from .oracle_tables import TABLES, sql_list as L, table
from .registry import query


def _lazy(name, build):
    """A corpus table written on first use."""
    def get(c):
        known = c.__dict__.setdefault("_lazy", {})
        if name not in known:
            known[name] = stage(build(c), name)
        return known[name]
    return get


marked = _lazy("marked_words", lambda c: R.marked(c.words))
nearest = _lazy("nearest_repeats", lambda c: R.nearest_repeats(R.aligned_repeats(stage(R.marked(c.words, texts=False), "marked"))))
candidates = _lazy("candidates", lambda c: R.find_retakes(c.words))
chained = _lazy("chained", lambda c: R.chain_candidates(candidates(c)))

table("mw", f"""SELECT clip_id, CAST(i AS BIGINT) AS i, text, start_us, end_us, nm AS n, sent_end AS stop,
  lag(nm) OVER w AS pn, i = 0 OR lag(sent_end) OVER w OR lag(comma_end) OVER w AS opens,
  i = 0 OR lag(sent_end) OVER w OR lag(comma_end) OVER w OR start_us - lag(end_us) OVER w >= 200000 AS at_boundary,
  i > 0 AND lag(sent_end) OVER w AS stop_before, coalesce(start_us - lag(end_us) OVER w >= 250000, false) AS gap_before,
  length(nm) >= 3 AND nm NOT IN {L(fixed.STOP_RETAKE)} AS content
  FROM nwords WINDOW w AS (PARTITION BY clip_id ORDER BY i)""")
WALK = """
walk AS (
  SELECT a.clip_id, a.i AS i0, b.i AS j0, a.i AS i, b.i AS j, 0 AS matched, 0 AS err, false AS done
  FROM mw a JOIN mw b ON a.clip_id = b.clip_id AND a.n = b.n AND b.i - a.i BETWEEN 3 AND 60 AND b.start_us - a.start_us <= 30000000
  WHERE a.n <> '' AND (a.opens OR NOT coalesce(a.pn = b.pn AND a.pn <> '', false))
  UNION ALL
  SELECT w.clip_id, i0, j0,
    CASE WHEN a.n = b.n AND a.n <> '' THEN w.i + 1 WHEN err >= 1 THEN w.i WHEN a1.n = b1.n AND a1.n <> '' THEN w.i + 1 WHEN a1.n = b.n THEN w.i + 1 ELSE w.i END,
    CASE WHEN a.n = b.n AND a.n <> '' THEN w.j + 1 WHEN err >= 1 THEN w.j WHEN a1.n = b1.n AND a1.n <> '' THEN w.j + 1 WHEN a1.n = b.n THEN w.j WHEN a.n = b1.n THEN w.j + 1 ELSE w.j END,
    CASE WHEN a.n = b.n AND a.n <> '' THEN matched + 1 ELSE matched END,
    CASE WHEN a.n = b.n AND a.n <> '' THEN err ELSE err + 1 END,
    NOT coalesce((a.n = b.n AND a.n <> '') OR (err = 0 AND ((a1.n = b1.n AND a1.n <> '') OR a1.n = b.n OR a.n = b1.n)), false)
  FROM walk w JOIN mw a ON a.clip_id = w.clip_id AND a.i = w.i JOIN mw b ON b.clip_id = w.clip_id AND b.i = w.j
    LEFT JOIN mw a1 ON a1.clip_id = w.clip_id AND a1.i = w.i + 1 LEFT JOIN mw b1 ON b1.clip_id = w.clip_id AND b1.i = w.j + 1
  WHERE NOT done),
fin AS (SELECT clip_id, i0, j0, max(i) - i0 AS len_i, max(matched) AS matched FROM walk GROUP BY clip_id, i0, j0),
qual AS (SELECT f.*, (SELECT coalesce(max(CASE WHEN x.stop_before THEN x.i END), max(CASE WHEN x.gap_before THEN x.i END), f.j0)
     FROM mw x WHERE x.clip_id = f.clip_id AND x.i > f.i0 + f.len_i - 1 AND x.i <= f.j0) AS end_i
  FROM fin f WHERE matched >= 3 AND (matched >= 4 OR EXISTS (SELECT 1 FROM mw x WHERE x.clip_id = f.clip_id AND x.i BETWEEN f.i0 AND f.i0 + f.len_i - 1 AND x.content))),
near AS (SELECT q.clip_id, q.i0 AS start_i, q.end_i, q.j0 - q.i0 AS d, q.matched, q.len_i, a.opens AND coalesce(a.pn = b.pn AND a.pn <> '', false) AS "inner"
  FROM (SELECT *, row_number() OVER (PARTITION BY clip_id, i0 ORDER BY j0) AS rn FROM qual) q
  JOIN mw a ON a.clip_id = q.clip_id AND a.i = q.i0 JOIN mw b ON b.clip_id = q.clip_id AND b.i = q.j0 WHERE rn = 1)"""
DEDUP = WALK + """,
raw AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY start_i) AS rn FROM near),
fold AS (
  SELECT clip_id, rn, [{'s': start_i, 'e': start_i + len_i, 'd': d}] AS kept, true AS keep FROM raw WHERE rn = 1
  UNION ALL
  SELECT r.clip_id, r.rn, CASE WHEN k THEN list_append(list_filter(kept, lambda x: x.e > r.start_i), {'s': r.start_i, 'e': r.start_i + r.len_i, 'd': r.d}) ELSE list_filter(kept, lambda x: x.e > r.start_i) END, k
  FROM (SELECT f.kept, r.*, r."inner" OR len(list_filter(f.kept, lambda x: r.start_i < x.e AND abs(r.d - x.d) <= 2)) = 0 AS k
        FROM fold f JOIN raw r ON r.clip_id = f.clip_id AND r.rn = f.rn + 1) r),
grams AS (SELECT r.clip_id, r.start_i, r.end_i, CAST(r.matched AS BIGINT) AS strength, 'ngram' AS kind FROM raw r JOIN fold f USING (clip_id, rn) WHERE f.keep)"""
table("rsents", """SELECT clip_id, s_ord, min(i) AS first_i, max(i) AS last_i, arg_min(n, i) AS head, list(n ORDER BY i)[2] AS second,
  coalesce(list(DISTINCT n) FILTER (WHERE content), CAST([] AS VARCHAR[])) AS content
  FROM (SELECT *, sum(CASE WHEN stop_before THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY i) AS s_ord FROM mw) GROUP BY clip_id, s_ord""")
table("sentcand", """SELECT clip_id, start_i, end_i, CAST(shared + CASE WHEN two THEN 2 ELSE 1 END AS BIGINT) AS strength, 'sentence' AS kind FROM (
  SELECT a.clip_id, a.first_i AS start_i, b.first_i AS end_i, len(list_intersect(a.content, b.content)) AS shared, least(len(a.content), len(b.content)) AS small,
    coalesce(a.last_i > a.first_i AND b.last_i > b.first_i AND a.second = b.second, false) AS two
  FROM rsents a JOIN rsents b ON a.clip_id = b.clip_id AND b.s_ord = a.s_ord + 1 WHERE a.head <> '' AND a.head = b.head)
  WHERE small > 0 AND shared * 2 >= small AND (two OR small >= 2)""")
table("sthits", """SELECT clip_id, i, CASE WHEN h4 THEN 4 WHEN h3 THEN 3 WHEN h2 THEN 2 END AS len FROM (
  SELECT clip_id, i,
    n <> '' AND n1 <> '' AND n2 <> '' AND n3 <> '' AND n = n4 AND n1 = n5 AND n2 = n6 AND n3 = n7 AND NOT (s0 OR s1 OR s2) AS h4,
    n <> '' AND n1 <> '' AND n2 <> '' AND n = n3 AND n1 = n4 AND n2 = n5 AND NOT (s0 OR s1) AS h3,
    n <> '' AND n1 <> '' AND n = n2 AND n1 = n3 AND NOT s0 AND (c0 OR c1) AS h2
  FROM (SELECT clip_id, i, n, stop AS s0, lead(stop) OVER w AS s1, lead(stop, 2) OVER w AS s2, content AS c0, lead(content) OVER w AS c1,
    lead(n) OVER w AS n1, lead(n, 2) OVER w AS n2, lead(n, 3) OVER w AS n3, lead(n, 4) OVER w AS n4, lead(n, 5) OVER w AS n5, lead(n, 6) OVER w AS n6, lead(n, 7) OVER w AS n7
    FROM mw WINDOW w AS (PARTITION BY clip_id ORDER BY i))) WHERE h4 OR h3 OR h2""")
STUT = """
sh AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY i) AS rn FROM sthits),
stf AS (SELECT clip_id, rn, i + len AS nxt, true AS keep FROM sh WHERE rn = 1
  UNION ALL SELECT h.clip_id, h.rn, CASE WHEN h.i >= f.nxt THEN h.i + h.len ELSE f.nxt END, h.i >= f.nxt FROM stf f JOIN sh h ON h.clip_id = f.clip_id AND h.rn = f.rn + 1),
stut AS (SELECT h.clip_id, h.i AS start_i, h.i + h.len AS end_i, CAST(h.len AS BIGINT) AS strength, 'stutter' AS kind FROM sh h JOIN stf f USING (clip_id, rn) WHERE f.keep)"""
CANDS = DEDUP + "," + STUT + """,
uni AS (SELECT clip_id, start_i, end_i, max(strength) AS strength, arg_min(kind, o) AS kind FROM (SELECT *, 0 AS o FROM grams UNION ALL SELECT *, 1 FROM sentcand) GROUP BY clip_id, start_i, end_i),
st0 AS (SELECT u.* FROM uni u JOIN mw m ON m.clip_id = u.clip_id AND m.i = u.start_i WHERE m.at_boundary),
pruned AS (SELECT * FROM st0 c WHERE (SELECT count(*) FROM st0 o WHERE o.clip_id = c.clip_id AND o.start_i >= c.start_i AND o.end_i <= c.end_i AND (o.start_i, o.end_i) <> (c.start_i, c.end_i)) < 2),
cands AS (SELECT clip_id, start_i, end_i, strength, kind FROM pruned UNION ALL SELECT * FROM stut s WHERE NOT EXISTS (SELECT 1 FROM pruned p WHERE p.clip_id = s.clip_id AND p.start_i = s.start_i AND p.end_i = s.end_i))"""
CHAIN = CANDS + """,
ch0 AS (SELECT *, CASE WHEN max(end_i) OVER (PARTITION BY clip_id ORDER BY start_i, end_i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= start_i THEN 0 ELSE 1 END AS nw FROM cands),
ch1 AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY clip_id ORDER BY start_i, end_i) AS BIGINT) AS chain FROM ch0),
ch AS (SELECT *, min(start_i) OVER c AS chain_start, max(end_i) OVER c AS chain_end, max(strength) OVER c AS chain_strength,
  first_value(kind) OVER (PARTITION BY clip_id, chain ORDER BY start_i, end_i) AS chain_kind, count(*) OVER c AS n_members
  FROM ch1 WINDOW c AS (PARTITION BY clip_id, chain))"""
SCORE = "CAST((clip_id * 7 + start_i * 3 + end_i) % 100 AS DOUBLE) / 100"


@query("repeat_starts", "WITH RECURSIVE " + WALK + " SELECT * FROM near")
def repeat_starts(c):
    """Nearest aligned repeat for every start."""
    return nearest(c).select("clip_id", F.col("start_i").cast("bigint").alias("start_i"), F.col("end_i").cast("bigint").alias("end_i"),
                             F.col("d").cast("bigint").alias("d"), F.col("matched").cast("bigint").alias("matched"),
                             F.col("len_i").cast("bigint").alias("len_i"), "inner")


@query("repeat_candidates", "WITH RECURSIVE " + DEDUP + " SELECT * FROM grams")
def repeat_candidates(c):
    return R.dedupe_diagonals(nearest(c))


@query("sentence_retakes", "SELECT * FROM sentcand")
def sentence_retakes(c):
    return R.sentence_retakes(c.words)


def doubled(c):
    """The transcript with a two-, three- or four-word phrase said twice in every fifty words."""
    from ..functions.seq import numbered
    n = F.expr("2 + (i DIV 50) % 3")
    w = c.words.select("clip_id", "text", "start_us", "end_us", F.col("i").cast("bigint").alias("i"))
    again = w.filter((F.col("i") % 50 >= 20) & (F.col("i") % 50 < 20 + n))
    both = w.withColumn("o", F.col("i") * 2).unionByName(again.withColumn("o", (F.col("i") - F.col("i") % 50 + 19 + n) * 2 + 1))
    return numbered(both.withColumnRenamed("i", "was"), "o", "i", order=["o", "was"]).drop("o", "was")


STUT2 = STUT.replace("sthits", "sthits2")
table("dw", """SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY o, i) - 1 AS i, nm AS n, sent_end AS stop, length(nm) >= 3 AND nm NOT IN """ + L(fixed.STOP_RETAKE) + """ AS content FROM (
  SELECT *, i * 2 AS o FROM nwords UNION ALL SELECT *, (i - i % 50 + 19 + 2 + (i // 50) % 3) * 2 + 1 FROM nwords WHERE i % 50 >= 20 AND i % 50 < 22 + (i // 50) % 3)""")
table("sthits2", TABLES["sthits"].replace("FROM mw WINDOW", "FROM dw WINDOW"))


@query("stutters", "WITH RECURSIVE " + STUT2 + " SELECT * FROM stut")
def stutters(c):
    return R.stutters(doubled(c))


@query("retake_candidates", "WITH RECURSIVE " + CANDS + " SELECT * FROM cands")
def retake_candidates(c):
    return candidates(c)


@query("retake_chains", "WITH RECURSIVE " + CHAIN + " SELECT clip_id, chain, start_i, end_i, strength, kind, chain_start, chain_end, chain_strength, chain_kind, n_members FROM ch")
def retake_chains(c):
    return chained(c)


@query("retake_requests", "WITH RECURSIVE " + CHAIN + """
, q AS (SELECT DISTINCT clip_id, chain, chain_start AS start_i, chain_end AS end_i, 0 AS link FROM ch WHERE n_members > 1
  UNION ALL SELECT clip_id, chain, start_i, end_i, 1 FROM ch),
r AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY chain, link, start_i, end_i) - 1 AS q_ord FROM q)
SELECT *, q_ord // 64 AS batch_id FROM r""")
def retake_requests(c):
    return R.questions(chained(c))


@query("retake_context", "WITH RECURSIVE " + CANDS + """
, b AS (SELECT c.clip_id, c.start_i, c.end_i,
  greatest(c.start_i - 40, coalesce((SELECT max(x.i) FROM mw x WHERE x.clip_id = c.clip_id AND x.stop_before AND x.i <= c.start_i), 0)) AS s,
  least(c.end_i + 40, coalesce((SELECT min(x.i) + 1 FROM mw x WHERE x.clip_id = c.clip_id AND x.stop AND x.i >= c.end_i), c.end_i + 40)) AS e FROM cands c)
SELECT b.clip_id, b.start_i, b.end_i,
  coalesce(string_agg(m.text, ' ' ORDER BY m.i) FILTER (m.i >= b.start_i - 24 AND m.i < b.start_i), '') AS before,
  coalesce(string_agg(m.text, ' ' ORDER BY m.i) FILTER (m.i >= b.start_i AND m.i < b.end_i), '') AS removed,
  coalesce(string_agg(m.text, ' ' ORDER BY m.i) FILTER (m.i >= b.end_i AND m.i < b.end_i + 24), '') AS after,
  coalesce(string_agg(m.text, ' ' ORDER BY m.i) FILTER ((m.i >= b.s AND m.i < b.start_i) OR (m.i >= b.end_i AND m.i < b.e)), '') AS result
FROM b JOIN mw m ON m.clip_id = b.clip_id AND m.i BETWEEN b.start_i - 40 AND b.end_i + 40 GROUP BY b.clip_id, b.start_i, b.end_i""")
def retake_context(c):
    return R.candidate_context(candidates(c), marked(c))


def scores(c):
    """Scores from the given rule; every seventh clip has no complete answer."""
    from pyspark.sql import DataFrame  # noqa: F401
    return R.questions(chained(c)).withColumn("score", F.when(F.col("clip_id") % 7 != 0, F.expr(SCORE))) \
        .select("clip_id", "start_i", "end_i", "link", "score")


ACCEPT = CHAIN + f""",
acc0 AS (SELECT *, clip_id % 7 <> 0 AS scored, {SCORE} AS score, CAST((clip_id * 7 + chain_start * 3 + chain_end) % 100 AS DOUBLE) / 100 AS whole FROM ch),
acc1 AS (SELECT *, scored AND n_members > 1 AND whole >= 0.4 AS aw FROM acc0),
accepted AS (SELECT DISTINCT clip_id, CASE WHEN aw THEN chain_start ELSE start_i END AS start_i, CASE WHEN aw THEN chain_end ELSE end_i END AS end_i,
  CASE WHEN scored THEN CASE WHEN aw THEN whole ELSE score END END AS score, CASE WHEN scored THEN 'scored' ELSE 'fallback' END AS mode
  FROM acc1 WHERE CASE WHEN scored THEN aw OR score >= 0.5 ELSE strength >= 5 OR (kind = 'stutter' AND strength >= 3) END)"""

accepted = _lazy("accepted", lambda c: R.accept_retakes(chained(c), scores(c)))


@query("accepted_retakes", "WITH RECURSIVE " + ACCEPT + " SELECT * FROM accepted")
def accepted_retakes(c):
    return accepted(c)


@query("outer_retakes", "WITH RECURSIVE " + ACCEPT + """ SELECT * FROM accepted a WHERE NOT EXISTS (SELECT 1 FROM accepted o WHERE o.clip_id = a.clip_id
  AND o.start_i <= a.start_i AND o.end_i >= a.end_i AND (o.start_i < a.start_i OR o.end_i > a.end_i))""")
def outer_retakes(c):
    return R.drop_contained(accepted(c))


@query("filler_words", "WITH RECURSIVE " + ACCEPT + f"""
SELECT clip_id, i FROM (SELECT *, lag(end_us) OVER w AS pe, lead(start_us) OVER w AS ns FROM mw WINDOW w AS (PARTITION BY clip_id ORDER BY i)) m
WHERE n IN {L(fixed.FILLER_SPOKEN)} AND coalesce(start_us - pe >= 30000, true) AND coalesce(ns - end_us >= 30000, true)
  AND NOT EXISTS (SELECT 1 FROM accepted a WHERE a.clip_id = m.clip_id AND m.i >= a.start_i AND m.i < a.end_i)""")
def filler_words(c):
    return R.filler_words(c.words, R.removed_words(accepted(c)))


@query("scored_by_user_function", "WITH RECURSIVE " + ACCEPT + " SELECT * FROM accepted")
def scored_by_user_function(c):
    """A user scorer over the request batches, with a clip that fails."""
    def fn(pdf):
        if int(pdf["clip_id"].iloc[0]) % 7 == 0:
            raise RuntimeError("no answer")
        return (pdf["clip_id"] * 7 + pdf["start_i"] * 3 + pdf["end_i"]) % 100 / 100
    s = stage(R.score_batches(R.questions(chained(c)), fn), "user_scores")
    return R.accept_retakes(chained(c), s)
