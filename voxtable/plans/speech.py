"""Queries on words: forms, segments, repeats and transcript checks."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import alignment as A, segments as S, verify as V
from .oracle_tables import sql_list as L, table
from .registry import query

STRIP = "'^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$'"
APOS = "regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}'']', '', 'g')"


def apos(c):
    return APOS.format(c=c)


@query("word_forms", f"""
SELECT n.clip_id, n.i, n.nm AS norm_match, n.n AS norm_heard, v.t AS norm_surface, {apos('n.text')} AS norm_apos,
  regexp_replace(lower(n.text), '[^a-z0-9.%]', '', 'g') AS norm_value, n.sent_end AS ends_strict,
  regexp_matches(n.text, '[.!?]["'')\\]]*$') AS ends_loose,
  length(n.nm) >= 3 AND n.nm NOT IN {L(fixed.STOP_RETAKE)} AS content_retake,
  length(n.nm) >= 1 AND n.nm NOT IN {L(fixed.STOP_TAKES)} AS content_takes, v.content AS content_verify
FROM nwords n JOIN vwords v USING (clip_id, i)""")
def word_forms(c):
    n, s = text.norm_match("text"), text.norm_surface("text")
    return c.words.select(
        "clip_id", "i", n.alias("norm_match"), text.norm_match("text", False).alias("norm_heard"), s.alias("norm_surface"),
        text.norm_apos("text").alias("norm_apos"), text.norm_value("text").alias("norm_value"),
        text.ends_sentence("text").alias("ends_strict"), text.ends_sentence("text", strict=False).alias("ends_loose"),
        text.is_content(n, "retake").alias("content_retake"), text.is_content(n, "takes").alias("content_takes"),
        text.is_content(s, "verify").alias("content_verify"))


@query("filler_token_counts", f"""
SELECT clip_id, nm AS token, count(*) AS n FROM nwords WHERE nm IN {L(fixed.FILLER_SPOKEN)} GROUP BY ALL""")
def filler_token_counts(c):
    n = text.norm_match("text")
    return c.words.filter(n.isin(fixed.FILLER_SPOKEN)).groupBy("clip_id", n.alias("token")).agg(F.count("*").alias("n"))


table("vsents", "SELECT clip_id, s_ord, first_i, last_i, start_us, end_us, text, array_to_string(content, ' ') AS content FROM sents")


@query("sentence_segments", "SELECT * FROM vsents")
def sentence_segments(c):
    return S.sentences(c.words).select("clip_id", "s_ord", "first_i", "last_i", "start_us", "end_us", "text",
                                       F.array_join("content", " ").alias("content"))


@query("document_sentences", """
WITH e AS (SELECT *, regexp_matches(text, '[.!?]["'')\\]]?$') AS e FROM document_words),
s AS (SELECT *, coalesce(sum(CAST(e AS INT)) OVER (PARTITION BY clip_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s_ord FROM e)
SELECT clip_id, CAST(s_ord AS BIGINT) AS s_ord, min(i) AS first_i, max(i) AS last_i, min(start_us) AS start_us, max(end_us) AS end_us FROM s GROUP BY clip_id, s_ord""")
def document_sentences(c):
    return S.sentence_numbers(c.document_words).groupBy("clip_id", "s_ord").agg(
        F.min("i").alias("first_i"), F.max("i").alias("last_i"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))


@query("sentence_content_counts", f"""
SELECT clip_id, s_ord, CAST(n AS INT) AS n, n >= 3 AS promotable FROM (
  SELECT clip_id, s_ord, len(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9'']+', ' ', 'g'), ' '),
    lambda t: t <> '' AND t NOT IN {L(fixed.FILLER_STRUCTURE + fixed.STOP_STRUCTURE)})) AS n FROM sents)""")
def sentence_content_counts(c):
    return S.sentences(c.words).select("clip_id", "s_ord", text.content_count("text").alias("n"), text.is_promotable("text").alias("promotable"))


@query("phrase_segments", """
WITH g AS (SELECT *, CASE WHEN start_us - lag(end_us) OVER (PARTITION BY clip_id ORDER BY i) >= 500000 THEN 1 ELSE 0 END AS b FROM words),
p AS (SELECT *, sum(b) OVER (PARTITION BY clip_id ORDER BY i) AS p_ord FROM g)
SELECT clip_id, CAST(p_ord AS BIGINT) AS p_ord, min(i) AS first_i, max(i) AS last_i, min(start_us) AS start_us, max(end_us) AS end_us
FROM p GROUP BY clip_id, p_ord""")
def phrase_segments(c):
    return S.phrases(c.words)


@query("transcript_lines", """
WITH g AS (SELECT *, CASE WHEN start_us - lag(end_us) OVER (PARTITION BY clip_id ORDER BY i) >= 500000 THEN 1 ELSE 0 END AS b FROM words),
p AS (SELECT *, sum(b) OVER (PARTITION BY clip_id ORDER BY i) AS p_ord FROM g),
a AS (SELECT clip_id, p_ord, min(start_us) AS s, max(end_us) AS e, bool_and(i % 40 IN (37, 38)) AS quiet,
  string_agg(text || '{' || i || '}', ' ' ORDER BY i) AS body FROM p GROUP BY clip_id, p_ord)
SELECT clip_id, CAST(p_ord AS BIGINT) AS p_ord, '[' || ((s + 50000) // 100000) // 10 || '.' || ((s + 50000) // 100000) % 10 || '-'
  || ((e + 50000) // 100000) // 10 || '.' || ((e + 50000) // 100000) % 10 || '] ' || CASE WHEN quiet THEN '(quiet pickup) ' ELSE '' END || body AS line FROM a""")
def transcript_lines(c):
    return S.packed_lines(c.words, c.words.filter("i % 40 IN (37, 38)"))


@query("numbered_transcript", """
SELECT u.clip_id, u.unit, (u.unit + 1) || '. ' || string_agg(w.text, ' ' ORDER BY w.i) AS line
FROM units u JOIN words w ON w.clip_id = u.clip_id AND w.i BETWEEN u.first_i AND u.last_i GROUP BY u.clip_id, u.unit""")
def numbered_transcript(c):
    return S.numbered_lines(c.units, c.words)


table("bq", f"""SELECT clip_id, i, text, CASE WHEN ns IS NULL THEN 3.0 ELSE q - CASE WHEN {apos('text')} IN {L(fixed.DANGLING)} AND q < 2 THEN 2.5 ELSE 0 END END AS bq FROM (
  SELECT *, CAST(CASE WHEN regexp_matches(trim(text), '[.!?]["'')\\]]*$') THEN 3.0 WHEN regexp_matches(trim(text), '[,;:—–-]["'')\\]]*$') THEN 2.2
    WHEN {apos('nt')} IN {L(fixed.CLAUSE_STARTERS)} THEN 1.4 ELSE 0 END
    + CASE WHEN ns - end_us >= 350000 THEN 1.2 WHEN ns - end_us >= 180000 THEN 0.6 ELSE 0 END AS DOUBLE) AS q
  FROM (SELECT *, lead(text) OVER (PARTITION BY clip_id ORDER BY i) AS nt, lead(start_us) OVER (PARTITION BY clip_id ORDER BY i) AS ns FROM words))""")


@query("break_quality", "SELECT clip_id, i, CAST(round(bq, 6) AS DOUBLE) AS bq FROM bq")
def break_quality(c):
    return S.break_quality(c.words).select("clip_id", "i", F.round("bq", 6).alias("bq"))


table("chunks", """SELECT clip_id, min(i) AS first_i, max(i) AS last_i, min(start_us) AS start_us, max(end_us) AS end_us FROM (
  SELECT *, (row_number() OVER (PARTITION BY clip_id, g ORDER BY i) - 1) // 3 AS third FROM (
    SELECT *, sum(CASE WHEN b THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY i) AS g FROM (
      SELECT *, coalesce(regexp_matches(trim(lag(text) OVER w), '[.,!?;:]$') OR start_us - lag(end_us) OVER w > 350000, true) AS b
      FROM words WINDOW w AS (PARTITION BY clip_id ORDER BY i)))) GROUP BY clip_id, g, third""")


@query("caption_chunks", "SELECT * FROM chunks")
def caption_chunks(c):
    return S.caption_chunks(c.words)


table("emcand", f"""SELECT clip_id, unit, i, text FROM (SELECT clip_id, i // 8 AS unit, i, text, {apos('text')} AS n FROM words)
  WHERE length(n) >= 3 AND n NOT IN {L(fixed.STOP_EMPHASIS)}""")


@query("emphasis_candidates", """
SELECT clip_id, CAST(unit AS BIGINT) AS unit, i, text FROM emcand QUALIFY count(*) OVER (PARTITION BY clip_id, unit) >= 2""")
def emphasis_candidates(c):
    return S.emphasis_candidates(c.words, c.units)


EMPH = "CASE WHEN unit % 2 = 0 THEN first_i + (clip_id + unit) % 8 END"
table("emph", f"SELECT * FROM (SELECT clip_id, unit, {EMPH} AS em_i FROM units) WHERE em_i IS NOT NULL")


def emphasis(c):
    """Picks the emphasised word of every other unit."""
    return c.units.select("clip_id", "unit", F.expr(EMPH).alias("i")).filter("i IS NOT NULL")


table("giants", f"""SELECT clip_id, CAST(unit AS BIGINT) AS unit, arg_max(p, (em, length(p), -i)) AS word FROM (
  SELECT w.clip_id, w.i // 8 AS unit, w.i, coalesce(w.i = e.em_i, false) AS em,
    CASE WHEN {apos('w.text')} NOT IN {L(fixed.STOP_GIANT)} AND length(l) BETWEEN 3 AND 12 THEN upper(replace(l, 'ß', 'SS')) END AS p
  FROM (SELECT *, regexp_replace(text, '[^\\p{{L}}]', '', 'g') AS l FROM words) w LEFT JOIN emph e ON e.clip_id = w.clip_id AND e.unit = w.i // 8)
  WHERE p IS NOT NULL AND (em OR length(p) >= 4) GROUP BY clip_id, unit""")


@query("giant_words", "SELECT * FROM giants")
def giant_words(c):
    return S.giant_words(c.units, c.words, emphasis(c))


@query("shot_split", """
WITH RECURSIVE cw AS MATERIALIZED (SELECT w.clip_id, w.i, w.start_us, w.end_us, CASE WHEN w.i = max(w.i) OVER (PARTITION BY w.clip_id) THEN 0 ELSE CAST(round_even(b.bq * 1e9, 0) AS BIGINT) END AS q,
  w.i = max(w.i) OVER (PARTITION BY w.clip_id) AS final FROM words w JOIN bq b USING (clip_id, i)),
sc AS (SELECT b.clip_id, b.i AS j, a.i AS a, b.q, (b.end_us - a.start_us) / 1e6 AS d FROM cw a JOIN cw b ON a.clip_id = b.clip_id AND a.i <= b.i AND (b.end_us - a.start_us <= 6600000 OR a.i = b.i)),
cand AS MATERIALIZED (SELECT clip_id, j, list(CAST(round_even(((d - 2.5) * (d - 2.5) + CASE WHEN d > 3.0 THEN 40 * ((d - 3.0) * (d - 3.0)) + 4 ELSE 0 END + CASE WHEN d < 1.4 THEN 25 * ((1.4 - d) * (1.4 - d)) + 2 ELSE 0 END) * 1e9, 0) AS BIGINT) - q ORDER BY a DESC) AS costs
  FROM sc GROUP BY clip_id, j),
f(clip_id, j, hist, k) AS (SELECT DISTINCT clip_id, -1, [CAST(0 AS BIGINT)], CAST(0 AS BIGINT) FROM cw
  UNION ALL SELECT clip_id, j, list_prepend(list_min(t), hist)[1:256], CAST(list_position(t, list_min(t)) AS BIGINT)
    FROM (SELECT f.clip_id, c.j, f.hist, list_transform(range(1, len(c.costs) + 1), lambda x: c.costs[x] + f.hist[x]) AS t FROM f JOIN cand c ON c.clip_id = f.clip_id AND c.j = f.j + 1)),
g(clip_id, e, k) AS (SELECT f.clip_id, f.j, f.k FROM f JOIN cw ON cw.clip_id = f.clip_id AND cw.i = f.j AND cw.final
  UNION ALL SELECT f.clip_id, f.j, f.k FROM g JOIN f ON f.clip_id = g.clip_id AND f.j = g.e - g.k AND f.j >= 0),
sh AS (SELECT g.clip_id, g.e - g.k + 1 AS first_i, g.e AS last_i, a.start_us, b.end_us FROM g JOIN cw a ON a.clip_id = g.clip_id AND a.i = g.e - g.k + 1 JOIN cw b ON b.clip_id = g.clip_id AND b.i = g.e),
ft AS (SELECT clip_id, max(first_i) AS upto FROM (SELECT *, max(end_us) OVER (PARTITION BY clip_id) AS fin FROM sh) WHERE fin - start_us >= 1000000 OR first_i = 0 GROUP BY clip_id),
fo AS (SELECT clip_id, least(first_i, upto) AS first_i, max(last_i) AS last_i, min(start_us) AS s, max(end_us) AS e FROM sh JOIN ft USING (clip_id) GROUP BY clip_id, least(first_i, upto))
SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY first_i) - 1 AS shot_ord, first_i, last_i, CASE WHEN first_i = 0 THEN 0 ELSE s END AS start_us,
  coalesce(lead(s) OVER (PARTITION BY clip_id ORDER BY first_i), e) AS end_us FROM fo""")
def shot_split(c):
    return S.split_shots(c.words)


table("secu", """SELECT x.*, regexp_matches(w.text, '[.!?]["'')\\]]?$') AS stop, x.unit = max(x.unit) OVER (PARTITION BY x.clip_id) AS final
  FROM units x JOIN words w ON w.clip_id = x.clip_id AND w.i = x.last_i""")
table("secf", """SELECT clip_id, unit, unit AS first, start_us AS s0, CAST(0 AS BIGINT) AS sec, end_us, (final OR (end_us - start_us >= 8000000 AND stop) OR end_us - start_us >= 12000000) AS close
      FROM secu WHERE unit = 0
  UNION ALL
  SELECT u.clip_id, u.unit, CASE WHEN f.close THEN u.unit ELSE f.first END, CASE WHEN f.close THEN u.start_us ELSE f.s0 END,
    CASE WHEN f.close THEN f.sec + 1 ELSE f.sec END, u.end_us,
    (u.final OR (u.end_us - CASE WHEN f.close THEN u.start_us ELSE f.s0 END >= 8000000 AND u.stop) OR u.end_us - CASE WHEN f.close THEN u.start_us ELSE f.s0 END >= 12000000)
  FROM secf f JOIN secu u ON u.clip_id = f.clip_id AND u.unit = f.unit + 1""")
table("secg", "SELECT clip_id, sec, min(unit) AS a, max(unit) AS b, min(s0) AS s, max(end_us) AS e, max(sec) OVER (PARTITION BY clip_id) AS m FROM secf GROUP BY clip_id, sec")
table("secs", """SELECT clip_id, sec_ord, min(a) AS first_shot, max(b) AS last_shot, min(s) AS start_us, max(e) AS end_us
  FROM (SELECT clip_id, CASE WHEN sec = m AND sec > 0 AND e - s < 4000000 THEN sec - 1 ELSE sec END AS sec_ord, a, b, s, e FROM secg) GROUP BY clip_id, sec_ord""")


@query("shot_sections", "WITH RECURSIVE x AS (SELECT * FROM secs) SELECT * FROM x")
def shot_sections(c):
    return S.sections(c.units.withColumnRenamed("unit", "shot_ord"), c.words)


# ---- checks -------------------------------------------------------------------------------------
table("topics", """SELECT clip_id, token, n FROM (SELECT clip_id, token, count(*) AS n FROM (SELECT clip_id, unnest(content) AS token FROM sents) GROUP BY clip_id, token)
  JOIN (SELECT clip_id, count(*) AS n_sents FROM sents GROUP BY clip_id) USING (clip_id) WHERE n >= 4 AND n * 3 >= n_sents""")
table("tsents", """SELECT clip_id, s_ord, start_us, end_us, text, list_filter(content, lambda x: NOT list_contains(coalesce(tp, CAST([] AS VARCHAR[])), x)) AS content
  FROM sents LEFT JOIN (SELECT clip_id, list(token) AS tp FROM topics GROUP BY clip_id) USING (clip_id)""")
table("restated", """SELECT a.clip_id, b.start_us AS at_us, a.text AS first, b.text AS second, array_to_string(list_sort(list_intersect(a.content, b.content)), ' ') AS shared
  FROM tsents a JOIN tsents b ON a.clip_id = b.clip_id AND b.s_ord - a.s_ord IN (1, 2)
  JOIN tsents m ON m.clip_id = a.clip_id AND m.s_ord = a.s_ord + 1
  WHERE b.start_us - a.end_us <= 15000000 AND m.start_us - a.end_us <= 15000000
    AND len(list_intersect(a.content, b.content)) >= 2 AND least(len(a.content), len(b.content)) > 0
    AND len(list_intersect(a.content, b.content)) * 2 >= least(len(a.content), len(b.content))""")


@query("topic_words", "SELECT * FROM topics")
def topic_words(c):
    return V.topic_words(S.sentences(c.words))


def _restated(c):
    s = S.sentences(c.words)
    return V.restated_sentences(s, V.topic_words(s))


@query("restated_sentences", "SELECT * FROM restated")
def restated_sentences(c):
    return _restated(c)


@query("restated_per_clip", """
SELECT clip_id, count(*) AS n_restated, min(at_us) AS first_at_us, max(at_us) AS last_at_us FROM restated GROUP BY clip_id""")
def restated_per_clip(c):
    return _restated(c).groupBy("clip_id").agg(F.count("*").alias("n_restated"), F.min("at_us").alias("first_at_us"),
                                               F.max("at_us").alias("last_at_us"))


table("again", """SELECT clip_id, at_us, phrase FROM (
  SELECT clip_id, key AS phrase, min(start_us) AS at_us FROM (
    SELECT *, lag(start_us) OVER (PARTITION BY clip_id, key ORDER BY i) AS prev FROM (
      SELECT clip_id, i, start_us, t || ' ' || t1 || ' ' || t2 AS key FROM (
        SELECT clip_id, i, start_us, t, lead(t) OVER w AS t1, lead(t, 2) OVER w AS t2, CAST(ct AS INT) AS c0, CAST(lead(ct) OVER w AS INT) AS c1, CAST(lead(ct, 2) OVER w AS INT) AS c2
        FROM (SELECT v.*, v.content AND p.token IS NULL AS ct FROM vwords v LEFT JOIN topics p ON p.clip_id = v.clip_id AND p.token = v.t)
        WINDOW w AS (PARTITION BY clip_id ORDER BY i)) WHERE t2 IS NOT NULL AND c0 + c1 + c2 >= 2))
  WHERE start_us - prev <= 20000000 GROUP BY clip_id, key) x
  WHERE NOT EXISTS (SELECT 1 FROM restated r WHERE r.clip_id = x.clip_id AND abs(r.at_us - x.at_us) < 8000000)""")


@query("repeated_phrases", "SELECT * FROM again")
def repeated_phrases(c):
    s = S.sentences(c.words)
    t = V.topic_words(s)
    return V.repeated_phrases(c.words, t, V.restated_sentences(s, t))


def heard(c):
    """A second transcript: some words dropped, some changed."""
    from ..functions.seq import numbered
    h = c.words.filter("i % 37 <> 5").withColumn("text", F.expr("CASE WHEN i % 41 = 7 THEN concat(text, 'x') ELSE text END"))
    return numbered(h.withColumnRenamed("i", "src_i"), "src_i", "i")


# the longest common subsequence row by row, each from the row below by the next place of the word on the other side
SURFACE = "regexp_replace(replace(replace(lower({}), '‘', ''''), '’', ''''), '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')"
OTHER = "CASE WHEN i % 41 = 7 THEN text || 'x' ELSE text END"
table("dcap", f"SELECT clip_id, i, text, start_us, {SURFACE.format('text')} AS t FROM words")
table("dhrd", f"SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY i) AS j, {OTHER} AS text, start_us, {SURFACE.format(OTHER)} AS t FROM words WHERE i % 37 <> 5")
table("dlst", """SELECT clip_id, n, coalesce(m, 0) AS m, x, coalesce(y, CAST([] AS VARCHAR[])) AS y FROM (SELECT clip_id, count(*) AS n, list(t ORDER BY i) AS x FROM dcap GROUP BY clip_id)
  LEFT JOIN (SELECT clip_id, count(*) AS m, list(t ORDER BY j) AS y FROM dhrd GROUP BY clip_id) USING (clip_id)""")
table("dpos", "SELECT c.clip_id, c.i, list(h.j ORDER BY h.j) FILTER (h.j IS NOT NULL) AS p FROM dcap c LEFT JOIN dhrd h ON h.clip_id = c.clip_id AND h.t = c.t GROUP BY c.clip_id, c.i")
table("drow", """SELECT clip_id, n AS i, list_transform(range(0, m + 1), lambda k: CAST(0 AS BIGINT)) AS below FROM dlst
  UNION ALL SELECT r.clip_id, r.i - 1, CASE WHEN q.p IS NULL THEN r.below ELSE list_transform(range(1, len(r.below) + 1), lambda k: greatest(r.below[k], coalesce(r.below[list_filter(q.p, lambda z: z >= k)[1] + 1] + 1, 0))) END
  FROM drow r JOIN dpos q ON q.clip_id = r.clip_id AND q.i = r.i - 1""")
table("dtwo", "SELECT a.clip_id, a.i, a.below AS here, b.below FROM drow a JOIN drow b ON b.clip_id = a.clip_id AND b.i = a.i + 1")
table("dwalk", """SELECT clip_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS j, CAST(NULL AS BOOLEAN) AS hit FROM dlst
  UNION ALL SELECT w.clip_id, w.i + CASE WHEN l.x[w.i + 1] = l.y[w.j + 1] OR t.below[w.j + 1] = t.here[w.j + 1] THEN 1 ELSE 0 END,
    w.j + CASE WHEN l.x[w.i + 1] = l.y[w.j + 1] OR t.below[w.j + 1] <> t.here[w.j + 1] THEN 1 ELSE 0 END, l.x[w.i + 1] = l.y[w.j + 1]
  FROM dwalk w JOIN dlst l USING (clip_id) JOIN dtwo t ON t.clip_id = w.clip_id AND t.i = w.i WHERE w.i < l.n AND w.j < l.m""")
table("dmark", "SELECT clip_id, i - 1 AS ca, j - 1 AS cb FROM dwalk WHERE hit UNION ALL SELECT clip_id, -1, -1 FROM dlst UNION ALL SELECT clip_id, n, m FROM dlst")
table("dgap", "SELECT * FROM (SELECT clip_id, ca, cb, lead(ca) OVER (PARTITION BY clip_id ORDER BY ca) AS na, lead(cb) OVER (PARTITION BY clip_id ORDER BY ca) AS nb FROM dmark) WHERE na - ca > 1 OR nb - cb > 1")
table("drift", """SELECT g.clip_id, CASE WHEN b IS NULL THEN 'caption_not_heard' WHEN a IS NULL THEN 'heard_not_captioned' ELSE 'differs' END AS kind, coalesce(bs, as_us) AS at_us, coalesce(a, '') AS caption, coalesce(b, '') AS heard FROM dgap g
  LEFT JOIN (SELECT g.clip_id, g.ca, string_agg(c.text, ' ' ORDER BY c.i) AS a, min(c.start_us) AS as_us FROM dgap g JOIN dcap c ON c.clip_id = g.clip_id AND c.i > g.ca AND c.i < g.na GROUP BY ALL) x USING (clip_id, ca)
  LEFT JOIN (SELECT g.clip_id, g.ca, string_agg(h.text, ' ' ORDER BY h.j) AS b, min(h.start_us) AS bs FROM dgap g JOIN dhrd h ON h.clip_id = g.clip_id AND h.j - 1 > g.cb AND h.j - 1 < g.nb GROUP BY ALL) y USING (clip_id, ca)""")


@query("transcript_drift", "WITH RECURSIVE d AS (SELECT * FROM drift) SELECT * FROM d")
def transcript_drift(c):
    return A.transcript_drift(c.words, heard(c))


NORM = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


@query("heard_word_diff", f"""
WITH RECURSIVE hx AS (SELECT clip_id, i, {NORM.format('text')} AS t, {NORM.format("CASE WHEN i % 41 = 7 THEN text || 'x' ELSE text END")} AS t2 FROM words),
ls AS MATERIALIZED (SELECT clip_id, list(t ORDER BY i) AS x, coalesce(list(t2 ORDER BY i) FILTER (i % 37 <> 5), CAST([] AS VARCHAR[])) AS y FROM hx GROUP BY clip_id),
f(clip_id, a, b, missing, extra) AS (SELECT clip_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM ls
  UNION ALL SELECT clip_id, a + CASE WHEN same THEN 1 WHEN d IS NULL THEN 1 WHEN d % 2 = 0 THEN 0 ELSE d // 2 END, b + CASE WHEN same THEN 1 WHEN d IS NULL THEN 1 WHEN d % 2 = 0 THEN d // 2 ELSE 0 END,
    missing + CASE WHEN same THEN 0 WHEN d IS NULL THEN 1 WHEN d % 2 = 1 THEN d // 2 ELSE 0 END, extra + CASE WHEN same THEN 0 WHEN d IS NULL THEN 1 WHEN d % 2 = 0 THEN d // 2 ELSE 0 END
  FROM (SELECT f.*, x[a + 1] = y[b + 1] AS same, list_min([CASE WHEN x[a + 1] = y[b + 2] THEN 2 END, CASE WHEN x[a + 2] = y[b + 1] THEN 3 END, CASE WHEN x[a + 1] = y[b + 3] THEN 4 END,
    CASE WHEN x[a + 3] = y[b + 1] THEN 5 END, CASE WHEN x[a + 1] = y[b + 4] THEN 6 END, CASE WHEN x[a + 4] = y[b + 1] THEN 7 END]) AS d FROM f JOIN ls USING (clip_id) WHERE a < len(x) AND b < len(y)))
SELECT clip_id, missing + len(x) - a AS missing, extra + len(y) - b AS extra, len(y) > 0 AND len(y) >= len(x) * 0.6 AS accepted FROM f JOIN ls USING (clip_id) WHERE a = len(x) OR b = len(y)""")
def heard_word_diff(c):
    return A.word_diff(c.words, heard(c))


@query("inner_pauses", """SELECT s.clip_id, s.start_us, s.end_us FROM silences s JOIN clips c USING (clip_id)
WHERE s.start_us > 100000 AND s.end_us < c.duration_us - 100000""")
def inner_pauses(c):
    return V.inner_pauses(c.silences, c.clips)


@query("longest_pauses", """SELECT s.clip_id, max(s.end_us - s.start_us) AS longest_us, count(*) FILTER (s.end_us - s.start_us > 350000) AS n_over
FROM silences s JOIN clips c USING (clip_id) WHERE s.start_us > 100000 AND s.end_us < c.duration_us - 100000 GROUP BY s.clip_id""")
def longest_pauses(c):
    return V.longest_pauses(V.inner_pauses(c.silences, c.clips))


def loudness(c):
    return c.clips.select("clip_id", (-10.0 - F.col("clip_id") % 9).alias("lufs"), (F.col("clip_id") % 11 != 3).alias("has_audio"))


@query("verify_report", """
WITH RECURSIVE rep AS (SELECT clip_id, count(*) AS n FROM (SELECT clip_id FROM restated UNION ALL SELECT clip_id FROM again) GROUP BY clip_id),
dr AS (SELECT clip_id, count(*) AS n FROM drift GROUP BY clip_id),
pa AS (SELECT s.clip_id, max(s.end_us - s.start_us) AS longest_us, count(*) FILTER (s.end_us - s.start_us > 350000) AS n_over
  FROM silences s JOIN clips c USING (clip_id) WHERE s.start_us > 100000 AND s.end_us < c.duration_us - 100000 GROUP BY s.clip_id),
f AS (SELECT clip_id, 1 + CASE WHEN clip_id % 11 = 3 THEN 1 ELSE 0 END + CASE WHEN abs(-10.0 - clip_id % 9 + 14) > 2 THEN 1 ELSE 0 END AS n_format FROM clips)
SELECT clip_id, coalesce(rep.n, 0) AS n_repeats, coalesce(dr.n, 0) AS n_drift, coalesce(longest_us, 0) AS longest_us, coalesce(n_over, 0) AS n_over,
  CAST(n_format AS BIGINT) AS n_format, CAST(coalesce(rep.n, 0) + coalesce(dr.n, 0) + coalesce(n_over, 0) + n_format AS BIGINT) AS issues
FROM clips LEFT JOIN rep USING (clip_id) LEFT JOIN dr USING (clip_id) LEFT JOIN pa USING (clip_id) LEFT JOIN f USING (clip_id)""")
def verify_report(c):
    s = S.sentences(c.words)
    t = V.topic_words(s)
    r = V.restated_sentences(s, t)
    found = r.select("clip_id").unionByName(V.repeated_phrases(c.words, t, r).select("clip_id"))
    return V.verify_report(c.clips, found, A.transcript_drift(c.words, heard(c)), V.inner_pauses(c.silences, c.clips), loudness(c))
