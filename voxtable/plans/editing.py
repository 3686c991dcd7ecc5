"""Queries on classifier answers, overlays, cameras, captions and beat structure.

Shots are the eight-word units; every unit of every clip has a distribution per question."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, text
from ..functions.stage import stage
from ..operators import clock as K, decisions as D, segments as S, structure as T
from .oracle_tables import sql_list as L, table
from .registry import query
from .retakes import _lazy
from .speech import emphasis
from .cleaning import CUTPTS

QUESTIONS = ("overlay", "camera", "template", "text_effect", "transition", "sfx", "caption_style")
dists = _lazy("dists", lambda c: D.distributions(c.answers, QUESTIONS))
hook = _lazy("hook", lambda c: D.hook_end(c.words, c.units, c.clips))
picks = _lazy("picks", lambda c: D.overlays(dists(c)).select("clip_id", "unit", "overlay", "graphic", "template"))

R = "round({}, 6)"
table("top", "SELECT clip_id, unit, question, arg_max(label, (prob, -label_ord)) AS label, max(prob) AS conf FROM answers GROUP BY clip_id, unit, question")
table("pick_rows", """SELECT o.clip_id, o.unit, o.label AS overlay, least(1.0, g.graphic) AS graphic,
  CASE WHEN o.label = 'keyword_pill' THEN 'keyword_pill' WHEN o.label = 'card' AND t.label = 'keyword_pill' THEN n.label ELSE t.label END AS template
  FROM top o JOIN top t ON t.clip_id = o.clip_id AND t.unit = o.unit AND t.question = 'template'
  JOIN (SELECT clip_id, unit, sum(prob) FILTER (label = 'card') + sum(prob) FILTER (label = 'keyword_pill') AS graphic FROM answers WHERE question = 'overlay' GROUP BY clip_id, unit) g ON g.clip_id = o.clip_id AND g.unit = o.unit
  JOIN (SELECT clip_id, unit, arg_max(label, (prob, -label_ord)) AS label FROM answers WHERE question = 'template' AND label <> 'keyword_pill' GROUP BY clip_id, unit) n ON n.clip_id = o.clip_id AND n.unit = o.unit
  WHERE o.question = 'overlay'""")
table("hooks", """SELECT c.clip_id, (((least(coalesce(s.s + 100000, b.b, 3000000), greatest(1000000, duration_us - 500000)) * 60 + 1000000) // 2000000) * 2000000 + 30) // 60 AS hook_end_us
  FROM clips c LEFT JOIN (SELECT clip_id, arg_min(end_us, i) AS s FROM words WHERE end_us BETWEEN 2400000 AND 4200000 AND regexp_matches(trim(text), '[.!?]["'')\\]]*$') GROUP BY clip_id) s USING (clip_id)
  LEFT JOIN (SELECT clip_id, min(start_us) AS b FROM units WHERE start_us BETWEEN 2400000 AND 4200000 GROUP BY clip_id) b USING (clip_id)""")


@query("overlay_picks", f"SELECT clip_id, unit, overlay, {R.format('graphic')} AS graphic, template FROM pick_rows")
def overlay_picks(c):
    return picks(c).withColumn("graphic", F.round("graphic", 6))


@query("second_best_template", """SELECT a.clip_id, a.unit, arg_max(a.label, (a.prob, -a.label_ord)) AS label FROM answers a JOIN top t ON t.clip_id = a.clip_id AND t.unit = a.unit AND t.question = 'template'
WHERE a.question = 'template' AND a.label <> t.label AND a.label <> 'quote' GROUP BY a.clip_id, a.unit""")
def second_best_template(c):
    ex = dists(c).select("clip_id", "unit", F.explode(F.array(D.best("template_d"), F.lit("quote"))).alias("label"))
    return D.next_best(dists(c), "template_d", ex)


table("inhook", "SELECT u.clip_id, u.unit, u.start_us, u.end_us, h.hook_end_us, h.hook_end_us > 0 AND u.start_us < h.hook_end_us - 200000 AS hook FROM units u JOIN hooks h USING (clip_id)")
table("camlift", """SELECT a.clip_id, a.unit, a.label, a.label_ord, (a.prob + 0.01) / (m.mean + 0.03) AS lift FROM answers a JOIN (
  SELECT a.clip_id, a.label, coalesce(sum(prob) FILTER (NOT hook), 0) / greatest(1, count(*) FILTER (NOT hook)) AS mean FROM answers a JOIN inhook USING (clip_id, unit) WHERE question = 'camera' GROUP BY a.clip_id, a.label) m USING (clip_id, label)
  WHERE question = 'camera'""")


def in_hook(c):
    return c.units.join(hook(c), "clip_id").withColumn("hook", (F.col("hook_end_us") > 0) & (F.col("start_us") < F.col("hook_end_us") - 200_000))


@query("camera_lift", f"SELECT clip_id, unit, label, {R.format('lift')} AS lift FROM camlift")
def camera_lift(c):
    a = c.answers.filter("question = 'camera'")
    return D.label_lift(a, in_hook(c)).select("clip_id", "unit", "label", F.round("lift", 6).alias("lift"))


@query("hook_ends", "SELECT * FROM hooks")
def hook_ends(c):
    return hook(c)


@query("opening_text", "SELECT clip_id, trim(regexp_replace(string_agg(trim(text), ' ' ORDER BY i), '\\s+', ' ', 'g')) AS text FROM words JOIN hooks USING (clip_id) WHERE start_us < hook_end_us GROUP BY clip_id")
def opening_text(c):
    return D.opening_text(c.words, hook(c))


STRIPT = "trim(regexp_replace({}, '^[^\\p{{L}}\\p{{N}}$%]+|[^\\p{{L}}\\p{{N}}$%?]+$', '', 'g'))"


@query("title_copy", f"""
WITH op AS (SELECT clip_id, trim(regexp_replace(string_agg(trim(text), ' ' ORDER BY i), '\\s+', ' ', 'g')) AS opening FROM words JOIN hooks USING (clip_id) WHERE start_us < hook_end_us GROUP BY clip_id),
raw AS (SELECT clip_id, opening, CASE WHEN clip_id % 3 = 0 THEN '  "big"  news, today ' WHEN clip_id % 3 = 1 THEN '' END AS word, CASE WHEN clip_id % 2 = 0 THEN 'one two three four five six seven eight.' END AS line FROM op),
p AS (SELECT *, array_to_string(list_filter(list_transform(string_split(trim(regexp_replace(coalesce(word, ''), '\\s+', ' ', 'g')), ' '), lambda x: {STRIPT.format('x')}), lambda x: x <> '')[1:2], ' ') AS own,
  list_transform(regexp_split_to_array(opening, '\\s+'), lambda x: {STRIPT.format('x')}) AS ow, regexp_split_to_array(opening, '\\s+') AS os FROM raw),
f AS (SELECT *, list_filter(ow, lambda x: length(x) >= 3 AND NOT list_contains([{', '.join(repr(w) for w in fixed.STOP_TITLE)}], lower(x))) AS cand FROM p),
g AS (SELECT *, list_filter(cand, lambda x: length(x) = list_max(list_transform(cand, lambda y: length(y))))[1] AS longest FROM f)
SELECT clip_id, upper(replace(left(CASE WHEN own <> '' THEN own ELSE left(coalesce(longest, ow[1], ''), 12) END, 14), 'ß', 'SS')) AS word,
 CASE WHEN line IS NOT NULL THEN regexp_replace(array_to_string(string_split(trim(line), ' ')[1:7], ' '), '[.,;:]+$', '') ELSE regexp_replace(array_to_string(os[1:6], ' '), '[.,;:!?]+$', '') END AS line FROM g""")
def title_copy(c):
    raw = D.opening_text(c.words, hook(c)).select(
        "clip_id", F.col("text").alias("opening"), F.expr("CASE WHEN clip_id % 3 = 0 THEN '  \"big\"  news, today ' WHEN clip_id % 3 = 1 THEN '' END").alias("word"),
        F.expr("CASE WHEN clip_id % 2 = 0 THEN 'one two three four five six seven eight.' END").alias("line"))
    return D.title_copy(raw)


# ---- overlays ---------------------------------------------------------------------------------------
def _giants(c):
    return S.giant_words(c.units, c.words, emphasis(c))


giants = _lazy("giants", _giants)


def _planned(c):
    d = dists(c)
    s = c.units.join(picks(c), ["clip_id", "unit"]).join(d.select(
        "clip_id", "unit", D.prob_of("overlay_d", "none").alias("p_none"), D.prob_of("overlay_d", "card").alias("p_card"),
        D.prob_of("overlay_d", "keyword_pill").alias("p_pill"), D.prob_of("overlay_d", "giant_word").alias("p_giant")), ["clip_id", "unit"])
    s = s.join(giants(c).withColumnRenamed("word", "giant_word"), ["clip_id", "unit"], "left")
    return D.plan_overlays(s.select("clip_id", "unit", "start_us", "end_us", "overlay", "graphic", "p_none", "p_card", "p_pill", "p_giant", "giant_word"),
                           hook(c), c.clips.select("clip_id", "duration_us"))


planned = _lazy("planned_overlays", _planned)
settled = _lazy("settled", lambda c: D.settle_visuals(planned(c), dists(c), picks(c)))


# the rules walked in order of rank, one clip's lists at a time
table("ovs", """SELECT u.clip_id, u.unit, u.start_us, u.end_us, p.overlay, p.graphic, g.word, h.hook_end_us, c.duration_us, a.p_none, a.p_card, a.p_pill, a.p_giant,
  CASE WHEN h.hook_end_us > 0 AND u.start_us < h.hook_end_us - 200000 THEN 'none' ELSE p.overlay END AS now0, u.start_us >= h.hook_end_us + 1500000 AS late
  FROM units u JOIN pick_rows p USING (clip_id, unit) LEFT JOIN giants g USING (clip_id, unit) JOIN hooks h USING (clip_id) JOIN clips c USING (clip_id) JOIN (
    SELECT clip_id, unit, max(prob) FILTER (label = 'none') AS p_none, max(prob) FILTER (label = 'card') AS p_card, max(prob) FILTER (label = 'keyword_pill') AS p_pill, max(prob) FILTER (label = 'giant_word') AS p_giant
    FROM answers WHERE question = 'overlay' GROUP BY clip_id, unit) a USING (clip_id, unit)""")
table("ovr", "SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY p_giant DESC, unit) AS rn FROM ovs WHERE now0 = 'giant_word' AND late AND word IS NOT NULL")
table("ovk", """SELECT clip_id, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(u BIGINT, s BIGINT, p DOUBLE)[]) AS kept FROM clips
  UNION ALL SELECT k.clip_id, r.rn, CASE WHEN len(list_filter(k.kept, lambda x: abs(x.s - r.start_us) < 8500000)) > 0 THEN k.kept ELSE list_append(k.kept, {'u': r.unit, 's': r.start_us, 'p': r.p_giant}) END
  FROM ovk k JOIN ovr r ON r.clip_id = k.clip_id AND r.rn = k.rn + 1""")
table("ovf", "SELECT clip_id, arg_max(kept, rn) AS kept FROM ovk GROUP BY clip_id")
table("ovq", """SELECT o.clip_id, o.unit, o.start_us, o.p_giant, row_number() OVER (PARTITION BY o.clip_id ORDER BY o.p_giant DESC, o.unit) AS rn, CAST(floor((o.duration_us - o.hook_end_us) / 14000000) AS BIGINT) - len(f.kept) AS short
  FROM ovs o JOIN ovf f USING (clip_id) WHERE o.late AND o.word IS NOT NULL AND len(list_filter(f.kept, lambda x: x.u = o.unit)) = 0""")
table("ovm", """SELECT clip_id, CAST(0 AS BIGINT) AS rn, kept, CAST([] AS BIGINT[]) AS more FROM ovf
  UNION ALL SELECT clip_id, rn, CASE WHEN take THEN list_append(kept, {'u': unit, 's': start_us, 'p': p_giant}) ELSE kept END, CASE WHEN take THEN list_append(more, unit) ELSE more END FROM (
    SELECT m.clip_id, q.rn, m.kept, m.more, q.unit, q.start_us, q.p_giant, len(m.more) < q.short AND len(list_filter(m.kept, lambda x: abs(x.s - q.start_us) < 8500000)) = 0 AS take
    FROM ovm m JOIN ovq q ON q.clip_id = m.clip_id AND q.rn = m.rn + 1)""")
table("ovn", """SELECT *, CASE WHEN added THEN 'giant_word' ELSE mid END AS now1 FROM (
  SELECT *, CASE WHEN NOT refused THEN NULL WHEN NOT late THEN 'giant word too close to the hook' WHEN word IS NOT NULL OR near THEN 'giant words at least 8.5 s apart' ELSE 'no plain word of 3 to 12 letters in this shot' END AS why,
    CASE WHEN NOT refused THEN now0 WHEN p_none >= p_card AND p_none >= p_pill THEN 'none' WHEN p_card >= p_pill THEN 'card' ELSE 'keyword_pill' END AS mid FROM (
    SELECT o.*, list_contains(m.more, o.unit) AS added, len(list_filter(f.kept, lambda x: x.u = o.unit)) > 0 AS is_kept, o.now0 = 'giant_word' AND len(list_filter(f.kept, lambda x: x.u = o.unit)) = 0 AS refused,
      len(list_filter(f.kept, lambda x: abs(x.s - o.start_us) < 8500000 AND (x.p > o.p_giant OR (x.p = o.p_giant AND x.u < o.unit)))) > 0 AS near
    FROM ovs o JOIN ovf f USING (clip_id) JOIN (SELECT clip_id, arg_max(more, rn) AS more FROM ovm GROUP BY clip_id) m USING (clip_id)))""")
table("ovc", "SELECT clip_id, unit, start_us, end_us, row_number() OVER (PARTITION BY clip_id ORDER BY graphic, unit) AS rn FROM ovn WHERE now1 IN ('card', 'keyword_pill')")
table("ovt", """SELECT clip_id, list({'u': unit, 's': start_us, 'e': end_us, 'c': now1 <> 'none'} ORDER BY unit) AS shots, min(start_us) AS lo, max(end_us) AS hi, max(greatest(1000000, duration_us - hook_end_us)) AS room,
  coalesce(sum(end_us - start_us) FILTER (now1 IN ('card', 'keyword_pill')), 0) AS shown FROM ovn GROUP BY clip_id""")
table("ovd", """SELECT clip_id, CAST(0 AS BIGINT) AS rn, shots, CAST(shown AS DOUBLE) AS shown, CAST([] AS BIGINT[]) AS gone FROM ovt
  UNION ALL SELECT clip_id, rn, CASE WHEN drops THEN list_transform(shots, lambda y: {'u': y.u, 's': y.s, 'e': y.e, 'c': y.c AND y.u <> unit}) ELSE shots END, CASE WHEN drops THEN shown - took ELSE shown END, CASE WHEN drops THEN list_append(gone, unit) ELSE gone END FROM (
    SELECT d.clip_id, c.rn, d.shots, d.shown, d.gone, c.unit, c.end_us - c.start_us AS took, d.shown / t.room > 0.55
      AND coalesce(list_min(list_transform(list_filter(d.shots, lambda y: y.u > c.unit AND y.c), lambda y: y.s)), t.hi) - coalesce(list_max(list_transform(list_filter(d.shots, lambda y: y.u < c.unit AND y.c), lambda y: y.e)), t.lo) <= 6000000 AS drops
    FROM ovd d JOIN ovc c ON c.clip_id = d.clip_id AND c.rn = d.rn + 1 JOIN ovt t ON t.clip_id = d.clip_id)""")
table("ovp", """SELECT n.clip_id, n.unit, n.graphic, CASE WHEN list_contains(g.gone, n.unit) THEN 'none' ELSE now1 END AS overlay, CASE WHEN is_kept OR added THEN word END AS giant,
  concat_ws(' | ', CASE WHEN now0 <> n.overlay THEN 'hook window stays clean: ' || n.overlay || ' -> none' END, why || ': giant_word -> ' || mid,
    CASE WHEN added THEN 'no giant word in the first ' || CAST(floor(start_us / 1e6 + 0.5) AS BIGINT) || ' s of a ' || CAST(floor(duration_us / 1e6 + 0.5) AS BIGINT) || ' s clip: best supported shot promoted: ' || mid || ' -> giant_word' END,
    CASE WHEN list_contains(g.gone, n.unit) THEN 'card density cap (55% of the speaking time): ' || now1 || ' -> none' END) AS log
  FROM ovn n JOIN (SELECT clip_id, arg_max(gone, rn) AS gone FROM ovd GROUP BY clip_id) g USING (clip_id)""")


@query("planned_overlays", "WITH RECURSIVE x AS (SELECT * FROM ovp) SELECT clip_id, unit, overlay, giant, log FROM x")
def planned_overlays(c):
    return planned(c).select("clip_id", "unit", "overlay", "giant", F.array_join("log", " | ").alias("log"))


@query("settled_visuals", """
WITH RECURSIVE x AS (SELECT * FROM ovp), t AS (SELECT clip_id, unit, arg_max(label, (prob, -label_ord)) AS alt FROM answers WHERE question = 'template' AND label <> 'keyword_pill' GROUP BY clip_id, unit)
SELECT x.clip_id, x.unit, x.overlay, x.giant, CASE WHEN x.overlay IN ('card', 'keyword_pill') THEN greatest(x.graphic, 0.55) ELSE least(x.graphic, 0.45) END AS needs,
  CASE WHEN x.overlay = 'keyword_pill' THEN 'keyword_pill' WHEN x.overlay = 'card' AND p.template = 'keyword_pill' THEN t.alt ELSE p.template END AS template
FROM x JOIN pick_rows p USING (clip_id, unit) JOIN t USING (clip_id, unit)""")
def settled_visuals(c):
    return settled(c)


# beats straight from the answers, so that the rule can be compared
table("hshots", """SELECT u.clip_id, u.unit, u.start_us, u.end_us, p.graphic >= 0.5 AS wants, CASE WHEN (u.clip_id + u.unit // 3) % 4 = 0 THEN p.template WHEN (u.clip_id + u.unit // 3) % 2 = 0 THEN 'quote' ELSE 'big_statement' END AS template FROM units u JOIN pick_rows p USING (clip_id, unit)""")


def hold_shots(c):
    t = F.expr("CASE WHEN (clip_id + unit DIV 3) % 4 = 0 THEN template WHEN (clip_id + unit DIV 3) % 2 = 0 THEN 'quote' ELSE 'big_statement' END")
    return c.units.join(picks(c), ["clip_id", "unit"]).select("clip_id", "unit", "start_us", "end_us", F.col("graphic").alias("needs"), t.alias("template"))


HOLD = f"""
hx AS (SELECT *, CASE WHEN template IN {L(fixed.UNDER_CHIN_TEMPLATES)} THEN 5500000 ELSE 3400000 END AS cap, wants AND template NOT IN {L(fixed.NO_HOLD_TEMPLATES)} AS grows FROM hshots),
hf AS (SELECT clip_id, unit, unit AS beat, template, start_us AS b0, cap, grows, false AS mid FROM hx WHERE unit = 0
  UNION ALL
  SELECT x.clip_id, x.unit, CASE WHEN take OR hold THEN f.beat ELSE x.unit END, CASE WHEN take OR hold THEN f.template ELSE x.template END, CASE WHEN take OR hold THEN f.b0 ELSE x.start_us END,
    CASE WHEN take OR hold THEN f.cap ELSE x.cap END, CASE WHEN take OR hold THEN f.grows ELSE x.grows END, hold AND NOT take
  FROM (SELECT f.*, x.unit AS xu FROM hf f JOIN hx x ON x.clip_id = f.clip_id AND x.unit = f.unit + 1) f JOIN (
    SELECT x.*, n.template AS nt, n.wants AS nw, n.end_us AS ne FROM hx x LEFT JOIN hx n ON n.clip_id = x.clip_id AND n.unit = x.unit + 1) x ON x.clip_id = f.clip_id AND x.unit = f.xu,
  LATERAL (SELECT f.grows AND x.wants AND x.template = f.template AND x.end_us - f.b0 <= f.cap AS take,
     f.grows AND NOT f.mid AND coalesce(x.nw AND x.nt = f.template AND x.end_us - x.start_us < 2500000 AND x.ne - f.b0 <= f.cap, false) AS hold))"""


@query("held_beats", "WITH RECURSIVE " + HOLD + " SELECT clip_id, unit, beat FROM hf")
def held_beats(c):
    return D.hold_merge(hold_shots(c))


@query("held_beat_rows")
def held_beat_rows(c):
    return D.held_beats(hold_shots(c), D.hold_merge(hold_shots(c)), dists(c)).withColumn("needs", F.round("needs", 6))


# ---- cameras ---------------------------------------------------------------------------------------
CTX = "hook, overlay IN ('card', 'keyword_pill') AS card, overlay = 'giant_word' AS giant"
table("camctx", f"SELECT i.clip_id, i.unit, i.hook, p.overlay IN ('card', 'keyword_pill') AS card, p.overlay = 'giant_word' AS giant, t.label AS pick, row_number() OVER (PARTITION BY i.clip_id ORDER BY i.unit) AS rn FROM inhook i JOIN pick_rows p USING (clip_id, unit) JOIN top t ON t.clip_id = i.clip_id AND t.unit = i.unit AND t.question = 'camera'")
CAMS = """
cl AS (SELECT clip_id, unit, list(lift ORDER BY label_ord) AS ls FROM camlift GROUP BY clip_id, unit),
cx AS (SELECT c.*, l.ls, CASE WHEN hook THEN 1 WHEN card THEN 2 WHEN giant THEN 3 ELSE 5 END AS width FROM camctx c JOIN cl l USING (clip_id, unit)),
cm AS (SELECT clip_id, rn, list_position(ls[1:width], list_max(ls[1:width])) - 1 AS cam, -1 AS prev FROM (SELECT clip_id, rn, width, list_transform(ls, lambda x, k: x + CASE WHEN k = 1 THEN 0.0001 ELSE 0 END) AS ls FROM cx) WHERE rn = 1
  UNION ALL
  SELECT clip_id, rn, list_position(sc[1:width], list_max(sc[1:width])) - 1, prev FROM (
    SELECT x.clip_id, x.rn, x.width, m.cam AS prev, list_transform(x.ls, lambda v, k: CASE WHEN x.width > 1 AND k - 1 = m.cam THEN -1.0 ELSE v * CASE WHEN k - 1 = m.cam OR k - 1 = m.prev THEN 0.15 ELSE 1 END + CASE WHEN k = 1 THEN 0.0001 ELSE 0 END END) AS sc
    FROM cm m JOIN cx x ON x.clip_id = m.clip_id AND x.rn = m.rn + 1)),
cameras AS (SELECT x.clip_id, x.unit, ['base', 'punch', 'face_closeup', 'push_in', 'drift'][CAST(m.cam + 1 AS INT)] AS camera, x.pick, x.hook, x.card, x.giant, x.width, CASE WHEN m.prev >= 0 THEN ['base', 'punch', 'face_closeup', 'push_in', 'drift'][CAST(m.prev + 1 AS INT)] END AS before FROM cx x JOIN cm m USING (clip_id, rn))"""


def _cameras(c):
    t = dists(c).select("clip_id", "unit", D.best("camera_d").alias("pick"))
    s = in_hook(c).join(picks(c), ["clip_id", "unit"]).join(t, ["clip_id", "unit"]).select(
        "clip_id", "unit", "hook", F.col("overlay").isin("card", "keyword_pill").alias("card"), (F.col("overlay") == "giant_word").alias("giant"), "pick")
    lifts = D.label_lift(c.answers.filter("question = 'camera'"), in_hook(c))
    return D.assign_cameras(s, lifts)


cameras = _lazy("cameras", _cameras)


@query("camera_plan", "WITH RECURSIVE " + CAMS + """ SELECT clip_id, unit, camera, pick, CASE WHEN camera = pick THEN NULL
  WHEN list_position(['base', 'punch', 'face_closeup', 'push_in', 'drift'], pick) > width THEN CASE WHEN hook THEN 'hook window stays clean' WHEN card THEN 'a card sits under the chin, wide moves would cover it' ELSE 'a moving camera would slide the giant word off the head' END
  WHEN width > 1 AND pick = before THEN 'same camera as the previous shot' ELSE 'camera used in the last two shots, varied instead' END AS rule FROM cameras""")
def camera_plan(c):
    return cameras(c)


def _style_sections(c):
    secs = S.sections(c.units.withColumnRenamed("unit", "shot_ord"), c.words)
    secs = secs.select("clip_id", F.col("sec_ord").alias("sec"), F.col("first_shot").alias("unit"), "start_us", "end_us")
    return secs.join(dists(c).select("clip_id", "unit", D.best("caption_style_d").alias("pick")), ["clip_id", "unit"])


style_secs = _lazy("style_sections", _style_sections)
style_whole = lambda c: dists(c).filter("unit = 0").select("clip_id", D.best("caption_style_d").alias("style"))


def _styles(c):
    probs = c.answers.filter("question = 'caption_style'").join(style_secs(c).select("clip_id", "unit", "sec"), ["clip_id", "unit"])
    return D.caption_styles(style_secs(c).select("clip_id", "sec", "pick"), probs.select("clip_id", "sec", "label_ord", "prob"), style_whole(c))


styles = _lazy("styles", _styles)

# the rule walked section by section; styles are numbered from 1 in menu order
table("cs0", """SELECT s.clip_id, s.sec_ord AS sec, s.first_shot AS unit, s.start_us, s.end_us, list(a.prob ORDER BY a.label_ord) AS p, list(a.label ORDER BY a.label_ord) AS labels
  FROM secs s JOIN answers a ON a.clip_id = s.clip_id AND a.unit = s.first_shot AND a.question = 'caption_style' GROUP BY ALL""")
table("csm", "SELECT clip_id, list(m ORDER BY k) AS m FROM (SELECT clip_id, k, sum(v) / count(*) AS m FROM (SELECT clip_id, unnest(p) AS v, unnest(range(1, len(p) + 1)) AS k FROM cs0) GROUP BY clip_id, k) GROUP BY clip_id")
table("cs1", "SELECT c.*, list_position(p, list_max(p)) AS own, list_transform(range(1, len(p) + 1), lambda k: (p[k] + 0.01) / (m[k] + 0.03)) AS lift FROM cs0 c JOIN csm USING (clip_id)")
table("csf", """SELECT clip_id, sec, [own] AS used, own AS pick, CAST(0 AS INTEGER) AS prev FROM cs1 WHERE sec = 0
  UNION ALL SELECT clip_id, sec, CASE WHEN list_contains(used, best) THEN used ELSE list_append(used, best) END, best, pick FROM (
    SELECT *, CASE WHEN list_max(sc) > -1 THEN list_position(sc, list_max(sc)) ELSE own END AS best FROM (
      SELECT f.clip_id, f.used, f.pick, c.sec, c.own, list_transform(range(1, len(c.lift) + 1), lambda k: CASE WHEN k = f.pick OR (len(f.used) >= 4 AND NOT list_contains(f.used, k)) THEN -1 ELSE c.lift[k] * CASE WHEN k = f.prev THEN 0.5 ELSE 1 END END) AS sc
      FROM csf f JOIN cs1 c ON c.clip_id = f.clip_id AND c.sec = f.sec + 1))""")
table("cslog", """SELECT c.clip_id, c.unit, CASE WHEN c.own = f.prev THEN 'same caption style as the previous section' ELSE 'ranked by lift over the clip''s average' END AS rule, c.labels[c.own] AS was, c.labels[f.pick] AS now
  FROM cs1 c JOIN csf f USING (clip_id, sec) WHERE c.sec > 0 AND f.pick <> c.own""")


@query("caption_style_log", "WITH RECURSIVE x AS (SELECT * FROM cslog) SELECT * FROM x")
def caption_style_log(c):
    s = style_secs(c).select("clip_id", "sec", "unit", "pick").join(styles(c).filter("rule IS NOT NULL"), ["clip_id", "sec"])
    return s.select("clip_id", "unit", "rule", F.col("pick").alias("was"), F.col("style").alias("now"))


@query("caption_style_sections", """
WITH RECURSIVE l AS (SELECT clip_id, max(sec) AS fin FROM cs1 GROUP BY clip_id),
x AS (SELECT c.clip_id, c.sec, CASE WHEN c.sec = 0 THEN 0 ELSE c.start_us END AS s, CASE WHEN c.sec = l.fin THEN greatest(d.duration_us, c.end_us) ELSE c.end_us END AS e, f.pick, c.labels[f.pick] AS style, c.sec > 0 AND f.pick <> c.own AS changed
  FROM cs1 c JOIN csf f USING (clip_id, sec) JOIN l USING (clip_id) JOIN clips d USING (clip_id)),
y AS (SELECT *, CASE WHEN pick = lag(pick) OVER (PARTITION BY clip_id ORDER BY sec) THEN 0 ELSE 1 END AS b FROM x),
z AS (SELECT *, sum(b) OVER (PARTITION BY clip_id ORDER BY sec) - 1 AS k FROM y)
SELECT clip_id, CAST(k AS BIGINT) AS k, min(s) AS start_us, max(e) AS end_us, min(style) AS style, count(*) FILTER (changed) AS n_changed FROM z GROUP BY clip_id, k""")
def caption_style_sections(c):
    return D.caption_sections(style_secs(c).select("clip_id", "sec", "start_us", "end_us"), styles(c), style_whole(c), c.clips.select("clip_id", "duration_us"))


table("tr0", """SELECT u.clip_id, u.unit, u.start_us, CASE WHEN u.unit % 3 = 0 THEN t.label WHEN t.conf >= 0.4 AND coalesce(cam.label <> lag(cam.label) OVER (PARTITION BY u.clip_id ORDER BY u.unit), false) THEN t.label ELSE 'hard_cut' END AS wanted
  FROM units u JOIN top t ON t.clip_id = u.clip_id AND t.unit = u.unit AND t.question = 'transition' JOIN top cam ON cam.clip_id = u.clip_id AND cam.unit = u.unit AND cam.question = 'camera'""")
TRANS = CUTPTS + """,
tr1 AS (SELECT *, wanted <> 'hard_cut' AND NOT EXISTS (SELECT 1 FROM cutpts p WHERE p.clip_id = t.clip_id AND abs(p.at_us - t.start_us) < 400000) AS clear FROM tr0 t),
tr2 AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY start_us) AS rn FROM tr1 WHERE clear),
tr3 AS (SELECT clip_id, rn, start_us AS last, true AS ok FROM tr2 WHERE rn = 1 UNION ALL SELECT x.clip_id, x.rn, CASE WHEN x.start_us - t.last >= 5000000 THEN x.start_us ELSE t.last END, x.start_us - t.last >= 5000000 FROM tr3 t JOIN tr2 x ON x.clip_id = t.clip_id AND x.rn = t.rn + 1),
tr4 AS (SELECT t2.clip_id, t2.unit FROM tr2 t2 JOIN tr3 USING (clip_id, rn) WHERE ok)"""


@query("shot_transitions", "WITH RECURSIVE " + TRANS + """ SELECT t.clip_id, t.unit, CASE WHEN k.unit IS NOT NULL THEN wanted ELSE 'hard_cut' END AS transition, wanted,
  CASE WHEN wanted = 'hard_cut' THEN NULL WHEN NOT clear THEN 'a clean cut is already here' WHEN k.unit IS NULL THEN 'transition effects at least 5 s apart' END AS rule FROM tr1 t LEFT JOIN tr4 k USING (clip_id, unit)""")
def shot_transitions(c):
    from ..functions.seq import neighbours
    conf = F.array_max(F.transform("transition_d", lambda x: x["prob"]))
    s = c.units.join(dists(c).select("clip_id", "unit", D.best("transition_d").alias("pick"), conf.alias("confidence"), D.best("camera_d").alias("cam")), ["clip_id", "unit"])
    s = neighbours(s, "unit", {"pc": ("cam", -1)}).select(
        "clip_id", "unit", "start_us", (F.col("unit") % 3 == 0).alias("first_of_beat"), F.col("pick").alias("beat_transition"), "pick", "confidence",
        F.coalesce(F.col("cam") != F.col("pc"), F.lit(False)).alias("camera_changed"))
    return D.shot_transitions(s, K.cut_points(c.keeps))


@query("sound_placement", f"""WITH RECURSIVE so AS (SELECT clip_id, (((start_us * 60 + 1000000) // 2000000) * 2000000 + 30) // 60 AS at_us, arg_min(label, unit) AS type FROM units JOIN top USING (clip_id, unit)
  WHERE question = 'sfx' AND label IN {L(fixed.SOUND_TYPES)} AND conf >= 0.45 GROUP BY ALL),
so1 AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY at_us) AS rn FROM so),
so2 AS (SELECT clip_id, rn, at_us AS last, true AS ok FROM so1 WHERE rn = 1 UNION ALL SELECT x.clip_id, x.rn, CASE WHEN x.at_us - t.last >= 2500000 THEN x.at_us ELSE t.last END, x.at_us - t.last >= 2500000 FROM so2 t JOIN so1 x ON x.clip_id = t.clip_id AND x.rn = t.rn + 1)
SELECT clip_id, at_us, type, -16 AS gain_db FROM so1 JOIN so2 USING (clip_id, rn) WHERE ok""")
def sound_placement(c):
    conf = F.array_max(F.transform("sfx_d", lambda x: x["prob"]))
    return D.place_sounds(c.units.join(dists(c).select("clip_id", "unit", D.best("sfx_d").alias("pick"), conf.alias("confidence")), ["clip_id", "unit"]))


# ---- structure -------------------------------------------------------------------------------------
table("tdist", "SELECT clip_id, unit, label, label_ord, prob, label IN " + L(fixed.UNDER_CHIN_TEMPLATES) + " AS under FROM answers WHERE question = 'template'")
table("bestlay", "SELECT clip_id, unit, arg_max(label, (prob, -label_ord)) FILTER (under) AS full_t, arg_max(label, (prob, -label_ord)) FILTER (NOT under) AS split_t FROM tdist GROUP BY clip_id, unit")
table("utext", "SELECT u.clip_id, u.unit, string_agg(w.text, ' ' ORDER BY w.i) AS text FROM units u JOIN words w ON w.clip_id = u.clip_id AND w.i BETWEEN u.first_i AND u.last_i GROUP BY u.clip_id, u.unit")
table("struct0", f"""SELECT *, CASE WHEN template IS NOT NULL AND template NOT IN {L(fixed.UNDER_CHIN_TEMPLATES)} THEN 'split' ELSE 'full' END AS layout FROM (
  SELECT u.clip_id, u.unit, u.start_us, u.end_us, p.graphic AS needs, p.graphic >= 0.5 OR u.unit = 0 AS has_visual, CASE WHEN p.graphic >= 0.5 OR u.unit = 0 THEN p.template END AS template, p.overlay = 'giant_word' AND p.graphic < 0.5 AS covered
  FROM units u JOIN pick_rows p USING (clip_id, unit))""")


def _struct0(c):
    words_in = S.unit_words(c.units, c.words).groupBy("clip_id", "unit").agg(S.joined("text").alias("text"))
    d = dists(c).select("clip_id", "unit", "template_d", D.best("transition_d").alias("transition"), D.best("text_effect_d").alias("text_effect"),
                        D.prob_of("camera_d", "punch").alias("p_punch"))
    say = words_in.select("clip_id", "unit", text.is_promotable("text").alias("promotable"))
    b = c.units.join(picks(c), ["clip_id", "unit"]).join(say, ["clip_id", "unit"]).join(d, ["clip_id", "unit"])
    b = b.select("clip_id", "unit", "start_us", "end_us", F.col("graphic").alias("needs"), "template", "template_d",
                 ((F.col("overlay") == "giant_word") & (F.col("graphic") < 0.5)).alias("covered"), "promotable", "transition", "text_effect", "p_punch")
    return T.initial_structure(b)


struct0 = _lazy("struct0", _struct0)
promoted = _lazy("promoted", lambda c: T.promote_dead_runs(struct0(c)))
smoothed = _lazy("smoothed", lambda c: T.smooth_layout(struct0(c)))
varied = _lazy("varied", lambda c: T.vary_templates(struct0(c)))
CORE = ("clip_id", "unit", "has_visual", "template", "layout")


@query("initial_structure", "SELECT clip_id, unit, has_visual, template, layout FROM struct0")
def initial_structure(c):
    return struct0(c).select(*CORE)


@query("dead_runs", """SELECT clip_id, min(unit) AS first_unit, max(unit) AS last_unit, max(end_us) - min(start_us) AS dur_us FROM (
  SELECT *, unit - row_number() OVER (PARTITION BY clip_id ORDER BY unit) AS g FROM struct0 WHERE NOT has_visual AND NOT covered) GROUP BY clip_id, g""")
def dead_runs(c):
    return T.dead_runs(struct0(c)).filter("run IS NOT NULL").groupBy("clip_id", "run").agg(
        F.min("unit").alias("first_unit"), F.max("unit").alias("last_unit"), (F.max("end_us") - F.min("start_us")).alias("dur_us")).drop("run")


PROMO = f"""
pt AS (SELECT s.*, len(list_filter(string_split(regexp_replace(lower(x.text), '[^a-z0-9'']+', ' ', 'g'), ' '), lambda t: t <> '' AND t NOT IN {L(fixed.FILLER_STRUCTURE + fixed.STOP_STRUCTURE)})) >= 3 AS promotable FROM struct0 s JOIN utext x USING (clip_id, unit)),
dr AS (SELECT clip_id, min(unit) AS a, max(unit) AS b FROM (SELECT *, unit - row_number() OVER (PARTITION BY clip_id ORDER BY unit) AS g FROM pt WHERE NOT has_visual AND NOT covered) GROUP BY clip_id, g),
sp AS (SELECT clip_id, a, b, CAST(NULL AS BIGINT) AS up FROM dr
  UNION ALL
  SELECT q.clip_id, CASE WHEN side = 0 THEN q.a ELSE q.k + 1 END, CASE WHEN side = 0 THEN q.k - 1 ELSE q.b END, q.k
  FROM (SELECT s.clip_id, s.a, s.b, (SELECT arg_max(p.unit, (p.needs, -p.unit)) FROM pt p WHERE p.clip_id = s.clip_id AND p.unit BETWEEN s.a AND s.b AND p.promotable) AS k
     FROM sp s WHERE s.a <= s.b AND (SELECT max(p.end_us) - min(p.start_us) FROM pt p WHERE p.clip_id = s.clip_id AND p.unit BETWEEN s.a AND s.b) > 6000000) q
  CROSS JOIN (SELECT unnest([0, 1]) AS side) WHERE q.k IS NOT NULL),
ups AS (SELECT DISTINCT clip_id, up AS unit FROM sp WHERE up IS NOT NULL)"""


@query("promoted_structure", "WITH RECURSIVE " + PROMO + """ SELECT p.clip_id, p.unit, has_visual OR u.unit IS NOT NULL AS has_visual, CASE WHEN u.unit IS NOT NULL THEN CASE WHEN layout = 'full' THEN full_t ELSE split_t END ELSE template END AS template, layout
 FROM pt p LEFT JOIN ups u USING (clip_id, unit) JOIN bestlay b ON b.clip_id = p.clip_id AND b.unit = p.unit""")
def promoted_structure(c):
    return promoted(c).select(*CORE)


# the published rule as written: always the leftmost run that is too short, until none is left
SMOOTH = """
lr0 AS (SELECT clip_id, list({'l': layout, 'a': start_us, 'b': end_us, 'c': covered, 'u': [unit]} ORDER BY unit) AS us FROM struct0 GROUP BY clip_id),
lr AS (SELECT clip_id, list({'l': layout, 'a': a, 'b': b, 'c': c, 'f': f, 'z': z} ORDER BY f) AS rs, CAST([] AS BIGINT[]) AS flips, 0 AS step FROM (
   SELECT clip_id, any_value(layout) AS layout, min(start_us) AS a, max(end_us) AS b, max(covered) AS c, min(unit) AS f, max(unit) AS z FROM (
     SELECT *, sum(nw) OVER (PARTITION BY clip_id ORDER BY unit) AS run FROM (SELECT *, CASE WHEN layout = lag(layout) OVER (PARTITION BY clip_id ORDER BY unit) THEN 0 ELSE 1 END AS nw FROM struct0)) GROUP BY clip_id, run) GROUP BY clip_id
  UNION ALL
  SELECT clip_id, list_concat(rs[1:lo - 1], [{'l': CASE WHEN r > 1 THEN rs[r - 1].l ELSE rs[r + 1].l END, 'a': rs[lo].a, 'b': rs[hi].b, 'c': list_bool_or(list_transform(rs[lo:hi], lambda x: x.c)), 'f': rs[lo].f, 'z': rs[hi].z}], rs[hi + 1:]),
    list_concat(flips, generate_series(rs[r].f, rs[r].z)), step + 1
  FROM (SELECT *, greatest(1, r - 1) AS lo, least(len(rs), r + 1) AS hi FROM (
     SELECT *, list_position(list_transform(rs, lambda x: (x.b - x.a < CASE WHEN x.l = 'split' THEN 2500000 ELSE 1500000 END) AND NOT (x.l = 'full' AND x.c)), true) AS r FROM lr WHERE len(rs) > 1) WHERE r > 0)),
lend AS (SELECT * FROM lr QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY step DESC) = 1),
lun AS (SELECT clip_id, unnest(rs) AS x FROM lend),
lfl AS (SELECT DISTINCT clip_id, unnest(flips) AS unit FROM lend)"""


@query("smoothed_structure", "WITH RECURSIVE " + SMOOTH + """ SELECT s.clip_id, s.unit, s.has_visual, CASE WHEN f.unit IS NOT NULL AND s.has_visual THEN CASE WHEN x.l = 'full' THEN full_t ELSE split_t END ELSE s.template END AS template, x.l AS layout
 FROM struct0 s JOIN lun ON lun.clip_id = s.clip_id AND s.unit BETWEEN x.f AND x.z LEFT JOIN lfl f ON f.clip_id = s.clip_id AND f.unit = s.unit JOIN bestlay b ON b.clip_id = s.clip_id AND b.unit = s.unit""")
def smoothed_structure(c):
    return smoothed(c).select(*CORE)


VARY = """
vx AS (SELECT s.*, d.ps, lead(s.template) OVER (PARTITION BY s.clip_id ORDER BY s.unit) AS nxt, row_number() OVER (PARTITION BY s.clip_id ORDER BY s.unit) AS rn FROM struct0 s JOIN (
  SELECT clip_id, unit, list({'t': label, 'p': prob, 'o': label_ord, 'u': under} ORDER BY prob DESC, label_ord) AS ps FROM tdist GROUP BY clip_id, unit) d USING (clip_id, unit)),
vf AS (SELECT clip_id, rn, CAST(NULL AS VARCHAR) AS older, CAST(NULL AS VARCHAR) AS prev, template AS cur FROM vx WHERE rn = 1
  UNION ALL
  SELECT x.clip_id, x.rn, f.prev,
   CASE WHEN clash AND back THEN coalesce(list_filter(p.ps, lambda q: q.u = (p.layout = 'full') AND q.t <> x.template AND (f.prev IS NULL OR q.t <> f.prev))[1].t, x.template) ELSE f.cur END,
   CASE WHEN clash AND NOT back THEN coalesce(list_filter(x.ps, lambda q: q.u = (x.layout = 'full') AND q.t <> x.template AND (x.nxt IS NULL OR q.t <> x.nxt))[1].t, x.template) ELSE x.template END
  FROM vf f JOIN vx x ON x.clip_id = f.clip_id AND x.rn = f.rn + 1 JOIN vx p ON p.clip_id = f.clip_id AND p.rn = f.rn,
  LATERAL (SELECT coalesce(x.template = f.cur, false) AS clash, coalesce(list_filter(p.ps, lambda q: q.t = x.template)[1].p < list_filter(x.ps, lambda q: q.t = x.template)[1].p, false) AS back)),
vfin AS (SELECT x.clip_id, x.unit, coalesce(n.rn IS NOT NULL, false) AS has_next, CASE WHEN n.rn IS NOT NULL THEN n.prev ELSE f.cur END AS template, x.has_visual, x.layout FROM vx x JOIN vf f USING (clip_id, rn) LEFT JOIN vf n ON n.clip_id = x.clip_id AND n.rn = x.rn + 1)"""


@query("varied_structure", "WITH RECURSIVE " + VARY + " SELECT clip_id, unit, has_visual OR template IS NOT NULL AS has_visual, template, layout FROM vfin")
def varied_structure(c):
    return varied(c).select(*CORE)


def streak_sql(q):
    return f"""WITH RECURSIVE sx AS (SELECT clip_id, unit, label, row_number() OVER (PARTITION BY clip_id ORDER BY unit) AS rn FROM (SELECT t.clip_id, t.unit, CASE WHEN t.unit % 5 < 4 THEN CASE WHEN (t.clip_id + t.unit // 5) % 2 = 0 THEN '{fixed.MENUS[q][1]}' ELSE '{fixed.MENUS[q][2]}' END ELSE t.label END AS label FROM top t WHERE question = '{q}')),
sa AS (SELECT s.clip_id, s.unit, arg_max(a.label, (a.prob, -a.label_ord)) AS alt FROM sx s JOIN answers a ON a.clip_id = s.clip_id AND a.unit = s.unit AND a.question = '{q}' AND a.label <> s.label GROUP BY s.clip_id, s.unit),
sf AS (SELECT clip_id, rn, unit, label, 1 AS n FROM sx WHERE rn = 1 UNION ALL
 SELECT x.clip_id, x.rn, x.unit, CASE WHEN x.label = f.label AND f.n >= 2 THEN a.alt ELSE x.label END, CASE WHEN x.label = f.label AND f.n < 2 THEN f.n + 1 ELSE 1 END
 FROM sf f JOIN sx x ON x.clip_id = f.clip_id AND x.rn = f.rn + 1 JOIN sa a ON a.clip_id = x.clip_id AND a.unit = x.unit)
SELECT clip_id, unit, label FROM sf"""


def _streaks(c, q):
    a, b = fixed.MENUS[q][1:3]
    u = dists(c).select("clip_id", "unit", F.when(F.col("unit") % 5 < 4, F.expr(f"IF((clip_id + unit DIV 5) % 2 = 0, '{a}', '{b}')")).otherwise(D.best(f"{q}_d")).alias("label"))
    return D.break_streaks(u, dists(c), q)


@query("effect_streaks", streak_sql("text_effect"))
def effect_streaks(c):
    return _streaks(c, "text_effect")


@query("transition_streaks", streak_sql("transition"))
def transition_streaks(c):
    return _streaks(c, "transition")


@query("transition_in", """SELECT s.clip_id, s.unit, CASE WHEN lag(layout) OVER w IS NOT NULL AND (layout <> lag(layout) OVER w OR template IS DISTINCT FROM lag(template) OVER w) THEN t.label ELSE 'hard_cut' END AS transition_in
 FROM struct0 s JOIN top t ON t.clip_id = s.clip_id AND t.unit = s.unit AND t.question = 'transition' WINDOW w AS (PARTITION BY s.clip_id ORDER BY s.unit)""")
def transition_in(c):
    return T.transition_in(struct0(c)).select("clip_id", "unit", "transition_in")


table("pw0", "SELECT s.clip_id, s.unit, s.layout = 'full' AND a.prob >= 0.6 AS wants, row_number() OVER (PARTITION BY s.clip_id ORDER BY s.unit) AS rn FROM struct0 s JOIN answers a ON a.clip_id = s.clip_id AND a.unit = s.unit AND a.question = 'camera' AND a.label = 'punch'")


def punches(c):
    # the threshold is lower than the operator's default so that the flat test distributions reach it
    return D.punch_flags(struct0(c).select("clip_id", "unit", ((F.col("layout") == "full") & (F.col("p_punch") >= 0.6)).alias("wants")))


@query("punch_flags", """WITH RECURSIVE pp AS (SELECT clip_id, rn, unit, wants AS punch FROM pw0 WHERE rn = 1 UNION ALL SELECT x.clip_id, x.rn, x.unit, x.wants AND NOT p.punch FROM pp p JOIN pw0 x ON x.clip_id = p.clip_id AND x.rn = p.rn + 1)
SELECT clip_id, unit, punch FROM pp""")
def punch_flags(c):
    return punches(c)


HOOKED = f"""
ht AS (SELECT s.*, t.label AS tr, row_number() OVER w AS rn, CASE WHEN lag(layout) OVER w IS NOT NULL AND (layout <> lag(layout) OVER w OR template IS DISTINCT FROM lag(template) OVER w) THEN t.label ELSE 'hard_cut' END AS tin FROM struct0 s JOIN top t ON t.clip_id = s.clip_id AND t.unit = s.unit AND t.question = 'transition' WINDOW w AS (PARTITION BY s.clip_id ORDER BY s.unit)),
h1 AS (SELECT x.clip_id, x.unit, x.tin, x.start_us, x.end_us, x.start_us < hook_end_us AS ins, CASE WHEN x.start_us < hook_end_us THEN 'full' ELSE layout END AS layout, x.start_us < hook_end_us AND x.end_us <= hook_end_us + 150000 AS sh,
  CASE WHEN x.start_us < hook_end_us AND x.end_us <= hook_end_us + 150000 THEN NULL WHEN x.start_us < hook_end_us AND layout = 'split' AND template IS NOT NULL THEN full_t ELSE template END AS template, x.has_visual, hook_end_us FROM ht x JOIN hooks USING (clip_id) JOIN bestlay b ON b.clip_id = x.clip_id AND b.unit = x.unit)
SELECT clip_id, unit, has_visual AND NOT sh AS has_visual, template, layout, CASE WHEN ins AND NOT sh AND has_visual THEN hook_end_us END AS visual_from_us,
  CASE WHEN ins OR (coalesce(lag(ins) OVER w, false) AND layout = lag(layout) OVER w AND template IS NOT DISTINCT FROM lag(template) OVER w) THEN 'hard_cut' ELSE tin END AS transition_in FROM h1 WINDOW w AS (PARTITION BY clip_id ORDER BY unit)"""


SHOWN = ("clip_id", "unit", "start_us", "end_us", "has_visual", "template", "layout", "transition", "full_template")


def _hooked(c):
    s = T.transition_in(T.full_templates(struct0(c)).select(*SHOWN)).join(punches(c), ["clip_id", "unit"])
    return T.apply_hook(s, hook(c))


hooked = _lazy("hooked", _hooked)


@query("hook_structure", "WITH " + HOOKED.strip())
def hook_structure(c):
    return hooked(c).select("clip_id", "unit", "has_visual", "template", "layout", "visual_from_us", "transition_in")


@query("full_structure")
def full_structure(c):
    """All structure passes in order, on the planned overlays."""
    s = struct0(c).drop("needs", "template", "has_visual", "layout", "covered").join(
        settled(c).select("clip_id", "unit", "needs", "template", F.col("giant").isNotNull().alias("covered")), ["clip_id", "unit"])
    s = stage(T.initial_structure(s, force_first=False), "full0")
    s = stage(T.promote_dead_runs(s), "full1")
    s = stage(T.smooth_layout(s), "full2")
    s = stage(T.vary_templates(s), "full3")
    s = T.full_templates(s).select(*SHOWN, "p_punch")
    s = s.join(D.break_streaks(s.select("clip_id", "unit", F.col("transition").alias("label")), dists(c), "transition").withColumnRenamed("label", "__tr"), ["clip_id", "unit"])
    s = T.transition_in(s.withColumn("transition", F.col("__tr")).drop("__tr"))
    p = D.punch_flags(s.select("clip_id", "unit", ((F.col("layout") == "full") & (F.col("p_punch") >= fixed.PUNCH_MIN)).alias("wants")))
    return T.apply_hook(s.join(p, ["clip_id", "unit"]), hook(c)).select(
        "clip_id", "unit", "start_us", "end_us", "has_visual", "template", "layout", "visual_from_us", "transition_in", "punch")


FLASH = """
fl0 AS (SELECT s.clip_id, (((start_us * 60 + 1000000) // 2000000) * 2000000 + 30) // 60 AS at_us, layout <> pl AS ch FROM (SELECT *, lag(layout) OVER (PARTITION BY clip_id ORDER BY unit) AS pl FROM struct0) s JOIN hooks USING (clip_id) WHERE pl IS NOT NULL AND start_us >= hook_end_us + 1000000),
fl1 AS (SELECT clip_id, at_us, gap, most, row_number() OVER (PARTITION BY clip_id ORDER BY at_us) AS rn FROM (SELECT f.clip_id, at_us, CASE WHEN has THEN 4000000 ELSE 8000000 END AS gap, CASE WHEN has THEN 4 ELSE 3 END AS most FROM fl0 f JOIN (SELECT clip_id, bool_or(ch) AS has FROM fl0 GROUP BY clip_id) USING (clip_id) WHERE ch OR NOT has)),
fl2 AS (SELECT clip_id, rn, at_us AS last, 1 AS n, true AS ok FROM fl1 WHERE rn = 1 UNION ALL
  SELECT x.clip_id, x.rn, CASE WHEN x.at_us - f.last >= x.gap AND f.n < x.most THEN x.at_us ELSE f.last END, f.n + CASE WHEN x.at_us - f.last >= x.gap AND f.n < x.most THEN 1 ELSE 0 END, x.at_us - f.last >= x.gap AND f.n < x.most FROM fl2 f JOIN fl1 x ON x.clip_id = f.clip_id AND x.rn = f.rn + 1)
SELECT clip_id, last AS at_us FROM fl2 WHERE ok"""


@query("flash_times", "WITH RECURSIVE " + FLASH)
def flash_times(c):
    return D.flash_times(struct0(c), hook(c))


# ---- change events ----------------------------------------------------------------------------------
table("evshots", """SELECT u.clip_id, u.unit, u.start_us, u.end_us, s.layout, c.label AS camera, p.overlay, CASE WHEN p.overlay IN ('card', 'keyword_pill') THEN CAST(u.unit // 2 AS VARCHAR) ELSE '' END AS card_key
  FROM units u JOIN struct0 s USING (clip_id, unit) JOIN pick_rows p USING (clip_id, unit) JOIN top c ON c.clip_id = u.clip_id AND c.unit = u.unit AND c.question = 'camera'""")
EV = CUTPTS + """,
ev AS (SELECT clip_id, start_us AS at_us FROM (SELECT *, lag(camera) OVER w AS pc, lag(layout) OVER w AS pl, lag(overlay) OVER w AS po, lag(card_key) OVER w AS pk FROM evshots WINDOW w AS (PARTITION BY clip_id ORDER BY unit)) WHERE pl IS NULL OR camera <> pc OR layout <> pl OR overlay <> po OR card_key <> pk
  UNION ALL SELECT clip_id, unnest(generate_series(start_us + 1500000, end_us - 300001, 1500000)) FROM evshots WHERE camera IN ('push_in', 'drift')
  UNION ALL SELECT c.clip_id, c.at_us FROM cutpts c JOIN (SELECT clip_id, min(start_us) AS lo, max(end_us) AS hi FROM units GROUP BY clip_id) USING (clip_id) WHERE at_us > lo AND at_us < hi),
ends AS (SELECT clip_id, min(start_us) AS lo, max(end_us) AS hi FROM units GROUP BY clip_id),
still AS (SELECT clip_id, max(at_us - prev) AS gap_us, arg_min(prev, (prev - at_us, prev)) AS at_us FROM (SELECT clip_id, at_us, lag(at_us) OVER (PARTITION BY clip_id ORDER BY at_us) AS prev FROM (SELECT * FROM ev UNION ALL SELECT clip_id, lo FROM ends UNION ALL SELECT clip_id, hi FROM ends)) WHERE prev IS NOT NULL GROUP BY clip_id)"""


def _event_shots(c):
    return c.units.join(struct0(c).select("clip_id", "unit", "layout"), ["clip_id", "unit"]).join(picks(c).select("clip_id", "unit", "overlay"), ["clip_id", "unit"]).join(
        dists(c).select("clip_id", "unit", D.best("camera_d").alias("camera")), ["clip_id", "unit"]).withColumn(
        "card_key", F.when(F.col("overlay").isin("card", "keyword_pill"), F.expr("CAST(unit DIV 2 AS STRING)")).otherwise("")) \
        .select("clip_id", "unit", "start_us", "end_us", "layout", "camera", "overlay", "card_key")


event_shots = _lazy("event_shots", _event_shots)
events = _lazy("change_events", lambda c: D.change_events(event_shots(c), K.cut_points(c.keeps)))


@query("change_events", "WITH RECURSIVE " + EV + " SELECT * FROM ev")
def change_events(c):
    return events(c)


@query("longest_still", "WITH RECURSIVE " + EV + " SELECT * FROM still")
def longest_still(c):
    return D.longest_still(events(c), event_shots(c))


@query("rhythm_report", "WITH RECURSIVE " + EV + """ SELECT s.clip_id, floor(gap_us / 1e6 * 100 + 0.5) / 100 AS max_gap_s,
  floor(coalesce(cs, 0) / greatest(1000000, hi - greatest(0, hook_end_us)) * 100 + 0.5) / 100 AS card_share FROM still s JOIN hooks USING (clip_id) JOIN ends USING (clip_id)
  LEFT JOIN (SELECT clip_id, CAST(sum(end_us - start_us) AS BIGINT) AS cs FROM evshots WHERE overlay IN ('card', 'keyword_pill') GROUP BY clip_id) k USING (clip_id)""")
def rhythm_report(c):
    return D.rhythm_report(event_shots(c), events(c), hook(c))


@query("assembled_shots")
def assembled_shots(c):
    secs = caption_style_sections(c)
    beats = hooked(c).select("clip_id", F.col("unit").alias("beat"), "start_us", "end_us", "layout", "template", "visual_from_us")
    r = D.assemble_shots(c.units.select("clip_id", "unit", "start_us", "end_us"), beats, planned(c), secs, hook(c))
    return r.withColumn("overrides", F.array_join("overrides", " | "))
