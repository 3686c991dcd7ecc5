"""From classifier answers to consistent picks per shot.

``shots`` are rows (clip_id, unit, start_us, end_us, ...). Distributions are arrays in menu order, so
argmax with the first label on a tie is the largest (prob, -position)."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.intervals import overlap_join, points_in
from ..functions.seq import fresh, neighbours, numbered, running, spaced
from ..functions.stage import stage
from . import automaton, rounds
from .paths import path

CAMERAS = fixed.MENUS["camera"]


def best(dist: str, without=None, only=None) -> Column:
    """Most likely label of a distribution column array<struct<label_ord, label, prob>>."""
    d = F.col(dist)
    if without is not None:
        ex = without if isinstance(without, Column) else F.array(*[F.lit(x) for x in without])
        d = F.filter(d, lambda x: ~F.array_contains(ex, x["label"]))
    if only is not None:
        d = F.filter(d, lambda x: F.array_contains(only, x["label"]))
    return F.array_max(F.transform(d, lambda x: F.struct(x["prob"].alias("p"), (-x["label_ord"]).alias("o"), x["label"].alias("label"))))["label"]


def prob_of(dist: str, label) -> Column:
    """Probability of one label, 0 when absent."""
    lab = F.lit(label) if isinstance(label, str) else label
    hit = F.filter(F.col(dist), lambda x: x["label"] == lab)
    return F.coalesce(F.get(hit, F.lit(0))["prob"], F.lit(0.0))


def distributions(answers: DataFrame, questions) -> DataFrame:
    """One row per unit with a ``<question>_d`` array per question (a unit has a few dozen labels)."""
    item = F.struct("label_ord", "label", "prob")
    return answers.filter(F.col("question").isin(list(questions))).groupBy("clip_id", "unit").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("question") == q, item))).alias(f"{q}_d") for q in questions])


def overlays(dists: DataFrame) -> DataFrame:
    """(clip_id, unit, overlay, graphic, template): overlay pick, share of graphics, reconciled template."""
    graphic = F.least(F.lit(1.0), prob_of("overlay_d", "card") + prob_of("overlay_d", "keyword_pill"))
    o = dists.select("*", best("overlay_d").alias("overlay"), graphic.alias("graphic"), best("template_d").alias("__t"))
    tpl = F.when(F.col("overlay") == "keyword_pill", "keyword_pill") \
        .when((F.col("overlay") == "card") & (F.col("__t") == "keyword_pill"), best("template_d", without=["keyword_pill"])).otherwise(F.col("__t"))
    return o.withColumn("template", tpl).drop("__t")


def next_best(dists: DataFrame, dist: str, excluded: DataFrame) -> DataFrame:
    """Best label outside a per-unit exclusion list; NULL when nothing is left."""
    ex = excluded.groupBy("clip_id", "unit").agg(F.collect_set("label").alias("__ex"))
    d = dists.join(fresh(ex), ["clip_id", "unit"], "left")
    none = F.array().cast("array<string>")
    return d.withColumn("__ex", F.coalesce("__ex", none)).select("clip_id", "unit", best(dist, without=F.col("__ex")).alias("label"))


def label_lift(answers: DataFrame, in_hook: DataFrame) -> DataFrame:
    """answers + lift: probability against the clip's mean outside the hook. Absent labels count as 0."""
    a = answers.join(fresh(in_hook.select("clip_id", "unit", "hook")), ["clip_id", "unit"])
    out = ~F.col("hook")
    s = a.groupBy("clip_id", "question", "label").agg(F.sum(F.when(out, F.col("prob"))).alias("s"))
    n = in_hook.groupBy("clip_id").agg(F.count_if(~F.col("hook")).alias("n"))
    m = s.join(fresh(n), "clip_id").select("clip_id", "question", "label", (F.coalesce("s", F.lit(0.0)) / F.greatest("n", F.lit(1))).alias("mean"))
    return a.join(fresh(m), ["clip_id", "question", "label"]).withColumn(
        "lift", (F.col("prob") + fixed.LIFT_P) / (F.col("mean") + fixed.LIFT_MEAN))


def hook_end(words: DataFrame, shots: DataFrame, clips: DataFrame) -> DataFrame:
    """Where the opening ends: first sentence end in 2.4..4.2 s + 0.1, else the first shot start there, else 3.0 s."""
    rng = lambda c: F.col(c).between(fixed.HOOK_MIN_US, fixed.HOOK_MAX_US)
    from ..functions import text
    s = words.filter(rng("end_us") & text.ends_sentence(F.trim("text"), strict=False)).groupBy("clip_id").agg(F.min_by("end_us", "i").alias("s"))
    b = shots.filter(rng("start_us")).groupBy("clip_id").agg(F.min("start_us").alias("b"))
    j = clips.select("clip_id", "duration_us").join(fresh(s), "clip_id", "left").join(fresh(b), "clip_id", "left")
    t = F.coalesce(F.col("s") + 100_000, F.col("b"), F.lit(fixed.HOOK_DEFAULT_US))
    t = F.least(t, F.greatest(F.lit(1_000_000), F.col("duration_us") - 500_000))
    return j.select("clip_id", snap30(t).alias("hook_end_us"))


def snap30(us: Column) -> Column:
    """Nearest 1/30 s, as whole microseconds."""
    frame = F.floor((us * 30 * 2 + 1_000_000) / 2_000_000)
    return F.floor((frame * 2_000_000 + 30) / 60).cast("bigint")


def opening_text(words: DataFrame, hook: DataFrame) -> DataFrame:
    from .segments import joined
    w = words.join(fresh(hook), "clip_id").filter("start_us < hook_end_us")
    return w.withColumn("text", F.trim("text")).groupBy("clip_id").agg(F.trim(F.regexp_replace(joined("text"), r"\s+", " ")).alias("text"))


def title_copy(raw: DataFrame) -> DataFrame:
    """raw (clip_id, word, line, opening) -> checked title word and line with fallbacks from the opening."""
    from ..functions import text
    tidy = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " "))
    parts = F.filter(F.transform(F.split(tidy("word"), " "), text.strip_title), lambda x: x != "")
    own = F.array_join(F.slice(parts, 1, 2), " ")
    opening = F.split("opening", r"\s+")
    stop = F.array(*[F.lit(x) for x in fixed.STOP_TITLE])
    cand = F.filter(F.transform(opening, text.strip_title), lambda x: (F.length(x) >= 3) & ~F.array_contains(stop, F.lower(x)))
    longest = F.array_max(F.transform(cand, lambda x, k: F.struct(F.length(x).alias("n"), (-k).alias("k"), x.alias("w"))))["w"]
    fall = F.substring(F.coalesce(longest, text.strip_title(F.get(opening, F.lit(0))), F.lit("")), 1, 12)
    word = F.upper(F.substring(F.when(own != "", own).otherwise(fall), 1, 14))
    line = F.regexp_replace(F.array_join(F.slice(F.split(tidy("line"), " "), 1, 7), " "), r"[.,;:]+$", "")
    spare = F.regexp_replace(F.array_join(F.slice(opening, 1, 6), " "), r"[.,;:!?]+$", "")
    return raw.select("clip_id", word.alias("word"), F.when(line != "", line).otherwise(spare).alias("line"))


# ---- overlays: cards, pills and large words ------------------------------------------------------
def best_first(cands: DataFrame, gap: int, span: int = rounds.SPAN) -> DataFrame:
    """Greedy by falling ``p`` (then unit): chosen rows lie at least ``gap`` from every better chosen one.

    cands (clip_id, unit, start_us, p)."""
    rows = cands.select("clip_id", "unit", "start_us", F.col("start_us").alias("end_us"), (-F.col("p")).alias("better"), F.lit(rounds.OPEN).alias("fate"))
    return rounds.settle(rows, gap, rounds.apart(gap), span).filter(f"fate = {rounds.YES}").select("clip_id", "unit", "start_us", (-F.col("better")).alias("p"))


def _thin_cards(shots: DataFrame, room: DataFrame, cap: float, max_dead_us: int, span: int) -> DataFrame:
    """Units whose card is dropped: least wanted first while cards cover more than ``cap`` of the time, never
    opening a bare stretch over the limit. shots (clip_id, unit, start_us, end_us, now, graphic), contiguous.

    Losing a card only lengthens bare stretches, so each card is considered once, in order, whatever the coverage;
    the coverage limit then keeps a prefix of all drops in order."""
    card, bare = F.col("now").isin("card", "keyword_pill"), F.col("now") == "none"
    dur = F.col("end_us") - F.col("start_us")
    total = shots.groupBy("clip_id").agg(F.sum(F.when(card, dur)).alias("shown"), F.min("start_us").alias("lo"), F.max("end_us").alias("hi"))
    total = stage(total.join(fresh(room), "clip_id").filter(F.col("shown") / F.col("room") > cap), "crowded")
    rows = shots.join(fresh(total), "clip_id").select(
        "clip_id", "unit", "start_us", "end_us", F.col("graphic").alias("better"), F.when(card, rounds.OPEN).otherwise(rounds.NO).alias("fate"),
        bare.alias("bare"), (~bare & ~card).alias("fixed"), (F.col("start_us") == F.col("lo")).alias("first"), (F.col("end_us") == F.col("hi")).alias("last"))
    gone = rounds.settle(rows, max_dead_us, rounds.thinned(max_dead_us), span).filter(f"fate = {rounds.YES}").withColumnRenamed("better", "graphic")
    order = running(gone.select("clip_id", "unit", "graphic", "start_us", "end_us"), "graphic", {"before": ("sum", "end_us - start_us")}, size=0.001, exclusive=True, order=["graphic", "unit"])
    return order.join(fresh(total.select("clip_id", "shown", "room")), "clip_id").filter((F.col("shown") - F.col("before")) / F.col("room") > cap) \
        .select("clip_id", "unit")


def plan_overlays(shots: DataFrame, hook: DataFrame, totals: DataFrame, cap: float = fixed.COVERAGE_CAP,
                  max_dead_us: int = fixed.DEAD_RUN_US, allow_giants: bool = True, span: int = rounds.SPAN) -> DataFrame:
    """shots (clip_id, unit, start_us, end_us, overlay, graphic, p_none..p_giant, giant_word) ->
    (clip_id, unit, overlay, giant, log): the opening stays bare, large words are spaced, cards are thinned.

    ``log`` lists 'rule: from -> to' entries in the order they fired."""
    gap = fixed.GIANT_GAP_US
    d = shots.join(fresh(hook), "clip_id").join(fresh(totals), "clip_id")
    inside = (F.col("hook_end_us") > 0) & (F.col("start_us") < F.col("hook_end_us") - 200_000)
    d = d.withColumn("now", F.when(inside, "none").otherwise(F.col("overlay"))) \
         .withColumn("late", F.col("start_us") >= F.col("hook_end_us") + fixed.GIANT_AFTER_HOOK_US) \
         .withColumn("ok", F.col("late") & F.col("giant_word").isNotNull() & F.lit(allow_giants)).withColumn("asked", F.col("now") == "giant_word")
    d = stage(d, "overlay_shots")
    cand = lambda f: f.select("clip_id", "unit", "start_us", F.col("p_giant").alias("p"))
    first = best_first(cand(d.filter("asked AND ok")), gap, span)
    # large words added to clips that run long without one
    need = d.groupBy("clip_id").agg(F.max(F.floor((F.col("duration_us") - F.col("hook_end_us")) / fixed.GIANT_EVERY_US)).alias("wanted")) \
        .join(fresh(first.groupBy("clip_id").agg(F.count("*").alias("have"))), "clip_id", "left")
    need = need.select("clip_id", (F.col("wanted") - F.coalesce("have", F.lit(0))).alias("short")).filter("short > 0")
    zone = first.select("clip_id", (F.col("start_us") - gap + 1).alias("z0"), (F.col("start_us") + gap - 1).alias("z1"))
    pts = cand(d.filter("ok")).join(fresh(need), "clip_id").drop("short").withColumn("t0", F.col("start_us")).withColumn("t1", F.col("start_us"))
    open_ = overlap_join(pts, fresh(zone), ("t0", "t1"), ("z0", "z1"), closed=True, how="left_anti").drop("t0", "t1")
    more = numbered(stage(best_first(open_, gap, span), "more_giants"), "-p", "rank", size=0.001, order=[-F.col("p"), F.col("unit")])
    more = more.join(fresh(need), "clip_id").filter("rank < short").select("clip_id", "unit")
    # an asked word without a plain spelling is too close only to better ones that were kept
    mute = d.filter("asked AND late AND giant_word IS NULL").select("clip_id", "unit", F.col("p_giant").alias("p"), F.col("start_us").alias("m0"), F.col("start_us").alias("m1"))
    rank = (F.col("k_p") > F.col("p")) | ((F.col("k_p") == F.col("p")) & (F.col("k_unit") < F.col("unit")))
    kept = first.select("clip_id", F.col("unit").alias("k_unit"), F.col("p").alias("k_p"), (F.col("start_us") - gap + 1).alias("k0"), (F.col("start_us") + gap - 1).alias("k1"))
    near = overlap_join(mute, fresh(kept), ("m0", "m1"), ("k0", "k1"), closed=True, on=rank).select("clip_id", "unit").distinct()
    flag = lambda f, name: fresh(f.select("clip_id", "unit")).withColumn(name, F.lit(True))
    j = d.join(flag(first, "kept"), ["clip_id", "unit"], "left").join(flag(more, "added"), ["clip_id", "unit"], "left").join(flag(near, "near"), ["clip_id", "unit"], "left")
    why = F.lit("no reliable face for a cut-out") if not allow_giants else \
        F.when(~F.col("late"), "giant word too close to the hook").when(F.col("giant_word").isNotNull() | F.col("near").isNotNull(), "giant words at least 8.5 s apart") \
         .otherwise("no plain word of 3 to 12 letters in this shot")
    refused = F.col("asked") & F.col("kept").isNull()
    other = F.when((F.col("p_none") >= F.col("p_card")) & (F.col("p_none") >= F.col("p_pill")), "none").when(F.col("p_card") >= F.col("p_pill"), "card").otherwise("keyword_pill")
    j = j.withColumn("was", F.col("now")).withColumn("why", F.when(refused, why)).withColumn("mid", F.when(refused, other).otherwise(F.col("now")))
    whole = lambda c: F.floor(c / 1e6 + 0.5).cast("string")
    j = j.withColumn("now", F.when(F.col("added").isNotNull(), "giant_word").otherwise(F.col("mid")))
    j = stage(j, "overlay_words")
    room = j.groupBy("clip_id").agg(F.max(F.greatest(F.lit(1_000_000), F.col("duration_us") - F.col("hook_end_us"))).alias("room"))
    gone = _thin_cards(j.select("clip_id", "unit", "start_us", "end_us", "now", "graphic"), room, cap, max_dead_us, span)
    j = j.join(flag(gone, "gone"), ["clip_id", "unit"], "left")
    arrow = lambda rule, a, b: F.concat(rule, F.lit(": "), a, F.lit(" -> "), b)
    log = F.array_compact(F.array(
        F.when((F.col("was") != F.col("overlay")), arrow(F.lit("hook window stays clean"), F.col("overlay"), F.lit("none"))),
        F.when(F.col("why").isNotNull(), arrow(F.col("why"), F.lit("giant_word"), F.col("mid"))),
        F.when(F.col("added").isNotNull(), arrow(F.concat(F.lit("no giant word in the first "), whole(F.col("start_us")), F.lit(" s of a "), whole(F.col("duration_us")),
                                                          F.lit(" s clip: best supported shot promoted")), F.col("mid"), F.lit("giant_word"))),
        F.when(F.col("gone").isNotNull(), arrow(F.lit(f"card density cap ({int(cap * 100 + 0.5)}% of the speaking time)"), F.col("now"), F.lit("none")))))
    return j.select("clip_id", "unit", F.when(F.col("gone").isNotNull(), "none").otherwise(F.col("now")).alias("overlay"),
                    F.when(F.col("kept").isNotNull() | F.col("added").isNotNull(), F.col("giant_word")).alias("giant"), log.alias("log"))


def settle_visuals(planned: DataFrame, dists: DataFrame, templates: DataFrame) -> DataFrame:
    """Needs and templates that agree with the final overlay: (clip_id, unit, overlay, giant, needs, template)."""
    p = planned.join(fresh(templates.select("clip_id", "unit", F.coalesce("graphic", F.lit(0.0)).alias("graphic"), F.col("template").alias("__t"))), ["clip_id", "unit"], "left") \
        .join(fresh(dists.select("clip_id", "unit", "template_d")), ["clip_id", "unit"], "left").withColumn("graphic", F.coalesce("graphic", F.lit(0.0)))
    card = F.col("overlay").isin("card", "keyword_pill")
    needs = F.when(card, F.greatest("graphic", F.lit(0.55))).otherwise(F.least("graphic", F.lit(0.45)))
    tpl = F.when(F.col("overlay") == "keyword_pill", "keyword_pill").when(
        (F.col("overlay") == "card") & (F.col("__t") == "keyword_pill"),
        F.coalesce(best("template_d", without=["keyword_pill"]), F.lit("big_statement"))).otherwise(F.col("__t"))
    return p.select("clip_id", "unit", "overlay", "giant", F.least(F.lit(1.0), F.greatest(F.lit(0.0), needs)).alias("needs"), tpl.alias("template"))


def hold_merge(shots: DataFrame) -> DataFrame:
    """Neighbouring shots with the same wanted template become one beat (also A-B-A around a short B).

    shots (clip_id, unit, start_us, end_us, needs, template) -> (clip_id, unit, beat) with beat = its first unit.
    A beat lasts at most a few seconds, so every shot sees the shots that could still join it and points
    at the next beat; the beats are the path of pointers."""
    s = shots.select("clip_id", "unit", "start_us", "end_us", "template", (F.col("needs") >= 0.5).alias("wants"))
    cap = F.when(F.col("template").isin(fixed.UNDER_CHIN_TEMPLATES), fixed.HOLD_UNDER_CHIN_US).otherwise(fixed.HOLD_SPLIT_US)
    open_ = s.filter("wants").filter(~F.col("template").isin(fixed.NO_HOLD_TEMPLATES)).withColumn("hi", F.col("start_us") + cap)
    later = fresh(s.select("clip_id", F.col("unit").alias("u"), F.col("start_us").alias("u0"), F.col("end_us").alias("u1"),
                           F.col("template").alias("ut"), F.col("wants").alias("uw")))
    p = points_in(later, open_, "u0", ("start_us", "hi")).filter("u > unit")
    seen = p.groupBy("clip_id", "unit").agg(
        F.first("template").alias("t"), F.first("hi").alias("hi"),
        F.array_sort(F.collect_list(F.struct("u", "u0", "u1", F.coalesce((F.col("ut") == F.col("template")) & F.col("uw"), F.lit(False)).alias("same")))).alias("ls"))
    # j: last shot taken; a pending short middle is accepted only by the same template right after it
    fold = f"""aggregate(ls, named_struct('j', unit, 'mid', false, 'done', false), (a, x) ->
        CASE WHEN a.done THEN a
             WHEN x.same AND x.u1 <= hi AND (x.u = a.j + 1 OR (a.mid AND x.u = a.j + 2)) THEN named_struct('j', x.u, 'mid', false, 'done', false)
             WHEN x.u = a.j + 1 AND x.u1 - x.u0 < {fixed.HOLD_MIDDLE_US} THEN named_struct('j', a.j, 'mid', true, 'done', false)
             ELSE named_struct('j', a.j, 'mid', false, 'done', true) END).j"""
    far = seen.select("clip_id", "unit", F.expr(fold).alias("j"))
    hops = stage(s.select("clip_id", "unit").join(fresh(far), ["clip_id", "unit"], "left").select(
        "clip_id", "unit", (F.coalesce("j", "unit") + 1).alias("nxt")), "hold_hops")
    head = path(hops, "unit", "nxt").withColumn("__h", F.col("unit"))
    m = hops.select("clip_id", "unit").join(fresh(head), ["clip_id", "unit"], "left")
    return running(m, "unit", {"beat": ("last", "__h")}).select("clip_id", "unit", "beat")


def held_beats(shots: DataFrame, beats: DataFrame, dists: DataFrame) -> DataFrame:
    """Beats with span, needs, template and the emphasis of the shot surest of the template."""
    s = shots.join(fresh(beats), ["clip_id", "unit"]).join(fresh(dists.select("clip_id", "unit", "template_d")), ["clip_id", "unit"], "left")
    s = s.withColumn("p", prob_of("template_d", F.col("template")))
    return s.groupBy("clip_id", "beat").agg(
        F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.max("unit").alias("last_unit"),
        F.max("needs").alias("needs"), F.min_by("template", "unit").alias("template"),
        F.max_by("unit", F.struct("p", -F.col("unit"))).alias("best_unit"))


# ---- cameras, captions, transitions, sounds --------------------------------------------------------
def assign_cameras(shots: DataFrame, lifts: DataFrame) -> DataFrame:
    """Camera per shot: allowed by context, never the previous one, used in the last two counts 0.15.

    shots (clip_id, unit, hook, card, giant, pick); lifts (clip_id, unit, label_ord, lift).
    State: the last two cameras."""
    n = len(CAMERAS)
    none = n                                        # "no camera yet"
    wide = lifts.groupBy("clip_id", "unit").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("label_ord", "lift"))), lambda x: x["lift"]).alias("lifts"))
    # a shot without answers is sure of its own pick
    own = F.transform(F.array(*[F.lit(c) for c in CAMERAS]), lambda x: F.when(x == F.col("pick"), 1.0).otherwise(0.0))
    d = shots.join(fresh(wide), ["clip_id", "unit"], "left").withColumn("lifts", F.coalesce("lifts", own))

    def table(pdf: pd.DataFrame) -> np.ndarray:
        lift = np.stack(pdf["lifts"].to_numpy())
        hook, card, giant = (pdf[c].to_numpy(dtype=bool) for c in ("hook", "card", "giant"))
        width = np.where(hook, 1, np.where(card, 2, np.where(giant, 3, n)))
        allowed = np.arange(n)[None, :] < width[:, None]          # menu order matches the allowed sets
        out = np.empty((len(pdf), (n + 1) ** 2), dtype=np.int64)
        for prev in range(n + 1):
            for older in range(n + 1):
                sc = lift.copy()
                for c in {prev, older} - {none}:
                    sc[:, c] *= 0.15
                sc[:, 0] += 0.0001
                if prev != none:
                    sc[width > 1, prev] = -1
                pick = np.argmax(np.where(allowed, sc, -np.inf), axis=1)
                out[:, prev * (n + 1) + older] = pick * (n + 1) + prev
        return out

    r = automaton.run(d, "unit", table, none * (n + 1) + none)
    names = F.array(*[F.lit(c) for c in CAMERAS])
    r = r.select("clip_id", "unit", F.get(names, (F.col("state") / (n + 1)).cast("int")).alias("camera"),
                 F.get(names, (F.col("state_before") / (n + 1)).cast("int")).alias("prev"))
    j = shots.join(fresh(r), ["clip_id", "unit"])
    place = F.array_position(names, F.col("pick"))
    width = F.when(F.col("hook"), 1).when(F.col("card"), 2).when(F.col("giant"), 3).otherwise(n)
    why = (F.when((place > width) & F.col("hook"), "hook window stays clean")
            .when((place > width) & F.col("card"), "a card sits under the chin, wide moves would cover it")
            .when(place > width, "a moving camera would slide the giant word off the head")
            .when((width > 1) & (F.col("pick") == F.col("prev")), "same camera as the previous shot")
            .otherwise("camera used in the last two shots, varied instead"))
    return j.select("clip_id", "unit", "camera", F.when(F.col("camera") != F.col("pick"), why).alias("rule"), "pick")


def break_streaks(units: DataFrame, dists: DataFrame, question: str, most: int = 3) -> DataFrame:
    """The third equal label in a row is re-picked from the unit's own distribution: (clip_id, unit, label)."""
    labels = fixed.MENUS[question]
    n = len(labels)
    d = units.join(fresh(dists.select("clip_id", "unit", F.transform(f"{question}_d", lambda x: x["prob"]).alias("probs"))), ["clip_id", "unit"], "left")
    # Without a distribution a unit's own choice has all the weight.
    d = d.withColumn("probs", F.coalesce("probs", F.array(*[(F.col("label") == lab).cast("double") for lab in labels])))
    where = {lab: k for k, lab in enumerate(labels)}

    def table(pdf: pd.DataFrame) -> np.ndarray:
        own = pdf["label"].map(where).to_numpy()
        probs = np.stack(pdf["probs"].to_numpy())
        rest = probs.copy()
        rest[np.arange(len(own)), own] = -np.inf
        alt = np.argmax(rest, axis=1)
        out = np.empty((len(pdf), n * (most - 1) + 1), dtype=np.int64)
        out[:, -1] = own * (most - 1)                       # nothing before
        for lab in range(n):
            for run in range(most - 1):                      # run + 1 equal labels so far
                again = own == lab
                full = again & (run == most - 2)
                out[:, lab * (most - 1) + run] = np.where(full, alt * (most - 1), np.where(again, own * (most - 1) + min(run + 1, most - 2), own * (most - 1)))
        return out

    r = automaton.run(d, "unit", table, n * (most - 1))
    return r.select("clip_id", "unit", F.get(F.array(*[F.lit(x) for x in labels]), (F.col("state") / (most - 1)).cast("int")).alias("label"))


def punch_flags(units: DataFrame) -> DataFrame:
    """Punch-ins on full shots at 0.6 or more, never two in a row: units (clip_id, unit, wants) -> punch."""
    def table(pdf: pd.DataFrame) -> np.ndarray:
        w = pdf["wants"].to_numpy(dtype=bool)
        return np.stack([w.astype("int64"), np.zeros(len(w), dtype="int64")], axis=1)
    return automaton.run(units, "unit", table, 0).select("clip_id", "unit", (F.col("state") == 1).alias("punch"))


def shot_transitions(shots: DataFrame, cuts: DataFrame) -> DataFrame:
    """shots (clip_id, unit, start_us, first_of_beat, beat_transition, pick, confidence, camera_changed) ->
    (clip_id, unit, transition, rule, wanted): effects away from cuts and at least 5 s apart."""
    want = F.when(F.col("first_of_beat"), F.col("beat_transition")).when(
        (F.col("confidence") >= fixed.TRANSITION_CONF) & F.col("camera_changed"), F.col("pick")).otherwise("hard_cut")
    s = stage(shots.withColumn("wanted", want).withColumn("s_lo", F.col("start_us")).withColumn("s_hi", F.col("start_us")), "wanted_transitions")
    c = cuts.select("clip_id", (F.col("at_us") - fixed.NEAR_CUT_US + 1).alias("c_lo"), (F.col("at_us") + fixed.NEAR_CUT_US - 1).alias("c_hi"))
    fx = s.filter("wanted <> 'hard_cut'").select("clip_id", "unit", "start_us", "s_lo", "s_hi")
    clear = stage(overlap_join(fx, fresh(c), ("s_lo", "s_hi"), ("c_lo", "c_hi"), closed=True, how="left_anti"), "clear_transitions")
    ok = spaced(clear, "start_us", fixed.TRANSITION_GAP_US).withColumn("chosen", F.lit(True))
    r = s.join(fresh(clear.select("clip_id", "unit", F.lit(True).alias("clear"))), ["clip_id", "unit"], "left").join(fresh(ok), ["clip_id", "start_us"], "left")
    chosen = F.col("clear").isNotNull() & F.col("chosen").isNotNull()
    rule = F.when(F.col("wanted") == "hard_cut", None).when(F.col("clear").isNull(), "a clean cut is already here") \
        .when(~chosen, "transition effects at least 5 s apart")
    return r.select("clip_id", "unit", F.when(chosen, F.col("wanted")).otherwise("hard_cut").alias("transition"), rule.alias("rule"), "wanted")


def place_sounds(shots: DataFrame) -> DataFrame:
    """Sure sound picks on frames, at least 2.5 s apart: shots (clip_id, unit, start_us, pick, confidence)."""
    c = shots.filter(F.col("pick").isin(fixed.SOUND_TYPES) & (F.col("confidence") >= fixed.SOUND_CONF))
    c = c.withColumn("at_us", snap30(F.col("start_us")))
    first = c.groupBy("clip_id", "at_us").agg(F.min_by("pick", "unit").alias("type"))
    first = stage(first, "sound_candidates")
    return first.join(fresh(spaced(first, "at_us", fixed.SOUND_GAP_US)), ["clip_id", "at_us"], "left_semi").withColumn("gain_db", F.lit(fixed.SOUND_GAIN_DB))


def flash_times(beats: DataFrame, hook: DataFrame) -> DataFrame:
    """Layout changes after the opening, 4 s apart, at most four; without any, beat starts 8 s apart, at most three."""
    n = neighbours(beats.select("clip_id", "unit", "start_us", "layout"), "unit", {"pl": ("layout", -1)})
    after = n.filter("pl IS NOT NULL").join(fresh(hook), "clip_id").filter(F.col("start_us") >= F.col("hook_end_us") + 1_000_000)
    after = stage(after.select("clip_id", snap30(F.col("start_us")).alias("at_us"), (F.col("layout") != F.col("pl")).alias("change")), "flash_candidates")
    changes = after.filter("change")
    rest = after.join(fresh(changes.select("clip_id").distinct()), "clip_id", "left_anti")
    def pick(d, gap, most):
        s = numbered(spaced(d, "at_us", gap), "at_us", "k", size=600_000_000)
        return s.filter(F.col("k") < most).drop("k")
    return pick(changes, fixed.FLASH_GAP_US, fixed.FLASH_MAX).unionByName(pick(rest, fixed.FLASH_FALLBACK_US, fixed.FLASH_FALLBACK_MAX))


class _StyleStates:
    """States of the caption rule: the styles used so far, the last one and the one before. State 0 is before the first."""

    def __init__(self, n: int, most: int):
        keys = [(0, n, n)] + [(m, p, q) for m in range(1, 1 << n) for p in range(n) if m >> p & 1 for q in (*range(n), n) if q == n or m >> q & 1]
        at = {k: i for i, k in enumerate(keys)}
        self.last = np.array([p for _, p, _ in keys])
        label = np.arange(n)
        used = (np.array([m for m, _, _ in keys])[:, None] >> label & 1).astype(bool)
        self.banned = (self.last[:, None] == label) | (used.sum(axis=1) >= most)[:, None] & ~used
        self.weight = np.where(np.array([q for _, _, q in keys])[:, None] == label, 0.5, 1.0)
        self.then = np.array([[at[m | 1 << x, x, p] for x in range(n)] for m, p, _ in keys])

    def picks(self, lift: np.ndarray, own: int, states: np.ndarray) -> np.ndarray:
        """States after a section for the states before it. lift: nan for styles without an answer."""
        score = np.where(self.banned[states] | np.isnan(lift), -np.inf, lift * self.weight[states])
        pick = np.where(np.isfinite(score).any(axis=1), score.argmax(axis=1), own)
        return self.then[states, pick]


def caption_styles(sections: DataFrame, probs: DataFrame, global_style: DataFrame, size: int = 256) -> DataFrame:
    """Caption style per section by lift over the clip's mean: no repeat, half weight two back, no new style beyond four, the first one
    global; a section to which nothing is left keeps its own pick: (clip_id, sec, style, rule), rule null where it is the pick.

    sections (clip_id, sec, pick), sec from 0; probs (clip_id, sec, label_ord, prob). A section without answers counts as sure of its
    pick. The rule is a machine over (styles used, last two), so sections are solved in blocks."""
    labels = fixed.MENUS["caption_style"]
    ordinal = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("pick")) - 1
    s = sections.select("clip_id", "sec", ordinal.cast("bigint").alias("own"))
    sure = s.join(fresh(probs.select("clip_id", "sec").distinct()), ["clip_id", "sec"], "left_anti").select("clip_id", "sec", F.col("own").alias("label_ord"), F.lit(1.0).alias("prob"))
    p = stage(probs.select("clip_id", "sec", "label_ord", "prob").unionByName(sure), "style_probs")
    n = sections.groupBy("clip_id").agg(F.count("*").alias("n"))
    mean = p.groupBy("clip_id", "label_ord").agg(F.sum("prob").alias("s")).join(fresh(n), "clip_id").select("clip_id", "label_ord", (F.col("s") / F.col("n")).alias("mean"))
    value = (F.col("prob") + fixed.LIFT_P) / (F.col("mean") + fixed.LIFT_MEAN)
    lift = p.join(fresh(mean), ["clip_id", "label_ord"]).groupBy("clip_id", "sec").agg(
        F.array(*[F.max(F.when(F.col("label_ord") == k, value)) for k in range(len(labels))]).alias("lifts"))
    first = global_style.select("clip_id", (F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("style")) - 1).cast("bigint").alias("whole"))
    d = s.join(fresh(lift), ["clip_id", "sec"]).join(fresh(first), "clip_id", "left").withColumn("whole", F.coalesce("whole", "own"))
    states = _StyleStates(len(labels), fixed.MAX_CAPTION_STYLES)

    def table(pdf: pd.DataFrame) -> automaton.Moves:
        sec, own, whole = (pdf[c].to_numpy() for c in ("sec", "own", "whole"))
        lifts = np.stack(pdf["lifts"].to_numpy()).astype("float64")
        return lambda k, before: np.full(len(before), states.then[0, whole[k]]) if sec[k] == 0 else states.picks(lifts[k], own[k], before)

    r = automaton.run(d, "sec", table, 0, size, len(states.last))
    last = F.array(*[F.lit(labels[x] if x < len(labels) else None) for x in states.last.tolist()])
    named = r.select("clip_id", "sec", F.get(last, F.col("state_before").cast("int")).alias("before"), F.get(last, F.col("state").cast("int")).alias("style"))
    why = F.when(F.col("pick") == F.col("before"), "same caption style as the previous section").otherwise("ranked by lift over the clip's average")
    return sections.select("clip_id", "sec", "pick").join(fresh(named), ["clip_id", "sec"]).select(
        "clip_id", "sec", "style", F.when((F.col("sec") > 0) & (F.col("style") != F.col("pick")), why).alias("rule"))


def caption_sections(sections: DataFrame, styles: DataFrame, global_style: DataFrame, totals: DataFrame) -> DataFrame:
    """Sections of one style from the beginning of a clip to its end: (clip_id, k, start_us, end_us, style, n_changed). Equal neighbours
    are merged; a clip without sections is one of its global style."""
    last = sections.groupBy("clip_id").agg(F.max("sec").alias("__last"))
    s = stage(sections.join(fresh(styles), ["clip_id", "sec"]).join(fresh(last), "clip_id").join(fresh(totals), "clip_id").select(
        "clip_id", "sec", F.when(F.col("sec") == 0, 0).otherwise(F.col("start_us")).cast("bigint").alias("start_us"),
        F.when(F.col("sec") == F.col("__last"), F.greatest("duration_us", "end_us")).otherwise(F.col("end_us")).alias("end_us"), "style",
        F.col("rule").isNotNull().cast("bigint").alias("changed")), "caption_styles")
    n = neighbours(s, "sec", {"ps": ("style", -1)}, keep_block=True)
    n = n.withColumn("__new", F.when(F.col("ps") == F.col("style"), 0).otherwise(1).cast("bigint"))
    n = running(n, "sec", {"k": ("sum", "__new")})
    n = n.withColumn("k", F.col("k") - 1).groupBy("clip_id", "k").agg(
        F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.first("style").alias("style"), F.sum("changed").alias("n_changed"))
    zero = F.lit(0).cast("bigint")
    bare = totals.join(fresh(last), "clip_id", "left_anti").join(fresh(global_style), "clip_id").select(
        "clip_id", zero.alias("k"), zero.alias("start_us"), F.col("duration_us").alias("end_us"), "style", zero.alias("n_changed"))
    return n.unionByName(bare)


# ---- change events and the final shot table ---------------------------------------------------------
def change_events(shots: DataFrame, cuts: DataFrame) -> DataFrame:
    """Times at which something visibly changes: shots (clip_id, unit, start_us, end_us, layout, camera, overlay, card_key)."""
    cols = ("layout", "camera", "overlay", "card_key")
    n = neighbours(shots, "unit", {f"p_{c}": (c, -1) for c in cols})
    changed = F.lit(False)
    for c in cols:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"p_{c}"))
    own = n.filter(changed | F.col("p_layout").isNull()).select("clip_id", F.col("start_us").alias("at_us"))
    step = fixed.ANIMATED_US
    hi = F.col("end_us") - fixed.ANIMATED_TAIL_US - 1
    moving = shots.filter(F.col("camera").isin("push_in", "drift") & (F.col("start_us") + step <= hi))
    steps = moving.select("clip_id", F.explode(F.sequence(F.col("start_us") + step, hi, F.lit(step).cast("bigint"))).alias("at_us"))
    ends = shots.groupBy("clip_id").agg(F.min("start_us").alias("lo"), F.max("end_us").alias("hi"))
    c = cuts.join(fresh(ends), "clip_id").filter((F.col("at_us") > F.col("lo")) & (F.col("at_us") < F.col("hi"))).select("clip_id", "at_us")
    return own.unionByName(steps).unionByName(c)


def longest_still(events: DataFrame, shots: DataFrame) -> DataFrame:
    """Longest stretch without a change per clip: (clip_id, gap_us, at_us); the ends count as changes."""
    ends = shots.groupBy("clip_id").agg(F.min("start_us").alias("lo"), F.max("end_us").alias("hi"))
    p = events.select("clip_id", "at_us").unionByName(ends.select("clip_id", F.explode(F.array("lo", "hi")).alias("at_us")))
    p = running(p, "at_us", {"prev": ("last", "at_us")}, size=60_000_000, exclusive=True)
    gap = F.col("at_us") - F.col("prev")
    g = p.filter("prev IS NOT NULL").groupBy("clip_id").agg(F.max(gap).alias("gap_us"), F.min_by("prev", F.struct(-gap, "prev")).alias("at_us"))
    return g.select("clip_id", "gap_us", F.when(F.col("gap_us") > 0, F.col("at_us")).otherwise(0).cast("bigint").alias("at_us"))


def rhythm_report(shots: DataFrame, events: DataFrame, hook: DataFrame) -> DataFrame:
    """Longest still stretch and share of card time after the opening, two decimals."""
    card = F.col("overlay").isin("card", "keyword_pill")
    s = shots.groupBy("clip_id").agg(F.coalesce(F.sum(F.when(card, F.col("end_us") - F.col("start_us"))), F.lit(0)).alias("card_us"), F.max("end_us").alias("hi"))
    r = longest_still(events, shots).join(fresh(s), "clip_id").join(fresh(hook), "clip_id")
    room = F.greatest(F.lit(1_000_000), F.col("hi") - F.greatest(F.lit(0), F.col("hook_end_us")))
    two = lambda c: F.floor(c * 100 + 0.5) / 100
    return r.select("clip_id", two(F.col("gap_us") / 1e6).alias("max_gap_s"), two(F.col("card_us") / room).alias("card_share"))


def assemble_shots(shots: DataFrame, beats: DataFrame, planned: DataFrame, sections: DataFrame, hook: DataFrame) -> DataFrame:
    """Shots with their beat, final overlay, caption style and planning log.

    shots (clip_id, unit, start_us, end_us); beats (clip_id, beat, start_us, end_us, layout, template, visual_from_us);
    planned (clip_id, unit, overlay, giant, log); sections (clip_id, start_us, end_us, style)."""
    from .clock import active_at
    b = active_at(shots.select("clip_id", "unit", F.col("start_us").alias("t_us")), beats.withColumnRenamed("beat", "b"), unit="b") \
        .select("clip_id", "unit", F.col("b").alias("beat"))
    st = active_at(shots.select("clip_id", "unit", F.col("start_us").alias("t_us")), sections.withColumn("b", F.struct("start_us", "style")), unit="b") \
        .select("clip_id", "unit", F.col("b.style").alias("caption_style"))
    j = (shots.join(fresh(b), ["clip_id", "unit"]).join(fresh(beats.select("clip_id", "beat", "layout", "template", "visual_from_us", F.col("start_us").alias("beat_start"))), ["clip_id", "beat"])
              .join(fresh(st), ["clip_id", "unit"]).join(fresh(planned.select("clip_id", "unit", F.col("overlay").alias("planned"), "giant", "log")), ["clip_id", "unit"])
              .join(fresh(hook), "clip_id"))
    shows = F.col("template").isNotNull() & (F.col("start_us") >= F.coalesce("visual_from_us", "beat_start"))
    card = F.when(shows, F.when(F.col("template") == "keyword_pill", "keyword_pill").otherwise("card")).otherwise("none")
    lost = F.col("giant").isNotNull() & (F.col("layout") != "full")
    word = F.when(~lost, F.col("giant"))
    j = j.withColumn("card_on", shows).withColumn("__card", card).withColumn("giant_word", word)
    j = j.withColumn("overlay", F.when(word.isNotNull(), "giant_word").otherwise(F.col("__card")))
    added = F.col("overlay").isin("card", "keyword_pill") & (F.col("planned") == "none") & (F.col("beat") == F.col("unit"))
    extra = F.array_compact(F.array(
        F.when(lost, F.concat(F.lit("giant word needs the full-bleed speaker: giant_word -> "), "__card")),
        F.when(added, F.concat(F.lit("nothing on screen for too long, a card was added: none -> "), "overlay"))))
    return j.select("clip_id", "unit", "start_us", "end_us", "beat", "layout", "overlay", "giant_word", "caption_style", "card_on",
                    ((F.col("hook_end_us") > 0) & (F.col("start_us") < F.col("hook_end_us") - 200_000)).alias("hook"),
                    F.concat("log", extra).alias("overrides"))
