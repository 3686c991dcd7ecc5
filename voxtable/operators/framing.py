"""Faces, crop rectangles and camera pieces."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.intervals import overlap_join, points_in
from ..functions.seq import fresh, neighbours, numbered, running
from ..functions.stage import stage
from . import automaton

OUT_W, OUT_H, FPS = 1080, 1920, 30
# fixed values: layout of the output frame in pixels
FACE_PAD, CAPTION_MARGIN, CAPTION_MAX, SPLIT_MARGIN, SPLIT_CAPTION_MAX = 0.12, 110, 1500, 100, 1560
SAFE_LEFT, SAFE_RIGHT, SAFE_BOTTOM, CAPTION_HALF, LEAST_CARD = 60, 960, 1580, 76, 40
NO_FACE_CAPTION, NO_FACE_SPLIT_CAPTION = 1400, 1500
SPLIT_ZOOM, SPLIT_HEADROOM, SPLIT_TOP, SPLIT_SIDE = 1.12, 36, 840, 1080
PLACEHOLDER = (0.3, 0.1, 0.4, 0.4)


def _round(c: Column) -> Column:
    return F.floor(c + 0.5).cast("bigint")


def _clamp(v: Column, lo, hi) -> Column:
    return F.greatest(lo if isinstance(lo, Column) else F.lit(lo), F.least(hi if isinstance(hi, Column) else F.lit(hi), v))


def largest_faces(faces: DataFrame, clips: DataFrame) -> DataFrame:
    """Per second of every clip the largest face, NULL where there is none: (clip_id, sec, x, y, w, h).

    Both sides have a row per second, but little of that shows in the size of their files, by which Spark would
    broadcast them; hence a merge join."""
    spine = clips.select("clip_id", F.explode(F.expr("sequence(0L, greatest(0L, duration_us DIV 1000000 - 1))")).alias("sec"), "duration_us") \
        .filter("duration_us >= 1000000").drop("duration_us")
    big = faces.groupBy("clip_id", F.col("sec").cast("bigint").alias("sec")).agg(
        F.max_by(F.struct("x", "y", "w", "h"), F.struct((F.col("w") * F.col("h")).alias("a"), -F.col("face_ord"))).alias("f"))
    return spine.join(fresh(big).hint("merge"), ["clip_id", "sec"], "left").select("clip_id", "sec", "f.x", "f.y", "f.w", "f.h")


def face_summary(per_second: DataFrame) -> DataFrame:
    """Median box, share of seconds with a face, and whether that is reliable.

    Medians come from counts per value and running ranks, so no clip's values are gathered in one place."""
    share = per_second.groupBy("clip_id").agg(F.count("*").alias("n_sec"), F.count("x").alias("n_face"))
    v = per_second.filter("x IS NOT NULL").select("clip_id", F.explode(F.array(*[F.struct(F.lit(k).alias("dim"), F.col(k).alias("v")) for k in "xywh"])).alias("p")) \
        .select("clip_id", "p.dim", "p.v")
    n = v.groupBy("clip_id", "dim", "v").agg(F.count("*").alias("n"))
    r = running(n, "v", {"cum": ("sum", "n")}, keys=("clip_id", "dim"), size=0.001)
    r = r.join(fresh(share.select("clip_id", "n_face")), "clip_id")
    at = lambda rank: F.min(F.when(F.col("cum") > rank, F.col("v")))
    lo, hi = F.floor((F.col("n_face") - 1) / 2), F.floor(F.col("n_face") / 2)
    med = r.groupBy("clip_id", "dim").agg(((at(lo) + at(hi)) / 2).alias("m"))
    wide = med.groupBy("clip_id").agg(*[F.max(F.when(F.col("dim") == k, F.col("m"))).alias(k) for k in "xywh"])
    j = share.join(fresh(wide), "clip_id", "left")
    conf = F.when(F.col("n_sec") > 0, F.col("n_face") / F.col("n_sec")).otherwise(0.0)
    return j.select("clip_id", *[F.coalesce(k, F.lit(p)).alias(k) for k, p in zip("xywh", PLACEHOLDER)], "n_sec", "n_face",
                    conf.alias("share"), (conf >= fixed.FACE_RELIABLE).alias("reliable"))


def describe_face(summary: DataFrame, note: Column) -> DataFrame:
    """An honest sentence about where the face is, after the given note."""
    mid = F.col("x") + F.col("w") / 2
    up = F.when(F.col("y") < 0.2, "upper").when(F.col("y") + F.col("h") > 0.7, "lower").otherwise("upper-middle")
    side = F.when(mid < 0.4, "left").when(mid > 0.6, "right").otherwise("center")
    fact = F.concat(F.lit("A face is detected in the "), up, F.lit(" "), side, F.lit(" of the frame (median across sampled frames)."))
    none = F.when(F.col("n_sec") > 0, F.concat(F.lit("No reliable face detected (present in "), F.col("n_face").cast("string"), F.lit("/"), F.col("n_sec").cast("string"),
                                              F.lit(" sampled frames); scene content could not be automatically described."))) \
        .otherwise("No frames were sampled; scene content could not be automatically described.")
    t = F.trim(note)
    return summary.select("clip_id", F.when(F.col("reliable"), F.when(note.isNotNull(), F.concat(t, F.lit(" "), fact)).otherwise(fact))
                          .when(note.isNotNull(), t).otherwise(none).alias("text"))


def sample_frames(frames: DataFrame) -> DataFrame:
    """First, middle and last frame of every clip."""
    n = frames.groupBy("clip_id").agg(F.count("*").alias("n"))
    r = numbered(frames, "frame", "pos").join(fresh(n), "clip_id")
    return r.filter("pos = 0 OR pos = n DIV 2 OR pos = n - 1").select("clip_id", "frame")


def _full_crop(cx: Column, cy: Column) -> dict[str, Column]:
    sw, sh = F.col("width").cast("double"), F.col("height").cast("double")
    want = sh * 9 / 16
    narrow = want > sw
    w = F.when(narrow, F.greatest(F.lit(1.0), sw)).otherwise(want)
    h = F.when(narrow, F.greatest(F.lit(1.0), F.least(sh, w * 16 / 9))).otherwise(sh)
    y = F.when(narrow, _clamp(cy - h / 2, 0.0, F.greatest(F.lit(0.0), sh - h))).otherwise(0.0)
    x = _clamp(cx - w / 2, 0.0, F.greatest(F.lit(0.0), sw - w))
    return {"x": _round(x), "y": _round(y), "w": _round(w), "h": _round(h)}


def crop_geometry(clips: DataFrame, summary: DataFrame) -> DataFrame:
    """Crops, padded face, caption rows and card rectangle for the full and the split layout, in whole pixels."""
    d = clips.select("clip_id", "width", "height").join(fresh(summary), "clip_id")
    ok, sw, sh = F.col("reliable"), F.col("width"), F.col("height")
    cx = F.when(ok, (F.col("x") + F.col("w") / 2) * sw).otherwise(sw / 2)
    cy = F.when(ok, (F.col("y") + F.col("h") / 2) * sh).otherwise(sh / 2)
    d = d.withColumn("cx", cx).withColumn("cy", cy)
    for k, v in _full_crop(F.col("cx"), F.col("cy")).items():
        d = d.withColumn(f"crop_{k}", v)
    pad = {"x": (F.col("x") - F.col("w") * FACE_PAD) * sw, "y": (F.col("y") - F.col("h") * FACE_PAD) * sh,
           "w": F.col("w") * (1 + 2 * FACE_PAD) * sw, "h": F.col("h") * (1 + 2 * FACE_PAD) * sh}
    for k, v in pad.items():
        d = d.withColumn(f"src_{k}", v)
    scale = OUT_W / F.col("crop_w")
    face = {"x": (F.col("src_x") - F.col("crop_x")) * scale, "y": (F.col("src_y") - F.col("crop_y")) * scale, "w": F.col("src_w") * scale, "h": F.col("src_h") * scale}
    d = d.withColumn("caption", F.when(ok, _clamp(face["y"] + face["h"] + CAPTION_MARGIN, 0.0, float(CAPTION_MAX))).otherwise(float(NO_FACE_CAPTION)))
    top = _clamp(F.col("caption") + CAPTION_HALF, 0.0, float(SAFE_BOTTOM - LEAST_CARD))
    side = F.least("width", "height")
    d = d.withColumn("sq", F.when(ok, side / SPLIT_ZOOM).otherwise(F.greatest(F.lit(1.0), side.cast("double"))))
    hair = F.greatest(F.lit(0.0), (F.col("y") - 0.5 * F.col("h")) * sh)
    s_scale = OUT_W / F.col("sq")
    d = d.withColumn("sx", _clamp(F.col("cx") - F.col("sq") / 2, 0.0, F.greatest(F.lit(0.0), sw - F.col("sq"))))
    d = d.withColumn("sy", _clamp(F.when(ok, hair - SPLIT_HEADROOM / s_scale).otherwise(F.col("cy") - F.col("sq") / 2), 0.0, F.greatest(F.lit(0.0), sh - F.col("sq"))))
    sf = {"x": (F.col("src_x") - F.col("sx")) * s_scale, "y": (F.col("src_y") - F.col("sy")) * s_scale + SPLIT_TOP, "w": F.col("src_w") * s_scale, "h": F.col("src_h") * s_scale}
    s_cap = F.when(ok, _clamp(sf["y"] + sf["h"] + SPLIT_MARGIN, 0.0, float(SPLIT_CAPTION_MAX))).otherwise(float(NO_FACE_SPLIT_CAPTION))
    none = {"x": F.col("cx"), "y": F.col("cy"), "w": F.lit(0.0), "h": F.lit(0.0)}
    s_none = {"x": F.lit(OUT_W / 2), "y": F.lit(SPLIT_TOP + SPLIT_SIDE / 2), "w": F.lit(0.0), "h": F.lit(0.0)}
    pick = lambda name, a, b: [_round(F.when(ok, a[k]).otherwise(b[k])).alias(f"{name}_{k}") for k in "xywh"]
    return d.select("clip_id", "width", "height", "x", "y", "w", "h", "reliable", *[F.col(f"crop_{k}") for k in "xywh"], *pick("face", face, none),
                    _round(F.col("caption")).alias("caption_y"), _round(top).alias("card_y"),
                    _round(F.greatest(F.lit(float(LEAST_CARD)), SAFE_BOTTOM - top)).alias("card_h"),
                    *[_round(F.col(c)).alias(f"split_{k}") for k, c in zip("xywh", ("sx", "sy", "sq", "sq"))], *pick("split_face", sf, s_none),
                    _round(s_cap).alias("split_caption_y"))


def face_safe_zoom(zoom, layout: Column) -> Column:
    """The zoom, limited so that the face keeps some room; columns of ``crop_geometry``."""
    z = F.lit(zoom) if isinstance(zoom, float) else zoom
    full = F.when((F.col("face_w") > 0) & (F.col("face_h") > 0) & (F.col("crop_w") > 0) & (F.col("crop_h") > 0),
                  F.least(F.col("crop_w") / (F.col("w") * F.col("width") * fixed.FACE_FIT), F.col("crop_h") / (F.col("h") * F.col("height") * fixed.FACE_FIT)))
    split = F.when((F.col("split_face_w") > 0) & (F.col("split_face_h") > 0),
                   F.least(SPLIT_SIDE / (F.col("split_face_w") * fixed.FACE_FIT),
                           SPLIT_SIDE * 0.95 / F.greatest(F.lit(1), F.col("split_face_y") + F.col("split_face_h") - SPLIT_TOP)))
    return F.greatest(F.lit(1.0), F.least(z, F.when(layout == "full", full).otherwise(split)))


def _anchors(layout: Column) -> tuple[Column, Column]:
    seen = (F.col("face_w") > 0) & (F.col("face_h") > 0) & (F.col("crop_w") > 0) & (F.col("crop_h") > 0)
    ax = F.when(seen, _clamp(((F.col("x") + F.col("w") / 2) * F.col("width") - F.col("crop_x")) / F.col("crop_w"), 0.25, 0.75)).otherwise(0.5)
    ay = F.when(seen, _clamp(((F.col("y") + F.col("h") / 2) * F.col("height") - F.col("crop_y")) / F.col("crop_h"), 0.15, 0.6)).otherwise(0.4)
    s_seen = (F.col("split_face_w") > 0) & (F.col("split_face_h") > 0)
    sx = F.when(s_seen, _clamp((F.col("split_face_x") + F.col("split_face_w") / 2) / SPLIT_SIDE, 0.25, 0.75)).otherwise(0.5)
    return F.when(layout == "split", sx).otherwise(ax), F.when(layout == "split", 0.0).otherwise(ay)


def static_rect(zoom: Column, layout: Column) -> Column:
    """Crop of a static camera: STRUCT(x, y, w, h) in whole source pixels."""
    seen = (F.col("face_w") > 0) & (F.col("face_h") > 0)
    bx, by, bw, bh = (F.col(f"crop_{k}") for k in "xywh")
    w, h = bw / zoom, bh / zoom
    fx = F.when(seen, (F.col("x") + F.col("w") / 2) * F.col("width")).otherwise(bx + bw / 2)
    fy = F.when(seen, (F.col("y") + F.col("h") / 2) * F.col("height")).otherwise(by + bh / 2)
    rect = lambda x, y, w, h: F.struct(_round(x).alias("x"), _round(y).alias("y"), _round(w).alias("w"), _round(h).alias("h"))
    full = rect(F.least(F.col("width") - w, F.greatest(F.lit(0.0), fx - w / 2)), F.least(F.col("height") - h, F.greatest(F.lit(0.0), fy - h / 2)), w, h)
    sx0, sy0, sw, sh = (F.col(f"split_{k}") for k in "xywh")
    ax, _ = _anchors(F.lit("split"))
    w2, h2 = sw / zoom, sh / zoom
    split = rect(F.least(sx0 + sw - w2, F.greatest(sx0.cast("double"), sx0 + ax * sw - w2 / 2)), F.least(F.col("height") - h2, F.greatest(F.lit(0.0), sy0.cast("double"))), w2, h2)
    base = F.when(layout == "full", F.struct(bx.alias("x"), by.alias("y"), bw.alias("w"), bh.alias("h"))).otherwise(
        F.struct(sx0.alias("x"), sy0.alias("y"), sw.alias("w"), sh.alias("h")))
    return F.when(zoom <= 1, base).when(layout == "full", full).otherwise(split)


def camera_pieces(shots: DataFrame, cuts: DataFrame, geometry: DataFrame) -> DataFrame:
    """Shots cut at the joins; a plain piece after a join that would look like the one before gets the punch.

    shots (clip_id, unit, start_us, end_us, layout, camera) -> (clip_id, piece, start_frame, end_frame, layout,
    camera, moving, zoom, z0, z1). Equal static neighbours are one piece. Times are 1/30 s frames."""
    fr = lambda c: F.floor((F.col(c) * 60 + 1_000_000) / 2_000_000)
    s = shots.select("clip_id", "unit", "layout", "camera", fr("start_us").alias("f0"), fr("end_us").alias("f1")).filter("f1 > f0")
    c = cuts.select("clip_id", fr("at_us").alias("cf")).filter("cf > 0").distinct()
    at = points_in(c, fresh(s.select("clip_id", "unit", "f0", "f1")), "cf", ("f0", "f1"), width=3000)
    at = at.groupBy("clip_id", "unit").agg(F.array_sort(F.collect_set("cf")).alias("cs"))
    p = s.join(fresh(at), ["clip_id", "unit"], "left").withColumn("cs", F.coalesce("cs", F.array().cast("array<bigint>")))
    p = p.withColumn("from", F.explode(F.array_union(F.array("f0"), F.col("cs")))) \
         .withColumn("to", F.coalesce(F.array_min(F.filter("cs", lambda x: x > F.col("from"))), F.col("f1"))) \
         .withColumn("at_cut", F.array_contains("cs", F.col("from")))
    p = p.join(fresh(geometry), "clip_id").withColumn("punch_zoom", face_safe_zoom(fixed.ZOOM_PUNCH, F.col("layout")))
    lay = F.col("layout")
    z0 = F.when(F.col("camera") == "punch", F.col("punch_zoom")).when(F.col("camera") == "face_closeup", face_safe_zoom(fixed.ZOOM_CLOSEUP, lay)) \
        .when(F.col("camera") == "push_in", face_safe_zoom(fixed.ZOOM_PUSH[0], lay)).when(F.col("camera") == "drift", face_safe_zoom(fixed.ZOOM_DRIFT[0], lay)).otherwise(1.0)
    z1 = F.when(F.col("camera") == "push_in", face_safe_zoom(fixed.ZOOM_PUSH[1], lay)).when(F.col("camera") == "drift", face_safe_zoom(fixed.ZOOM_DRIFT[1], lay)).otherwise(F.col("z0"))
    p = p.withColumn("z0", z0).withColumn("z1", z1).select("clip_id", "unit", "from", "to", "layout", "camera", "at_cut", "z0", "z1", "punch_zoom")
    p = stage(numbered(p, "from", "n"), "camera_pieces")
    gap = fixed.FLIP_GAP

    def table(pdf: pd.DataFrame) -> np.ndarray:
        # state 1: the piece before ended near the plain framing
        near = lambda col: (np.abs(pdf[col].to_numpy() - 1) < gap).astype("int64")
        flips = (pdf["at_cut"] & (pdf["camera"] == "base")).to_numpy()
        own = near("z1")
        return np.stack([own, np.where(flips, near("punch_zoom"), own)], axis=1)

    r = automaton.run(p.select("clip_id", "n", "at_cut", "camera", "z1", "punch_zoom"), "n", table, 1)
    p = p.join(fresh(r.select("clip_id", "n", "state_before")), ["clip_id", "n"])
    flip = F.col("at_cut") & (F.col("camera") == "base") & (F.col("state_before") == 1)
    p = p.withColumn("z0", F.when(flip, F.col("punch_zoom")).otherwise(F.col("z0"))).withColumn("z1", F.when(flip, F.col("punch_zoom")).otherwise(F.col("z1"))) \
         .withColumn("camera", F.when(flip, "punch").otherwise(F.col("camera"))).withColumn("moving", F.col("camera").isin("push_in", "drift"))
    q = neighbours(p, "n", {"pl": ("layout", -1), "pc": ("camera", -1), "pm": ("moving", -1), "pt": ("to", -1)}, keep_block=True)
    same = ~F.col("moving") & (F.col("pm") == F.lit(False)) & (F.col("pl") == F.col("layout")) & (F.col("pc") == F.col("camera")) & (F.col("pt") == F.col("from"))
    q = running(q.withColumn("__new", F.when(same, 0).otherwise(1).cast("bigint")), "n", {"piece": ("sum", "__new")})
    return q.groupBy("clip_id", (F.col("piece") - 1).alias("piece")).agg(
        F.min("from").alias("start_frame"), F.max("to").alias("end_frame"), F.first("layout").alias("layout"), F.first("camera").alias("camera"),
        F.first("moving").alias("moving"), F.min_by("z0", "n").alias("z0"), F.max_by("z1", "n").alias("z1"))


def _moved(p: Column) -> dict[str, Column]:
    """View of a moving camera at progress p over its layout's base crop."""
    lay = F.col("layout")
    ax, ay = _anchors(lay)
    drift = F.col("camera") == "drift"
    a = F.when(drift, fixed.DRIFT_ANCHOR[0] + (fixed.DRIFT_ANCHOR[1] - fixed.DRIFT_ANCHOR[0]) * p).otherwise(ax)
    base = {k: F.when(lay == "split", F.col(f"split_{k}")).otherwise(F.col(f"crop_{k}")) for k in "xywh"}
    z = F.col("z0") + (F.col("z1") - F.col("z0")) * p
    w, h = base["w"] / z, base["h"] / z
    return {"x": base["x"] + a * (base["w"] - w), "y": base["y"] + ay * (base["h"] - h), "w": w, "h": h}


def camera_path(pieces: DataFrame, geometry: DataFrame) -> DataFrame:
    """One view rectangle per frame of every moving piece: (clip_id, frame_no, x, y, w, h)."""
    m = pieces.filter("moving").join(fresh(geometry), "clip_id").withColumn("frame_no", F.explode(F.expr("sequence(start_frame, end_frame - 1)")))
    p = (F.col("frame_no") - F.col("start_frame")) / F.greatest(F.lit(1), F.col("end_frame") - F.col("start_frame"))
    return m.select("clip_id", "frame_no", *[v.alias(f"view_{k}") for k, v in _moved(p).items()])


def effect_windows(windows: DataFrame, pieces: DataFrame, geometry: DataFrame) -> DataFrame:
    """Highest head position while a window is on screen: windows (clip_id, start_us, end_us) + head_top, NULL without a face."""
    us = lambda c: F.floor((F.col(c) * 2_000_000 + 30) / 60)
    p = pieces.withColumn("p0", us("start_frame")).withColumn("p1", us("end_frame"))
    g = p.join(fresh(geometry), "clip_id")
    half = _moved(F.lit(0.5))
    st = static_rect(F.col("z0"), F.lit("full"))
    full_half = {k: v for k, v in half.items()}
    src = F.col("crop_y") + (F.col("face_y") - 0.25 * F.col("face_h")) * F.col("crop_h") / OUT_H
    vy = F.when(F.col("moving"), full_half["y"]).otherwise(st["y"])
    vh = F.when(F.col("moving"), full_half["h"]).otherwise(st["h"])
    head = F.when((F.col("face_w") > 0) & (F.col("face_h") > 0), F.least(F.lit(0.5), F.greatest(F.lit(0.04), (src - vy) / vh)))
    tops = g.withColumn("lay0", F.col("layout")).withColumn("layout", F.lit("full")).select("clip_id", "p0", "p1", head.alias("head"))
    hit = overlap_join(windows, fresh(tops), ("start_us", "end_us"), ("p0", "p1"))
    top = hit.groupBy("clip_id", "start_us", "end_us").agg(F.min("head").alias("head_top"), F.count("*").alias("n_pieces"))
    return windows.join(fresh(top), ["clip_id", "start_us", "end_us"], "left")


def coverage_verdict(frames: DataFrame, min_mean: float = fixed.MIN_COVERAGE) -> DataFrame:
    """Whether a person matte covers enough of the frames: frames (clip_id, coverage)."""
    a = frames.groupBy("clip_id").agg(F.avg("coverage").alias("mean"), F.avg((F.col("coverage") >= min_mean / 2).cast("double")).alias("good"))
    one = lambda c: F.format_string("%.1f", c)
    reason = F.when(F.col("mean") < min_mean, F.concat(F.lit("person coverage "), one(F.col("mean") * 100), F.lit(f"% is below {min_mean * 100:.0f}%"))) \
        .when(F.col("good") < fixed.MIN_GOOD_FRAMES, F.concat(F.lit("person missing in "), F.floor((1 - F.col("good")) * 100 + 0.5).cast("string"), F.lit("% of frames")))
    return a.select("clip_id", reason.isNull().alias("ok"), "mean", reason.alias("reason"))
