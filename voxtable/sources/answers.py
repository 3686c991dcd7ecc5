"""Probe, face and decision documents; proposals and card copy written by models."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.seq import fresh
from .files import us

PROBE = "struct<streams:array<struct<codec_type:string,width:int,height:int,r_frame_rate:string,sample_rate:string>>,format:struct<duration:string>>"


def probe_clips(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clips, rejects): duration, size, frame rate as a ratio, sample rate; both streams are required."""
    d = docs.select("clip_id", F.from_json("text", PROBE).alias("j"))
    of = lambda kind: F.get(F.filter("j.streams", lambda s: s["codec_type"] == kind), F.lit(0))
    d = d.select("clip_id", of("video").alias("v"), of("audio").alias("a"), F.expr("try_cast(j.format.duration AS DOUBLE)").alias("sec"))
    rate = F.split(F.coalesce("v.r_frame_rate", F.lit("30/1")), "/")
    den = F.coalesce(F.get(rate, F.lit(1)).try_cast("int"), F.lit(0))
    problem = F.when(F.col("v").isNull(), "no video stream").when(F.col("a").isNull(), "no audio stream").when(F.col("sec").isNull(), "no duration")
    d = d.withColumn("problem", problem)
    clips = d.filter("problem IS NULL").select(
        "clip_id", us("sec").alias("duration_us"), F.coalesce("v.width", F.lit(0)).alias("width"), F.coalesce("v.height", F.lit(0)).alias("height"),
        F.get(rate, F.lit(0)).try_cast("int").alias("fps_num"), F.when(den == 0, 1).otherwise(den).alias("fps_den"),
        F.coalesce(F.col("a.sample_rate").try_cast("int"), F.lit(48000)).alias("sample_rate"))
    return clips, d.filter("problem IS NOT NULL").select("clip_id", "problem")


def read_faces(docs: DataFrame) -> DataFrame:
    """One row per face; a second without faces has one row of NULLs."""
    d = docs.select("clip_id", F.posexplode(F.from_json("text", "array<struct<file:string,faces:array<struct<x:double,y:double,w:double,h:double>>>>")).alias("sec", "f"))
    return d.select("clip_id", "sec", F.posexplode_outer("f.faces").alias("face_ord", "b")).select("clip_id", "sec", "face_ord", "b.x", "b.y", "b.w", "b.h")


ANSWER = "struct<type:string,noul:double,choice:string,score:double,confidence:double,probabilities:map<string,double>>"


def read_answers(docs: DataFrame, menu: DataFrame, expected: dict[str, str]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(answers, heads, requests, rejects) of decision responses (clip_id, unit, req_id, latency_ms, text).

    ``expected`` maps question to answer type; any other type is rejected. Usage may be null."""
    form = f"struct<answers:map<string,{ANSWER}>,usage:struct<input_tokens:bigint,output_tokens:bigint>>"
    d = docs.select("clip_id", "unit", "req_id", "latency_ms", F.from_json("text", form).alias("j"))
    requests = d.select("clip_id", "req_id", "latency_ms", F.coalesce("j.usage.input_tokens", F.lit(0)).alias("input_tokens"),
                        F.coalesce("j.usage.output_tokens", F.lit(0)).alias("output_tokens"))
    q = d.select("clip_id", "unit", F.explode("j.answers").alias("question", "a"))
    want = F.create_map(*[F.lit(x) for kv in expected.items() for x in kv])
    q = q.withColumn("want", F.try_element_at(want, F.col("question")))
    good = q.filter(F.col("want").isNull() | (F.col("want") == F.col("a.type")))
    heads = good.select("clip_id", "unit", "question", "a.choice", "a.confidence", "a.score", "a.noul")
    long = good.select("clip_id", "unit", "question", F.explode("a.probabilities").alias("label", "prob"))
    answers = long.join(F.broadcast(menu.select("question", "label", "label_ord")), ["question", "label"])   # fixed menus
    rejects = q.filter(F.col("want") != F.col("a.type")).select("clip_id", "unit", "question", F.concat(F.lit("expected "), "want", F.lit(" answer, got "), "a.type").alias("problem"))
    return answers.select("clip_id", "unit", "question", "label", "label_ord", "prob"), heads, requests, rejects


def json_body(col: str) -> Column:
    """The JSON in a model's text: without thinking, from a code fence, bare, or between the outer braces."""
    plain = F.regexp_replace(F.col(col), r"(?s)<think>.*?</think>", "")
    fenced = F.regexp_extract(plain, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(F.trim(plain))
    outer = F.regexp_extract(plain, r"(?s)(\{.*\})", 1)
    valid = lambda c: F.try_parse_json(c).isNotNull()
    return F.when(valid(body), body).when((outer != "") & valid(outer), outer)


def read_proposals(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(proposals, rejects): drop proposals of a model; reasons cut to 200 characters, junk is not repaired."""
    d = texts.withColumn("body", json_body("text"))
    d = d.withColumn("drops", F.from_json("body", "struct<drops:array<struct<from:double,to:double,reason:string>>>")["drops"])
    problem = F.when(F.col("body").isNull(), "no JSON").when(F.col("drops").isNull(), "no drops array")
    d = d.withColumn("problem", problem)
    p = d.filter("problem IS NULL").select("clip_id", F.posexplode("drops").alias("p_ord", "x"))
    whole = lambda c: F.when(F.col(c) == F.floor(F.col(c)), F.col(c).cast("bigint"))
    p = p.select("clip_id", F.col("p_ord").cast("bigint").alias("p_ord"), whole("x.from").alias("from_i"), whole("x.to").alias("to_i"),
                 F.substring(F.coalesce("x.reason", F.lit("")), 1, 200).alias("reason"))
    return p, d.filter("problem IS NOT NULL").select("clip_id", "problem")


def _json_type(v: Column) -> Column:
    """string, number, boolean, array or object; NULL for a JSON null."""
    t = F.schema_of_variant(v)
    return F.when(t == "STRING", "string").when(t == "BOOLEAN", "boolean").when(t.startswith("ARRAY"), "array").when(t.startswith("OBJECT"), "object") \
        .when(t.isin("BIGINT", "DOUBLE", "FLOAT") | t.startswith("DECIMAL"), "number")


def _copy(texts: DataFrame, shape: str) -> DataFrame:
    return texts.withColumn("j", F.from_json(json_body("text"), shape))


def read_copy(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fields, corrections) of card copy. fields (clip_id, unit, field, kind, value, items, icons): kind is the JSON
    type, value the text of a scalar, items the strings of an array, icons its objects that have an emoji and a
    label. corrections have a whole number as index and a text; others change no word."""
    d = _copy(texts, "struct<beats:map<string,map<string,variant>>,corrections:array<variant>>")
    f = d.select("clip_id", F.explode("j.beats").alias("b", "fields")).select(
        "clip_id", F.regexp_extract("b", r"^b(\d+)$", 1).try_cast("bigint").alias("unit"), F.explode("fields").alias("field", "v"))
    f = f.withColumn("kind", _json_type(F.col("v"))).filter("kind IS NOT NULL")
    elements = F.when(F.col("kind") == "array", F.expr("try_variant_get(v, '$', 'array<variant>')"))
    strings = F.transform(F.filter(elements, lambda x: _json_type(x) == "string"), lambda x: F.try_variant_get(x, "$", "string"))
    part = lambda x, k: F.try_variant_get(x, f"$.{k}", "string")
    icons = F.transform(F.filter(elements, lambda x: (_json_type(x) == "object") & part(x, "emoji").isNotNull() & part(x, "label").isNotNull()),
                        lambda x: F.struct(part(x, "emoji").alias("emoji"), part(x, "label").alias("label")))
    f = f.select("clip_id", "unit", "field", "kind", F.when(F.col("kind").isin("string", "number", "boolean"), F.expr("try_variant_get(v, '$', 'string')")).alias("value"),
                 strings.alias("items"), icons.alias("icons"))
    c = d.select("clip_id", F.posexplode("j.corrections").alias("c_ord", "v"))
    index = F.expr("try_variant_get(v, '$.i', 'double')")
    typed = (_json_type(F.expr("try_variant_get(v, '$.i', 'variant')")) == "number") & (index == F.floor(index)) & \
        (_json_type(F.expr("try_variant_get(v, '$.text', 'variant')")) == "string")
    c = c.filter(typed).select("clip_id", "c_ord", index.cast("bigint").alias("i"), F.expr("try_variant_get(v, '$.text', 'string')").alias("text"))
    return f, c


def read_title(texts: DataFrame) -> DataFrame:
    """(clip_id, word, line) of the title block of card copy; NULL where it is absent or not a string."""
    d = _copy(texts, "struct<hook:struct<word:variant,line:variant>>")
    own = lambda k: F.when(_json_type(F.col(f"j.hook.{k}")) == "string", F.try_variant_get(F.col(f"j.hook.{k}"), "$", "string")).alias(k)
    return d.filter("j.hook IS NOT NULL").select("clip_id", own("word"), own("line"))
