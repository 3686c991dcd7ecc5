"""Card copy: validation against the schema, fallbacks, corrections, emphasis and reveal times."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import fixed, text
from ..functions.seq import fresh
from .segments import joined, unit_words


def card_schema(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixed.CARD_SCHEMA, "template string, field string, kind string, required boolean, max_words int, "
                                                    "min_len int, max_len int, enum_values array<string>")


def validate_cards(cards: DataFrame, fields: DataFrame, schema: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fields, invalid): every field checked and clamped; a card with one bad field is invalid as a whole.

    cards (clip_id, unit, template); fields (clip_id, unit, field, kind, value, items, icons) as read_copy gives them:
    the JSON type decides. Where a number is wanted, numeric strings and booleans are taken as numbers. Valid fields
    carry the icons' labels as items and their emoji beside them."""
    want = cards.join(F.broadcast(schema), "template")     # the schema is a fixed table of a few dozen rows
    j = want.join(fresh(fields.withColumnRenamed("kind", "found")), ["clip_id", "unit", "field"], "left")
    absent = F.col("found").isNull()
    blank = (F.col("found") == "string") & (F.trim("value") == "")
    number = F.when(F.col("found") == "boolean", F.when(F.col("value") == "true", "1").otherwise("0")).when(blank, "0") \
        .when(F.col("found").isin("number", "string") & F.expr("try_cast(value AS DOUBLE) IS NOT NULL"), F.trim("value"))
    array = F.col("found") == "array"
    least = F.coalesce("min_len", F.lit(0))
    ok = (F.when(absent, ~F.col("required"))
           .when(F.col("kind") == "string", F.col("found") == "string")
           .when(F.col("kind") == "number", number.isNotNull())
           .when(F.col("kind") == "enum", (F.col("found") == "string") & F.array_contains("enum_values", F.col("value")))
           .when(F.col("kind") == "stringArray", array & (F.size("items") >= least))
           .otherwise(array & (F.size("icons") >= least)))
    cut = lambda c: F.when(F.col("max_len").isNotNull(), F.slice(c, 1, F.col("max_len"))).otherwise(F.col(c))
    items = F.when(F.col("kind") == "stringArray", F.transform(cut("items"), lambda x: text.clamp_words(x, 6))) \
        .when(F.col("kind") == "iconArray", F.transform(cut("icons"), lambda x: text.clamp_words(x["label"], 4)))
    emoji = F.when(F.col("kind") == "iconArray", F.transform(cut("icons"), lambda x: x["emoji"]))
    value = F.when(F.col("kind") == "string", text.clamp_words(F.col("value"), F.coalesce("max_words", F.lit(5)))) \
        .when(F.col("kind") == "number", number).when(F.col("kind") == "enum", F.col("value"))
    j = j.withColumn("ok", F.coalesce(ok, F.lit(False)))
    verdict = j.groupBy("clip_id", "unit").agg(F.bool_and("ok").alias("valid"))
    good = j.filter(~absent).join(fresh(verdict.filter("valid").drop("valid")), ["clip_id", "unit"], "left_semi").select(
        "clip_id", "unit", "template", "field", value.alias("value"), items.alias("items"), emoji.alias("emoji"))
    return good, verdict.filter("NOT valid").select("clip_id", "unit")


def fallback_phrase(invalid: DataFrame, units: DataFrame, words: DataFrame, emphasis: DataFrame) -> DataFrame:
    """A phrase from the unit itself: the emphasised word and its neighbours, else the first three words."""
    u = units.join(fresh(invalid), ["clip_id", "unit"], "left_semi")
    w = unit_words(u, words).join(fresh(emphasis.select("clip_id", "unit", F.col("i").alias("em_i"))), ["clip_id", "unit"], "left")
    i, em = F.col("i"), F.col("em_i")
    near = F.when(em.isNull(), i <= F.col("first_i") + 2).otherwise(F.abs(i - em) <= 1)
    s = text.strip_outer("text")
    w = w.withColumn("stripped", s)
    phrase = joined("stripped", when=near & (s != ""))
    own = F.max(F.when(i == em, F.col("stripped")))
    g = w.groupBy("clip_id", "unit").agg(phrase.alias("p"), own.alias("own"))
    return g.select("clip_id", "unit", F.when(F.col("p") != "", F.col("p")).otherwise(F.coalesce("own", "p")).alias("text"))


def apply_corrections(words: DataFrame, corrections: DataFrame) -> DataFrame:
    """Words with corrected text; of several corrections of a word the last one counts.

    corrections (clip_id, c_ord, i, text)."""
    last = corrections.groupBy("clip_id", "i").agg(F.max_by("text", "c_ord").alias("fixed"))
    return words.join(fresh(last), ["clip_id", "i"], "left").withColumn("raw", F.col("text")) \
        .withColumn("text", F.coalesce("fixed", "text")).drop("fixed")


def corrected_units(units: DataFrame, corrected: DataFrame, giants: DataFrame) -> DataFrame:
    """Unit text rebuilt from corrected words; a large word taken from a corrected word takes its spelling."""
    w = unit_words(units, corrected)
    raw = fresh(corrected.select("clip_id", "i", "raw"))
    w = w.join(raw, ["clip_id", "i"]).join(fresh(giants.withColumnRenamed("word", "giant")), ["clip_id", "unit"], "left")
    before, after = text.norm_value("raw"), text.norm_value("text")
    changed = (before != "") & (before == text.norm_value("giant")) & (after != before)
    spelled = F.upper(F.regexp_replace("text", r"[^\p{L}\p{N}.%'-]", ""))
    return w.groupBy("clip_id", "unit").agg(joined("text").alias("text"), F.max("giant").alias("giant"),
                                            F.min_by(spelled, F.when(changed, F.col("i"))).alias("new")) \
        .select("clip_id", "unit", "text", F.coalesce("new", "giant").alias("giant_word"))


def mark_emphasis(words: DataFrame, picks: DataFrame) -> DataFrame:
    """words + emph for every picked index (own and held picks)."""
    p = picks.select("clip_id", "i").distinct().withColumn("emph", F.lit(True))
    return words.join(fresh(p), ["clip_id", "i"], "left").withColumn("emph", F.coalesce("emph", F.lit(False)))


def reveal_times(cards: DataFrame, units: DataFrame, words: DataFrame) -> DataFrame:
    """When a card's answer is spoken, relative to its unit and 0.15 s early.

    cards (clip_id, unit, template, picked): the picked option or label. More than 0.6 s into the unit:
    the word equal to a picked option, else the first word with a digit, else the word equal to the label."""
    c = cards.filter(F.col("template").isin(fixed.REVEAL_TEMPLATES))
    u = units.join(fresh(c), ["clip_id", "unit"]).withColumn("u0", F.col("start_us"))
    w = unit_words(u, words).filter(F.col("w_start") - F.col("u0") > 600_000)
    same = F.col("picked").isNotNull() & (F.col("picked") != "") & (text.norm_value("text") == text.norm_value("picked"))
    rank = F.when(same & (F.col("template") == "option_chips"), 0).when(F.col("text").rlike("[0-9]"), 1).when(same, 2)
    hit = w.withColumn("rank", rank).filter("rank IS NOT NULL").groupBy("clip_id", "unit").agg(
        F.min_by(F.col("w_start") - F.col("u0"), F.struct("rank", "i")).alias("t"))
    return hit.select("clip_id", "unit", (F.floor((F.col("t") - 150_000) / 10_000 + 0.5) * 10_000).cast("bigint").alias("reveal_us"))
