"""Document fingerprints by closed syncmers, with DataFrame and SQL functions only.

A text's words (in lower case; a run of more than WORD characters counts as several words) are hashed. Of all stretches of
K words those are anchors whose least inner stretch of S words, by hash, stands at the stretch's beginning or end. Whether a
stretch is an anchor depends on its own words alone, so an edit changes only anchors that hold an edited word, every other one is
found again in the changed text, and of K - S + 1 neighbouring stretches one at least is an anchor. The fingerprint lists the
anchors in order: words since the anchor before, and 48 bits of the anchor's hash. Texts of fewer than K words have one
anchor, the whole. Two fingerprints are as alike as the share of anchors (different ones) they have in common: twice the
number of shared ones by the sum of both.

Comparing each document with the next one of descending doc_id takes no window over the table: doc_id quantiles cut the order into
parts of about PART rows, each text is shuffled once to its part, and the first row of a part is also sent to the part before, as
what follows its last row (the greatest doc_id to the last part, too). Only these quantiles, one number per part and at most
PARTS, come to the driver.

Null or empty text: no words, empty fingerprint; two of them are alike (1). Rows of one doc_id stand in the order of a hash of
their text (ids are expected to be unique, rows of one id are one part). A row without doc_id stands outside the order and is its own
next document. A text takes about 100 bytes a word while it is handled. Other columns are not read. An empty table gives no rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import table

K, S, WORD = 6, 2, 16
PART, PARTS = 1000, 20_000

_WORDS = rf"[^\\x20\\x09-\\x0D]{{1,{WORD}}}"


def anchors(text: str) -> Column:
    """array<struct<place:int,hash:bigint>>: the anchors of a text column. The column's name must be plain."""
    inner = [f"s[i + {j}]" for j in range(K - S + 1)]
    # Stretches that follow each other without overlap, and the last one, hold all words.
    whole = ", ".join(inner[j] for j in sorted({*range(0, K - S + 1, S), K - S}))
    stretch = ", ".join(f"h[i + {j}]" for j in range(S))
    return F.expr(f"""transform(array(transform(regexp_extract_all(lower(coalesce({text}, '')), '{_WORDS}', 0), w -> xxhash64(w))), h ->
      case when size(h) = 0 then cast(array() as array<struct<place:int,hash:bigint>>)
        when size(h) < {K} then array(named_struct('place', 0, 'hash', xxhash64(h)))
        else transform(array(transform(sequence(0, size(h) - {S}), i -> xxhash64({stretch}))), s ->
          transform(filter(sequence(0, size(h) - {K}), i -> least({', '.join(inner)}) = least({inner[0]}, {inner[-1]})),
            i -> named_struct('place', i, 'hash', xxhash64({whole}))))[0] end)[0]""")


def written(found: str) -> Column:
    """The fingerprint of a column of anchors: gap:hash, joined by commas."""
    return F.expr(f"""array_join(transform({found}, (a, j) -> concat(cast(a.place - if(j = 0, 0, {found}[j - 1].place) as string), ':',
        lpad(lower(hex(a.hash & 281474976710655L)), 12, '0'))), ',')""")


def read(fingerprint: str) -> Column:
    """The different anchors of a fingerprint column, without their places."""
    return F.expr(f"array_distinct(transform(filter(split({fingerprint}, ','), x -> x <> ''), x -> substring_index(x, ':', -1)))")


def _different(found: str) -> Column:
    return F.expr(f"array_distinct(transform({found}, a -> a.hash & 281474976710655L))")


def likeness(a: str, b: str) -> Column:
    """Of two columns of different anchors: shared ones by all, 0 to 1."""
    return F.expr(f"if(size({a}) + size({b}) = 0, 1D, 2D * size(array_intersect({a}, {b})) / (size({a}) + size({b})))")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, anchors, fingerprint) of each text."""
    plain = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    found = plain.select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_chars"), anchors("text").alias("anchors"))
    return found.withColumn("fingerprint", written("anchors"))


def _part(bounds: list[int]) -> Column:
    """How many of the sorted bounds are below doc_id, by halving."""
    b = F.lit(bounds)

    def half(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        lower = F.get(b, middle) < F.col("doc_id")
        done = s["lo"] >= s["hi"]
        return F.struct(F.when(~done & lower, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(~done & ~lower, middle).otherwise(s["hi"]).alias("hi"))

    steps = F.sequence(F.lit(0), F.lit(len(bounds).bit_length()))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(bounds) - 1).alias("hi")), half, lambda s: s["lo"])


def followed(docs: DataFrame, rows: int = PART) -> DataFrame:
    """docs (doc_id, text) with anchors, next_text and next_anchors, those of the next document."""
    ids = docs.where("doc_id is not null")
    n = ids.count()
    if not n:
        return docs.withColumn("anchors", anchors("text")).selectExpr("*", "text next_text", "anchors next_anchors")
    parts = min(PARTS, -(-n // rows))
    cuts = ids.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts + 1)], 10 * parts), F.max("doc_id")).first()
    # Quantiles are rounded where ids are large; the greatest id of each part is exact.
    rough = sorted({x for x in cuts[0] if x < cuts[1]} | {cuts[1]})
    bounds = sorted(r[0] for r in ids.groupBy(_part(rough)).agg(F.max("doc_id")).select("max(doc_id)").collect())
    first = F.get(F.lit(bounds), F.col("part")) == F.col("doc_id")
    places = F.when(first, F.array(F.struct(F.col("part"), F.lit(False).alias("next")), F.struct(((F.col("part") + 1) % len(bounds)).alias("part"), F.lit(True).alias("next"))))
    dealt = ids.withColumn("part", _part(bounds)).withColumn("place", F.explode(F.coalesce(places, F.array(F.struct("part", F.lit(False).alias("next"))))))
    dealt = dealt.select("doc_id", "text", "place.part", "place.next").repartition("part").withColumn("anchors", anchors("text"))
    order = Window.partitionBy("part").orderBy("next", F.desc("doc_id"), F.xxhash64("text"))
    led = dealt.withColumn("next_text", F.lead("text").over(order)).withColumn("next_anchors", F.lead("anchors").over(order)).where("not next").drop("part", "next")
    bare = docs.where("doc_id is null").withColumn("anchors", anchors("text")).selectExpr("*", "text next_text", "anchors next_anchors")
    return led.unionByName(bare)


def compared(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = PART) -> DataFrame:
    """One row per text: its fingerprint, that of the text whose last third is replaced by the beginning of the next
    document, and how alike these and the next document's are to its own."""
    plain = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    led = followed(plain, rows).withColumn("n_chars", F.char_length("text").cast("bigint"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = led.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - third), F.substring(F.col("next_text"), F.lit(1), third)))
    edited = edited.withColumn("edited_anchors", anchors("edited")).select("*", *(_different(c).alias(f"d_{c}") for c in ("anchors", "edited_anchors", "next_anchors")))
    return edited.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), written("anchors").alias("fingerprint"), written("edited_anchors").alias("edited_fingerprint"),
                         likeness("d_anchors", "d_edited_anchors").alias("near_edited"), likeness("d_anchors", "d_next_anchors").alias("near_next"))


def op13_syncmers(spark, folder: str) -> DataFrame:
    return compared(table(spark, folder, "documents"))
