"""Language identification by Bayesian fusion of four kinds of evidence.

    P(l | all) ~ P(l | host) * P(text | l) ** k * P(declared | l) * P(suffix | l)

* Text: naive Bayes over hashed letter trigrams. It is fitted on all texts of known language: each task sums trigrams by
  language, and the sums are added in a grouped aggregation. A text that repeats in a language counts once. k keeps a text's weight at EVIDENCE trigrams, since trigrams of one text are far from independent. The
  class "und" knows no trigram; it wins where a text looks like none of the languages.
* Declared language and address suffix (a two-letter top domain, or a language as a part of the path): how often either
  goes with a language is counted over all rows, the language being what the text alone says.
* Host: shares of the languages on a host, smoothed towards those of its domain, and these towards those of the corpus.
The counts are grouped aggregations with partial sums; the host's prior is joined to written rows without texts, so a host
with a third of all rows is a skewed join that adaptive execution splits.

A row is rejected if its text has no letters or "und" has a probability of CERTAIN; else it gets the likeliest language. Null or empty text: "und", rejected. Null declared
language, address or host give no evidence. A language needs LEAST_ROWS labelled texts; where none has
them, all texts with letters are accepted as "und". Repeated rows count each; null ids are kept. Other columns are not read.
An empty table gives no rows."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxtable.functions.stage import stage

from .common import BROADCAST_IDS, table
from .tokens import buffers, mix, pieces

LEAST_ROWS = 2
#: Languages whose sums a task holds, or the driver fetches, at once.
HELD = 64
BINS, EVIDENCE, SMOOTH, PRIOR, CERTAIN = 1 << 15, 60.0, 0.05, 20.0, 0.9


def _letters() -> np.ndarray:
    """Code of each byte: letters by themselves in lower case, bytes beyond ASCII by themselves, all else a gap."""
    code = np.zeros(256, np.uint64)
    for c in range(97, 123):
        code[c] = code[c - 32] = c
    code[128:] = np.arange(128, 256)
    return code


_CODE = _letters()


def trigrams(column: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, bins, row of each bin, letters of each row) of the letter trigrams, in bytes, of a few texts at a time."""
    data, offsets = buffers(column)
    for rows in pieces(offsets):
        edges = offsets[rows.start:rows.stop + 1]
        code = _CODE[data[edges[0]:edges[-1]]]
        row = np.repeat(np.arange(rows.stop - rows.start), np.diff(edges))
        letters = np.bincount(row[code > 0], minlength=rows.stop - rows.start)
        if len(code) < 3:
            yield rows, np.zeros(0, np.int64), np.zeros(0, np.int64), letters
            continue
        key = code[:-2] | code[1:-1] << np.uint64(8) | code[2:] << np.uint64(16)
        # A gap may end or begin a trigram, and the middle is a letter.
        good = (code[1:-1] > 0) & ((code[:-2] > 0) | (code[2:] > 0))
        good &= row[:-2] == row[2:]
        yield rows, (mix(key[good]) % np.uint64(BINS)).astype(np.int64), row[:-2][good], letters


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (language, text, weight) become (language, bin, n)."""
    held: dict[str, np.ndarray] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, n in held.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["language", "bin", "n"])
        held.clear()

    for batch in batches:
        langs, weights = np.array(batch.column(0).to_pylist(), object), batch.column(2).to_numpy()
        for rows, bins, row, _ in trigrams(batch.column(1)):
            names, of = np.unique(langs[rows], return_inverse=True)
            for k, lang in enumerate(names):
                if lang not in held:
                    if len(held) >= HELD:
                        yield from out()
                    held[lang] = np.zeros(BINS)
                mine = of[row] == k
                held[lang] += np.bincount(bins[mine], weights[rows][row[mine]], minlength=BINS)
    yield from out()


def fit(known: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and log2 P(bin | language), one row per language and "und" as the last, from rows (language, text)."""
    known = known.where("language is not null and text is not null and language <> ''").select("language", "text")
    sizes = known.groupBy("language").count().where(F.col("count") >= LEAST_ROWS).collect()
    langs = [x[0] for x in sorted(sizes, key=lambda x: (-x[1], x[0]))]
    at = {x: i for i, x in enumerate(langs)}
    counts = np.full((len(langs) + 1, BINS), SMOOTH)
    if langs:
        keyed = known.where(F.col("language").isin(langs)).withColumn("key", F.xxhash64("language", "text"))
        # Only what repeats is joined, so texts are not shuffled up to a checked number.
        repeated = stage(keyed.groupBy("key").count().where("count > 1"), "repeated")
        repeated = F.broadcast(repeated) if repeated.count() <= BROADCAST_IDS else repeated
        rows = keyed.join(repeated, "key", "left").select("language", "text", (1 / F.coalesce("count", F.lit(1))).alias("weight"))
        sums = stage(rows.mapInArrow(_sums, "language string, bin int, n double").groupBy("language", "bin").agg(F.sum("n").alias("n")), "trigrams")
        for k in range(0, len(langs), HELD):
            part = sums.where(F.col("language").isin(langs[k:k + HELD])).toArrow()
            row = np.array([at[x] for x in part["language"].to_pylist()], np.int64)
            counts[row, part["bin"].to_numpy()] += part["n"].to_numpy()
    return [*langs, "und"], np.log2(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def _likelihoods(weights: np.ndarray):
    """Rows (id, text) become (id, like, best, letters): weighted log2 likelihoods, the likeliest language by text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_of = np.ascontiguousarray(weights.T)
        for batch in batches:
            for rows, bins, row, letters in trigrams(batch.column(1)):
                n = rows.stop - rows.start
                count = np.bincount(row, minlength=n)
                like = np.zeros((n, table_of.shape[1]), np.float64)
                full = np.flatnonzero(count)
                if len(full):
                    first = np.cumsum(count) - count
                    like[full] = np.add.reduceat(table_of[bins], first[full], axis=0)
                like *= (np.minimum(count, EVIDENCE) / np.maximum(count, 1))[:, None]
                best = np.where(count > 0, like.argmax(axis=1), table_of.shape[1] - 1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * like.shape[1], pa.int32()), pa.array(like.ravel()))
                yield pa.RecordBatch.from_arrays([*(c.slice(rows.start, n) for i, c in enumerate(batch.columns) if i != 1), lists, pa.array(best.astype(np.int32)), pa.array(letters.astype(np.int64))],
                                                 [f for f in batch.schema.names if f != "text"] + ["like", "best", "letters"])
    return run


def _domain(host):
    """The last two parts of a host's name; another name is its own domain."""
    return F.coalesce(F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")), host)


def identify(docs: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text", declared: str | None = None, address: str | None = None) -> DataFrame:
    """(doc_id, language, probability, text_language, accepted) of every row of docs.

    known: (language, text), labelled rows. address: a URL, or just a host or source."""
    langs, weights = fit(known)
    n = len(langs)
    none = F.lit(None).cast("string")
    where = F.col(address).cast("string") if address else none
    host = F.lower(F.when(where.contains("://"), F.regexp_extract(where, r"://([^/?#:]+)", 1)).otherwise(where))
    path = F.lower(F.regexp_extract(where, r"[./]([A-Za-z]{2})(?:[/?#:]|$)", 1))
    inside = F.lower(F.regexp_extract(where, r"://[^/]*/([A-Za-z]{2})(?:[/?#]|$)", 1))
    suffix = F.when(inside.isin(langs), inside).when(path != "", path)
    said = F.lower(F.regexp_extract(F.col(declared).cast("string"), r"^\s*([A-Za-z]{2,3})", 1)) if declared else none
    said = F.when(said.isin(langs), said).when(said.isNotNull() & (said != ""), F.lit("other"))
    plain = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), said.alias("declared"), suffix.alias("suffix"), F.nullif(host, F.lit("")).alias("host"))
    rows = stage(plain.mapInArrow(_likelihoods(weights), "doc_id bigint, declared string, suffix string, host string, like array<double>, best int, letters bigint"), "likelihoods")
    rows = rows.withColumn("domain", _domain(F.col("host")))
    each = [F.sum((F.col("best") == i).cast("double")) for i in range(n)]

    def counted(key):
        return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.array(*each).alias("n"))

    overall = rows.agg(*[F.coalesce(e, F.lit(0.0)) for e in each]).first()
    size = sum(overall)
    share = [(c + 1) / (size + n) for c in overall]
    # P(value | language): at most one row per language or pair of letters.
    def reliability(key):
        t = counted(key)
        kinds = t.count() + 1
        return t.select(key, F.transform("n", lambda c, i: F.log2((c + 1) / (F.element_at(F.array(*map(F.lit, map(float, overall))), i + 1) + kinds))).alias(f"w_{key}"))

    def drawn(own, prior):
        """Shares of the own counts, drawn towards the prior's."""
        return F.zip_with(own, prior, lambda a, b: (a + PRIOR * b) / (F.aggregate(own, F.lit(0.0), lambda s, x: s + x) + PRIOR))

    domain = counted("domain").select("domain", drawn(F.col("n"), F.array(*map(F.lit, share))).alias("p"))
    hosts = stage(rows.where("host is not null").groupBy("host", "domain").agg(F.array(*each).alias("n")).join(domain, "domain").select("host", F.transform(drawn(F.col("n"), F.col("p")), lambda x: F.log2(x)).alias("w_host")), "hosts")
    told = rows.join(F.broadcast(reliability("declared")), "declared", "left").join(F.broadcast(reliability("suffix")), "suffix", "left").join(hosts, "host", "left")
    flat = F.array(*[F.lit(0.0)] * n)
    score = F.coalesce("w_host", F.array(*[F.log2(F.lit(p)) for p in share]))
    for w in (F.col("like"), F.coalesce("w_declared", flat), F.coalesce("w_suffix", flat)):
        score = F.zip_with(score, w, lambda a, b: a + b)
    named = told.withColumn("score", score).withColumn("top", F.array_max("score"))
    shares = named.withColumn("p", F.expr("transform(score, x -> pow(2D, x - top) / aggregate(score, 0D, (s, y) -> s + pow(2D, y - top)))"))
    shares = shares.withColumn("accepted", (F.col("letters") > 0) & ((F.element_at("p", n) < CERTAIN) | F.lit(n == 1))).withColumn("best_p", F.array_max(F.slice("p", 1, max(n - 1, 1))))
    names = F.array(*map(F.lit, langs))
    at = F.array_position("p", F.col("best_p")).cast("int")
    return shares.select(
        "doc_id", F.when(F.col("accepted"), F.element_at(names, at)).otherwise("und").alias("language"), F.when(F.col("accepted"), F.col("best_p")).when(F.col("letters") > 0, F.element_at("p", n)).otherwise(1.0).alias("probability"),
        F.element_at(names, F.col("best") + 1).alias("text_language"), "accepted")


def of_documents(docs: DataFrame) -> DataFrame:
    """Languages of a documents table: lang is what a document declares, source its host."""
    return identify(docs, docs.select(F.col("lang").alias("language"), "text"), declared="lang", address="source")


def op6_language(spark, folder: str) -> DataFrame:
    return of_documents(table(spark, folder, "documents"))
