"""From raw documents to packed training sequences, in five stages. Each reads the documents its predecessor kept.

Filters name the documents that go, by doc_id; few go, so texts are not shuffled for them. Rows without doc_id stay in every
filter, since nothing names them; rows of one doc_id go together. Whole texts are read, of any length. Other columns pass
unchanged, also those whose names the operators use themselves. An empty table gives an empty one."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from voxtable.functions.stage import stage
from voxtable.llm import bin_slack, disclosure, language, minhash_forest, spaced_seeds
from voxtable.llm.common import table, without


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: no letters (so null and empty texts, too), or no language likely enough."""
    rejected = stage(language.of_documents(docs).where("not accepted").select("doc_id").distinct(), "rejected")
    return without(docs, rejected, "doc_id").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of least doc_id stays. Null and empty texts are nobody's copies and stay. Rows of one
    doc_id count as one document, so both stay or both go."""
    copies = stage(minhash_forest.near_duplicates(docs).where("not kept").select("doc_id").distinct(), "copies")
    return without(docs, copies, "doc_id").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go. Null and empty texts and items overlap with nothing."""
    found = stage(spaced_seeds.contamination(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "contaminated")
    return without(docs, found, "doc_id").select(*docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by their kind, terms that give them away generalised or removed; n_chars follows the text.
    Each row has its own spans, also beside others of its doc_id; without doc_id no terms are looked up. Null stays null."""
    return disclosure.sanitise(docs).selectExpr(*("cast(char_length(text) as bigint) n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences. A null or empty text is its end id alone; repeated rows are packed
    each."""
    return bin_slack.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language ID", language_id), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("PII", pii), ("best-fit packing", packing)]

#: No stage but PII can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each result being written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, function) in enumerate(STAGES):
        docs = stage(function(spark, docs, sf_dir), f"stage-{k + 1}")
    return docs
