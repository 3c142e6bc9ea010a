"""The corpus pipeline: documents -> quality -> near duplicates -> decontamination -> personal data -> tokens.

Each stage takes what the one before kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm import bpe, decontaminate, ngram_join, pii, quality
from eventide.llm.common import materialize, table, unused

#: Near duplicates: words in a shingle, and hundredths of the union that two documents share at least.
WORDS, PERCENT = 5, 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. Without usable labels there is no classifier, and all stay."""
    labels = table(spark, sf_dir, "labels")
    if labels.filter("quality IN (0, 1)").isEmpty():
        return docs
    aside = {c: unused(docs, f"own_{c}") for c in docs.columns if c.lower() in ("score", "predicted")}
    judged = quality.classify(docs.withColumnsRenamed(aside), quality.train(docs, labels)).filter("predicted = 1")
    return judged.drop("score", "predicted").withColumnsRenamed({v: k for k, v in aside.items()}).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id; those without words or id stay. Rows of one id are one document."""
    groups = ngram_join.jaccard_join(docs, WORDS, PERCENT)
    dropped = materialize(groups.filter("component_id < doc_id").select(F.col("doc_id").alias("dropped")).distinct(), "near-duplicates")
    return docs.join(dropped, docs.doc_id == dropped.dropped, "left_anti")


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced by ``[KIND]`` and n_chars counted anew where that changed the text."""
    return pii.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of all documents."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), keep=False)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", keep_clean),
    ("PII", hide_personal_data),
    ("byte-level BPE encoding and decoding", tokenize),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + "".join(c if c.isalnum() else "-" for c in name))
    return STAGES[-1][1](spark, docs, sf_dir)
