"""The corpus pipeline: rules, classifier, near-duplicates, mixing, tokens. Each stage reads what the last one wrote."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from flowspark.llm._shared import table, written
from flowspark.llm.bpe import encode_documents
from flowspark.llm.minhash import keep_one
from flowspark.llm.mixing import TARGET_WEIGHTS, replicate
from flowspark.llm.quality import keep_by_rules
from flowspark.llm.weak_labels import classify

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or lie far from their language and source."""
    return keep_by_rules(docs.select(*COLUMNS))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the weakly trained scorer rejects."""
    return classify(docs, columns=COLUMNS).filter("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the member of least doc_id of each class of near-duplicates."""
    return keep_one(docs).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replicates documents to the target weights of their sources, in a global random order."""
    return replicate(docs, TARGET_WEIGHTS).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each copy of a document, with the digests of the ids and of what they decode to."""
    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", rules),
    ("quality_classifier", classifier),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("bpe_tokens", tokens),
]

#: SQL can't express the classifier, the near-duplicates or the tokens; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
