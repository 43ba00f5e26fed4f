"""A training corpus from raw documents, in five stages.

Quality rules reject bad documents; of each group of near duplicates (five-word shingles, Jaccard
similarity 0.8 or more) the one with the least doc_id stays; documents with a copy of a benchmark item
go; secrets are replaced in the texts; the rest is encoded. Each stage takes all that the stage before
kept and returns the columns of ``documents``, the last one (doc_id, n_tokens, ids).

Defined results: of rows that agree in doc_id and text one stays; rows that share a doc_id with different
texts are documents of their own, each judged by its text; rows without a doc_id are never near duplicates; a
null text fails the quality rules; columns besides ``documents``'s own pass through unchanged, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterloom.llm import bpe, decontam, quality, secrets, simhash
from shutterloom.llm.common import table, unused
from shutterloom.session import dropped, written

#: The vocabulary that the last stage encodes with.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    into = unused(docs, "judgement")
    return quality.judged(docs, model, into=into).where(F.col(f"`{into}`.kept")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced."""
    out = secrets.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every document."""
    return bpe.bpe_encode(docs, VOCABULARY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("encoding", encoding),
]

#: SQL expresses none of learning, fingerprints, alignment or BPE; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            dropped(before)
        before = docs
    return docs
