"""From raw documents to token ids, stage by stage; each stage's rows are written before the next reads them.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; all but the
last return the columns of `documents`. Nulls, empty and very long texts, repeated rows and empty
tables have the results that the operators' own docstrings define.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sheafmill.llm import bpe, decontamination, near_dedup, quality_rules, secrets
from sheafmill.llm.common import scratch, shared_dir, stored, table
from sheafmill.llm.queries import PATTERN, VOCABULARY


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_rules.keep(docs, quality_rules.fit(docs, trusted))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id."""
    return near_dedup.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.cleaned(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, and linked parts of credentials, are replaced by their kind in brackets."""
    return secrets.redacted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with the digests of a round trip."""
    return bpe.round_trip(docs, VOCABULARY, PATTERN, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near-dedup", dedup),
    ("decontamination", decontaminate),
    ("secret scan", redact),
    ("byte-level BPE", encode),
]

#: SQL can't express the tokenizer's merges nor the language models; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        with scratch(spark):  # what a stage wrote on its way isn't read again
            docs = stored(stage(spark, docs, sf_dir), f"{folder}/stage-{k}")
    return docs
