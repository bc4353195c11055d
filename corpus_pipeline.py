"""A corpus pipeline: toxicity, near duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as
Parquet and read again as the next one's ``docs``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trigrove.llm import decontaminate, mixing, neardup, toxicity
from trigrove.llm.common import staged, table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject.  Nulls, empty texts and
    repeated rows are judged by their text like any row; an empty table stays
    empty."""
    return toxicity.accepted(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id
    (five-word shingles, a similarity of 0.8 or more).  Null and empty texts have
    no copies and stay."""
    return neardup.keep_one(docs, 80, 100)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item, whole or edited; null and empty texts
    hold none."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in the mix of sources; a null source is a
    source of its own."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("near-duplicates", remove_near_duplicates),
    ("decontamination", remove_benchmark),
    ("mixing", mix_sources),
]

#: Trees, signatures and alignments aren't SQL: the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table ``documents``, each written before the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, f"pipeline-{name}")
    return docs
