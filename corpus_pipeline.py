"""The corpus pipeline: stages over documents, each written as Parquet and read by the next.

Quality rules and toxicity drop the documents they reject, near-duplicate detection
keeps exactly one row of each component (similarity 0.80 or more): the one with the
smallest id. PII replaces personal data in the texts, and packing returns the places of
all pieces of what is left. All stages but the last return the columns of their input.
Nulls, empty texts, ties, repeated rows and empty tables are handled as each operator's
module says. Column names may clash with those an operator adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veritide.llm import neardup, packing, pii, quality, toxicity
from veritide.llm.queries import table, tokenizer_path
from veritide.scratch import written
from veritide.session import ship

#: Texts that share so many percent of their five-word shingles are near copies; op9_minhash_neardup has a threshold of its own.
PERCENT = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs, PERCENT)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path(), capacity=2048)


STAGES = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("near duplicates", near_duplicate_stage),
    ("personal data", pii_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None


ship_first = lambda stage: lambda spark, docs, sf_dir: ship(spark) or stage(spark, docs, sf_dir)
STAGES = [(name, ship_first(stage)) for name, stage in STAGES]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
