"""The text pipeline: five stages, each written and read again, each of which works on all that the one before kept.

Documents that the quality rules reject go; of each group of near duplicates the smallest doc_id stays; documents in which a
window of the benchmark occurs go; personal data are replaced by their kinds; what is left is segmented into pieces.
All stages but the last return the columns of documents. The operators state what they do with nulls and empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from jobstrata.llm import decontam, jaccard, pieces, pii, rules
from jobstrata.llm.common import stored, table


#: Units that a Python worker keeps: workers outlive the stage, and the others need the memory.
UNITS = 150_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.kept_documents(docs)


def quality_rules_v2(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.kept_documents(docs, "v2")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.digest(docs, public_tokenizers.path("piece_bpe_32k.model"), limit=UNITS)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("sentencepiece", sentencepiece),
]

#: The same under policy v2, which also rejects words with marks between them.
STAGES_V2 = [("quality_rules", quality_rules_v2), *STAGES[1:]]

#: Segmentation can't be said in SQL; tests/llm hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, stages: list = STAGES) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(stages):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(stages):
            docs = stored(docs, name)
    return docs


def run_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, STAGES_V2)
