"""Five stages over a corpus: reject toxic documents, keep one of each near-duplicate group, drop documents that hold
benchmark items, mask personal data, encode. Each stage reads what the one before it wrote as Parquet.

No SQL gives the rows: two stages learn models or count over hashed keys, so ORACLE_SQL is None and
tests/llm/test_pipeline.py checks each stage against brute force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from siteview.llm import decontam, neardup, pii, subword, toxicity
from siteview.llm.common import checkpointed, shared_dir, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles; texts of fewer words are one shingle. Rows without shingles stay."""
    groups = neardup.near_duplicate_groups(docs, shingle=5)
    dropped = checkpointed(groups.where("not kept").select("doc_id").distinct().withColumnRenamed("doc_id", "_dropped"))
    return docs.join(dropped, docs["doc_id"].cast("long") == dropped["_dropped"], "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitise(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return subword.encode(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal data", mask_personal_data),
    ("sentencepiece", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
