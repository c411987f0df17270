"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Writer options of tables with large rows: small row groups, since a reader holds a group of them.
LARGE_ROWS = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "4"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares: ``spark.checkpoint.dir``, or the checkpoint folder that the session was given. A
    temporary one serves only a session in one JVM; on a cluster the rest would not see what an executor wrote there."""
    sc, given = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if not sc.getCheckpointDir():
        if given is None and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="siteview-"))
    return given or sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of a narrow table; the copy survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, **options: str) -> DataFrame:
    """As ``checkpointed``, as compressed Parquet, for tables of many rows; ``options`` are the writer's."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/siteview-{uuid.uuid4().hex}"
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(column: str, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; a null id falls in bucket 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % buckets, F.lit(0))


def label_sample(labels: DataFrame, label: str, folds: int, limit: int) -> DataFrame:
    """(doc_id, label) of training rows: fold not 0, one row a document (the mean of repeated labels, 0.5 up
    counts as 1). At most ``limit`` rows, half of them of each label, those with the smallest hash of the id."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (id_bucket("doc_id", folds) != 0))
        .groupBy("doc_id")
        .agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    )
    half = [known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit // 2) for y in (0, 1)]
    return half[0].union(half[1])
