"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, one below the warehouse, which is shared too.

    Nothing here deletes what jobs leave there: checkpoints go with their DataFrames where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set, tables when the folder's owner
    clears it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.shared"
    return root.rstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/{uuid.uuid4().hex}"


def written(df: DataFrame, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, written with ``options``: cuts lineage and is computed once."""
    path = shared_dir(df.sparkSession)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_alone(df: DataFrame, **options: str) -> DataFrame:
    """``written``, after which Spark removes the shuffle files that it took."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name)
    conf.set(name, "true")
    try:
        return written(df, **options)
    finally:
        conf.set(name, before)


def written_in_buckets(df: DataFrame, by: list[str], buckets: int) -> DataFrame:
    """``written``, as a table in buckets: joins on ``by`` meet its rows without moving them."""
    path = shared_dir(df.sparkSession)
    name = f"kept_{path.rsplit('/', 1)[-1]}"
    df.repartition(buckets, *by).write.format("parquet").bucketBy(buckets, *by).sortBy(*by).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and checkpointed in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()
