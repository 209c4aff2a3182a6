"""Query logs and reports on trees, retrievals and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doctree_spark.sources.store import append_keyed, with_keys


def log_queries(records: DataFrame, path: str) -> None:
    """Appends query records to the log at ``path``, in which few ids are found without a scan."""
    append_keyed(records, path, "query_id")


def find_query(log: DataFrame, query_id: str) -> DataFrame:
    return log.filter(F.col("query_id") == query_id)


def find_queries(log: DataFrame, requests: DataFrame) -> DataFrame:
    """The log's records of the ``query_id`` in ``requests``; few are a filter of the scan, more a join."""
    return with_keys(log, "query_id", requests)


def retrieved_by_level(retrieved: DataFrame, nodes: DataFrame) -> DataFrame:
    """``query_id, total_retrieved, levels``: levels descending, nodes of each in rank order.

    A node with children has its text as summary; a missing score counts as 0.
    """
    extra = nodes.select("document_id", "node_id", "text", F.when(F.size("children") > 0, F.col("text")).alias("summary"))
    df = retrieved.join(extra, ["document_id", "node_id"])
    node = F.struct("rank", F.col("node_id").cast("string").alias("node_id"), F.coalesce("score", F.lit(0.0)).alias("similarity"), "text", "summary")
    by_level = df.groupBy("query_id", "layer").agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    level = F.struct((-F.col("layer")).alias("order"), F.col("layer").alias("level"), "nodes")
    out = by_level.groupBy("query_id").agg(F.sum(F.size("nodes")).alias("total_retrieved"), F.array_sort(F.collect_list(level)).alias("levels"))
    return out.withColumn("levels", F.transform("levels", lambda x: F.struct(x.level.alias("level"), x.nodes.alias("nodes"))))


def retrieval_summary(retrieved: DataFrame) -> DataFrame:
    """``query_id, level, nodes, total``."""
    by_level = retrieved.groupBy("query_id", F.col("layer").alias("level")).agg(F.count("*").alias("nodes"))
    return by_level.withColumn("total", F.sum("nodes").over(Window.partitionBy("query_id")))


def level_overlay(summary: DataFrame, retrieved: DataFrame) -> DataFrame:
    """``document_id, level, num_clusters, retrieved``: trees' levels with how many of their nodes were retrieved."""
    levels = summary.select("document_id", F.explode("levels").alias("l")).select("document_id", "l.level", "l.num_clusters")
    counts = retrieved.groupBy("document_id", F.col("layer").alias("level")).agg(F.count("*").alias("retrieved"))
    return levels.join(counts, ["document_id", "level"], "left").withColumn("retrieved", F.coalesce("retrieved", F.lit(0)))


def top_sources(retrieved: DataFrame, nodes: DataFrame, most: int = 3, snippet: int = 100) -> DataFrame:
    """``query_id, place, node_id, level, percent, band, snippet``: the first ``most`` nodes, highest levels first."""
    order = Window.partitionBy("query_id").orderBy(F.desc("layer"), "rank")
    few = retrieved.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    df = few.join(nodes.select("document_id", "node_id", "text", "children"), ["document_id", "node_id"])
    text = F.when(F.size("children") > 0, F.col("text")).otherwise(F.concat(F.substring("text", 1, snippet), F.lit("...")))
    score = F.coalesce("score", F.lit(0.0))
    band = F.when(score >= 0.9, "high").when(score >= 0.8, "medium").otherwise("low")
    return df.select("query_id", "place", "node_id", F.col("layer").alias("level"), F.round(score * 100).cast("int").alias("percent"), band.alias("band"), text.alias("snippet"))


def list_conversations(conversations: DataFrame) -> DataFrame:
    return conversations.groupBy("conv_id").agg(F.count("*").alias("messages"))


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """``conv_id, messages``: turns of a conversation in order."""
    return conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
