"""Catalog of uploads: content ids, exact duplicates, status, names, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUPPORTED = r"\.(pdf|txt|md)$"


def supported(uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Uploads with a supported file name, and the others; null names are rejected."""
    good = F.coalesce(F.col("filename").rlike(SUPPORTED), F.lit(False))
    return uploads.filter(good), uploads.filter(~good)


def with_document_id(uploads: DataFrame) -> DataFrame:
    """Adds ``document_id``: the first 16 hex digits of the content's SHA-256."""
    return uploads.withColumn("document_id", F.substring(F.sha2(F.col("content"), 256), 1, 16))


def dedupe_uploads(uploads: DataFrame) -> DataFrame:
    """One row a content: the first upload's name and time, and how many there were.

    An aggregate with partial sums, so a much repeated content is no hot spot; contents don't move.
    """
    first = F.min(F.struct("upload_time", "filename"))
    by_id = with_document_id(uploads).groupBy("document_id").agg(first.alias("first"), F.count("*").alias("uploads"))
    return by_id.select("document_id", "first.filename", "first.upload_time", "uploads")


def pending_documents(uploads: DataFrame, catalog: DataFrame) -> DataFrame:
    """Distinct uploads that the catalog doesn't have as completed."""
    return dedupe_uploads(uploads).join(catalog.filter("status = 'completed'").select("document_id"), "document_id", "left_anti")


def fold_status(catalog: DataFrame, status_events: DataFrame) -> DataFrame:
    """Catalog with each document's latest status; events of unknown documents have no effect.

    Events are ordered by ``ts, event_id``; the first ``upload_time`` stays.
    """
    latest = status_events.join(catalog.select("document_id"), "document_id", "left_semi")
    latest = latest.groupBy("document_id").agg(F.max(F.struct("ts", "event_id", "status")).alias("last"), F.count("*").alias("changes"))
    out = catalog.join(latest, "document_id", "left")
    return out.withColumn("status", F.coalesce("last.status", "status")).withColumn("changes", F.coalesce("changes", F.lit(0))).drop("last")


def document_counts(nodes: DataFrame) -> DataFrame:
    """Nodes by document. ``num_chunks`` counts all nodes too; ``num_leaves`` those of layer 0."""
    return nodes.groupBy("document_id").agg(F.count("*").alias("num_chunks"), F.count("*").alias("num_nodes"), F.count_if(F.col("layer") == 0).alias("num_leaves"))


def display_names(catalog: DataFrame, sidecars: DataFrame) -> DataFrame:
    """``document_id, display_name``: the sidecar's name, or else the stored name without the id before it.

    What is left empty or begins with a dot falls back to the stored name; without any name it
    is "Unknown Document". Of several sidecars of a document the first name counts.
    """
    df = catalog.join(sidecars.groupBy("document_id").agg(F.min("original_filename").alias("original_filename")), "document_id", "left")
    bare = F.when(F.startswith("stored_name", "document_id"), F.substr("stored_name", F.length("document_id") + 1)).otherwise(F.col("stored_name"))
    bare = F.regexp_replace(bare, "^_+", "")
    bare = F.when((bare == "") | bare.startswith("."), F.col("stored_name")).otherwise(bare)
    return df.select("document_id", F.coalesce("original_filename", bare, F.lit("Unknown Document")).alias("display_name"))


def find_documents(catalog: DataFrame, requests: DataFrame) -> DataFrame:
    """Answers to ``request_id, document_id, filename``: status by id, or the first upload of a name."""
    by_id = requests.filter("document_id IS NOT NULL").select("request_id", "document_id").join(catalog.select("document_id", "status"), "document_id")
    named = catalog.groupBy("filename").agg(F.min(F.struct("upload_time", "document_id", "status")).alias("first"))
    by_name = requests.filter("document_id IS NULL").select("request_id", "filename").join(named, "filename")
    return by_id.select("request_id", "document_id", "status").union(by_name.select("request_id", "first.document_id", "first.status"))
