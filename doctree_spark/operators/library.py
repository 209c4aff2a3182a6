"""A library of documents that grows by batches of uploads, from their bytes to saved trees."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doctree_spark.functions.plugins import SENTENCES, TOKENS, Sentences, Tokens
from doctree_spark.functions.text import strip
from doctree_spark.operators import build, chunk, ingest
from doctree_spark.sources import store
from doctree_spark.sources.lineage import cut

NO_CHUNKS = "failed: No chunk of the document is long enough."
EVENTS = "document_id string, ts timestamp, event_id long, status string, batch int"
#: Documents of a batch that may fail at a build.
MOST_FAILURES = 20
#: Where a message begins: the kind of an error.
ERROR_LINE = re.compile(r"(?:\w+\.)*\w*(?:Error|Exception)\b")
CATALOG = "document_id string, filename string, status string, upload_time timestamp, num_nodes long, num_leaves long, batch int"


def catalog(spark: SparkSession, library: str) -> DataFrame:
    """The library's documents, each as its latest batch left it: ``CATALOG``."""
    rows = store.read_if_there(spark, f"{library}/catalog", CATALOG)
    latest = rows.withColumn("__nth", F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("batch"))))
    return latest.filter("__nth = 1").drop("__nth")


def forest(spark: SparkSession, library: str, active_model: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and trees of the library's completed documents, checked as ``load_forest`` does."""
    return store.load_forest(spark, f"{library}/forest", active_model, catalog(spark, library).filter("status = 'completed'").select("document_id"))


def events(spark: SparkSession, library: str) -> DataFrame:
    """What has happened to documents, in order of ``ts, event_id``: ``EVENTS``."""
    return store.read_if_there(spark, f"{library}/events", EVENTS)


def statuses(spark: SparkSession, library: str) -> DataFrame:
    """Every document ever taken in, with its latest status: while a batch runs, ``processing``."""
    happened = events(spark, library)
    first = happened.groupBy("document_id").agg(F.lit("uploaded").alias("status"), F.min("ts").alias("upload_time"))
    return ingest.fold_status(first, happened)


def _note(rows: DataFrame, library: str, batch: int, stage: int) -> None:
    """Appends a status a document of ``document_id, status``."""
    noted = rows.select("document_id", F.current_timestamp().alias("ts"), F.lit(batch * 10 + stage).cast("long").alias("event_id"), "status", F.lit(batch).alias("batch"))
    store.append_keyed(noted, f"{library}/events", "document_id")


def _isolated(texts: DataFrame, make: Callable[[DataFrame], tuple[DataFrame, DataFrame]], most_failures: int) -> tuple[list[tuple[DataFrame, DataFrame]], list[tuple[str, str]]]:
    """Trees of ``texts`` by ``make``, and documents at which it raises with what they raise.

    What raises is halved by a hash of ids until single documents are left, so one costs the
    logarithm of the batch in builds. Over ``most_failures`` such documents, the last error is
    raised: the cause isn't in the documents.
    """
    done, failed, left = [], [], [(texts, 0)]
    while left:
        some, depth = left.pop()
        try:
            done.append(make(some))
            continue
        except Exception as error:  # models and readers may fail in any way
            ids = [r[0] for r in some.select("document_id").distinct().limit(2).collect()]
            if len(ids) < 2:
                failed += [(i, _message(error)) for i in ids]
                if len(failed) > most_failures:
                    raise
                continue
        half = F.shiftright(F.xxhash64("document_id"), depth % 64) % 2 == 0
        left += [(some.filter(half), depth + 1), (some.filter(~half), depth + 1)]
    return done, failed


def _message(error: Exception) -> str:
    """The last line of what a task or the driver raised, at most 200 characters."""
    lines = [x.strip() for x in str(error).splitlines() if x.strip() and not x.strip().startswith(("at ", "File ", "..."))]
    raised = [x for x in lines if ERROR_LINE.match(x)]
    return (raised or lines or [type(error).__name__])[-1 if raised else 0][:200]


def add_uploads(uploads: DataFrame, library: str, most_failures: int = MOST_FAILURES, tokens: Tokens = TOKENS, split: Sentences = SENTENCES, **how: object) -> DataFrame:
    """Takes a batch of uploads (``filename, content, upload_time``) into the library and returns its catalog.

    Unsupported names are left out, a null content is empty, equal contents are one document, and what the catalog has as
    completed isn't processed again; documents that failed are. Trees are built with
    ``build_forest``'s arguments ``how``. A batch that died is processed again as a whole: its
    trees are written over, and summaries it had are reused.

    Each document's status is noted when the batch begins (``processing``) and when it ends
    (``completed``, or ``failed: `` and why). A document at which a build raises fails alone;
    over ``most_failures`` of them the batch raises.
    """
    spark = uploads.sparkSession
    content = F.coalesce("content", F.lit("").cast(uploads.schema["content"].dataType))
    good, _ = ingest.supported(uploads.withColumn("content", content))
    known = catalog(spark, library)
    batch = (known.agg(F.max("batch")).head()[0] or 0) + 1
    new = cut(ingest.pending_documents(good, known))
    _note(new.withColumn("status", F.lit("processing")), library, batch, 0)
    texts = ingest.with_document_id(good).join(new.select("document_id"), "document_id", "left_semi").groupBy("document_id").agg(F.first("content").cast("string").alias("text"))
    texts = cut(texts.select("document_id", F.coalesce("text", F.lit("")).alias("text")))

    def made(some: DataFrame) -> tuple[DataFrame, DataFrame]:
        chunks = cut(chunk.chunk_documents(some, tokens=tokens, split=split))
        return build.build_forest(chunks, kept=f"{library}/summaries", tokens=tokens, **how)

    parts, failed = _isolated(texts, made, most_failures)
    lost = spark.createDataFrame(failed, "document_id string, __error string")
    if parts:
        nodes, trees = (reduce(DataFrame.unionByName, side) for side in zip(*parts, strict=True))
        store.save_forest(nodes, trees, f"{library}/forest", batch=batch)
        counts = ingest.document_counts(nodes).select("document_id", "num_nodes", "num_leaves")
    else:
        counts = new.limit(0).select("document_id", F.lit(0).cast("long").alias("num_nodes"), F.lit(0).cast("long").alias("num_leaves"))
    blank = texts.filter(strip(F.col("text")) == "").select("document_id", F.lit(True).alias("__blank"))
    done = new.join(counts, "document_id", "left").join(blank, "document_id", "left").join(lost, "document_id", "left")
    status = F.when(F.col("__error").isNotNull(), F.concat(F.lit("failed: "), "__error")).when(F.col("__blank"), chunk.EMPTY).when(F.col("num_nodes").isNull(), NO_CHUNKS).otherwise("completed")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    rows = cut(done.select("document_id", "filename", status.alias("status"), F.col("upload_time").cast("timestamp").alias("upload_time"), zero("num_nodes"), zero("num_leaves"), F.lit(batch).alias("batch")))
    store.append_keyed(rows, f"{library}/catalog", "document_id")
    _note(rows, library, batch, 1)
    return catalog(spark, library)
