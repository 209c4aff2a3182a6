"""Forests: all documents' trees grow a layer at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctree_spark.functions.plugins import TOKENS, Tokens
from doctree_spark.operators import cluster, tree
from doctree_spark.operators.embed import Embedder, embed, hash_embedder
from doctree_spark.operators.models import Calls
from doctree_spark.sources.lineage import cut, written
from doctree_spark.sources.store import remove

LEAST_NODES = 2
MOST_LAYERS = 12
SLICE_ITEMS = 100_000
NODE = ["document_id", "node_id", "layer", "text", "embedding", "children", "token_count"]
_KEY = ["document_id", "layer", "cluster"]


def build_forest(
    chunks: DataFrame, make_embedder: Callable[[], Embedder] = hash_embedder, make_summarizer: Callable[[], tree.Summarizer] | None = None, make_verifier: Callable[[], tree.Verifier] | None = None,
    calls: Calls = Calls(), attempts: int = 2, kept: str | None = None, slice_items: int = SLICE_ITEMS, least_nodes: int = LEAST_NODES, max_context_tokens: int = tree.MAX_CONTEXT_TOKENS,
    max_cluster_tokens: int = cluster.MAX_CLUSTER_TOKENS, most_clusters: int = cluster.MAX_CLUSTERS, most_layers: int = MOST_LAYERS, model: str = "hash-64", tokens: Tokens = TOKENS,
) -> tuple[DataFrame, DataFrame]:  # fmt: skip  # noqa: B008
    """Nodes and trees of ``document_id, chunk_no, text, token_count`` rows.

    While a document's top layer has more than ``least_nodes`` nodes and more than one cluster,
    its clusters become the next layer. ``most_layers`` ends trees that soft clusters keep from
    shrinking; these have ``complete`` false. Summaries that ``make_verifier``'s model doesn't
    pass are made anew, up to ``attempts`` in all; ``failures`` counts those that never passed.

    Args:
        calls: how both models are called: batches, retries, calls at a time.
        kept: folder in which summaries are kept as they are made, by document, layer, cluster
            and a hash of their context. A build that died is resumed with the same folder: it
            calls no model for a context whose summary is there. Removed when the build is done.
        tokens: how tokens are counted (``plugins``); the chunks' ``token_count`` should come from the same.
        slice_items: contexts whose summaries are kept together, so that what a death costs is bounded.
    """
    if kept:
        _saved(chunks, []).write.mode("append").parquet(kept)
    # tables, not checkpoints: these would carry what Spark knows of each layer's expressions into the next, whose planning takes ever longer
    top = written(tree.leaf_nodes(embed(chunks, "text", make=make_embedder, deal=True)).select(NODE))
    layers, failures, complete = top, None, False
    for layer in range(1, most_layers):
        sizes = top.groupBy("document_id").agg(F.count("*").alias("__n"), F.sum("token_count").alias("__tokens"))
        growing, largest, longest = sizes.agg(F.count_if(F.col("__n") > least_nodes), F.max("__n"), F.max("__tokens")).head()
        if not growing:
            complete = True
            break
        growing = top.join(sizes.filter(F.col("__n") > least_nodes).select("document_id"), "document_id", "left_semi")
        clusters = cluster.cluster_layer(growing, most=most_clusters, largest=largest)
        # no cluster has more tokens than its document's layer
        if longest > max_cluster_tokens:
            clusters = cluster.split_overflow(clusters, growing, max_cluster_tokens, most=most_clusters, largest=largest)
        several = clusters.groupBy("document_id").agg(F.max("cluster").alias("__last")).filter("__last > 0").select("document_id")
        clusters = cut(clusters.join(several, "document_id", "left_semi"))
        members = clusters.join(growing.select("document_id", "node_id", "layer", "text"), ["document_id", "node_id"])
        contexts = tree.cluster_context(members, max_context_tokens, tokens).withColumn("layer", F.lit(layer))
        said = _summaries(contexts, make_summarizer, make_verifier, calls, attempts, kept, slice_items, tokens)
        if make_verifier:
            failed = said.groupBy("document_id").agg(F.count_if(~F.col("passed")).alias("failures"))
            failures = failed if failures is None else failures.union(failed)
        next_ids = growing.groupBy("document_id").agg((F.max("node_id") + F.lit(1).cast("long")).alias("next_id"))
        parents = tree.make_parents(members.join(said.select("document_id", "cluster", "summary"), ["document_id", "cluster"]), next_ids, tokens)
        top = written(embed(parents, "text", make=make_embedder).select(NODE))
        layers = layers.union(top)
    last = layers.groupBy("document_id").agg(F.max("layer").alias("__top"))
    trees = layers.join(last, "document_id").groupBy("document_id").agg(F.array_sort(F.collect_list(F.when(F.col("layer") == F.col("__top"), F.col("node_id")))).alias("root_ids"), (F.max("__top") + 1).alias("num_layers"))
    trees = trees.withColumn("embed_model", F.lit(model)).withColumn("source", F.lit(None).cast("string"))
    trees = trees.withColumn("complete", F.lit(True) if complete else (F.col("num_layers") < most_layers) | (F.size("root_ids") <= least_nodes))
    lost = failures.groupBy("document_id").agg(F.sum("failures").alias("failures")) if failures is not None else None
    trees = trees.join(lost, "document_id", "left").withColumn("failures", F.coalesce("failures", F.lit(0))) if lost is not None else trees.withColumn("failures", F.lit(0).cast("long"))
    trees = cut(trees)
    if kept:
        remove(chunks.sparkSession, kept)
    return layers, trees


def _saved(df: DataFrame, rows: list) -> DataFrame:
    kind = df.schema["document_id"].dataType.simpleString()
    return df.sparkSession.createDataFrame(rows, f"document_id {kind}, layer int, cluster int, context_hash string, summary string, passed boolean")


def _summaries(contexts: DataFrame, make_summarizer: Callable | None, make_verifier: Callable | None, calls: Calls, attempts: int, kept: str | None, slice_items: int, tokens: Tokens) -> DataFrame:
    """``document_id, layer, cluster, context_hash, summary, passed``, each made once: kept ones are read, the others made and kept."""
    spark = contexts.sparkSession
    saved = spark.read.schema(_saved(contexts, []).schema).parquet(kept) if kept else None
    pending = tree.resume_pending(contexts, saved, _KEY) if kept else contexts.withColumn("context_hash", F.sha2("context", 256))
    summarize = lambda df, attempt: tree.summarize_clusters(df, make_summarizer, calls, sentence=False, tokens=tokens)

    def made(some: DataFrame) -> DataFrame:
        if make_verifier:
            said, _ = tree.verify_summaries(some, summarize, tree.judged(make_verifier, calls, tokens), attempts)
        else:
            said = summarize(some, 1).withColumn("passed", F.lit(True))
        return said.select(*_KEY, "context_hash", "summary", "passed")

    if make_verifier or kept and make_summarizer:
        pending = cut(pending)
    if not kept:
        # without a verifier they are read once
        return cut(made(pending)) if make_verifier else made(pending)
    slices = -(-pending.count() // slice_items) if make_summarizer else 1
    for k in range(slices):
        part = pending if slices == 1 else pending.filter(F.pmod(F.xxhash64(*_KEY), F.lit(slices)) == k)
        made(part).write.mode("append").parquet(kept)
    every = spark.read.schema(saved.schema).parquet(kept)
    hashed = contexts.select(*_KEY, F.sha2("context", 256).alias("context_hash"))
    return every.join(hashed, [*_KEY, "context_hash"], "left_semi")
