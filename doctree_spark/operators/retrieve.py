"""Batches of queries against trees of nodes: scores, budgets, traversal, filters, merging.

``queries`` have ``query_id, document_id, embedding``; ``nodes`` the forest's columns. Scores are
rounded to six digits before anything compares them. Ranks follow score descending, then
position descending.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doctree_spark.functions.vector import dot, doubles
from doctree_spark.sources.lineage import cut

MAX_TOKENS = 2000
TOP_K = 3
LAYER_SCORE = 0.3
RELEVANCE = 0.45
REDUNDANCY = 0.75

#: Nodes of a document scored together, queries of a document in one salt, and queries multiplied at a time.
BLOCK_NODES, SALT_QUERIES, QUERIES_AT_ONCE = 2048, 20_000, 256

COLUMNS = ["query_id", "document_id", "node_id", "layer", "score", "token_count"]


def score(queries: DataFrame, nodes: DataFrame, max_tokens: int | None = None, most: int | None = None) -> DataFrame:
    """Queries with the nodes of their document: ``COLUMNS``; rows without a vector have no scores.

    A document's nodes are cut into blocks and its queries salted, so that neither gathers in one
    task; each block's vectors move once for every salt, and matrix products score them. Of each
    query and block only what can count leaves the task: with ``max_tokens``, of nodes with t
    tokens the best max_tokens / t; with ``most``, the best so many.
    """
    q = queries.filter("embedding IS NOT NULL").select("document_id", "query_id", doubles(F.col("embedding")).alias("v"))
    n = nodes.filter("embedding IS NOT NULL").select("document_id", "node_id", "layer", "token_count", doubles(F.col("embedding")).alias("v"))
    sizes = n.groupBy("document_id").agg((F.floor(F.max("node_id") / BLOCK_NODES) + 1).alias("__blocks"))
    sizes = sizes.join(q.groupBy("document_id").agg(F.ceil(F.count("*") / SALT_QUERIES).alias("__salts")), "document_id")
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1))
    n = n.join(sizes, "document_id").withColumn("__block", F.floor(F.col("node_id") / BLOCK_NODES)).withColumn("__salt", every("__salts"))
    q = q.join(sizes, "document_id").withColumn("__salt", F.pmod(F.xxhash64("query_id"), F.col("__salts"))).withColumn("__block", every("__blocks"))
    key = ["document_id", "__block", "__salt"]
    both = n.withColumn("__side", F.lit(0)).unionByName(q.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    both = both.select(*key, F.xxhash64(*key).alias("__group"), "__side", "query_id", "node_id", "layer", "token_count", "v")
    dealt = both.repartition(*key).sortWithinPartitions(*key, "__side").drop("__block", "__salt")
    kinds = [f"query_id {q.schema['query_id'].dataType.simpleString()}", f"document_id {q.schema['document_id'].dataType.simpleString()}", "node_id int, layer int, score double, token_count int"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, block = None, [], None
        for batch in batches:
            names, side = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            edges = np.flatnonzero((names[1:] != names[:-1]) | (side[1:] != side[:-1])) + 1
            for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if a == b:
                    continue
                if names[a] != group:
                    group, held, block = names[a], [], None
                if side[a] == 0:
                    held.append(batch.slice(a, b - a))
                    continue
                block = block or _Block(held)
                for at in range(a, b, QUERIES_AT_ONCE):
                    part = batch.slice(at, min(b, at + QUERIES_AT_ONCE) - at)
                    query, node, scores = block.scores(part.column(7), max_tokens, most)
                    at_query = pa.array(query)
                    yield pa.RecordBatch.from_arrays([part.column(3).take(at_query), part.column(0).take(at_query), pa.array(block.node[node]), pa.array(block.layer[node]), pa.array(scores), pa.array(block.tokens[node])], names=COLUMNS)

    return dealt.mapInArrow(run, ", ".join(kinds)).select(COLUMNS)


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


class _Block:
    """Some nodes of a document."""

    def __init__(self, batches: list[pa.RecordBatch]) -> None:
        whole = pa.Table.from_batches(batches).combine_chunks()
        self.node, self.layer, self.tokens = (whole.column(k).to_numpy().astype(np.int32) for k in (4, 5, 6))
        self.vectors = np.concatenate([_matrix(x) for x in whole.column(7).chunks])

    def scores(self, queries: pa.Array, max_tokens: int | None, most: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of queries and nodes that can count, and their scores."""
        near = np.round(_matrix(queries) @ self.vectors.T, 6) + 0.0
        query, node = (x.ravel() for x in np.indices(near.shape))
        near = near.ravel()
        if max_tokens is not None:
            tokens = self.tokens[node]
            nth = _nth(query, tokens, near, self.node[node])
            good = (tokens <= max_tokens) & (nth * tokens.astype(np.int64) <= max_tokens)
            query, node, near = query[good], node[good], near[good]
        if most is not None:
            good = _nth(query, np.zeros_like(query), near, self.node[node]) <= most
            query, node, near = query[good], node[good], near[good]
        return query, node, near


def _nth(query: np.ndarray, kind: np.ndarray, near: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Which place each row has among its query's of its kind, by score and node descending, from 1."""
    order = np.lexsort((-node, -near, kind, query))
    new = np.ones(len(order), bool)
    new[1:] = (query[order][1:] != query[order][:-1]) | (kind[order][1:] != kind[order][:-1])
    at = np.arange(len(order))
    out = np.empty(len(order), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(new, at, 0)) + 1
    return out


def budget_fill(scored: DataFrame, max_tokens: int) -> DataFrame:
    """Ranked rows that a greedy walk takes: each that still fits, skipping those that don't. Adds ``rank``.

    Before rows of a query come together, those that can't be taken go: of rows with t tokens
    only the first max_tokens / t can fit. What is left of a query is bounded by the budget, not
    by the tree (max_tokens times the harmonic number of max_tokens).
    """
    order = [F.desc("score"), F.desc("node_id")]
    alike = Window.partitionBy("query_id", "token_count").orderBy(*order)
    pruned = scored.filter(F.col("token_count") <= max_tokens).withColumn("__nth", F.row_number().over(alike))
    pruned = pruned.filter(F.col("__nth") * F.col("token_count") <= max_tokens)
    row = F.struct((-F.col("score")).alias("s"), (-F.col("node_id")).alias("n"), "document_id", "layer", "token_count")
    ranked = pruned.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<int>").alias("taken"))
    at = F.transform("rows", lambda r, i: F.struct(i.alias("i"), r.token_count.alias("t")))
    step = lambda a, x: F.when(a.used + x.t <= max_tokens, F.struct((a.used + x.t).alias("used"), F.array_append(a.taken, x.i).alias("taken"))).otherwise(a)
    taken = F.aggregate(at, start, step, lambda a: a.taken)
    out = ranked.withColumn("taken", taken).select("query_id", F.posexplode(F.transform("taken", lambda i: F.get("rows", i))).alias("rank", "r"))
    return out.select("query_id", "r.document_id", (-F.col("r.n")).alias("node_id"), "r.layer", (-F.col("r.s")).alias("score"), "r.token_count", (F.col("rank") + 1).alias("rank"))


def retrieve_collapsed(queries: DataFrame, nodes: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """All layers at once: best nodes of the document within the budget."""
    return budget_fill(score(queries, nodes, max_tokens), max_tokens)


def flat_candidates(max_tokens: int) -> int:
    return max(50, max_tokens // 20)


def retrieve_flat(queries: DataFrame, nodes: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Exact inner-product search: the best N nodes, N = max(50, max_tokens // 20), then the budget."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("node_id"))
    top = score(queries, nodes, most=flat_candidates(max_tokens)).withColumn("__rank", F.row_number().over(best)).filter(F.col("__rank") <= flat_candidates(max_tokens))
    return budget_fill(top.drop("__rank"), max_tokens)


def retrieve_traversal(queries: DataFrame, nodes: DataFrame, trees: DataFrame, k: int = TOP_K, depth: int | None = None, layer_score: float = LAYER_SCORE) -> DataFrame:
    """Top-down: the k best of each layer's frontier, whose children are the next.

    A query stops where its frontier's best is under ``layer_score``. A child of two chosen
    parents stands twice in the frontier; children that don't exist are left out. ``depth`` None
    or 0 is the tree's number of layers. Picks are ranked by score, earlier ones first on ties.
    """
    limit = F.lit(depth).cast("int") if depth else F.col("num_layers").cast("int")
    roots = queries.join(trees.select("document_id", "root_ids", limit.alias("left")), "document_id").filter("left > 0")
    frontier = roots.select("query_id", "document_id", F.col("embedding").alias("q"), "left", F.posexplode("root_ids").alias("pos", "node_id"))
    here = nodes.select("document_id", "node_id", "layer", "token_count", "children", F.col("embedding").alias("n"))
    best = Window.partitionBy("query_id")
    picks = None
    for level in range(depth or trees.agg(F.max("num_layers")).head()[0] or 0):
        scored = frontier.join(here, ["document_id", "node_id"]).withColumn("score", F.round(dot(F.col("q"), F.col("n")), 6))
        scored = scored.withColumn("__best", F.max("score").over(best)).filter(F.col("__best") >= layer_score)
        ranked = scored.withColumn("__rank", F.row_number().over(best.orderBy(F.desc("score"), F.desc("pos"))))
        chosen = cut(ranked.filter(F.col("__rank") <= k).drop("__best", "n"))
        now = chosen.select(*COLUMNS, F.lit(level).alias("__level"), "__rank")
        picks = now if picks is None else picks.union(now)
        children = chosen.filter("left > 1").select("query_id", "document_id", "q", (F.col("left") - 1).alias("left"), "__rank", F.posexplode("children").alias("__pos", "node_id"))
        # the place in the concatenated children; existing ones only, so gaps do no harm
        frontier = children.withColumn("pos", F.col("__rank").cast("long") * (1 << 32) + F.col("__pos")).drop("__rank", "__pos")
    if picks is None:
        return queries.sparkSession.createDataFrame([], "query_id string, document_id string, node_id int, layer int, score double, token_count int, rank int")
    order = best.orderBy(F.desc("score"), "__level", "__rank")
    return picks.withColumn("rank", F.row_number().over(order)).select(*COLUMNS, "rank")


def in_scope(retrieved: DataFrame, relevance: float = RELEVANCE) -> DataFrame:
    """Rows of queries whose best selected score reaches ``relevance``."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    return retrieved.withColumn("__best", best).filter(F.col("__best") >= relevance).drop("__best")


def dedupe_similar(retrieved: DataFrame, nodes: DataFrame, threshold: float = REDUNDANCY) -> DataFrame:
    """In rank order, drops a node as similar as ``threshold`` to one that is kept before it.

    Groups are selections under a budget, so they are small; vectors are fetched for these only.
    """
    vectors = nodes.select("document_id", "node_id", F.col("embedding").alias("__v"))
    row = F.struct("rank", "document_id", "node_id", "layer", "score", "token_count", F.col("__v").cast("array<double>").alias("v"))
    ranked = retrieved.join(vectors, ["document_id", "node_id"]).groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    start = F.filter("rows", lambda r: F.lit(False))
    like = lambda kept, x: F.exists(kept, lambda y: F.round(dot(y.v, x.v), 6) >= threshold)
    kept = F.aggregate("rows", start, lambda a, x: F.when(like(a, x), a).otherwise(F.array_append(a, x)))
    out = ranked.withColumn("kept", kept).select("query_id", F.posexplode("kept").alias("__rank", "r"))
    return out.select("query_id", "r.document_id", "r.node_id", "r.layer", "r.score", "r.token_count", (F.col("__rank") + 1).alias("rank"))


def retrieve(queries: DataFrame, nodes: DataFrame, trees: DataFrame, max_tokens: int = MAX_TOKENS, k: int = TOP_K, layer_score: float = LAYER_SCORE, relevance: float = RELEVANCE, redundancy: float = REDUNDANCY) -> DataFrame:
    """Queries with a ``strategy`` (collapsed or traversal): retrieve, drop what is out of scope, drop what repeats. Adds ``strategy``."""
    flat = retrieve_collapsed(queries.filter("strategy = 'collapsed'"), nodes, max_tokens).withColumn("strategy", F.lit("collapsed"))
    down = retrieve_traversal(queries.filter("strategy = 'traversal'"), nodes, trees, k, None, layer_score).withColumn("strategy", F.lit("traversal"))
    both = cut(in_scope(flat.unionByName(down), relevance))
    named = both.select("query_id", "strategy").distinct()
    return dedupe_similar(both, nodes, redundancy).join(named, "query_id")


def retrieve_comparative(halves: DataFrame, nodes: DataFrame, trees: DataFrame, k: int = TOP_K, layer_score: float = LAYER_SCORE, relevance: float = RELEVANCE, redundancy: float = REDUNDANCY) -> DataFrame:
    """Comparative questions, each half (``query_id, document_id, part, embedding``) traversed for itself, then merged.

    Each half drops what is out of its scope and what repeats in it; one may end with nothing.
    """
    keyed = halves.withColumn("__half", F.struct("query_id", "part")).withColumn("query_id", F.to_json("__half"))
    found = retrieve(keyed.withColumn("strategy", F.lit("traversal")), nodes, trees, k=k, layer_score=layer_score, relevance=relevance, redundancy=redundancy)
    kind = halves.schema["query_id"].dataType.simpleString()
    half = F.from_json("query_id", f"query_id {kind}, part int")
    found = found.withColumn("__half", half).withColumn("query_id", F.col("__half.query_id")).withColumn("part", F.col("__half.part"))
    return merge_parts(found.select(*COLUMNS, "part", "rank"))


def merge_parts(retrieved: DataFrame) -> DataFrame:
    """Rows with ``query_id, part, rank``: part by part, each node once, where it stands first. Ranks anew."""
    first = Window.partitionBy("query_id", "document_id", "node_id").orderBy("part", "rank")
    once = retrieved.withColumn("__nth", F.row_number().over(first)).filter("__nth = 1").drop("__nth")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("part", "rank")))


def insufficiency(retrieved: DataFrame, queries: DataFrame, nodes: DataFrame, threshold: float = 0.35) -> DataFrame:
    """``query_id, best, insufficient``: whether the best node is too far from the original query."""
    vectors = nodes.select("document_id", "node_id", F.col("embedding").alias("__v"))
    df = retrieved.select("query_id", "document_id", "node_id").join(queries.select("query_id", F.col("embedding").alias("__q")), "query_id")
    df = df.join(vectors, ["document_id", "node_id"]).groupBy("query_id").agg(F.max(F.round(dot(F.col("__q"), F.col("__v")), 6)).alias("best"))
    return df.withColumn("insufficient", F.col("best") < threshold)
