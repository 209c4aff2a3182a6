"""Batches of questions from their text to prompts: classified, routed, retrieved, merged, assembled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctree_spark.functions.plugins import TOKENS, Tokens
from doctree_spark.operators import classify, context, retrieve
from doctree_spark.operators.embed import Embedder, embed, hash_embedder
from doctree_spark.operators.models import Calls
from doctree_spark.sources.lineage import cut

INSUFFICIENT = 0.35


def ask(
    questions: DataFrame, examples: DataFrame | None, nodes: DataFrame, trees: DataFrame, snippets: DataFrame | None = None, make_embedder: Callable[[], Embedder] = hash_embedder,
    make_generator: Callable[[], context.Generator] | None = None, max_tokens: int = retrieve.MAX_TOKENS, k: int = retrieve.TOP_K, layer_score: float = retrieve.LAYER_SCORE,
    relevance: float = retrieve.RELEVANCE, redundancy: float = retrieve.REDUNDANCY, insufficient: float = INSUFFICIENT, calls: Calls = Calls(), make_classifier: Callable[[], classify.Classifier] | None = None, tokens: Tokens = TOKENS,
) -> tuple[DataFrame, DataFrame]:  # fmt: skip  # noqa: B008
    """Answers, and the nodes behind them, for ``query_id, document_id, query`` rows.

    A comparative question without an override is cut in two; with two parts each is retrieved
    for itself by traversal and the parts are merged, with one it is a specific question. All
    others go the way of their type. Contexts are assembled under ``max_tokens``; where even the
    best node is too far from the question, its ``snippets`` follow. Blank questions have no
    answer; those without any node get the fixed refusal, snippets or not.

    ``make_classifier``'s model decides where no rule does, in place of ``examples``.

    Returns:
        ``query_id, document_id, query, query_type, confidence, strategy, context, external,
        mode, temperature, prompt, answer`` (with a generator ``answer_error`` too), one row a question, and ``query_id, document_id,
        node_id, layer, score, token_count, rank`` of retrieved nodes.
    """
    asked = embed(classify.query_prefix(questions), "query", make=make_embedder)
    asked = cut(classify.classify(asked, examples, make=make_classifier))
    parts = classify.decompose_comparative(asked.filter("query_type = 'comparative'"))
    parts = parts.join(parts.groupBy("query_id").agg(F.count("*").alias("__parts")), "query_id").filter("__parts = 2")
    halves = cut(embed(parts.join(asked.select("query_id", "document_id"), "query_id"), "sub_query", make=make_embedder).select("query_id", "document_id", "part", "embedding"))
    single = asked.join(halves.select("query_id").distinct(), "query_id", "left_anti")
    one = retrieve.retrieve(single, nodes, trees, max_tokens, k, layer_score, relevance, redundancy)
    two = retrieve.retrieve_comparative(halves, nodes, trees, k, layer_score, relevance, redundancy)
    columns = [*retrieve.COLUMNS, "rank"]
    found = cut(one.select(columns).unionByName(two.select(columns)))
    contexts = context.assemble_context(found, nodes, max_tokens, tokens).select("query_id", "context")
    if snippets is not None:
        contexts = context.append_snippets(contexts, retrieve.insufficiency(found, asked, nodes, insufficient), snippets)
    else:
        contexts = contexts.withColumn("external", F.lit(False))
    df = asked.drop("embedding", "override").join(contexts, "query_id", "left")
    df = df.withColumn("context", F.coalesce("context", F.lit(context.NO_RESULT))).withColumn("external", F.coalesce("external", F.lit(False)))
    answers = context.prepare_answers(df.withColumn("question", F.col("query")), make_generator, calls=calls, tokens=tokens)
    return answers.select(*(["answer_error"] if make_generator else []), "query_id", "document_id", "query", "query_type", "confidence", "strategy", "context", "external", "mode", "temperature", "prompt", "answer"), found
