"""Contexts for answers: assembly under a token budget, external snippets, answer prompts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doctree_spark.functions.plugins import TOKENS, Tokens
from doctree_spark.functions.text import strip
from doctree_spark.operators.models import Calls, call_model

SNIPPETS = 3
# What stands between texts and before snippets, what is said without a context, and
# beginnings of questions that ask for reasons.
SEPARATOR = "\n\n---\n\n"
SNIPPET_HEAD = "\n\n=== Web Search Results ===\n"
NO_RESULT = "No relevant information found in the document for this query."
REFUSAL = "The document does not contain information about this topic."
REASONS = ("why", "how", "what causes", "what role", "what happens", "explain", "describe", "design", "compare", "contrast", "interact")
#: What a generator is asked where nothing else is given; both fields must be there once.
PROMPT = "Passages from the document:\n\n{context}\n\nAnswer from them alone: {question}"
#: Answers (prompt, temperature) pairs.
Generator = Callable[[list[tuple[str, float]]], list[str]]


def assemble_context(retrieved: DataFrame, nodes: DataFrame, max_tokens: int, tokens: Tokens = TOKENS) -> DataFrame:
    """``query_id, context, tokens, leaves, summaries, dropped``: leaves first, each text that still fits.

    Tokens are counted from the texts; a separator costs its tokens except before the first.
    """
    texts = nodes.select("document_id", "node_id", F.col("text").alias("__text"))
    row = F.struct("layer", "rank", F.col("__text").alias("text"), F.col("__t").alias("t"))
    df = retrieved.select("query_id", "document_id", "node_id", "layer", "rank").join(texts, ["document_id", "node_id"]).withColumn("__t", tokens.of(F.col("__text")))
    df = df.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("rows")).withColumn("__between", tokens.of(F.lit(SEPARATOR)))
    between = F.col("__between")
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("taken"))

    def step(a: Column, x: Column) -> Column:
        used = a.used + x.t + F.when(F.size(a.taken) > 0, between).otherwise(0)
        return F.when(used <= max_tokens, F.struct(used.alias("used"), F.array_append(a.taken, x.i).alias("taken"))).otherwise(a)

    at = F.transform("rows", lambda r, i: F.struct(i.alias("i"), r.t.alias("t")))
    df = df.withColumn("fill", F.aggregate(at, start, step)).withColumn("picked", F.transform("fill.taken", lambda i: F.get("rows", i)))
    leaves = F.size(F.filter("picked", lambda r: r.layer == 0))
    return df.select("query_id", F.array_join(F.transform("picked", lambda r: r.text), SEPARATOR).alias("context"), F.col("fill.used").alias("tokens"), leaves.alias("leaves"), (F.size("picked") - leaves).alias("summaries"), (F.size("rows") - F.size("picked")).alias("dropped"))


def append_snippets(contexts: DataFrame, flags: DataFrame, snippets: DataFrame, most: int = SNIPPETS) -> DataFrame:
    """Contexts of insufficient queries with their first ``most`` snippets behind them, whatever the budget.

    ``snippets`` have ``query_id, pos, title, body, href``; missing fields are empty.
    """
    blank = lambda c: F.coalesce(c, F.lit(""))
    said = strip(F.concat(blank(F.col("title")), F.lit(". "), blank(F.col("body")), F.lit(" (Source: "), blank(F.col("href")), F.lit(")")))
    first = Window.partitionBy("query_id").orderBy("pos")
    few = snippets.withColumn("__nth", F.row_number().over(first)).filter(F.col("__nth") <= most)
    blocks = few.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", said.alias("said")))).alias("rows"))
    blocks = blocks.select("query_id", F.array_join(F.transform("rows", lambda r: r.said), "\n\n").alias("__block"))
    wanted = blocks.join(flags.filter("insufficient").select("query_id"), "query_id", "left_semi")
    df = contexts.join(wanted, "query_id", "left")
    more = F.col("__block").isNotNull()
    return df.withColumn("context", F.when(more, F.concat("context", F.lit(SNIPPET_HEAD), "__block")).otherwise(F.col("context"))).withColumn("external", more).drop("__block")


def prepare_answers(contexts: DataFrame, make: Callable[[], Generator] | None = None, reasons: tuple[str, ...] = REASONS, calls: Calls = Calls(), form: str = PROMPT, tokens: Tokens = TOKENS) -> DataFrame:  # noqa: B008
    """Adds ``mode, temperature, prompt, answer`` to ``query_id, question, query_type, context``, and with a model ``answer_error, answer_attempts``.

    Broad and comparative questions, and those that begin like one for reasons, are inferential.
    Without a context there is a fixed refusal and no prompt; else the prompt is ``form`` with
    both fields filled in. ``make`` builds a model that answers pairs of prompt and temperature,
    in batches; a prompt at which it fails in all attempts has no answer, and says why. Without
    a model answers other than refusals are null.
    """
    starts = F.lit(False)
    for r in reasons:
        starts = starts | F.lower("question").startswith(r)
    inferential = F.coalesce(F.col("query_type").isin("broad", "comparative"), F.lit(False)) | starts
    none = strip(F.coalesce("context", F.lit(""))).isin("", NO_RESULT)
    df = contexts.withColumn("mode", F.when(inferential, "inferential").otherwise("factual"))
    df = df.withColumn("temperature", F.when(inferential, 0.1).otherwise(0.0)).withColumn("prompt", F.when(~none, _filled(form)))
    df = call_model(df, ["prompt", "temperature"], "answer", make, calls, tokens.of(F.col("prompt"))) if make else df.withColumn("answer", F.lit(None).cast("string"))
    return df.withColumn("answer", F.when(F.col("prompt").isNull(), REFUSAL).otherwise(F.col("answer")))


def _filled(form: str) -> Column:
    head, tail = form.split("{context}")
    if "{question}" in head:
        before, between = head.split("{question}")
        return F.concat(F.lit(before), "question", F.lit(between), "context", F.lit(tail))
    between, after = tail.split("{question}")
    return F.concat(F.lit(head), "context", F.lit(between), "question", F.lit(after))
