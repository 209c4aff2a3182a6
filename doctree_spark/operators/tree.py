"""Tables of nodes: edges, summaries of trees, clusters' contexts, summaries, parents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doctree_spark.functions.plugins import TOKENS, Tokens
from doctree_spark.functions.text import shortened, strip, truncated
from doctree_spark.operators.models import Calls, call_model
from doctree_spark.sources.lineage import cut

PROBABILITY = 0.1
MAX_CLUSTER_TOKENS = 8000
MAX_CONTEXT_TOKENS = 3000
Summarizer = Callable[[list[str]], list[str]]
Verifier = Callable[[list[tuple[str, str]]], list[str]]


def children_of(nodes: DataFrame) -> DataFrame:
    """``document_id, parent_id, pos, child_id, child_layer``; ids without a node are left out, order stays."""
    edges = nodes.select("document_id", F.col("node_id").alias("parent_id"), F.posexplode("children").alias("pos", "child_id"))
    child = nodes.select("document_id", F.col("node_id").alias("child_id"), F.col("layer").alias("child_layer"))
    return edges.join(child, ["document_id", "child_id"]).select("document_id", "parent_id", "pos", "child_id", "child_layer")


def all_nodes(nodes: DataFrame, trees: DataFrame) -> DataFrame:
    """All nodes, flat, of the documents in ``trees``."""
    return nodes.join(trees.select("document_id"), "document_id", "left_semi")


def tree_summary(nodes: DataFrame) -> DataFrame:
    """``document_id, levels, total_nodes, max_depth``; ``levels`` has the layers with parents, ascending, and how many."""
    by_layer = nodes.groupBy("document_id", "layer").agg(F.count_if(F.size("children") > 0).alias("num_clusters"), F.count("*").alias("n"))
    level = F.when(F.col("num_clusters") > 0, F.struct(F.col("layer").alias("level"), "num_clusters"))
    return by_layer.groupBy("document_id").agg(F.array_sort(F.collect_list(level)).alias("levels"), F.sum("n").alias("total_nodes"), F.max("layer").alias("max_depth"))


def leaf_nodes(chunks: DataFrame) -> DataFrame:
    """Layer 0 from ``document_id, chunk_no, text, token_count, embedding``."""
    none = F.array().cast("array<int>")
    return chunks.select("document_id", F.col("chunk_no").alias("node_id"), F.lit(0).alias("layer"), "text", "embedding", none.alias("children"), "token_count")


def assign_soft(members: DataFrame, threshold: float = PROBABILITY) -> DataFrame:
    """``document_id, node_id, cluster`` of ``document_id, node_id, probabilities``: every cluster above ``threshold``.

    Clusters without a member go; the others are numbered densely by document. Clusters are few,
    so they are numbered apart from their members.
    """
    df = members.select("document_id", "node_id", F.posexplode("probabilities").alias("__c", "p")).filter(F.col("p") > threshold)
    named = df.groupBy("document_id", "__c").agg(F.count("*").alias("__n"))
    named = named.withColumn("cluster", F.dense_rank().over(Window.partitionBy("document_id").orderBy("__c")) - 1).drop("__n")
    return df.join(named, ["document_id", "__c"]).select("document_id", "node_id", "cluster")


def overflow_clusters(members: DataFrame, max_tokens: int = MAX_CLUSTER_TOKENS) -> DataFrame:
    """``document_id, cluster, members, tokens`` of clusters over ``max_tokens`` with more than one member."""
    df = members.groupBy("document_id", "cluster").agg(F.count("*").alias("members"), F.sum("token_count").alias("tokens"))
    return df.filter((F.col("tokens") > max_tokens) & (F.col("members") > 1))


def cluster_context(members: DataFrame, max_tokens: int = MAX_CONTEXT_TOKENS, tokens: Tokens = TOKENS) -> DataFrame:
    """``document_id, cluster, context``: members' texts in order while they fit.

    The first that doesn't is cut to as many whole words as fit, and is the last. A limit of 0
    or less is none. Separators cost nothing. The first words of a text cost the sum of what
    each costs alone, whatever ``tokens`` counts.
    """
    row = F.struct("node_id", "text", F.col("__t").alias("t"))
    members = members.select("document_id", "cluster", "node_id", "text", tokens.of(F.col("text")).alias("__t"))
    df = members.groupBy("document_id", "cluster").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    if max_tokens <= 0:
        return df.select("document_id", "cluster", F.array_join(F.transform("rows", lambda r: r.text), "\n\n").alias("context"))
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("whole"), F.lit(False).alias("full"))

    def step(a: Column, r: Column) -> Column:
        over = a["full"] | (a.used + r.t > max_tokens)
        return F.when(over, F.struct(a.used.alias("used"), a.whole.alias("whole"), F.lit(True).alias("full"))).otherwise(F.struct((a.used + r.t).alias("used"), (a.whole + 1).alias("whole"), F.lit(False).alias("full")))

    df = df.withColumn("f", F.aggregate("rows", start, step))
    words = F.filter(F.split(F.coalesce(F.get("rows", F.col("f.whole")).text, F.lit("")), r"\s+"), lambda w: w != "")
    df = df.withColumn("words", F.when(F.col("f.full"), words).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("costs", tokens.each(F.col("words")))
    sums = F.aggregate("costs", F.struct(F.col("f.used").alias("used"), F.lit(0).alias("n"), F.lit(True).alias("on")), _count_words(max_tokens), lambda a: a.n)
    df = df.withColumn("n", sums)
    cut_off = F.when(F.col("n") > 0, F.array(F.array_join(F.slice("words", F.lit(1), F.col("n")), " "))).otherwise(F.array().cast("array<string>"))
    texts = F.concat(F.transform(F.slice("rows", F.lit(1), F.col("f.whole")), lambda r: r.text), cut_off)
    return df.select("document_id", "cluster", F.array_join(texts, "\n\n").alias("context"))


def _count_words(max_tokens: int) -> Callable[[Column, Column], Column]:
    def step(a: Column, cost: Column) -> Column:
        used = a.used + cost
        on = a.on & (used <= max_tokens)
        return F.struct(used.alias("used"), (a.n + on.cast("int")).alias("n"), on.alias("on"))

    return step


def fallback_summary(df: DataFrame, text_col: str, out_col: str = "summary", most: int = 800, sentence: bool = True) -> DataFrame:
    """Adds an extractive summary: cut behind a sentence, or the plain first characters."""
    text = F.col(text_col)
    return df.withColumn(out_col, shortened(text, most) if sentence else truncated(text, most))


def summarize_clusters(contexts: DataFrame, make: Callable[[], Summarizer] | None = None, calls: Calls = Calls(), sentence: bool = True, tokens: Tokens = TOKENS) -> DataFrame:  # noqa: B008
    """Adds ``summary``, ``generated``, whether it is the model's, and ``summary_error``, ``summary_attempts`` (``call_model``).

    Where the model fails at a context or says nothing in all attempts, an extractive summary
    stands in: cut behind a sentence or, without ``sentence``, plain first characters; without
    any model it is cut behind a sentence. The result is kept, so that nothing calls the model twice.
    """
    if make is None:
        return fallback_summary(contexts, "context").withColumns({"generated": F.lit(False), "summary_error": F.lit(None).cast("string"), "summary_attempts": F.lit(0)})
    plain = shortened(F.col("context")) if sentence else truncated(F.col("context"))
    df = cut(call_model(contexts, ["context"], "summary", make, calls, tokens.of(F.col("context"))))
    return df.withColumn("generated", F.col("summary").isNotNull()).withColumn("summary", F.coalesce("summary", plain))


def verdicts(df: DataFrame, verdict_col: str = "verdict") -> DataFrame:
    """Adds ``passed, claim``: PASS in any case passes; FAIL: x claims x; else all of it is the claim. Null (an error) passes."""
    v = strip(F.col(verdict_col))
    passed = F.coalesce(F.upper(v).startswith("PASS"), F.lit(True))
    claim = F.when(F.upper(v).startswith("FAIL:"), strip(F.substr(v, F.lit(6)))).otherwise(v)
    return df.withColumn("passed", passed).withColumn("claim", F.when(~passed, claim))


def verify_summaries(contexts: DataFrame, summarize: Callable[[DataFrame, int], DataFrame], verify: Callable[[DataFrame], DataFrame], attempts: int = 2) -> tuple[DataFrame, DataFrame]:
    """Summarises, verifies, and tries again what fails, up to ``attempts``; the last summary stays.

    ``summarize`` gets contexts and the attempt and adds ``summary``; ``verify`` adds
    ``verdict``. Returns summaries with ``passed, claim, attempt``, and failures by document.
    """
    done, left = None, contexts
    for attempt in range(1, attempts + 1):
        tried = cut(verdicts(verify(summarize(left, attempt))).withColumn("attempt", F.lit(attempt)))
        kept = tried if attempt == attempts else tried.filter("passed")
        done = kept if done is None else done.unionByName(kept)
        left = tried.filter("NOT passed").select(contexts.columns)
        if attempt < attempts and left.isEmpty():
            break
    return done, done.groupBy("document_id").agg(F.count_if(~F.col("passed")).alias("failures"))


def judged(make: Callable[[], Verifier], calls: Calls = Calls(), tokens: Tokens = TOKENS) -> Callable[[DataFrame], DataFrame]:  # noqa: B008
    """A step that adds ``verdict`` to rows with ``context, summary, generated``, in batches (``call_model``).

    Extractive summaries aren't judged; where the model fails, the verdict is null.
    """

    def step(df: DataFrame) -> DataFrame:
        judged = call_model(df, ["context", F.when(F.col("generated"), F.col("summary"))], "verdict", make, calls, tokens.of(F.col("context")) + tokens.of(F.col("summary")))
        return judged.drop("verdict_error", "verdict_attempts")

    return step


def make_parents(clusters: DataFrame, next_ids: DataFrame, tokens: Tokens = TOKENS) -> DataFrame:
    """Parents of ``document_id, cluster, node_id, layer`` rows with ``summary`` (one a cluster): ids follow ``next_id`` in cluster order.

    ``next_ids`` has ``document_id, next_id``. No embedding yet.
    """
    df = clusters.groupBy("document_id", "cluster").agg(F.array_sort(F.collect_list("node_id")).alias("children"), F.max("layer").alias("layer"), F.min("summary").alias("text"))
    df = df.join(next_ids, "document_id")
    return df.select("document_id", (F.col("next_id") + F.col("cluster")).cast("int").alias("node_id"), (F.col("layer") + 1).alias("layer"), "text", "children", tokens.of(F.col("text")).alias("token_count"))


def resume_pending(contexts: DataFrame, checkpoint: DataFrame, key: list[str]) -> DataFrame:
    """Contexts whose ``key`` has no kept summary, or one made from another context (``context_hash``)."""
    hashed = contexts.withColumn("context_hash", F.sha2("context", 256))
    return hashed.join(checkpoint.select(*key, "context_hash"), [*key, "context_hash"], "left_anti")
