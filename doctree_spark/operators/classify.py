"""What kind of question a query is, how it is routed, and comparative questions in two parts."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doctree_spark.functions.text import strip
from doctree_spark.operators.models import Calls, call_model

LEAST_CONFIDENCE = 0.45
MAX_EXAMPLES = 10_000
#: Gives a label and a score for each question.
Classifier = Callable[[list[str]], list[tuple[str, float]]]

# Signals of question types, in the order in which they are tried. The missing bar
# between the last but two alternatives of "broad" belongs to the rules that results must follow.
COMPARATIVE = r"what is the difference between|how do .+ and .+ differ|compare .+ and|contrast .+ and|.+\s+vs\s+.+|.+\s+versus\s+.+"
BROAD = (
    r"what are (all|the different|the main|the various|the types of)|list (all|the)|describe all|explain all|overview|summari[sz]e|"
    r"advantages and disadvantages|pros and cons|benefits and drawbacks|compare .+ types|differences between .+ typestypes of|different types"
)
DEFINITIONAL = r"^(what is|what are|define|explain what)"
SPECIFIC = r"^(why|how does|how do|what causes|what role|what happens|how is|how are|what is the role|what is the function|what is the density|how many|when does)"
# Words before both concepts of a comparative question, words behind them, words between them.
COMPARING = r"(?:difference between|compare|contrast|how do|how does)\s+(.+)"
DIFFERING = r"\s+differs?$"
VERSUS = r"(.+?)\s+(?:vs|versus)\s+(.+)"
RULES = ((COMPARATIVE, "comparative"), (BROAD, "broad"), (DEFINITIONAL, "definitional"), (SPECIFIC, "specific"))


def query_prefix(queries: DataFrame) -> DataFrame:
    """Takes a leading ``collapsed:`` or ``traversal:`` off ``query`` into ``override``; blank queries go."""
    text = strip(F.col("query"))
    name = F.lower(F.regexp_extract(text, r"(?i)^(collapsed|traversal):", 1))
    df = queries.withColumn("override", F.when(name != "", name)).withColumn("query", strip(F.regexp_replace(text, r"(?i)^(collapsed|traversal):", "")))
    return df.filter(F.col("query") != "")


def clean(query: Column) -> Column:
    return F.regexp_replace(strip(F.lower(query)), r"\?+$", "")


def rule_type(query: Column) -> Column:
    """Type by the first rule that matches, null when none does."""
    out = None
    for pattern, name in RULES:
        hit = clean(query).rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def with_nearest(queries: DataFrame, examples: DataFrame, asked: Column | None = None) -> DataFrame:
    """Adds ``label, confidence`` of the closest of the labelled ``examples`` (``example_id, label, embedding``), in the row.

    The examples are a model, not data: up to ``MAX_EXAMPLES`` go to the tasks, more are
    refused. Of equally close ones the first counts. Rows without an embedding, and those where
    ``asked`` doesn't hold, get nulls.
    """
    rows = examples.select("example_id", "label", "embedding").orderBy("example_id").limit(MAX_EXAMPLES + 1).collect()
    if not 0 < len(rows) <= MAX_EXAMPLES:
        raise ValueError(f"1 to {MAX_EXAMPLES} examples are needed")
    labels, vectors = [r["label"] for r in rows], np.array([r["embedding"] for r in rows], float)

    @F.pandas_udf(T.StructType().add("label", "string").add("confidence", "double"))
    def nearest(embeddings: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"label": pd.Series([None] * len(embeddings), dtype=object), "confidence": np.nan})
        have = embeddings.notna().to_numpy()
        if have.any():
            near = np.round(np.array(embeddings[have].tolist(), float) @ vectors.T, 6)
            out.loc[have, "label"] = [labels[k] for k in near.argmax(axis=1)]
            out.loc[have, "confidence"] = near.max(axis=1)
        return out

    vector = F.col("embedding") if asked is None else F.when(asked, F.col("embedding"))
    best = queries.withColumn("__best", nearest(vector))
    confidence = F.when(F.col("__best.label").isNotNull(), F.col("__best.confidence"))
    return best.withColumn("label", F.col("__best.label")).withColumn("confidence", confidence).drop("__best")


def nearest_example(queries: DataFrame, examples: DataFrame) -> DataFrame:
    """``query_id, label, confidence`` of each query's closest example (``with_nearest``)."""
    return with_nearest(queries, examples).select("query_id", "label", "confidence")


def with_model(queries: DataFrame, make: Callable[[], Classifier], asked: Column, calls: Calls = Calls()) -> DataFrame:  # noqa: B008
    """Adds ``label, confidence`` as a model gives them for ``query``, where ``asked`` holds; elsewhere, and where it fails, nulls.

    The model is built once in each task and called in batches (``models``); it takes questions and gives
    pairs of a label and a score.
    """

    def packed() -> Callable[[list[str]], list[str]]:
        model = make()
        return lambda texts: [None if x is None else json.dumps([str(x[0]), float(x[1])]) for x in model(texts)]

    said = call_model(queries, [F.when(asked, F.col("query"))], "__said", packed, calls)
    found = F.from_json("__said", "array<string>")
    return said.withColumn("label", F.get(found, F.lit(0))).withColumn("confidence", F.round(F.get(found, F.lit(1)).cast("double"), 6)).drop("__said", "__said_error", "__said_attempts")


def classify(queries: DataFrame, examples: DataFrame | None, least: float = LEAST_CONFIDENCE, make: Callable[[], Classifier] | None = None, calls: Calls = Calls()) -> DataFrame:  # noqa: B008
    """Adds ``query_type, confidence, strategy``, a row for each row.

    An override is its own type. A rule is certain; else ``make``'s model decides or, without
    one, the nearest example, and below ``least`` the type is specific. Overrides choose the strategy; broad questions are
    collapsed, all others traversed.
    """
    own = queries.columns
    ruled = queries.withColumn("__rule", F.when(F.col("override").isNull(), rule_type(F.col("query"))))
    open_ = F.col("override").isNull() & F.col("__rule").isNull()
    df = with_model(ruled, make, open_, calls) if make else with_nearest(ruled, examples, open_)
    label = F.when(F.col("confidence") < least, "specific").otherwise(F.col("label"))
    kind = F.when(F.col("override").isNotNull(), "override").otherwise(F.coalesce("__rule", label, F.lit("specific")))
    certain = F.col("override").isNotNull() | F.col("__rule").isNotNull()
    df = df.select(*own, kind.alias("query_type"), F.when(certain, F.lit(1.0)).otherwise(F.col("confidence")).alias("confidence"))
    return df.withColumn("strategy", route(F.col("override"), F.col("query_type")))


def route(override: Column, query_type: Column) -> Column:
    return F.coalesce(override, F.when(query_type == "broad", "collapsed").otherwise("traversal"))


def decompose_comparative(queries: DataFrame) -> DataFrame:
    """``query_id, part, sub_query``: both concepts of a comparative query as questions, or the query itself as part 0.

    The text behind the comparing words is cut at the last "and"; a first concept of fewer words
    gets the second's further words. Otherwise it is cut at "vs" or "versus".
    """
    low = clean(F.col("query"))
    rest = strip(F.regexp_extract(low, COMPARING, 1))
    rest = strip(F.regexp_replace(rest, DIFFERING, ""))
    df = queries.withColumn("__rest", rest).withColumn("__low", low)
    df = df.withColumn("__a", strip(F.regexp_extract("__rest", r"^(.*) and (.*)$", 1))).withColumn("__b", strip(F.regexp_extract("__rest", r"^(.*) and (.*)$", 2)))
    split = F.col("__rest").rlike(r"^.* and .*$")
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    more = F.size(words("__b")) - F.size(words("__a"))
    longer = F.when(more > 0, F.concat("__a", F.lit(" "), F.array_join(F.slice(words("__b"), F.size(words("__a")) + 1, F.greatest(more, F.lit(1))), " "))).otherwise(F.col("__a"))
    ask = lambda c: F.when(F.rtrim(c).endswith("s"), F.concat(F.lit("what are "), c)).otherwise(F.concat(F.lit("what is "), c))
    second = F.array(*(ask(strip(F.regexp_extract("__low", VERSUS, i))) for i in (1, 2)))
    parts = F.when(split, F.array(ask(longer), ask(F.col("__b")))).when(F.col("__low").rlike(VERSUS), second).otherwise(F.array("query"))
    return df.select("query_id", F.posexplode(parts).alias("part", "sub_query"))
