"""Inputs of the registered queries, derived from the given tables: uploads, blocks, a forest, questions.

Each derivation stands twice, as DataFrames here and as SQL in ``sql.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doctree_spark.functions.text import shortened, token_count
from doctree_spark.functions.vector import added, doubles, unit
from doctree_spark.operators.chunk import chunk_documents
from doctree_spark.operators.embed import embed
from doctree_spark.operators.ingest import with_document_id
from doctree_spark.sources.lineage import written_alone

DIMENSIONS = 64
MODEL = "hash-64"
#: How layers are written that stay until the forest is saved.
SMALL = {"compression": "zstd"}
EXAMPLES = [
    ("which value does the setting have", "specific"),
    ("who wrote it and in which year", "specific"),
    ("how large is the part", "specific"),
    ("give a summary of everything", "broad"),
    ("main themes of the text", "broad"),
    ("the whole story in short", "broad"),
    ("is one better than the other", "comparative"),
    ("in what way are both unlike", "comparative"),
    ("advantages of this over that", "comparative"),
    ("meaning of the word", "definitional"),
    ("the term and its sense", "definitional"),
    ("stands for which name", "definitional"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.get(F.array(*map(F.lit, (".pdf", ".txt", ".md", ".docx"))), (F.col("doc_id") % 4).cast("int"))
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), ending).alias("filename"), F.col("text").alias("content"), F.timestamp_seconds(F.col("doc_id") + 1_704_067_200).alias("upload_time"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of every third upload; every third of these has failed."""
    df = with_document_id(uploads(spark, sf_dir).filter("doc_id % 3 = 0"))
    df = df.groupBy("document_id").agg(F.min(F.struct("doc_id", "filename", "upload_time")).alias("first"))
    return df.select("document_id", "first.filename", F.when(F.col("first.doc_id") % 9 == 0, "failed: x").otherwise("completed").alias("status"), "first.upload_time")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of the event table as a catalog, every third of them unknown."""
    df = table(spark, sf_dir, "events").filter("user_id % 3 <> 0").groupBy("user_id").agg(F.min("ts").alias("upload_time"))
    return df.select(F.col("user_id").cast("string").alias("document_id"), F.lit("uploaded").alias("status"), "upload_time")


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "signup", "uploaded").when(kind.isin("view", "click"), "processing").when(kind == "purchase", "completed").when(kind == "error", "failed: error").otherwise("processing")
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("document_id"), "ts", status.alias("status"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("block_no", "text"))
    return df.select("document_id", F.floor(F.col("block_no") / 40).cast("int").alias("page_no"), "block_no", (612.0 * ((F.col("block_no") * 37) % 100) / 100).alias("x0"), F.lit(612.0).alias("page_width"), F.when(F.col("block_no") % 11 == 10, 1).otherwise(0).alias("block_type"), "text")


def sectioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose lines are set apart by blank ones, every second with a heading."""
    text = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    head = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Part "), F.col("lang"), F.lit("\n\n"))).otherwise("")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.concat(head, text).alias("text"))


def _parents(members: DataFrame, first: DataFrame, layer: int) -> DataFrame:
    """Nodes above ``document_id, cluster, node_id, embedding, text`` rows; ids from ``first`` on."""
    row = F.struct("node_id", doubles(F.col("embedding")).alias("embedding"), "text")
    df = members.groupBy("document_id", "cluster").agg(F.array_sort(F.collect_list(row)).alias("rows")).join(first, "document_id")
    text = shortened(F.array_join(F.transform("rows", lambda r: r.text), "\n\n"))
    df = df.select("document_id", (F.col("first") + F.col("cluster")).cast("int").alias("node_id"), F.lit(layer).alias("layer"), text.alias("text"), added(F.transform("rows", lambda r: r.embedding), DIMENSIONS).alias("sum"), F.transform("rows", lambda r: r.node_id).alias("children"))
    return df.select("document_id", "node_id", "layer", "text", unit(F.col("sum")).alias("embedding"), "children", token_count(F.col("text")).alias("token_count"))


def leaf_clusters(leaves: DataFrame, *more: str) -> DataFrame:
    """``document_id, node_id, cluster`` and ``more``: leaves in fours; the fourth of every other four is in the next one too."""
    sizes = leaves.groupBy("document_id").agg(F.ceil(F.count("*") / 4).alias("groups"))
    own = F.floor(F.col("node_id") / 4).cast("int")
    both = F.when((F.col("node_id") % 8 == 3) & (own + 1 < F.col("groups")), F.array(own, own + 1)).otherwise(F.array(own))
    return leaves.join(sizes, "document_id").select("document_id", "node_id", *more, F.explode(both).alias("cluster"))


def forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of a tree of three layers for every document with chunks: its chunks, whole, and two layers above them.

    Texts and vectors move once for a layer, as members are met, counted and grouped by document.
    """
    chunks = embed(chunk_documents(sectioned(spark, sf_dir)), "text", deal=True)
    leaves = chunks.select(
        F.concat(F.lit("d"), F.col("document_id").cast("string")).alias("document_id"), F.col("chunk_no").alias("node_id"), F.lit(0).alias("layer"), "text",
        "embedding", F.array().cast("array<int>").alias("children"), "token_count",
    )
    leaves = written_alone(leaves, **SMALL)
    sizes = leaves.groupBy("document_id").agg(F.count("*").alias("leaves"))
    layer1 = written_alone(_parents(leaf_clusters(leaves, "embedding", "text"), sizes.select("document_id", F.col("leaves").alias("first")), 1), **SMALL)
    groups = layer1.join(sizes, "document_id").withColumn("cluster", F.floor((F.col("node_id") - F.col("leaves")) / 4).cast("int"))
    layer2 = written_alone(_parents(groups, sizes.select("document_id", (F.col("leaves") + F.ceil(F.col("leaves") / 4)).alias("first")), 2), **SMALL)
    return leaves.union(layer1).union(layer2)


def trees(nodes: DataFrame) -> DataFrame:
    roots = F.array_sort(F.collect_list(F.when(F.col("layer") == 2, F.col("node_id"))))
    return nodes.groupBy("document_id").agg(roots.alias("root_ids"), (F.max("layer") + 1).alias("num_layers")).withColumn("embed_model", F.lit(MODEL)).withColumn("source", F.concat("document_id", F.lit(".pdf")))


def forest_queries(nodes: DataFrame) -> DataFrame:
    """A question near every fifth leaf and, less so, the one behind it."""
    leaves = nodes.filter("layer = 0").select("document_id", "node_id", "embedding")
    sizes = leaves.groupBy("document_id").agg(F.count("*").alias("n"))
    asked = leaves.filter("node_id % 5 = 0").join(sizes, "document_id").withColumn("next", ((F.col("node_id") + 1) % F.col("n")).cast("int"))
    behind = leaves.select("document_id", F.col("node_id").alias("next"), F.col("embedding").alias("other"))
    df = asked.join(behind, ["document_id", "next"])
    vector = unit(F.zip_with("embedding", "other", lambda x, y: 0.8 * x + 0.6 * y))
    return df.select(F.concat("document_id", F.lit("_"), F.col("node_id").cast("string")).alias("query_id"), "document_id", vector.alias("embedding"))


def _templated(number: Column, w1: Column, w2: Column) -> Column:
    """A question about two words, its form by ``number``."""
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    forms = F.array(
        said("what is ", w1), said("what are the main ", w1), said("compare ", w1, " ", w2, " and ", w2), said("how do ", w1, " and ", w2, " ", w1, " differ?"),
        said(w1, " vs ", w2), said("why ", w1), said("collapsed: define ", w1), said(w1, " ", w2),
    )
    return F.get(forms, (number % 8).cast("int"))


def _two(words: Column) -> list[Column]:
    return [F.coalesce(F.get(words, F.lit(k)), F.lit("")) for k in (0, 1)]


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id, query``: questions from the first words of user turns."""
    df = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return df.select(F.concat(F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("query_id"), _templated(F.col("conv_id"), *_two(F.split("text", " "))).alias("query"))


def asked_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id, document_id, query``: of every document a question about its own first two words."""
    # a question has its words many times in its expression: they are looked for at the text's beginning only
    words = [F.coalesce(F.regexp_extract("text", rf"^(?:\P{{L}}*+\p{{L}}++){{{k}}}\P{{L}}*+(\p{{L}}++)", 1), F.lit("")) for k in (0, 1)]
    df = table(spark, sf_dir, "documents")
    name = F.col("doc_id").cast("string")
    return df.select(F.concat(name, F.lit("_0")).alias("query_id"), F.concat(F.lit("d"), name).alias("document_id"), _templated(F.col("doc_id"), *words).alias("query"))


def question_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as external snippets of documents' questions, four each while there are pages."""
    return snippets(spark, sf_dir).withColumn("query_id", F.concat(F.floor(F.col("pos") / 4).cast("string"), F.lit("_0")))


def examples(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame([(k, t, label) for k, (t, label) in enumerate(EXAMPLES)], "example_id int, text string, label string")
    return embed(df, "text")


def memberships(leaves: DataFrame) -> DataFrame:
    """``document_id, node_id, probabilities``: five weights a leaf, in millionths."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda j: (1 + (F.col("node_id") * (j + 1) * 7) % 11).cast("double"))
    df = leaves.select("document_id", "node_id", raw.alias("raw"))
    total = F.aggregate("raw", F.lit(0.0), lambda s, x: s + x)
    return df.select("document_id", "node_id", F.transform("raw", lambda x: F.round(x / total, 6)).alias("probabilities"))


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as external snippets, four for the first query of each document while there are pages."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    body = F.regexp_replace("html", "<[^>]*>", "")
    return table(spark, sf_dir, "pages").select(F.concat(F.lit("d"), F.floor(F.col("page_id") / 4).cast("string"), F.lit("_0")).alias("query_id"), F.col("page_id").alias("pos"), title.alias("title"), body.alias("body"), F.col("url").alias("href"))
