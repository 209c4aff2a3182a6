"""Reading uploads and storing forests: Parquet tables, and the JSON layout of single trees."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doctree_spark.operators.ingest import supported
from doctree_spark.sources.files import read_files

#: Nodes in a bucket, and how many times as many let all be dealt anew.
BUCKET_ROWS, GROWTH = 200_000, 4
BY = ("document_id", "node_id")
#: Keys of a file for which its Bloom filter is made, and keys that a lookup hands to the scan.
KEYS_IN_FILE, LOOKUP_KEYS = 1_000_000, 64
_NAME = "buckets="
#: Of nodes' files: a quarter to a third smaller than Spark's default.
COMPRESSION = "zstd"
#: Node ids in a part of a tree's JSON, what stands before the first node, and the type of a part's nodes.
PART_NODES = 1000
_NODES = ',"nodes":{'
_ENTRIES = "map<string, struct<index:int, text:string, layer:int, children:array<int>, token_count:int>>"


def read_uploads(spark: SparkSession, path: str, hidden: bool = False) -> tuple[DataFrame, DataFrame]:
    """Files below ``path`` as uploads (``filename, content, upload_time``): supported ones, and rejects (``read_files``)."""
    return supported(read_files(spark, path, hidden=hidden))


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """``document_id, original_filename`` from ``<id>.meta.json`` files; unreadable ones have a null name."""
    files = read_files(spark, path, ".meta.json")
    found = F.from_json(F.regexp_replace(F.col("content").cast("string"), "^\ufeff", ""), "original_filename string")
    return files.select(F.regexp_replace("filename", r"\.meta\.json$", "").alias("document_id"), found["original_filename"].alias("original_filename"))


def save_forest(nodes: DataFrame, trees: DataFrame, path: str, batch: int | None = None, rows: int = BUCKET_ROWS, vectors: str = "array<float>") -> None:
    """Nodes and trees below ``path``, nodes in buckets by document and node.

    Whatever joins on both columns meets the nodes where they lie; a large document is spread over
    all buckets. There are as many buckets as keep ``rows`` nodes each, the session's default
    parallelism at least. With a ``batch``, rows go beside those of other batches and over what
    the same batch may have left there; once the buckets hold ``GROWTH`` times their rows, all
    are written anew into more of them, which readers see when the last file is there.
    """
    spark = nodes.sparkSession
    nodes = nodes.withColumn("embedding", F.col("embedding").cast(vectors)).withColumn("batch", F.lit(batch or 0))
    have = _buckets(spark, path)
    if have and batch is None:
        raise ValueError(f"{path} has a forest already")
    n = nodes.count()
    if have:
        remove(spark, f"{path}/nodes/{_NAME}{have}/batch={batch}")
        before = open_nodes(spark, path, drop=())
        n += before.count()
    need = max(spark.sparkContext.defaultParallelism, -(-n // rows))
    if have and need <= GROWTH * have:
        _write(nodes, path, have)
    else:
        _write(before.select(nodes.columns).unionByName(nodes) if have else nodes, path, need)
        if have:
            remove(spark, f"{path}/nodes/{_NAME}{have}")
    mode, part = ("error", "") if batch is None else ("overwrite", f"/batch={batch}")
    trees.write.mode(mode).parquet(f"{path}/trees{part}")


def _write(nodes: DataFrame, path: str, buckets: int) -> None:
    table = _table(nodes.sparkSession, path, buckets, nodes.schema)
    columns = [*(c for c in nodes.columns if c != "batch"), "batch"]
    # each bucket's rows in one task, so in one file a batch
    dealt = nodes.select(columns).repartition(buckets, *BY)
    dealt.write.mode("append").format("parquet").partitionBy("batch").bucketBy(buckets, *BY).sortBy(*BY).saveAsTable(table)


def _table(spark: SparkSession, path: str, buckets: int, schema: T.StructType) -> str:
    """A table of the session over the files of a forest's nodes; dropping it leaves the files."""
    root = f"{path}/nodes/{_NAME}{buckets}"
    name = f"nodes_{hashlib.md5(root.encode()).hexdigest()}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    by = ", ".join(BY)
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet OPTIONS (compression '{COMPRESSION}') PARTITIONED BY (batch) CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{root.replace(chr(39), chr(92) + chr(39))}'")
    spark.catalog.recoverPartitions(name)
    return name


def _buckets(spark: SparkSession, path: str) -> int | None:
    """Buckets of the forest at ``path``, those of the last write that ended; None without a forest."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/nodes")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    names = [x.getPath() for x in fs.listStatus(at) if x.getPath().getName().startswith(_NAME)]
    ended = [int(x.getName().removeprefix(_NAME)) for x in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
    return max(ended, default=None)


def open_nodes(spark: SparkSession, path: str, drop: tuple[str, ...] = ("batch",)) -> DataFrame:
    """Nodes saved at ``path``, of all batches, as a table in buckets."""
    buckets = _buckets(spark, path)
    if not buckets:
        raise ValueError(f"{path} has no forest")
    schema = spark.read.parquet(f"{path}/nodes/{_NAME}{buckets}").schema
    return spark.table(_table(spark, path, buckets, schema)).drop(*drop)


def load_forest(spark: SparkSession, path: str, active_model: str | None = None, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and trees saved at ``path``, of all batches; with ``only``, those of its ``document_id``.

    Raises ValueError for trees of another model than ``active_model``, trees without nodes,
    nodes without a tree, and nodes without an embedding.
    """
    nodes, trees = open_nodes(spark, path), spark.read.parquet(f"{path}/trees").drop("batch")
    if only is not None:
        nodes, trees = nodes.join(only, "document_id", "left_semi"), trees.join(only, "document_id", "left_semi")
    if active_model is not None and (other := trees.filter(~F.col("embed_model").eqNullSafe(active_model)).head(1)):
        raise ValueError(f"{other[0]['document_id']} was embedded by {other[0]['embed_model']}, not {active_model}")
    if missing := nodes.filter("embedding IS NULL").select("document_id", "node_id").head(1):
        raise ValueError(f"node {missing[0]['node_id']} of {missing[0]['document_id']} has no embedding")
    if lost := trees.join(nodes, "document_id", "left_anti").head(1) or nodes.join(trees, "document_id", "left_anti").head(1):
        raise ValueError(f"{lost[0]['document_id']} is incomplete")
    return nodes, trees


def tree_json(nodes: DataFrame, trees: DataFrame, part_nodes: int = PART_NODES) -> DataFrame:
    """``document_id, part, json``: each tree as a JSON document without embeddings, cut into parts of ``part_nodes`` node ids.

    A document's parts in their order, one behind the other, are its JSON. The first begins with
    the tree's own fields, the last ends it; a tree without nodes has one part. No part gathers
    more than its nodes, however large a tree is.
    """
    node = F.to_json(F.struct(F.col("node_id").alias("index"), "text", "layer", "children", "token_count"))
    entry = F.struct("node_id", F.concat(F.lit('"'), F.col("node_id").cast("string"), F.lit('":'), node).alias("json"))
    dealt = nodes.join(trees.select("document_id"), "document_id", "left_semi").withColumn("part", F.floor(F.col("node_id") / part_nodes))
    parts = dealt.groupBy("document_id", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e.json), ",").alias("json"))
    # counted from the nodes, as the parts' texts needn't meet for this
    ends = dealt.groupBy("document_id").agg(F.min("part").alias("__first"), F.max("part").alias("__last"))
    head = F.to_json(F.struct("root_ids", "num_layers", "embed_model", F.col("source").alias("source_pdf")), {"ignoreNullFields": "false"})
    heads = trees.withColumn("__h", head).select("document_id", F.concat(F.expr("substring(__h, 1, length(__h) - 1)"), F.lit(_NODES)).alias("__head"))
    whole = heads.join(ends, "document_id", "left").join(parts, "document_id", "left")
    first, last = F.coalesce(F.col("part") == F.col("__first"), F.lit(True)), F.coalesce(F.col("part") == F.col("__last"), F.lit(True))
    json = F.concat(F.when(first, F.col("__head")).otherwise(","), F.coalesce("json", F.lit("")), F.when(last, "}}").otherwise(""))
    return whole.select("document_id", F.coalesce("part", F.lit(0).cast("long")).alias("part"), json.alias("json"))


def parse_tree_json(parts: DataFrame) -> DataFrame:
    """Nodes, without embeddings, from ``document_id, json``: whole trees, or parts as ``tree_json`` cuts them, each for itself.

    A string's quotes are escaped, so what stands before the nodes, and what ends the tree, can't be mistaken.
    """
    own = F.instr("json", _NODES) > 0
    body = F.when(own, F.substr("json", F.instr("json", _NODES) + len(_NODES))).otherwise(F.substr("json", F.lit(2)))
    closed = F.when(body.endswith("}}}") | (body == "}}"), F.substr(body, F.lit(1), F.length(body) - 2)).otherwise(body)
    entries = F.from_json(F.concat(F.lit("{"), closed, F.lit("}")), _ENTRIES)
    df = parts.select("document_id", F.when(own | F.col("json").startswith(","), entries).otherwise(F.from_json("json", f"nodes {_ENTRIES}")["nodes"]).alias("t")).select("document_id", F.explode("t").alias("id", "n"))
    return df.select("document_id", F.col("id").cast("int").alias("node_id"), "n.layer", "n.text", "n.children", "n.token_count")


def write_tree_json(nodes: DataFrame, trees: DataFrame, path: str, part_nodes: int = PART_NODES) -> None:
    """Trees below ``path`` as JSON lines ``document_id, part, json``, in files by ranges of both."""
    parts = tree_json(nodes, trees, part_nodes)
    parts.repartitionByRange("document_id", "part").sortWithinPartitions("document_id", "part").write.json(path)


def read_tree_json(spark: SparkSession, path: str) -> DataFrame:
    """Nodes, without embeddings, of the trees that ``write_tree_json`` wrote."""
    return parse_tree_json(spark.read.schema("document_id string, part long, json string").json(path))


def read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at ``path``, or an empty one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def append_keyed(df: DataFrame, path: str, key: str, distinct: int = KEYS_IN_FILE) -> None:
    """Appends rows to the Parquet table at ``path`` so that few keys are found without a scan.

    Rows are ranged and sorted by ``key``, whose row groups carry least and largest values and a
    Bloom filter for ``distinct`` keys a file.
    """
    dealt = df.repartitionByRange(key).sortWithinPartitions(key)
    dealt.write.mode("append").option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", distinct).parquet(path)


def with_keys(df: DataFrame, key: str, values: DataFrame, most: int = LOOKUP_KEYS) -> DataFrame:
    """Rows of a keyed table whose ``key`` is in ``values``: up to ``most`` go to the scan as a filter, more are joined."""
    few = values.select(key).filter(F.col(key).isNotNull()).distinct()
    found = [r[0] for r in few.limit(most + 1).collect()]
    if len(found) > most:
        return df.join(few, key, "left_semi")
    # one comparison each, as a long list would be looked up by its least and largest only
    hit = F.lit(False)
    for v in found:
        hit = hit | (F.col(key) == v)
    return df.filter(hit)


def remove(spark: SparkSession, path: str) -> None:
    """Removes what jobs have kept below ``path``, on whatever file system that is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
