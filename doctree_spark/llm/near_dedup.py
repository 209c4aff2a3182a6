"""Near duplicates by MinHash with tensored banding, confirmed on whole shingle sets.

A document is the set of its five-word shingles. Equal sets are one node from the start, so
copies cost one row each. A node gets two small collections of ``PARTS`` hashes, each of
``ROWS`` minhashes; every pair of one hash from either collection is a table key, so
2 * PARTS * ROWS minhashes make PARTS squared keys of 2 * ROWS minhashes.

Nodes under one key aren't all compared. Under each key the most central node, the one that
shares most keys with others, leads: it is held against the rest, and what is linked becomes one
component. Members left outside their leader's component are compared with all other members of its group,
in blocks, from the shingles in which they differ from the leader: with h the leader's shingles,
|x and y| = |x and h| + |y and h| - |h| + |dx and dy|, by which most pairs can't be links unless they
share rare ones of these; only such are compared. So a group of thousands of variants costs
about one comparison each, pairs that aren't links never become rows, and no link that shares a
key is lost. Keys and leaders with many members are salted: the one row that all of them meet is
repeated for every ``SALT_MEMBERS`` of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doctree_spark.llm.shared import SPACE, byte_table, hashed_words, table, written

SHINGLE = 5
PERCENT = 75
#: Chance of a shared key at similarity 0.75: 0.9995, at 0.85: 0.999995.
PARTS = 10
ROWS = 2
#: Differing shingles of the members that one task holds against a slice of their group.
BLOCK_SHINGLES = 250_000
#: Members of a key or a leader that meet it under one salt.
SALT_MEMBERS = 500
#: What comparing one candidate costs, in common shingles counted; where that is dearer, all of them are counted together.
PAIR_COST = 1500

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_WORDS = byte_table(SPACE)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _STEP
    return (x ^ (x >> np.uint64(32))) * _STEP


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text.

    A-Z are lower-cased; words are runs without ASCII white space. Fewer than ``size`` words
    are one shingle; none make the empty set.
    """
    for hashes, begin in hashed_words(texts, _WORDS):
        for k in range(len(begin) - 1):
            h = hashes[begin[k] : begin[k + 1]]
            n = len(h)
            if not n:
                yield np.empty(0, np.uint64)
                continue
            width = min(n, size)
            out = np.full(n - width + 1, width, np.uint64)
            for j in range(width):
                out = out * _MIX + h[j : n - width + 1 + j]
            yield np.unique(_mixed(out))


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240101)
    return draw.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 2**63, n, np.uint64)


def collections(shingles: np.ndarray, multipliers: np.ndarray, offsets: np.ndarray, rows: int) -> np.ndarray:
    """The hashes of both collections, each from ``rows`` minhashes."""
    low = np.array([(shingles * a + b).min() for a, b in zip(multipliers, offsets, strict=True)], np.uint64)
    out = np.zeros(len(low) // rows, np.uint64)
    for k in range(rows):
        out = _mixed(out * _MIX + low[k::rows])
    return out.view(np.int64)


def _sketches(docs: DataFrame, parts: int, rows: int) -> DataFrame:
    """``doc_id, n_shingles, signature, parts`` of ``id, text`` rows; no shuffle."""
    schema = T.StructType().add("doc_id", "long").add("n_shingles", "long").add("signature", "binary").add("parts", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _multipliers(2 * parts * rows)
        for batch in batches:
            size, signature, part = [], [], []
            for s in shingle_sets(batch.column(1)):
                size.append(len(s))
                signature.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                part.append(collections(s, a, b, rows) if len(s) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(signature, pa.binary()), pa.array(part, pa.list_(pa.int64()))], names=schema.fieldNames())

    return docs.mapInArrow(run, schema)


def _sets(docs: DataFrame) -> DataFrame:
    """``node, shingles`` of ``node, text`` rows."""
    schema = T.StructType().add("node", "long").add("shingles", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.view(np.int64) for s in shingle_sets(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=schema.fieldNames())

    return docs.mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) of every node in edges ``a, b``.

    Each round every vertex hooks to its smallest neighbour, two jumps shorten the chains, and
    the edges between what is left go into the next round; each round at least halves the
    vertices that still have edges.
    """
    labels = None
    edges = written(edges.filter("a <> b").select("a", "b").distinct())
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        hook = both.groupBy("a").agg(F.min("b").alias("up")).select(F.col("a").alias("node"), F.least("a", "up").alias("up"))
        hook = written(hook)
        for _ in range(2):
            higher = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
            hook = hook.join(higher, "up").select("node", F.col("top").alias("up"))
        hook = written(hook)
        renamed = hook.select(F.col("node").alias("component"), F.col("up").alias("to"))
        labels = hook.select("node", F.col("up").alias("component")) if labels is None else labels.join(renamed, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        labels = written(labels)
        to = lambda c: hook.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up"))  # noqa: B023, E731
        edges = edges.join(to("a"), "a").join(to("b"), "b").filter("a_up <> b_up").select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct()
        edges = written(edges)
    return labels


def _placed(star: DataFrame, comp: DataFrame) -> DataFrame:
    """Members of leaders' groups with their components ``c`` and their leaders'."""
    label = lambda c, out: comp.select(F.col("node").alias(c), F.col("component").alias(out))
    placed = star.join(label("node", "c"), "node", "left").join(label("leader", "leader_c"), "leader", "left")
    return placed.withColumn("c", F.coalesce("c", "node")).withColumn("leader_c", F.coalesce("leader_c", "leader"))


def _links_outside(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """Links ``a, b`` between members outside their leader's component and other members of its group.

    ``placed`` has the ``members`` of each node's group as ``link`` counts them, by which it is
    salted; a leader's own count is at least as large. Both sides are dealt into blocks by how many differing shingles they have, so neither a
    block of members outside nor a slice of the group grows with the group.
    """
    of = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}_set"))
    df = placed.withColumn("x", F.col("c") != F.col("leader_c")).withColumn("size", F.col("n") + F.col("leader_n") - 2 * F.col("both"))
    blocks = df.groupBy("leader").agg(F.ceil(F.sum(F.when(F.col("x"), F.col("size"))) / BLOCK_SHINGLES).alias("xs"), F.ceil(F.sum("size") / (4 * BLOCK_SHINGLES)).alias("ys"), F.max("members").alias("members"))
    blocks = blocks.filter("xs > 0").join(of("leader"), "leader").select("leader", "leader_set", "xs", "ys", _every_salt(F.col("members")))
    df = df.withColumn("salt", _salt(F.col("members"))).join(blocks, ["leader", "salt"]).join(of("node"), "node")
    df = df.withColumn("differ", F.concat(F.array_except("node_set", "leader_set"), F.array_except("leader_set", "node_set"))).drop("node_set", "leader_set")
    deal = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    columns = ["leader", "xb", "yb", "side", "node", "n", "both", "leader_n", "c", "differ"]
    left = df.filter("x").withColumn("xb", deal("xs", 1)).withColumn("yb", every("ys")).withColumn("side", F.lit(0))
    right = df.withColumn("xb", every("xs")).withColumn("yb", deal("ys", 2)).withColumn("side", F.lit(1))
    dealt = left.select(columns).union(right.select(columns)).repartition("leader", "xb", "yb").sortWithinPartitions("leader", "xb", "yb", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, outside, index = None, [], None
        for batch in batches:
            a, b = [], []
            numbers = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(9)]).tolist() if batch.num_rows else []
            for row, differ in zip(numbers, batch.column(9), strict=True):
                if row[:3] != key:
                    key, outside, index = row[:3], [], None
                differ = np.asarray(differ.values)
                if row[3] == 0:
                    outside.append((row, differ))
                    continue
                index = index or _Outside(outside)
                for x in index.links(row, differ):
                    a.append(min(x, row[4]))
                    b.append(max(x, row[4]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


class _Outside:
    """A block of members outside, by the shingles in which they differ from the leader.

    A link to any of them takes at least so many differing shingles in common, by sizes alone; of
    a member's d differing shingles, any d - least + 1 then meet one of each node it is linked
    with. So the rarest of these in the block find the candidates, and these are compared.
    """

    def __init__(self, rows: list[tuple[list, np.ndarray]]) -> None:
        self.node, self.n, self.both, self.c = (np.array([r[k] for r, _ in rows], np.int64) for k in (4, 5, 6, 8))
        self.sets = [d for _, d in rows]
        shingles = np.concatenate(self.sets) if rows else np.empty(0, np.int64)
        order = np.argsort(shingles, kind="stable")
        self.shingles, self.owner = shingles[order], np.repeat(np.arange(len(rows)), [len(d) for _, d in rows])[order]
        # by 100 + PERCENT times, so that bounds are whole numbers
        self.least = int((PERCENT * self.n - (100 + PERCENT) * self.both).min()) if rows else 0
        self.compared = 0

    def links(self, row: list, differ: np.ndarray) -> list[int]:
        """Nodes of the block, in other components, that are similar enough to the member ``row``."""
        node, n, both, leader_n, c = row[4:9]
        if not len(self.node):
            return []
        least = -(-(PERCENT * n + (100 + PERCENT) * (leader_n - both) + self.least) // (100 + PERCENT))
        if least > len(differ):
            return []
        low, high = (np.searchsorted(self.shingles, differ, side) for side in ("left", "right"))
        times, every = high - low, np.arange(len(self.node))
        if least > 1:
            rare = np.argpartition(times, len(differ) - least)[: len(differ) - least + 1]
            met = np.unique(self._owners(low[rare], times[rare]))
        else:
            met = np.unique(self._owners(low, times)) if least == 1 else every
        self.compared += len(met)
        if len(met) * PAIR_COST <= times.sum():
            inside = np.array([len(np.intersect1d(self.sets[k], differ, assume_unique=True)) for k in met.tolist()], np.int64)
        else:
            inside = np.bincount(self._owners(low, times), minlength=len(self.node))[met]
        common = self.both[met] + both - leader_n + inside
        good = (100 * common >= PERCENT * (self.n[met] + n - common)) & (self.c[met] != c) & (self.node[met] != node)
        return self.node[met][good].tolist()

    def _owners(self, low: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Members that have the shingles found at ``low``, ``times`` each."""
        at = np.repeat(low - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
        return self.owner[at]


def _salt(members: Column) -> Column:
    """A node's salt among those of a group of ``members``."""
    return F.pmod(F.xxhash64("node"), F.ceil(members / SALT_MEMBERS))


def _every_salt(members: Column) -> Column:
    """All salts of a group of ``members``, a row each."""
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(members / SALT_MEMBERS) - 1)).alias("salt")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = PARTS, rows: int = ROWS) -> DataFrame:
    """Near-duplicate components of documents.

    Args:
        docs: rows with an integer id and a text; other columns are ignored.

    Returns:
        ``doc_id, n_shingles, component_id long, kept boolean``, one row per row of ``docs``:
        the smallest id of the component, and whether this is it. A null or blank text has no
        shingles and is linked with nothing. Rows that repeat an id count as one document. A
        null id is never the smallest of a component that has others.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sketches = written(_sketches(named, parts, rows))
    first = sketches.filter("n_shingles > 0").groupBy("signature").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("parts").alias("parts"))
    nodes = written(written(first).withColumn("node", F.monotonically_increasing_id()))

    half = lambda start: F.slice("parts", start, parts)
    keys = F.flatten(F.transform(half(1), lambda x, i: F.transform(half(parts + 1), lambda y, j: F.xxhash64(i, j, x, y))))
    keyed = nodes.select("node", "n", F.explode(keys).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    members = written(keyed.join(shared, "key"))

    central = members.groupBy("node").agg(F.sum("members").alias("central"))
    ranked = members.join(central, "node")
    best = ranked.groupBy("key").agg(F.max(F.struct("central", "node")).alias("best"), F.first("members").alias("members"))
    best = best.select("key", F.col("best.node").alias("leader"), _every_salt(F.col("members")))
    met = members.withColumn("salt", _salt(F.col("members"))).join(best, ["key", "salt"])
    led = written(met.groupBy("node", "n", "leader").agg(F.max("members").alias("members")))

    wanted = led.select("node").distinct().join(nodes.select("node", F.col("least").alias("doc_id"), "signature"), "node")
    texts = named.join(wanted.select("node", "doc_id").hint("shuffle_hash"), named["doc_id"].eqNullSafe(wanted["doc_id"])).select("node", "text")
    sets = written(_sets(texts))

    of = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}_set"))
    common = F.size(F.array_intersect("node_set", "leader_set"))
    leaders = led.groupBy("leader").agg(F.max("members").alias("members")).join(of("leader"), "leader").select("leader", "leader_set", _every_salt(F.col("members")))
    star = led.filter("node <> leader").withColumn("salt", _salt(F.col("members"))).join(of("node"), "node").join(leaders, ["leader", "salt"])
    star = written(star.select("leader", "node", "n", "members", common.alias("both"), F.size("leader_set").alias("leader_n")))
    linked = 100 * F.col("both") >= PERCENT * (F.col("n") + F.col("leader_n") - F.col("both"))
    edges = written(star.filter(linked).select(F.col("leader").alias("a"), F.col("node").alias("b")))
    comp = components(edges)

    found = written(_links_outside(_placed(star, comp), sets).distinct())
    if not found.isEmpty():
        comp = components(edges.union(found))

    least = nodes.join(comp, "node", "left").select("signature", "least", F.coalesce("component", "node").alias("component"))
    smallest = least.groupBy("component").agg(F.min("least").alias("component_id"))
    named_by = least.join(smallest, "component").select("signature", "component_id")
    out = sketches.select("doc_id", "n_shingles", "signature").join(named_by, "signature", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, unchanged, without those that ``link`` doesn't keep.

    Of rows that repeat an id the one with the first text stays. Rows without an id go by a hash
    of their text that is larger than ids below 2^62: of equal or similar ones one stays, and
    none where a row with an id is similar. What goes is written first: while it is small, Spark
    broadcasts it and texts don't move.
    """
    key = F.coalesce(docs[id_col].cast("long"), F.lit(1 << 62) + F.pmod(F.xxhash64(docs[text_col]), F.lit(1 << 61)))
    linked = written(link(docs.select(key.alias("__id"), docs[text_col].alias("__text")), "__id", "__text").select("doc_id", "kept"))
    gone = written(linked.filter(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct())
    out = docs.join(gone, key == gone["__gone"], "left_anti")
    again = written(linked.filter("kept").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("__again")))
    if again.isEmpty():
        return out
    marked = out.join(again, key == again["__again"], "left")
    first = F.row_number().over(Window.partitionBy("__again").orderBy(text_col)) == 1
    repeated = marked.filter(F.col("__again").isNotNull()).withColumn("__first", first).filter("__first")
    return marked.filter(F.col("__again").isNull()).select(docs.columns).union(repeated.select(docs.columns))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))
