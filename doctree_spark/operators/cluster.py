"""Soft clusters of a layer's nodes: reduced vectors, Gaussian mixtures, their number by BIC, two passes.

A group of up to ``LARGE`` rows is fitted in one task by numpy, together with the task's other
groups of as many rows, ``ROWS_AT_ONCE`` rows at a time. The rows of larger ones stay where they are, and what moves are sums (``grouped``). Both ways take the same steps from the
same first centres, so the size of a group decides where it is fitted, not how.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doctree_spark.operators.grouped import fit_grouped
from doctree_spark.operators.mixture import MAX_CLUSTERS, Mixture, Sums, best_mixture, best_of_all, reduce
from doctree_spark.operators.tree import MAX_CLUSTER_TOKENS, PROBABILITY, overflow_clusters
from doctree_spark.sources.lineage import cut

__all__ = ["MAX_CLUSTERS", "Mixture", "Sums", "best_mixture", "cluster_layer", "reduce", "split_overflow"]

#: Rows that one task fits; larger groups are fitted across tasks.
LARGE = 5000
SPLIT_ROUNDS = 5
#: Rows whose groups a task takes together.
ROWS_AT_ONCE = 8192
#: Tasks that fit groups, as a multiple of the session's shuffle partitions.
TASKS = 2


Group = tuple[np.ndarray, np.ndarray]


def _fit_groups(df: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """``keys, node_id, probabilities`` of ``keys, node_id, embedding`` rows."""

    def fit(groups: list[Group]) -> Iterator[tuple[np.ndarray, list]]:
        for i, member in enumerate(best_of_all(groups, most)):
            yield np.full(len(member), i), [groups[i][1], member.tolist()]

    large = _large(df, keys)
    out = _by_group(df.join(large, list(keys), "left_anti"), keys, fit, {"node_id": "int", "probabilities": "array<double>"})
    return out if large.isEmpty() else out.unionByName(fit_grouped(df.join(large, list(keys), "left_semi"), keys, most))


def _by_group(df: DataFrame, keys: Sequence[str], fit: Callable[[list[Group]], Iterator[tuple[np.ndarray, list]]], columns: dict[str, str]) -> DataFrame:
    """``keys`` and ``columns`` that ``fit`` gives of many groups' rows and ids: for each some rows, with the group of each."""
    types = [pa.list_(pa.float64()) if t == "array<double>" else pa.int32() for t in columns.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _whole_groups(batches, keys):
            ids, vectors = rows.column("node_id").to_numpy(), rows.column("embedding").combine_chunks()
            at, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False).astype(float)
            ends = [*starts[1:], len(rows)]
            given = [(flat[at[a] : at[b]].reshape(b - a, -1), ids[a:b]) for a, b in zip(starts, ends, strict=True)]
            found = list(fit(given))
            if found:
                places = pa.array(starts[np.concatenate([g for g, _ in found])])
                made = [pa.array(np.concatenate(c), t) if t == pa.int32() else pa.array([v for part in c for v in part], t) for c, t in zip(zip(*(c for _, c in found), strict=True), types, strict=True)]
                out = pa.table([*(rows.column(k).take(places) for k in keys), *made], names=[*keys, *columns])
                yield from out.combine_chunks().to_batches()

    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), *(f"{c} {t}" for c, t in columns.items())])
    return _spread(df.select(*keys, "node_id", "embedding"), keys).sortWithinPartitions(*keys, "node_id").mapInArrow(run, schema)


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by ``keys`` as tables of whole groups, of ``ROWS_AT_ONCE`` rows or one group more, with the groups' first places."""
    held: list[pa.RecordBatch] = []

    def cut_off(last: bool) -> Iterator[tuple[pa.Table, np.ndarray]]:
        rows = pa.Table.from_batches(held)
        new = np.zeros(len(rows), bool)
        new[:1] = True
        for k in keys:
            here, before = rows.column(k).slice(1).combine_chunks(), rows.column(k).slice(0, max(len(rows) - 1, 0)).combine_chunks()
            other = pc.or_(pc.fill_null(pc.not_equal(here, before), False), pc.not_equal(pc.is_null(here), pc.is_null(before)))
            new[1:] |= other.to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new)
        end = len(rows) if last or not len(starts) else int(starts[-1])
        held[:] = rows.slice(end).to_batches()
        if end:
            yield rows.slice(0, end).combine_chunks(), starts if last else starts[:-1]

    for batch in batches:
        # from here on, no batch is larger
        for k in range(0, batch.num_rows, ROWS_AT_ONCE):
            held.append(batch.slice(k, ROWS_AT_ONCE))
            if sum(b.num_rows for b in held) >= ROWS_AT_ONCE:
                yield from cut_off(False)
    if held:
        yield from cut_off(True)


def _spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows by ``keys`` in ``TASKS`` times the session's shuffle partitions.

    Adaptive execution merges tasks by bytes, but fitting costs far more than its bytes; a number
    of its own keeps this shuffle from being dropped for an earlier one by the same keys.
    """
    return df.repartition(TASKS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _large(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, __n`` of groups over ``LARGE`` rows."""
    return cut(df.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > LARGE))


def _assigned(members: DataFrame, keys: Sequence[str], out: str, threshold: float) -> DataFrame:
    """``keys, node_id, out``: every cluster above the threshold."""
    df = members.select(*keys, "node_id", F.posexplode("probabilities").alias(out, "__p"))
    return df.filter(F.col("__p") > threshold).drop("__p")


def _numbered(df: DataFrame, key: str, parts: Sequence[str]) -> DataFrame:
    """``key, cluster, node_id``: distinct ``parts`` numbered densely by ``key``."""
    named = df.select(key, *parts).distinct()
    named = named.withColumn("cluster", F.dense_rank().over(Window.partitionBy(key).orderBy(*parts)) - 1)
    return df.join(named, [key, *parts]).select(key, "cluster", "node_id")


def cluster_layer(nodes: DataFrame, key: str = "document_id", threshold: float = PROBABILITY, most: int = MAX_CLUSTERS, largest: int | None = None) -> DataFrame:
    """``key, cluster, node_id``: clusters of each ``key``'s ``node_id, embedding`` rows, in two passes.

    A node joins every cluster in which its membership is over ``threshold``. The second pass
    divides each cluster of the first. Each tries up to ``most`` clusters. Where a key's rows fit in a task, so do both passes.
    No key has more rows than ``largest``, where that is known: then they needn't be counted.
    """
    rows = nodes.select(key, "node_id", "embedding")

    def both(groups: list[Group]) -> Iterator[tuple[np.ndarray, list]]:
        parts = [(i, at) for i, found in enumerate(_parts(groups, threshold, most)) for at in found]
        again = _parts([(groups[i][0][at], groups[i][1][at]) for i, at in parts], threshold, most)
        numbers = [0] * len(groups)
        for (i, at), found in zip(parts, again, strict=True):
            for part in found:
                yield np.full(len(part), i), [np.full(len(part), numbers[i]), groups[i][1][at[part]]]
                numbers[i] += 1

    large = None if largest is not None and largest <= LARGE else _large(rows, [key])
    out = _by_group(rows if large is None else rows.join(large, key, "left_anti"), [key], both, {"cluster": "int", "node_id": "int"})
    if large is not None and not large.isEmpty():
        big = rows.join(large, key, "left_semi")
        first = cut(_assigned(_fit_groups(big, [key], most), [key], "__global", threshold))
        second = _fit_groups(first.join(big, [key, "node_id"]), [key, "__global"], most)
        out = out.unionByName(_numbered(_assigned(second, [key, "__global"], "__local", threshold), key, ["__global", "__local"]))
    return cut(out)


def memberships(nodes: DataFrame, key: str = "document_id", most: int = MAX_CLUSTERS) -> DataFrame:
    """``key, node_id, probabilities`` of each ``key``'s ``node_id, embedding`` rows: memberships in the clusters of one pass."""
    return _fit_groups(nodes.select(key, "node_id", "embedding"), [key], most)


def _parts(groups: list[Group], threshold: float, most: int) -> list[list[np.ndarray]]:
    """Of each group, the places of the members of each cluster that has some."""
    return [[at for m in member.T if len(at := np.flatnonzero(m > threshold))] for member in best_of_all(groups, most)]


def split_overflow(clusters: DataFrame, nodes: DataFrame, max_tokens: int = MAX_CLUSTER_TOKENS, rounds: int = SPLIT_ROUNDS, most: int = MAX_CLUSTERS, largest: int | None = None) -> DataFrame:
    """Clusters over ``max_tokens`` clustered again, up to ``rounds`` times; one that doesn't divide stays whole.

    Clusters are numbered anew, parts in their cluster's place. ``overflow_clusters`` of what
    comes out lists those that the rounds left.
    """
    df = clusters.select("document_id", "node_id", F.array(F.col("cluster")).alias("__path"), F.lit(False).alias("__whole"))
    tokens = nodes.select("document_id", "node_id", "embedding", "token_count")
    for _ in range(rounds):
        over = overflow_clusters(df.filter("NOT __whole").join(tokens, ["document_id", "node_id"]).withColumn("cluster", F.col("__path")), max_tokens)
        over = cut(over.select("document_id", F.col("cluster").alias("__path"), F.to_json(F.struct("document_id", "cluster")).alias("__key"), "members"))
        widest = over.agg(F.max("members")).head()[0]
        if widest is None:
            break
        over = over.drop("members")
        again = df.join(over, ["document_id", "__path"])
        parts = cluster_layer(again.join(tokens, ["document_id", "node_id"]), "__key", most=most, largest=widest if largest is None else min(widest, largest))
        divided = parts.groupBy("__key").agg((F.max("cluster") > 0).alias("__divided"))
        fresh = parts.join(over, "__key").join(divided, "__key")
        fresh = fresh.select("document_id", "node_id", F.when(F.col("__divided"), F.concat("__path", F.array("cluster"))).otherwise(F.col("__path")).alias("__path"), (~F.col("__divided")).alias("__whole"))
        df = cut(df.join(over, ["document_id", "__path"], "left_anti").select("document_id", "node_id", "__path", "__whole").union(fresh))
    return _numbered(df, "document_id", ["__path"]).select("document_id", "cluster", "node_id")
