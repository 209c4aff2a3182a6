"""Mixtures of groups larger than a task: rows in blocks where they lie, sums and mixtures in tables.

Rows of a group are packed into blocks and some blocks into a part; blocks lie in a table in
buckets by group and part. A round brings each part the group's mixtures of all numbers of
clusters that still go on, adds up the rows' sums first within a task, then by group and number,
and makes the next mixtures in tasks, by group. All groups advance together, so the number of jobs
is that of rounds, whatever the number of groups; the driver gets how many fits still go on.
A number whose BIC can't become the smallest any more stops, and only a group's best finished
mixture is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctree_spark.operators.mixture import ROWS, SEED_ROWS, Fit, Mixture, Sums, axes, bic, least_bic, nearest, scattered, seeds
from doctree_spark.sources.lineage import written, written_in_buckets

#: Node ids in a block, blocks in a part, and parts in a bucket.
BLOCK_ROWS, PART_BLOCKS, BUCKET_PARTS = 4096, 16, 8
_PART = ["__g", "__part"]
_SUMS = "__g string, k int, n long, sums binary"
_STATE = "__g string, k int, n long, last double, rounds int, done boolean, likelihood double, mixture binary"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], names=schema.names)


_SUMS_ARROW = pa.schema([("__g", pa.string()), ("k", pa.int32()), ("n", pa.int64()), ("sums", pa.binary())])
_STATE_ARROW = pa.schema([("__g", pa.string()), ("k", pa.int32()), ("n", pa.int64()), ("last", pa.float64()), ("rounds", pa.int32()), ("done", pa.bool_()), ("likelihood", pa.float64()), ("mixture", pa.binary())])


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _blocks(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``__g, __part, keys, ids, x``: rows of ``keys, node_id, embedding`` by blocks, vectors as bytes."""
    block = F.floor(F.col("node_id") / BLOCK_ROWS)
    rows = df.select(F.to_json(F.struct(*keys)).alias("__g"), F.floor(block / PART_BLOCKS).alias("__part"), block.alias("__block"), *keys, F.col("node_id").cast("int").alias("node_id"), F.col("embedding").cast("array<double>").alias("x"))
    dealt = rows.repartition(*_PART).sortWithinPartitions("__g", "__block", "node_id")
    width = 3 + len(keys)
    schema = "__g string, __part long, " + "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys) + "ids array<int>, x binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packed() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            ids, x = whole.column(width).combine_chunks(), np.concatenate([_vectors(c) for c in whole.column(width + 1).chunks])
            one = [whole.column(c).slice(0, 1).combine_chunks() for c in (0, 1, *range(3, width))]
            return pa.RecordBatch.from_arrays([*one, pa.ListArray.from_arrays([0, len(ids)], ids), pa.array([x.tobytes()], pa.binary())], names=["__g", "__part", *keys, "ids", "x"])

        for batch in batches:
            group, of = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            at = 0
            for k in range(batch.num_rows):
                mine = (group[k], of[k])
                if held and k == at and mine != (held[-1].column(0)[0].as_py(), held[-1].column(2)[0].as_py()):
                    yield packed()
                    held.clear()
                if k > at and mine != (group[at], of[at]):
                    held.append(batch.slice(at, k - at))
                    yield packed()
                    held.clear()
                    at = k
            if at < batch.num_rows:
                held.append(batch.slice(at))
        if held:
            yield packed()

    return dealt.mapInArrow(run, schema)


def _summed(blocks: DataFrame, given: list[str], sums: Callable) -> DataFrame:
    """``_SUMS`` of all blocks (``__g, n, ids, x`` and ``given``): what ``sums(x, *given)`` gives as (k, Sums) pairs, added up by group and k.

    Blocks of a group lie one after the other in a task; its sums are handed on when the next group begins.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, n, found = None, 0, {}
        for batch in batches:
            for g, size, ids, x, *more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != group:
                    if found:
                        yield _batch([(group, k, n, s.to_bytes()) for k, s in found.items()], _SUMS_ARROW)
                    group, n, found = g, size, {}
                rows = np.frombuffer(x).reshape(len(ids), -1)
                for at in range(0, len(rows), ROWS):
                    for k, now in sums(rows[at : at + ROWS], *more):
                        found[k] = found[k] + now if k in found else now
        if found:
            yield _batch([(group, k, n, s.to_bytes()) for k, s in found.items()], _SUMS_ARROW)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in batches:
            for g, k, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (g, k, n) != key:
                    if key:
                        yield _batch([(*key, total.to_bytes())], _SUMS_ARROW)
                    key, total = (g, k, n), None
                now = Sums.from_bytes(data, k)
                total = now if total is None else total + now
        if key:
            yield _batch([(*key, total.to_bytes())], _SUMS_ARROW)

    each = blocks.select("__g", "n", "ids", "x", *given).mapInArrow(local, _SUMS)
    return each.repartition("__g", "k").sortWithinPartitions("__g", "k").mapInArrow(add, _SUMS)


def _axes(raw: DataFrame) -> DataFrame:
    """``__g, n, mean, along``: sizes and principal components of groups."""
    whole = _summed(raw.withColumn("n", F.lit(0).cast("long")), [], lambda x: [(1, Sums.of(x, np.ones((len(x), 1))))])
    schema = pa.schema([("__g", pa.string()), ("n", pa.int64()), ("mean", pa.binary()), ("along", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, _, _, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total = Sums.from_bytes(data, 1)
                mean, along = axes(total)
                yield _batch([(g, int(round(total.size[0])), mean.tobytes(), np.ascontiguousarray(along).tobytes())], schema)

    return whole.mapInArrow(run, "__g string, n long, mean binary, along binary")


def _reduced(raw: DataFrame, axes_: DataFrame, parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Blocks with vectors along their group's components, and the group's size as ``n``."""
    both = raw.join(parts.join(axes_, "__g"), _PART).select(*raw.columns, "n", "mean", "along")
    out = [*raw.columns, "n"]
    schema = ", ".join(f"`{c}` {both.schema[c].dataType.simpleString()}" for c in out)
    x_at = out.index("x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turned = []
            for ids, x, mean, along in zip(*(batch.column(c).to_pylist() for c in ("ids", "x", "mean", "along")), strict=True):
                m = np.frombuffer(mean)
                turned.append(((np.frombuffer(x).reshape(len(ids), -1) - m) @ np.frombuffer(along).reshape(len(m), -1)).tobytes())
            columns = batch.columns[: len(out)]
            columns[x_at] = pa.array(turned, pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=out)

    return both.mapInArrow(run, schema)


def _centres(reduced: DataFrame, most: int) -> DataFrame:
    """``__g, n, centres``: the first centres of each group, drawn among its rows with the smallest hashes."""
    schema = pa.schema([("__g", pa.string()), ("n", pa.int64()), ("ids", pa.list_(pa.int32())), ("x", pa.binary())])

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        group, size, ids, x = None, 0, None, None
        for batch in batches:
            for g, n, now, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now = np.array(now, np.int64)
                rows = np.frombuffer(data).reshape(len(now), -1)
                if g != group:
                    if group is not None:
                        yield group, size, ids, x
                    group, size, ids, x = g, n, now, rows
                else:
                    ids, x = np.concatenate([ids, now]), np.concatenate([x, rows])
                few = np.lexsort((ids, scattered(ids)))[:SEED_ROWS]
                ids, x = ids[few], x[few]
        if group is not None:
            yield group, size, ids, x

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, n, ids, x in least(batches):
            yield _batch([(g, n, ids.tolist(), x.tobytes())], schema)

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, n, ids, x in least(batches):
            yield _batch([(g, n, seeds(x, ids, min(most, n - 1)).tobytes())], pa.schema([("__g", pa.string()), ("n", pa.int64()), ("centres", pa.binary())]))

    few = reduced.select("__g", "n", "ids", "x").mapInArrow(local, "__g string, n long, ids array<int>, x binary")
    return few.repartition("__g").sortWithinPartitions("__g").mapInArrow(drawn, "__g string, n long, centres binary")


def _stepped(state: DataFrame | None, sums: DataFrame) -> DataFrame:
    """The next ``_STATE``: each fit takes its sums; then, by group, fits that can't win any more end and lesser mixtures go."""
    fresh = sums.selectExpr("__g", "k", "n", "CAST(NULL AS double) last", "0 rounds", "false done", "CAST(NULL AS double) likelihood", "CAST(NULL AS binary) mixture", "sums", "1 side")
    both = fresh if state is None else state.selectExpr("*", "CAST(NULL AS binary) sums", "0 side").unionByName(fresh)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, size, fits = None, 0, {}

        def ended() -> pa.RecordBatch:
            best = (np.inf, 0)
            d = next((f.mixture.mean.shape[1] for f in fits.values() if f.mixture is not None), 0)
            for k, f in sorted(fits.items()):
                if f.done and f.mixture is not None and np.isfinite(f.likelihood):
                    best = min(best, (bic(f.likelihood, size, d, k), k))
            rows = []
            for k, f in sorted(fits.items()):
                if not f.done and least_bic(size, d, k) >= best[0]:
                    f.done, f.likelihood = True, -np.inf
                held = f.mixture is not None and (not f.done or k == best[1])
                rows.append((group, k, size, float(f.last), f.rounds, f.done, float(f.likelihood), f.mixture.to_bytes() if held else None))
            return _batch(rows, _STATE_ARROW)

        for batch in batches:
            for g, k, n, last, rounds, done, likelihood, mixture, data, side in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != group:
                    if fits:
                        yield ended()
                    group, size, fits = g, n, {}
                if side == 0:
                    fits[k] = Fit.at(n, last, rounds, done, likelihood, Mixture.from_bytes(mixture, k) if mixture else None)
                elif k in fits:
                    fits[k].add(Sums.from_bytes(data, k))
                else:
                    fits[k] = Fit(Sums.from_bytes(data, k), n)
        if fits:
            yield ended()

    return both.repartition("__g").sortWithinPartitions("__g", "k", "side").mapInArrow(run, _STATE)


def _round(x: np.ndarray, models: list[dict]) -> Iterator[tuple[int, Sums]]:
    for m in models:
        yield m["k"], Mixture.from_bytes(m["mixture"], m["k"]).sums(x)


def _first(x: np.ndarray, centres: bytes) -> Iterator[tuple[int, Sums]]:
    every = np.frombuffer(centres).reshape(-1, x.shape[1])
    for k in range(1, len(every) + 1):
        yield k, Sums.of(x, nearest(x, every[:k]))


def fit_grouped(df: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """``keys, node_id, probabilities`` of ``keys, node_id, embedding`` rows, by ``keys``: memberships in the mixture of the smallest BIC.

    Groups have at least two rows, and a group's node ids are distinct.
    """
    raw = written(_blocks(df, keys))
    parts = written(raw.select(*_PART).distinct())
    buckets = max(df.sparkSession.sparkContext.defaultParallelism, -(-parts.count() // BUCKET_PARTS))
    axes_ = written(_axes(raw))
    reduced = written_in_buckets(_reduced(raw, axes_, parts, keys), _PART, buckets)
    to_parts = lambda some: reduced.join(parts.join(some, "__g"), _PART)
    firsts = written(_centres(reduced, most)).drop("n")
    state = written(_stepped(None, _summed(to_parts(firsts), ["centres"], _first)))
    while state.filter("NOT done").count():
        models = state.filter("NOT done").groupBy("__g").agg(F.collect_list(F.struct("k", "mixture")).alias("models"))
        state = written(_stepped(state, _summed(to_parts(models), ["models"], _round)))
    best = state.filter("mixture IS NOT NULL").select("__g", "k", "mixture")
    chosen = reduced.join(parts.join(best, "__g"), _PART, "left").select(*keys, "ids", "x", "k", "mixture")
    width = len(keys)
    schema = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys) + "node_id int, probabilities array<double>"

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, (ids, x, k, mixture) in enumerate(zip(*(c.to_pylist() for c in batch.columns[width:]), strict=True)):
                rows = np.frombuffer(x).reshape(len(ids), -1)
                found = Mixture.from_bytes(mixture, k).memberships(rows)[0] if mixture else np.ones((len(ids), 1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, found.shape[1]), pa.int32()), pa.array(found.ravel()))
                named = [batch.column(c).take(pa.array(np.full(len(ids), at))) for c in range(width)]
                yield pa.RecordBatch.from_arrays([*named, pa.array(ids, pa.int32()), lists], names=[*keys, "node_id", "probabilities"])

    return chosen.mapInArrow(members, schema)
