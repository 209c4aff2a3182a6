"""Calls of models: batches by count and tokens, retries of what failed, a bound on calls at a time.

A model is a callable that takes a list of items and returns a list of texts. It is built once
in each task by a function that travels to the workers. Batches run over the edges of Arrow's
batches, so a task with n items makes ceil(n / items) first calls.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Model = Callable[[list], list]


@dataclass(frozen=True)
class Calls:
    """How a model is called.

    Attributes:
        items: most items of a call.
        tokens: most tokens of a call's items together; an item of more goes alone. None: no limit.
        attempts: how often an item is tried, at least once.
        delay: seconds before the second attempt at an item, doubled before each one after.
        parallel: most calls at a time over the whole cluster. None: one for each running task.
        threads: calls that one task makes at a time, so that ``parallel`` takes fewer cores.
        fatal: kinds of exceptions that end the task, which Spark then repeats.
    """

    items: int = 16
    tokens: int | None = None
    attempts: int = 1
    delay: float = 0.0
    parallel: int | None = None
    threads: int = 1
    fatal: tuple[type[Exception], ...] = ()


@dataclass
class _Item:
    """An item, where its result goes, and what became of it."""

    value: object
    tokens: int
    said: str | None = None
    error: str | None = None
    attempts: int = 0


def attempted(model: Model, items: list[_Item], calls: Calls) -> None:
    """Tries a batch, then what failed of it, with growing delays.

    An answer that is null or blank fails its item alone. A call that raises, or has another
    number of answers, fails all its items; these are tried again in calls a quarter as large,
    in the last attempt one by one, so an item that breaks every call takes none with it.
    """
    left, size, delay = items, len(items), calls.delay
    for attempt in range(1, max(1, calls.attempts) + 1):
        broken = False
        for at in range(0, len(left), size):
            part = left[at : at + size]
            for x in part:
                x.attempts = attempt
            try:
                said = list(model([x.value for x in part]))
                if len(said) != len(part):
                    raise ValueError(f"{len(said)} answers to {len(part)} items")
            except calls.fatal:
                raise
            except Exception as error:  # a model may fail in any way
                broken = True
                for x in part:
                    x.error = f"{type(error).__name__}: {error}"
                continue
            for x, text in zip(part, said, strict=True):
                x.said = (text or "").strip() or None
                x.error = None if x.said else "no answer"
        left = [x for x in left if x.error]
        if not left or attempt >= calls.attempts:
            return
        if broken:
            size = 1 if attempt == calls.attempts - 1 else max(1, size // 4)
        if delay:
            time.sleep(delay)
            delay *= 2


def _groups(tokens: list[int], calls: Calls, last: bool) -> Iterator[tuple[int, int]]:
    """From where to where calls go, in a row; without ``last`` only those that further items can't join."""
    at = held = 0
    for k, n in enumerate(tokens):
        if k > at and (k - at >= calls.items or calls.tokens is not None and held + n > calls.tokens):
            yield at, k
            at, held = k, 0
        held += n
    if at < len(tokens) and (last or len(tokens) - at >= calls.items):
        yield at, len(tokens)


def call_model(df: DataFrame, inputs: list[Column | str], out: str, make: Callable[[], Model], calls: Calls = Calls(), tokens: Column | None = None) -> DataFrame:  # noqa: B008
    """Adds ``out string``, ``<out>_error string`` and ``<out>_attempts int``.

    Args:
        inputs: what makes an item: the value of one column, or a tuple of several. Rows with a
            null among them aren't asked: all three are null (0 attempts).
        make: builds the model; called once in each task.
        tokens: an item's tokens, for ``calls.tokens``.

    With ``calls.parallel``, rows are dealt into so many tasks (times threads). Rows may repeat
    and come out in any order. Nothing is kept: where the result is used twice, cut it first.
    """
    columns = [c for c in df.columns if c not in (out, f"{out}_error", f"{out}_attempts")]
    if calls.parallel:
        df = df.repartition(max(1, calls.parallel // max(1, calls.threads)))
    named = [F.col(c) if isinstance(c, str) else c for c in inputs]
    sent = df.select(*columns, F.coalesce(tokens if tokens is not None else F.lit(0), F.lit(0)).cast("long").alias("__tokens"), *(c.alias(f"__in{k}") for k, c in enumerate(named)))
    fields = [T.StructField(out, T.StringType()), T.StructField(f"{out}_error", T.StringType()), T.StructField(f"{out}_attempts", T.IntegerType())]
    schema = T.StructType([*(df.schema[c] for c in columns), *fields])
    width = len(columns)

    def results(rows: pa.Table, items: list[_Item]) -> Iterator[pa.RecordBatch]:
        new = [pa.array([x.said for x in items], pa.string()), pa.array([x.error for x in items], pa.string()), pa.array([x.attempts for x in items], pa.int32())]
        yield from pa.table([*rows.columns[:width], *new], names=schema.fieldNames()).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, rows, items = make(), None, []
        going: deque[tuple[pa.Table, list[_Item], Future]] = deque()

        def ended(most: int) -> Iterator[pa.RecordBatch]:
            while len(going) > most:
                part, some, future = going.popleft()
                future.result()
                yield from results(part, some)

        def begun(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal rows, items
            done = 0
            for at, to in _groups([x.tokens for x in items], calls, last):
                yield from ended(threads - 1)
                going.append((rows.slice(at, to - at), items[at:to], pool.submit(attempted, model, items[at:to], calls)))
                done = to
            rows, items = rows.slice(done), items[done:]

        threads = max(1, calls.threads)
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                values = [v if len(v) > 1 else v[0] for v in zip(*(c.to_pylist() for c in batch.columns[width + 1 :]), strict=True)]
                asked = [None not in v if isinstance(v, tuple) else v is not None for v in values]
                table = pa.Table.from_batches([batch])
                if not all(asked):
                    out = table.filter(pa.array([not x for x in asked]))
                    yield from results(out, [_Item(None, 0)] * out.num_rows)
                    table = table.filter(pa.array(asked))
                rows = table if rows is None else pa.concat_tables([rows, table])
                items += [_Item(v, n) for v, n, x in zip(values, batch.column(width).to_pylist(), asked, strict=True) if x]
                yield from begun(False)
            if rows is not None:
                yield from begun(True)
                yield from ended(0)

    return sent.mapInArrow(run, schema)
