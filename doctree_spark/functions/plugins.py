"""How tokens are counted and sentences split: built-in expressions, or callables that see many texts at a time.

Operators that take ``tokens`` or ``split`` ask for columns only, so built-in ones stay in the
JVM. Callables are built once in each worker by a function that travels there, and get a flat
list: that of all texts of a batch, or of all elements of its arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from doctree_spark.functions import text as own


@dataclass(frozen=True)
class Tokens:
    """``of`` counts a text's tokens, ``each`` those of every text of an array. Null texts have null."""

    of: Callable[[Column], Column]
    each: Callable[[Column], Column]


@dataclass(frozen=True)
class Sentences:
    """``each`` splits every text of an array: an array of arrays, sentences stripped and none empty."""

    each: Callable[[Column], Column]


TOKENS = Tokens(own.token_count, lambda texts: F.transform(texts, own.token_count))
SENTENCES = Sentences(lambda texts: F.transform(texts, own.sentences))


def _counts(said: list, n: int) -> pa.Array:
    if len(said) != n:
        raise ValueError(f"{len(said)} counts of {n} texts")
    return pa.array(said, pa.int32())


def counting(make: Callable[[], Callable[[list[str]], list[int]]]) -> Tokens:
    """Counts by a callable from texts to numbers of tokens."""

    @F.arrow_udf("int")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = make()
        for texts in batches:
            have = texts.drop_null()
            found = _counts(count(have.to_pylist()), len(have)) if len(have) else pa.array([], pa.int32())
            if len(have) == len(texts):
                yield found
            else:
                at = np.cumsum(np.asarray(texts.is_valid())) - 1
                yield found.take(pa.array(at, mask=~np.asarray(texts.is_valid())))

    @F.arrow_udf("array<int>")
    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = make()
        for lists in batches:
            flat = lists.flatten()
            found = _counts(count(flat.to_pylist()), len(flat)) if len(flat) else pa.array([], pa.int32())
            yield _like(lists, found)

    # else the optimizer would draw a call into lambdas, where Python can't be called
    return Tokens(of.asNondeterministic(), each.asNondeterministic())


def splitting(make: Callable[[], Callable[[list[str]], list[list[str]]]]) -> Sentences:
    """Sentences by a callable from texts to lists of them; what it gives is stripped, and empty ones go."""

    @F.arrow_udf("array<array<string>>")
    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        split = make()
        for lists in batches:
            flat = lists.flatten().to_pylist()
            said = split(flat) if flat else []
            if len(said) != len(flat):
                raise ValueError(f"{len(said)} splits of {len(flat)} texts")
            yield _like(lists, pa.array([[b for s in x if (b := s.strip())] for x in said], pa.list_(pa.string())))

    return Sentences(each.asNondeterministic())


def _like(lists: pa.Array, values: pa.Array) -> pa.Array:
    """``values`` in lists as long as ``lists``'; null lists stay null."""
    sizes = np.asarray(lists.value_lengths().fill_null(0))
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values, mask=lists.is_null() if lists.null_count else None)
