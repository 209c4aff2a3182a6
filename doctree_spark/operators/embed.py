"""Embeddings: any batch model, by default signed feature hashing of lower-cased tokens."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doctree_spark.functions.text import TOKEN

DIMENSIONS = 64
BATCH = 64
Embedder = Callable[[list[str]], list]
_CACHE = 200_000


class _WordVectors(dict):
    """Places of words in a table of their tokens' sums; tokens never span white space."""

    def __init__(self) -> None:
        self.token, self.signs, self.table = regex.compile(TOKEN), {}, np.zeros((1024, DIMENSIONS))

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        if place == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        row = self.table[place]
        for t in self.token.findall(word):
            found = self.signs.get(t)
            if found is None:
                # place by the first eight hex digits, sign by the ninth
                h = hashlib.md5(t.encode()).digest()
                found = self.signs[t] = (int.from_bytes(h[:4], "big") % DIMENSIONS, -1.0 if h[4] & 16 else 1.0)
            row[found[0]] += found[1]
        return place


def hash_embedder() -> Embedder:
    """Default model: a token adds a sign at a place, both from its MD5; vectors have length one, or zero without tokens.

    Words are cut into tokens and hashed once, up to ``_CACHE`` of them at a time.
    """
    known = _WordVectors()

    def embed(texts: list[str]) -> list:
        nonlocal known
        out = []
        for text in texts:
            if len(known) > _CACHE:
                known = _WordVectors()
            places = list(map(known.__getitem__, text.lower().split()))
            v = known.table[places].sum(axis=0)
            size = math.sqrt(float(v @ v))
            out.append(v / size if size else v)
        return out

    return embed


def embed(df: DataFrame, text_col: str, out_col: str = "embedding", make: Callable[[], Embedder] = hash_embedder, batch: int = BATCH, deal: bool = False) -> DataFrame:
    """Adds ``out_col`` (array<double>). ``make`` builds the model once in each worker; null texts count as empty.

    The model gets ``batch`` texts at a time, and what it gives is handed on before the next
    batches are asked for. With ``deal``, rows go to all of the session's shuffle partitions
    first: for inputs of few files and models that cost more than moving a text.
    """

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = make()
        for s in texts:
            values = s.to_pylist()
            vectors = [np.asarray(v, float) for k in range(0, len(values), batch) for v in model(values[k : k + batch])]
            ends = np.concatenate([[0], np.cumsum([len(v) for v in vectors])]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(vectors) if vectors else np.zeros(0)))

    if deal:
        df = df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism))
    return df.withColumn(out_col, run(F.coalesce(F.col(text_col), F.lit(""))))
