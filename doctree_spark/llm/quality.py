"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features gives a document its score s; ordered thresholds
cut the scores into grades: P(grade <= k) = logistic(threshold[k] - s). From that follow the
expected grade and the probability of reaching a grade, on which documents are selected.

Features: which words and beginnings of words a text has (hashed, present or not), how its kinds
of characters follow each other (shares of pairs of eight kinds), and how much it repeats words
and lines. The model is fitted on a bounded sample of
rated documents; scoring runs over every document, with no shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doctree_spark.llm.shared import table

#: Most rated documents that the fit reads.
SAMPLE = 12_000
BITS = 20
#: Words in fewer sampled documents than this get no weight.
LEAST_DOCS = 4
#: ... nor words whose documents' mean grade differs by fewer standard errors than this.
APART = 4.0
ROUNDS = 120
RIDGE = 3.0
RATE = 0.1
#: Letters of a word that count as its beginning.
HEAD = 4
CACHE_WORDS = 500_000
#: Rated documents whose features the fit looks at together.
PIECE_ROWS = 1000

_WORD = re.compile(r"\w+")
_KINDS = 8
#: Features that aren't words: pairs of kinds, and three shares of repetition.
_SHAPES = _KINDS * _KINDS + 3


def _kind_table() -> bytes:
    """Kind of each byte: capital, small, digit, blank, line end, sentence mark, other sign, beyond ASCII."""
    kind = bytearray([6] * 128 + [7] * 128)
    for chars, k in (("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0), ("abcdefghijklmnopqrstuvwxyz", 1), ("0123456789", 2), (" \t", 3), ("\n\r", 4), (".,;:?'\"()-", 5)):
        for c in chars:
            kind[ord(c)] = k
    return bytes(kind)


_KIND = _kind_table()


class Features:
    """Hashed features of texts: bucket ids, word values are 1, kind pairs have shares."""

    def __init__(self, bits: int = BITS) -> None:
        self.words = 1 << bits
        self.size = self.words + _SHAPES
        self.cache: dict[str, int] = {}

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        cache, ids = self.cache, set()
        words = _WORD.findall(text.lower())
        distinct = set(words)
        for word in distinct | {f"{w[:HEAD]}-" for w in distinct}:
            i = cache.get(word)
            if i is None:
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                i = cache[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) & (self.words - 1)
            ids.add(i)
        kinds = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_KIND), np.uint8)
        pairs = np.bincount(kinds[:-1] * _KINDS + kinds[1:], minlength=_KINDS * _KINDS) if len(kinds) > 1 else np.zeros(_KINDS * _KINDS)
        lines = text.split("\n")
        again = [1 - len(set(lines)) / len(lines), 1 - len(distinct) / max(1, len(words)), sum(map(eq, words, words[1:])) / max(1, len(words))]
        shares = np.sqrt(pairs / max(1, len(kinds) - 1))
        index = np.concatenate([np.sort(np.fromiter(ids, np.int64, len(ids))), np.arange(self.words, self.size)])
        return index, np.concatenate([np.ones(len(ids)), 5 * shares, again])


@dataclass
class Model:
    """Weights by bucket and ascending thresholds; grades run from 0 to their number."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tail(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...: one row a document."""
        return _logistic(score[:, None] - self.thresholds[None, :])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(sizes: np.ndarray, flat: np.ndarray, x: np.ndarray, grade: np.ndarray, grades: int, features: int, least: int = LEAST_DOCS, rounds: int = ROUNDS, ridge: float = RIDGE) -> Model:
    """Maximum likelihood with a ridge, by full-batch steps of adaptive size; the same rows in the same order give the same model.

    ``flat`` and ``x`` are the buckets and values of all rows behind each other, ``sizes`` of each.
    """
    begin = np.concatenate([[0], np.cumsum(sizes)])
    pieces = [(slice(begin[a], begin[min(a + PIECE_ROWS, len(sizes))]), np.arange(a, min(a + PIECE_ROWS, len(sizes)), dtype=np.int32)) for a in range(0, len(sizes), PIECE_ROWS)]
    return _fit([(rows, sizes[rows], flat[at], x[at]) for at, rows in pieces], grade, grades, features, least, rounds, ridge)


def _fit(pieces: Sequence[tuple[np.ndarray, ...]], grade: np.ndarray, grades: int, features: int, least: int = LEAST_DOCS, rounds: int = ROUNDS, ridge: float = RIDGE) -> Model:
    """``fit`` of pieces: numbers of some rows in order, their sizes, buckets and values. Only values that the fit uses are held in wide types."""
    seen, off = np.zeros(features, np.int64), np.zeros(features)
    for rows, sizes, flat, _ in pieces:
        seen += np.bincount(flat, minlength=features)
        off += np.bincount(flat, np.repeat(grade[rows] - grade.mean(), sizes), minlength=features)
    # of the word buckets, those whose documents' mean grade is far from the overall mean
    apart = np.abs(off) / (np.sqrt(np.maximum(seen, 1)) * max(grade.std(), 1e-9))
    used, kept = (seen >= least) & (apart >= APART) | (np.arange(features) >= features - _SHAPES), []
    for rows, sizes, flat, x in pieces:
        use = used[flat]
        kept.append((rows, np.repeat(np.arange(len(rows), dtype=np.int32), sizes)[use], flat[use], x[use]))
    own = np.flatnonzero(np.bincount(np.concatenate([np.unique(flat) for _, _, flat, _ in kept]), minlength=features))
    kept = [(rows, row, np.searchsorted(own, flat).astype(np.int32), x) for rows, row, flat, x in kept]
    n, m = len(grade), grades - 1
    w = np.zeros(len(own))
    share = np.array([(grade < k).mean() for k in range(1, grades)]).clip(0.01, 0.99)
    first = np.log(share / (1 - share))
    theta = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 0.05))])
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (w, theta)]
    for t in range(1, rounds + 1):
        cuts = np.concatenate([theta[:1], theta[0] + np.cumsum(np.exp(theta[1:]))])
        s = np.empty(n)
        for rows, row, flat, x in kept:
            s[rows] = np.bincount(row, x * w[flat], minlength=len(rows))
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        with np.errstate(over="ignore"):
            low, high = (1 / (1 + np.exp(-np.clip(edges[grade + k] - s, -40, 40))) for k in (0, 1))
        low, high = np.where(grade == 0, 0, low), np.where(grade == m, 1, high)
        p = np.maximum(high - low, 1e-12)
        by_score = 1 - low - high
        by_cut = np.bincount(grade, -high * (1 - high) / p, minlength=grades)[:m] + np.bincount(grade, low * (1 - low) / p, minlength=grades)[1:]
        grad_w = ridge * w
        for rows, row, flat, x in kept:
            grad_w += np.bincount(flat, x * by_score[rows][row], minlength=len(own))
        grad_t = np.concatenate([[by_cut.sum()], np.cumsum(by_cut[::-1])[::-1][1:] * np.exp(theta[1:])])
        for p_, g, (a, b) in zip((w, theta), (grad_w, grad_t), moments, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p_ -= RATE * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)
    full = np.zeros(features, np.float32)
    full[own] = w
    return Model(full, np.concatenate([theta[:1], theta[0] + np.cumsum(np.exp(theta[1:]))]))


def train(docs: DataFrame, rated: DataFrame, grades: int, sample: int = SAMPLE) -> Model | None:
    """Model from ``rated`` (``doc_id, grade``) and their texts in ``docs``.

    At most ``sample`` rated ids, the first in the order of a hash, are read, so the sample is
    small enough to broadcast and its features to fit on the driver. Of ratings of one id the
    lowest counts; rows with a null id or grade are left out. No usable row: None.
    """
    chosen = rated.filter("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    schema = T.StructType().add("doc_id", "long").add("grade", "integer").add("index", T.ArrayType(T.IntegerType())).add("shapes", T.ArrayType(T.FloatType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([i[:-_SHAPES].astype(np.int32) for i, _ in found], pa.list_(pa.int32())), pa.array([v[-_SHAPES:].astype(np.float32) for _, v in found], pa.list_(pa.float32()))], names=schema.fieldNames())

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade"))), "doc_id").groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min("text").alias("text"))
    got = rows.mapInArrow(run, schema).toArrow()
    if not got.num_rows:
        return None
    # the table is neither joined nor sorted as a whole: a piece of it at a time is brought into order and widened
    ids = got.column("doc_id").to_numpy()
    model = _fit(_Pieces(got.select(["index", "shapes"]), np.argsort(ids)), got.column("grade").to_numpy().astype(np.int64)[np.argsort(ids)], grades, Features().size)
    del got
    pa.default_memory_pool().release_unused()
    return model


class _Pieces(Sequence):
    """Rows of a table with ``index`` (buckets of words, of value 1) and ``shapes`` (values of the other features), in an order, as ``_fit`` takes them."""

    def __init__(self, table: pa.Table, order: np.ndarray) -> None:
        self.table, self.order = table, order

    def __len__(self) -> int:
        return -(-len(self.order) // PIECE_ROWS)

    def __getitem__(self, k: int) -> tuple[np.ndarray, ...]:
        if k >= len(self):
            raise IndexError(k)
        at = self.order[k * PIECE_ROWS : (k + 1) * PIECE_ROWS]
        piece = self.table.take(pa.array(at)).combine_chunks()
        index, shapes = (piece.column(c).combine_chunks() for c in range(2))
        words = index.value_lengths().to_numpy().astype(np.int64)
        ends, others = np.cumsum(words), Features().words + np.arange(_SHAPES, dtype=np.int32)
        # behind the words of a row its other features
        flat = np.insert(index.flatten().to_numpy(), np.repeat(ends, _SHAPES), np.tile(others, len(at)))
        x = np.insert(np.ones(ends[-1], np.float32), np.repeat(ends, _SHAPES), shapes.flatten().to_numpy())
        return k * PIECE_ROWS + np.arange(len(at), dtype=np.int32), words + _SHAPES, flat, x


def score(docs: DataFrame, model: Model | None, grades: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score, expected_grade double, tail array<double>`` for every row of ``docs``.

    ``tail[k-1]`` is the probability of grade k or better. A null text counts as empty. Without
    a model all but the id are null. Ids may repeat or be null; other columns are ignored.
    """
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    if model is None:
        empty = F.lit(None).cast("double")
        return rows.select(id_col, empty.alias("score"), empty.alias("expected_grade"), F.lit(None).cast("array<double>").alias("tail"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([rows.schema[0]]).add("score", "double").add("expected_grade", "double").add("tail", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, fitted = Features(), sent.value
        for batch in batches:
            s = np.empty(batch.num_rows)
            for k, text in enumerate(batch.column(1)):
                index, value = features(text.as_py())
                s[k] = fitted.weights[index] @ value
            tail = fitted.tail(s)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array(tail.sum(axis=1)), pa.array(list(tail), pa.list_(pa.float64()))], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


def select_documents(docs: DataFrame, model: Model | None, grade: int, least: float, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, unchanged, whose probability of ``grade`` or better is ``least`` or more; all of them without a model.

    A null text counts as empty; rows may repeat, and are judged each for itself.
    """
    if model is None:
        return docs
    sent, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, fitted = Features(), sent.value
        for batch in batches:
            found = [features(text.as_py() or "") for text in batch.column(place)]
            s = np.array([fitted.weights[index] @ value for index, value in found])
            yield batch.filter(pa.array(fitted.tail(s.reshape(-1))[:, grade - 1] >= least))

    return docs.mapInArrow(run, docs.schema)


def grades_of(labels: DataFrame) -> DataFrame:
    """``doc_id, grade``: one step for quality, one for not being toxic; the best grade is 2."""
    return labels.select("doc_id", (F.col("quality") + 1 - F.col("toxic")).alias("grade"))


GRADES = 3
#: Documents less likely than this to have the best grade are rejected.
KEEP_FROM = 0.65


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, grades_of(table(spark, sf_dir, "labels")), GRADES)
    best = F.get("tail", F.lit(GRADES - 2))
    return score(docs, model, GRADES).select("doc_id", "expected_grade", best.alias("p_best"), F.coalesce(best >= KEEP_FROM, F.lit(True)).alias("kept"))
