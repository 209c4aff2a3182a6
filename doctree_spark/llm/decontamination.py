"""Benchmark decontamination by latent semantic retrieval.

1. Two passes over the corpus cut every text into passages and add up, task by task, the product
   of the terms' Gram matrix with test vectors, random ones first, then a basis of what came of
   these. Blocks of rows of the product are summed by a shuffle. From the sums, which have a
   fixed size, follow the singular values and right singular vectors of the TF-IDF matrix (a
   randomised SVD with a power step).
2. A last pass looks for regions where rare words of a benchmark item stand together, rejects
   those whose latent cosine with it is low, and confirms the others by their longest common
   subsequence with the whole item or with one of its passages, and by its answer where one is given.

A region that reaches the least common subsequence must hold three of the passage's rarest words,
if as many of these are looked for as the subsequence may miss and three more. So cosines are
only computed where three stand together; nothing that the subsequence could confirm is left out by that.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doctree_spark.llm.shared import byte_table, hashed_words, table, written

#: Hashed terms, test vectors (twice as many as are kept) and singular vectors kept.
TERMS = 1 << 14
TEST_VECTORS = 24
RANK = 12
#: Words in a passage of the SVD.
PASSAGE = 32
#: Words in a passage of an item, and from one passage's first to the next's. With a least common
#: share of 0.75 any 24 words of an item in a row fill one.
ITEM_PASSAGE, ITEM_STEP = 32, 8
#: Terms in a larger share of passages than this carry no weight.
TOO_COMMON = 0.5
LEAST_COSINE = 0.6
LEAST_COMMON = 0.75
LEAST_ANSWER = 0.6
#: Items with fewer words must stand in a text word for word.
SHORT = 8
#: Rare words of an item that must stand together before a passage is looked at.
ANCHORS = 3
#: Benchmark text that one scan takes to every task; more is scanned in several blocks.
BLOCK_BYTES = 32 << 20
_BLOCKS = 64
_WIDTH = TERMS // _BLOCKS

#: Letters, digits and whatever isn't ASCII make words.
_LETTERS = byte_table(bytes(c for c in range(128) if not chr(c).isalnum()))


def _ids(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of some texts at a time as 32-bit numbers, and where each text's begin."""
    for hashes, begin in hashed_words(texts, _LETTERS):
        yield (hashes >> np.uint64(32)).astype(np.uint32), begin


def _each(texts: pa.Array) -> Iterator[np.ndarray]:
    """Words of each text as numbers."""
    for ids, begin in _ids(texts):
        for k in range(len(begin) - 1):
            yield ids[begin[k] : begin[k + 1]]


def sign_matrix() -> np.ndarray:
    """Random signs, by terms and test vectors."""
    return np.random.default_rng(7).choice(np.array([-1, 1], np.float32), (TERMS, TEST_VECTORS))


class _Gram:
    """Sums over passages: how many have each term, and the matrix of terms by terms times ``vectors``."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.passages = 0
        self.having = np.zeros(TERMS, np.int64)
        self.vectors = np.ascontiguousarray(vectors, np.float32)
        self.product = np.zeros((vectors.shape[1], TERMS))

    def add(self, ids: np.ndarray, begin: np.ndarray) -> None:
        if not len(ids):
            return
        lengths = np.diff(begin)
        counts = -(-lengths // PASSAGE)
        first = np.concatenate([[0], np.cumsum(counts)])
        starts = np.repeat(begin[:-1], counts) + (np.arange(first[-1]) - np.repeat(first[:-1], counts)) * PASSAGE
        n = len(starts)
        passage = np.repeat(np.arange(n), np.diff(np.append(starts, len(ids))))
        term = (ids & np.uint32(TERMS - 1)).astype(np.int64)
        pairs = np.sort(passage * TERMS + term)
        once = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])]
        self.passages += n
        self.having += np.bincount(once & (TERMS - 1), minlength=TERMS)
        rows = np.add.reduceat(self.vectors[term], starts, axis=0)
        for j, column in enumerate(np.ascontiguousarray(rows.T)):
            self.product[j] += np.bincount(term, column[passage], minlength=TERMS)


def corpus_gram(texts: DataFrame, vectors: np.ndarray) -> tuple[int, np.ndarray, np.ndarray] | None:
    """Number of passages of all ``text`` rows, passages by term, and A'A times ``vectors``, A the term counts by passage.

    Each task sends its sums once, in blocks of terms; a block's pieces are added as they stream
    in. What arrives has ``TERMS`` rows whatever the corpus. None for a corpus without words.
    """
    schema = T.StructType().add("block", "integer").add("passages", "long").add("having", "binary").add("product", "binary")
    arrow = pa.schema([("block", pa.int32()), ("passages", pa.int64()), ("having", pa.binary()), ("product", pa.binary())])
    sent, wide = texts.sparkSession.sparkContext.broadcast(vectors), vectors.shape[1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = _Gram(sent.value)
        for batch in batches:
            for ids, begin in _ids(batch.column(0)):
                gram.add(ids, begin)
        if gram.passages:
            cut = lambda a, k: np.ascontiguousarray(a[..., k * _WIDTH : (k + 1) * _WIDTH]).tobytes()
            rows = [{"block": k, "passages": gram.passages, "having": cut(gram.having, k), "product": cut(gram.product.astype(np.float32), k)} for k in range(_BLOCKS)]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                having, product = np.frombuffer(row["having"], np.int64), np.frombuffer(row["product"], np.float64 if len(row["product"]) == 8 * _WIDTH * wide else np.float32)
                s = sums.setdefault(row["block"], [0, np.zeros(_WIDTH, np.int64), np.zeros(_WIDTH * wide)])
                s[0] += row["passages"]
                s[1] += having
                s[2] += product
        if sums:
            yield pa.RecordBatch.from_pylist([{"block": k, "passages": s[0], "having": s[1].tobytes(), "product": s[2].tobytes()} for k, s in sums.items()], schema=arrow)

    pieces = texts.mapInArrow(count, schema)
    # first within a few groups a block, then over these
    some = pieces.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(8))).repartition("block", "part").drop("part").mapInArrow(add, schema)
    rows = sorted(some.repartition("block").mapInArrow(add, schema).collect(), key=lambda r: r["block"])
    sent.unpersist()
    if not rows:
        return None
    having = np.concatenate([np.frombuffer(r["having"], np.int64) for r in rows])
    return rows[0]["passages"], having, np.concatenate([np.frombuffer(r["product"], np.float64).reshape(wide, _WIDTH).T for r in rows])


@dataclass
class Space:
    """The latent space: inverse document frequency of terms, and their weighted singular vectors."""

    idf: np.ndarray
    vectors: np.ndarray
    singular: np.ndarray

    def of(self, ids: np.ndarray) -> np.ndarray:
        return self.vectors[ids & np.uint32(TERMS - 1)].sum(axis=0)


def latent_space(texts: DataFrame, rank: int = RANK) -> Space | None:
    """Singular vectors of the TF-IDF matrix of all passages of ``text`` rows; None without words.

    A randomised SVD in two passes over the corpus: the first takes the matrix of terms by terms
    to random test vectors, the second to an orthonormal basis of what comes out (the power
    step); a small eigenproblem in that basis gives the vectors. The test vectors are left
    unweighted, as document frequencies are known after the first pass only.
    """
    found = corpus_gram(texts, sign_matrix())
    if found is None:
        return None
    n, having, product = found
    idf = np.where((having > 0) & (having <= TOO_COMMON * n), np.log((n + 1) / (having + 1)), 0.0)
    if not idf.any():
        idf = np.where(having > 0, 1.0, 0.0)
    base, _ = np.linalg.qr(idf[:, None] * product)
    _, _, product = corpus_gram(texts, idf[:, None] * base)
    small = base.T @ (idf[:, None] * product)
    value, vector = np.linalg.eigh((small + small.T) / 2)
    top = np.argsort(-value)[:rank]
    return Space(idf, (idf[:, None] * (base @ vector[:, top])).astype(np.float32), np.sqrt(np.maximum(value[top], 0)))


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel: one addition for each item of ``b``."""
    where: dict[int, int] = defaultdict(int)
    for i, x in enumerate(a):
        where[x] |= 1 << i
    row = full = (1 << len(a)) - 1
    for y in b:
        m = row & where.get(y, 0)
        row = (row + m | row - m) & full
    return len(a) - row.bit_count()


def item_passages(n: int) -> list[tuple[int, int]]:
    """Spans of an item of ``n`` words that are looked for: the whole item and, if it is longer than one, its passages."""
    if n <= ITEM_PASSAGE:
        return [(0, n)] if n else []
    return [(0, n), *((k, k + ITEM_PASSAGE) for k in [*range(0, n - ITEM_PASSAGE, ITEM_STEP), n - ITEM_PASSAGE])]


class Finder:
    """Items by their rarest words, and the checks of a candidate."""

    def __init__(self, space: Space, items: list[tuple[int, str, str | None]]) -> None:
        self.space = space
        self.items, anchors, self.together, self.reach = [], [], [], []
        wholes, answers = (_each(pa.array([item[k] for item in items], pa.string())) for k in (1, 2))
        for (item_id, _, _), whole, said in zip(items, wholes, answers, strict=True):
            said = said.tolist()
            for first, last in item_passages(len(whole)):
                ids = whole[first:last]
                m = len(ids)
                need = m if m < SHORT else math.ceil(LEAST_COMMON * m)
                together = min(ANCHORS, need)
                rare = np.argsort(-space.idf[ids & np.uint32(TERMS - 1)], kind="stable")[: m - need + together]
                anchors += [(int(ids[offset]), len(self.items), offset) for offset in rare.tolist()]
                latent = space.of(ids)
                slack = 0 if m < SHORT else m // 4
                self.items.append((item_id, ids.tolist(), need, slack, latent / max(float(np.linalg.norm(latent)), 1e-12), said, first, len(whole)))
                self.together.append(together)
                self.reach.append(m + 2 * slack)
        anchors.sort()
        self.words, self.first = np.unique(np.array([a[0] for a in anchors], np.uint32), return_index=True)
        self.first = np.append(self.first, len(anchors))
        self.item, self.offset = (np.array([a[k] for a in anchors], np.int64) for k in (1, 2))
        self.together, self.reach = np.array(self.together, np.int64), np.array(self.reach, np.int64)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.words & np.uint32((1 << 20) - 1)] = True

    def starts(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """(item, start) of the regions in which enough of an item's rarest words stand together."""
        at = np.flatnonzero(self.seen[ids & np.uint32((1 << 20) - 1)])
        if not len(at):
            return []
        place = np.minimum(np.searchsorted(self.words, ids[at]), len(self.words) - 1)
        real = self.words[place] == ids[at]
        at, place = at[real], place[real]
        counts = self.first[place + 1] - self.first[place]
        entry = np.repeat(self.first[place] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        item, at, offset = self.item[entry], np.repeat(at, counts), self.offset[entry]
        # a word that stands several times in an item is one occurrence in the text
        order = np.lexsort((at, item))
        item, at, offset = item[order], at[order], offset[order]
        new = np.concatenate([[True], (item[1:] != item[:-1]) | (at[1:] != at[:-1])]) if len(item) else np.zeros(0, bool)
        of, where = item[new], at[new]
        enough = np.zeros(len(of), bool)
        for k in range(1, ANCHORS + 1):
            n = len(of) - k + 1
            if n > 0:
                fits = (of[k - 1 :] == of[:n]) & (where[k - 1 :] - where[:n] < self.reach[of[:n]]) & (self.together[of[:n]] == k)
                for j in range(k):
                    enough[j : j + n] |= fits
        chosen = enough[np.cumsum(new) - 1]
        return list(zip(item[chosen].tolist(), (at[chosen] - offset[chosen]).tolist(), strict=True))

    def find(self, ids: np.ndarray) -> list[dict]:
        """The best region of each item in a text.

        Starts in one bucket of a passage are looked at as one region, which reaches as far as
        the passage, with what it may skip or add, would from any of them.
        """
        best: dict[int | None, dict] = {}
        tried = set()
        for k, start in self.starts(ids):
            item_id, words, need, slack, latent, answer, before, whole = self.items[k]
            m, wide = len(words), max(1, slack)
            mark = (k, start // wide)
            if mark in tried or best.get(item_id, {"words": 0})["words"] >= m:
                continue
            here = self.space.of(ids[max(0, start) : max(0, start + m)])
            cosine = float(here @ latent) / max(float(np.linalg.norm(here)), 1e-12)
            if cosine < LEAST_COSINE and latent.any():
                continue
            tried.add(mark)
            low = mark[1] * wide
            a, b = max(0, low - slack), min(len(ids), low + wide - 1 + m + slack)
            common = common_subsequence(words, ids[a:b].tolist())
            if common < need or common <= best.get(item_id, {"words": 0})["words"]:
                continue
            said = None
            if answer:
                # a passage's answer may stand wherever the whole item would
                around = whole // 4
                said = common_subsequence(answer, ids[max(0, min(a, low - before - around)) : max(b, low - before + whole + around)].tolist()) / len(answer)
            if said is None or said >= LEAST_ANSWER:
                best[item_id] = {"item_id": item_id, "first_word": a, "last_word": b - 1, "cosine": min(1.0, cosine), "common": common / m, "answer": said, "words": common}
        return list(best.values())


FOUND = T.StructType().add("item_id", "long").add("first_word", "long").add("last_word", "long").add("cosine", "double").add("common", "double").add("answer", "double")


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None) -> DataFrame:
    """Passages of ``docs`` that give away benchmark items, the best for each document and item.

    Args:
        docs: the corpus; the latent space is made of all its texts.
        benchmark: items. Where ``answer_col`` gives an answer, a region must hold it too.

    Returns:
        ``id_col, item_id, first_word, last_word`` (of the region looked at), ``cosine`` in the
        latent space, ``common`` (longest common subsequence, share of the words of the item or
        the passage of it that was confirmed) and ``answer`` (share of the answer's, null without one). Null or empty texts and items have no rows; ids may
        repeat. An empty corpus or benchmark gives no rows.
    """
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    schema = T.StructType([rows.schema[0], *FOUND])
    kinds = {"bigint": pa.int64(), "double": pa.float64()}

    def scan(sent: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(*sent.value)
            for batch in batches:
                of, found = [], []
                for n, ids in enumerate(_each(batch.column(1))):
                    got = finder.find(ids)
                    found += got
                    of += [n] * len(got)
                columns = [pa.array([f[c.name] for f in found], kinds[c.dataType.simpleString()]) for c in FOUND]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *columns], names=schema.fieldNames())

        return rows.mapInArrow(run, schema)

    out = None
    for sent, last in _blocks(docs, benchmark, text_col, item_col, item_text, answer_col):
        found = scan(sent) if last and out is None else written(scan(sent))
        out = found if out is None else out.union(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None) -> DataFrame:
    """Rows of ``docs``, unchanged, in which ``find_leaks`` finds no item; null texts stay."""
    place, first = docs.columns.index(text_col), docs

    def without(rows: DataFrame, sent: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(*sent.value)
            for batch in batches:
                yield batch.filter(pa.array([not finder.find(ids) for ids in _each(batch.column(place))], pa.bool_()))

        return rows.mapInArrow(run, rows.schema)

    for sent, last in _blocks(docs, benchmark, text_col, item_col, item_text, answer_col):
        rest = without(docs, sent)
        docs = rest if last and docs is first else written(rest)
    return docs


def _blocks(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text: str, answer_col: str | None) -> Iterator[tuple[Broadcast, bool]]:
    """Latent space and items for the scans: a broadcast for each block of about ``BLOCK_BYTES`` of items, and whether it is the last.

    Rows that repeat an item are one. Of several blocks one is there at a time: a scan must have
    been written before the next is asked for.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t"), (F.col(answer_col) if answer_col else F.lit(None)).cast("string").alias("a")).distinct()
    size = items.agg(F.sum(F.octet_length("t") + F.coalesce(F.octet_length("a"), F.lit(0)))).head()[0]
    space = latent_space(docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))) if size else None
    if space is None:
        return
    n = math.ceil(size / BLOCK_BYTES)
    for k in range(n):
        part = [tuple(r) for r in items.filter(F.pmod(F.xxhash64("i"), F.lit(n)) == k).orderBy("i", "t", "a").collect()]
        sent = docs.sparkSession.sparkContext.broadcast((space, part))
        yield sent, k == n - 1
        if n > 1:
            sent.unpersist()


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
