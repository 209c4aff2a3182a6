"""Language-model scores from probabilistic suffix trees.

Two trees share the work. The tree over words has frequent words, classes of all others by their
endings, and the end of a text as symbols; the tree over letters spells words, last letter first,
given their class. Both grow alike: next-symbol counts of all contexts up to a depth are gathered
from the training texts, and a context is retained when it is frequent enough and its next
symbols diverge from those of its suffix by more than their description costs. Distributions are
smoothed towards the suffix's, and each symbol is scored in the state of the longest suffix of
its past that the tree has.

A word that is no symbol has a probability in its class: its count, discounted, and its spelling
with what the discounts leave. Words of one class and texts of all words so have probabilities
that sum to one at most, which a test counts out.

On these stands a third tree, of contexts of up to ``DEEP`` words, every word a symbol of its own and
every context that was seen a state, without a least share. It grows with the corpus, so it is never
in one place: each position goes, with the words before it, to the bucket of its context's last word
(where that is a symbol of the word tree, of its last words down to the first that is none), and all
states that it can be in are there. A state of n occurrences, k different words after them, mixes these by
their shares with what the shorter context says; the weight of the latter is the chance of a new word, from
the k - 1 of n - 1 occurrences that brought one. Contexts of symbols alone stand in the word tree, and here
when they have all ``DEEP`` words.

Everything counted is counted over all training texts, every word with its own count, however
many there are. Words that are frequent for the corpus go to the tasks, the others meet their
counts and spellings, once each, by a shuffle. What is sent is bounded by the least shares below:
at most 1 / share words or contexts of a depth.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doctree_spark.llm.shared import SPACE, Words, byte_table, table, words_of, written, written_alone

#: Words with this share of all tokens are symbols of the word tree, ...
SYMBOL_SHARE = 2e-3
#: ... with this one, and so many occurrences, go to the tasks, ...
WORD_SHARE = 4e-7
WORD_LEAST = 5
#: ... and contexts need this share of all positions.
CONTEXT_SHARE = 5e-5
#: Least weight of the suffix's distribution in a context's own.
LEAST_WEIGHT = 0.03
WORD_DEPTH, WORD_BITS = 2, 10
LETTER_DEPTH, LETTER_BITS = 6, 9
#: Share of the letters' own frequencies, whatever stands before them, in a spelling.
ANY_LETTERS = 0.05
#: Symbols of the word tree that are no words.
END, START, FIRST_CLASS = 0, 1, 2
CLASSES = 61
FIRST_WORD = FIRST_CLASS + CLASSES
#: The end of a spelling, and what stands before it, by class.
LETTER_END, LETTER_START = 256, 257
#: Bytes of text handled at a time.
SLICE_BYTES = 2 << 20
#: Most words of a context of any words, ...
DEEP = 4
#: ... chance that one of 1, 2, ... words that was seen once goes on with another word, and how many occurrences that counts for.
NEW = (0.98, 0.9, 0.5, 0.15)
NEW_WEIGHT = 2.0
#: Words whose positions go to the buckets together, and positions of a bucket, in the mean.
DEAL_WORDS = 750_000
BUCKET_POSITIONS = 500_000
#: Buckets are dealt in turns, one behind the other, so that not all positions lie on disk at once.
DEEP_TURNS = 3
#: In place of the hash of a word: the end of a text, and what stands before it.
END_HASH, START_HASH = 0, 1
_WORDS = byte_table(SPACE)


def classes_of(w: Words) -> np.ndarray:
    """Classes of words by their last two bytes."""
    last = w.low[w.last].astype(np.int64)
    return np.where(w.last > w.first, w.low[np.maximum(w.last - 1, 0)].astype(np.int64) * 256 + last, last) % CLASSES


def word_counts(rows: DataFrame) -> DataFrame:
    """``h, class, word, n`` of all words in ``held_out, text`` rows; held-out texts add nothing to ``n``."""
    arrow = pa.schema([("h", pa.int64()), ("class", pa.int32()), ("word", pa.binary()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            learnt, at = ~batch.column(0).to_numpy(zero_copy_only=False).astype(bool), 0
            for w in words_of(batch.column(1), _WORDS, SLICE_BYTES):
                texts = len(w.begin) - 1
                if len(w.hashes):
                    h, where, own = np.unique(w.hashes, return_index=True, return_inverse=True)
                    n = np.bincount(own, learnt[at : at + texts][w.text], minlength=len(h)).astype(np.int64)
                    some = Words(h, w.begin, w.low, w.first[where], w.last[where])
                    held = pa.table([pa.array(h.view(np.int64)), pa.array(classes_of(some), pa.int32()), _bytes_of(some), pa.array(n)], schema=arrow)
                    yield from held.to_batches(max_chunksize=50_000)
                at += texts

    return rows.mapInArrow(count, "h long, class int, word binary, n long").groupBy("h", "class", "word").agg(F.sum("n").alias("n"))


def _bytes_of(w: Words) -> pa.Array:
    """The words as an array of bytes."""
    lengths = w.last - w.first + 1
    ends = np.concatenate([[0], np.cumsum(lengths)])
    data = w.low[np.repeat(w.first - ends[:-1], lengths) + np.arange(ends[-1])]
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def _gram_rows(codes: np.ndarray, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Distinct codes and how many there are of each."""
    code, n = np.unique(codes, return_counts=True)
    yield from pa.table([pa.array(code), pa.array(n.astype(np.int64))], schema=arrow).to_batches(max_chunksize=50_000)


_GRAMS = pa.schema([("code", pa.int64()), ("n", pa.int64())])


def _codes(symbols: np.ndarray, depth: int, bits: int) -> np.ndarray:
    """Each symbol with the ``depth`` before it, the latest in the lowest bits; the first ``depth`` are only past."""
    out = symbols[depth:].astype(np.int64)
    for k in range(1, depth + 1):
        out |= symbols[depth - k : len(symbols) - k].astype(np.int64) << (bits * k)
    return out


def _lines(symbols: np.ndarray, begin: np.ndarray, start: np.ndarray | int, end: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences ``begin`` cuts ``symbols`` into, each behind ``depth`` times its ``start`` and before ``end``.

    Returns all of them in one line, and where in it the symbols and the ends stand.
    """
    k, lengths = np.arange(len(begin) - 1), np.diff(begin)
    line = np.repeat(np.broadcast_to(start, len(k)), lengths + depth + 1).astype(np.int64)
    at = np.arange(len(symbols)) + np.repeat(k * (depth + 1) + depth, lengths)
    ends = begin[1:] + k * (depth + 1) + depth
    line[at], line[ends] = symbols, end
    return line, at, ends


def word_grams(blocks: DataFrame, sent) -> DataFrame:
    """``code, n``: word symbols with their past, counted over the texts of ``in_blocks`` that aren't held out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        usual = Usual(sent.value)
        for r in _each(batches):
            block = Block(r, usual)
            line, at, ends = _lines(block.table(usual.symbols, FIRST_CLASS + block.classes)[block.words], block.begin, START, END, WORD_DEPTH)
            codes = _codes(line, WORD_DEPTH, WORD_BITS)
            yield from _gram_rows(codes[np.concatenate([at[block.learnt[block.text]], ends[block.learnt]]) - WORD_DEPTH], _GRAMS)

    return blocks.mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _spelled(words: pa.Array, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all letters and ends of the words, last letter first, and where each word begins among them."""
    _, ends, data = words.buffers()
    begin = np.frombuffer(ends, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    letters = np.frombuffer(data, np.uint8)[begin[0] : begin[-1]] if data is not None else np.zeros(0, np.uint8)
    begin = begin - begin[0]
    backwards = np.repeat(begin[:-1] + begin[1:] - 1, np.diff(begin)) - np.arange(len(letters))
    line, at, ends = _lines(letters[backwards].astype(np.int64), begin, LETTER_START + classes, LETTER_END, LETTER_DEPTH)
    codes = _codes(line, LETTER_DEPTH, LETTER_BITS)
    return codes[np.sort(np.concatenate([at, ends])) - LETTER_DEPTH], begin[:-1] + np.arange(len(words))


def letter_grams(words: DataFrame) -> DataFrame:
    """``code, n``: letters of the words in ``class, word`` rows with their past."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from _gram_rows(_spelled(batch.column(1), batch.column(0).to_numpy())[0], _GRAMS)

    return words.mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def grow_tree(grams: DataFrame, depth: int, bits: int, share: float = CONTEXT_SHARE) -> DataFrame:
    """Retained contexts with their next-symbol counts: ``depth, context, symbol, n``.

    ``grams`` has ``code, n``: a symbol in the lowest ``bits`` and its past above. A context is
    retained when it has at least ``share`` of all positions and n * KL(next symbols of the
    context || of its suffix) is over half its number of next symbols times ln n; so are all
    suffixes of a retained context.
    """
    masks = F.lit([(1 << (bits * d)) - 1 for d in range(depth + 1)])
    cut = grams.select(F.posexplode(masks).alias("depth", "mask"), F.shiftright("code", bits).alias("past"), F.col("code").bitwiseAND(F.lit((1 << bits) - 1)).alias("symbol"), "n")
    by_symbol = written_alone(cut.groupBy("depth", F.col("past").bitwiseAND(F.col("mask")).alias("context"), "symbol").agg(F.sum("n").alias("n")))
    totals = by_symbol.groupBy("depth", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    whole = by_symbol.filter("depth = 0").agg(F.sum("n").alias("whole"))
    frequent = written(totals.join(F.broadcast(whole)).filter(F.col("total") >= F.col("whole") * share).drop("whole"))
    known = by_symbol.join(frequent, ["depth", "context"])
    shorter = known.select((F.col("depth") + 1).alias("depth"), F.col("context").alias("suffix"), "symbol", F.col("n").alias("up_n"), F.col("total").alias("up_total"))
    suffix = F.col("context").bitwiseAND(F.get(masks, F.col("depth") - 1))
    gain = F.sum(F.col("n") * F.log((F.col("n") / F.col("total")) / (F.col("up_n") / F.col("up_total"))))
    tested = known.filter("depth > 0").withColumn("suffix", suffix).join(shorter, ["depth", "suffix", "symbol"]).groupBy("depth", "context").agg(gain.alias("gain"), F.first("total").alias("total"), F.first("kinds").alias("kinds"))
    kept = tested.filter(F.col("gain") > 0.5 * F.col("kinds") * F.log("total")).select("depth", "context")
    up = kept.select(F.explode(F.sequence(F.lit(0), F.col("depth"))).alias("depth"), "context").select("depth", F.col("context").bitwiseAND(F.get(masks, F.col("depth"))).alias("context"))
    states = up.union(frequent.filter("depth = 0").select("depth", "context")).distinct()
    return known.join(states, ["depth", "context"]).select("depth", "context", "symbol", "n")


@dataclass
class Tree:
    """States by depth (sorted contexts and their rows), and log10 probabilities of symbols by state."""

    contexts: list[tuple[np.ndarray, np.ndarray]]
    logs: np.ndarray
    bits: int

    @classmethod
    def of(cls, rows: pa.Table, depth: int, bits: int, symbols: int) -> Tree:
        """From ``grow_tree``'s rows; a state's distribution leans on its suffix's by its number of kinds, and by ``LEAST_WEIGHT`` at least."""
        by_state: dict[tuple[int, int], list] = {}
        for d, context, symbol, n in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            by_state.setdefault((d, context), []).append((symbol, n))
        place = {s: k for k, s in enumerate(sorted(by_state) or [(0, 0)])}
        p = np.empty((len(place), symbols))
        for (d, context), k in place.items():
            above = p[place[(d - 1, context & ((1 << (bits * (d - 1))) - 1))]] if d else np.full(symbols, 1 / symbols)
            n = np.zeros(symbols)
            for symbol, m in by_state.get((d, context), ()):
                n[symbol] += m
            weight = max(LEAST_WEIGHT, np.count_nonzero(n) / max(1, n.sum() + np.count_nonzero(n))) if n.any() else 1.0
            p[k] = (1 - weight) * n / max(1, n.sum()) + weight * above
        contexts = []
        for d in range(depth + 1):
            own = [(c, k) for (e, c), k in place.items() if e == d]
            contexts.append((np.array([c for c, _ in own], np.int64), np.array([k for _, k in own], np.int64)))
        return cls(contexts, np.log10(p).astype(np.float32), bits)

    def states(self, past: np.ndarray) -> np.ndarray:
        """The state of each past: its longest suffix that the tree has."""
        state = np.zeros(len(past), np.int64)
        for d, (context, row) in enumerate(self.contexts):
            if d and len(context):
                own = past & ((1 << (self.bits * d)) - 1)
                at = np.minimum(np.searchsorted(context, own), len(context) - 1)
                state = np.where(context[at] == own, row[at], state)
        return state

    def score(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol in the state of its past."""
        return self.logs[self.states(codes >> self.bits), codes & ((1 << self.bits) - 1)]


@dataclass
class Model:
    """What tasks need of the frequent words, by hash: counts, symbols and log10 probabilities in their classes; and the word tree."""

    hashes: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray
    emissions: np.ndarray
    tokens: int
    kinds: int
    ends: int
    word_tree: Tree | None = None


@dataclass
class Spelling:
    """What spells words: the letter tree, tokens and kinds of words by class (without symbols), and the discount of a count."""

    letter_tree: Tree
    tokens: np.ndarray
    kinds: np.ndarray
    discount: float

    def log_spelled(self, words: pa.Array, classes: np.ndarray) -> np.ndarray:
        """log10 probability of each word's letters, given its class."""
        codes, begin = _spelled(words, classes)
        tree = self.letter_tree
        known = np.add.reduceat(tree.score(codes).astype(float), begin)
        plain = np.add.reduceat(tree.logs[0, codes & ((1 << LETTER_BITS) - 1)].astype(float), begin)
        return np.logaddexp2((known + math.log10(1 - ANY_LETTERS)) * _TWOS, (plain + math.log10(ANY_LETTERS)) * _TWOS) / _TWOS

    def log_in_class(self, words: pa.Array, classes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log10 probability of words, with their counts, among those of their class that are no symbols."""
        spelled, tokens = self.log_spelled(words, classes), self.tokens[classes]
        left = np.where(tokens > 0, self.discount * self.kinds[classes] / np.maximum(tokens, 1), 1.0)
        own = np.where(n > 0, (n - self.discount) / np.maximum(tokens, 1), 0.0)
        with np.errstate(divide="ignore"):
            return np.logaddexp2(np.log2(own), (np.log10(left) + spelled) * _TWOS) / _TWOS


_TWOS = math.log2(10)


def train(rows: DataFrame) -> tuple[Model, Spelling, DataFrame]:
    """Models from the ``held_out, text`` rows that aren't held out, and the table of all words' counts (``word_counts``)."""
    return _train(rows.select(F.lit(0).alias("id"), "held_out", "text"))[:3]


def _train(rows: DataFrame) -> tuple[Model, Spelling, DataFrame, DataFrame]:
    """``train`` of ``id, held_out, text`` rows, and these in blocks (``in_blocks``)."""
    sc = rows.sparkSession.sparkContext
    counts = written_alone(word_counts(rows.select("held_out", "text")))
    ends = rows.filter("NOT held_out").select(F.count("*")).head()[0]
    once, twice, kinds, tokens = counts.agg(F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2), F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).head()
    tokens, kinds = tokens + ends, kinds + (ends > 0)
    own = counts.filter(F.col("n") >= least_count(tokens)).select("h", "class", "n").toArrow()
    h, of, n = (own.column(k).to_numpy() for k in range(3))
    order = np.argsort(h.view(np.uint64))
    h, of, n = h.view(np.uint64)[order], of[order].astype(np.int64), n[order]
    top = np.lexsort((h, -n))[: (1 << WORD_BITS) - FIRST_WORD]
    top = np.sort(top[n[top] >= tokens * SYMBOL_SHARE])
    symbols = FIRST_CLASS + of
    symbols[top] = FIRST_WORD + np.arange(len(top))
    in_class, kinds_in_class = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for k, total, different in counts.filter("n > 0").groupBy("class").agg(F.sum("n"), F.count("*")).collect():
        in_class[k], kinds_in_class[k] = total, different
    in_class -= np.bincount(of[top], n[top], minlength=CLASSES).astype(np.int64)
    kinds_in_class -= np.bincount(of[top], minlength=CLASSES)
    discount = once / (once + 2 * twice) if once and twice else 0.5
    emissions = np.log10((n - discount) / np.maximum(in_class[of], 1))
    emissions[top] = 0.0
    model = Model(h, n, symbols, emissions, tokens, kinds, ends)
    sent = sc.broadcast(model)
    blocks = written(in_blocks(rows, sent))
    word_rows = grow_tree(written_alone(word_grams(blocks.filter("block IS NOT NULL").select(_BLOCK.names), sent)), WORD_DEPTH, WORD_BITS).toArrow()
    rare = counts.filter((F.col("n") > 0) & (F.col("n") < least_count(tokens))).select("class", "word")
    letter_rows = grow_tree(written_alone(letter_grams(rare)), LETTER_DEPTH, LETTER_BITS).toArrow()
    model = replace(model, word_tree=Tree.of(word_rows, WORD_DEPTH, WORD_BITS, FIRST_WORD + len(top)))
    letter_tree = Tree.of(letter_rows, LETTER_DEPTH, LETTER_BITS, LETTER_START)
    return model, Spelling(letter_tree, in_class, kinds_in_class, discount), counts, blocks


def least_count(tokens: int) -> float:
    return max(WORD_LEAST, tokens * WORD_SHARE)


class Scorer:
    """Scores of texts as far as frequent words go."""

    def __init__(self, model: Model) -> None:
        self.model, self.usual = model, Usual(model)
        unit = math.log10(model.tokens + model.kinds + 1)
        self.base = np.log10(self.usual.counts + 1) - unit
        # states of all pasts of the word tree, by their code
        self.states = model.word_tree.states(np.arange(1 << (WORD_BITS * WORD_DEPTH)))

    def of(self, block: Block) -> tuple[np.ndarray, ...]:
        """Tokens, known tokens, base scores and scores of the texts."""
        usual, texts, none = self.usual, len(block.learnt), np.zeros(len(block.others))
        line, at, ends = _lines(block.table(usual.symbols, FIRST_CLASS + block.classes)[block.words], block.begin, START, END, WORD_DEPTH)
        codes = _codes(line, WORD_DEPTH, WORD_BITS)
        logs = self.model.word_tree.logs[self.states[codes >> WORD_BITS], codes & ((1 << WORD_BITS) - 1)].astype(float)
        score = logs[at - WORD_DEPTH] + block.table(usual.emissions, none)[block.words]
        sums = lambda x: np.bincount(block.text, x, minlength=texts)
        known = sums(block.words < len(usual.hashes)).astype(np.int64) + (self.model.ends > 0)
        return np.diff(block.begin) + 1, known, sums(block.table(self.base, none)[block.words]) + self.base[0], sums(score) + logs[ends - WORD_DEPTH]


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _joined(x: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of sequences ``x`` with one more word each."""
    x = (x ^ (x >> np.uint64(29))) * _MIX + word
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _key_depth(alone: list[np.ndarray]) -> np.ndarray:
    """How many of the last words name a position's bucket: up to the first that is ``alone`` enough (no symbol), or all."""
    depth = np.full(len(alone[0]), len(alone))
    for d in range(len(alone), 0, -1):
        depth[alone[d - 1]] = d
    return depth


class Usual:
    """Frequent words, most frequent first, behind the two symbols that are no words: so numbers of most are small."""

    def __init__(self, model: Model) -> None:
        order = np.argsort(-model.counts, kind="stable")
        behind = lambda end, start, x: np.concatenate([np.array([end, start], x.dtype), x[order]])
        self.hashes, self.symbols = behind(END_HASH, START_HASH, model.hashes), behind(END, START, model.symbols)
        self.emissions, self.counts = behind(0, 0, model.emissions), behind(model.ends, 0, model.counts)
        self.alone = (self.symbols >= FIRST_CLASS) & (self.symbols < FIRST_WORD)


_BLOCK = pa.schema([("block", pa.int64()), ("held", pa.binary()), ("sizes", pa.binary()), ("codes", pa.binary()), ("hashes", pa.binary()), ("classes", pa.binary())])
_DEALT = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("texts", pa.int32()), ("n", pa.int32()), ("hashes", pa.binary()), ("classes", pa.binary()), ("ids", pa.binary()), ("of", pa.binary()), ("learnt", pa.binary())])
_TOLD = pa.schema([("block", pa.int64()), ("sums", pa.binary()), ("row", pa.int64()), ("h", pa.int64()), ("a", pa.float32()), ("b", pa.float32())])
_TOLD_SQL = "block long, sums binary, row long, h long, a float, b float"
_GAINS = pa.schema([("row", pa.int64()), ("gain", pa.float64())])
_SCORED = pa.schema([("row", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("h", pa.int64())])
#: A text's number is its block's and, in so many bits, its place there; a block's is its task's and its place there.
TEXT_BITS, BLOCK_BITS = 22, 24
#: Buckets of a task in the mean, and texts whose sums it holds at a time.
TASK_BUCKETS = 2
HELD_TEXTS = 1 << 20


def _packed(x: np.ndarray) -> bytes:
    """Numbers below 2^32, bytes of equal place side by side."""
    return pa.compress(x.astype(np.uint32).reshape(-1, 1).view(np.uint8).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd"), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel()


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows, one at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, tuple[np.ndarray, ...]]]:
    """Ids of texts, and their flags, sizes, words and the words' classes, of so many texts as have ``DEAL_WORDS`` with their ends."""
    ids, parts, n = [], [], 0
    for batch in batches:
        held, done = batch.column(1).to_numpy(zero_copy_only=False).astype(bool), 0
        for w in words_of(batch.column(2), _WORDS, SLICE_BYTES):
            to = done + len(w.begin) - 1
            ids.append(batch.column(0).slice(done, to - done))
            parts.append((held[done:to], np.diff(w.begin), w.hashes, classes_of(w).astype(np.uint8)))
            n += to - done + len(w.hashes)
            done = to
            if n >= DEAL_WORDS:
                yield pa.concat_arrays(ids), tuple(np.concatenate(c) for c in zip(*parts, strict=True))
                ids, parts, n = [], [], 0
    if parts:
        yield pa.concat_arrays(ids), tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def in_blocks(rows: DataFrame, sent) -> DataFrame:
    """Texts of ``id, held_out, text`` rows, many in a row: their flags (``held``), ``sizes`` in words, and the words' ``codes``.

    A code is twice a place among frequent words, or twice and one a place among ``hashes`` and ``classes`` of others.
    Besides these rows one for each text: its id, flag and number (``row``).
    """
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema[:2]]).add("row", "long").add("block", "long")
    for name in _BLOCK.names[1:]:
        schema = schema.add(name, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked = Usual(sent.value).hashes
        order = np.argsort(ranked)
        in_order, task = ranked[order], TaskContext.get().partitionId()
        for k, (ids, (held, sizes, every, kinds)) in enumerate(_gathered(batches)):
            u, own = np.unique(every, return_inverse=True)
            classes = np.zeros(len(u), np.uint8)
            classes[own] = kinds
            found = np.minimum(np.searchsorted(in_order, u), len(in_order) - 1)
            rare = in_order[found] != u
            code = 2 * order[found]
            code[rare] = 2 * np.arange(np.count_nonzero(rare)) + 1
            block = task << BLOCK_BITS | k
            columns = block, held.tobytes(), _packed(sizes), _packed(code[own]), u[rare].tobytes(), classes[rare].tobytes()
            texts = [ids, pa.array(held), pa.array(block << TEXT_BITS | np.arange(len(held))), *(pa.nulls(len(held), f.type) for f in _BLOCK)]
            yield pa.RecordBatch.from_arrays(texts, names=schema.fieldNames())
            one = [pa.nulls(1, ids.type), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.int64()), *(pa.array([c], f.type) for c, f in zip(columns, _BLOCK, strict=True))]
            yield pa.RecordBatch.from_arrays(one, names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


class Block:
    """A row of ``in_blocks``: its texts' words by number, frequent ones by their places in ``Usual``, others behind these."""

    def __init__(self, r: dict, usual: Usual) -> None:
        self.number, self.learnt = r["block"], np.frombuffer(r["held"], np.uint8) == 0
        sizes = _unpacked(r["sizes"], len(self.learnt)).astype(np.int64)
        self.begin = np.concatenate([[0], np.cumsum(sizes)])
        self.others, self.classes = np.frombuffer(r["hashes"], np.uint64), np.frombuffer(r["classes"], np.uint8).astype(np.int64)
        code = _unpacked(r["codes"], self.begin[-1])
        self.words = np.where(code & 1, len(usual.hashes) + (code >> 1), code >> 1).astype(np.int32)

    @property
    def text(self) -> np.ndarray:
        """Number of each word's text."""
        return np.repeat(np.arange(len(self.learnt)), np.diff(self.begin))

    def table(self, usual: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Values by the words' numbers."""
        return np.concatenate([usual, others])


def _deal(blocks: DataFrame, sent, buckets: int, depth: int, turn: int) -> DataFrame:
    """Positions of all texts of ``in_blocks``, each with the ``depth`` words before it, packed by bucket.

    Only buckets of one ``turn`` of ``DEEP_TURNS``. A row has ``n`` positions of a block of ``texts``, in their order:
    ``ids``, codes of the word and those before it, latest first, by ``hashes`` and ``classes`` of the row; ``of``, the
    steps from text to text; and a bit for those ``learnt``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        usual = Usual(sent.value)
        frequent = len(usual.hashes)
        for r in _each(batches):
            block = Block(r, usual)
            others = len(block.others)
            hashes, alone = block.table(usual.hashes, block.others), block.table(usual.alone, np.ones(others, bool))
            x = _joined(np.zeros(len(hashes), np.uint64), hashes)
            by_word = np.where(alone, (x % np.uint64(buckets)).astype(np.int64), -1)
            # the first two of the frequent words are the end and what stands before a text
            line, at, ends = _lines(block.words, block.begin, 1, 0, depth)
            line, here = line.astype(np.int32), np.zeros(len(line), bool)
            here[at], here[ends] = True, True
            # what stands first in its text has no word before it
            here[block.begin[:-1] + np.arange(len(block.learnt)) * (depth + 1) + depth] = False
            place, text = np.flatnonzero(here), block.text
            bucket = by_word[line[place - 1]]
            rest = np.flatnonzero(bucket < 0)
            named = x[line[place[rest] - 1]]
            for d in range(2, depth + 1):
                word = line[place[rest] - d]
                named = _joined(named, hashes[word])
                last = alone[word] | (d == depth)
                bucket[rest[last]] = (named[last] % np.uint64(buckets)).astype(np.int64)
                rest, named = rest[~last], named[~last]
            mine = np.flatnonzero(bucket % DEEP_TURNS == turn)
            if not len(mine):
                continue
            mine = mine[np.argsort(bucket[mine].astype(np.uint16 if buckets <= 1 << 16 else np.uint32), kind="stable")]
            bucket, place, text = bucket[mine], place[mine], text[mine]
            first = np.flatnonzero(np.diff(bucket, prepend=-1))
            edges = np.append(first, len(bucket))
            word = np.concatenate([line[place - k] for k in range(depth + 1)])
            # others have their place among those of their row
            rare, code = np.flatnonzero(word >= frequent), 2 * word
            in_row = np.repeat(np.arange(len(first)), np.diff(edges))[rare % len(place)]
            pairs, number = np.unique(in_row * others + (word[rare] - frequent), return_inverse=True)
            begins = np.searchsorted(pairs, np.arange(len(first) + 1) * others)
            code[rare] = 2 * (number - begins[in_row]) + 1
            code, own = code.reshape(depth + 1, -1), pairs % max(1, others)
            classes, learnt, packed = block.classes.astype(np.uint8), block.learnt[text], []
            for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                some = own[begins[k] : begins[k + 1]]
                packed.append((bucket[a], block.number, len(block.learnt), b - a, block.others[some].tobytes(), classes[some].tobytes(), _packed(code[:, a:b].ravel()), _packed(np.diff(text[a:b], prepend=0)), np.packbits(learnt[a:b]).tobytes()))
            yield from pa.table([pa.array(c, f.type) for c, f in zip(zip(*packed, strict=True), _DEALT, strict=True)], schema=_DEALT).to_batches(max_chunksize=64)

    return blocks.mapInArrow(run, "bucket int, block long, texts int, n int, hashes binary, classes binary, ids binary, of binary, learnt binary")


def _begins(x: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    out = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


class Deep:
    """A bucket of positions: what the contexts in it say of the word that follows."""

    def __init__(self, words: np.ndarray, alone: np.ndarray, learnt: np.ndarray) -> None:
        """``words``: in rows, the words (hashes, or numbers in 32 bits) and those before them, latest first; ``alone``: which of the latter are no symbols."""
        if words.dtype.itemsize > 4:
            words = np.unique(words, return_inverse=True)[1].reshape(words.shape).astype(np.int32)
        self.words, self.learnt = words, learnt
        self.first = _key_depth(list(alone))

    def mixed(self) -> tuple[np.ndarray, np.ndarray]:
        """``a, b`` of each position: its word has the probability a + b * p, with p that of the two other trees."""
        count = self.words.shape[1]
        a, b, met = np.zeros(count), np.ones(count), np.ones(count, bool)
        # positions whose context is met elsewhere, and the numbers of these contexts
        at, group = np.arange(count), np.zeros(count, np.int64)
        bits = int(self.words.max(initial=1)).bit_length()
        for d, new in zip(range(1, len(self.words)), NEW, strict=True):
            here = self.first <= d
            # contexts that are met nowhere else, nor are longer ones: seen once, if learnt, and with this word
            lone = here & ~met & self.learnt
            a[lone], b[lone] = 1 - new + new * a[lone], new * b[lone]
            if not len(at):
                continue
            context = group << bits | self.words[d, at]
            if int(context.max()).bit_length() + bits > 63:
                context = np.unique(context, return_inverse=True)[1]
            key = context << bits | self.words[0, at]
            order = np.argsort(key)
            key, at = key[order], at[order]
            new_pair, new_context = _begins(key), _begins(key >> bits)
            pair, own = np.cumsum(new_pair) - 1, np.cumsum(new_context) - 1
            pairs, contexts = np.flatnonzero(new_pair), np.flatnonzero(new_context)
            learnt = np.concatenate([[0], np.cumsum(self.learnt[at])])
            both, n = (np.diff(learnt[np.append(begins, len(at))]) for begins in (pairs, contexts))
            kinds = np.bincount(own[pairs], both > 0, minlength=len(contexts))
            left = np.where((n > 0) & here[at[contexts]], (kinds - 1 + NEW_WEIGHT * new) / (np.maximum(n, 1) - 1 + NEW_WEIGHT), 1.0)
            says = ((1 - left) / np.maximum(n, 1))[own[pairs]] * both
            left = left[own]
            a[at] = says[pair] + left * a[at]
            b[at] *= left
            again = (np.diff(contexts, append=len(at)) > 1)[own]
            met[at[~again]] = False
            at, group = at[again], own[again]
        return a, b


class _Mixer:
    """Scores buckets of positions of ``_deal``, and adds up what is said of each text."""

    def __init__(self, model: Model, depth: int) -> None:
        self.model, self.depth, self.usual = model, depth, Usual(model)
        self.states = model.word_tree.states(np.arange(1 << (WORD_BITS * WORD_DEPTH)))
        # sums of texts, by block
        self.sums: dict[int, np.ndarray] = {}

    def of(self, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        """Rows of the positions of one bucket whose words aren't frequent; gains of all others go to the sums."""
        sizes = np.array([r["n"] for r in rows])
        code = np.concatenate([_unpacked(r["ids"], r["n"] * (self.depth + 1)).reshape(-1, r["n"]) for r in rows], axis=1)
        text = np.concatenate([np.cumsum(_unpacked(r["of"], r["n"]), dtype=np.int64) for r in rows])
        learnt = np.concatenate([np.unpackbits(np.frombuffer(r["learnt"], np.uint8), count=r["n"]) for r in rows]).astype(bool)
        hashes = [np.frombuffer(r["hashes"], np.uint64) for r in rows]
        others, number = np.unique(np.concatenate(hashes), return_inverse=True)
        classes, count = np.zeros(len(others), np.int64), len(text)
        classes[number] = np.frombuffer(b"".join(r["classes"] for r in rows), np.uint8)
        ids = (code >> 1).astype(np.int32).ravel()
        odd = np.flatnonzero(code.ravel() & 1)
        before = np.repeat(np.cumsum([0, *map(len, hashes[:-1])]), sizes)
        frequent = len(self.usual.hashes)
        ids[odd] = frequent + number[before[odd % count] + ids[odd]]
        ids = ids.reshape(code.shape)
        with_others = lambda of_usual, x: np.concatenate([of_usual, x])
        symbols = with_others(self.usual.symbols, FIRST_CLASS + classes)
        past = np.zeros(count, np.int64)
        for d in range(WORD_DEPTH, 0, -1):
            past = past << WORD_BITS | symbols[ids[d]]
        logs = self.model.word_tree.logs[self.states[past], symbols[ids[0]]] + with_others(self.usual.emissions, np.zeros(len(others)))[ids[0]]
        a, b = Deep(ids, with_others(self.usual.alone, np.ones(len(others), bool))[ids[1:]], learnt).mixed()
        a *= 10.0**-logs
        gain = np.where(ids[0] < frequent, np.log10(a + b), 0.0)
        texts = np.array([r["texts"] for r in rows])
        sums = np.bincount(np.repeat(np.cumsum(texts) - texts, sizes) + text, gain, minlength=texts.sum())
        for r, part in zip(rows, np.split(sums, np.cumsum(texts)[:-1]), strict=True):
            self.sums[r["block"]] = self.sums.get(r["block"], 0) + part
        rare = np.flatnonzero(ids[0] >= frequent)
        block = np.repeat(np.array([r["block"] for r in rows]), sizes)[rare]
        yield from _batches(_TOLD, None, None, block << TEXT_BITS | text[rare], others[ids[0, rare] - frequent].view(np.int64), a[rare].astype(np.float32), b[rare].astype(np.float32))

    def told(self) -> Iterator[pa.RecordBatch]:
        """The sums so far, a row for each block; they begin anew."""
        for block, sums in self.sums.items():
            columns = block, sums.tobytes(), None, None, None, None
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(columns, _TOLD, strict=True)], schema=_TOLD)
        self.sums = {}


def deep_gains(blocks: DataFrame, model: Model, depth: int) -> tuple[DataFrame, DataFrame]:
    """What contexts of up to ``depth`` words add to the score of texts ``in_blocks``.

    ``row, gain`` for the words that are frequent; ``row, h, a, b`` for each of the others, first words of texts aside: with p, its
    probability in its class, log10(a + b * p) takes the place of log10(p).
    """
    spark = blocks.sparkSession
    sent = spark.sparkContext.broadcast(model)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at_once = max(least, math.ceil(model.tokens / BUCKET_POSITIONS / DEEP_TURNS))
    tasks = max(least, math.ceil(at_once / TASK_BUCKETS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, held = _Mixer(sent.value, depth), []
        for r in _each(batches):
            if held and held[0]["bucket"] != r["bucket"]:
                yield from mixer.of(held)
                held = []
                if sum(map(len, mixer.sums.values())) > HELD_TEXTS:
                    yield from mixer.told()
            held.append(r)
        if held:
            yield from mixer.of(held)
        yield from mixer.told()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sums = None, None
        for r in _each(batches):
            own = np.frombuffer(r["sums"], float).copy()
            if r["block"] == block:
                sums += own
                continue
            if block is not None:
                yield from _batches(_GAINS, block << TEXT_BITS | np.arange(len(sums)), sums)
            block, sums = r["block"], own
        if block is not None:
            yield from _batches(_GAINS, block << TEXT_BITS | np.arange(len(sums)), sums)

    told = None
    for turn in range(DEEP_TURNS):
        dealt = _deal(blocks, sent, at_once * DEEP_TURNS, depth, turn).repartition(tasks, "bucket").sortWithinPartitions("bucket")
        part = written_alone(dealt.mapInArrow(run, _TOLD_SQL))
        told = part if told is None else told.union(part)
    sums = told.filter("sums IS NOT NULL").select("block", "sums").repartition(least, "block").sortWithinPartitions("block")
    return sums.mapInArrow(added, "row long, gain double"), told.filter("h IS NOT NULL").select("row", "h", "a", "b")


def _batches(schema: pa.Schema, *columns: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    n = max(len(c) for c in columns if c is not None)
    yield from pa.table([pa.nulls(n, f.type) if c is None else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema).to_batches(max_chunksize=50_000)


def score(docs: DataFrame, held_out: str, id_col: str = "doc_id", text_col: str = "text", depth: int = 0) -> DataFrame:
    """Scores of all texts by a model of those that aren't held out.

    Args:
        docs: rows with an id, a text and a boolean column ``held_out``.
        depth: most words of contexts of any words, 0 (only contexts of the word tree's symbols count) or ``DEEP``.

    Returns:
        ``id_col, held_out boolean, n_tokens, n_known, train_tokens long, base_score, score
        double``, one row per row of ``docs``. A text is its words and one end. ``n_known``
        counts tokens seen in training; ``base_score`` is the log10 probability by single words
        with one added to every count, ``score`` that of the suffix trees. A null text counts as
        empty. Ids may repeat or be null. Without training rows the trees are uniform.
    """
    rows = docs.select(F.col(id_col), F.col(held_out).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    model, spelling, counts, table = _train(rows)
    blocks = table.filter("block IS NOT NULL").select(_BLOCK.names)
    sc = docs.sparkSession.sparkContext
    sent, spell = sc.broadcast(model), sc.broadcast(spelling)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for r in _each(batches):
            block = Block(r, scorer.usual)
            row, frequent = block.number << TEXT_BITS | np.arange(len(block.learnt)), len(scorer.usual.hashes)
            yield from _batches(_SCORED, row, *scorer.of(block), None)
            # the other words, of which contexts of any words tell all but a text's first
            rare = block.words >= frequent
            if depth:
                later = np.ones(len(rare), bool)
                later[block.begin[:-1][np.diff(block.begin) > 0]] = False
                rare &= ~later
            yield from _batches(_SCORED, row[block.text[rare]], None, None, None, None, block.others[block.words[rare] - frequent].view(np.int64))

    def log_in_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                logs = spell.value.log_in_class(batch.column(2), batch.column(1).to_numpy(), batch.column(3).to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(logs)], names=["h", "n", "log"])

    scored = written(blocks.mapInArrow(run, "row long, n_tokens long, n_known long, base_score double, score double, h long"))
    # the other words meet their counts and spellings by a shuffle; the frequent ones, most tokens, were scored in place
    rare = scored.filter("h IS NOT NULL").select("row", "h", F.lit(0.0).cast("float").alias("a"), F.lit(1.0).cast("float").alias("b"))
    out = table.filter("row IS NOT NULL").select(id_col, "held_out", "row").join(scored.filter("h IS NULL").drop("h"), "row")
    if depth:
        gains, more = deep_gains(blocks, model, depth)
        rare, out = rare.union(more), out.join(gains, "row", "left")
    else:
        out = out.withColumn("gain", F.lit(0.0))
    known = counts.filter(F.col("n") < least_count(model.tokens)).mapInArrow(log_in_class, "h long, n long, log double")
    unit = math.log10(model.tokens + model.kinds + 1)
    # however long a word is, its own probability may come to nothing here
    adds = F.when(F.col("a") > 0, F.log10(F.col("a") + F.col("b") * F.pow(F.lit(10.0), F.col("log")))).otherwise(F.col("log") + F.log10("b"))
    told = rare.join(known.hint("shuffle_hash"), "h").groupBy("row").agg(F.count_if(F.col("n") > 0).alias("__known"), F.sum(F.log10(F.col("n") + 1) - unit).alias("__base"), F.sum(adds).alias("__score"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.join(told, "row", "left").select(
        id_col, "held_out", "n_tokens", (F.col("n_known") + zero("__known")).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + zero("__base")).alias("base_score"), (F.col("score") + zero("gain") + zero("__score")).alias("score"),
    )


def op9_suffix_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    return score(docs.withColumn("held_out", held), "held_out", depth=DEEP)
