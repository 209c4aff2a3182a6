"""Byte-pair encoding as a transducer with bounded lookahead, and decoding as a byte machine.

A token is stable once so many bytes behind it are known that no merge can reach back over
them. How many that takes follows from the merge list (``lookahead``): text that is added
behind a place can undo a merge across it; the place then moves left by the merge's left part,
and only a merge of a later rank, whose right part begins with that left part, can move it
again. The longest such chain, in bytes, is enough for every text. ``Stream`` takes bytes in
pieces of any size, holds no more than a window of them, and emits tokens as they become stable.

Texts are read in chunks. A chunk's pieces (as the vocabulary's splitter makes them) are final
unless they end within its last characters; a piece longer than a chunk goes through one
stream. Tokens of short pieces are kept in a dictionary that is emptied when it is full, so
what a task holds beside its rows doesn't grow with the text or the corpus.
"""

from __future__ import annotations

import codecs
import functools
import heapq
import json
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doctree_spark.llm.shared import table
from doctree_spark.llm.token_counts import _SPACE as _WHITE
from doctree_spark.llm.token_counts import MAX_VOCABULARY_BYTES, _byte_letters

#: Characters of a text that are split at a time, and at its end how many may still change a piece.
CHUNK = 1 << 16
UNSURE = 3
#: Pieces whose tokens are kept, and the longest kept, in bytes.
CACHE_PIECES = 300_000
CACHE_BYTES = 64
#: Windows up to this many bytes look for the lowest pair in a list, longer ones in a heap.
SHORT = 64
#: Ids decoded at a time.
DECODE_IDS = 1 << 18
#: Ids handed on at a time, at least those of one text.
GIVEN_IDS = 1 << 19
#: A pair of ids, and a rank with an id, are one number each.
BITS = 20
_IDS = (1 << BITS) - 1
_NONE = 1 << 62
_SPACE = _WHITE[1:-1]


def lookahead(merges: list[tuple[int, int, int]]) -> list[int]:
    """For merges ``(left, right, merged)`` by rank, how far in bytes each can move a place left, chains included; the largest is enough for any text.

    Every part must be a byte or the result of an earlier merge.
    """
    size: dict[int, int] = {}
    begins: dict[int, int] = {}
    furthest: dict[int, int] = {}
    reach = []
    for left, right, merged in merges:
        size[merged] = size.get(left, 1) + size.get(right, 1)
        head, before = right, furthest.get(right, 0)
        while head in begins:
            head = begins[head]
            before = max(before, furthest.get(head, 0))
        reach.append(size.get(left, 1) + before)
        furthest[left] = max(furthest.get(left, 0), reach[-1])
        begins.setdefault(merged, left)
    return reach


#: Characters for which the ``re`` module's classes of letters and decimals are not all: other numbers, and what later Unicode may have.
_UNSETTLED = re.compile("[\u00b2\u00b3\u00b9\u00bc-\u00be\u09f4-\u1fff\u2070-\U0010ffff]")


def _splitter(module, letter: str, number: str, other: str, space: str) -> tuple:
    """The byte-level vocabularies' splitter (contractions, words, numbers, other signs, white space), and its four kinds of runs."""
    # words begin no contraction, so they may come first, being most of all pieces
    whole = rf" ?{letter}+|'s|'t|'re|'ve|'m|'ll|'d| ?{number}+| ?{other}+|[{space}]+(?![^{space}])|[{space}]+"
    return module.compile(whole), [module.compile(f"{kind}*") for kind in (letter, number, other, f"[{space}]")]


@functools.cache
def _splitters() -> tuple[tuple, tuple]:
    """A quick splitter for texts without unsettled characters, and one for all."""
    quick = _splitter(re, r"[^\W\d_]", r"\d", rf"(?:[^\w{_SPACE}]|_)", _SPACE)
    return quick, _splitter(regex, r"\p{L}", r"\p{N}", rf"[^{_SPACE}\p{{L}}\p{{N}}]", _SPACE)


class Vocabulary:
    """Merges, bytes and special strings of a byte-level vocabulary file.

    Raises ValueError where the file is of another kind, or a merge has parts that no earlier
    merge makes, for which the lookahead would not hold.
    """

    def __init__(self, content: bytes) -> None:
        spec = json.loads(content)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if model["type"] != "BPE" or not plain or spec["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError("a plain byte-level byte-pair vocabulary is needed")
        ids, letters = model["vocab"], _byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.of_byte = [ids[c] for c in letters]
        merges, made = [], set(self.of_byte)
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            merges.append((ids[a], ids[b], ids[a + b]))
            if not {ids[a], ids[b]} <= made:
                raise ValueError(f"{a} {b} merges what no earlier merge makes")
            made.add(ids[a + b])
        self.pairs = {}
        for rank, (a, b, ab) in enumerate(merges):
            self.pairs.setdefault(a << BITS | b, rank << BITS | ab)
        texts = {i: t for t, i in ids.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        if max(texts) > _IDS:
            raise ValueError(f"ids above {_IDS} are not supported")
        self.bytes_of = [b""] * (max(texts) + 1)
        for i, t in texts.items():
            self.bytes_of[i] = bytes(map(byte_of.__getitem__, t)) if all(c in byte_of for c in t) else t.encode()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.lookahead = max(lookahead(merges), default=0)
        self.longest = max(map(len, self.bytes_of))


class Stream:
    """Tokens of one piece, whose bytes come in parts: ``push`` emits what is stable, ``finish`` the rest."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.held = vocabulary, b""
        self.window = vocabulary.lookahead + max(vocabulary.longest, 1024)

    def push(self, data: bytes) -> Iterator[list[int]]:
        at, size, parts = 0, self.window, self.vocabulary.bytes_of
        data = self.held + data
        while len(data) - at > size:
            # the first token ends before the lookahead begins, so every turn emits some
            out, left = [], size - self.vocabulary.lookahead
            for token in merged(self.vocabulary, data[at : at + size]):
                left -= len(parts[token])
                if left < 0:
                    break
                out.append(token)
                at += len(parts[token])
            yield out
        self.held = data[at:]

    def finish(self) -> list[int]:
        out, self.held = merged(self.vocabulary, self.held), b""
        return out


def merged(vocabulary: Vocabulary, data: bytes) -> list[int]:
    """Tokens of a piece that is whole: the pair of lowest rank merges, the leftmost first, until none is left."""
    symbols = [vocabulary.of_byte[b] for b in data]
    get = vocabulary.pairs.get
    if len(symbols) > SHORT:
        return _merged_by_heap(symbols, get)
    found = [get(a << BITS | b, _NONE) for a, b in zip(symbols, symbols[1:], strict=False)]
    while found:
        best = min(found)
        if best == _NONE:
            break
        i = found.index(best)
        symbols[i] = ab = best & _IDS
        del symbols[i + 1], found[i]
        if i:
            found[i - 1] = get(symbols[i - 1] << BITS | ab, _NONE)
        if i < len(found):
            found[i] = get(ab << BITS | symbols[i + 1], _NONE)
    return symbols


def _merged_by_heap(symbols: list[int], get) -> list[int]:
    n = len(symbols)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(f, i) for i in range(n - 1) if (f := get(symbols[i] << BITS | symbols[i + 1]))]
    heapq.heapify(heap)
    while heap:
        f, i = heapq.heappop(heap)
        j, ab = right[i], f & _IDS
        if symbols[i] < 0 or j >= n or get(symbols[i] << BITS | symbols[j]) != f:
            continue  # one of the two has merged since
        symbols[i], symbols[j] = ab, -1
        right[i] = right[j]
        for a, b in ((left[i], i), (i, right[i])):
            if a >= 0 and b < n and (f := get(symbols[a] << BITS | symbols[b])):
                heapq.heappush(heap, (f, a))
        if right[i] < n:
            left[right[i]] = i
    return [s for s in symbols if s >= 0]


class Encoder(dict):
    """Ids of texts, in parts; as a dictionary, the ids of pieces as 32-bit numbers."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.special = re.compile("|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode()
        if len(data) > CACHE_BYTES:
            stream = Stream(self.vocabulary)
            return b"".join(_packed(out) for out in (*stream.push(data), stream.finish()))
        if len(self) >= CACHE_PIECES:
            self.clear()
        out = self[piece] = _packed(merged(self.vocabulary, data))
        return out

    def parts(self, text: str) -> Iterator[bytes]:
        """The ids of a text as 32-bit numbers, part by part; special strings in it are their tokens."""
        self.split, self.kinds = _splitters()[1 if _UNSETTLED.search(text) else 0]
        at = 0
        for found in self.special.finditer(text) if self.special else ():
            yield from self._plain(text, at, found.start())
            yield _packed([self.vocabulary.special[found.group()]])
            at = found.end()
        yield from self._plain(text, at, len(text))

    def _plain(self, text: str, at: int, end: int) -> Iterator[bytes]:
        while at < end:
            to = min(at + CHUNK, end)
            pieces = self.split.findall(text[at:to])
            known = to - at
            while to < end and pieces and known > to - at - UNSURE:
                known -= len(pieces.pop())
            if pieces:
                yield b"".join(map(self.__getitem__, pieces))
                at += known
            else:
                at = yield from self._endless(text, at, end)

    def _endless(self, text: str, at: int, end: int) -> Iterator[bytes]:
        """The piece at ``at``, which a chunk doesn't hold, through a stream; returns where it ends."""
        stream = Stream(self.vocabulary)
        head = self.split.match(text, at, min(at + CHUNK, end)).end() - UNSURE
        kind = next(k for k in self.kinds if k.fullmatch(text, head - 1, head))
        while True:
            last, head = head, kind.match(text, head, min(head + CHUNK, end)).end()
            # of white space before something else, the last character is a piece of its own or the next one's first
            stop = head - 1 if kind is self.kinds[-1] and head < end else head
            if head < end and head == last + CHUNK:
                stop = head - 1
                yield from map(_packed, stream.push(text[at:stop].encode()))
                at = stop
                continue
            yield from map(_packed, stream.push(text[at:stop].encode()))
            yield _packed(stream.finish())
            return stop


def _packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


class Decoder:
    """Texts of ids: bytes of tokens, through a machine that knows what a cut character lacks.

    Bytes that are no UTF-8 become U+FFFD, one for each longest beginning of a character; ids
    that the vocabulary doesn't have are left out.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.known = len(vocabulary.bytes_of)
        self.bytes_of = dict(enumerate(vocabulary.bytes_of))

    def parts(self, ids: np.ndarray) -> Iterator[str]:
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for at in range(0, len(ids), DECODE_IDS):
            some = ids[at : at + DECODE_IDS]
            if len(some) and (some.min() < 0 or some.max() >= self.known):
                some = some[(some >= 0) & (some < self.known)]
            yield machine.decode(b"".join(map(self.bytes_of.__getitem__, some.tolist())))
        yield machine.decode(b"", True)


@functools.lru_cache(maxsize=1)
def _known(content: bytes) -> Vocabulary:
    return Vocabulary(content)


@functools.lru_cache(maxsize=1)
def _encoder(content: bytes) -> Encoder:
    """One a worker: what it has learned serves its later tasks as well."""
    return Encoder(_known(content))


def _sent(df: DataFrame, vocabulary: str):
    with open(vocabulary, "rb") as f:
        content = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(content) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return df.sparkSession.sparkContext.broadcast(content)


def _passed(df: DataFrame, out: list[T.StructField], needs: str, columns: Callable[[pa.Array], Iterator[tuple]], keep: list[str] | None) -> DataFrame:
    """``df`` (its columns ``keep``, None: all) with ``out`` added; ``columns`` takes the values of ``needs`` and gives the new arrays for some rows at a time."""
    names = [f.name for f in out]
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    schema = T.StructType([*(df.schema[c] for c in kept), *out])
    sent = df.select(*kept, F.col(needs).alias("__needs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for new in columns(batch.column(len(kept))):
                n = len(new[0])
                yield pa.RecordBatch.from_arrays([*(c.slice(at, n) for c in batch.columns[: len(kept)]), *new], names=schema.fieldNames())
                at += n

    return sent.mapInArrow(run, schema)


def _lists(parts: list[bytes], ends: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text", out_col: str = "ids", decoded_col: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Adds ``out_col array<int>``, the token ids of every whole text, and with ``decoded_col`` the text that these ids decode to.

    Args:
        docs: any table with ``text_col``; columns named like new ones are replaced, others stay.
        keep: the columns to keep; what isn't needed needn't travel.
        vocabulary: path of the vocabulary file, read by the driver and broadcast
            (refused above ``MAX_VOCABULARY_BYTES``).

    A null text counts as empty: no ids. Special strings in a text are their tokens. Rows may
    repeat; an empty table gives an empty one. Rows are handed on some ``GIVEN_IDS`` ids at a time.
    """
    sent = _sent(docs, vocabulary)

    def ids(texts: pa.Array) -> Iterator[tuple]:
        encoder = _encoder(sent.value)
        decoder = Decoder(encoder.vocabulary)
        parts, ends, decoded = [], [0], []
        for text in texts:
            own = b"".join(encoder.parts(text.as_py() or ""))
            parts.append(own)
            ends.append(ends[-1] + len(own) // 4)
            if decoded_col:
                decoded.append("".join(decoder.parts(np.frombuffer(own, np.int32))))
            if ends[-1] >= GIVEN_IDS:
                yield (_lists(parts, ends), pa.array(decoded, pa.string())) if decoded_col else (_lists(parts, ends),)
                parts, ends, decoded = [], [0], []
        if len(ends) > 1:
            yield (_lists(parts, ends), pa.array(decoded, pa.string())) if decoded_col else (_lists(parts, ends),)

    fields = [T.StructField(out_col, T.ArrayType(T.IntegerType())), *([T.StructField(decoded_col, T.StringType())] if decoded_col else [])]
    return _passed(docs, fields, text_col, ids, keep)


def decode(df: DataFrame, vocabulary: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds ``out_col string``, the text of each row's ids; null ids give null, none an empty text.

    Other columns stay; a column named ``out_col`` is replaced. Null and unknown ids are left out.
    """
    sent = _sent(df, vocabulary)

    def texts(lists: pa.Array) -> Iterator[tuple]:
        decoder, out, given = Decoder(_known(sent.value)), [], 0
        for x in lists:
            out.append("".join(decoder.parts(x.values.drop_null().to_numpy(zero_copy_only=False))) if x.is_valid else None)
            given += len(x.values) if x.is_valid else 0
            if given >= GIVEN_IDS:
                yield (pa.array(out, pa.string()),)
                out, given = [], 0
        if out:
            yield (pa.array(out, pa.string()),)

    return _passed(df, [T.StructField(out_col, T.StringType())], ids_col, texts, None)


def op12_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    both = encode(table(spark, sf_dir, "documents"), vocabulary, decoded_col="decoded", keep=["doc_id"])
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
