"""What the operators of this package share: tables, cut lineage, words and their hashes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doctree_spark.sources.lineage import shared_dir, written, written_alone

__all__ = ["SPACE", "WORD_GAP", "byte_table", "hashed_words", "shared_dir", "table", "words", "words_of", "written", "written_alone"]

#: Words are maximal runs of characters other than ASCII white space.
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


#: Bytes of text hashed at a time, unless one text has more.
HASH_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones((2, 1), np.uint64)


def byte_table(gaps: bytes) -> np.ndarray:
    """Byte table for ``hashed_words``: A-Z become small, ``gaps`` 0, and zero 255, which no UTF-8 has."""
    return np.array([0 if c in gaps else c | 32 if 65 <= c <= 90 else c or 255 for c in range(256)], np.uint8)


#: White space between words, as in ``WORD_GAP``.
SPACE = bytes([32, *range(9, 14)])


def _powers_up_to(n: int) -> np.ndarray:
    """Powers of an odd number modulo 2^64, and of its inverse."""
    global _powers
    if _powers.shape[1] < n:
        steps = np.full((2, 1 << (n - 1).bit_length()), [[_BASE], [pow(_BASE, -1, 1 << 64)]], np.uint64)
        steps[:, 0] = 1
        _powers = np.cumprod(steps, axis=1, dtype=np.uint64)
    return _powers


@dataclass
class Words:
    """Words of some texts: hashes, where each text's begin among them (one number more than texts), and their bytes.

    Word k is ``low[first[k] : last[k] + 1]``.
    """

    hashes: np.ndarray
    begin: np.ndarray
    low: np.ndarray
    first: np.ndarray
    last: np.ndarray

    @property
    def text(self) -> np.ndarray:
        """Number of each word's text."""
        return np.repeat(np.arange(len(self.begin) - 1), np.diff(self.begin))


def words_of(texts: pa.Array, table: np.ndarray, size: int | None = None) -> Iterator[Words]:
    """The words of the texts, as many texts at a time as have ``size`` bytes, one at least.

    ``table`` says which bytes stand between words (0) and which count as equal. A word's hash is
    a polynomial of its bytes, taken from running sums over all bytes, so that no word is
    handled alone. A null text has no words.
    """
    size = size or HASH_BYTES
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
        yield _words_of(table[data[ends[at] : ends[to]]], ends[at : to + 1] - ends[at])
        at = to


def _words_of(low: np.ndarray, edges: np.ndarray) -> Words:
    n = len(low)
    word = low != 0
    before, behind = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    before[1:], behind[:-1] = word, word
    before[edges], behind[edges] = False, False
    first, last = np.flatnonzero(word & ~before[:-1]), np.flatnonzero(word & ~behind[1:])
    power, inverse = _powers_up_to(max(1, n))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(low * power[:n], out=sums[1:])
    h = (sums[last + 1] - sums[first]) * inverse[first]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return Words(h ^ (h >> np.uint64(32)), np.searchsorted(first, edges), low, first, last)


def hashed_words(texts: pa.Array, table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the words of some texts at a time, and where each text's begin (``words_of``)."""
    for w in words_of(texts, table):
        yield w.hashes, w.begin
