"""Token counts by byte-pair merging, without building the tokens.

The vocabulary file holds merges with ranks. A word starts as one symbol per UTF-8 byte, the
last one marked as the end of the word. The adjacent pair of lowest rank merges again and
again: a heap offers the pairs, a linked list keeps the neighbours. A word has as many tokens
as it had symbols at first, less the merges made. No identifier is emitted.

Words repeat, so each task keeps the counts of words it has met, in a dictionary that is
emptied when it holds ``CACHE_WORDS`` entries.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doctree_spark.llm.shared import table

CACHE_WORDS = 500_000
#: A vocabulary file above this size is refused: it is sent to every executor.
MAX_VOCABULARY_BYTES = 64 << 20
#: The white space that the vocabulary's splitter knows.
_SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


class MergeCounter:
    """Counts tokens as the file's normaliser, splitter and merges make them."""

    def __init__(self, vocabulary: bytes) -> None:
        spec = json.loads(vocabulary)
        model = spec["model"]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix"):
            raise ValueError("a byte-pair vocabulary with word ends is needed")
        end, ids = model["end_of_word_suffix"], model["vocab"]
        letters = _byte_letters()
        self.inner = [ids[c] for c in letters]
        self.last = [ids[c + end] for c in letters]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(split.replace(r"[^\s", "[^" + _SPACE[1:-1]))
        self.cache: dict[str, int] = {}

    def of_word(self, word: str) -> int:
        """Symbols of one word less the merges that apply."""
        raw = word.encode()
        symbol = [self.inner[b] for b in raw]
        symbol[-1] = self.last[raw[-1]]
        n = len(symbol)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            if found := self.merges.get((symbol[i], symbol[i + 1])):
                heap.append((found[0], i, found[1]))
        heapq.heapify(heap)
        count = n
        while heap:
            rank, i, merged = heapq.heappop(heap)
            j = right[i]
            if symbol[i] < 0 or j >= n or self.merges.get((symbol[i], symbol[j]), (-1,))[0] != rank:
                continue  # one of the two has merged since
            symbol[i], symbol[j] = merged, -1
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
                if found := self.merges.get((merged, symbol[right[j]])):
                    heapq.heappush(heap, (found[0], i, found[1]))
            if left[i] >= 0 and (found := self.merges.get((symbol[left[i]], merged))):
                heapq.heappush(heap, (found[0], left[i], found[1]))
            count -= 1
        return count

    def of_text(self, text: str) -> int:
        """Tokens of a text; each special string in it is one token, as the library has it."""
        total, parts = 0, [text]
        if self.special and "<|" in text:
            parts = self.special.split(text)
            total = len(parts) - 1
        cache = self.cache
        for part in parts:
            part = unicodedata.normalize("NFC", part)
            # letter by letter: a sigma at the end of a word is no special case
            part = part.replace("Σ", "σ").lower()
            for word in self.split.findall(part):
                n = cache.get(word)
                if n is None:
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    n = cache[word] = self.of_word(word)
                total += n
        return total


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    own = set(plain)
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Bytes and tokens of every text.

    Args:
        docs: a table with ``id_col`` and ``text_col``; other columns are ignored.
        vocabulary: path of the vocabulary file, read by the driver and broadcast
            (refused above ``MAX_VOCABULARY_BYTES``).
        limit: texts with more tokens are flagged.

    Returns:
        ``id_col, n_bytes long, n_tokens long, over_limit boolean``, one row per row of
        ``docs``. A null text counts as empty: 0 bytes, 0 tokens. Ids may repeat or be null.
    """
    with open(vocabulary, "rb") as f:
        content = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(content) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary} is larger than {MAX_VOCABULARY_BYTES} bytes")
    sent = docs.sparkSession.sparkContext.broadcast(content)

    @F.pandas_udf("long")
    def tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = MergeCounter(sent.value)
        for batch in texts:
            yield pd.Series([counter.of_text(t) for t in batch], dtype="int64")

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(id_col, F.octet_length(text).cast("long").alias("n_bytes"), tokens(text).alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
