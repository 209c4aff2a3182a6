"""Spelling variants: words one code point apart, found by hashes of what deletions leave.

Two words differ by one replaced code point if deleting it at the same place leaves the same
string, and by an inserted one if a deletion leaves the other word. So each word has a key for
itself and one for each place: a polynomial hash of the part before it and the part behind it,
taken from running sums over all words of a batch in NumPy (``deletion_keys``). Keys are dealt
by their high bits and sorted; runs of equal keys are compared on strings.

Members of a run are counted, not paired: a member has as neighbours all others of the same
place, and the most frequent of them is one of the run's two first. A run has at most as many
members as the alphabet times the places of a word, however frequent the words are.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doctree_spark.llm.shared import _powers_up_to, table, written

LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A form is at least so many times as frequent.
TIMES = 5
#: One run in so many is damaged, see ``word_counts``.
DAMAGED = 199
#: Words a task counts before it hands the counts on.
COUNTED = 300_000
#: Code points up to which a word travels with its keys; the strings of longer ones follow only keys that occur again.
INLINE = 64
#: Bits of a key by which keys are dealt.
RADIX = 20
#: Places hashed at a time.
PLACES = 1 << 18
_KEYS = "key long, place int, first boolean, word string, n long"
#: Fixed: bytes of Latin-1, letters from U+00C0 on and a-z as they are, A-Z small, all others a space.
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 0xC0 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damaged: int = DAMAGED, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of all texts' words with ``least_length`` code points and ``least_count`` occurrences.

    Words are runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z made small. If the CRC-32 of
    ``<id>:<run>`` in UTF-8 is a multiple of ``damaged``, the run loses the code point at that
    number modulo its length. A null text has no words, a null id is empty; ids may repeat.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _count(name, text.as_py(), damaged, total)
                if len(total) >= COUNTED:
                    yield _counted(total, least_length)
                    total.clear()
        yield _counted(total, least_length)

    df = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col)).filter(F.col(text_col).isNotNull())
    found = df.mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _count(name: str, text: str, damaged: int, total: Counter[bytes]) -> None:
    # every other character becomes "?", which is no letter
    own = Counter(text.encode("latin-1", "replace").translate(_LETTERS).split())
    total.update(own)
    start, crc = zlib.crc32(f"{name}:".encode()), zlib.crc32
    for run, n in own.items():
        h = crc(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % damaged == 0:
            at = h % len(run)
            total[run] -= n
            total[run[:at] + run[at + 1 :]] += n


def _counted(total: Counter[bytes], least: int) -> pa.RecordBatch:
    rows = {w.decode("latin-1"): n for w, n in total.items() if n and len(w) >= least}
    return pa.RecordBatch.from_arrays([pa.array(rows.keys(), pa.string()), pa.array(rows.values(), pa.int64())], names=["word", "n"])


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word its own key (place -1), then those of all strings that lack one of its code points.

    Returns word numbers, places, keys, and whether a place is the first of its run of equal
    code points, whose deletions leave the same string.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    end = np.cumsum(sizes)
    begin = end - sizes
    power, inverse = _powers_up_to(max(1, len(points) + 1))
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points + np.uint64(1)) * power[: len(points)], out=sums[1:])
    word = np.repeat(np.arange(len(words)), sizes)
    a, b, i = begin[word], end[word], np.arange(len(points))
    # what stands behind the gap moves up by one place
    left = (sums[i] - sums[a] + (sums[b] - sums[i + 1]) * inverse[1]) * inverse[a]
    own = (sums[end] - sums[begin]) * inverse[begin]
    first = np.ones(len(points), bool)
    first[1:] = points[1:] != points[:-1]
    first[begin[sizes > 0]] = True
    number = np.concatenate([np.arange(len(words)), word])
    place = np.concatenate([np.full(len(words), -1), i - a])
    keys = np.concatenate([own, left])
    keys = (keys ^ (keys >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return number, place, (keys ^ (keys >> np.uint64(29))).view(np.int64), np.concatenate([np.zeros(len(words), bool), first])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, counts = batch.column(0).to_pylist(), batch.column(1)
        at = 0
        while at < len(words):
            to, places = at, 0
            while to < len(words) and (to == at or places + len(words[to]) < PLACES):
                places += len(words[to])
                to += 1
            number, place, keys, first = deletion_keys(words[at:to])
            number = pa.array(number + at)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(place, pa.int32()), pa.array(first), batch.column(0).take(number), counts.take(number)], names=["key", "place", "first", "word", "n"])
            at = to


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]]:
    """The rows of runs of two and more equal keys in batches that come sorted by key."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        keys = rows.column(0).to_numpy()
        done = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        held = rows.slice(done)
        yield _again(rows.slice(0, done))
    if held is not None:
        yield _again(held)


def _again(rows: pa.Table) -> tuple:
    keys = rows.column(0).to_numpy()
    same = keys[1:] == keys[:-1]
    rows = rows.filter(pa.array(np.append(same, False) | np.append(False, same))) if len(keys) else rows
    return (*(rows.column(k).to_numpy() for k in range(3)), rows.column(3).to_pylist(), rows.column(4).to_numpy())


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For words of each run: how many neighbours they have there, and the best of them."""
    for keys, places, firsts, words, counts in _runs(batches):
        if not len(keys):
            continue
        edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        out: list[tuple[str, int, int, str]] = []
        for a, b in zip(edge, np.append(edge[1:], len(keys)), strict=True):
            by_text = defaultdict(list)
            for word, place, first, n in zip(words[a:b], places[a:b].tolist(), firsts[a:b].tolist(), counts[a:b].tolist(), strict=True):
                by_text[word[:place] + word[place + 1 :] if place >= 0 else word].append((-n, word, place, first))
            for run in by_text.values():
                if len(run) > 1:
                    _of_run(run, out)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "near", "less", "other"])


def _of_run(run: list[tuple[int, str, int, bool]], out: list[tuple[str, int, int, str]]) -> None:
    own = next((r for r in run if r[2] < 0), None)
    longer = [r for r in run if r[3]]
    if own and longer:
        out.append((own[1], len(longer), *min(longer)[:2]))
        out += [(r[1], 1, *own[:2]) for r in longer]
    by_place = defaultdict(list)
    for r in run:
        if r[2] >= 0:
            by_place[r[2]].append(r)
    for members in by_place.values():
        if len(members) > 1:
            members.sort()
            best, second = members[0][:2], members[1][:2]
            out += [(r[1], len(members) - 1, *(best if r[1] != best[1] else second)) for r in members]


def near_words(words: DataFrame, inline: int = INLINE) -> DataFrame:
    """``word, n_near, near, near_n``: for each of ``word, n`` that has any, how many others are one code point away, and the most frequent (ties: the least).

    ``word`` must be distinct; null words are left out. Words longer than ``inline`` code points
    come with their strings only under keys that occur again, as all their keys with copies of
    them would be the square of their length.
    """
    words = words.filter("word IS NOT NULL").select("word", F.col("n").cast("long").alias("n"))
    short, long = words.filter(F.length("word") <= inline), words.filter(F.length("word") > inline)
    keys = short.mapInArrow(_keyed, _KEYS)
    bare = long.mapInArrow(_keyed, _KEYS).withColumn("id", F.sha2("word", 256)).drop("word")
    edge = short.filter(F.length("word") == inline).mapInArrow(_keyed, _KEYS).filter("place < 0")
    again = bare.select("key").union(edge.select("key")).groupBy("key").agg(F.count("*").alias("__n")).filter("__n > 1").select("key")
    strings = long.select(F.sha2("word", 256).alias("id"), "word")
    late = bare.join(again, "key", "left_semi").join(strings, "id").select(keys.columns)
    radix = F.shiftright("key", 64 - RADIX)
    dealt = keys.union(late).repartition(radix).sortWithinPartitions("key")
    found = dealt.mapInArrow(_neighbours, "word string, near long, less long, other string")
    best = F.min(F.struct("less", "other"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.other").alias("near"), (-F.col("b.less")).alias("near_n"))


def group_variants(words: DataFrame, times: int = TIMES, inline: int = INLINE) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of distinct ``word, n``.

    ``form`` is the nearest word's most frequent neighbour if it has ``times`` the occurrences,
    else null; ``root`` is where following forms ends, the word itself without one. Forms grow
    by ``times`` at each step, so a chain has at most log(largest n) steps, and doubling it
    takes the logarithm of these. No words give no rows.
    """
    words = written(words.filter("word IS NOT NULL").select("word", F.col("n").cast("long").alias("n")))
    near = near_words(words, inline)
    fits = F.col("near_n") >= times * F.col("n")
    rows = words.join(near, "word", "left").select("word", F.when(fits, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("near_n")).alias("form_n"))
    rows = written(rows)
    least, most = words.agg(F.min("n"), F.max("n")).head()
    steps = math.ceil(math.log(max(1, most / max(1, least)), times)) if most else 0
    links = rows.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(max(0, steps - 1).bit_length()):
        further = links.select(F.col("word").alias("root"), F.col("root").alias("__end"))
        links = written(links.join(further, "root", "left").select("word", F.coalesce("__end", "root").alias("root")))
    roots = rows.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))
    return roots.select("word", "form", "root", "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(word_counts(table(spark, sf_dir, "documents")))
