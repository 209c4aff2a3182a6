"""Conversation repair: cheapest edits by dynamic programming over a trie of signatures.

A conversation's signature has a character a turn: whether it must go (blank, or said before),
else its role and whether it is cut off. What edits cost depends on the signature alone.
Signatures are sorted, so a task meets those with a common beginning one after the other; the
path from the trie's root to the present signature is all it holds, and a layer of the
programme is computed once for each prefix (``Trie``). Answers come out at terminal nodes.

Three exchanges: turns without texts by conversation, signatures by range, and texts by
conversation with their answer ahead of them. Sorting is Spark's; Python passes stream over
sorted rows and hold a signature's characters, not turns or texts. Equal signatures may lie in
several ranges, so a signature that a third of all conversations have is no single task. A
conversation's answer is one row and its texts are read in turn, by the nature of the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doctree_spark.llm.shared import SPACE, table, written

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
#: Costs of edits, and of a turn that is cut off and stays.
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
USER, ASSISTANT = "user", "assistant"
GOOD_PAIRS = ("su", "ua", "au")
#: What has been said so far: nothing, the system's turn, the user's last, the assistant's last.
_NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
_ENDS = (0, 3)
#: By state, what an inserted or changed turn says there, and where that leads.
_SAYS = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
#: Signature characters: a turn that must go; a turn by role, capital where it is cut off.
GONE, OTHER = "x", "o"
_WORST = 1 << 60


def _insertions(state: int) -> list[tuple[int, str]]:
    """States that insertions reach from ``state``, each by the fewest."""
    found, n = [(state, "")], 0
    while (state := _SAYS[state][1]) not in [s for s, _ in found]:
        n += 1
        found.append((state, INSERT * n))
    return found


def _steps(symbol: str) -> list[tuple[int, int, int, str]]:
    """``(from, to, cost, edits)`` of all ways to take a turn: insertions before it, then what happens to it."""
    steps = []
    for state in range(4):
        for at, inserted in _insertions(state):
            cost = INSERT_COST * len(inserted)
            steps.append((state, at, cost + DELETE_COST, inserted + DELETE))
            if symbol != GONE:
                stays = cost + (TRUNCATED_COST if symbol.isupper() else 0)
                steps.append((state, _SAYS[at][1], stays + REROLE_COST, inserted + REROLE))
                if (to := _NEXT[at].get(symbol.lower())) is not None:
                    steps.append((state, to, stays, inserted + KEEP))
    return steps


STEPS = {c: _steps(c) for c in (GONE, "s", "S", "u", "U", "a", "A", OTHER, OTHER.upper())}


class Trie:
    """The path of the last signature: a layer for each prefix, which later signatures share.

    A layer has for each state the least cost, the place of its edits in the order of all
    states' edits, and the step that led there. Edits up to a turn end with what happens to
    it, so none of them begins with another, and their order settles every longer one's.
    """

    def __init__(self) -> None:
        self.path = ""
        self.layers = [((0, _WORST, _WORST, _WORST), (0, 0, 0, 0), (None,) * 4)]
        self.computed = 0

    def answer(self, signature: str) -> tuple[int, str]:
        """Cost and edits of a signature. Quick if signatures come sorted."""
        same = _common(self.path, signature)
        del self.layers[same + 1 :]
        for symbol in signature[same:]:
            self.layers.append(self._layer(symbol))
        self.path = signature
        cost, order, _ = self.layers[-1]
        ends = [(cost[s] + INSERT_COST * len(i), order[s], i, s) for s in range(4) for e, i in _insertions(s) if e in _ENDS and cost[s] < _WORST]
        best, _, last, state = min(ends)
        edits = [last]
        for _, _, steps in reversed(self.layers[1:]):
            state, said = steps[state]
            edits.append(said)
        return best, "".join(reversed(edits))

    def _layer(self, symbol: str) -> tuple:
        self.computed += 1
        cost, order, _ = self.layers[-1]
        best: list = [None] * 4
        for state, to, more, said in STEPS[symbol]:
            if cost[state] < _WORST:
                way = (cost[state] + more, order[state], said, state)
                if best[to] is None or way < best[to]:
                    best[to] = way
        ranks = sorted({w[1:3] for w in best if w})
        return tuple(w[0] if w else _WORST for w in best), tuple(ranks.index(w[1:3]) if w else 0 for w in best), tuple((w[3], w[2]) if w else None for w in best)


def _common(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:  # slices compare quicker than characters
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def damaged(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``id_col, turn, role, text, gone`` with damage by the CRC-32 of ``<id>:<turn>`` modulo 20.

    0 drops a row (``gone``), 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes
    it the user's. Null roles and texts become one space, as do null ids and turns in the key.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", spaced(id_col), spaced("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    role = F.when(kind == 4, USER).otherwise(spaced("role"))
    df = conversations.select(id_col, "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("gone"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("__copy"))
    return df.drop("__copy")


def _digest() -> Column:
    """Stands for a turn's role and text where texts don't travel, and orders turns with equal numbers and roles."""
    return F.unhex(F.sha2(F.concat(F.col("role"), F.lit("\0"), F.col("text")), 256))


def signatures(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``id_col, gaps, blank, duplicate, truncated, illegal, signature`` of each conversation in ``turns`` (as ``damaged`` gives them).

    Turns are taken by number (nulls first), then role, then a digest of role and text; rows
    that are ``gone`` only say that their conversation exists.
    """
    text = F.rtrim("text", F.lit(SPACE.decode()))
    fault = F.when(text == "", "b").when(~F.substring(text, -1, 1).isin(".", "!", "?"), "t").otherwise("")
    lean = turns.select(id_col, F.col("turn").cast("long").alias("turn"), "role", _digest().alias("digest"), fault.alias("fault"), "gone")
    same = Window.partitionBy(id_col, "gone", "digest").orderBy(F.col("turn").asc_nulls_first())
    lean = lean.repartition(id_col).withColumn("again", F.row_number().over(same) > 1)
    lean = lean.select(id_col, "turn", F.substring("role", 1, 1).alias("initial"), "role", "digest", "gone", F.when(F.col("fault") == "b", "b").when(F.col("again"), "d").otherwise(F.col("fault")).alias("fault"))
    order = [F.col(id_col).asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest"]
    lean = lean.sortWithinPartitions(*order).select(id_col, "turn", "initial", "fault", "gone")
    schema = T.StructType([turns.schema[id_col], *(T.StructField(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal")), T.StructField("signature", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, own = [], None
        for batch in batches:
            for name, turn, initial, fault, gone in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own is None or own.name != name:
                    if own:
                        out.append(own.row())
                    own = _Signature(name)
                if not gone:
                    own.add(turn, initial, fault)
            if out:
                yield _batch(out, schema, batch.schema.field(0).type)
                out = []
            kind = batch.schema.field(0).type
        if own:
            yield _batch([own.row()], schema, kind)

    return lean.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: T.StructType, kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, *(pa.int64() if isinstance(f.dataType, T.LongType) else pa.string() for f in schema.fields[1:])]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.fieldNames())


class _Signature:
    """What is known of a conversation while its turns go by."""

    def __init__(self, name) -> None:
        self.name, self.faults, self.illegal, self.last = name, {"b": 0, "d": 0, "t": 0, "": 0}, 0, None
        self.least = self.most = None
        self.distinct, self.symbols = 0, bytearray()

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        if turn is not None:
            self.distinct += turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn
        self.faults[fault] += 1
        self.illegal += self.last is not None and self.last + initial not in GOOD_PAIRS
        self.last = initial
        role = initial if initial in ("s", "u", "a") else OTHER
        self.symbols += (GONE if fault in ("b", "d") else role.upper() if fault == "t" else role).encode()

    def row(self) -> tuple:
        gaps = 0 if self.least is None else min(self.most - self.least + 1 - self.distinct, (1 << 63) - 1)
        return self.name, gaps, self.faults["b"], self.faults["d"], self.faults["t"], self.illegal, self.symbols.decode()


def answers(signed: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``signed`` with ``cost`` and ``audit``, the edits' initials, for ``signature``.

    Rows are ranged by signature, then by a hash of the id, so that a frequent one is split.
    """
    sorted_ = signed.repartitionByRange("signature", F.xxhash64(id_col)).sortWithinPartitions("signature")
    schema = T.StructType([*signed.schema.fields, T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())])
    at = signed.columns.index("signature")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, last, known = Trie(), None, None
        for batch in batches:
            costs, audits = [], []
            for signature in batch.column(at).to_pylist():
                if signature != last:
                    last, known = signature, trie.answer(signature)
                costs.append(known[0])
                audits.append(known[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(costs, pa.int64()), pa.array(audits, pa.string())], names=schema.fieldNames())

    return sorted_.mapInArrow(run, schema)


def _edited(rows: Iterable[tuple]) -> Iterator[tuple]:
    """``(id, role, text)`` after the edits; rows are sorted, a conversation's audit before its turns. A role of None begins a conversation."""
    audit, at, said = "", 0, 0

    def inserted(upto: int) -> Iterator[tuple]:
        nonlocal at, said
        while at < upto and audit[at] == INSERT:
            role, said = _SAYS[said]
            yield name, USER if role == "u" else ASSISTANT, ""
            at += 1

    started, name = False, None
    for key, kind, role, text in rows:
        if kind == 0:
            if started:
                yield from inserted(len(audit))
            started, name, audit, at, said = True, key, text, 0, 0
            yield name, None, None
            continue
        yield from inserted(len(audit))
        edit, at = audit[at], at + 1
        if edit == KEEP:
            said = _NEXT[said][role[0]]
            yield name, role, text
        elif edit == REROLE:
            letter, said = _SAYS[said]
            yield name, USER if letter == "u" else ASSISTANT, text
    if started:
        yield from inserted(len(audit))


def _stream(turns: DataFrame, answered: DataFrame, id_col: str) -> DataFrame:
    """Turns by conversation in order, each conversation's audit ahead of them."""
    none = F.lit(None)
    said = turns.filter("NOT gone").select(id_col, F.lit(1).alias("kind"), F.col("turn").cast("long").alias("turn"), "role", "text", _digest().alias("digest"))
    heads = answered.select(id_col, F.lit(0).alias("kind"), none.cast("long").alias("turn"), none.cast("string").alias("role"), F.col("audit").alias("text"), none.cast("binary").alias("digest"))
    order = [F.col(id_col).asc_nulls_first(), "kind", F.col("turn").asc_nulls_first(), "role", "digest"]
    return said.union(heads).repartition(id_col).sortWithinPartitions(*order).select(id_col, "kind", "role", "text")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def repaired_turns(turns: DataFrame, answered: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``id_col, place, role, text`` of the repaired conversations, places from 0."""
    schema = T.StructType([turns.schema[id_col], T.StructField("place", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    return _stream(turns, answered, id_col).mapInArrow(lambda batches: _placed(batches, schema), schema)


def _placed(batches: Iterator[pa.RecordBatch], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    first = next(batches, None)
    if first is None:
        return
    kind, out, place = first.schema.field(0).type, [], 0

    def every() -> Iterator[pa.RecordBatch]:
        yield first
        yield from batches

    for name, role, text in _edited(_rows(every())):
        if role is None:
            place = 0
            continue
        out.append((name, place, role, text))
        place += 1
        if len(out) >= 2000:
            yield _batch(out, schema, kind)
            out = []
    if out:
        yield _batch(out, schema, kind)


def repaired_hashes(turns: DataFrame, answered: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``id_col, repaired_sha256`` over the repaired turns as ``role:text`` lines; a conversation without any has an empty text's."""
    schema = T.StructType([turns.schema[id_col], T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return

        def every() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        kind, out, sums, begun, own = first.schema.field(0).type, [], None, False, None
        for name, role, text in _edited(_rows(every())):
            if role is None:
                if sums:
                    out.append((own, sums.hexdigest()))
                if len(out) >= 10_000:
                    yield _batch(out, schema, kind)
                    out = []
                sums, begun, own = hashlib.sha256(), False, name
                continue
            sums.update(f"{chr(10) if begun else ''}{role}:{text}".encode())
            begun = True
        if sums:
            out.append((own, sums.hexdigest()))
        if out:
            yield _batch(out, schema, kind)

    return _stream(turns, answered, id_col).mapInArrow(run, schema)


def repair(conversations: DataFrame, id_col: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """Answers a conversation (``signatures`` with ``cost, audit``), and its turns as they were judged.

    ``conversations`` has ``id_col, turn, role, text``; other columns are ignored. A null id is
    a conversation too. Where all rows are dropped, numbers are 0 and the audit is empty. An
    empty table gives empty ones. ``repaired_turns`` makes the repaired conversations of both.
    """
    turns = damaged(conversations, id_col)
    return written(answers(signatures(turns, id_col), id_col)), turns


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    answered, turns = repair(table(spark, sf_dir, "conversations"))
    hashes = repaired_hashes(turns, answered).withColumnRenamed("conv_id", "__id")
    both = answered.join(hashes, F.col("conv_id").eqNullSafe(F.col("__id")))
    return both.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
