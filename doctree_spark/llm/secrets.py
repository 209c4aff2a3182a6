r"""Secret scans: patterns, and encoded candidates confirmed by their structure.

Base kinds are patterns. The structural kinds decode what looks encoded and look inside before
they report it:

* ``key``: base64 or hex that decodes to a private key: DER with nested lengths that agree, in
  one of the shapes of private keys, or the OpenSSH format. It may begin anywhere in a run, stand
  between PEM lines, be wrapped over lines (real ones or ``\n`` in a string) that begin with
  quote or comment marks, or be hex with colons, blanks or dashes. PEM lines whose headers name
  a cipher are a key that is encrypted, so that only its size can be looked at.
* ``jwt``: three dotted base64url parts, the first a JSON header that names an algorithm, the
  second JSON.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doctree_spark.llm.shared import table

#: Order of kinds at the same start.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "key", "jwt")
SPANS = T.ArrayType(T.StructType().add("kind", T.StringType()).add("start", T.IntegerType()).add("end", T.IntegerType()))

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, as without the length
_MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*)-----")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
_ANY_HEX = re.compile(r"[0-9A-Fa-f]{48,}")
#: Where a line of an encoding ends and the next one begins; in strings both may be escaped.
_WRAP = r"[\"',+\x20\t]{0,4}+(?:\\[rn]|[\r\n])++(?:[\x20\t>#*;\"'|]|//(?=\x20))*+"
_LINES = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{24,}}+={{0,2}}+(?:{_WRAP}(?!--)[A-Za-z0-9+/_-]++={{0,2}}+)++")
_HEX_LINES = re.compile(rf"(?<![0-9A-Fa-f])[0-9A-Fa-f]{{24,}}+(?:{_WRAP}[0-9A-Fa-f]++)++")
_LINE_END = re.compile(rf"={{0,2}}{_WRAP}")
_PAIRS = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{2}(?:[:\x20-]\s*+[0-9A-Fa-f]{2}){47,}+")
_PAIR_END = re.compile(r"[:\x20-]\s*")
#: PEM headers, and those of an encrypted body.
_HEADER = re.compile(r"[A-Za-z][A-Za-z-]*:\x20[^\r\n\\]*")
_CIPHER = re.compile(r"DEK-Info:\x20*[A-Z0-9-]+,[0-9A-Fa-f]{16,64}")
# the first part begins its run, so that no run is read from each of its characters
_JWT = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{2,}+\.[A-Za-z0-9_-]*+")
#: No sequence of a private key has more elements.
MOST_PARTS = 10
#: How DER sequences and OpenSSH keys begin in base64, and in hex at any digit.
_BEGINS = re.compile(r"M[A-I]|b3BlbnNzaC1rZXk")
_HEX_BEGINS = re.compile(r"(?=30(?:8[1-4]|[2-7][0-9A-Fa-f])|6f70656e7373682d6b6579)", re.I)


def _element(data: bytes | Encoded, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, first and end offset of the DER element at ``at``, when it fits before ``end``."""
    if at + 2 > end:
        return None
    size, start = data[at + 1], at + 2
    if size >= 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or start + n > end:
            return None
        size = int.from_bytes(data[start : start + n], "big")
        start += n
        if size < 0x80:
            return None  # a short length in long form isn't DER
    return (data[at], start, start + size) if start + size <= end else None


def _children(data: bytes | Encoded, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill start to end exactly."""
    found = []
    while start < end:
        if not (e := _element(data, start, end)) or len(found) > MOST_PARTS:
            return None
        found.append(e)
        start = e[2]
    return found


def _algorithm(data: bytes | Encoded, e: tuple[int, int, int]) -> bool:
    """A sequence that starts with an object identifier."""
    inner = _children(data, e[1], e[2]) if e[0] == 0x30 else None
    return bool(inner) and inner[0][0] == 0x06


class Encoded:
    """The bytes that base64 text from ``start`` on stands for, decoded only where they are looked at.

    Takes base64 and base64url, with or without padding; what doesn't decode has no bytes.
    """

    def __init__(self, text: str, start: int = 0) -> None:
        self.text, self.start = text, start
        n = len(text.rstrip("=")) - start
        self.size = n // 4 * 3 + (0, 0, 1, 2)[n % 4]

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, at: int | slice) -> int | bytes:
        first, last = (at, at + 1) if isinstance(at, int) else (at.start, min(at.stop, self.size))
        if first >= last:
            return b""
        data = self.bytes(first, last)
        return data[0] if isinstance(at, int) else data

    def bytes(self, first: int, last: int) -> bytes:
        a, b = first // 3 * 4, -(-last // 3) * 4
        return _decoded(self.text[self.start + a : self.start + b])[first - a // 4 * 3 : last - a // 4 * 3]

    def letters(self, n: int) -> int:
        """Letters that the first ``n`` bytes take."""
        return -(-n * 4 // 3)


class Hex(Encoded):
    """The same for hex digits."""

    def __init__(self, text: str, start: int = 0) -> None:
        self.text, self.start, self.size = text, start, (len(text) - start) // 2

    def bytes(self, first: int, last: int) -> bytes:
        return bytes.fromhex(self.text[self.start + 2 * first : self.start + 2 * last])

    def letters(self, n: int) -> int:
        return 2 * n


def is_private_key(data: bytes | Encoded) -> int:
    """How many bytes a private key has with which ``data`` begins, in DER or the OpenSSH format; 0 if with none.

    Looks at headers and short numbers only, whatever the length.
    """
    if data[0:15] == b"openssh-key-v1\0":
        at = 15
        for _ in range(3):  # cipher, derivation, its options
            if at + 4 > len(data):
                return 0
            at += 4 + int.from_bytes(data[at : at + 4], "big")
        if at + 8 > len(data):
            return 0
        keys = int.from_bytes(data[at : at + 4], "big")
        end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "big")
        return end if 1 <= keys <= 16 and end <= len(data) else 0
    top = _element(data, 0, len(data))
    # a version of one byte or, where the key is encrypted, an algorithm comes first
    if not top or top[0] != 0x30 or data[top[1] : top[1] + 1] not in (b"\x02", b"\x30") or not (inner := _children(data, top[1], top[2])):
        return 0
    tags = [e[0] for e in inner]
    number = data[inner[0][1]] if tags[0] == 0x02 and inner[0][2] - inner[0][1] == 1 else None
    if number is None:  # encrypted: algorithm and content
        good = tags == [0x30, 0x04] and _algorithm(data, inner[0])
    elif number in (0, 1) and tags[1:3] == [0x30, 0x04]:
        good = _algorithm(data, inner[1])
    elif number == 1 and tags[1:2] == [0x04]:  # elliptic curve
        good = all(t in (0xA0, 0xA1) for t in tags[2:]) and inner[1][2] - inner[1][1] >= 16
    else:
        good = number == 0 and set(tags) == {0x02} and len(tags) in (6, 9)
    return top[2] if good else 0


def _decoded(text: str) -> bytes:
    """Base64 or base64url, with or without padding; what decodes of it."""
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    text = text[: len(text) - 1] if len(text) % 4 == 1 else text
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4))
    except binascii.Error:
        return b""


def _is_json(part: str, key: str | None = None) -> bool:
    try:
        value = json.loads(_decoded(part))
    except (ValueError, RecursionError):
        return False
    return isinstance(value, dict) and (key is None or isinstance(value.get(key), str))


def _pem_keys(text: str) -> Iterator[tuple[int, int]]:
    """Spans of PEM blocks, from a BEGIN line to the next mark if that is its END, that hold a private key."""
    begun = None
    for m in _MARK.finditer(text):
        if m[1] == "END" and begun and begun[2] == m[2]:
            body = text[begun.end() : m.start()]
            bare = re.sub(r"\\[rn]|//(?=\x20)|[^A-Za-z0-9+/=]", "", _HEADER.sub("", body))
            if is_private_key(_decoded(bare)) or m[2].endswith("PRIVATE KEY") and _CIPHER.search(body) and len(_decoded(bare)) >= 16:
                yield begun.start(), m.end()
        begun = m if m[1] == "BEGIN" else None


def _in_run(letters: str, kind: type[Encoded], begins: re.Pattern) -> Iterator[tuple[int, int]]:
    """Where keys begin and end in letters without gaps."""
    end = 0
    for start in dict.fromkeys([0, *(b.start() for b in begins.finditer(letters))]):
        if start >= end and (n := is_private_key(data := kind(letters, start))):
            end = start + data.letters(n)
            yield start, end


def _over_gaps(text: str, a: int, b: int, gap: re.Pattern, kind: type[Encoded], begins: re.Pattern) -> Iterator[tuple[int, int]]:
    """Spans of keys in text whose letters stand between gaps."""
    parts, places, at, n = [], [], a, 0
    for m in [*gap.finditer(text, a, b), None]:
        end = m.start() if m else b
        parts.append(text[at:end])
        places.append((n, at))
        n += end - at
        at = m.end() if m else b
    firsts = [p[0] for p in places]

    def place(k: int) -> int:
        first, where = places[bisect.bisect_right(firsts, k) - 1]
        return where + k - first

    for start, end in _in_run("".join(parts), kind, begins):
        yield place(start), place(end - 1) + 1


def _keys(text: str) -> list[tuple[int, int]]:
    """Spans of private keys, none inside another: PEM blocks, then runs, then what is wrapped or spaced."""
    found = list(_pem_keys(text)) if "-----BEGIN " in text else []
    runs = [(*m.span(), m[0]) for m in _BASE64.finditer(text)]
    candidates: list[tuple[int, int]] = []
    for a, b, run in runs:
        # a run's key takes in what follows it there
        first = next(_in_run(run, Encoded, _BEGINS), None)
        if first:
            candidates.append((a + first[0], b))
    for m in _ANY_HEX.finditer(text):
        candidates += [(m.start() + a, m.start() + b) for a, b in _in_run(m[0], Hex, _HEX_BEGINS)]
    for m in _LINES.finditer(text):
        candidates += _over_gaps(text, *m.span(), _LINE_END, Encoded, _BEGINS)
    for m in _HEX_LINES.finditer(text):
        candidates += _over_gaps(text, *m.span(), _LINE_END, Hex, _HEX_BEGINS)
    for m in _PAIRS.finditer(text):
        candidates += _over_gaps(text, *m.span(), _PAIR_END, Hex, _HEX_BEGINS)
    # those found first stay; later ones that touch them go
    starts = [a for a, _ in sorted(found)]
    for a, b in candidates:
        k = bisect.bisect_left(starts, b)
        if not any(x < b and a < y for x, y in found[max(0, k - 1) : k]):
            at = bisect.bisect_left(starts, a)
            starts.insert(at, a)
            found.insert(at, (a, b))
    return found


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every span, by start and then kind."""
    spans = []
    if ":" in text or "=" in text:
        spans += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [("hex", *m.span()) for m in _HEX.finditer(text)]
    spans += [("key", a, b) for a, b in _keys(text)]
    if "." in text and "ey" in text:
        for m in _JWT.finditer(text):
            head, body, _ = m[0].split(".")
            if head.startswith("ey") and _is_json(head, "alg") and _is_json(body):
                spans.append(("jwt", *m.span()))
    return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redacted(text: str) -> str:
    """The text with every span, merged where they overlap, replaced by ``[secret]``."""
    out, at = [], 0
    for _, start, end in find_secrets(text):
        if start >= at:
            out += [text[at:start], "[secret]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


@F.pandas_udf(SPANS)
def _spans_of(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in find_secrets(t)] for t in texts], dtype=object)


@F.pandas_udf(T.StringType())
def _redacted_of(texts: pd.Series) -> pd.Series:
    return pd.Series([redacted(t) for t in texts], dtype=object)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of secrets in every text: ``id_col, spans array<struct<kind,start,end>>``.

    Offsets count code points, the end exclusive. A null or empty text has no spans. Ids may
    repeat or be null; other columns are ignored. No shuffle.
    """
    return docs.select(id_col, _spans_of(F.coalesce(F.col(text_col), F.lit(""))).alias("spans"))


def redact_secrets(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with secrets replaced in ``text_col`` and ``chars_col`` counted anew where they were.

    Null texts stay null. All columns and rows are kept.
    """
    clean = F.when(F.col(text_col).isNotNull(), _redacted_of(F.coalesce(F.col(text_col), F.lit(""))))
    out = docs.withColumn("__clean", clean)
    changed = ~F.col("__clean").eqNullSafe(F.col(text_col))
    if chars_col in docs.columns:
        kind = docs.schema[chars_col].dataType
        out = out.withColumn(chars_col, F.when(changed, F.length("__clean").cast(kind)).otherwise(F.col(chars_col)))
    return out.withColumn(text_col, F.col("__clean")).drop("__clean")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s.kind.isin(*BASE_KINDS))
    kinds = F.transform(spans, lambda s: s.kind)
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return scan_secrets(table(spark, sf_dir, "documents")).select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"))
