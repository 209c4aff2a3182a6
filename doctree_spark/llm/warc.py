"""WARC archives: written and read back as Spark jobs, with one merged capture index.

Writing: each page is a record; of equal payloads one is the response, the others revisit it.
A record is one string whose line separator is the record's end, so Spark's text writer makes
the archives, on any file system and with task commits.

Reading: every archive is parsed by the lengths in its headers, never by searching for
separators, and gives one run of index lines sorted by URL key and time, each with its place in
the run. The runs are written; ranges of keys deal them out, and in each range a tree of losers
merges the runs' pieces, which places alone put back in order. The ranges in turn are one capture
history in global order.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doctree_spark.llm.shared import shared_dir, table, written

#: Most records in one archive file, and about the most bytes, unless one record has more.
ARCHIVE_RECORDS = 2000
ARCHIVE_BYTES = 128 << 20
#: About the most index lines in one range of a merge.
RANGE_LINES = 250_000
#: Captures without a time of their own are taken to be seconds after this one.
FIRST_CAPTURE = 1_704_067_200
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = (
    T.StructType()
    .add("run", "string").add("url_key", "string").add("captured_at", "string").add("page_id", "long")
    .add("offset", "long").add("length", "long").add("payload_bytes", "long").add("payload_digest", "string")
    .add("record_type", "string").add("refers_to", "long").add("place", "long")
)
_ORDER = ["url_key", "captured_at", "page_id"]


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32: five hex digits are four of base32."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def warc_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """One WARC record a page: ``record string``.

    Of equal payloads of at least ``min_bytes`` bytes, those with the smallest id are responses
    (rows that repeat an id alike), the others revisit it; smaller ones are responses. A null
    payload is empty. A null id comes after every other; a null URL leaves out its header.
    """
    df = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    df = df.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("digest", base32_sha1(F.encode("html", "UTF-8")))
    # only ids and digests move; what revisits is written, and while it is small the pages with their text stay in place
    named = df.filter(F.col("bytes") >= min_bytes).select("id", "digest")
    first = named.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # with no id at all in the group, there is none to refer to
    again = named.join(first, "digest").filter(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))).distinct()
    again = written(again.select(F.col("id").alias("r_id"), F.col("digest").alias("r_digest"), "first"))
    df = df.join(again, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left")
    revisit = F.col("first").isNotNull()
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    seconds = F.lit(FIRST_CAPTURE) + F.coalesce(F.pmod(F.col("id"), F.lit(1_000_000_000)), F.lit(0))
    # days and seconds are counted in UTC, whatever the session's time zone
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    day, second = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int")), F.pmod(seconds, F.lit(86400))
    when = F.concat(day.cast("string"), F.lit("T"), two(second / 3600), F.lit(":"), two(second % 3600 / 60), F.lit(":"), two(second % 60), F.lit("Z"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("bytes").cast("string")), F.lit("\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("id"))),
        line("WARC-Date", when),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(F.col("first"))), line("WARC-Profile", F.lit(_PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
        F.col("block"),
    )
    return df.withColumn("block", block).select(record.alias("record"))


def write_archives(records: DataFrame, path: str) -> None:
    """Archives of ``records`` below ``path``; the text writer's separator ends each record.

    Records are written in classes of size, each with as many to a file as ``ARCHIVE_BYTES``
    allow, so that a few long pages don't make all archives small, nor one too large to read.
    A class with no records costs a scan, and is left out where none is that long. Without any
    record there is a folder without archives, which reads as no records.
    """
    size = F.octet_length("record")
    longest = records.agg(F.max(size)).head()[0] or 0
    bounds = [b for b in (ARCHIVE_BYTES // ARCHIVE_RECORDS, 4 << 20) if b < longest] + [None]
    for low, high in zip([-1, *bounds], bounds, strict=False):
        part = records if len(bounds) == 1 else records.filter((size > low) & (F.lit(True) if high is None else size <= high))
        each = max(1, min(ARCHIVE_RECORDS, ARCHIVE_BYTES // (high or max(1, longest))))
        part.write.mode("append").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", each).text(path)


def url_key(url: str) -> str:
    """Sort key of a URL: host labels reversed, then path and query; port, user and fragment left out."""
    try:
        parts = urlsplit(url)
        host = parts.hostname or ""
    except ValueError:
        return url
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def _headers(data: bytes, start: int) -> tuple[str, dict[str, str], int]:
    """First line, fields with lower-case names, and the offset behind the empty line."""
    end = data.find(b"\r\n\r\n", start)
    if end < 0:
        raise ValueError(f"no end of headers after byte {start}")
    first, *lines = data[start:end].decode().split("\r\n")
    return first, {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}, end + 4


def _page(urn: str | None) -> int | None:
    found = (urn or "").removeprefix("<urn:page:").rstrip(">")
    return int(found) if found.lstrip("-").isdigit() else None


def parse_archive(data: bytes, run: str = "") -> Iterator[dict]:
    """Index lines of an archive, in its own order; payloads are held against their digests."""
    at = 0
    while at < len(data):
        version, head, block = _headers(data, at)
        if not version.startswith("WARC/1."):
            raise ValueError(f"{run}: no record at byte {at}")
        end = block + int(head["content-length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"{run}: the record at byte {at} has no end")
        _, http, payload = _headers(data[block:end], 0)
        digest = head["warc-payload-digest"].removeprefix("sha1:")
        size = int(http["content-length"])
        if head["warc-type"] == "response":
            content = data[block + payload : end]
            if len(content) != size or base64.b32encode(hashlib.sha1(content).digest()).decode() != digest:
                raise ValueError(f"{run}: the payload of the record at byte {at} is damaged")
        url = head.get("warc-target-uri")
        yield {
            "run": run, "url_key": "" if url is None else url_key(url), "captured_at": head["warc-date"], "page_id": _page(head["warc-record-id"]),
            "offset": at, "length": end + 4 - at, "payload_bytes": size, "payload_digest": digest,
            "record_type": head["warc-type"], "refers_to": _page(head.get("warc-refers-to")),
        }
        at = end + 4


def _key(line: dict) -> tuple:
    page = line["page_id"]
    return line["url_key"], line["captured_at"], page is not None, page or 0


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Index lines of all archives below ``path``: one run an archive, sorted by URL key and time."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                lines = sorted(parse_archive(content.as_py(), name.as_py().rpartition("/")[2]), key=_key)
                if lines:
                    yield pa.RecordBatch.from_pylist([{**line, "place": k} for k, line in enumerate(lines)], schema=schema)

    schema = _arrow(INDEX)
    return spark.read.format("binaryFile").load(path).filter("length > 0").select("path", "content").mapInArrow(parse, INDEX)


def _arrow(schema: T.StructType) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64()}
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema])


def merge_sorted(keys: list[list]) -> Iterator[tuple[int, int]]:
    """(run, place) of all items in order, merged from sorted runs by a tree of losers.

    Inner node i holds the loser of the match played there; the winner goes up. After the
    winner is taken, its run's next item plays again only on the way from its leaf to the top.
    """
    k = len(keys)
    if not k:
        return
    place = [0] * k

    def beats(a: int, b: int) -> bool:
        """Whether run a's next item comes before run b's; a run at its end never does."""
        if place[a] >= len(keys[a]) or place[b] >= len(keys[b]):
            return place[a] < len(keys[a])
        x, y = keys[a][place[a]], keys[b][place[b]]
        return x < y or x == y and a < b

    winner, loser = [0] * k + list(range(k)), [0] * k
    for node in range(k - 1, 0, -1):
        a, b = winner[2 * node], winner[2 * node + 1]
        winner[node], loser[node] = (a, b) if beats(a, b) else (b, a)
    top = winner[1] if k > 1 else 0
    while place[top] < len(keys[top]):
        yield top, place[top]
        place[top] += 1
        node = (top + k) // 2
        while node:
            if beats(loser[node], top):
                loser[node], top = top, loser[node]
            node //= 2


def merge_runs(runs: DataFrame) -> DataFrame:
    """The runs as one index in global order of URL key, time and page id.

    Range partitioning deals key ranges to tasks (a URL with very many captures is dealt out by
    time and page), each with its piece of every run; run and place put a piece's lines back into
    the run's order, and the task merges the pieces. There are as many ranges as keep each near
    ``RANGE_LINES`` lines, which is what a task holds, without payloads.
    """
    schema = _arrow(INDEX)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches), schema=schema)
        if not held.num_rows:
            return
        lines = held.select(["run", *_ORDER]).to_pydict()
        keys = list(zip(lines["url_key"], lines["captured_at"], [p is not None for p in lines["page_id"]], [p or 0 for p in lines["page_id"]], strict=True))
        run = lines["run"]
        starts = [i for i in range(len(run)) if not i or run[i] != run[i - 1]]
        pieces = [keys[a:b] for a, b in zip(starts, [*starts[1:], len(run)], strict=True)]
        order = [starts[r] + i for r, i in merge_sorted(pieces)]
        yield from held.take(pa.array(order, pa.int64())).combine_chunks().to_batches(max_chunksize=10_000)

    session = runs.sparkSession
    ranges = max(int(session.conf.get("spark.sql.shuffle.partitions")), math.ceil(runs.count() / RANGE_LINES))
    dealt = runs.select(INDEX.fieldNames()).repartitionByRange(ranges, *_ORDER).sortWithinPartitions("run", "place")
    return dealt.mapInArrow(merge, INDEX)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = shared_dir(spark)
    write_archives(warc_records(table(spark, sf_dir, "pages")), archives)
    index = merge_runs(written(read_runs(spark, archives)))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_DIGITS = " || ".join(f"to_base(CAST('0x' || substr(h, {1 + 5 * i}, 5) AS BIGINT), 32, 4)" for i in range(8))
OP5_SQL = f"""
WITH hashed AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
named AS (SELECT page_id, payload_bytes, translate({_DIGITS}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest FROM hashed),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM named)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NULL OR first_id IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id IS NULL OR first_id IS NOT DISTINCT FROM page_id THEN NULL ELSE first_id END AS refers_to
FROM firsts
"""
