"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash in the lowest ``1/scale`` of the hash range, so its size
follows the document and sketches of very unequal documents stay comparable: the kept hashes of
a part are kept in the whole too. The smallest hash is always kept, so that no text with words
has an empty sketch. Sketches merge by union, after which only the smallest of all may lie above
the fraction: what results is the sketch of both documents' shingles together.

Everything is built from Spark's own functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doctree_spark.llm.shared import table, words

SHINGLE = 5
SCALE = 4
LOWEST = -(2**63)


def with_sketch(df: DataFrame, text: str, out: str, scale: int = SCALE, shingle: int = SHINGLE) -> DataFrame:
    """Adds ``out``, the sorted sketch (array<bigint>) of the words in column ``text``.

    A text of fewer than ``shingle`` words is one shingle; a null text or one without words
    has the empty sketch.
    """
    w, h, n = f"__{out}_words", f"__{out}_hashes", F.size(f"__{out}_words")
    starts = F.slice(F.col(w), F.lit(1), n - (shingle - 1))
    hashes = F.transform(starts, lambda x, i: F.xxhash64(x, *(F.get(F.col(w), i + k) for k in range(1, shingle))))
    df = df.withColumn(w, words(F.col(text)))
    df = df.withColumn(h, F.when(n >= shingle, hashes).when(n > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>")))
    return df.withColumn(out, _kept(F.col(h), scale)).drop(w, h)


def _kept(hashes: Column, scale: int) -> Column:
    """Distinct hashes in the lowest ``1/scale`` of the range, and the smallest of all, sorted."""
    low = F.filter(hashes, lambda x: x < LOWEST + 2**64 // scale) if scale > 1 else hashes
    return F.when(F.size(hashes) > 0, F.array_sort(F.array_union(low, F.array(F.array_min(hashes))))).otherwise(hashes)


def resemblance(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sketches, 0 to 1; two empty sketches are alike."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first document's shingles that the second has too; 1 for an empty first."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merged(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Sketch of the union of two documents' shingles, from their sketches of the same ``scale``."""
    return _kept(F.array_union(a, b), scale)


def as_text(sketch: Column) -> Column:
    """Sketch as text: 16 hex digits a hash."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: int = SCALE) -> DataFrame:
    """``id_col, sketch array<bigint>`` for every row; no shuffle. Ids may repeat or be null."""
    return with_sketch(docs.select(F.col(id_col), F.col(text_col).alias("__text")), "__text", "sketch", scale).select(id_col, "sketch")


def with_next(docs: DataFrame, id_col: str, bucket_rows: int = 256, max_buckets: int = 65_536) -> tuple[DataFrame, Window]:
    """Rows dealt into buckets of consecutive ids, and a window in which ``lead`` finds the next row.

    The first row of a bucket stands once more at the end of the one before it, and the first
    row of all at the end of the last, each marked ``__again``: drop those after the window.
    So no bucket needs another, and no task all rows. Bucket bounds are quantiles of the ids;
    these, at most ``max_buckets`` numbers, are all that reaches the driver. Over ``bucket_rows *
    max_buckets`` rows buckets get longer, which Spark sorts with spilling; nothing else changes.
    Null ids come first; rows with equal ids, always in one bucket, follow in the order of
    ``__text``.
    """
    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(LOWEST))
    rows = docs.select(F.count("*")).head()[0]
    n = max(1, min(max_buckets, math.ceil(rows / bucket_rows)))
    low, cuts = docs.select(F.min(key), F.percentile_approx(key, [i / n for i in range(1, n)] or [0.5], 100 * n)).head()
    bounds = sorted({low, *(cuts if n > 1 else ())}) if low is not None else [0]
    steps = [2**k for k in reversed(range(len(bounds).bit_length()))]
    all_bounds = F.lit(bounds)
    # binary search: how many bounds are at or below the key
    bucket = F.aggregate(F.lit(steps), F.lit(0), lambda at, s: F.when(F.get(all_bounds, at + s - 1) <= F.col("__key"), at + s).otherwise(at))
    df = docs.withColumn("__key", key).withColumn("__bucket", bucket)
    own = F.array(F.struct(F.col("__bucket").alias("bucket"), F.lit(False).alias("again")))
    before = F.when(F.col("__key") == bounds[0], F.lit(len(bounds))).otherwise(F.col("__bucket") - 1)
    head = F.col("__key") == F.get(all_bounds, F.col("__bucket") - 1)
    places = F.when(head, F.concat(own, F.array(F.struct(before.alias("bucket"), F.lit(True).alias("again"))))).otherwise(own)
    df = df.withColumn("__place", F.explode(places)).withColumn("__bucket", F.col("__place.bucket")).withColumn("__again", F.col("__place.again")).drop("__place")
    return df, Window.partitionBy("__bucket").orderBy("__again", "__key", "__text")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("__text"))
    df, following = with_next(docs, "doc_id")
    size = F.length("__text")
    kept = F.col("n_chars") - F.floor(F.col("n_chars") / 4)
    df = df.withColumn("n_chars", size.cast("long")).withColumn("__next", F.lead("__text").over(following))
    df = df.withColumn("__edited", F.concat(F.substr("__text", F.lit(1), kept.cast("int")), F.substr("__next", F.lit(1), (F.col("n_chars") - kept).cast("int"))))
    df = with_sketch(df.drop("__next"), "__text", "__sketch")
    df = df.withColumn("__next_sketch", F.lead("__sketch").over(following)).filter(~F.col("__again"))
    df = with_sketch(df, "__edited", "__edited_sketch")
    return df.select(
        "doc_id",
        "n_chars",
        F.sha2("__edited", 256).alias("edited_sha256"),
        as_text(F.col("__sketch")).alias("fingerprint"),
        as_text(F.col("__edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("__sketch"), F.col("__edited_sketch")).alias("near_edited"),
        resemblance(F.col("__sketch"), F.col("__next_sketch")).alias("near_next"),
    )
