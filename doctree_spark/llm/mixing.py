"""Mixing sources to target weights by systematic sampling.

Each source gets a target of words. Its documents stand in a fixed order; the running sum of
their expected copies, from one random offset, emits a document once for each whole number it
passes. Expected copies are the same for all documents of a source, so the running sum is that
number times the document's place, and the places are found without any source in one task:
documents are dealt into cells (source, band of size, salt), and cells into blocks of
``BLOCK_SALTS`` salts. Prefix sums run over a source's blocks (one for some three million of its
documents), a block's cells and a cell's documents. Bands put documents of like size side by
side, so the words taken come near the target.

Everything is built from Spark's own functions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doctree_spark.llm.shared import table, words, written

WEIGHTS = (3.0, 1.0, 2.0)
TOTAL = 1.5
MOST_COPIES = 2
CELL_ROWS = 3000
BLOCK_SALTS = 1024
SEED = 17

_SOURCE = ["__no_source", "__source"]
_BLOCK = [*_SOURCE, "__band", "__block"]
_CELL = [*_BLOCK, "__salt"]


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, total: float = TOTAL, most: float = MOST_COPIES) -> DataFrame:
    """Targets of sources: one row a source in, with ``__no_source, __source, source_size``.

    Sources in code point order, null last, take ``weights`` in turn. They share ``total`` times
    all sizes by weight, none above ``most`` times its own size; what is cut off goes to the
    others by weight. That is a water level: the target is the smaller of the limit and level
    times weight. Windows here run over one row a source, not over documents.
    """
    everything = Window.partitionBy()
    named = Window.orderBy(*_SOURCE)
    weight = F.get(F.lit([float(w) for w in weights]), ((F.row_number().over(named) - 1) % len(weights)))
    df = sizes.withColumn("__weight", weight).withColumn("__limit", F.col("source_size") * float(most))
    filling = Window.orderBy(F.col("__limit") / F.col("__weight"), *_SOURCE)
    df = df.withColumn("__before", F.coalesce(F.sum("__limit").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    df = df.withColumn("__left", F.sum("__weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))
    df = df.withColumn("__goal", F.sum("source_size").over(everything) * float(total))
    df = df.withColumn("__level", (F.col("__goal") - F.col("__before")) / F.col("__left"))
    # the first source in filling order that its limit doesn't stop sets the level
    stays = F.col("__limit") / F.col("__weight") > F.col("__level")
    level = F.min(F.when(stays, F.struct(F.col("__limit") / F.col("__weight"), F.col("__level").alias("level")))).over(everything)["level"]
    target = F.coalesce(F.least(F.col("__limit"), level * F.col("__weight")), F.col("__limit"))
    return df.select(*_SOURCE, "source_size", target.alias("target"))


def mix(docs: DataFrame, source_col: str, size_col: str, id_col: str, weights: Sequence[float] = WEIGHTS, total: float = TOTAL, most: int = MOST_COPIES, cell_rows: int = CELL_ROWS, seed: int = SEED) -> DataFrame:
    """How often the mix takes each document.

    Args:
        docs: rows with a source, a size (null: 0) and an id; whatever else they have is carried.
        weights, total, most: see ``source_targets``.
        cell_rows: about the most rows that are ordered together, whatever the hot source.

    Returns:
        ``row struct`` (all columns of ``docs``), ``size, source_size long, target double,
        copies long``. Null is a source of its own. Rows of equal id and size follow a hash of
        all their columns (maps aside); where that is equal too, so are the rows. The same rows
        give the same copies whatever their partitions.
    """
    salts = max(1, math.ceil(docs.select(F.count("*")).head()[0] / cell_rows))
    digits = F.substring(F.md5(F.coalesce(F.col("row")[id_col].cast("string"), F.lit(""))), 1, 8)
    df = docs.select(F.struct("*").alias("row")).withColumn("size", F.coalesce(F.col("row")[size_col].cast("long"), F.lit(0)))
    df = df.withColumn("__no_source", F.col("row")[source_col].isNull()).withColumn("__source", F.coalesce(F.col("row")[source_col].cast("string"), F.lit("")))
    bits = F.bin("size")
    df = df.withColumn("__band", F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.substring(bits, 1, 3)))
    df = df.withColumn("__salt", F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(salts)))
    df = df.withColumn("__block", F.floor(F.col("__salt") / BLOCK_SALTS)).repartition(*_CELL)

    # one small row a cell, kept, so that rows are dealt out once for it and once for their places
    cells = written(df.groupBy(*_CELL).agg(F.count("*").alias("__rows"), F.sum("size").alias("__size")))
    blocks = cells.groupBy(*_BLOCK).agg(F.sum("__rows").alias("__rows"), F.sum("__size").alias("__size"))
    targets = source_targets(blocks.groupBy(*_SOURCE).agg(F.sum("__size").alias("source_size")), weights, total, most)
    before = lambda group, *order: F.coalesce(F.sum("__rows").over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("__before", before(_SOURCE, "__band", "__block")).join(targets, _SOURCE).drop("__rows", "__size")
    cells = cells.withColumn("__inside", before(_BLOCK, "__salt")).drop("__rows", "__size").join(blocks, _BLOCK)
    cells = cells.withColumn("__first", F.col("__before") + F.col("__inside"))

    plain = [F.col("row")[f.name] for f in docs.schema if "map<" not in f.dataType.simpleString()]
    place = F.row_number().over(Window.partitionBy(*_CELL).orderBy("size", F.col("row")[id_col], F.xxhash64(*plain)))
    df = df.withColumn("__place", place).join(cells, _CELL)
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("__no_source").cast("string"), F.col("__source"))), 1, 8), 16, 10).cast("double") / float(2**32)
    end = F.col("__first") + F.col("__place")
    crossed = F.floor(offset + copies * end) - F.floor(offset + copies * (end - 1))
    return df.select("row", "size", "source_size", "target", F.least(crossed, F.lit(int(most))).alias("copies"))


def with_copies(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row of ``mix`` as often as it is taken, with its own columns."""
    taken = mixed.filter(F.col("copies") > 0)
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("__copy")).select("row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = written(table(spark, sf_dir, "documents").select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size")))
    mixed = mix(docs, "source", "size", "doc_id")
    return mixed.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP4_SQL = f"""
WITH sized AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
dealt AS (
  SELECT *, lpad(CAST(length(bin(size)) AS VARCHAR), 2, '0') || substr(bin(size), 1, 3) AS band,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)
           % greatest(1, CAST(ceil((SELECT count(*) FROM documents) / {CELL_ROWS}.0) AS BIGINT)) AS salt
  FROM sized),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY no_source, source ORDER BY band, salt, size, doc_id NULLS FIRST) AS place FROM dealt),
sources AS (
  SELECT no_source, source, CAST(sum(size) AS BIGINT) AS source_size,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][CAST(1 + (row_number() OVER (ORDER BY no_source, source) - 1) % 3 AS BIGINT)] AS weight
  FROM sized GROUP BY no_source, source),
filling AS (
  SELECT *, source_size * 2.0::DOUBLE AS most,
         coalesce(sum(source_size * 2.0::DOUBLE) OVER (ORDER BY source_size * 2.0::DOUBLE / weight, no_source, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(weight) OVER (ORDER BY source_size * 2.0::DOUBLE / weight, no_source, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS remaining,
         sum(source_size) OVER () * 1.5::DOUBLE AS goal FROM sources),
levels AS (
  SELECT *, (SELECT min_by((goal - before) / remaining, most / weight) FROM filling WHERE most / weight > (goal - before) / remaining) AS level FROM filling),
targets AS (SELECT no_source, source, source_size, coalesce(least(most, level * weight), most) AS target FROM levels),
drawn AS (
  SELECT p.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS copies,
         CAST('0x' || substr(md5('{SEED}:' || CAST(no_source AS VARCHAR) || source), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM placed p JOIN targets t USING (no_source, source))
SELECT doc_id, size, source_size, target,
       size * CAST(least(floor(u + copies * place) - floor(u + copies * (place - 1)), 2) AS BIGINT) AS taken
FROM drawn
"""
