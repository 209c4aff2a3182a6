"""Text from layout blocks, sections, and chunks of whole sentences within a token budget.

Everything from a document to its numbered chunks happens inside its row: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctree_spark.functions.plugins import SENTENCES, TOKENS, Sentences, Tokens
from doctree_spark.functions.text import strip

MARGIN = 0.75
CHUNK_TOKENS = 100
LEAST_TOKENS = 40
STARTS_AT_ONCE = 128
EMPTY = "failed: No extractable text found in the document."


def body_text(blocks: DataFrame, margin: float = MARGIN) -> DataFrame:
    """``document_id, text, kept, dropped``: text blocks left of the margin, in page and block order."""
    good = (F.col("block_type") == 0) & (F.col("x0") < margin * F.col("page_width")) & (strip(F.col("text")) != "")
    good = F.coalesce(good, F.lit(False))
    parts = F.array_sort(F.collect_list(F.when(good, F.struct("page_no", "block_no", strip(F.col("text")).alias("text")))))
    df = blocks.groupBy("document_id").agg(parts.alias("parts"), F.count_if(good).alias("kept"), F.count_if(~good).alias("dropped"))
    return df.select("document_id", F.array_join(F.transform("parts", lambda p: p.text), "\n\n").alias("text"), "kept", "dropped")


def empty_documents(texts: DataFrame) -> DataFrame:
    """``document_id, status`` of documents without text."""
    return texts.filter(strip(F.coalesce("text", F.lit(""))) == "").select("document_id", F.lit(EMPTY).alias("status"))


def with_sections(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``sections``, an array of texts. A heading line begins a section; without one the whole text, unstripped, is the only one.

    A heading is shorter than 60 characters when stripped, ends in neither full stop nor comma,
    doesn't begin with Figure, Table or a digit, has a letter or digit, and has a blank line
    before or behind it.
    """
    df = docs.withColumn("__lines", F.split(F.coalesce(text_col, F.lit("")), "\n"))
    df = df.withColumn("__bare", F.transform("__lines", strip))
    blank = lambda i: F.get("__bare", i) == ""

    def heading(line: Column, i: Column) -> Column:
        shape = (line != "") & (F.length(line) < 60) & ~line.rlike(r"[.,]$") & ~line.rlike(r"^(Figure|Table|\p{N})") & line.rlike(r"[\p{L}\p{N}]")
        return F.when(shape & (F.coalesce(blank(i - 1), F.lit(False)) | F.coalesce(blank(i + 1), F.lit(False))), i)

    df = df.withColumn("__heads", F.array_compact(F.transform("__bare", heading)))
    df = df.withColumn("__starts", F.array_distinct(F.concat(F.array(F.lit(0)), "__heads")))
    end = lambda k: F.coalesce(F.get("__starts", k + 1), F.size("__lines"))
    cut = F.transform("__starts", lambda s, k: strip(F.array_join(F.slice("__lines", s + 1, end(k) - s), "\n")))
    sections = F.when(F.size("__heads") == 0, F.array(F.coalesce(text_col, F.lit("")))).otherwise(F.filter(cut, lambda s: s != ""))
    return df.withColumn("sections", sections).drop("__lines", "__bare", "__heads", "__starts")


def split_sections(docs: DataFrame, id_col: str = "document_id", text_col: str = "text") -> DataFrame:
    """``id_col, section_no, text``."""
    return with_sections(docs, text_col).select(id_col, F.posexplode("sections").alias("section_no", "text"))


def _with_chunks(docs: DataFrame, chunk_tokens: int, text_col: str, tokens: Tokens, split: Sentences) -> DataFrame:
    """Adds ``sections``, ``__sents`` and ``__chunks`` (structs of section and text), before small chunks go.

    One fold finds where chunks begin: with a section, where the budget is spent, and at and
    behind a sentence that is over it alone.
    """
    df = with_sections(docs, text_col)
    df = df.withColumn("__split", split.each(F.col("sections")))
    own = F.transform("__split", lambda s, k: F.transform(s, lambda x: F.struct(k.alias("section"), x.alias("text"))))
    df = df.withColumn("__flat", F.flatten(own)).withColumn("__counts", tokens.each(F.transform("__flat", lambda x: x.text)))
    df = df.withColumn("__sents", F.zip_with("__flat", "__counts", lambda x, n: F.struct(x.section.alias("section"), x.text.alias("text"), n.alias("tokens")))).drop("__split", "__flat", "__counts")
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(0).alias("i"), F.lit(-1).alias("used"), F.lit(-1).alias("section"), none.alias("few"), F.array().cast("array<array<int>>").alias("lists"))

    def step(acc: Column, s: Column) -> Column:
        over = s.tokens > chunk_tokens
        new = over | (acc.used < 0) | (acc.used + s.tokens > chunk_tokens) | (acc.section != s.section)
        used = F.when(over, F.lit(-1)).when(new, s.tokens).otherwise(acc.used + s.tokens)
        # a new chunk copies a short list, and each full one the list of lists, so time follows length
        full = new & (F.size(acc.few) >= STARTS_AT_ONCE)
        lists = F.when(full, F.array_append(acc.lists, acc.few)).otherwise(acc.lists)
        few = F.when(full, F.array(acc.i)).when(new, F.array_append(acc.few, acc.i)).otherwise(acc.few)
        return F.struct((acc.i + 1).alias("i"), used.alias("used"), s.section.alias("section"), few.alias("few"), lists.alias("lists"))

    df = df.withColumn("__starts", F.aggregate("__sents", start, step, lambda acc: F.concat(F.flatten(acc.lists), acc.few)))
    end = lambda k: F.coalesce(F.get("__starts", k + 1), F.size("__sents"))
    text = lambda s, k: F.array_join(F.transform(F.slice("__sents", s + 1, end(k) - s), lambda x: x.text), " ")
    return df.withColumn("__chunks", F.transform("__starts", lambda s, k: F.struct(F.get("__sents", s).section.alias("section_no"), text(s, k).alias("text"))))


def chunk_documents(docs: DataFrame, chunk_tokens: int = CHUNK_TOKENS, least_tokens: int = LEAST_TOKENS, id_col: str = "document_id", text_col: str = "text", tokens: Tokens = TOKENS, split: Sentences = SENTENCES) -> DataFrame:
    """``id_col, chunk_no, section_no, text, token_count``: chunks of at least ``least_tokens``, numbered densely.

    ``tokens`` and ``split`` say how tokens are counted and sentences found (``plugins``).
    """
    df = _with_chunks(docs, chunk_tokens, text_col, tokens, split)
    df = df.withColumn("__counts", tokens.each(F.transform("__chunks", lambda c: c.text)))
    counted = F.zip_with("__chunks", "__counts", lambda c, n: F.struct(c.section_no.alias("section_no"), c.text.alias("text"), n.alias("token_count")))
    df = df.select(id_col, counted.alias("__counted")).select(id_col, F.posexplode(F.filter("__counted", lambda c: c.token_count >= least_tokens)).alias("chunk_no", "c"))
    return df.select(id_col, "chunk_no", "c.section_no", "c.text", "c.token_count")


def chunk_report(docs: DataFrame, chunk_tokens: int = CHUNK_TOKENS, least_tokens: int = LEAST_TOKENS, id_col: str = "document_id", text_col: str = "text", tokens: Tokens = TOKENS, split: Sentences = SENTENCES) -> DataFrame:
    """``id_col, sections, chunks, dropped, oversize``: kept and dropped chunks, and sentences over the budget."""
    df = _with_chunks(docs, chunk_tokens, text_col, tokens, split).withColumn("__counts", tokens.each(F.transform("__chunks", lambda c: c.text)))
    kept = F.size(F.filter("__counts", lambda n: n >= least_tokens))
    df = df.select(id_col, F.size("sections").alias("sections"), kept.alias("chunks"), F.size("__chunks").alias("made"), F.size(F.filter("__sents", lambda s: s.tokens > chunk_tokens)).alias("oversize"))
    return df.select(id_col, "sections", "chunks", (F.col("made") - F.col("chunks")).alias("dropped"), "oversize")
