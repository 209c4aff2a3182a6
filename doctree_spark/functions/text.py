"""Column expressions on text: tokens, sentences, white space, shortened text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Default tokens: runs of letters, up to three digits, runs of other signs.
TOKEN = r"\p{L}+|\p{N}{1,3}|[^\s\p{L}\p{N}]+"
NOTHING_TO_SUMMARISE = "No content to summarize."


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))


def strip(text: Column) -> Column:
    """Without white space of any kind at either end (``trim`` takes blanks only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    """Array of sentences: cut behind . ! ? before white space, stripped, none empty."""
    cut = F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), "\u0001")
    return F.filter(F.transform(cut, strip), lambda s: s != "")


def shortened(text: Column, most: int = 800) -> Column:
    """Extractive summary: at most ``most`` characters, cut at the last full stop before a blank among them."""
    flat = strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    head = F.substring(flat, 1, most)
    # the last ". " wholly inside the head, counted from its end
    behind = F.instr(F.reverse(head), " .")
    kept = F.when(behind > 0, F.substr(head, F.lit(1), most - 1 - behind)).otherwise(head)
    return F.when(flat == "", NOTHING_TO_SUMMARISE).when(F.length(flat) <= most, flat).otherwise(F.concat(strip(kept), F.lit("...")))


def truncated(text: Column, most: int = 800) -> Column:
    """The first ``most`` characters, white space collapsed, and three dots, however short the text is."""
    flat = strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.concat(F.substring(flat, 1, most), F.lit("..."))
