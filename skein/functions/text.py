"""Text features as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores of any script and length."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


tokens = word_tokens


def sentence_count(text: Column) -> Column:
    """Runs of sentence signs before white space or the end."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[.!?]+(\s|$)"), F.lit(0))).cast("long")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\r]+", -1), lambda t: t != "")).cast("long")


def has_number(text: Column) -> Column:
    return F.coalesce(text.rlike("[0-9]"), F.lit(False))


def has_list(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(^|\n)[ ]*([-*]|[0-9]+\.) "), F.lit(False))


def strip_tags(html: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(bare, "[ \t\n\r]+", " "))
