"""Text helpers that stay inside Spark SQL.

Null texts give null (or 0 words where a count is asked for).
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters other than A-Z that a full lower-casing would change; such texts take the slower exact path.
CASED = r"[^\x00-\x7F&&[\p{Lu}\p{Lt}\p{javaUpperCase}Σİ]]"

#: Words divided by ASCII white space.
SPACED = r"[^\x20\x09-\x0D]+"
#: A character of white space.
SPACES = r"[\x20\x09-\x0D]"

#: Words of letters, digits and all that isn't ASCII, in lower-cased text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What divides such words, in lower-cased text.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words where A-Z are still there.
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
NOT_WORD_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    lower() does that fast for texts in which no other character has case; the rest go through translate().
    """
    exact = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.regexp_like(text, F.lit(CASED)), exact).otherwise(F.lower(text))


def words(lowered: Column) -> Column:
    """Array of the words of a lower-cased text, in order; empty for null."""
    return F.filter(F.split(F.coalesce(lowered, F.lit("")), NOT_WORD), lambda w: w != "")


def count_words(text: Column) -> Column:
    """Number of words, any case; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_ANY_CASE)), F.lit(0)).cast("long")


def count_spaced(text: Column) -> Column:
    """Number of words divided by white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACED)), F.lit(0)).cast("long")


def windows(ws: Column, n: int) -> Column:
    """Array of (pos, gram): every run of ``n`` words as one string, with the index of its first word."""
    starts = F.when(F.size(ws) >= n, F.sequence(F.lit(0), F.size(ws) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("pos"), F.array_join(F.slice(ws, i + 1, n), " ").alias("gram")))


def row_hash(docs: DataFrame) -> Column:
    """Hash of all columns but the text, of any type."""
    own = [docs[f"`{c}`"] for c in docs.columns if c != "text"]
    return F.xxhash64(F.to_json(F.struct(*own))) if own else F.lit(0).cast("long")
