"""Text columns: labels, words, offsets, canonical forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of letters or digits.
WORD = r"[\p{L}\p{N}]+"
#: Tokens of the scoped search: letters or digits, then also _ ' -
SEARCH_TOKEN = r"[\p{L}\p{N}][\p{L}\p{N}_'-]*"
#: Tokens of the baseline search, ASCII only.
ASCII_TOKEN = r"[a-z0-9][a-z0-9'-]*"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: str | Column) -> Column:
    """Without white space (any Unicode white space) at either end."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def label(c: str | Column) -> Column:
    """A reference or label as it is compared: trimmed, lower case; blank becomes null."""
    t = F.lower(trimmed(c))
    return F.when(t != "", t)


def hyphened(c: str | Column) -> Column:
    """A category label: as ``label``, each run of white space or underscores one hyphen."""
    return F.regexp_replace(label(c), r"(?U)[\s_]+", "-")


def words(c: str | Column) -> Column:
    """Array of the words in order of appearance, lower case; null text has none."""
    return tokens(c, WORD)


def tokens(c: str | Column, pattern: str = SEARCH_TOKEN) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(col(c)), F.lit(pattern), F.lit(0)),
                      F.array().cast("array<string>"))


def utf16_length(c: str | Column) -> Column:
    """Length in UTF-16 code units, the unit of stored offsets."""
    return (F.octet_length(F.encode(col(c), "UTF-16BE")) / 2).cast("int")
