"""Identifiers: parsing the destination out of a route name, and keys as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space is what Python's str.split() takes for it, that is Unicode white space
# (Java's \s under the U flag) and the four separators FS, GS, RS and US.
_LAST_WORD = r"(?U)\A(?s:.*[\s\x1c-\x1f])?([^\s\x1c-\x1f]+)[\s\x1c-\x1f]*\z"
_PLAIN_WORD = r"\A[!-~]+\z"


def last_word(name: Column) -> Column:
    """Last white-space separated word, null where there is none.

    Names normally end in a number after a space. Cutting there and seeing that the number reads and
    prints alike needs no pattern, which is many times faster; words take a short pattern, and only
    what is left goes through the full one.
    """
    tail = F.substring_index(name, " ", -1)
    parsed = F.regexp_extract(name, _LAST_WORD, 1)
    return (
        F.when(tail.try_cast("long").cast("string") == tail, tail)
        .when(tail.rlike(_PLAIN_WORD), tail)
        .when(parsed != "", parsed)
    )


def id_text(df: DataFrame, column: str) -> Column:
    """An id as text. Numbers go through ``long``, since a float would print as ``5.0``."""
    if isinstance(df.select(column).schema[0].dataType, T.StringType):
        return F.col(column)
    return F.col(column).cast("long").cast("string")
