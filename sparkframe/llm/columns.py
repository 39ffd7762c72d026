"""Column expressions over texts that the native operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates words: space, and tab to carriage return.
BLANK = r"[\x20\x09-\x0D]+"
NONBLANK = r"[^\x20\x09-\x0D]"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")


def n_words(text: Column) -> Column:
    """Number of words as a long: the pieces between blanks, less the empty ones at either end."""
    t = F.coalesce(text, F.lit(""))
    pieces = F.size(F.split(t, BLANK))
    return (pieces - (~t.rlike(r"\A" + NONBLANK)).cast("int") - (t.rlike(r"[\x20\x09-\x0D]\z")).cast("int")).cast("long")


def carried(docs, **extra: Column):
    """One struct ``row`` with all columns of ``docs``, beside the extra ones, so that no names clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in extra.items()])
