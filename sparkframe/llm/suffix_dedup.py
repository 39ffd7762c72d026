"""Substring removal by a depth-limited radix sort of suffixes, over bytes.

Texts are UTF-8 bytes. A byte goes if a 50-byte string over it also starts in a document with a
smaller number. Suffixes are ordered only through their first 50 bytes. Suffixes that can't repeat,
as no other document has their least-hashed gram, are left out, and the others are dealt by it (see
repeats.py). Each bucket's suffixes are sorted by radix passes, eight bytes at a time from the first,
and a group that holds one document only drops out after each pass. Groups left after the last pass
are exactly the repeated strings; equal stretches of text are sorted as one.

Defined results: a null text is empty; null numbers count as the largest; documents with equal
numbers don't remove from each other; a text under 50 bytes and an empty table lose nothing; texts
may have any length that a string column holds; extra columns, whatever their names, are carried along in ``row``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkframe.llm.repeats import covered, first_names, own_names, repeated_windows
from sparkframe.llm.tokens import BYTE_CODES, column_of, span_column, spans_of, spread

#: Bytes of a repeated string, and of the part of it that deals it out.
LENGTH, GRAM = 50, 22
#: Bytes that one sorting pass compares.
DIGIT = 8


def _symbols(data, offsets):
    place = np.arange(len(data) + 1)
    return BYTE_CODES[data], offsets, data, place[:-1], place[1:]


def radix_groups(values: np.ndarray, starts: np.ndarray, number: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes whose first ``length`` bytes also start in another document, and their groups."""
    alive, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    words = np.lib.stride_tricks.sliding_window_view(values, DIGIT) if len(values) >= DIGIT else np.zeros((0, DIGIT), np.uint8)
    for depth in [*range(0, length - DIGIT + 1, DIGIT), *([length - DIGIT] if length % DIGIT else [])]:
        if not len(alive):
            break
        digit = np.ascontiguousarray(words[starts[alive] + depth]).view(">u8").ravel().astype(np.uint64)
        order = np.lexsort((digit, group)) if depth else np.argsort(digit, kind="stable")
        alive, digit, before = alive[order], digit[order], group[order]
        new = np.ones(len(alive), bool)
        new[1:] = (digit[1:] != digit[:-1]) | (before[1:] != before[:-1])
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        n = number[alive]
        several = (np.minimum.reduceat(n, first) < np.maximum.reduceat(n, first))[group]
        alive, group = alive[several], group[several]
    return alive, group


def _repeated(data, begin, size, counts, number):
    starts = spread(begin, counts)
    number = np.repeat(number, counts)
    marks = np.zeros(len(starts), bool)
    alive, group = radix_groups(data, starts, number, LENGTH)
    if len(alive):
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        least = np.repeat(np.minimum.reduceat(number[alive], first), np.diff(np.append(first, len(alive))))
        marks[alive] = number[alive] > least
    return marks


def remove_repeats(docs: DataFrame, number: str = "doc_id", text: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs``), ``kept`` (the bytes that stay), ``n_bytes``, ``removed`` (spans of bytes)."""
    renamed, key, column = own_names(docs, number, text)
    names = [f"c{i}" for i in range(len(docs.columns))]
    span = T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([*[renamed.schema[c] for c in names], T.StructField("kept", T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("removed", T.ArrayType(span))])

    def finish(block, chunks):
        parts = []
        for i, j, bounds, raw, _, _, mark in chunks:
            gone = covered(mark, LENGTH)
            stays = np.zeros(len(gone) + 1, np.int64)
            np.cumsum(~gone, out=stays[1:])
            kept = column_of(raw[~gone], stays[bounds], binary=True)
            columns = [block.table.column(c).slice(i, j - i).combine_chunks() for c in names]
            parts.append(pa.table([*columns, kept, pa.array(np.diff(bounds)), span_column(*spans_of(gone, bounds))], names=[f.name for f in schema]))
        return pa.concat_tables(parts)

    found = repeated_windows(renamed, key, column, LENGTH, GRAM, _symbols, _repeated, finish, schema)
    return first_names(found, docs, "kept", "n_bytes", "removed")


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = remove_repeats(docs)
    return found.select("row.doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
