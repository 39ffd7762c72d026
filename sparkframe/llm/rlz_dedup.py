"""Substring removal over words by relative Lempel-Ziv parsing.

A document is parsed against all documents with smaller numbers. These can't stand in one place, so
stretches of words are dealt by content into reference blocks (see repeats.py): every 13 words that
two documents share meet in one block. A block indexes its stretches' 13-word windows. Each
stretch is parsed greedily from its first word: where an earlier document has the next 13 words, the
match with the first such document is carried on for as long as both agree and becomes a factor;
elsewhere one word is a literal. A greedy parse misses windows across the end of a factor, so these are
looked up in the index one by one. Words under factors, and under windows found at their ends, go.
Words and windows are compared byte by byte; hashes only bring together what may be equal.

Defined results: a null text has no words; null numbers count as the largest; documents with equal
numbers don't remove from each other; a text under 13 words and an empty table lose nothing; texts
may have any length that a string column holds; extra columns, whatever their names, are carried along in ``row``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkframe.llm.repeats import covered, equal_rows, equal_spans, first_names, own_names, repeated_windows
from sparkframe.llm.tokens import U64, column_of, mix, span_column, span_hashes, spans_of, spread, word_spans

#: Words of a window, and of the part of it that deals it out.
LENGTH, GRAM = 13, 5


def _symbols(data, offsets):
    starts, ends, bounds = word_spans(data, offsets)
    hashes = span_hashes(data, starts, ends)
    # From here on, words have one space between them.
    sizes = ends - starts
    begin = np.cumsum(sizes + 1) - sizes - 1
    raw = np.full(int((sizes + 1).sum()), 0x20, np.uint8)
    raw[spread(begin, sizes)] = data[spread(starts, sizes)]
    return hashes, bounds, raw, begin, begin + sizes


def sources(ids: np.ndarray, bounds: np.ndarray, number: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each place the place where a sequence with a smaller number first has the same ``length`` ids, else -1.

    The first one is that of the sequence with the smallest number, the first place in it.
    """
    out = np.full(len(ids), -1)
    starts = spread(bounds[:-1], np.maximum(np.diff(bounds) - length + 1, 0))
    if not len(starts):
        return out
    owner = number[np.searchsorted(bounds, starts, "right") - 1]
    hashes = np.zeros(len(starts), U64)
    for k in range(length):
        hashes = mix(hashes ^ ids[starts + k].astype(U64), k + 1)

    def same(rows, firsts):
        alike = np.ones(len(rows), bool)
        for k in range(length):
            alike &= ids[starts[rows] + k] == ids[starts[firsts] + k]
        return alike

    first = equal_rows(hashes, owner, same)
    earlier = owner[first] < owner
    out[starts[earlier]] = starts[first[earlier]]
    return out


def parse(ids: np.ndarray, bounds: np.ndarray, number: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(begin, size, source) of every factor, by begin, and the index' answers that it was made from.

    All sequences are parsed side by side. What lies between factors are literals.
    """
    source = sources(ids, bounds, number, length)
    end = np.repeat(bounds[1:], np.diff(bounds))
    # The next place from each on where a match begins.
    following = np.where(source >= 0, np.arange(len(ids)), len(ids))
    following = np.append(np.minimum.accumulate(following[::-1])[::-1], len(ids)) if len(ids) else np.zeros(1, np.int64)
    at, stop, found = bounds[:-1].copy(), bounds[1:], []
    while True:
        begin = following[at]
        goes = begin < stop
        begin, stop = begin[goes], stop[goes]
        if not len(begin):
            break
        size = np.full(len(begin), length)
        longer = np.arange(len(begin))
        while len(longer):
            p, q = begin[longer] + size[longer], source[begin[longer]] + size[longer]
            inside = (p < stop[longer]) & (q < end[source[begin[longer]]])
            longer, p, q = longer[inside], p[inside], q[inside]
            longer = longer[ids[p] == ids[q]]
            size[longer] += 1
        found.append((begin, size, source[begin]))
        at = begin + size
    if not found:
        return *(np.zeros(0, np.int64) for _ in range(3)), source
    begin, size, where = (np.concatenate([f[k] for f in found]) for k in range(3))
    order = np.argsort(begin, kind="stable")
    return begin[order], size[order], where[order], source


def _repeated(data, begin, size, counts, number):
    """Which windows of the stretches of a reference block lie in a factor, or over a factor's end and in the index."""
    offsets = np.append(0, np.cumsum(size))
    data = data[spread(begin, size)]
    starts, ends, bounds = word_spans(data, offsets)
    ids = equal_spans(data, starts, ends - starts, np.arange(len(starts)))
    first, long, _, source = parse(ids, bounds, number)
    marks = np.zeros(len(ids), bool)
    marks[spread(first, long - LENGTH + 1)] = True
    across = spread(first + long - LENGTH + 1, np.full(len(first), LENGTH - 1))
    across = across[across < len(ids)]
    marks[across[source[across] >= 0]] = True
    return marks[spread(bounds[:-1], counts)]


def _joined(data, starts, ends, keep, bounds):
    """Each row's kept words with one space between."""
    n = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(keep, out=n[1:])
    per_row = n[bounds]
    starts, sizes = starts[keep], (ends - starts)[keep]
    lead = np.ones(len(starts), np.int64)  # a space before each word but a row's first
    lead[per_row[:-1][np.diff(per_row) > 0]] = 0
    begin = np.cumsum(sizes + lead) - sizes
    out = np.full(int((sizes + lead).sum()), 0x20, np.uint8)
    out[spread(begin, sizes)] = data[spread(starts, sizes)]
    total = np.append(0, np.cumsum(sizes + lead))
    return column_of(out, total[per_row])


def remove_repeats(docs: DataFrame, number: str = "doc_id", text: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs``), ``kept`` (the words that stay, with one space between), ``n_words``, ``n_removed``, ``removed`` (spans of words)."""
    renamed, key, column = own_names(docs, number, text)
    names = [f"c{i}" for i in range(len(docs.columns))]
    span = T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([*[renamed.schema[c] for c in names], T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.ArrayType(span))])

    def finish(block, chunks):
        parts = []
        for i, j, bounds, raw, first, last, mark in chunks:
            gone = covered(mark, LENGTH)
            n = np.zeros(len(gone) + 1, np.int64)
            np.cumsum(gone, out=n[1:])
            columns = [block.table.column(c).slice(i, j - i).combine_chunks() for c in names]
            parts.append(pa.table([*columns, _joined(raw, first, last, ~gone, bounds), pa.array(np.diff(bounds)), pa.array(np.diff(n[bounds])), span_column(*spans_of(gone, bounds))], names=[f.name for f in schema]))
        return pa.concat_tables(parts)

    found = repeated_windows(renamed, key, column, LENGTH, GRAM, _symbols, _repeated, finish, schema)
    return first_names(found, docs, "kept", "n_words", "n_removed", "removed")


def without_repeats(docs: DataFrame, number: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated words cut out of the texts; a text without any stays as it is.

    A document whose words all repeat has nothing left and goes. A column ``n_chars`` follows.
    """
    found = remove_repeats(docs, number, text).filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    own = lambda c: F.col("row").getField(c)
    cut = F.col("n_removed") > 0
    new = {text: F.when(cut, F.col("kept")).otherwise(own(text))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.char_length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(own("n_chars"))
    return found.select(*[new.get(c, own(c)).alias(c) for c in docs.columns])


def op9_rlz_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
