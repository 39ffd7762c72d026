"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

A document longer than the capacity is cut into full pieces after a shorter first one. Pieces of one
length are alike, so packing works on counts of lengths, at most ``capacity`` of them, whatever the
number of documents: pieces over a third of the capacity stand at most two to a sequence, matched
greedily from the longest with the longest that still fits; smaller ones, longest first, go to the
tightest gap that takes them, and new sequences open when none does. The plan is a list of ranges of
ranks within a length; each piece finds its place from its rank, which is counted in two levels, so
that no length gathers in one task.

Defined results: a null text is empty and has the end token alone; equal rows are packed each by
itself; an empty table gives no rows; only the named columns are used.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkframe.llm import bpe, jobs

CAPACITY, END_ID = 2048, 0
#: Pieces of a length that are ranked in one task.
_RANKED = 200_000


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, pieces, first sequence, offset, pieces a sequence): where each length's ranks go."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    gaps: dict[int, list] = defaultdict(list)  # gap -> [sequences, contents]

    def put(n: int, contents: tuple, used: int) -> None:
        if n:
            gaps[capacity - used].append((n, contents))

    third = capacity // 3
    for a in range(capacity, third, -1):
        while left[a]:
            fits = min(a, capacity - a)
            found = np.flatnonzero(left[third + 1 : fits + 1]) if fits > third else np.zeros(0, int)
            b = third + 1 + int(found[-1]) if len(found) else 0
            n = int(left[a]) if not b else int(left[a]) // 2 if a == b else min(int(left[a]), int(left[b]))
            if not n:  # one is left that could only match itself
                found = found[:-1]
                b = third + 1 + int(found[-1]) if len(found) else 0
                n = 1
            left[a] -= n
            if b:
                left[b] -= n
            put(n, ((a, 0, 1), (b, a, 1)) if b else ((a, 0, 1),), a + b)
    for a in range(third, 0, -1):
        while left[a]:
            gap = next((g for g in range(a, capacity + 1) if gaps.get(g)), None)
            if gap is None:
                n, contents, gap = 1 << 62, (), capacity
            else:
                n, contents = gaps[gap].pop()
            each = min(gap // a, int(left[a]))
            taken = min(n, int(left[a]) // each)
            left[a] -= taken * each
            if contents and n > taken:
                gaps[gap].append((n - taken, contents))
            put(taken, (*contents, (a, capacity - gap, each)), capacity - gap + each * a)
    out, rank, sequence = [], defaultdict(int), 0
    for gap in sorted(gaps):
        for n, contents in gaps[gap]:
            for length, offset, each in contents:
                out.append((length, rank[length], n * each, sequence, offset, each))
                rank[length] += n * each
            sequence += n
    return out


def pieces(docs: DataFrame, number: str, text: str, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(number, piece, start, length, ids_crc32) of every piece of every document."""

    def run(batches):
        for batch in batches:
            for i, j, ids, bounds in bpe.encoded_chunks(batch, text, path):
                rows = batch.column(number).slice(i, j - i).to_pylist()
                out = []
                for k, doc in enumerate(rows):
                    own = np.append(ids[bounds[k] : bounds[k + 1]], np.uint32(end_id)).astype("<u4")
                    cut = [0, *range((len(own) - 1) % capacity + 1, len(own) + 1, capacity)]
                    out += [(doc, p, a, b - a, zlib.crc32(own[a:b])) for p, (a, b) in enumerate(zip(cut, cut[1:], strict=False))]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(f"`{number}`").cast("long").alias(number), F.col(f"`{text}`").alias(text)).mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, number: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents with ``sequence_id`` and ``offset``; sequences are filled from 0 without gaps."""
    cut = jobs.written(pieces(docs, number, text, path or bpe.default_path(), capacity, end_id), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # one row a length
    runs = sorted(plan(counts, capacity))
    table = np.array(runs, np.int64).reshape(-1, 6)
    salts = jobs.parts_for(max(counts.values(), default=1), _RANKED)
    salted = cut.withColumn("salt", jobs.hashed_block(salts, F.col("id"), F.col("piece"), F.col("ids_crc32")))
    before = salted.groupBy("length", "salt").count().withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).drop("count")
    ranked = salted.withColumn("r", F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "salt"]).withColumn("r", F.col("r") + F.col("before")).drop("salt", "before")

    def place(batches):
        base = table[:, 0] << 40 | table[:, 1]
        for batch in batches:
            length, r = batch.column("length").to_numpy(), batch.column("r").to_numpy()
            k = np.searchsorted(base, length << 40 | r, "right") - 1
            within = r - table[k, 1]
            columns = [batch.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(table[k, 3] + within // table[k, 5]), pa.array(table[k, 4] + within % table[k, 5] * table[k, 0])], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("id", "piece", "start", "length", "ids_crc32", F.col("r").cast("long").alias("r")).mapInArrow(place, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("id", number)


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
