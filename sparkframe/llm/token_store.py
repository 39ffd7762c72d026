"""Token ids in files of directly addressable codes.

An id is split into chunks of eight bits, lowest first. Level 0 holds every id's lowest chunk; a bit
beside it says whether more follow, and level k + 1 holds the next chunks of just those ids. A rank
directory counts the bits set before every 512, so any id is found from its place by one count a
level, without decoding others.

File: magic, the length and crc32 of what follows, then 64-bit little-endian numbers (partition, file
within it, documents, ids, levels), document numbers, a byte each that tells null, document bounds,
and for each level its length, its chunks, its continuation bits and its directory.
Files are written and read by Spark, on whatever file system the shared folder is; a task that is run
again writes its files anew. A file whose bytes were changed on the way, or whose directory doesn't
lead to each document's end token, is refused.

Defined results: a null text is empty and has the end token alone; null numbers come first, equal
numbers in the order of a hash of their texts; an empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkframe.llm import bpe, jobs

MAGIC, END_ID = b"SFDAC002", 2
_DIRECTORY = 512
#: Ids of a file, and bytes of text that one writing task takes.
FILE_IDS, TASK_BYTES = 4 << 20, 24 << 20


def encode(ids: np.ndarray, bounds: np.ndarray, numbers: list, place: tuple[int, int] = (0, 0)) -> bytes:
    """One file with these documents' ids."""
    levels, rest = [], np.ascontiguousarray(ids, np.uint32)
    while len(rest) or not levels:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (_DIRECTORY // 8), np.uint8)])
        ones = np.bitwise_count(bits).reshape(-1, _DIRECTORY // 8).sum(axis=1)
        levels.append((rest.astype(np.uint8), bits, (np.cumsum(ones) - ones).astype("<u4")))
        rest = rest[more] >> 8
    out = [struct.pack("<5q", *place, len(numbers), len(ids), len(levels)), np.array([x or 0 for x in numbers], "<i8").tobytes(), np.array([x is None for x in numbers], np.uint8).tobytes(), np.asarray(bounds, "<i8").tobytes()]
    for chunks, bits, directory in levels:
        out += [struct.pack("<q", len(chunks)), chunks.tobytes(), bits.tobytes(), directory.tobytes()]
    body = b"".join(out)
    return MAGIC + struct.pack("<qI", len(body), zlib.crc32(body)) + body


class TokenFile:
    """A file's documents, and any id by its place."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC or len(raw) < 60:
            raise ValueError("not a file of token ids")
        size, crc = struct.unpack_from("<qI", raw, 8)
        if len(raw) < 20 + size or zlib.crc32(memoryview(raw)[20 : 20 + size]) != crc:
            raise ValueError("a file of token ids was changed")
        self.partition, self.index, docs, self.n, levels = struct.unpack_from("<5q", raw, 20)
        at = 60

        def take(kind, n):
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        self.numbers, self.null, self.bounds, self.levels = take("<i8", docs), take(np.uint8, docs).astype(bool), take("<i8", docs + 1), []
        for _ in range(levels):
            n = int(take("<i8", 1)[0])
            blocks = -(-n // _DIRECTORY)
            self.levels.append((take(np.uint8, n), take(np.uint8, blocks * _DIRECTORY // 8), take("<u4", blocks)))

    def __getitem__(self, i: int) -> int:
        """The id at place ``i``, reading one chunk and one directory entry a level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value, shift = 0, 0
        for chunks, bits, directory in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // _DIRECTORY
            own = bits[block * _DIRECTORY // 8 : (i >> 3) + 1].copy()
            own[-1] &= (1 << (i & 7)) - 1
            i, shift = int(directory[block]) + int(np.bitwise_count(own).sum()), shift + 8
        return value

    def take(self, places: np.ndarray) -> np.ndarray:
        """The ids at any places, each found by the directories alone."""
        at, which, shift = np.asarray(places, np.int64).copy(), np.arange(len(places)), 0
        if len(at) and not (0 <= at.min() and at.max() < self.n):
            raise IndexError("a place outside of the file")
        out = np.zeros(len(at), np.uint32)
        for chunks, bits, directory in self.levels:
            out[which] |= chunks[at].astype(np.uint32) << np.uint32(shift)
            more = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            at, which = at[more], which[more]
            if not len(at):
                break
            # Bits set before: the directory's count, and those of the block's bytes up to the place.
            block = at // _DIRECTORY
            own = bits.reshape(-1, _DIRECTORY // 8)[block]
            inside = np.arange(_DIRECTORY // 8)[None] * 8
            left = np.clip((at - block * _DIRECTORY)[:, None] - inside, 0, 8)
            set_before = np.bitwise_count(own & ((1 << left) - 1).astype(np.uint8)).sum(axis=1, dtype=np.int64)
            at, shift = directory[block].astype(np.int64) + set_before, shift + 8
        return out

    def ids(self) -> np.ndarray:
        """All ids, level by level."""
        out, where = np.zeros(self.n, np.uint32), np.arange(self.n)
        for k, (chunks, bits, _) in enumerate(self.levels):
            out[where] |= chunks.astype(np.uint32) << np.uint32(8 * k)
            where = where[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)]
        return out


def write(docs: DataFrame, number: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = END_ID, folder: str | None = None) -> str:
    """Write all texts' ids, each text's end token after them, in ascending order of ``number``; the folder's path."""
    spark, path = docs.sparkSession, path or bpe.default_path()
    folder = folder or jobs.new_path(spark, "tokens")
    known = docs.select(F.col(f"`{number}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    tasks = jobs.parts_for(jobs.total_bytes(known, "text"), TASK_BYTES, 2)

    def run(batches):
        where, index = TaskContext.get().partitionId(), 0
        numbers, parts, size = [], [], 0

        def flush():
            bounds = np.append(0, np.cumsum([len(x) for x in parts]))
            blob = encode(np.concatenate(parts), bounds, numbers, (where, index))
            return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["file"])

        for batch in batches:
            for i, j, ids, bounds in bpe.encoded_chunks(batch, "text", path):
                for k, doc in enumerate(batch.column("id").slice(i, j - i).to_pylist()):
                    numbers.append(doc)
                    parts.append(np.append(ids[bounds[k] : bounds[k + 1]], np.uint32(end_id)))
                    size += len(parts[-1])
                    if size >= FILE_IDS:
                        yield flush()
                        numbers, parts, size, index = [], [], 0, index + 1
        if numbers:
            yield flush()

    ordered = known.repartitionByRange(tasks, F.col("id"), F.xxhash64("text")).sortWithinPartitions(F.col("id"), F.xxhash64("text"), "text")
    files = ordered.mapInArrow(run, "file binary")
    # The text writer writes a string's bytes as they are, and one line end after them.
    with jobs.small_batches(spark):
        files.select(F.col("file").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    return folder


def read(spark, folder: str, end_id: int = END_ID) -> DataFrame:
    """(number, start, n_tokens, ids_crc32) of every document, from the files alone."""

    def run(batches):
        for batch in batches:
            for raw in batch.column("content"):
                f = TokenFile(raw.as_buffer().to_pybytes())
                ids, n = f.ids().astype("<u4"), np.diff(f.bounds)
                if (f.take(f.bounds[1:] - 1) != end_id).any():
                    raise ValueError("a document in a file of token ids doesn't end with the end token")
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(f.bounds[:-1], f.bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), f.partition)), pa.array(np.full(len(n), f.index)), pa.array(f.numbers, pa.int64(), mask=f.null), pa.array(f.bounds[:-1]), pa.array(n), pa.array(crc, pa.int64())], ["part", "file", "id", "start", "n_tokens", "ids_crc32"])

    content = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    docs = jobs.written(content.mapInArrow(run, "part long, file long, id long, start long, n_tokens long, ids_crc32 long"), "token-rows")
    # Files before this one: totals of partitions, then of a partition's files.
    files = docs.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"))
    within = files.withColumn("within", F.sum("n").over(Window.partitionBy("part").orderBy("file")) - F.col("n"))
    parts = files.groupBy("part").agg(F.sum("n").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    starts = within.select("part", "file", "within").join(parts.select("part", "before"), "part")
    return docs.join(starts, ["part", "file"]).select("id", (F.col("start") + F.col("within") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op4_token_store(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read(spark, write(docs)).withColumnRenamed("id", "doc_id")
