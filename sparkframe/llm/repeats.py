"""Which windows of a document also start in a document with a smaller number.

A window is ``length`` consecutive symbols: bytes, or words. Documents are dealt into blocks.
Every window is represented by its least-hashed ``gram``, its anchor; equal windows have equal
anchors at equal places, so they meet when anchors are dealt by hash. Neighbouring windows with
the same anchor form one run, and a run travels as one stretch of text, not window by window:

1. Each block sends the hashes of its runs' anchors to buckets. Anchors of one document only end here.
2. For the others, blocks send the stretches of text themselves, one for equal stretches of a block.
3. In each bucket equal stretches become one, and a method the caller gives compares the windows.
4. Blocks put the answers together.

Hashes only deal windows out and rule them out: what is marked as repeated has been compared byte
by byte (``Equal``). Entries travel as packed arrays, one row for each block and bucket, so a
passage in a third of all documents costs one stretch a block. Blocks, buckets and stretches have
bounded sizes whatever the input's size is; only their number grows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkframe.llm import jobs
from sparkframe.llm.tokens import U64, Substrings, bytes_of, forget, mix, sliding_min, slices, span_hashes, spread

BLOCK_BYTES, BUCKET_BYTES, CHUNK_BYTES = 4 << 20, 2 << 20, 1 << 20
_PLACE = U64((1 << 28) - 1)
_REPLY = "block int, bucket int, kind int, payload binary, text binary, sizes binary, counts binary, values binary, index binary"
_BINARY = ("payload", "text", "sizes", "counts", "values", "index")
#: Bytes that are compared at once.
_COMPARED = 1 << 20


def equal_rows(hashes: np.ndarray, order: np.ndarray, same) -> np.ndarray:
    """For each row the first one, by ``order``, that equals it. ``same(rows, firsts)`` compares rows for certain.

    Rows are grouped by their hashes; rows that differ from their group's first one are grouped again
    among themselves, so equal hashes of different rows cost time but change nothing.
    """
    out, rest = np.arange(len(hashes)), np.arange(len(hashes))
    while len(rest):
        rest = rest[np.lexsort((rest, order[rest], hashes[rest]))]
        new = np.ones(len(rest), bool)
        new[1:] = hashes[rest][1:] != hashes[rest][:-1]
        first = rest[new][np.cumsum(new) - 1]
        later = first != rest
        rest, first = rest[later], first[later]
        equal = same(rest, first)
        out[rest[equal]] = first[equal]
        rest = rest[~equal]
    return out


def equal_spans(data: np.ndarray, begin: np.ndarray, size: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each span of bytes the first one, by ``order``, with the same bytes."""

    def same(rows, firsts):
        out = size[rows] == size[firsts]
        pick = np.flatnonzero(out & (size[rows] > 0))
        ends = np.cumsum(size[rows[pick]])
        i = 0
        while i < len(pick):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + _COMPARED, "right")))
            n = size[rows[pick[i:j]]]
            alike = data[spread(begin[rows[pick[i:j]]], n)] == data[spread(begin[firsts[pick[i:j]]], n)]
            out[pick[i:j]] = np.logical_and.reduceat(alike, np.cumsum(n) - n)
            i = j
        return out

    return equal_rows(span_hashes(data, begin, begin + size), order, same)


class Runs:
    """The runs of some documents' windows. Places count from the first symbol of the first."""

    def __init__(self, symbols: np.ndarray, bounds: np.ndarray, length: int, gram: int):
        self.lo = self.n = self.doc = np.zeros(0, np.int64)
        self.anchor = np.zeros(0, U64)
        if len(symbols) < length:
            return
        grams = Substrings(symbols).windows(gram)
        place = np.arange(len(grams), dtype=U64)
        least = sliding_min((grams & ~_PLACE) | place, length - gram + 1) & _PLACE
        sizes = np.diff(bounds)
        valid = spread(bounds[:-1], np.maximum(sizes - length + 1, 0))
        if not len(valid):
            return
        at = least[valid].astype(np.int64)
        new = np.ones(len(valid), bool)
        new[1:] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1] + 1)
        first = np.flatnonzero(new)
        self.lo = valid[first]
        self.n = np.diff(np.append(first, len(valid)))
        self.doc = np.searchsorted(bounds, self.lo, "right") - 1
        self.anchor = mix(grams[at[first]], 0x5851F42D4C957F2D)


class Block:
    """The documents of a block in a fixed order, cut into chunks, with their runs.

    ``symbols(data, offsets)`` gives for some texts: symbols, each text's bounds among them, bytes, and
    where each symbol begins and ends among the bytes.
    """

    def __init__(self, table: pa.Table, order: str, text: str, length: int, gram: int, symbols, buckets: int):
        number = np.asarray(table.column(order).to_numpy(), np.int64)
        rank = _in_order(number, table.column(text))
        self.table, self.buckets = table.take(pa.array(rank)), buckets
        number = number[rank]
        data, offsets = bytes_of(self.table.column(text))
        #: For each chunk: its documents' range, symbols' bounds, bytes, begins and ends, and where its bytes begin in the block's.
        self.chunks, parts, raw, base = [], [], [], 0
        for i, j in slices(offsets, CHUNK_BYTES):
            a, b = offsets[i], offsets[j]
            made, bounds, own, begin, end = symbols(data[a:b], offsets[i : j + 1] - a)
            r = Runs(made, bounds, length, gram)
            first, last = r.lo, r.lo + r.n + length - 2
            parts.append((np.full(len(r.lo), len(self.chunks)), r.lo, r.n, base + begin[first], end[last] - begin[first], number[r.doc + i], r.anchor))
            self.chunks.append((i, j, bounds, own, begin, end))
            raw.append(own)
            base += len(own)
        self.raw = np.concatenate(raw) if raw else np.zeros(0, np.uint8)
        join = lambda k, kind: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kind)
        #: Each run's chunk, first symbol, windows, bytes and document number.
        self.chunk, self.lo, self.n, self.begin, self.size, self.number = (join(k, np.int64) for k in range(6))
        #: Distinct anchors, each run's, and whether several documents here have it.
        self.anchors, self.anchor = np.unique(join(6, U64), return_inverse=True)
        low, high = np.full(len(self.anchors), 2**63 - 1), np.full(len(self.anchors), -(2**63))
        np.minimum.at(low, self.anchor, self.number)
        np.maximum.at(high, self.anchor, self.number)
        self.several = low < high
        self.bucket = ((self.anchors >> U64(32)) % U64(buckets)).astype(np.int64)

    def stretches(self, elsewhere: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs whose anchors several documents have, one for equal ones, the smallest document's; and each run's, or -1."""
        open_ = np.flatnonzero((self.several | elsewhere)[self.anchor])
        of = np.full(len(self.anchor), -1)
        of[open_] = open_[equal_spans(self.raw, self.begin[open_], self.size[open_], self.number[open_])]
        return np.flatnonzero(of == np.arange(len(of))), of


def _in_order(number: np.ndarray, texts) -> np.ndarray:
    """Rows by number; equal numbers by a hash of their texts, so that every read agrees."""
    rank = np.argsort(number, kind="stable")
    same = number[rank][1:] == number[rank][:-1]
    if not same.any():
        return rank
    tied = np.zeros(len(rank), bool)
    tied[1:] |= same
    tied[:-1] |= same
    key = np.zeros(len(rank), np.int64)
    for k in rank[tied]:
        raw = texts[int(k)].as_py() or b""
        key[k] = zlib.crc32(raw.encode() if isinstance(raw, str) else raw)
    return np.lexsort((key, number))


def _rows(rows: list[dict]) -> pa.Table:
    schema = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in _BINARY)])
    return pa.Table.from_pylist([{"kind": 0} | dict.fromkeys(_BINARY, b"") | r for r in rows], schema)


def _by_bucket(bucket: np.ndarray, buckets: int):
    """The indices of each bucket's entries, in order."""
    order = np.argsort(bucket, kind="stable")
    at = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(at)):
        yield int(b), order[at[b] : at[b + 1]]


def _packed(values: np.ndarray) -> bytes:
    return len(values.tobytes()).to_bytes(8, "little") + pa.compress(values.tobytes(), codec="zstd", asbytes=True)


def _unpacked(payload: bytes, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(payload[8:], int.from_bytes(payload[:8], "little"), codec="zstd", asbytes=True), kind)


def repeated_windows(docs: DataFrame, number: str, text: str, length: int, gram: int, symbols, method, finish, schema: T.StructType) -> DataFrame:
    """Apply ``finish`` to every block with its windows marked; see the module's text.

    ``docs`` has ``number`` (long, not null) and ``text`` (string or binary) among its columns, none of
    them named ``__block``. ``method(data, begin, size, counts, number)`` gets different stretches of bytes,
    how many windows each has, and the least number of a document with it; it returns for each window
    whether it also starts in a stretch with a smaller number. ``finish(block, chunks)`` gets the
    block and for each chunk its documents' range, symbols' bounds, bytes, begins, ends and windows' marks.
    """
    size = jobs.total_bytes(docs, text)
    blocks, buckets = jobs.parts_for(size, BLOCK_BYTES, 2), jobs.parts_for(size // 4, BUCKET_BYTES, 8)
    own = "__block"
    dealt = docs.withColumn(own, jobs.hashed_block(blocks, F.col(f"`{number}`"), F.col(f"`{text}`")))
    load = lambda table: Block(table, number, text, length, gram, symbols, buckets)

    def send(table: pa.Table) -> pa.Table:
        forget()
        if not table.num_rows:
            return _rows([])
        block = load(table)
        return _rows([{"block": table.column(own)[0].as_py(), "bucket": b, "values": block.anchors[at].astype(np.uint32).tobytes()} for b, at in _by_bucket(block.bucket, buckets)])

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        sent = [np.frombuffer(r["values"], np.uint32) for r in rows]
        _, which, counts = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
        often = counts[which] > 1  # a block sends an anchor once
        ends = np.cumsum([len(x) for x in sent]).tolist()
        return _rows([{"block": r["block"], "bucket": r["bucket"], "kind": 1, "payload": _packed(np.packbits(often[e - len(x) : e]))} for r, x, e in zip(rows, sent, ends, strict=True)])

    def elsewhere(block: Block, replies: pa.Table) -> np.ndarray:
        out = np.zeros(len(block.anchors), bool)
        got = {r["bucket"]: r["payload"] for r in replies.to_pylist() if r["kind"] == 1}
        for b, at in _by_bucket(block.bucket, buckets):
            out[at] = np.unpackbits(_unpacked(got[b], np.uint8), count=len(at)).astype(bool)
        return out

    def stretches(table: pa.Table, replies: pa.Table) -> pa.Table:
        forget()
        if not table.num_rows:
            return _rows([])
        block = load(table)
        runs, _ = block.stretches(elsewhere(block, replies))
        out = [{k: r[k] for k in ("block", "bucket", "kind", "payload")} for r in replies.to_pylist()]
        for b, at in _by_bucket(block.bucket[block.anchor[runs]], buckets):
            k = runs[at]
            values, index = np.unique(block.number[k], return_inverse=True)
            packed = {"text": block.raw[spread(block.begin[k], block.size[k])], "sizes": block.size[k].astype(np.uint32), "counts": block.n[k].astype(np.uint32), "values": values, "index": index.astype(np.uint32)}
            out.append({"block": table.column(own)[0].as_py(), "bucket": b, "kind": 2} | {c: _packed(v) for c, v in packed.items()})
        return _rows(out)

    def resolve(table: pa.Table) -> pa.Table:
        forget()
        every = table.to_pylist()
        passed = [{k: r[k] for k in ("block", "bucket", "kind", "payload")} for r in every if r["kind"] == 1]
        rows = [r for r in every if r["kind"] == 2]
        if not rows:
            return _rows(passed)
        read = lambda c, kind: np.concatenate([_unpacked(r[c], kind) for r in rows])
        data, sizes, counts = read("text", np.uint8), read("sizes", np.uint32).astype(np.int64), read("counts", np.uint32).astype(np.int64)
        num = np.concatenate([_unpacked(r["values"], np.int64)[_unpacked(r["index"], np.uint32)] for r in rows])
        begin = np.cumsum(sizes) - sizes
        of = equal_spans(data, begin, sizes, num)
        distinct = np.flatnonzero(of == np.arange(len(of)))
        marks = method(data, begin[distinct], sizes[distinct], counts[distinct], num[distinct])
        place = np.zeros(len(of), np.int64)
        place[distinct] = np.cumsum(counts[distinct]) - counts[distinct]
        # A stretch that stands in a smaller document as it is repeats as a whole.
        out = marks[spread(place[of], counts)] | np.repeat(num > num[of], counts)
        each = np.cumsum([len(_unpacked(r["counts"], np.uint32)) for r in rows])
        ends = np.append(0, np.cumsum(counts))
        return _rows(passed + [{"block": r["block"], "bucket": r["bucket"], "kind": 2, "payload": _packed(np.packbits(out[ends[i] : ends[j]]))} for r, i, j in zip(rows, np.append(0, each[:-1]).tolist(), each.tolist(), strict=True)])

    def gather(table: pa.Table, replies: pa.Table) -> pa.Table:
        forget()
        if not table.num_rows:
            return schema_arrow.empty_table()
        block = load(table)
        runs, of = block.stretches(elsewhere(block, replies))
        got = {r["bucket"]: r["payload"] for r in replies.to_pylist() if r["kind"] == 2}
        begin = np.zeros(len(of), np.int64)
        begin[runs] = np.cumsum(block.n[runs]) - block.n[runs]
        marks = np.zeros(int(block.n[runs].sum()), bool)
        for b, at in _by_bucket(block.bucket[block.anchor[runs]], buckets):
            n = block.n[runs[at]]
            marks[spread(begin[runs[at]], n)] = np.unpackbits(_unpacked(got[b], np.uint8), count=int(n.sum())).astype(bool)
        sent = of >= 0
        later = sent & (block.number > block.number[of])

        def marked():
            for c, (i, j, bounds, raw, first, last) in enumerate(block.chunks):
                mark = np.zeros(len(first), bool)
                mine = np.flatnonzero(sent & (block.chunk == c))
                n = block.n[mine]
                mark[spread(block.lo[mine], n)] = marks[spread(begin[of[mine]], n)] | np.repeat(later[mine], n)
                yield i, j, bounds, raw, first, last, mark

        return finish(block, marked())

    schema_arrow = _arrow_schema(schema)
    answers = dealt.groupBy(own).applyInArrow(send, _REPLY).groupBy("bucket").applyInArrow(answer, _REPLY)
    grouped = lambda df: df.groupBy("block")
    asked = dealt.groupBy(own).cogroup(grouped(answers)).applyInArrow(stretches, _REPLY)
    # A block's answers travel on beside its questions, in one group.
    key = F.when(F.col("kind") == 1, -1 - F.col("block").cast("long")).otherwise(F.col("bucket").cast("long")).alias("__key")
    resolved = asked.groupBy(key).applyInArrow(resolve, _REPLY)
    return dealt.groupBy(own).cogroup(grouped(resolved)).applyInArrow(gather, schema)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def own_names(docs: DataFrame, number: str, text: str) -> tuple[DataFrame, str, str]:
    """``docs`` under names of the operator's own, whatever columns it has; the number as a long, null last; and its and the text's names."""
    place = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in place.items()], jobs.is_null_last(F.col(f"`{number}`")).alias("__number"))
    return renamed, "__number", place[text]


def first_names(found: DataFrame, docs: DataFrame, *more: str) -> DataFrame:
    """``row`` (all columns of ``docs``, by their names) and the operator's own columns."""
    return found.select(F.struct(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]).alias("row"), *more)


def covered(mark: np.ndarray, length: int) -> np.ndarray:
    """Symbols under windows that are marked at their first symbol."""
    step = np.zeros(len(mark) + 1, np.int32)
    at = np.flatnonzero(mark)
    step[at] += 1
    step[at + length] -= 1
    return np.cumsum(step[:-1]) > 0
