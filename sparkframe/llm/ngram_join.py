"""Near duplicates: a parity-sketch join on sets of word five-grams, Jaccard 0.75 or more.

The sketch of a set has p words; each shingle's hash picks one word and is XORed into it. A shingle
in one set but not in the other changes at most one word, so the words in which two sketches differ
(their Hamming distance) are at most as many as the sets' symmetric difference d. Sets a <= b with
100 |A & B| >= 75 |A | B| have d <= (a + b) / 7. With p words, of which z are empty in both, at least
p - d - z words that aren't empty agree: the pigeonhole. Documents are joined on (size band, place,
word); a set takes part in its own band's sketch and, as the smaller side, in the next band's. A
document with too many empty words for the bound also sends sketches with other seeds, until one
has few enough; since both sides of a pair send all seeds up to their first good one, no pair is lost.

A group of more than ``HOT`` documents is hot. A document is sure to share s words with any set it
links with, so it leaves its hottest groups, s - 1 words of them at most: the coldest word that a
linked pair shares is never among them, as all documents rank the groups alike. A passage that many
documents hold thus doesn't pair them all. Equal sets stand for one document.

Links are found without emitting all pairs of a group, in three steps, each on the components of the one before:

1. Each group's best document is paired with the others. The best is the one whose groups are largest, which among
   near copies is the text they come from, or what is nearest to it.
2. The best document outside of that one's component is paired with the rest.
3. Documents still outside are compared with all of their group, in cells of bounded size. A cell first finds
   by parity bits what may link, then by the whole sets what does, and gives out a spanning forest
   of either, so never more rows than it has documents.

Pairs are verified on the whole sets. A pair left out is one whose ends are already joined, or whose sizes or
bits differ too much. Sets hold 64-bit hashes of shingles.

Defined results: words are lower-cased A-Z; a text with one to four words has its whole sequence as
one shingle; null, empty and blank texts have none and link with nothing, nor do null numbers;
rows that share a number count as one document per distinct text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkframe.llm import jobs
from sparkframe.llm.columns import carried
from sparkframe.llm.components import components
from sparkframe.llm.tokens import LOWER, U64, bytes_of, column_of, give_back, lean, mix, slices, span_hashes, spread, word_spans

SHINGLE, NUM, DEN = 5, 75, 100
CHUNK_BYTES, BUCKET_BYTES = 2 << 20, 16 << 20
#: Sizes of a band lie within this factor, and a sketch has this many words for each shingle of the band's largest set.
BAND, DENSITY = DEN / NUM, 0.42
#: A group of more documents than this is hot.
HOT = 16
#: 64-bit words of the folded sketches at most; documents, and shingles of them all, in a block that a cell compares with another.
SHORT_WORDS, CELL, CELL_SHINGLES = 256, 512, 1 << 19


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingle hashes, sorted, end to end, and where each row's begin."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    n = np.diff(first)
    rows = len(n)
    long = n >= SHINGLE
    at = spread(first[:-1][long], (n - SHINGLE + 1)[long])
    hashes = np.full(len(at), 0x2545F4914F6CDD1D, U64)
    for k in range(SHINGLE):
        hashes = mix(hashes + words[at + k], k + 1)
    owner = np.repeat(np.flatnonzero(long), (n - SHINGLE + 1)[long])
    short = np.flatnonzero((n > 0) & ~long)
    if len(short):
        whole = np.full(len(short), 0x9E3779B97F4A7C15, U64) * (n[short] + 1).astype(U64)
        for k in range(SHINGLE - 1):
            has = n[short] > k
            whole[has] = mix(whole[has] + words[first[short[has]] + k], k + 1)
        hashes, owner = np.concatenate([hashes, whole]), np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(rows + 1))


def digests(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two 64-bit sums that stand for each row's set."""
    sums = np.zeros((2, len(hashes) + 1), U64)
    np.cumsum(mix(hashes, 0x1234567), out=sums[0, 1:])
    np.cumsum(mix(hashes, 0x89ABCDEF), out=sums[1, 1:])
    return mix(sums[:, bounds[1:]] - sums[:, bounds[:-1]])


def band_of(sizes: np.ndarray) -> np.ndarray:
    return np.searchsorted(_BAND_STARTS, sizes, "right") - 1


def _band_starts() -> np.ndarray:
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(np.ceil(out[-1] * BAND))))
    return np.array(out)


_BAND_STARTS = _band_starts()
_BAND_ENDS = _BAND_STARTS[1:] - 1


def sketch_words(band: np.ndarray) -> np.ndarray:
    """Number of words in a band's sketch: over (2 r) / 7 for its largest set r, plus room for empty words."""
    r = _BAND_ENDS[band]
    return np.maximum(2 * r // 7 + 1, np.ceil(DENSITY * r).astype(np.int64))


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, row of each, step of each, sure): every word of every sketch that a row sends, unless empty.

    Step 0 is the sketch of the row's own band, 1 that of the next. ``sure`` has for each step and
    row how many words that aren't empty agree at least with any set it links with; 0 for a row
    that sends more seeds than one.
    """
    n = np.diff(bounds)
    rows_out, keys_out, steps_out, sure = [], [], [], np.zeros((2, len(n)), np.int64)
    for step in (0, 1):
        todo = np.flatnonzero(n > 0)
        seed = 0
        while len(todo):
            sizes = n[todo]
            band = band_of(sizes) + step
            p = sketch_words(band)
            most = np.minimum(sizes * DEN // NUM, _BAND_ENDS[band])
            differ = (sizes + most) // 7
            at = spread(bounds[todo], sizes)
            row = np.repeat(np.arange(len(todo)), sizes)
            h = mix(hashes[at], 0xA5A5A5A5 + 977 * seed)
            place = ((h >> U64(32)) * p[row].astype(U64)) >> U64(32)
            slot = (np.cumsum(p) - p)[row] + place.astype(np.int64)
            order = np.argsort(slot, kind="stable")
            slots = slot[order]
            start = np.flatnonzero(np.append(True, slots[1:] != slots[:-1]))
            word = np.bitwise_xor.reduceat(mix(h[order], 0x3C3C3C3C), start)
            row, place = row[order][start], place[order][start]
            keys_out.append(mix(word + mix(place + (band[row].astype(U64) << U64(32)) + (U64(seed) << U64(48)))))
            rows_out.append(todo[row])
            steps_out.append(np.full(len(row), step, np.int64))
            agree = np.bincount(row, minlength=len(todo)) - differ
            if not seed:
                sure[step, todo] = np.clip(agree, 0, 65535)
            todo = todo[agree < 1]
            seed += 1
    if not keys_out:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), sure
    return np.concatenate(keys_out), np.concatenate(rows_out), np.concatenate(steps_out), sure


def _sets_of(batch, number: str, text: str):
    """For each chunk of an Arrow batch: numbers, set hashes and bounds."""
    data, offsets = bytes_of(batch.column(text))
    number = np.asarray(batch.column(number).to_numpy(zero_copy_only=False), np.int64)
    for i, j in slices(offsets, CHUNK_BYTES):
        yield number[i:j], *shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def bit_sketches(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's parity bits, packed: every shingle flips one of 2^k bits, twice the shingles or more, 64 at least.

    Bits that differ are at most the shingles that differ. Half of a sketch XOR its other half is
    the sketch of half the bits, so sketches of any two lengths compare.
    """
    n = np.diff(bounds)
    size = 1 << np.maximum(6, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64) + 1)
    begin = np.append(0, np.cumsum(size))
    row = np.repeat(np.arange(len(n)), n)
    at = begin[row] + (mix(hashes, 0x77777) & (size[row] - 1).astype(U64)).astype(np.int64)
    bits = np.bincount(at, minlength=begin[-1]).astype(np.uint8) & 1
    return np.packbits(bits, bitorder="little"), begin // 8


def differing_bits(x: bytes, y: bytes) -> int:
    """The Hamming distance of two sketches, the longer folded to the shorter's length."""
    a, b = np.frombuffer(x, U64), np.frombuffer(y, U64)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Sketches, a row each, folded to so many 64-bit words."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def describe(docs: DataFrame, number: str, text: str) -> DataFrame:
    """(number, n, d0, d1, bits, short) of every row: its set's size, digest, parity bits, and these folded once and to ``SHORT_WORDS`` words at most."""

    def run(batches):
        for batch in batches:
            for num, hashes, bounds in _sets_of(batch, number, text):
                d = digests(hashes, bounds).view(np.int64)
                bits, at = bit_sketches(hashes, bounds)
                short = [folded(bits[i:j].view(U64)[None], min(SHORT_WORDS, max(1, (j - i) // 16))).tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(num), pa.array(np.diff(bounds)), pa.array(d[0]), pa.array(d[1]), column_of(bits, at, binary=True), pa.array(short, pa.binary())], ["id", "n", "d0", "d1", "bits", "short"])

    return docs.select(number, text).mapInArrow(lean(run), "id long, n long, d0 long, d1 long, bits binary, short binary")


_BLOB = "bucket int, keys binary, place binary, step binary, id binary, n binary, d binary, sure binary"
#: Rows of ``_candidate_groups``: a group (documents and sizes), a hot group (and each one's 2 * sure + step;
#: ``times`` words have it), and counts of words in hot groups (documents, how many, and 2 * sure + step).
COLD, HOT_GROUP, HEAT = 0, 1, 2
_GROUPS = "kind int, members array<long>, sizes array<long>, more array<long>, times long"


def _candidate_groups(docs: DataFrame, number: str, text: str, buckets: int) -> DataFrame:
    """Groups of documents that agree in a sketch word, by number, equal sets as one. Distinct within a bucket."""

    def send(batches):
        for batch in batches:
            for num, hashes, bounds in _sets_of(batch, number, text):
                d = digests(hashes, bounds)[0]
                order = np.lexsort((num, d))
                keep = np.zeros(len(num), bool)
                keep[order[np.append(True, d[order][1:] != d[order][:-1])]] = True  # the smallest of equal sets speaks for them here
                n = np.diff(bounds)
                chosen = spread(bounds[:-1][keep], n[keep])
                keys, row, step, sure = signatures(hashes[chosen], np.append(0, np.cumsum(n[keep])))
                num, n, d = num[keep], n[keep], d[keep]
                bucket = ((keys >> U64(32)) % U64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                at = np.searchsorted(bucket[order], np.arange(buckets + 1))
                out = []
                for b in np.flatnonzero(np.diff(at)):
                    pick = order[at[b] : at[b + 1]]
                    present, place = np.unique(row[pick], return_inverse=True)
                    values = {"keys": keys[pick].astype(np.uint32), "place": place.astype(np.uint16 if len(present) < 65536 else np.uint32), "step": np.packbits(step[pick].astype(bool)), "id": num[present], "n": n[present].astype(np.uint32), "d": d[present], "sure": sure[:, present].astype(np.uint16)}
                    out.append({"bucket": int(b)} | {k: v.tobytes() for k, v in values.items()})
                if out:
                    yield pa.RecordBatch.from_pylist(out, pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("keys", "place", "step", "id", "n", "d", "sure"))]))

    def group(table: pa.Table) -> pa.Table:
        out = groups_of(table)
        give_back()
        return out

    def groups_of(table: pa.Table) -> pa.Table:
        read = lambda k, c, kind: np.frombuffer(table.column(c)[k].as_buffer(), kind)
        keys = np.concatenate([read(k, "keys", np.uint32) for k in range(table.num_rows)])
        often = _often(keys)
        if not often.any():
            return _groups_table([])
        # Most words are one document's; only the others' documents are looked up.
        parts, end = {k: [] for k in ("id", "n", "d", "step", "sure")}, 0
        for k in range(table.num_rows):
            begin, end = end, end + len(read(k, "keys", np.uint32))
            at, ids = np.flatnonzero(often[begin:end]), read(k, "id", np.int64)
            place = read(k, "place", np.uint16 if len(ids) < 65536 else np.uint32)[at]
            step = np.unpackbits(read(k, "step", np.uint8), count=end - begin)[at]
            sure = read(k, "sure", np.uint16).reshape(2, -1)
            for c, v in (("id", ids[place]), ("n", read(k, "n", np.uint32)[place]), ("d", read(k, "d", U64)[place]), ("step", step), ("sure", sure[step, place])):
                parts[c].append(v)
        keys, c = keys[often], {k: np.concatenate(v) for k, v in parts.items()}
        order = np.lexsort((c["id"], c["d"], keys))
        first = np.append(True, (keys[order][1:] != keys[order][:-1]) | (c["d"][order][1:] != c["d"][order][:-1]))
        order = order[first]
        order = order[np.lexsort((c["id"][order], keys[order]))]
        keys, c = keys[order], {k: v[order].astype(np.int64) for k, v in c.items() if k != "d"}
        start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sizes = np.diff(np.append(start, len(keys)))
        start, sizes = start[sizes > 1], sizes[sizes > 1]
        if not len(start):
            return _groups_table([])
        hot = sizes > HOT
        mark = c["id"] * 2 + c["step"]
        sums = np.zeros(len(mark) + 1, U64)
        np.cumsum(mix(mark.view(U64)), out=sums[1:])
        same = mix(sums[start + sizes] - sums[start]) + sizes.astype(U64)
        out = []
        for kind, which in ((COLD, ~hot), (HOT_GROUP, hot)):
            _, once, words = np.unique(same[which], return_index=True, return_counts=True)
            s, n = start[which][once], sizes[which][once]
            at = spread(s, n)
            out.append((kind, n, c["id"][at], c["n"][at], c["sure"][at] * 2 + c["step"][at] if kind else np.zeros(len(at), np.int64), words))
        if hot.any():
            at = spread(start[hot], sizes[hot])
            _, once, times = np.unique(mark[at], return_index=True, return_counts=True)
            at = at[once]
            out.append((HEAT, [len(at)], c["id"][at], times, c["sure"][at] * 2 + c["step"][at], [0]))
        return _groups_table(out)

    return docs.select(number, text).mapInArrow(lean(send), _BLOB).groupBy("bucket").applyInArrow(group, _GROUPS)


def _often(keys: np.ndarray) -> np.ndarray:
    """Which keys stand there more than once."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    again = np.zeros(len(keys), bool)
    again[1:] = ranked[1:] == ranked[:-1]
    again[:-1] |= again[1:]
    out = np.empty(len(keys), bool)
    out[order] = again
    return out


def _groups_table(parts) -> pa.Table:
    kinds = np.concatenate([np.full(len(p[1]), p[0], np.int32) for p in parts]) if parts else np.zeros(0, np.int32)
    lengths = np.concatenate([np.asarray(p[1], np.int64) for p in parts]) if parts else np.zeros(0, np.int64)
    ends = pa.array(np.append(0, np.cumsum(lengths)), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.asarray(p[k], np.int64) for p in parts]) if parts else [], pa.int64())) for k in (2, 3, 4)]
    times = np.concatenate([np.asarray(p[5], np.int64) for p in parts]) if parts else np.zeros(0, np.int64)
    return pa.table({"kind": pa.array(kinds), "members": lists[0], "sizes": lists[1], "more": lists[2], "times": pa.array(times)})


def _memberships(raw: DataFrame) -> DataFrame:
    """(g, id, n): each group's documents, of hot groups only those that don't leave them.

    A document whose words in hot groups, in a sketch, are fewer than those it is sure to share leaves
    them all; others leave the largest groups first, ties by g, while the words left are fewer. Groups
    of the same documents from several buckets follow each other, so the last one decides.
    """
    each = lambda kind, *more: raw.filter(F.col("kind") == kind).select(F.xxhash64("kind", "members", "more").alias("g"), *more, F.explode(F.arrays_zip(F.col("members").alias("id"), F.col("sizes").alias("n"), F.col("more").alias("more"))).alias("m")).select("g", *[c for c in ("heat", "times") if more], "m.*")
    split = [(F.col("more") % 2).alias("step"), F.floor(F.col("more") / 2).alias("sure")]
    heat = each(HEAT).select("id", *split, F.col("n").alias("times"))
    bound = heat.groupBy("id", "step").agg(F.sum("times").alias("all"), F.min("sure").alias("least")).filter("all >= least").select("id", "step", "least")
    hot = each(HOT_GROUP, F.size("members").alias("heat"), F.col("times")).select("g", "heat", "times", "id", "n", *split).join(bound, ["id", "step"])
    so_far = F.sum("times").over(Window.partitionBy("id", "step").orderBy(F.desc("heat"), "g").rowsBetween(Window.unboundedPreceding, 0))
    stays = hot.withColumn("so_far", so_far).filter("so_far >= least").select("g", "id", "n")
    return each(COLD).select("g", "id", "n").unionByName(stays).distinct()


#: So many document numbers at most are broadcast, 8 bytes each.
_BROADCAST_ROWS = 500_000


def _set_table(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, hashes) of the wanted documents."""

    def run(batches):
        for batch in batches:
            for num, hashes, bounds in _sets_of(batch, "id", "text"):
                packed = column_of(np.ascontiguousarray(hashes).view(np.uint8), bounds * 8, binary=True)
                yield pa.RecordBatch.from_arrays([pa.array(num), packed], ["id", "hashes"])

    few = wanted.count() <= _BROADCAST_ROWS
    return docs.join(F.broadcast(wanted) if few else wanted, "id", "left_semi").select("id", "text").mapInArrow(lean(run), "id long, hashes binary")


def _close(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b, na, nb) whose parity bits differ in no more places than linked sets may."""

    def run(batches):
        for batch in batches:
            most = ((batch.column("na").to_numpy() + batch.column("nb").to_numpy()) * (DEN - NUM)) // (DEN + NUM)
            keep = [differing_bits(x.as_buffer(), y.as_buffer()) <= m for x, y, m in zip(batch.column("x"), batch.column("y"), most, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda k, v: sketches.select(F.col("id").alias(k), F.col("bits").alias(v))
    return pairs.join(side("b", "y"), "b").join(side("a", "x"), "a").select("a", "b", "na", "nb", "x", "y").mapInArrow(lean(run), "a long, b long")


def _links(pairs: DataFrame, sketches: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b, na, nb) whose sets are alike enough: by their parity bits first, then by the whole sets."""

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                a, b = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = len(a) + len(b) - len(np.union1d(a, b))
                keep[k] = DEN * both >= NUM * (len(a) + len(b) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    close = jobs.written(_close(pairs, sketches), "close")
    sets = jobs.written(_set_table(docs, close.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "hashes")
    side = lambda k, v: sets.select(F.col("id").alias(k), F.col("hashes").alias(v))
    near = close.join(side("b", "y"), "b").join(side("a", "x"), "a")
    out = jobs.written(near.select("a", "b", "x", "y").mapInArrow(lean(run), "a long, b long"), "links")
    jobs.dropped(close, sets)
    return out


def _alike(na, nb):
    return DEN * F.least(na, nb) >= NUM * F.greatest(na, nb)


def _scored(groups: DataFrame) -> DataFrame:
    """``groups`` with each document's ``score``, the sizes of its groups summed: what many near copies have in common scores highest."""
    sizes = jobs.written(groups.groupBy("g").agg(F.count("*").alias("size")), "sizes")
    scores = jobs.written(groups.join(sizes, "g").groupBy("id").agg(F.sum("size").alias("score")), "scores")
    out = jobs.written(groups.join(scores, "id").select("g", "id", "n", "score"), "scored")
    jobs.dropped(sizes, scores, groups)
    return out


def _placed(groups: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``groups`` with the component that each document is in so far."""
    if roots is None:
        return groups.withColumn("root", F.col("id"))
    return groups.join(roots.withColumnRenamed("v", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))


_BEST = "max_by(struct(id, n, root), struct(score, -id))"


def _open_groups(placed: DataFrame) -> DataFrame:
    """Of groups with documents of several components: g, and the document that scores highest."""
    return placed.groupBy("g").agg(F.expr(_BEST).alias("head"), F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("g", "head")


def _star(placed: DataFrame, centres: DataFrame) -> DataFrame:
    """Pairs of each group's centre with its documents of other components, as sizes allow."""
    met = placed.join(centres, "g").filter((F.col("root") != F.col("head.root")) & _alike(F.col("n"), F.col("head.n")))
    first = F.col("head.id") < F.col("id")
    return met.select(F.least("id", "head.id").alias("a"), F.greatest("id", "head.id").alias("b"), F.when(first, F.col("head.n")).otherwise(F.col("n")).alias("na"), F.when(first, F.col("n")).otherwise(F.col("head.n")).alias("nb")).distinct()


def _met(known: DataFrame) -> DataFrame:
    """(g, id, n): groups of documents (id, text) in one of which any two that link are, equal sets as one."""
    # About a byte of keys and places travels for each byte of text.
    buckets = jobs.parts_for(jobs.total_bytes(known, "text"), BUCKET_BYTES, 12)
    candidates = jobs.written(_candidate_groups(known, "id", "text", buckets), "candidates")
    out = jobs.written(_memberships(candidates), "groups")
    jobs.dropped(candidates)
    return out


def linked_pairs(docs: DataFrame, number: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b), a < b, of every two different sets that link, each named by the smallest document with it.

    With ``class_id`` of ``near_duplicates`` these are all links. All pairs of a group are compared whose
    sizes allow it, so work and result grow with the square of a group of near copies.
    """
    known = docs.select(F.col(f"`{number}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).filter("id IS NOT NULL")
    sketches = jobs.written(describe(known, "id", "text"), "sets").select("id", "bits")
    groups = _met(known)
    x, y = (groups.select("g", F.col("id").alias(v), F.col("n").alias(f"n{v}")) for v in ("a", "b"))
    pairs = x.join(y, "g").filter((F.col("a") < F.col("b")) & _alike(F.col("na"), F.col("nb"))).select("a", "b", "na", "nb").distinct()
    return _links(jobs.written(pairs, "pairs"), sketches, known).distinct()


def near_duplicates(docs: DataFrame, number: str = "doc_id", text: str = "text") -> DataFrame:
    """(number, n_shingles, component_id, class_id) for every row of ``docs``.

    ``class_id`` is the smallest document with the same set; ``component_id`` the smallest that
    links reach. Without shingles or number both are the row's own number.
    """
    docs = docs.select(F.col(f"`{number}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    known = docs.filter("id IS NOT NULL")
    described = jobs.written(describe(known, "id", "text"), "sets")
    sketches = described.select("id", "bits")
    groups = _scored(_met(known))

    # Each group's best document against all, then the best of what that one didn't reach.
    heads = jobs.written(_open_groups(_placed(groups, None)), "heads")
    links = _links(jobs.written(_star(_placed(groups, None), heads), "pairs"), sketches, known)
    roots = components(links)
    jobs.dropped(heads)
    heads = jobs.written(_open_groups(_placed(groups, roots)), "heads")
    joined = roots.select(F.col("v").alias("a"), F.col("root").alias("b"))
    if not heads.isEmpty():
        rest = _placed(groups, roots).join(heads.select("g", F.col("head.root").alias("done")), "g").filter("root <> done")
        second = jobs.written(rest.groupBy("g").agg(F.expr(_BEST).alias("head")), "heads")
        more = _links(jobs.written(_star(_placed(groups, roots), second), "pairs"), sketches, known)
        if not more.isEmpty():
            roots = components(links.unionByName(more))
            joined = roots.select(F.col("v").alias("a"), F.col("root").alias("b"))
        # What is left is compared in cells.
        joined = joined.unionByName(_cell_links(groups, roots, described, known))
    # Documents of one class follow its first; rows that share a number join their classes.
    classes = jobs.written(described.filter("n > 0").groupBy("n", "d0", "d1").agg(F.min("id").alias("class_id"), F.count("*").alias("copies")).filter("copies > 1").drop("copies"), "classes")
    member = jobs.written(described.join(classes, ["n", "d0", "d1"], "left").select("id", "n", F.coalesce("class_id", "id").alias("class_id")), "members")
    several = jobs.written(member.filter("n > 0").groupBy("id").agg(F.min("class_id").alias("x"), F.max("class_id").alias("y")).filter("x <> y").select("id", "x"), "several")
    shared = member.filter("n > 0").join(several, "id").select(F.col("class_id").alias("a"), F.col("x").alias("b")).distinct()
    whole = components(joined.unionByName(shared).filter("a <> b"))
    placed = member.join(whole.select(F.col("v").alias("class_id"), "root"), "class_id", "left")
    out = placed.select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("root", "class_id")).otherwise(F.col("id")).alias("component_id"), "class_id")
    loose = docs.filter("id IS NULL")
    counted = describe(loose.select(F.lit(0).cast("long").alias("id"), "text"), "id", "text")
    none = F.lit(None).cast("long")
    return out.unionByName(counted.select(none.alias("id"), F.col("n").alias("n_shingles"), none.alias("component_id"), none.alias("class_id"))).withColumnRenamed("id", number)


def _cells(left: DataFrame, done: DataFrame) -> DataFrame:
    """(g, i, j, x, y, id, n, root): the documents of groups ``left`` (g, id, n, root) dealt into cells.

    In a group, only documents outside of the component ``done`` (g, done) can bring a link that joins
    anything. These are dealt into blocks as rows of a table (x), and all documents as columns (y); a
    cell holds one block of either kind, of bounded size.
    """
    left = jobs.written(left.join(done, "g").select("g", "id", "n", "root", (F.col("root") != F.col("done")).alias("out")), "left")
    blocks = lambda n, size: F.greatest(F.ceil(n / CELL), F.ceil(size / CELL_SHINGLES)).cast("int")
    outside = F.col("out").cast("long")
    dealt = jobs.written(left.groupBy("g").agg(blocks(F.sum(outside), F.sum(outside * F.col("n"))).alias("rows"), blocks(F.count("*"), F.sum("n")).alias("columns")), "blocks")
    own = left.join(dealt, "g").withColumn("i", F.pmod(F.xxhash64("id"), "rows").cast("int")).withColumn("j", F.pmod(F.xxhash64("id"), "columns").cast("int"))
    at = lambda i, j, x, y: F.struct(i.alias("i"), j.alias("j"), x.alias("x"), y.alias("y"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    down = F.transform(upto("rows"), lambda i: at(i, F.col("j"), F.col("out") & (i == F.col("i")), F.lit(True)))
    across = F.transform(F.filter(upto("columns"), lambda j: F.col("out") & (j != F.col("j"))), lambda j: at(F.col("i"), j, F.lit(True), F.lit(False)))
    return own.select(F.explode(F.concat(down, across)).alias("c"), "g", "id", "n", "root").select("g", "c.*", "id", "n", "root")


def _in_cells(cells: DataFrame, what: DataFrame, column: str, work) -> DataFrame:
    """(a, b) that ``work`` finds in the cells, whose rows get ``what``'s ``column`` by id."""
    key, parts = ["g", "i", "j"], int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cells.join(what, "id").select(*key, "x", "y", "id", "n", "root", column).repartition(parts, *key).sortWithinPartitions(*key)
    return rows.mapInArrow(lean(_by_cell(work)), "a long, b long").distinct()


def _cell_links(groups: DataFrame, roots: DataFrame, described: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) that join what is left of every group, fewer in each cell than it has documents.

    Cells compare folded bits first. Pairs that may link make clusters, across all groups, of which a
    cell gives out a spanning forest; pairs within a cluster are then verified on the whole sets, in cells
    again, and what comes out is a spanning forest of the links.
    """
    placed = _placed(groups, roots)
    done = jobs.written(_open_groups(placed).select("g", F.col("head.root").alias("done")), "heads")
    short = described.select("id", "short")
    near = components(_in_cells(_cells(placed, done), short, "short", _near_in_cells))
    jobs.dropped(done)
    sizes = described.select("id", "n").join(near.select(F.col("v").alias("id"), F.col("root").alias("g")), "id").distinct()
    left = jobs.written(_placed(sizes, roots).select("g", "id", "n", "root"), "clusters")
    done = jobs.written(left.groupBy("g", "root").count().groupBy("g").agg(F.max_by("root", F.struct("count", "root")).alias("done")), "heads")
    sets = jobs.written(_set_table(docs, left.select("id").distinct()), "hashes")
    return jobs.written(_in_cells(_cells(left, done), sets, "hashes", _forest_in_cells), "links")


def _by_cell(work):
    """Apply ``work`` to tables of whole cells; a cell's rows stand together, and the last cell of a batch waits for the next."""

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            edge = _cell_edges(table)
            rest = table.slice(edge[-2])
            yield from links(table.slice(0, edge[-2]), edge[:-1])
        if rest is not None:
            yield from links(rest, _cell_edges(rest))

    def links(table, edge):
        found = work(_Cells(table), edge) if len(edge) > 1 else []
        if found:
            a, b = np.array(found, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _cell_edges(table: pa.Table) -> np.ndarray:
    """Where each cell's rows begin, and the end."""
    g, i, j = (table.column(c).to_numpy() for c in ("g", "i", "j"))
    if not len(g):
        return np.zeros(2, np.int64)
    new = (g[1:] != g[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    return np.concatenate([[0], np.flatnonzero(new) + 1, [len(g)]])


class _Cells:
    """The rows of some cells as arrays, and which pairs of them may link."""

    def __init__(self, table: pa.Table):
        self.id, self.n, self.root, self.x, self.y = (table.column(c).to_numpy() for c in ("id", "n", "root", "x", "y"))
        self.data, self.at = bytes_of(table.column(table.num_columns - 1))
        self.words = np.diff(self.at) // 8

    def hold(self, data: np.ndarray, at: np.ndarray) -> None:
        """Compare these bits from now on."""
        self.data, self.at, self.words = data, at, np.diff(at) // 8

    def bits(self, rows: np.ndarray, words: int) -> np.ndarray:
        out = np.empty((len(rows), words), U64)
        for m in np.unique(self.words[rows]).tolist():
            which = np.flatnonzero(self.words[rows] == m)
            out[which] = folded(self.data[self.at[rows[which]][:, None] + np.arange(8 * m)].view(U64), words)
        return out

    def _within(self, a, b):
        return DEN * np.minimum(a, b) >= NUM * np.maximum(a, b)

    def near_pairs(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Which of the pairs may link, by roles, components, sizes and bits."""
        n = self.n
        ok = ((self.x[p] & self.y[q]) | (self.x[q] & self.y[p])) & (self.root[p] != self.root[q]) & self._within(n[p], n[q])
        left = np.flatnonzero(ok)
        least = np.minimum(self.words[p[left]], self.words[q[left]])
        for w in np.unique(least).tolist():
            pick = left[least == w]
            for i in range(0, len(pick), max(1, _BITS_AT_ONCE // w)):
                some = pick[i : i + max(1, _BITS_AT_ONCE // w)]
                rows, back = np.unique(np.concatenate([p[some], q[some]]), return_inverse=True)
                bits = self.bits(rows, w)
                differ = np.bitwise_count(bits[back[: len(some)]] ^ bits[back[len(some) :]]).sum(axis=1, dtype=np.int64)
                ok[some] = differ <= (n[p[some]] + n[q[some]]) * (DEN - NUM) // (DEN + NUM)
        return ok

    def near_block(self, s: int, e: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows x and y of a cell, and a table of which may link."""
        x, y = s + np.flatnonzero(self.x[s:e]), s + np.flatnonzero(self.y[s:e])
        if not len(x) or not len(y):
            return x, y, np.zeros((len(x), len(y)), bool)
        rows = np.arange(s, e)
        bits = self.bits(rows, int(self.words[rows].min()))
        differ = np.zeros((len(x), len(y)), np.int32)
        for w in range(bits.shape[1]):
            differ += np.bitwise_count(bits[x - s, w][:, None] ^ bits[y - s, w][None])
        a, b = self.n[x][:, None], self.n[y][None]
        return x, y, (differ <= (a + b) * (DEN - NUM) // (DEN + NUM)) & self._within(a, b) & (self.root[x][:, None] != self.root[y][None])


#: 64-bit words of sketches that are compared at once, and rows of a cell whose pairs are compared together with other cells'.
_BITS_AT_ONCE, _SMALL = 1 << 20, 64


class _Forest:
    """Components that grow by links, of which it keeps those that joined two."""

    def __init__(self, ids: np.ndarray, root: np.ndarray):
        self.ids, self.root, self.above, self.links = ids, root, {}, []

    def find(self, r: int) -> int:
        while r in self.above:
            r = self.above[r]
        return r

    def apart(self, p: int, others: np.ndarray) -> np.ndarray:
        """Which of the other rows aren't in row ``p``'s component."""
        own = self.find(int(self.root[p]))
        return others[np.array([self.find(r) != own for r in self.root[others].tolist()], bool)]

    def link(self, p: int, q: int) -> None:
        a, b = self.find(int(self.root[p])), self.find(int(self.root[q]))
        if a != b:
            self.above[max(a, b)] = min(a, b)
            self.links.append((self.ids[p], self.ids[q]))


def _near_in_cells(cells: _Cells, edge: np.ndarray) -> list:
    """A spanning forest of each cell's pairs that may link by folded bits; each document stands for itself."""
    links, sizes = [], np.diff(edge)
    small = (sizes > 1) & (sizes <= _SMALL)
    if small.any():
        # All pairs of all small cells, in memory only.
        rows = spread(edge[:-1][small], sizes[small])
        first = np.repeat(edge[:-1][small], sizes[small])
        p, q = np.repeat(rows, rows - first), spread(first, rows - first)
        near = cells.near_pairs(p, q)
        last, forest = -1, None
        for c, a, b in zip(np.searchsorted(edge, p[near], "right").tolist(), p[near].tolist(), q[near].tolist(), strict=True):
            if c != last:
                links += forest.links if forest else []
                last, forest = c, _Forest(cells.id, cells.id)
            forest.link(a, b)
        links += forest.links if forest else []
    for s, e in zip(edge[:-1][sizes > _SMALL].tolist(), edge[1:][sizes > _SMALL].tolist(), strict=True):
        x, y, near = cells.near_block(s, e)
        forest = _Forest(cells.id, cells.id)
        for k in np.flatnonzero(near.any(axis=1)).tolist():
            for q in y[near[k]].tolist():
                forest.link(int(x[k]), q)
        links += forest.links
    return links


def _forest_in_cells(cells: _Cells, edge: np.ndarray) -> list:
    """Links that join components within each cell, by the whole sets: each joins two that weren't joined."""
    hashes, at = np.frombuffer(cells.data.tobytes(), U64), cells.at // 8
    cells.n = n = np.diff(at)
    cells.hold(*bit_sketches(hashes, at))
    links = []
    for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        x, y, near = cells.near_block(s, e)
        if not near.any():
            continue
        codes = np.unique(hashes[at[s] : at[e]], return_inverse=True)[1]
        mark = np.zeros(int(codes.max()) + 1, bool)
        forest = _Forest(cells.id, cells.root)
        for k in np.flatnonzero(near.any(axis=1)).tolist():
            p = int(x[k])
            q = forest.apart(p, y[near[k]])
            if not len(q):
                continue
            own = codes[at[p] - at[s] : at[p + 1] - at[s]]
            mark[own] = True
            both = np.add.reduceat(mark[codes[spread(at[q] - at[s], n[q])]].astype(np.int64), np.cumsum(n[q]) - n[q])
            mark[own] = False
            for o in q[DEN * both >= NUM * (n[p] + n[q] - both)].tolist():
                forest.link(p, o)
        links += forest.links
    return links


def one_of_each(docs: DataFrame, number: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest number, once."""
    found = near_duplicates(docs, number, text).filter(F.col(number) == F.col("component_id")).select(F.col(number).alias("first")).distinct()
    packed = carried(docs, id=F.col(f"`{number}`").cast("long"), t=F.coalesce(F.col(f"`{text}`"), F.lit("")))
    # Rows that share a number: the first by its text's hash stays.
    kept = packed.join(found, F.col("id") == F.col("first"), "left_semi").groupBy("id").agg(F.min_by("row", F.struct(F.xxhash64("t"), F.length("t"))).alias("row"))
    return kept.select("row").unionByName(packed.filter("id IS NULL").select("row")).select("row.*")


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
