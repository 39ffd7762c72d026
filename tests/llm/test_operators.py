import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkframe.llm import ann, bpe, classifier, components, jobs, licenses, mixing, ngram_join, packing, quality_rules, repeats, rlz_dedup, suffix_dedup, token_store, tokens

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, source string, row string, __block string, id long"
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"


def fixture(rng):
    """Small texts with copies, near copies, shared passages, nulls, blanks, odd white space and clashing columns."""
    vocab = [f"w{i}" for i in range(60)] + ["é", "ß", "The", "CC", "by", "naïve,"]
    texts = [" ".join(rng.choice(vocab, rng.integers(1, 60))) for _ in range(40)]
    texts += [texts[3], texts[3], texts[5] + " more", "x " + texts[5], texts[7].upper(), None, None, "", "   ", "\n\t", "a", "a", "a b", "A b", "a\x0bb c\rd  e", "Ber " * 300, "Ber " * 400, BASE, BASE + " " + BASE, BASE[5:] + " x", "ab" * 90, "ab" * 90 + "c", "tail  ", " head", "x \n y  z"]
    long = " ".join(rng.choice(vocab, 9000))
    texts += [long, long + " " + BASE, texts[1] + " " + BASE + " " + texts[2]]
    rows = [(i, t, ["s1", "s0", None][i % 3], "r", "b", -i) for i, t in enumerate(texts)]
    return rows + [(3, texts[3], "s0", "r", "b", 0), (None, texts[5], None, None, None, None), (2**40, texts[9], "s2", None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return fixture(np.random.default_rng(5))


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def repeats_by_hand(rows, length, split):
    key = lambda d: 2**63 - 1 if d is None else d
    seqs, least = [split(r[1]) for r in rows], {}
    for r, q in zip(rows, seqs, strict=True):
        for i in range(len(q) - length + 1):
            w = tuple(q[i : i + length])
            least[w] = min(least.get(w, key(r[0])), key(r[0]))
    out = []
    for r, q in zip(rows, seqs, strict=True):
        gone = np.zeros(len(q), bool)
        for i in range(len(q) - length + 1):
            if least[tuple(q[i : i + length])] < key(r[0]):
                gone[i : i + length] = True
        out.append((r[0], q, gone))
    return out


def test_suffix_dedup(docs, rows, empty):
    want = Counter()
    for d, q, gone in repeats_by_hand(rows, 50, lambda t: list((t or "").encode())):
        kept = bytes(x for x, g in zip(q, gone, strict=True) if not g)
        want[d, len(q), kept, tuple((m.start(), m.end()) for m in re.finditer("1+", "".join("01"[int(g)] for g in gone)))] += 1
    got = suffix_dedup.remove_repeats(docs)
    assert got.schema["row"].dataType == docs.schema
    assert Counter((r["row"]["doc_id"], r["n_bytes"], bytes(r["kept"]), tuple(tuple(x) for x in r["removed"])) for r in got.collect()) == want
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_rlz_dedup(docs, rows, empty):
    want = Counter((d, len(q), int(gone.sum()), " ".join(x for x, g in zip(q, gone, strict=True) if not g)) for d, q, gone in repeats_by_hand(rows, 13, words))
    got = rlz_dedup.remove_repeats(docs)
    assert Counter((r["row"]["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got.collect()) == want
    left = rlz_dedup.without_repeats(docs)
    assert left.columns == docs.columns and left.count() == sum(n for (d, a, b, k), n in want.items() if b == 0 or b < a)
    assert rlz_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_parse_rebuilds_the_text(seed):
    """Factors are copies from documents with smaller numbers, longest from where they begin; literals are the rest."""
    rng = np.random.default_rng(seed)
    seqs = [rng.integers(0, 4, n) for n in rng.integers(0, 120, 12)]
    seqs += [np.concatenate([seqs[2][:40], seqs[5], seqs[2][10:]]), seqs[5].copy()]
    number = rng.permutation(len(seqs)) // 2  # some documents share a number
    bounds, ids = np.append(0, np.cumsum([len(s) for s in seqs])), np.concatenate(seqs)
    begin, size, source, index = rlz_dedup.parse(ids, bounds, number, 6)
    assert len(begin) and (size >= 6).all()
    made, at = np.full(len(ids), -1), 0
    owner = lambda p: np.searchsorted(bounds, p, "right") - 1
    for b, n, s in zip(begin.tolist(), size.tolist(), source.tolist(), strict=True):
        assert b >= at and number[owner(s)] < number[owner(b)] and owner(s) == owner(s + n - 1) and owner(b) == owner(b + n - 1)
        end_b, end_s = bounds[owner(b) + 1], bounds[owner(s) + 1]
        assert b + n == end_b or s + n == end_s or ids[b + n] != ids[s + n]
        made[b : b + n], at = ids[s : s + n], b + n
    assert (made[made >= 0] == ids[made >= 0]).all()
    seen = {}
    for k in np.argsort(number, kind="stable"):
        for p in range(bounds[k], bounds[k + 1] - 5):
            seen.setdefault(tuple(ids[p : p + 6]), number[k])
    want = [p + 6 <= bounds[owner(p) + 1] and seen[tuple(ids[p : p + 6])] < number[owner(p)] for p in range(len(ids))]
    assert (index >= 0).tolist() == want
    assert not any(want[p] for p in np.flatnonzero(made < 0))


def test_equal_spans_when_all_hashes_agree(monkeypatch):
    """Equal hashes of different bytes change nothing."""
    rng = np.random.default_rng(4)
    size = rng.integers(0, 4, 300)
    data = rng.integers(0, 2, int(size.sum())).astype(np.uint8)
    begin, order = np.cumsum(size) - size, rng.permutation(300)
    spans = [data[b : b + n].tobytes() for b, n in zip(begin, size, strict=True)]
    want = [min((k for k in range(300) if spans[k] == x), key=lambda k: order[k]) for x in spans]
    assert repeats.equal_spans(data, begin, size, order).tolist() == want
    monkeypatch.setattr(repeats, "span_hashes", lambda data, a, b: np.zeros(len(a), np.uint64))
    monkeypatch.setattr(repeats, "_COMPARED", 5)
    assert repeats.equal_spans(data, begin, size, order).tolist() == want
    monkeypatch.setattr(rlz_dedup, "mix", lambda x, salt=0: x & np.uint64(1))
    ids = rng.integers(0, 3, 400)
    bounds, number = np.arange(0, 401, 40), np.arange(10)
    weak = rlz_dedup.sources(ids, bounds, number, 5)
    monkeypatch.undo()
    assert (weak == rlz_dedup.sources(ids, bounds, number, 5)).all() and (weak >= 0).any()


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def test_words_made_to_collide(spark):
    """Words whose polynomial hashes modulo 2^64 agree for any base are different words."""
    for n in (2048, 4096):
        t = thue_morse(n)
        other = t.translate(str.maketrans("ab", "ba"))
        rows = [(1, " ".join([t] * 13)), (2, " ".join([other] * 13)), (3, f"{t} x y z w"), (4, f"{other} x y z w")]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert {r["row"]["doc_id"]: r["n_removed"] for r in rlz_dedup.remove_repeats(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
        import pyarrow as pa

        hashes, _ = ngram_join.shingle_sets(*tokens.bytes_of(pa.array([r[1] for r in rows])))
        assert len(set(hashes.tolist())) == 4


def test_radix_groups_against_a_dictionary():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2, 600).astype(np.uint8)
    starts, number = np.arange(500), np.arange(500) // 50
    alive, group = suffix_dedup.radix_groups(values, starts, number, 13)
    seen = {}
    for s in starts:
        seen.setdefault(bytes(values[s : s + 13]), []).append(s)
    want = {tuple(v) for v in seen.values() if len({number[x] for x in v}) > 1}
    assert {tuple(sorted(alive[group == g])) for g in set(group)} == want


def components_by_hand(rows):
    sets = {}
    for r in rows:
        w = words(lower(r[1]))
        sets[r[0]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            i = len(sets[a] & sets[b])
            if a < b and i and 100 * i >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_ngram_join(docs, rows, empty):
    want = components_by_hand([r for r in rows if r[0] is not None])
    got = ngram_join.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    one = ngram_join.one_of_each(docs)
    assert one.columns == docs.columns
    assert sorted(r["doc_id"] for r in one.collect() if r["doc_id"] is not None) == sorted({c for _, c in want.values()})
    assert ngram_join.near_duplicates(empty).count() == 0


def test_ngram_join_of_a_large_group_that_links_in_part(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELL", 8)
    rng, rows = np.random.default_rng(11), []
    base = [f"b{i}" for i in range(160)]
    for i in range(90):
        words = list(base)
        for at in rng.choice(160, rng.integers(0, 12), replace=False):
            words[at] = f"x{i}_{at}"
        rows.append((i, " ".join(words)))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    first = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((first[a], first[b]))
                first = {k: low if v == high else v for k, v in first.items()}
    assert 1 < len(set(first.values())) < 90
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == first


def test_linked_pairs_are_all_links(spark, rows):
    """Also those within a component, and in groups that are hot; copies stand for their first."""
    rng, base = np.random.default_rng(12), [f"b{i}" for i in range(120)]
    more = [(1000 + i, " ".join(f"x{i}_{k}" if k in at else w for k, w in enumerate(base))) for i in range(50) for at in [set(rng.choice(120, rng.integers(0, 9), replace=False).tolist())]]
    every = [(r[0], r[1]) for r in rows] + more
    first = {}
    for number, text in sorted((r for r in every if r[0] is not None), key=lambda r: r[0]):
        w = words(lower(text))
        if w:
            first.setdefault(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))), number)
    want = {tuple(sorted((first[a], first[b]))) for a in first for b in first if a != b and 100 * len(a & b) >= 75 * len(a | b)}
    got = [tuple(r) for r in ngram_join.linked_pairs(spark.createDataFrame(every, "doc_id long, text string")).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    within = [p for p in want if p[0] >= 1000]
    assert len(within) > 2 * len({v for p in within for v in p})


def test_ngram_join_of_many_that_share_a_passage(spark):
    """Hot groups: near copies link, texts that only share a passage don't, whatever group size is hot."""
    rng = np.random.default_rng(9)
    pick = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 10**6, n))
    passage, original = pick(50), pick(120)
    rows = [(i, f"{pick(40)} {passage} {pick(40)}") for i in range(60)]
    rows += [(100 + i, " ".join(w if j != i else "edited" for j, w in enumerate(original.split()))) for i in range(60)]
    rows += [(300 + i, " ".join(original.split()[i : i + 100])) for i in range(0, 20, 2)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components_by_hand(rows)


def test_workers_hold_little(spark):
    """Batches of scratch tables are small, and a worker forgets other operators' tables before it joins documents."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["rows", "bytes"])

    key, docs = "spark.sql.execution.arrow.maxBytesPerBatch", spark.range(0, 6000, 1, 1).select(F.repeat(F.lit("abcd"), 1000).alias("t"))
    before = spark.conf.get(key)
    seen = jobs.written(docs.mapInArrow(run, "rows long, bytes long"), "seen").collect()
    assert sum(r["rows"] for r in seen) == 6000 and max(r["bytes"] for r in seen) <= jobs.BATCH_BYTES + 10_000
    assert spark.conf.get(key) == before
    bpe.encoder(bpe.default_path())
    assert list(tokens.lean(iter)([1, 2])) == [1, 2] and not bpe._encoders


def test_keys_that_stand_there_often():
    rng = np.random.default_rng(4)
    for n, m in ((0, 1), (1, 1), (2, 1), (500, 400), (500, 10**6)):
        keys = rng.integers(0, m, n, dtype=np.uint32)
        counts = Counter(keys.tolist())
        assert ngram_join._often(keys).tolist() == [counts[k] > 1 for k in keys.tolist()]


def test_parity_bits_bound_the_difference():
    rng = np.random.default_rng(2)
    for n, m in ((3, 4), (60, 70), (1000, 1300), (5, 900)):
        pool = np.unique(rng.integers(1, 2**63, 4000, dtype=np.uint64))
        a, b = np.sort(rng.choice(pool, n, False)), np.sort(rng.choice(pool, m, False))
        packed, at = ngram_join.bit_sketches(np.concatenate([a, b]), np.array([0, n, n + m]))
        x, y = packed[at[0] : at[1]].tobytes(), packed[at[1] : at[2]].tobytes()
        assert ngram_join.differing_bits(x, y) <= len(np.setxor1d(a, b))
        assert ngram_join.differing_bits(x, x) == 0


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (3, 4), (10, 11), (20, 20), (11, 12), (4, 9), (9, 1)], "a long, b long")
    assert {r["v"]: r["root"] for r in components.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 9: 1, 10: 10, 11: 10, 12: 10}
    assert components.components(edges.limit(0)).count() == 0


def test_encoder_agrees_with_the_library(rows):
    from tokenizers import Tokenizer

    hard = [r[1] or "" for r in rows] + [" ", "  a  b", "a \n b", "  x", "it's 'll 1234 5", "a\n\n", "<|endoftext|> a", "é" * 50, "  a b"]
    ids, bounds = bpe.Encoder(bpe.default_path()).encode(hard)
    want = Tokenizer.from_file(bpe.default_path()).encode_batch(hard, add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [w.ids for w in want]


def test_encoder_on_pieces_of_any_kind():
    """Pieces of 15 to 17 bytes, with zeros, white space of all kinds and openings, over several calls of one encoder."""
    from tokenizers import Tokenizer

    rng, library, own = np.random.default_rng(8), Tokenizer.from_file(bpe.default_path()), bpe.Encoder(bpe.default_path())
    parts = [*"ab \n\t  <|>é  à\u2003\u3000x1'\u65e5\x1c\x85\0", "word ", " the", "<|endoftext|>", "fifteenbytes_ab ", "sixteenbytes_abc ", "seventeenbytes_ab ", "\0" * 15 + " ", "\0" * 16 + " "]
    for _ in range(8):
        texts = ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(150)] + ["", ""]
        ids, bounds = own.encode(texts)
        want = library.encode_batch(texts, add_special_tokens=False)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [w.ids for w in want]
    assert [x.tolist() for x in own.encode([])] == [[], [0]]


def test_table_of_pieces_against_a_dictionary(monkeypatch):
    rng = np.random.default_rng(6)
    for weak in (False, True):  # all pieces of a size at one place
        if weak:
            monkeypatch.setattr(bpe._Table, "_slots", lambda self, low, high, size: (size % np.uint64(4)).astype(np.int64))
        table, known = bpe._Table(2), {}
        for _ in range(12):
            low, high, size = (rng.integers(0, m, 60, dtype=np.uint64) for m in (6, 5, 17))
            keys = list(zip(low.tolist(), high.tolist(), size.tolist(), strict=True))
            assert table.find(low, high, size).tolist() == [known.get(k, -1) for k in keys]
            new = [i for i, k in enumerate(keys) if k not in known and k not in keys[:i]]
            known |= {keys[i]: len(known) + j for j, i in enumerate(new)}
            table.add(low[new], high[new], size[new], np.array([known[keys[i]] for i in new], np.int64))
        assert table.n == len(known) and 2 * table.n <= len(table.rows)


def token_ids(text, end):
    from tokenizers import Tokenizer

    return np.array([*Tokenizer.from_file(bpe.default_path()).encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_packing(docs, rows, empty):
    got = packing.pack(docs, capacity=256).toPandas()
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset == s.length.cumsum() - s.length).all() and s.length.sum() <= 256
    want = Counter()
    for r in rows:
        ids = token_ids(r[1], 0)
        cut = [0, *range((len(ids) - 1) % 256 + 1, len(ids) + 1, 256)]
        want.update((r[0], p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(cut, cut[1:], strict=False)))
    ids = [None if x != x else int(x) for x in got.doc_id]
    assert Counter(zip(ids, got.piece, got.start, got.length, got.ids_crc32, strict=True)) == want
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 256) + 1
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    counts = {int(k): int(n) for k, n in zip(*np.unique(rng.integers(1, 101, 400 if seed else 3), return_counts=True), strict=True)}
    fill, ranks = Counter(), Counter()
    spans = {}
    for length, rank, n, sequence, offset, each in packing.plan(counts, 100):
        assert rank == ranks[length]
        ranks[length] += n
        for k in range(n):
            fill[sequence + k // each] += length
            spans.setdefault(sequence + k // each, []).append((offset + k % each * length, length))
    assert ranks == Counter(counts) and max(fill.values()) <= 100
    for s in spans.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
    assert len(fill) <= 1.1 * sum(k * n for k, n in counts.items()) / 100 + max(2, 0.5 * sum(n for k, n in counts.items() if k > 50))


def test_token_store(spark, docs, rows, empty):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted(token_store.read(spark, token_store.write(docs)).collect(), key=lambda r: r["start"])
    start = 0
    for r, g in zip(order, got, strict=True):
        ids = token_ids(r[1], 2)
        assert (g["id"], g["start"], g["n_tokens"]) == (r[0], start, len(ids))
        if r[0] != 3:
            assert g["ids_crc32"] == zlib.crc32(ids.tobytes())
        start += len(ids)
    assert token_store.read(spark, token_store.write(empty)).count() == 0


def test_token_file_gives_random_access():
    rng = np.random.default_rng(0)
    ids = np.concatenate([rng.integers(0, 2**k, 700) for k in (4, 8, 9, 16, 17, 32)]).astype(np.uint32)
    f = token_store.TokenFile(token_store.encode(ids, np.array([0, 10, len(ids)]), [5, None]))
    assert (f.ids() == ids).all() and [f[i] for i in range(0, len(ids), 7)] == ids[::7].tolist()
    places = rng.integers(0, len(ids), 3000)
    assert (f.take(places) == ids[places]).all() and len(f.take(np.zeros(0, int))) == 0
    with pytest.raises(IndexError):
        f.take(np.array([0, len(ids)]))
    raw = bytearray(token_store.encode(ids, np.array([0, len(ids)]), [1]))
    raw[len(raw) // 2] ^= 1
    with pytest.raises(ValueError):
        token_store.TokenFile(bytes(raw))
    assert f.numbers.tolist() == [5, 0] and f.null.tolist() == [False, True]
    with pytest.raises(IndexError):
        f[len(ids)]
    none = token_store.TokenFile(token_store.encode(np.zeros(0, np.uint32), np.array([0]), []))
    assert len(none.ids()) == 0


def test_quality_rules_edges(docs, rows, empty):
    got = {r["doc_id"]: r for r in quality_rules.judge(docs.filter("doc_id is not null")).select("row.doc_id", "stats.*", "base_failed", "kept").collect()}
    for d, t, *_ in rows:
        if d is None:
            continue
        w, lines, g = words(t), [x for x in (t or "").split("\n") if words(x)], got[d]
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        under = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
        assert (g["n_words"], g["word_chars"], g["n_repeat_words"], g["n_dup_lines"]) == (len(w), sum(map(len, w)), len(under), len(lines) - len(set(lines)))
        assert g["base_failed"] == (len(w) < 50 or 100 * len(under) > 50 * len(w))
    assert quality_rules.keep_good(docs).columns == docs.columns and quality_rules.keep_good(empty).count() == 0


def test_repeat_words_by_text_agrees(docs):
    both = docs.select(F.split(F.coalesce("text", F.lit("")), " ").alias("w")).filter(F.size("w") >= 3).select(quality_rules._repeat_words(F.col("w")).alias("a"), quality_rules._repeat_words_by_text(F.col("w")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in both) and any(r["a"] for r in both)


def test_quality_rules_agree_with_sql(spark):
    from compare import agree

    agree(quality_rules.op3_quality_rules, quality_rules.ORACLE, spark, SF)


def test_mixing(docs, rows, empty):
    got = mixing.mix(docs).toPandas()
    assert len(got) == len(rows) and (got.taken <= 2 * got["size"]).all() and (got.taken == got.passes * got["size"]).all()
    size = Counter()
    for r in rows:
        size[r[2]] += len(words(r[1]))
    names = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight, full = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, set()
    while True:
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full)
        unit = left / max(1, sum(weight[s] for s in names if s not in full))
        over = {s for s in names if s not in full and unit * weight[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    for s, g in got.groupby(got.source.where(got.source.notna(), "none")):
        s = None if s == "none" else s
        assert g.source_size.eq(size[s]).all() and np.allclose(g.target, 2 * size[s] if s in full else unit * weight[s])
    again = mixing.mix(docs.repartition(5)).toPandas()
    key = lambda x: sorted(zip(x.doc_id.fillna(-1), x["size"], x.taken, strict=True))
    assert key(got) == key(again)
    assert mixing.mix(empty).count() == 0 and mixing.mixed(docs).columns == docs.columns


def test_mixing_keeps_equal_rows_of_no_words(spark, docs, rows):
    more = [(7, None, "s1"), (7, None, "s1"), (8, "", None), (8, "", None), (None, "  ", "s0"), (None, "  ", "s0"), (None, "  ", "s0"), (9, "a b", "s0"), (9, "a b", "s0")]
    every = docs.select("doc_id", "text", "source").union(spark.createDataFrame(more, "doc_id long, text string, source string"))
    got = mixing.mix(every).collect()
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in got) == Counter((r[0], len(words(r[1])), r[2]) for r in [*((d, t, s) for d, t, s, *_ in rows), *more])
    assert all(r["taken"] == r["passes"] * r["size"] and (r["size"] or not r["passes"]) for r in got)


def test_mixed_takes_each_row_by_its_own_passes(spark):
    """Documents without a number, some of them equal, are taken as often as the mix takes each."""
    rows = [(None, f"t{i // 2} " * (1 + i % 7), f"s{i % 3}") for i in range(300)] + [(None, "a b", "s1")] * 5 + [(4, "c d e", "s0")] * 3 + [(None, None, "s2")]
    every = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    per = Counter()
    for r in mixing.mix(every).collect():
        per[r["doc_id"], r["source"], r["size"]] += r["passes"]
    got = mixing.mixed(every)
    assert got.columns == every.columns
    out = got.collect()
    assert Counter((r["doc_id"], r["source"], len(words(r["text"]))) for r in out) == +per
    assert sum(len(words(r["text"])) for r in out) <= 1.5 * sum(len(words(t)) for _, t, _ in rows)


def queue_by_hand(rows, cells):
    """The weighted fair queue, one document after another: {(source, number, size): words taken}."""
    size = Counter()
    for r in rows:
        size[r["source"]] += r["size"]
    target = {r["source"]: r["target"] for r in rows}
    order, waiting = {}, []
    for s in size:
        own = sorted((r for r in rows if r["source"] == s), key=lambda r: (r["at"] % cells, r["at"], r["id"] is not None, r["id"] or 0, r["size"], r["row"]))
        so_far = 0
        for r in own:
            so_far += r["size"]
            for k in range(mixing.REPEATS):
                finish = int((so_far + k * size[s]) / target[s] * 1e9) if target[s] > 0 else 0
                waiting.append((finish, r["at"], r["id"] is not None, r["id"] or 0, k, r["size"], r["source"] is not None, r["source"] or "", r["row"]))
    budget, words, taken = 3 * sum(size.values()) // 2, 0, Counter()
    for w in sorted(waiting):
        words += w[5]
        if words <= budget and w[5]:
            taken[w[-1]] += 1
    return taken


@pytest.mark.parametrize("cell_rows", [2000, 20])
def test_mixing_agrees_with_a_queue(spark, docs, monkeypatch, cell_rows):
    monkeypatch.setattr(mixing, "_CELL_ROWS", cell_rows)
    for every in (docs.select("doc_id", "text", "source"), spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")):
        narrow = mixing.sized(every, F.monotonically_increasing_id(), F.col("doc_id"), F.col("text"), F.col("source"))
        found = mixing.decided(narrow).join(narrow.select("row", "at"), "row").collect()
        want = queue_by_hand(found, max(1, -(-len(found) // cell_rows)))
        assert {r["row"]: r["passes"] for r in found if r["passes"]} == dict(want)


def test_mixing_comes_near_its_targets(spark):
    got = mixing.op6_mixing(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source"), "doc_id").toPandas()
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), most=("size", "max"))
    assert ((by.taken - by.target).abs() <= by.most).all()


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 12))
    x[50:60] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 12), (1002, [float("nan")] * 12), (1003, [1.0]), (1004, [None] * 12), (None, x[0].tolist())]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0, 5).toPandas()
    hit = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(400), -s))[:5]
        hit += len(set(want) & set(g.vec_id))
        assert g["rank"].tolist() == [1, 2, 3, 4, 5] and np.allclose(g.score, s[g.vec_id]) and q not in set(g.vec_id)
    assert got.query_id.nunique() == 20 and hit >= 0.9 * 100
    few = ann.search(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>"), F.col("id") % 20 == 0, 5)
    assert few.count() == 2
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("id") % 20 == 0, 5).count() == 0


def test_nearest_settles_ties_by_sums_in_order():
    rng = np.random.default_rng(6)
    b = rng.integers(-2, 3, (400, 8)).astype(float) * 0.1
    a = rng.integers(-2, 3, (30, 8)).astype(float) * 0.3
    exact = np.zeros((30, 400))
    for d in range(8):
        exact += a[:, d, None] * b[None, :, d]
    for k in (1, 3, 50, 500):
        top, score = ann.nearest(a, b, k)
        want = np.argsort(-exact, axis=1, kind="stable")[:, :k]
        assert (top == want).all() and (score == np.take_along_axis(exact, want, axis=1)).all()


def test_neighbours_in_one_cluster(spark, monkeypatch):
    """One bucket a table may hold all vectors: it is cut into blocks and still searched whole."""
    monkeypatch.setattr(ann, "BLOCK_ROWS", 300)
    rng = np.random.default_rng(12)
    x = np.round(np.append(np.ones(1), np.zeros(15)) + rng.normal(size=(4000, 16)) * 1e-3, 6)
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(docs, F.col("id") % 50 == 0, 10).toPandas()
    hit = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(np.lexsort((np.arange(4000), -s))[:10]) & set(g.vec_id))
    assert got.query_id.nunique() == 80 and hit >= 0.99 * 800


@pytest.mark.parametrize(("sf", "each"), [(SF, 20), ("/root/testdata/sf0.1", 50)])
def test_neighbours_recall(spark, sf, each):
    """op7's own queries on the small table, and those divisible by 50 against all rows of a larger one."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = (ann.op7_cross_polytope(spark, sf) if each == 20 else ann.search(e, F.col("id") % each == 0, 20)).toPandas()
    e = e.toPandas()
    x, ids = np.stack(e.embedding).astype(float), e.vec_id.to_numpy()
    hit = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        hit += len(set(ids[np.lexsort((ids, -s))[:20]]) & set(g.vec_id))
    assert hit >= 0.9 * 20 * (ids % each == 0).sum()


def test_classifier(spark, docs, empty):
    got = classifier.op8_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got.quality).mean() >= 0.95 and got.score.between(0, 1).all()
    rng = np.random.default_rng(0)
    x = rng.random((500, len(classifier.FEATURES)))
    model = classifier.fit(x, (x[:, 2] > 0.6).astype(float))
    assert ((model.score(x) >= 0.5) == (x[:, 2] > 0.6)).mean() > 0.97
    labels = spark.createDataFrame([], "doc_id long, quality int")
    blank = classifier.train(docs, labels)
    assert blank.rules == () and classifier.score(docs, blank).filter("score = 0.5").count() == docs.count()
    assert classifier.score(empty, model).count() == 0
    stats = docs.select(quality_rules.statistics(F.col("text")).alias("s"))
    rows = stats.select(model.column(F.col("s")).alias("score"), *[F.col(f"s.{f}").cast("double") for f in classifier.FEATURES]).toPandas().to_numpy()
    assert np.allclose(rows[:, 0], model.score(rows[:, 1:]))


def test_classifier_contract(spark):
    """held_out and predicted follow from their definitions, and held-out labels change nothing."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    got = classifier.op8_quality_classifier(spark, SF).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1
    held = classifier.remainder(F.col("doc_id")) == 0
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert labels.filter(held).count() > 20
    assert classifier.train(docs, flipped) == classifier.train(docs, labels)
    # Repeated numbers in documents don't multiply the sample.
    assert classifier.train(docs.union(docs), labels) == classifier.train(docs, labels)


def licenses_by_hand(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    places, base = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split(" ")
        at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    joined, found = f" {' '.join(w)} ", []
    for label, _, pattern, rank, weight in licenses.rules():  # no gate: keywords may lose nothing
        found += [(m.start(), m.end(), rank, label, weight) for m in re.finditer(f"(?<= )(?:{pattern})(?= )", joined)]
    first = sorted(found, key=lambda f: (f[0], -f[1], f[2], f[3], f[4]))
    kept = [f for k, f in enumerate(first) if not any(g[1] >= f[1] and g[2] <= f[2] for g in first[:k])]
    score = max([f[4] for f in kept] + [0.6 if base else 0.0])
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | {f[3] for f in kept})), score


def test_license_scan(spark, empty):
    texts = [None, "", " ", ".", "a.", ".a", "CC BY cc-by CC  by-SA 4.0", "Released under the MIT License.", "All\nrights; reserved", "GNU General Public License, version 3 or the GNU Lesser General Public License", "licensed under the Apache License, Version 2.0. " * 40, "cc", "cc by", "license", "SPDX-License-Identifier: BSD-3-Clause", "Mozilla Public License 2.0 and Creative Commons Attribution-ShareAlike 4.0", "K mit license é", "BSD license; new BSD license; public domain", "general public general public license license"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in licenses.scan(docs).select("row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()}
    for i, t in enumerate(texts):
        assert got[i] == licenses_by_hand(t), t
    assert len(licenses.rules()) >= 300 and licenses.scan(empty).count() == 0
    sample = spark.read.parquet(f"{SF}/documents.parquet").collect()
    whole = {r["doc_id"]: tuple(r)[1:] for r in licenses.op10_license_scan(spark, SF).collect()}
    assert all(whole[r["doc_id"]] == licenses_by_hand(r["text"]) for r in sample)


def test_license_scan_finds_every_phrasing(spark):
    """Phrases before a name, with no other word that the gate knows."""
    names = ("MIT", "MIT X11", "Apache 2.0", "Mozilla Public", "GNU General Public", "public domain", "zlib")
    openings = ("governed by", "subject to", "according to", "in accordance with", "under", "covered under", "licence", "SPDX license identifier")
    texts = [f"Use is {o} {x}{n} text" for o in openings for x in ("", "the ", "the terms of the ") for n in names]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in licenses.scan(docs).select("row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()}
    assert got[texts.index("Use is governed by the MIT text")][-2:] == ("mit", 0.7)
    for i, t in enumerate(texts):
        assert got[i] == licenses_by_hand(t), t


def test_license_scan_finds_every_sentence(spark):
    """Each sentence alone, with punctuation and capitals, has its label and the method's highest score."""
    plain = [(label, re.sub(r" ?\?|\(\?:([^|)]*)[^)]*\)\??", lambda m: m[1] or " " * m[0].startswith(" "), p.replace("[^|]{1,80}", "Some Body"))) for label, p in licenses.SENTENCES]
    texts = [". ".join(["Preface", t.capitalize().replace(" the ", ",\nThe "), "End"]) for _, t in plain]
    got = {r["doc_id"]: tuple(r)[1:] for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()}
    for k, (label, _) in enumerate(plain):
        assert got[k] == licenses_by_hand(texts[k]), texts[k]
        assert label in got[k][-2].split(",") and got[k][-1] == 1.0, texts[k]


def test_native_plans_have_no_python(spark):
    for f in (quality_rules.op3_quality_rules, licenses.op10_license_scan):
        plan = f(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_word_spans_and_hashes():
    import pyarrow as pa

    data, offsets = tokens.bytes_of(pa.array([" a bb", None, "", "c", "d\x0bé "]))
    starts, ends, first = tokens.word_spans(data, offsets)
    assert [bytes(data[a:b]).decode() for a, b in zip(starts, ends, strict=True)] == ["a", "bb", "c", "d", "é"]
    assert first.tolist() == [0, 2, 2, 2, 3, 5]
    assert len(set(tokens.span_hashes(data, starts, ends).tolist())) == 5
    mark = np.array([1, 1, 0, 1, 1, 1], bool)
    assert [x.tolist() for x in tokens.spans_of(mark, np.array([0, 2, 4, 6]))] == [[0, 1, 0], [2, 2, 2], [0, 1, 2, 3]]
    assert repeats.covered(np.array([0, 1, 0, 0, 0], bool), 3).tolist() == [False, True, True, True, False]


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    counts = [docs.count()]
    for k, (_, stage) in enumerate(cp.STAGES):
        docs = stage(spark, docs, SF)
        if k + 1 < len(cp.STAGES):
            assert docs.columns == names
            docs = docs.persist()
        counts.append(docs.count())
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[5] > 0
    digest = lambda df: hashlib.sha256(repr(sorted(map(tuple, df.select("doc_id", "piece", "ids_crc32").collect()))).encode()).hexdigest()
    assert digest(cp.run(spark, SF)) == digest(docs)
