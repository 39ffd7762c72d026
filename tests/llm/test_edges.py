"""Each operator and each pipeline stage on nulls, empty and very long texts, ties, repeated rows, no rows and clashing names."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sparkframe.llm import ann, classifier, licenses, mixing, ngram_join, packing, quality_rules, rlz_dedup, suffix_dedup, token_store

#: Names that operators use inside, or give to their own columns.
NAMES = "row id own t v a b g x y n i j d d0 d1 bits short hashes key rep root score out done first which c0 c1 c2 __block __number __key __n __before __position block bucket kind payload kept n_words n_removed n_bytes removed stats base_failed passes taken size at cell slot words finish source_size target pass piece start length ids_crc32 sequence_id offset r salt before n_tokens part file n_shingles component_id class_id copies labels base_labels held_out predicted rank query query_id".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)
WORDS = [f"w{i}" for i in range(5000)]
LONG = 1_100_000


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def texts():
    rng = np.random.default_rng(8)
    usual = [" ".join(rng.choice(WORDS, 80)) + " the of and" for _ in range(6)]
    return [*usual, usual[0], usual[1] + " more", None, "", "  \n", "one", "x " * 400]


@pytest.fixture(scope="module")
def rows():
    out = [(k, t, "en", ["s1", "s0", None][k % 3], len(t or ""), *NAMES) for k, t in enumerate(texts())]
    return out + [out[2], out[8], out[8], out[9], (None, texts()[3], None, None, None, *NAMES), (None, None, None, None, None, *NAMES), (None, None, None, None, None, *NAMES)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def long_docs(spark):
    rng = np.random.default_rng(2)
    body = " ".join(rng.choice([f"u{i}" for i in range(200_000)], LONG))
    return spark.createDataFrame([(1, " ".join(WORDS[:60]), "s0"), (2, body + " " + " ".join(WORDS[:60]), "s0"), (3, body[:3_000_000], "s1")], "doc_id long, text string, source string"), body


#: The others are the pipeline's stages, tested below.
OPERATORS = {
    "near_duplicates": lambda d: ngram_join.near_duplicates(d),
    "pack": lambda d: packing.pack(d),
    "judge": lambda d: quality_rules.judge(d),
    "token_store": lambda d: token_store.read(d.sparkSession, token_store.write(d)),
    "suffix_dedup": lambda d: suffix_dedup.remove_repeats(d),
    "mix": lambda d: mixing.mix(d),
    "classifier": lambda d: classifier.score(d, classifier.train(d, d.sparkSession.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int"))),
    "rlz_dedup": lambda d: rlz_dedup.remove_repeats(d),
    "licenses": lambda d: licenses.scan(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_on_clashing_names_and_edges(name, docs, rows):
    got = OPERATORS[name](docs)
    found = got.collect()
    assert len(found) == len(rows)  # one piece of each, too: all are short
    if "row" in got.columns and "doc_id" not in got.columns:
        assert Counter(map(tuple, (r["row"] for r in found))) == Counter(rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_on_no_rows(name, spark):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).count() == 0


def test_neighbours_on_clashing_names(spark):
    rows = [(k, [float(k % 7), 1.0, 2.0], *NAMES) for k in range(45)]
    names = [n for n in NAMES if n not in ("vec_id", "embedding")]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, " + ", ".join(f"`{n}` string" for n in names)), "id % 20 = 0", 4).collect()
    assert Counter(r["query_id"] for r in got) == {0: 4, 20: 4, 40: 4}
    for q in (0, 20, 40):  # ties go to the smaller number
        near = [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q]
        score = {k: (q % 7) * (k % 7) + 5.0 for k in range(45) if k != q}
        if q != 0:
            assert near == sorted(score, key=lambda k: (-score[k], k))[:4]


@pytest.mark.parametrize("name", [n for n in OPERATORS if n != "classifier"])
def test_operator_on_a_million_words(name, long_docs):
    docs, body = long_docs
    found = OPERATORS[name](docs).collect()
    if name == "judge":
        assert sorted(r["stats"]["n_words"] for r in found) == [60, len(words(body[:3_000_000])), LONG + 60]
    if name == "near_duplicates":
        assert {r["doc_id"]: r["component_id"] for r in found} == {1: 1, 2: 2, 3: 3}
    if name == "rlz_dedup":
        gone = {r["row"]["doc_id"]: (r["n_words"], r["n_removed"]) for r in found}
        assert gone[1] == (60, 0) and gone[2] == (LONG + 60, 60) and gone[3][1] >= gone[3][0] - 1
    if name == "suffix_dedup":
        assert {r["row"]["doc_id"]: r["n_bytes"] - len(r["kept"]) for r in found}[3] == 3_000_000
    if name == "pack":
        assert {r["doc_id"] for r in found} == {1, 2, 3} and max(r["length"] for r in found) == 2048
    if name == "licenses":
        assert sorted(r["n_words"] for r in found)[-1] == LONG + 60
    if name == "mix":
        assert sorted(r["size"] for r in found)[-1] == LONG + 60
    if name == "token_store":
        assert sorted(r["n_tokens"] for r in found)[-1] > LONG


def stages():
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)


STAGES = ["quality rules", "n-gram Jaccard join", "substring dedup", "mixing sources", "best-fit packing"]


@pytest.mark.parametrize("name", STAGES)
def test_stage_on_clashing_names_and_edges(name, spark, docs, rows):
    got = stages()[name](spark, docs, "")
    found = got.collect()
    if name == "best-fit packing":
        assert {(r["doc_id"], r["ids_crc32"]) for r in found} >= {(9, zlib.crc32(np.zeros(1, "<u4").tobytes()))}
        return
    assert got.columns == docs.columns
    assert {r[5:] for r in map(tuple, found)} == {tuple(NAMES)}
    ids = Counter(r["doc_id"] for r in found)
    if name == "quality rules":
        assert ids == Counter(r[0] for r in rows if r[1] in texts()[:8])
    if name == "n-gram Jaccard join":  # copies go, but rows without a number stay
        assert ids == Counter({**{k: 1 for k in range(len(texts())) if k not in (6, 7)}, None: 3})
    if name == "substring dedup":  # a copy has nothing left; rows of no words stay
        assert 6 not in ids and ids[8] == 3 and ids[None] == 2 and ids[2] == 2
        assert next(r for r in found if r["doc_id"] == 7)["text"] == "more" and next(r for r in found if r["doc_id"] == 7)["n_chars"] == 4
    if name == "mixing sources":
        assert not {8, 9, 10} & set(ids)


@pytest.mark.parametrize("name", STAGES)
def test_stage_on_no_rows(name, spark):
    assert stages()[name](spark, spark.createDataFrame([], SCHEMA), "").count() == 0
