"""Documents to packed training sequences: quality rules, near duplicates, substrings, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns of
documents. ``run`` writes each stage's rows to the cluster's shared folder and reads them again for
the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from sparkframe.llm import jobs, mixing, ngram_join, packing, quality_rules, rlz_dedup


def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every quality rule lets pass; null, empty and blank texts go, equal rows stay or go together."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest number of each group of near duplicates, once; texts without words and rows without a number stay, equal numbers are one document."""
    return ngram_join.one_of_each(docs)


def substrings(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller number has, null being the largest; documents with nothing left go, texts that had no words stay."""
    return rlz_dedup.without_repeats(docs)


def mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix of sources takes them, some twice; each row by itself, texts without words never, a null source is a source."""
    return mixing.mixed(docs)


def pack(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's pieces and their places in sequences; a text without ids is its end token alone."""
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("substring dedup", substrings), ("mixing sources", mix), ("best-fit packing", pack)]

#: Near duplicates, cuts judged on all documents and token ids have no SQL.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = jobs.written(docs, f"stage{k}")
    return docs
