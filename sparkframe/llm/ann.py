"""Approximate nearest neighbours by cross-polytope hashing.

A vector is turned by a pseudo-rotation (three rounds of random signs and a fast Hadamard transform)
and belongs to the signed axis it lies nearest to. Several tables with rotations of their own hold every
vector; a query looks into the buckets of the axes it lies nearest to, in every table, and candidates
are ranked exactly by inner product in double precision.

The vectors and the queries of every bucket are counted first; a bucket with more than ``BLOCK_ROWS`` of
either is cut into blocks, and every block of queries meets every block of vectors, so a bucket of any
size is searched whole by tasks of bounded size. Only the counts, two for each axis of each table, reach the
driver. Equal vectors stand in the tables once, with the smallest ids that a query can need; equal queries
are searched once. Candidates near the last place are told apart by sums in the order of the final scores.

Defined results: vectors that are null, of another length than most, zero, or with null or non-finite
components take no part, as query or candidate; a query with fewer candidates than asked gets all
that were found; rows with one id count as one vector each; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkframe.llm import jobs
from sparkframe.llm.tokens import mix, spread

TABLES, PROBES, SEED = 8, 16, 7
#: Vectors, or queries, of a block, and pairs that are scored at once.
BLOCK_ROWS, TILE = 16_384, 1 << 22


def rotations(dims: int, tables: int, seed: int = SEED) -> np.ndarray:
    """Random signs for each table's three rounds, over the next power of two of dimensions."""
    width = 1 << max(1, int(np.ceil(np.log2(max(dims, 2)))))
    return np.random.Generator(np.random.PCG64(seed)).choice([-1.0, 1.0], (tables, 3, width))


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """The rows of ``x`` under one table's pseudo-rotation."""
    width = signs.shape[1]
    y = np.zeros((len(x), width))
    y[:, : x.shape[1]] = x
    for s in signs:
        y = y * s
        h = 1
        while h < width:
            z = y.reshape(len(y), -1, 2, h)
            y = np.concatenate([(z[:, :, :1] + z[:, :, 1:]), (z[:, :, :1] - z[:, :, 1:])], axis=2).reshape(len(y), width)
            h *= 2
        y = y / np.sqrt(width)
    return y


def axes(y: np.ndarray, most: int) -> np.ndarray:
    """For each row its ``most`` nearest signed axes: axis, or axis + width for its negative."""
    both = np.concatenate([y, -y], axis=1)
    most = min(most, both.shape[1])
    top = np.argpartition(-both, most - 1, axis=1)[:, :most]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(both, top, axis=1), axis=1, kind="stable"), axis=1)


def _matrix(column) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(values, np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products over the last axis, added one after another as the final scores are."""
    out = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]))
    for d in range(a.shape[-1]):
        out += a[..., d] * b[..., d]
    return out


def nearest(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``a`` the ``k`` rows of ``b`` with the largest products, ties to the first; and the products.

    A matrix product picks some more than ``k``, and sums in order decide among them. A row in which it
    can't tell those picked from the others, as their products lie within its rounding, is summed in order whole.
    """
    rough = a @ b.T
    k, more = min(k, len(b)), min(2 * k + 8, len(b))
    pick = np.argpartition(-rough, more - 1, axis=1)[:, :more]
    pick.sort(axis=1)
    score = in_order(a[:, None, :], b[pick])
    order = np.argsort(-score, axis=1, kind="stable")[:, :k]
    top, score = np.take_along_axis(pick, order, axis=1), np.take_along_axis(score, order, axis=1)
    if more < len(b):
        slack = 4 * a.shape[1] * np.finfo(float).eps * np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1).max()
        lowest = np.take_along_axis(rough, pick, axis=1).min(axis=1)
        for r in np.flatnonzero(~(lowest < score[:, -1] - slack)):
            whole = in_order(a[r][None], b)
            top[r] = np.argsort(-whole, kind="stable")[:k]
            score[r] = whole[top[r]]
    return top, score


def usable(vector):
    """Whether a vector column's value takes part."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, ok) & F.exists(vector, lambda x: x != 0), F.lit(False))


def search(vectors: DataFrame, is_query, k: int, number: str = "vec_id", vector: str = "embedding", tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest found. ``is_query`` is a condition on ``id``."""
    rows = vectors.select(F.col(f"`{number}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).filter(usable(F.col("v")) & F.col("id").isNotNull())
    dims = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    spark = vectors.sparkSession
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("v") == dims["n"]).withColumn("h", F.xxhash64("v"))
    # The smallest k + 1 ids of equal vectors are all that any query can need. First within salts, then together.
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    first = salted.withColumn("r", F.row_number().over(Window.partitionBy("v", "salt").orderBy("id"))).filter(F.col("r") <= k + 1)
    few = first.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("r") <= k + 1)
    distinct = jobs.written(few.groupBy("h", "v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("rep", F.col("ids")[0]), "vectors")
    asked = jobs.written(rows.filter(is_query).select(F.col("id").alias("query_id"), "v"), "queries")
    asked_distinct = asked.select("v").distinct().join(distinct.select("v", "rep"), "v")
    signs = rotations(dims["n"], tables)
    width = signs.shape[2]

    def buckets(x: np.ndarray, probe: int) -> np.ndarray:
        """Each vector's buckets in all tables, a row each."""
        unit = x / np.abs(x).max(axis=1, keepdims=True)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        return np.concatenate([t * 2 * width + axes(rotate(unit, signs[t]), probe) for t in range(tables)], axis=1)

    def parts(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                yield part, _matrix(part.column("v"))

    def counted(df: DataFrame, probe: int) -> np.ndarray:
        """How many blocks each bucket needs."""

        def run(batches):
            total = np.zeros(tables * 2 * width, np.int64)
            for _, x in parts(batches):
                total += np.bincount(buckets(x, probe).ravel(), minlength=len(total))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["key", "n"])

        out = np.ones(tables * 2 * width, np.int64)
        for r in df.select("v").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect():  # two for each axis of each table at most
            out[r["key"]] = -(-r["n"] // BLOCK_ROWS)
        return out

    held_blocks, sought_blocks = counted(distinct, 1), counted(asked_distinct, probes)

    def place(probe: int, own: np.ndarray, others: np.ndarray, query: bool):
        """Each vector in a block of its own kind in each of its buckets, once for every block of the other kind."""

        def run(batches):
            for part, x in parts(batches):
                reps = part.column("rep").to_numpy()
                where = buckets(x, probe)
                each = max(1, 65536 // where.shape[1])
                for i in range(0, len(x), each):
                    key = where[i : i + each].ravel()
                    row = np.repeat(np.arange(i, min(len(x), i + each)), where.shape[1])
                    mine = (mix(reps[row].view(np.uint64), 5) % own[key].astype(np.uint64)).astype(np.int64)
                    copies = others[key]
                    other = spread(np.zeros(len(key), np.int64), copies)
                    key, row, mine = np.repeat(key, copies), np.repeat(row, copies), np.repeat(mine, copies)
                    a, b = (mine, other) if query else (other, mine)
                    for k in range(0, len(key), 65536):
                        s = slice(k, k + 65536)
                        yield pa.RecordBatch.from_arrays([pa.array(key[s]), pa.array(a[s]), pa.array(b[s]), pa.array(reps[row[s]]), part.column("v").take(pa.array(row[s]))], ["key", "i", "j", "rep", "v"])

        return run

    schema = "key long, i long, j long, rep long, v array<double>"
    held = distinct.select("rep", "v").mapInArrow(place(1, held_blocks, sought_blocks, False), schema)
    sought = asked_distinct.select("rep", "v").mapInArrow(place(probes, sought_blocks, held_blocks, True), schema)

    def rank(queries: pa.Table, block: pa.Table) -> pa.Table:
        out = {"query": [], "rep": [], "score": []}
        if queries.num_rows and block.num_rows:
            b, ids = _matrix(block.column("v").combine_chunks()), block.column("rep").to_numpy()
            order = np.argsort(ids)
            b, ids = b[order], ids[order]
            a, names = _matrix(queries.column("v").combine_chunks()), queries.column("rep").to_numpy()
            each = min(2048, max(1, TILE // len(b)))
            for i in range(0, len(a), each):
                top, score = nearest(a[i : i + each], b, k + 1)
                out["query"].append(np.repeat(names[i : i + each], top.shape[1]))
                out["rep"].append(ids[top].ravel())
                out["score"].append(score.ravel())
        return pa.table({c: pa.array(np.concatenate(x) if x else np.zeros(0), pa.float64() if c == "score" else pa.int64()) for c, x in out.items()})

    found = sought.groupBy("key", "i", "j").cogroup(held.groupBy("key", "i", "j")).applyInArrow(rank, "query long, rep long, score double")
    found = found.groupBy("query", "rep").agg(F.max("score").alias("score"))
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "rep"))).filter(F.col("r") <= k + 1).select("query", "rep")
    # Scores anew, each in one fixed order of additions, so that equal pairs have equal scores.
    sides = best.join(distinct.select("rep", "ids", F.col("v").alias("y")), "rep").join(distinct.select(F.col("rep").alias("query"), F.col("v").alias("x")), "query")
    product = F.aggregate(F.zip_with("x", "y", lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    scored = sides.select("query", F.explode("ids").alias("vec_id"), product.alias("score"))
    near = scored.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).filter(F.col("r") <= k + 1)
    lists = near.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("low"), "vec_id", "score"))).alias("near"))
    named = asked.join(distinct.select("v", F.col("rep").alias("query")), "v").select("query_id", "query").join(lists, "query")
    own = named.select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    out = own.select("query_id", F.posexplode("near").alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op7_cross_polytope(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, F.col("id") % 20 == 0, 20)
