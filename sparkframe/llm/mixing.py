"""Mixing sources to target weights by weighted fair queueing.

A source's documents stand in a shuffled queue, twice over, since a document may be taken twice.
A document's virtual finish time is its source's words so far, itself included, divided by the
source's target. All queues merge in order of finish time and the mix ends where the total budget
does, so every source comes as near to its target as its documents' sizes allow.

Running sums have two levels (cells of a queue, then documents of a cell), so no source gathers in
one task; only a table of sources and sums of cells are gathered. The shuffle is a seeded hash, so reruns agree.

Defined results: a null text has no words and is never taken; a null source is a source of its own,
the last; equal rows stand in the queue each by itself; an empty table gives no rows; only the
named columns are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkframe.llm import jobs
from sparkframe.llm.columns import carried, n_words

WEIGHTS, SHARE_NUM, SHARE_DEN, REPEATS, SEED = (5, 2, 1), 3, 2, 2, 20240607
#: Documents that a cell of a queue holds, about.
_CELL_ROWS = 2_000


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from each source's (source, source_size).

    Targets share the budget by weight, none above ``REPEATS`` times its source's size; what is
    cut off is shared by weight among the others. With sources in order of size per weight, the
    first ones are at their limit, and the least number of them is right for which all others
    stay below theirs.
    """
    by_code = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in WEIGHTS]), (F.col("i") % len(WEIGHTS) + 1).cast("int"))
    ranked = sizes.withColumn("i", F.row_number().over(by_code) - 1).withColumn("weight", weight)
    order = [(F.col("source_size").cast("decimal(38,12)") / F.col("weight")), F.col("i")]
    before, every = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(every)
    state = ranked.withColumn("total", total).withColumn("all_weight", F.sum("weight").over(every)).withColumn("full", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * REPEATS).withColumn("full_weight", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # What a unit of weight gets if just the sources before this one are at their limit; times two, to stay whole.
    left, rest = SHARE_NUM * F.col("total") - SHARE_DEN * F.col("full"), SHARE_DEN * (F.col("all_weight") - F.col("full_weight"))
    below = left.cast("decimal(38,0)") * F.col("weight") <= (REPEATS * F.col("source_size")).cast("decimal(38,0)") * rest
    marked = state.withColumn("below", below).withColumn("unit", F.when(below, F.struct(F.row_number().over(Window.orderBy(*order)).alias("k"), left.alias("left"), rest.alias("rest"))))
    first = F.min("unit").over(every)
    share = F.when(F.col("cut").isNull() | (F.col("k") < F.col("cut.k")), (REPEATS * F.col("source_size")).cast("double")).otherwise(F.col("cut.left").cast("double") * F.col("weight") / F.col("cut.rest"))
    return marked.withColumn("k", F.row_number().over(Window.orderBy(*order))).withColumn("cut", first).select("source", "source_size", share.alias("target"))


def running(rows: DataFrame, keys: list[str], order: list, cell: str, value: str, out: str) -> DataFrame:
    """``rows`` with ``out``: the sum of ``value`` up to each row within ``keys``, ordered by ``cell``, then ``order``."""
    cells = rows.groupBy(*keys, cell).agg(F.sum(value).alias("__n"))
    before = cells.withColumn("__before", F.sum("__n").over(Window.partitionBy(*keys).orderBy(cell)) - F.col("__n")).drop("__n") if keys else cells.withColumn("__before", F.sum("__n").over(Window.orderBy(cell)) - F.col("__n")).drop("__n")
    cond = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, cell]]
    joined = rows.alias("a").join(before.alias("b"), cond).select("a.*", "b.__before")
    inside = F.sum(value).over(Window.partitionBy(*keys, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return joined.withColumn(out, inside + F.col("__before")).drop("__before")


def sized(docs: DataFrame, row: Column, number: Column, text: Column, source: Column, seed: int = SEED) -> DataFrame:
    """(row, id, source, size, at) of every document; ``row`` is a number of its own, fixed by being written."""
    shuffled = F.xxhash64(F.lit(seed), number.cast("string"), F.xxhash64(text))
    return jobs.written(docs.select(row.alias("row"), number.cast("long").alias("id"), source.cast("string").alias("source"), n_words(text).alias("size"), shuffled.alias("at")), "sizes")


def decided(narrow: DataFrame) -> DataFrame:
    """(row, id, source, size, source_size, target, passes) of every row of ``narrow``, which has the columns of ``sized``."""
    goal = targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")))
    cells = jobs.parts_for(narrow.count(), _CELL_ROWS)
    queue = narrow.withColumn("cell", F.pmod(F.col("at"), F.lit(cells)).cast("int"))
    queue = running(queue, ["source"], ["at", "id", "size", "row"], "cell", "size", "sofar")
    joined = queue.alias("q").join(F.broadcast(goal).alias("g") if goal.count() <= 100_000 else goal.alias("g"), F.col("q.source").eqNullSafe(F.col("g.source"))).select("q.row", "q.id", "q.source", "q.size", "q.at", "q.sofar", "g.source_size", "g.target")
    # Both passes of the queue; times are in billionths of a source's target.
    time = lambda words: F.when(F.col("target") > 0, F.floor(words / F.col("target") * 1e9)).otherwise(F.lit(0)).cast("long")
    passes = joined.withColumn("pass", F.explode(F.array(*[F.lit(k) for k in range(REPEATS)]))).withColumn("finish", time((F.col("sofar") + F.col("pass") * F.col("source_size")).cast("double")))
    budget = F.floor(F.lit(SHARE_NUM) * F.sum("source_size") / SHARE_DEN).cast("long")
    total = goal.agg(F.coalesce(budget, F.lit(0)).alias("budget"))
    # Every queue's finish times run evenly to the budget at 1, so cells of equal time hold equal shares.
    merged = running(passes.withColumn("slot", F.floor(F.col("finish") / F.lit(REPEATS * 1e9 / cells)).cast("long")), [], ["finish", "at", "id", "pass", "size", "source", "row"], "slot", "size", "words")
    chosen = merged.crossJoin(F.broadcast(total)).withColumn("in", (F.col("words") <= F.col("budget")) & (F.col("size") > 0))
    # Rows may agree in all but their own number.
    return chosen.groupBy("row", "id", "source", "size", "source_size", "target").agg(F.sum(F.col("in").cast("long")).alias("passes"))


def mix(docs: DataFrame, number: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """(number, size, source, source_size, target, passes, taken) of every document: how often the mix takes it, and how many words."""
    c = lambda n: F.col(f"`{n}`")
    per = decided(sized(docs, F.monotonically_increasing_id(), c(number), c(text), c(source), seed))
    return per.select(F.col("id").alias(number), "size", "source", "source_size", "target", "passes", (F.col("passes") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, number: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` as the mix takes them: a document taken twice is there twice, one not taken is left out."""
    c = lambda n: F.col(f"row.`{n}`")
    # Written, so that the numbers are the same when the rows are read again for the join.
    packed = jobs.written(carried(docs, own=F.monotonically_increasing_id()), "numbered")
    found = decided(sized(packed, F.col("own"), c(number), c(text), c(source))).select(F.col("row").alias("which"), "passes").filter("passes > 0")
    joined = packed.join(found, F.col("own") == F.col("which"))
    return joined.select("row", F.explode(F.array_repeat(F.lit(1), F.col("passes").cast("int")))).select("row.*")


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
