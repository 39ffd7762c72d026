"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkframe.llm import jobs


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (a, b): the smallest vertex that links reach.

    Alternates large-star and small-star steps until every vertex has one edge, to its root. Minima are
    aggregated before their shuffle and written before they are joined, so the edges of a hub cost one
    row a partition in the aggregate, and the join is between plain tables, whose large partitions adaptive
    execution splits. Each round ends in a written table, so lineage stays short, and the table before it
    goes; nothing but whether it has settled reaches the driver.
    """
    now = jobs.written(edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "edges")
    for _ in range(rounds):
        ends = now.select(F.col("v").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(now.select(F.col("u").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        if ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 OR down + up > 1").isEmpty():
            break
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = jobs.written(both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m")), "least")
        # Large star: larger neighbours move to the smallest vertex around.
        large = both.filter("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).filter("v <> u").distinct()
        # Small star: smaller neighbours and the vertex itself move to the smallest of them; what a vertex has left are few.
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).filter("v <> u").unionByName(low.select("v", F.col("m").alias("u"))).distinct()
        after = jobs.written(small, "edges")
        jobs.dropped(now, least)
        now = after
    else:
        raise RuntimeError("components did not settle")
    # Settled, every vertex has one edge, to its root.
    out = jobs.written(now.unionByName(now.select(F.col("u").alias("v"), "u").distinct()).withColumnRenamed("u", "root"), "roots")
    jobs.dropped(now)
    return out
