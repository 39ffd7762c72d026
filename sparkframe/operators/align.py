"""Expressions over columns of several frames, whose rows pair by position (P20).

Each frame's rows get their dense position: the number of rows in the partitions before, plus the
place within the partition. Only one count a partition reaches the driver. The frames then join
on the position, a plain equi-join.

Counts and joins must see the same partitions. A frame that only scans, filters and projects gives
the same ones every time it is run, and one that is sorted or shuffled is written first, where
``spark.checkpoint.dir`` is set (a lost executor can't change rows then), else persisted.
"""

from __future__ import annotations

import re

from pyspark import StorageLevel
from pyspark.sql import DataFrame as SparkDataFrame
from pyspark.sql import functions as F


def unused(name: str, *taken) -> str:
    """``name``, or a longer one that none of the columns has."""
    have = {c.lower() for columns in taken for c in columns}
    while name.lower() in have:
        name += "_"
    return name


def _steady(sdf: SparkDataFrame) -> SparkDataFrame:
    """The same rows in partitions that stay the same, however often they are read."""
    plan = sdf._jdf.queryExecution().optimizedPlan().toString()
    if not re.search(r"(?m)^\W*(Sort|Aggregate|Join|Repartition|Window|Distinct|Generate|Sample|MapIn|FlatMap|Limit|GlobalLimit)", plan):
        return sdf
    if sdf.sparkSession.sparkContext.getCheckpointDir() or sdf.sparkSession.sparkContext.getConf().get("spark.checkpoint.dir"):
        return sdf.checkpoint()
    return sdf.persist(StorageLevel.MEMORY_AND_DISK)


def numbered(sdf: SparkDataFrame, position: str) -> tuple[SparkDataFrame, int]:
    """``sdf`` with each row's position from 0 in a column ``position``, and its number of rows."""
    spark = sdf.sparkSession
    mark = unused("__id", sdf.columns, [position])
    marked = _steady(sdf).withColumn(mark, F.monotonically_increasing_id())
    part = F.shiftrightunsigned(F.col(mark), 33)
    counts = sorted((r[0], r[1]) for r in marked.groupBy(part).count().collect())
    before, total = {}, 0
    for p, n in counts:
        before[p] = total
        total += n
    # One number a partition, as a literal array beside the rows; no join.
    starts = ",".join(str(before.get(p, 0)) for p in range(max(before, default=0) + 1))
    place = F.get(F.split(F.lit(starts), ",").cast("array<bigint>"), part.cast("int"))
    return marked.withColumn(position, (place + F.col(mark).bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop(mark), total


def side_by_side(frame, others, expr):
    """``frame`` with the other frames' columns that ``expr`` names, and where they are."""
    from sparkframe.functions.expr import Field, Operation
    from sparkframe.operators.frame import quoted

    wanted: dict[int, list[str]] = {}

    def visit(e):
        if isinstance(e, Field) and e.frame is not frame:
            names = wanted.setdefault(id(e.frame), [])
            if e.name not in names:
                names.append(e.name)
        elif isinstance(e, Operation):
            visit(e.left)
            visit(e.right)

    visit(expr)
    taken = [frame.columns, *(f.columns for f in others)]
    position = unused("__position", *taken)
    out, size = numbered(frame.sdf, position)
    place = {}
    for k, other in enumerate(others):
        side, n = numbered(other.sdf, position)
        if n != size:
            raise ValueError(f"rows pair by position: {size} and {n} rows")
        names = wanted[id(other)]
        place |= {(id(other), c): unused(f"__other{k}_{i}", *taken) for i, c in enumerate(names)}
        side = side.select(position, *[F.col(quoted(c)).alias(place[id(other), c]) for c in names])
        out = out.join(side, position)
    # Rows keep the frame's order.
    return out.orderBy(position), place
