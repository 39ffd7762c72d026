"""Equi-joins of eight kinds (J1-J13). Catalyst and adaptive execution choose the strategy."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame as SparkDataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("inner", "left_outer", "right_outer", "full_outer", "left_semi", "right_semi", "left_anti", "right_anti")
_ALIASES = {"left": "left_outer", "right": "right_outer", "outer": "full_outer"}


def _names(keys) -> list[str] | None:
    return [keys] if isinstance(keys, str) else None if keys is None else list(keys)


def merge(left, right, on=None, left_on=None, right_on=None, how: str = "inner"):
    """Rows of both frames whose keys are equal; null equals nothing.

    Inner and outer joins return all columns of the left, then of the right; a name that both
    have gets ``_l`` and ``_r``, keys included. Semi and anti joins return one side's columns.
    """
    from sparkframe.operators.frame import DataFrame, quoted

    how, on, left_on, right_on = _ALIASES.get(how, how), _names(on), _names(left_on), _names(right_on)
    if how not in KINDS:
        raise ValueError(f"how must be one of {', '.join(KINDS)}")
    if left_on is None and right_on is None:
        if on is None:
            raise ValueError("Required argument 'on'")
        left_on = right_on = on
    if left_on is None or right_on is None:
        raise ValueError("left_on and right_on go together")
    if len(left_on) != len(right_on) or not left_on:
        raise ValueError("both sides need the same number of keys, one at least")
    for frame, keys in ((left, left_on), (right, right_on)):
        for k in keys:
            if k not in frame.columns:
                raise KeyError(k)

    # Each side gets names of its own, so that a self-join and equal names stay apart.
    a = left.sdf.select(*[F.col(quoted(c)).alias(f"l{i}") for i, c in enumerate(left.columns)])
    b = right.sdf.select(*[F.col(quoted(c)).alias(f"r{i}") for i, c in enumerate(right.columns)])
    pairs = [F.col(f"l{left.columns.index(x)}") == F.col(f"r{right.columns.index(y)}") for x, y in zip(left_on, right_on, strict=True)]
    condition = functools.reduce(lambda x, y: x & y, pairs)
    if how in ("left_semi", "left_anti"):
        joined = a.join(b, condition, how)
        return DataFrame(joined.select(*[F.col(f"l{i}").alias(c) for i, c in enumerate(left.columns)]))
    if how in ("right_semi", "right_anti"):
        joined = b.join(a, condition, how.replace("right", "left"))
        return DataFrame(joined.select(*[F.col(f"r{i}").alias(c) for i, c in enumerate(right.columns)]))
    both = {*left.columns} & {*right.columns}
    names = [f"{c}_l" if c in both else c for c in left.columns] + [f"{c}_r" if c in both else c for c in right.columns]
    if len({*names}) < len(names):
        raise ValueError("a suffixed name equals another column's: " + ", ".join(sorted({n for n in names if names.count(n) > 1})))
    inner = [*(f"l{i}" for i in range(len(left.columns))), *(f"r{i}" for i in range(len(right.columns)))]
    out = DataFrame(a.join(b, condition, how).select(*[F.col(x).alias(n) for x, n in zip(inner, names, strict=True)]))
    if how == "inner":
        keys = [(f"l{left.columns.index(x)}", f"r{right.columns.index(y)}") for x, y in zip(left_on, right_on, strict=True)]
        out._joined = Joined(a, b, keys, dict(zip(names, inner, strict=True)), left.sdf is right.sdf and left_on == right_on)
    return out


@dataclass(frozen=True)
class Joined:
    """What an inner join was made of: both sides, pairs of key columns, the sides' column behind each name,
    and whether the sides are one table by the same keys."""

    left: SparkDataFrame
    right: SparkDataFrame
    keys: list[tuple[str, str]]
    place: dict[str, str]
    same: bool


def aggregated(joined: Joined, group: list[str], wanted: list[tuple[str, str, str]]):
    """Sums and counts of a join grouped by all of its keys, from sums and counts of either side, or None.

    Rows with the same keys pair all with all, so a side's count is multiplied by the other side's
    number of rows instead of making the pairs. A table that meets itself by the same keys is aggregated
    once. ``wanted`` has (column, operation, name).
    """
    from sparkframe.operators.frame import quoted

    place, of_key = joined.place, {c: k for k, pair in enumerate(joined.keys) for c in pair}
    by = [of_key.get(place[g]) for g in group]
    if None in by or sorted(by) != list(range(len(joined.keys))) or any(op not in ("sum", "count") for _, op, _ in wanted):
        return None
    types = {f.name: f.dataType for side in (joined.left, joined.right) for f in side.schema}
    # Equal keys of other types, or of floats that are equal and look different, would need the pairs.
    plain = (T.IntegralType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)
    if any(types[a] != types[b] or not isinstance(types[a], plain) for a, b in joined.keys):
        return None
    if any(op == "sum" and not isinstance(types[place[c]], (T.IntegralType, T.DoubleType)) for c, op, _ in wanted):
        return None
    made = {"sum": F.sum, "count": F.count}
    if joined.same:
        # A join would hold the same groups twice, and a sorted copy of both.
        keys = [x for x, _ in joined.keys]
        parts = [made[op](f"l{place[c][1:]}").alias(f"v{i}") for i, (c, op, _) in enumerate(wanted)]
        known = functools.reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])
        met = joined.left.filter(known).groupBy(*keys).agg(F.count("*").alias("n"), *parts)
        values = [(F.col(f"v{i}") * F.col("n")).alias(name) for i, (_, _, name) in enumerate(wanted)]
        return met.select(*[F.col(keys[k]).alias(g) for g, k in zip(group, by, strict=True)], *values)
    sides = []
    for side, k, mark in ((joined.left, 0, "l"), (joined.right, 1, "r")):
        parts = [made[op](F.col(place[c])).alias(f"v{i}") for i, (c, op, _) in enumerate(wanted) if place[c].startswith(mark)]
        sides.append(side.groupBy(*[F.col(pair[k]).alias(f"{mark}k{i}") for i, pair in enumerate(joined.keys)]).agg(F.count("*").alias(f"{mark}n"), *parts))
    met = sides[0].join(sides[1], functools.reduce(lambda x, y: x & y, [F.col(f"lk{i}") == F.col(f"rk{i}") for i in range(len(joined.keys))]))
    other = {"l": "rn", "r": "ln"}
    values = [(F.col(f"v{i}") * F.col(other[place[c][0]])).alias(name) for i, (c, _, name) in enumerate(wanted)]
    return met.select(*[F.col(f"lk{k}").alias(g) for g, k in zip(group, by, strict=True)], *values)
