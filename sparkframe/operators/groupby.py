"""Grouped aggregates (A1-A16). Results are named ``op(column)`` and follow the keys."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T


def _sum(c, kind):
    if not isinstance(kind, T.NumericType):
        raise TypeError("sum needs a numeric column")
    return F.sum(c.cast("double") if isinstance(kind, T.FloatType) else c)


#: name -> (column, its type) -> aggregate; nulls are skipped, and a group of nulls gives null, or 0 where it counts.
AGGREGATES = {
    "sum": _sum,
    "count": lambda c, kind: F.count(c),
    "all": lambda c, kind: F.bool_and(c),
    "any": lambda c, kind: F.bool_or(c),
    "approximate_median": lambda c, kind: F.percentile_approx(c, 0.5, 10000).cast("double"),
    "median": lambda c, kind: F.median(c),
    "count_distinct": lambda c, kind: F.countDistinct(c),
    "distinct": lambda c, kind: F.array_sort(F.collect_set(c)),
    "first": lambda c, kind: F.first(c, ignorenulls=True),
    "last": lambda c, kind: F.last(c, ignorenulls=True),
    "first_last": lambda c, kind: F.struct(F.first(c, ignorenulls=True).alias("first"), F.last(c, ignorenulls=True).alias("last")),
}
_ORDERED = {"first": (F.min_by,), "last": (F.max_by,), "first_last": (F.min_by, F.max_by)}


class GroupBy:
    def __init__(self, frame, keys: list[str]):
        if not keys:
            raise ValueError("groupby needs a key")
        for k in keys:
            if k not in frame.columns:
                raise KeyError(k)
        self._frame, self._keys = frame, keys

    def __getitem__(self, name: str) -> GroupedField:
        if name not in self._frame.columns:
            raise KeyError(name)
        return GroupedField(self, name)

    def sum(self):
        raise NotImplementedError("choose a column: groupby(keys)[column].sum()")

    def count(self):
        raise NotImplementedError("choose a column: groupby(keys)[column].count()")

    def aggregate(self, spec: dict, order_by: str | None = None):
        """{column: op or [ops]} in order. ``order_by`` makes first and last those by that column."""
        if not isinstance(spec, dict):
            raise NotImplementedError("aggregate needs a dict of columns and operations")
        pairs = [(c, op) for c, ops in spec.items() for op in ([ops] if isinstance(ops, str) else ops)]
        return self._run(pairs, order_by)

    agg = aggregate

    def _run(self, pairs, order_by=None):
        from sparkframe.operators.frame import DataFrame, quoted

        types, out = {f.name: f.dataType for f in self._frame.sdf.schema}, []
        if not pairs:
            raise ValueError("aggregate needs an operation")
        for name, op in pairs:
            if not isinstance(op, str) or op not in AGGREGATES:
                raise ValueError(f"unknown aggregate {op!r}; there are {', '.join(AGGREGATES)}")
            if name not in types:
                raise KeyError(name)
        if self._frame._joined is not None:
            from sparkframe.operators.joins import aggregated

            early = aggregated(self._frame._joined, self._keys, [(name, op, f"{op}({name})") for name, op in pairs])
            if early is not None:
                return DataFrame(early)
        for name, op in pairs:
            c = F.col(quoted(name))
            if order_by is not None and op in _ORDERED:
                by = F.when(c.isNotNull(), F.col(quoted(order_by)))  # a null order value is passed over
                parts = [f(c, by) for f in _ORDERED[op]]
                made = parts[0] if len(parts) == 1 else F.struct(parts[0].alias("first"), parts[1].alias("last"))
            else:
                made = AGGREGATES[op](c, types[name])
            out.append(made.alias(f"{op}({name})"))
        keys = [F.col(quoted(k)) for k in self._keys]
        sdf = self._frame.sdf
        if [op for _, op in pairs] == ["distinct"] and pairs[0][0] not in self._keys:
            # Equal values go before the lists are made, a shuffle on key and value.
            sdf = sdf.select(*keys, F.col(quoted(pairs[0][0]))).distinct()
        return DataFrame(sdf.groupBy(*keys).agg(*out))


class GroupedField:
    def __init__(self, group: GroupBy, name: str):
        self._group, self._name = group, name

    def sum(self):
        return self._group._run([(self._name, "sum")])

    def count(self):
        return self._group._run([(self._name, "count")])

    def aggregate(self, op: str, order_by: str | None = None):
        if not isinstance(op, str):
            raise ValueError("aggregate needs an operation's name")
        return self._group._run([(self._name, op)], order_by)

    agg = aggregate
