"""Whole-column sum and count (A17-A19): one row to the driver, from partial aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T


def reduce_expr(expr, name: str):
    """The reduction of any expression over one frame; a sum of no values is None."""
    frames = expr.frames()
    if not frames:
        raise ValueError("a literal has no rows")
    sdf, column, kind = frames[0]._bind(expr)
    if name == "sum" and not isinstance(kind, T.NumericType):
        raise TypeError("sum needs a numeric column")
    if name == "sum" and isinstance(kind, T.FloatType):
        column = column.cast("double")
    return sdf.agg({"sum": F.sum, "count": F.count}[name](column)).first()[0]
