"""Expression trees over columns and literals, lowered to Spark columns when used.

A field names a column of a frame and is looked up when the expression is used, so a column
replaced in between is seen with its new values. Lowering needs the operands' types: integer
literals widen to bigint, NaN compares false, integers divide with truncation, and floats
divide without errors, whatever the session's ANSI mode and time zone are.
"""

from __future__ import annotations

import datetime
import functools

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATING = (T.FloatType, T.DoubleType)


class Expr:
    """Base of fields, literals and operations."""

    __hash__ = None  # == builds an expression

    def frames(self) -> list:
        """The frames that fields name, each once."""
        raise NotImplementedError

    def lower(self, resolve) -> tuple[Column, T.DataType]:
        """The Spark column and its type; ``resolve(frame, name)`` gives a field's."""
        raise NotImplementedError

    def _with(self, op: str, other, swap: bool = False) -> Expr:
        other = wrap(other)
        return Operation(op, other, self) if swap else Operation(op, self, other)

    def __add__(self, other):
        return self._with("+", other)

    def __radd__(self, other):
        return self._with("+", other, swap=True)

    def __sub__(self, other):
        return self._with("-", other)

    def __rsub__(self, other):
        return self._with("-", other, swap=True)

    def __mul__(self, other):
        return self._with("*", other)

    def __rmul__(self, other):
        return self._with("*", other, swap=True)

    def __truediv__(self, other):
        return self._with("/", other)

    def __rtruediv__(self, other):
        return self._with("/", other, swap=True)

    def __lt__(self, other):
        return self._with("<", other)

    def __le__(self, other):
        return self._with("<=", other)

    def __gt__(self, other):
        return self._with(">", other)

    def __ge__(self, other):
        return self._with(">=", other)

    def __eq__(self, other):
        return self._with("==", other)

    def __ne__(self, other):
        return self._with("!=", other)

    def __and__(self, other):
        return self._with("and", other)

    def __or__(self, other):
        return self._with("or", other)

    def __bool__(self):
        raise TypeError("an expression has no truth value; use it as a filter, and & or | to combine")

    def _reduced(self, name: str):
        from sparkframe.operators.reduce import reduce_expr

        return reduce_expr(self, name)

    def count(self) -> int:
        """Number of values that aren't null."""
        return self._reduced("count")

    def sum(self):
        """Sum of the values that aren't null; None if there are none."""
        return self._reduced("sum")


class Field(Expr):
    def __init__(self, frame, name: str):
        self.frame, self.name = frame, name

    def frames(self):
        return [self.frame]

    def lower(self, resolve):
        return resolve(self.frame, self.name)


class Literal(Expr):
    def __init__(self, value):
        self.value = value

    def frames(self):
        return []

    def lower(self, resolve):
        v = self.value
        if isinstance(v, int):
            return F.lit(int(v)).cast("bigint"), T.LongType()
        if isinstance(v, float):
            return F.lit(v), T.DoubleType()
        # Through a string: a datetime literal would shift with the session's time zone.
        text = np.datetime64(v, "us").item().isoformat(sep=" ")
        return F.lit(text).cast("timestamp_ntz"), T.TimestampNTZType()


class Operation(Expr):
    def __init__(self, op: str, left: Expr, right: Expr):
        self.op, self.left, self.right = op, left, right

    def frames(self):
        out = []
        for f in [*self.left.frames(), *self.right.frames()]:
            if not any(f is g for g in out):
                out.append(f)
        return out

    def lower(self, resolve):
        a, at = self.left.lower(resolve)
        b, bt = self.right.lower(resolve)
        # A literal takes a float column's width, as bigint and double would widen it.
        if isinstance(at, T.FloatType) and isinstance(self.right, Literal) and isinstance(bt, T.LongType):
            b, bt = b.cast("float"), T.FloatType()
        if isinstance(bt, T.FloatType) and isinstance(self.left, Literal) and isinstance(at, T.LongType):
            a, at = a.cast("float"), T.FloatType()
        if self.op in ("and", "or"):
            return (a & b if self.op == "and" else a | b), T.BooleanType()
        if self.op in _COMPARE:
            return _compare(self.op, a, at, b, bt), T.BooleanType()
        if self.op == "/":
            return _divide(a, at, b, bt)
        out = {"+": a + b, "-": a - b, "*": a * b}[self.op]
        return out, _arithmetic_type(at, bt)


_COMPARE = {
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
}


def _either_nan(a, at, b, bt) -> Column | None:
    tests = [F.isnan(c) for c, t in ((a, at), (b, bt)) if isinstance(t, _FLOATING)]
    return functools.reduce(lambda x, y: x | y, tests) if tests else None


def _compare(op, a, at, b, bt) -> Column:
    plain = _COMPARE[op](a, b)
    nan = _either_nan(a, at, b, bt)
    if nan is None:
        return plain
    # The plain comparison stays a conjunct of its own, so that it can reach the scan.
    if op == "!=":
        return plain | (a.isNotNull() & b.isNotNull() & nan)
    return plain & ~nan


def _arithmetic_type(at, bt) -> T.DataType:
    if isinstance(at, _INTEGRAL) and isinstance(bt, _INTEGRAL):
        return at if _INTEGRAL.index(type(at)) >= _INTEGRAL.index(type(bt)) else bt
    if isinstance(at, T.FloatType) and isinstance(bt, T.FloatType):
        return at
    if isinstance(at, (*_INTEGRAL, *_FLOATING)) and isinstance(bt, (*_INTEGRAL, *_FLOATING)):
        return T.DoubleType()
    if isinstance(at, (T.TimestampNTZType, T.TimestampType)) and type(at) is type(bt):
        return T.DayTimeIntervalType()
    return at


def _divide(a, at, b, bt) -> tuple[Column, T.DataType]:
    if isinstance(at, _INTEGRAL) and isinstance(bt, _INTEGRAL):
        return F.call_function("div", a, b), T.LongType()
    both_float = isinstance(at, T.FloatType) and isinstance(bt, T.FloatType)
    x, y = a.cast("double"), b.cast("double")
    negative = lambda c: c.cast("string").startswith("-")  # noqa: E731  also tells -0.0
    signed = F.when(negative(x) != negative(y), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    zero = F.when((x == 0) | F.isnan(x), F.lit(float("nan"))).otherwise(signed)
    out = F.when(x.isNull() | y.isNull(), F.lit(None).cast("double")).when(y == 0, zero).otherwise(x / F.when(y == 0, F.lit(1.0)).otherwise(y))
    return (out.cast("float"), T.FloatType()) if both_float else (out, T.DoubleType())


def wrap(value) -> Expr:
    """An expression as it is, or a literal of a supported Python type."""
    if isinstance(value, Expr):
        return value
    if isinstance(value, np.generic) and not isinstance(value, np.datetime64):
        value = value.item()
    if isinstance(value, (int, float, np.datetime64, datetime.datetime)):
        return Literal(value)
    if isinstance(value, str):
        return StringLiteral(value)
    raise ValueError(f"unsupported operand type: {type(value).__name__}")


class StringLiteral(Literal):
    def lower(self, resolve):
        return F.lit(self.value), T.StringType()
