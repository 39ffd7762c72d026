"""The frame: a Spark DataFrame behind a small pandas-like API."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame as SparkDataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkframe.functions.expr import Expr, Field, wrap
from sparkframe.session import get_session, is_dry


def quoted(name: str) -> str:
    """A column name as Spark's parser takes it, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def arrow_table(sdf: SparkDataFrame):
    """All rows as an Arrow table, timestamps with a zone as the session's local time."""
    import pyarrow as pa
    import pyarrow.compute as pc

    table = sdf.toArrow()
    for i, f in enumerate(table.schema):
        if pa.types.is_timestamp(f.type) and f.type.tz:
            zone = sdf.sparkSession.conf.get("spark.sql.session.timeZone")
            table = table.set_column(i, f.name, pc.local_timestamp(table.column(i).cast(pa.timestamp(f.type.unit, zone))))
    return table


class DataFrame:
    """A table. Derived frames are new; only ``frame[name] = ...`` changes a frame in place."""

    def __init__(self, source):
        if isinstance(source, str):
            from sparkframe.sources.parquet import scan

            source = scan(source)
        elif isinstance(source, pd.DataFrame):
            source = get_session().createDataFrame(source)
        if not isinstance(source, SparkDataFrame):
            raise NotImplementedError(f"a frame can't be made of {type(source).__name__}")
        self._sdf = source
        #: For the rows of an inner join, what they were made of.
        self._joined = None

    @property
    def sdf(self) -> SparkDataFrame:
        """The Spark DataFrame behind this frame."""
        return self._sdf

    @property
    def columns(self) -> list[str]:
        return self._sdf.columns

    def __getitem__(self, key):
        if isinstance(key, str):
            if key not in self._sdf.columns:
                raise KeyError(key)
            return Field(self, key)
        if isinstance(key, (list, tuple)):
            return DataFrame(self._sdf.select(*[F.col(quoted(c)) for c in key]))
        if isinstance(key, Expr):
            sdf, column, kind = self._bind(key)
            if not isinstance(kind, T.BooleanType):
                raise TypeError("a filter must be boolean")
            return DataFrame(sdf.filter(column).select(*[sdf[quoted(c)] for c in self.columns]))
        raise TypeError(f"a frame can't be indexed by {type(key).__name__}")

    def __setitem__(self, name: str, value) -> None:
        sdf, column, _ = self._bind(wrap(value))
        self._joined = None
        if sdf is self._sdf:
            self._sdf = sdf.withColumn(name, column)
            return
        out = [column.alias(name) if c == name else sdf[quoted(c)] for c in self.columns]
        self._sdf = sdf.select(*out, *([] if name in self.columns else [column.alias(name)]))

    def _bind(self, expr: Expr):
        """The frame to evaluate on, the Spark column and its type. Other frames' columns pair by row position."""
        others = [f for f in expr.frames() if f is not self]
        sdf, place = self._sdf, {}
        if others:
            from sparkframe.operators.align import side_by_side

            sdf, place = side_by_side(self, others, expr)

        def resolve(frame, name):
            types = {f.name: f.dataType for f in frame._sdf.schema}
            if name not in types:
                raise KeyError(name)
            return F.col(quoted(name if frame is self else place[id(frame), name])), types[name]

        return (sdf, *expr.lower(resolve))

    def get(self) -> pd.DataFrame:
        """All rows, in this frame's order, as pandas; they travel as Arrow batches."""
        if is_dry():
            self.explain()
            return pd.DataFrame(columns=self.columns)
        return arrow_table(self._sdf).to_pandas()

    def print(self, n: int = 20) -> None:
        self.explain() if is_dry() else self._sdf.show(n, truncate=False)

    def size(self) -> int:
        if is_dry():
            self.explain()
            return 0
        return self._sdf.count()

    def memory_size(self) -> int:
        """Bytes that the optimiser expects of this frame's rows."""
        return int(self._sdf._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())

    def __len__(self) -> int:
        return self.size()

    def merge(self, other: DataFrame, on=None, left_on=None, right_on=None, how: str = "inner") -> DataFrame:
        from sparkframe.operators.joins import merge

        return merge(self, other, on, left_on, right_on, how)

    def join(self, other: DataFrame, on, how: str = "inner") -> DataFrame:
        return self.merge(other, on=on, how=how)

    def groupby(self, keys):
        from sparkframe.operators.groupby import GroupBy

        return GroupBy(self, [keys] if isinstance(keys, str) else list(keys))

    def sort_values(self, by, ascending: bool = True) -> DataFrame:
        """Rows in order of all the keys: values, then NaN, then null, in both directions."""
        order, types = [], {f.name: f.dataType for f in self._sdf.schema}
        for name in [by] if isinstance(by, str) else list(by):
            if name not in types:
                raise KeyError(name)
            c = F.col(quoted(name))
            order.append(c.isNull().asc())
            if isinstance(types[name], (T.FloatType, T.DoubleType)):
                order.append(F.coalesce(F.isnan(c), F.lit(False)).asc())
            order.append(c.asc() if ascending else c.desc())
        if not order:
            raise ValueError("sort_values needs a key")
        return DataFrame(self._sdf.orderBy(*order))

    def explain(self, mode: str = "formatted") -> None:
        self._sdf.explain(mode)

    def persist(self) -> DataFrame:
        self._sdf = self._sdf.persist()
        return self

    def unpersist(self) -> DataFrame:
        self._sdf = self._sdf.unpersist()
        return self
