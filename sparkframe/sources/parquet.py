"""Parquet scans, with the path's last part as a regular expression."""

from __future__ import annotations

import os
import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkframe.session import get_session

_REMOTE = re.compile(r"^[a-z][a-z0-9+.-]*://[^/]*", re.IGNORECASE)


def expand(path: str, spark=None) -> list[str]:
    """Sorted files below the path's parent folder whose whole path matches it as a regex.

    A path that exists is taken as it is. One with a scheme is listed through Hadoop's file system,
    so any store that Spark reads will do; its scheme and host are no part of the regex.
    """
    remote = _REMOTE.match(path)
    if remote:
        return _expand_remote(path, remote[0], spark or get_session())
    if os.path.exists(path):
        return [path]
    pattern, top = re.compile(path), os.path.dirname(path) or "."
    while top and not os.path.isdir(top) and os.path.dirname(top) != top:
        top = os.path.dirname(top)
    found = sorted(f for at, _, names in os.walk(top or ".") for n in names if pattern.fullmatch(f := os.path.join(at, n)))
    if not found:
        raise FileNotFoundError(f"no file matches {path!r}")
    return found


def _expand_remote(path: str, host: str, spark) -> list[str]:
    make = spark._jvm.org.apache.hadoop.fs.Path
    fs = make(host + "/").getFileSystem(spark._jsc.hadoopConfiguration())
    inner = path[len(host) :]
    if not re.search(r"[][\\^$|?*+(){}]", inner) or fs.exists(make(path)):
        return [path]
    top = os.path.dirname(inner)
    while len(top) > 1 and not fs.exists(make(host + top)):
        top = os.path.dirname(top)
    pattern, files, found = re.compile(inner), fs.listFiles(make(host + top), True), []
    while files.hasNext():
        name = files.next().getPath().toUri().getPath()
        if pattern.fullmatch(name):
            found.append(host + name)
    if not found:
        raise FileNotFoundError(f"no file matches {path!r}")
    return sorted(found)


def scan(path: str, spark=None):
    """A Spark DataFrame over the files; all of them must have the same columns and types."""
    spark = spark or get_session()
    files = expand(path, spark)
    try:
        first = spark.read.parquet(files[0])
        if len(files) == 1:
            return first
        # Footers are read side by side.
        with ThreadPoolExecutor(16) as readers:
            for f, s in zip(files, readers.map(lambda f: spark.read.parquet(f).schema, files), strict=True):
                if [(x.name, x.dataType) for x in s] != [(x.name, x.dataType) for x in first.schema]:
                    raise ValueError(f"{f} has other columns than {files[0]}")
        return spark.read.schema(first.schema).parquet(*files)
    except AnalysisException as e:
        if "PARQUET_TYPE_ILLEGAL" not in str(e):
            raise
    return _scan_nanos(spark, files)


def _scan_nanos(spark, files):
    """Files with nanosecond timestamps: read as integers, kept as microseconds."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    first = files[0]
    if os.path.isdir(first):
        first = next(os.path.join(at, n) for at, _, names in os.walk(first) for n in sorted(names) if n.endswith(".parquet"))
    nanos = {f.name for f in pq.read_schema(first) if pa.types.is_timestamp(f.type) and f.type.unit == "ns"}
    key = "spark.sql.legacy.parquet.nanosAsLong"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        sdf = spark.read.parquet(*files)
        sdf.schema  # the reader takes the setting now
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)
    return sdf.select(*[(F.timestamp_micros(F.call_function("div", F.col(f"`{f.name}`"), F.lit(1000))).cast(T.TimestampNTZType()).alias(f.name) if f.name in nanos else F.col(f"`{f.name}`")) for f in sdf.schema])


def read_parquet(path: str, spark=None):
    """A frame over ``path``: a file, a folder, or a regular expression over files."""
    from sparkframe.operators.frame import DataFrame

    return DataFrame(scan(path, spark))
