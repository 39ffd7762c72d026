"""Shared plumbing: scratch tables in the cluster's shared folder, sizes, and block numbers."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_made: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, which all executors see.

    Where the setting is absent, a local session gets a temporary folder; a cluster is refused, as no
    folder is known that its executors share.
    """
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir")
    if not top:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = _made.get(sc.applicationId) or tempfile.mkdtemp(prefix="sparkframe-")
        _made[sc.applicationId] = top
    folder = f"{top.rstrip('/')}/sparkframe-{sc.applicationId}"
    if folder not in _made:
        _made[folder] = folder
        atexit.register(_remove, spark, folder)
    return folder


def _remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder, if it and the session are still there."""
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session may be gone; its folder then stays
        pass


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Bytes of a batch that goes to a Python worker. Executor and worker each hold batches, beside the heap.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Meanwhile Python workers get batches of ``BATCH_BYTES`` at most, in place of Spark's 64 MB."""
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH)
        else:
            spark.conf.set(_BATCH, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: its lineage ends here."""
    path = new_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove tables that ``written`` made and that no plan reads any more."""
    for t in tables:
        _remove(t.sparkSession, t._scratch)


def total_bytes(df: DataFrame, text: str) -> int:
    """Bytes of all texts, from one aggregate."""
    return int(df.agg(F.sum(F.octet_length(F.col(f"`{text}`")).cast("long"))).first()[0] or 0)


def parts_for(size: int, each: int, least: int = 1) -> int:
    """How many parts of about ``each`` hold ``size``."""
    return max(least, -(-size // each))


def hashed_block(blocks: int, *columns: Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(blocks)).cast("int")


def is_null_last(doc_id: Column) -> Column:
    """A document number for comparisons: null counts as the largest."""
    return F.coalesce(doc_id.cast("long"), F.lit(2**63 - 1))


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
