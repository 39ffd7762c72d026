"""Which SparkSession the library works on, and builders for local ones."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame as SparkDataFrame
from pyspark.sql import SparkSession

_current: SparkSession | None = None
_dry = False


def set_session(spark: SparkSession) -> None:
    """Make ``spark`` the session that reads go to. May be called again."""
    global _current, _dry
    _current, _dry = spark, False


def is_dry() -> bool:
    """Whether plans are only shown, as a ``DebugSession`` was set last."""
    return _dry


def get_session() -> SparkSession:
    """The session set last, else Spark's active one, else a new one."""
    if _current is not None:
        return _current
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


class Session:
    """A connection to Spark: an existing session, a master URL, or a Connect address.

    ``odf`` (over-decomposition) sets the shuffle partitions to ``odf`` per core, where the
    number of cores is known.
    """

    def __init__(self, spark: SparkSession | None = None, *, master: str | None = None, remote: str | None = None, odf: int = 4, conf: dict[str, str] | None = None):
        if spark is None:
            builder = SparkSession.builder.config(map=conf or {})
            if remote:
                builder = builder.remote(remote)
            elif master:
                builder = builder.master(master)
            spark = builder.getOrCreate()
            if not remote:
                spark.conf.set("spark.sql.shuffle.partitions", str(max(1, odf * spark.sparkContext.defaultParallelism)))
        self.spark = spark
        set_session(spark)

    def barrier(self, *frames) -> None:
        """Run the plans of ``frames`` to their end without keeping their rows."""
        for frame in frames:
            sdf: SparkDataFrame = getattr(frame, "sdf", frame)
            sdf.write.format("noop").mode("overwrite").save()

    def rescale(self, executors: int) -> bool:
        """Ask the cluster manager for ``executors`` in all; False where it can't (local mode)."""
        if executors < 1:
            raise ValueError("executors must be at least 1")
        sc = self.spark.sparkContext
        if re.fullmatch(r"local(\[.*\])?", sc.master):
            return False
        # Python has no call of its own for this; the Scala one is a developer API.
        nothing_pending = sc._jvm.scala.collection.immutable.Map.empty()
        return bool(sc._jsc.sc().requestTotalExecutors(executors, 0, nothing_pending))

    def disconnect(self) -> None:
        global _current
        if _current is self.spark:
            _current = None
        self.spark.stop()


class LocalCluster(Session):
    """Between ``min_pes`` and ``max_pes`` cores; ``max_pes`` local ones unless another ``master`` is given.

    On a cluster the bounds are those of dynamic allocation, which lets executors go that have been idle
    for ``activity_timeout`` seconds; the cores of one local JVM cost nothing when idle. A session that is
    already running can't be given other cores, so it is refused.
    """

    def __init__(self, min_pes: int = 1, max_pes: int | None = None, odf: int = 4, activity_timeout: int = 60, master: str | None = None):
        top = max_pes or min_pes
        if not 1 <= min_pes <= top:
            raise ValueError("1 <= min_pes <= max_pes must hold")
        master, running = master or f"local[{top}]", SparkSession.getActiveSession()
        if running is not None and running.sparkContext.master != master:
            raise RuntimeError(f"a session on {running.sparkContext.master} is running; disconnect it first")
        super().__init__(
            master=master,
            odf=odf,
            conf={
                "spark.dynamicAllocation.enabled": "true",
                "spark.dynamicAllocation.shuffleTracking.enabled": "true",
                "spark.dynamicAllocation.minExecutors": str(min_pes),
                "spark.dynamicAllocation.maxExecutors": str(top),
                "spark.dynamicAllocation.executorIdleTimeout": f"{activity_timeout}s",
            },
        )


class DebugSession(Session):
    """A dry run: calls build and check their plans, and what would run them shows the plan instead.

    ``get`` gives a frame without rows, ``size`` gives 0.
    """

    def __init__(self, spark: SparkSession | None = None, **options):
        global _dry
        super().__init__(spark, **options)
        _dry = True

    def barrier(self, *frames) -> None:
        for frame in frames:
            getattr(frame, "sdf", frame).explain("formatted")


def set_interface(interface: Session | SparkSession) -> None:
    set_session(getattr(interface, "spark", interface))


def get_interface() -> SparkSession:
    return get_session()
