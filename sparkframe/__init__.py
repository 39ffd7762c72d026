"""sparkframe: a small pandas-like analytics library that lowers to Spark plans.

Every call builds a Catalyst plan; nothing runs before ``get``, ``print``, ``size`` or a
scalar reduction asks for rows.
"""

from sparkframe.operators.frame import DataFrame
from sparkframe.operators.setops import concat
from sparkframe.session import (
    DebugSession,
    LocalCluster,
    Session,
    get_interface,
    get_session,
    set_interface,
    set_session,
)
from sparkframe.sources.parquet import read_parquet

__all__ = [
    "DataFrame",
    "DebugSession",
    "LocalCluster",
    "Session",
    "concat",
    "get_interface",
    "get_session",
    "read_parquet",
    "set_interface",
    "set_session",
]
