"""Join helpers: size-checked broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Used when the session has no broadcast threshold configured (or disabled it).
DEFAULT_BROADCAST_BYTES = 10 * 1024 * 1024


def estimated_size_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of ``df``'s optimised plan, or None.

    For a file scan this is the on-disk (compressed) size of the files read
    after pruning, the same basis Spark's own broadcast threshold uses. For
    derived plans it is Catalyst's estimate, which filters and aggregates
    never increase. It is never a count of the data (no job runs).
    """
    try:
        stats = df._jdf.queryExecution().optimizedPlan().stats()
        return int(str(stats.sizeInBytes()))
    except Exception:
        return None


_UNITS = {"": 1, "b": 1, "k": 1024, "kb": 1024, "m": 1024**2, "mb": 1024**2, "g": 1024**3, "gb": 1024**3}


def parse_bytes(text: str) -> int:
    """Spark byte strings: ``10485760``, ``10485760b``, ``64m``, ``64MB``, ``1g``, ``-1``."""
    t = str(text).strip().lower()
    num = t.rstrip("kmgb")
    return int(float(num) * _UNITS[t[len(num):]])


def broadcast_threshold(df: DataFrame) -> int:
    """The session's ``spark.sql.autoBroadcastJoinThreshold`` in bytes (0 when
    broadcasts are disabled with a negative value)."""
    try:
        v = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", None)
        n = parse_bytes(v) if v is not None else DEFAULT_BROADCAST_BYTES
        return n if n > 0 else 0
    except Exception:
        return DEFAULT_BROADCAST_BYTES


def broadcast_if_small(df: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Hint a broadcast only when the plan's size estimate is within bounds.

    Beyond the bound the side is returned unchanged: the join is planned as a
    shuffle (sort-merge) join, and AQE may still turn it into a broadcast at
    run time from the *measured* size of the materialised side.
    """
    limit = broadcast_threshold(df) if max_bytes is None else max_bytes
    size = estimated_size_bytes(df)
    if size is not None and 0 <= size <= limit:
        return F.broadcast(df)
    return df
