"""Sides of joins whose size Spark can't know: what comes from an explode, or from files that compress far below their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A side is broadcast only when its measured size is at most this many bytes.
BROADCAST_BYTES = 32 << 20
#: What a row of a broadcast hash table takes besides its values.
ROW_OVERHEAD = 96


def measured(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (cheap to count) for a join with a side that Spark may take for small: broadcast if it measures ``limit`` at most.

    Beyond it both sides are exchanged and sorted, so that neither goes through the driver.
    """
    return F.broadcast(df) if df.count() * (row_bytes + ROW_OVERHEAD) <= limit else df.hint("merge")
