"""Set operations over keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def only(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def once(*tables: DataFrame) -> DataFrame:
    """Rows that occur exactly once in the tables put together; repeated rows go altogether."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy(*out.columns).agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")


def nets_of(totals: DataFrame, pairs: DataFrame) -> DataFrame:
    """Distinct nets of totals and of coupling ends."""
    ends = pairs.select("window_id", F.explode(F.array("net_lo", "net_hi")).alias("net"))
    return totals.select("window_id", "net").union(ends).distinct()
