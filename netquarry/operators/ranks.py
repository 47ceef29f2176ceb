"""Positions and running sums over all rows, without a task that sees them all.

Rows are range-partitioned by the order; each partition's totals are small, their running sum gives its offset, and
positions within a partition are counted there. Ties need no order of their own if the order ends in a unique column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(rows: DataFrame, order: list[Column | str], value: Column | str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` (whole numbers, nulls as 0) over all rows before each (exclusive)."""
    from ..lineage import ensure_checkpoints

    ensure_checkpoints(rows.sparkSession)
    value = F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(0)).cast("long")
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Cut here, so that the offsets and the rows see the same partitions.
    placed = rows.withColumn("_value", value).repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    # A row a partition, however many rows there are.
    total, offsets = 0, []
    for r in sorted(placed.groupBy("_part").agg(F.sum("_value").alias("_total")).collect()):
        offsets.append((r["_part"], total))
        total += r["_total"]
    offset = F.broadcast(rows.sparkSession.createDataFrame(offsets, "_part int, _offset long"))
    before = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn("_sum", F.coalesce(F.sum("_value").over(before), F.lit(0))).join(offset, "_part")
    return out.withColumn(name, F.col("_sum") + F.col("_offset")).drop("_part", "_value", "_sum", "_offset")


def numbered(rows: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """``rows`` with their position in the order, from 0."""
    return running(rows, order, F.lit(1), name)


def shuffled(rows: DataFrame, keys: list[str], seed: int, name: str) -> DataFrame:
    """``rows`` with their place in a seeded permutation: the rank of a hash of the keys, ties by the keys."""
    return numbered(rows, [F.xxhash64(F.lit(seed), *keys), *[F.col(k) for k in keys]], name)


def carried(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with the last ``value`` that isn't null at or before each row, in ascending order of columns, among rows of equal keys."""
    from ..lineage import ensure_checkpoints

    ensure_checkpoints(rows.sparkSession)
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by = [*[F.col(k) for k in keys], *[F.col(c).asc_nulls_last() for c in order]]
    placed = rows.withColumn("_value", value).repartitionByRange(parts, *by).withColumn("_part", F.spark_partition_id()).checkpoint()
    # A row a partition and key: what the key's later partitions begin with.
    ends = placed.groupBy("_part", *keys).agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begin = ends.select("_part", *keys, F.last("_end", ignorenulls=True).over(before).alias("_begin"))
    within = Window.partitionBy("_part", *keys).orderBy(*by[len(keys) :]).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumn("_last", F.last("_value", ignorenulls=True).over(within)).join(begin, ["_part", *keys], "left")
    return out.withColumn(name, F.coalesce("_last", "_begin")).drop("_value", "_part", "_last", "_begin")
