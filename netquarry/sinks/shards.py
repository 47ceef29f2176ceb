"""Density shards: windows packed into shards in arrival or seeded order, with an index.

The store is Parquet: ``pixels`` partitioned by shard, sorted by window, and ``index`` with a row a window. Windows are
added in batches. A batch's pixels are written first, its index rows last, by Spark's committers; readers see the pixels
of indexed batches only, so that a batch that failed half-way leaves nothing behind that counts, and can be tried again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import ensure_checkpoints
from ..operators.joins import measured
from ..operators.ranks import numbered
from ..operators.samples import permutation, shards

VERSION = 2


def problems(windows: DataFrame) -> DataFrame:
    """Windows that break the rules: repeated ids, layers unlike the others', flags or names not one a layer.

    windows: (window_id, layer_names, layer_has_density, height, width).
    """
    common = windows.groupBy(F.struct("layer_names", "height", "width").alias("shape")).agg(F.count("*").alias("n")).agg(F.max_by("shape", F.struct("n", "shape")).alias("shape"))
    repeated = windows.groupBy("window_id").agg(F.count("*").alias("n")).where("n > 1").select("window_id", F.lit("repeated id").alias("problem"))
    joined = windows.join(F.broadcast(common))  # one row
    unlike = joined.where(F.struct("layer_names", "height", "width") != F.col("shape")).select("window_id", F.lit("other shape or layers").alias("problem"))
    flags = windows.where(F.size("layer_names") != F.size("layer_has_density")).select("window_id", F.lit("a flag a layer").alias("problem"))
    return repeated.unionAll(unlike).unionAll(flags)


def _cut(windows: DataFrame) -> DataFrame:
    """Windows computed once: they are looked at for problems, numbered and written."""
    ensure_checkpoints(windows.sparkSession)
    return windows.checkpoint()


def _put(pixels: DataFrame, windows: DataFrame, path: str, order: DataFrame, per_shard: int, start: int, mode: str) -> DataFrame:
    """Writes a batch whose windows come at ``start`` and after in the store's order; returns the whole index."""
    spark: SparkSession = pixels.sparkSession
    batch = F.lit(uuid.uuid4().hex)
    placed = shards(order.withColumn("position", F.col("position") + start), per_shard)
    index = windows.join(placed.drop("position").hint("merge"), "window_id").withColumns({"format_version": F.lit(VERSION), "batch": batch})
    good = F.when(F.col("cid") < 0, F.raise_error(F.lit("negative conductor id")).cast("long")).otherwise(F.col("cid"))
    rows = pixels.withColumns({"cid": good, "batch": batch}).join(measured(placed.select("window_id", "shard_id"), 64), "window_id")
    rows.repartitionByRange("shard_id", "window_id").sortWithinPartitions("shard_id", "window_id", "layer", "y", "x").write.mode(mode).partitionBy("shard_id").parquet(f"{path}/pixels")
    index.write.mode(mode).parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")


def write(pixels: DataFrame, windows: DataFrame, path: str, per_shard: int = 64, seed: int | None = None, arrival: str | None = None) -> DataFrame:
    """Writes a new store; returns the index (windows with shard_id and shard_offset).

    The order is arrival (a column of ``windows``), or sorted ids, permuted if a seed is given. Negative ids raise.
    """
    windows = _cut(windows)
    if problems(windows).limit(1).count():
        raise ValueError("windows don't fit one store")
    if seed is None or arrival:
        order = numbered(windows, [arrival or "window_id"], "position").select("window_id", "position")
    else:
        order = permutation(windows, seed, "numpy")
    return _put(pixels, windows, path, order, per_shard, 0, "overwrite")


def append(pixels: DataFrame, windows: DataFrame, path: str, per_shard: int = 64, arrival: str = "window_id") -> DataFrame:
    """Adds windows behind those of a store (or begins one), filling its last shard first; returns the index.

    Windows that the store has already, or that don't fit its layers and shape, raise before anything is written.
    """
    spark: SparkSession = pixels.sparkSession
    there, windows = _index(spark, path), _cut(windows)
    columns = ["window_id", "layer_names", "layer_has_density", "height", "width"]
    both = windows.select(*columns) if there is None else windows.select(*columns).unionByName(there.select(*columns))
    if problems(both).limit(1).count():
        raise ValueError("windows don't fit the store")
    start = 0 if there is None else there.count()
    order = numbered(windows, [arrival], "position").select("window_id", "position")
    return _put(pixels, windows, path, order, per_shard, start, "append")


def _index(spark: SparkSession, path: str) -> DataFrame | None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/index")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.parquet(f"{path}/index")


def is_store(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds a store of this format."""
    index = _index(spark, path)
    return index is not None and {"window_id", "shard_id", "format_version"} <= set(index.columns)


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pixels, index); another format version raises."""
    index = spark.read.parquet(f"{path}/index")
    if index.where(F.col("format_version") != VERSION).limit(1).count():
        raise ValueError("format version")
    # Pixels compress so well that Spark takes their files for a small table.
    listed = measured(index.select("window_id", "batch"), 96)
    pixels = spark.read.parquet(f"{path}/pixels").join(listed, ["window_id", "batch"], "left_semi")
    return pixels.drop("batch"), index


def window_pixels(spark: SparkSession, path: str, window_id: str) -> DataFrame:
    """Pixels of one window; only its shard's partition is read."""
    pixels, index = read(spark, path)
    shard = index.where(F.col("window_id") == window_id).select("shard_id").first()
    if shard is None:
        raise KeyError(window_id)
    return pixels.where((F.col("shard_id") == shard["shard_id"]) & (F.col("window_id") == window_id))
