"""Training samples: labels joined to conductors, grouped cases, leakage-free splits, batches."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FEMTO = 1e15


def label_files(windows: DataFrame, files: DataFrame, priority: tuple[str, ...] = ("rwcap", "raphael")) -> DataFrame:
    """The label file of each window: the first solver by priority, plain before compressed; windows without go.

    files: (window_id, solver, path).
    """
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("solver"))
    ranked = files.where(rank > 0).withColumn("_k", F.struct(rank, F.col("path").endswith(".gz").cast("int"), F.col("path")))
    best = ranked.groupBy("window_id").agg(F.min_by(F.struct("solver", "path"), "_k").alias("f"))
    return windows.join(best, "window_id").select(*windows.columns, "f.solver", "f.path")


def self_samples(selfs: DataFrame, conductors: DataFrame) -> DataFrame:
    """Per window and conductor the first label by ``seq``, in fF. conductors: (window_id, net, cid)."""
    joined = selfs.join(conductors, ["window_id", "net"])
    first = joined.groupBy("window_id", "cid").agg(F.min_by("value_f", "seq").alias("v"))
    return first.select("window_id", F.col("cid").alias("pos_id"), F.lit(0).alias("neg_id"), (F.col("v") * FEMTO).alias("target"))


def coupling_samples(pairs: DataFrame, conductors: DataFrame, centroids: DataFrame | None = None, last: bool = False) -> DataFrame:
    """Per window and unordered pair of conductors one label (first by ``seq``, or last), in fF.

    The positive end is the one whose centroid is nearer to the origin; without centroids, and for ties, the first
    of the sorted names. centroids: (window_id, cid, c_layer, c_y, c_x).
    """
    lo = conductors.select("window_id", F.col("net").alias("net_lo"), F.col("cid").alias("id_lo"))
    hi = conductors.select("window_id", F.col("net").alias("net_hi"), F.col("cid").alias("id_hi"))
    rows = pairs.where(F.col("value_f") > 1e-20).join(lo, ["window_id", "net_lo"]).join(hi, ["window_id", "net_hi"]).where("id_lo <> id_hi")
    near = F.lit(True)
    if centroids is not None:
        square = F.col("c_layer") ** 2 + F.col("c_y") ** 2 + F.col("c_x") ** 2
        for end in ("lo", "hi"):
            rows = rows.join(centroids.select("window_id", F.col("cid").alias(f"id_{end}"), square.alias(f"d_{end}")), ["window_id", f"id_{end}"], "left")
        far = F.lit(float("inf"))
        near = F.coalesce("d_lo", far) <= F.coalesce("d_hi", far)
    pos, neg = F.when(near, F.col("id_lo")).otherwise(F.col("id_hi")), F.when(near, F.col("id_hi")).otherwise(F.col("id_lo"))
    pick = F.max_by if last else F.min_by
    chosen = rows.groupBy("window_id", F.least("id_lo", "id_hi").alias("a"), F.greatest("id_lo", "id_hi").alias("b")).agg(pick(F.struct(pos.alias("p"), neg.alias("n"), F.col("value_f").alias("v")), "seq").alias("s"))
    return chosen.select("window_id", F.col("s.p").alias("pos_id"), F.col("s.n").alias("neg_id"), (F.col("s.v") * FEMTO).alias("target"))


def grouped_cases(conductors: DataFrame, samples: DataFrame) -> DataFrame:
    """Per window and master all other conductors with target and validity, by slave id.

    All ordered pairs of one window are wanted here, valid or not; conductors of a window are few by construction
    of windows. Pairs labelled more than once count with their mean.
    """
    ids = conductors.select("window_id", "cid").distinct()
    pairs = ids.withColumnRenamed("cid", "master").join(ids.withColumnRenamed("cid", "slave"), "window_id").where("master <> slave")
    target = samples.groupBy("window_id", F.least("pos_id", "neg_id").alias("a"), F.greatest("pos_id", "neg_id").alias("b")).agg(F.avg("target").alias("target"))
    keyed = pairs.withColumns({"a": F.least("master", "slave"), "b": F.greatest("master", "slave")}).join(target, ["window_id", "a", "b"], "left")
    entry = F.struct("slave", F.coalesce("target", F.lit(0.0)).alias("target"), F.col("target").isNotNull().alias("valid"))
    return keyed.groupBy("window_id", "master").agg(F.array_sort(F.collect_list(entry)).alias("slaves"))


def offsets(samples: DataFrame) -> DataFrame:
    """Per window the samples and the range [start, end) of their global indices, windows in order."""
    from .ranks import running

    n = samples.groupBy("window_id").agg(F.count("*").alias("n"))
    return running(n, ["window_id"], "n", "start").select("window_id", "n", "start", (F.col("start") + F.col("n")).alias("end"))


def locate(indices: DataFrame, ranges: DataFrame, width: int = 1024) -> DataFrame:
    """Window and place within it of global indices, joined on blocks of ``width`` indices."""
    blocks = ranges.where("n > 0").withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    found = indices.withColumn("_b", F.floor(F.col("index") / width)).join(blocks, "_b").where((F.col("index") >= F.col("start")) & (F.col("index") < F.col("end")))
    return found.select("index", "window_id", (F.col("index") - F.col("start")).alias("place"))


def permutation(windows: DataFrame, seed: int | None, kind: str = "random", key: str = "window_id") -> DataFrame:
    """(key, position): distinct ids in order, or in the order of a seeded shuffle (``random``) or permutation (``numpy``).

    A shuffle moves places whatever lies there, so each task draws the same one for the number of windows and looks up
    its own rows' places: 8 bytes a window and task with ``numpy``, some 40 with ``random``.
    """
    from .ranks import numbered

    ranked = numbered(windows.select(key).distinct(), [key], "position")
    if seed is None:
        return ranked
    n = ranked.count()

    @F.pandas_udf("long")
    def place(ranks: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if kind == "numpy":
            order = np.random.default_rng(seed).permutation(n)
        else:
            shuffled = list(range(n))
            random.Random(seed).shuffle(shuffled)
            order = np.array(shuffled, dtype=np.int64)
        at = np.empty(n, dtype=np.int64)
        at[order] = np.arange(n)
        for r in ranks:
            yield pd.Series(at[r.to_numpy()])

    return ranked.select(key, place("position").alias("position"))


def split_windows(windows: DataFrame, train: float = 0.7, val: float = 0.15, seed: int = 42, key: str = "window_id") -> DataFrame:
    """(key, split, position): whole windows, counts cut to whole numbers, the rest to test."""
    order = permutation(windows, seed, key=key)
    n = order.count()
    a, b = int(n * train), int(n * train) + int(n * val)
    p = F.col("position")
    return order.select(key, F.when(p < a, "train").when(p < b, "val").otherwise("test").alias("split"), "position")


def leaks(splits: DataFrame) -> DataFrame:
    """Windows that more than one split holds."""
    return splits.groupBy("window_id").agg(F.count_distinct("split").alias("n")).where("n > 1")


def shards(order: DataFrame, per_shard: int = 64) -> DataFrame:
    """Shard id and place within it by position."""
    return order.withColumn("shard_id", F.floor(F.col("position") / per_shard).cast("int")).withColumn("shard_offset", (F.col("position") % per_shard).cast("int"))


def batches(samples: DataFrame, size: int, drop_last: bool = False, order: list[Column] | None = None) -> DataFrame:
    """Batches within windows: ``batch`` numbers a window's groups of ``size`` samples; none spans two windows."""
    within = Window.partitionBy("window_id").orderBy(*(order or [F.col("sample")]))
    rows = samples.withColumn("_k", F.row_number().over(within) - 1).withColumn("batch", F.floor(F.col("_k") / size))
    if drop_last:
        rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy("window_id"))).where((F.col("batch") + 1) * size <= F.col("_n")).drop("_n")
    return rows.withColumn("in_batch", F.col("_k") % size).drop("_k")


def shuffled_batches(samples: DataFrame, placed: DataFrame, size: int, seed: int, epoch: int = 0, drop_last: bool = False) -> DataFrame:
    """Batches of an epoch: shards in seeded order, windows in seeded order within, samples in seeded order within.

    placed: (window_id, shard_id). Orders are hashes of seed plus epoch, so reruns agree whatever the partitioning.
    """
    mixed = lambda *c: F.xxhash64(F.lit(seed + epoch), *[F.col(x) for x in c])
    rows = batches(samples.join(placed, "window_id"), size, drop_last, [mixed("window_id", "sample"), F.col("sample")])
    return rows.withColumns({"shard_order": mixed("shard_id"), "window_order": mixed("shard_id", "window_id")})


def sample_label(window: Column, pos: Column, neg: Column) -> Column:
    """``W:pos`` or ``W:pos|neg``."""
    return F.when(neg == 0, F.concat_ws(":", window, pos.cast("string"))).otherwise(F.concat(window, F.lit(":"), pos.cast("string"), F.lit("|"), neg.cast("string")))


def stratified_split(rows: DataFrame, stratum: str, order: list[Column], share: float = 0.8) -> DataFrame:
    """Exactly ``int(share * n)`` rows of each stratum, first by order, are train; the rest test."""
    w = Window.partitionBy(stratum)
    k, n = F.row_number().over(w.orderBy(*order)), F.count("*").over(w)
    return rows.withColumn("split", F.when(k <= F.floor(n * share), "train").otherwise("test"))


def flux(net: Column, pos: Column, neg: Column | None = None) -> Column:
    """+1 on the positive conductor's points, -1 on the negative's, else 0."""
    out = F.when(net == pos, 1.0)
    return (out if neg is None else out.when(net == neg, -1.0)).otherwise(0.0)


def dense_features(pixels: DataFrame, layers: int, height: int, width: int, keys: list[str], value: str = "feature") -> DataFrame:
    """Per sample one flat array of ``layers * height * width`` features from sparse pixels."""
    at = (F.col("layer") * height + F.col("y")) * width + F.col("x")
    cells = pixels.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(at.cast("int").alias("k"), F.col(value).cast("float").alias("v")))).alias("m"))
    return cells.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(layers * height * width - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0).cast("float"))).alias("features"))
