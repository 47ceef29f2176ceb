"""Sample datasets over a shard store: windows, labels and conductors joined lazily.

Nothing is computed until samples are asked for; tensors are built for the selected samples only.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import raster, samples
from .operators.labels import directional_pairs
from .sinks import shards
from .sources import spef

SOLVERS = {"auto": ("rwcap", "raphael"), "rwcap": ("rwcap", "raphael"), "raphael": ("raphael", "rwcap")}


@dataclass(frozen=True)
class WindowSamples:
    """pixels, index (with shard ids), conductors and labelled samples of a set of windows."""

    pixels: DataFrame
    index: DataFrame
    conductors: DataFrame
    samples: DataFrame
    ids_as_density: bool = False
    highlight: float = 1.0

    def subset(self, window_ids: list[str] | DataFrame) -> WindowSamples:
        """The listed windows, in the order given (column ``position`` of the index).

        A long list comes as a table (window_id, position), and stays one.
        """
        order = window_ids
        if isinstance(window_ids, list):
            order = self.index.sparkSession.createDataFrame([(w, i) for i, w in enumerate(dict.fromkeys(window_ids))], "window_id string, position int")
        keep = order.select("window_id")
        semi = lambda d: d.join(keep, "window_id", "left_semi")
        return replace(self, pixels=semi(self.pixels), index=self.index.drop("position").join(order, "window_id"), conductors=semi(self.conductors), samples=semi(self.samples))

    def split(self, train: float = 0.7, val: float = 0.15, seed: int = 42) -> dict[str, WindowSamples]:
        """Whole windows to train, val and test."""
        parts = samples.split_windows(self.index, train, val, seed)
        return {k: self.subset(parts.where(F.col("split") == k).select("window_id", "position")) for k in ("train", "val", "test")}

    def features(self, wanted: DataFrame) -> DataFrame:
        """Sparse features of samples (window_id, pos_id, neg_id): the painted pixels with the sample's highlight."""
        base = F.col("cid").cast("boolean").cast("double") if self.ids_as_density else F.col("density")
        # Never the pixels go through the driver: their files are small beside their rows.
        rows = wanted.join(self.pixels.hint("merge"), "window_id")
        lit = raster.highlighted(base, F.col("cid"), F.col("pos_id"), F.when(F.col("neg_id") > 0, F.col("neg_id")))
        raised = F.when((F.col("cid") == F.col("pos_id")), base + self.highlight).otherwise(lit)
        return rows.select("window_id", "pos_id", "neg_id", "layer", "y", "x", raised.alias("feature"))

    def tensors(self, wanted: DataFrame, layers: int, height: int, width: int) -> DataFrame:
        return samples.dense_features(self.features(wanted), layers, height, width, ["window_id", "pos_id", "neg_id"])

    def ranges(self) -> DataFrame:
        return samples.offsets(self.samples)

    def cases(self) -> DataFrame:
        return samples.grouped_cases(self.conductors, self.samples)

    def batches(self, size: int, seed: int, epoch: int = 0, drop_last: bool = False) -> DataFrame:
        numbered = self.samples.withColumn("sample", F.struct("pos_id", "neg_id"))
        return samples.shuffled_batches(numbered, self.index.select("window_id", "shard_id"), size, seed, epoch, drop_last)


def load(spark: SparkSession, store: str, label_files: DataFrame, goal: str, solver: str = "auto", ids_as_density: bool = False, highlight: float = 1.0) -> WindowSamples:
    """Samples of a store for a goal: ``self`` or ``coupling``.

    label_files: (window_id, solver, path, text). Windows without labels, or whose labels can't be read, go.
    """
    pixels, index = shards.read(spark, store)
    chosen = samples.label_files(index.select("window_id"), label_files.select("window_id", "solver", "path"), SOLVERS[solver])
    files = chosen.join(label_files.select("window_id", "path", "text"), ["window_id", "path"])
    rows = spef.read_spef(files).where("error is null")
    # A window's map is one value, which tells Spark nothing of the rows in it.
    conductors = index.select("window_id", F.explode("conductor_id_map").alias("net", "cid")).hint("merge")
    if goal == "self":
        found = samples.self_samples(spef.nets(rows).withColumnRenamed("total_f", "value_f").withColumn("seq", -F.col("seq")), conductors)
    elif goal == "coupling":
        at = raster.centroids(pixels, ["window_id"])
        found = samples.coupling_samples(directional_pairs(spef.resolved_caps(rows)).withColumn("seq", F.lit(0)), conductors, at)
    else:
        raise ValueError(goal)
    labelled = found.select("window_id").distinct()
    return WindowSamples(pixels, index.join(labelled, "window_id", "left_semi"), conductors.join(labelled, "window_id", "left_semi"), found, ids_as_density, highlight)
