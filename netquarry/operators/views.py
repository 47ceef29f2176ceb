"""What viewers and file layouts need: heights, colours, groups, paths, grouped neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


NEAR = 0.2  # distance at which a conductor is near a height
COLOURS = 12  # of the palette


def near_height(blocks: DataFrame, z: float, tolerance: float = 1e-6, proximity: float = NEAR) -> DataFrame:
    """Per window whether a conductor block's extent (z0, z1) reaches a height, or comes within ``proximity`` of it."""
    reach = max(tolerance, proximity)
    return blocks.groupBy("window_id").agg(F.bool_or((F.col("z0") - reach <= z) & (F.col("z1") + reach >= z)).alias("near"))


def uppermost(blocks: DataFrame) -> DataFrame:
    """Per window the top of its highest conductor, 0 if none is above."""
    return blocks.groupBy("window_id").agg(F.greatest(F.max("z1"), F.lit(0.0)).alias("z"))


def colour(layer: Column, colours: int = COLOURS) -> Column:
    """A layer's place in a palette; layers beyond it begin again. A block without a numbered layer is an error."""
    number = layer.cast("string").try_cast("int")
    return F.when(number.isNull(), F.raise_error(F.lit("a block has no numbered layer")).cast("int")).otherwise(F.pmod(number, F.lit(colours)))


def medium_style(er: Column) -> Column:
    """Red, green, blue and opacity of a medium, in three steps of its constant."""
    style = lambda *v: F.array(*map(F.lit, v))
    return F.when(er <= 2.0, style(0.2, 0.4, 0.8, 0.15)).when(er <= 4.0, style(0.2, 0.7, 0.3, 0.25)).otherwise(style(0.9, 0.4, 0.2, 0.35))


def layer_group(layer: Column, z_top: Column) -> Column:
    """Group of a block: ``L:`` and its layer, else ``Z:`` and its top to a tenth."""
    by_height = F.concat(F.lit("Z:"), F.coalesce((F.rint(z_top * 10) / 10).cast("string"), F.lit("unknown")))
    return F.coalesce(F.concat(F.lit("L:"), layer.cast("string")), by_height)


def node_of_path(path: Column, nodes: tuple[str, ...]) -> Column:
    """The process node that a path names in one of its folders; null without one."""
    return F.get(F.filter(F.split(F.lower(path), "/"), lambda p: p.isin(*[n.lower() for n in nodes])), F.lit(0))


def relative(path: Column, root: Column) -> Column:
    """A path below a root; other paths as they are."""
    base = F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"))
    return F.when(F.startswith(path, base), F.substr(path, F.length(base) + 1)).otherwise(path)


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^/.]+)*$", 1)


def paired(a: DataFrame, b: DataFrame, most: int | None = None) -> DataFrame:
    """Files of two folders with one stem, by number and name. a, b: (path)."""
    from .names import window_number

    side = lambda d, n: d.select(stem(F.col("path")).alias("stem"), F.col("path").alias(n))
    both = side(a, "path_a").join(side(b, "path_b"), "stem").orderBy(window_number(F.col("stem")), "stem")
    return both if most is None else both.limit(most)


def matches_filter(value: Column, allowed: str | None) -> Column:
    """Whether a value is in a comma-separated list; no list allows all."""
    wanted = [x.strip().lower() for x in (allowed or "").split(",") if x.strip()]
    return F.lower(value).isin(*wanted) if wanted else F.lit(True)


def grouped_neighbours(centres: DataFrame, points: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Per centre its k nearest points relative to it, as one array in order of distance.

    centres: (keys, q_idx, q_x …); points: (keys, p_idx, p_x …).
    """
    from .points import nearest

    near = nearest(centres, points, keys, k).join(centres, [*keys, "q_idx"]).join(points, [*keys, "p_idx"])
    local = F.struct("rank", "p_idx", *[(F.col(f"p_{c}") - F.col(f"q_{c}")).alias(c) for c in "xyz"])
    return near.groupBy(*keys, "q_idx").agg(F.array_sort(F.collect_list(local)).alias("group"))


def layered_points(points: DataFrame, layers: DataFrame) -> DataFrame:
    """Points with the id of the layer whose extent holds their height, the lowest of several; -1 without one.

    layers: (layer_id, z0, z1), a technology's few.
    """
    stack = layers.agg(F.array_sort(F.collect_list(F.struct("z0", "z1", "layer_id"))).alias("_l"))
    hit = F.filter("_l", lambda x: (x["z0"] <= F.col("z")) & (F.col("z") <= x["z1"]))
    return points.join(F.broadcast(stack)).withColumn("layer_id", F.coalesce(F.get(hit, F.lit(0))["layer_id"], F.lit(-1))).drop("_l")
