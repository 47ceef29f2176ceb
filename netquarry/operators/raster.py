"""Rasterization: rectangles to pixels, and what is read off pixel tables.

Pixels are sparse: rows ``(window_id, layer, y, x, cid)`` exist only where something is painted, so that a dense
tensor is built only for a sample that asks for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def active(rects: DataFrame) -> DataFrame:
    """Rectangles of a known layer and conductor that cover at least one pixel."""
    return rects.where((F.col("layer") >= 0) & (F.col("cid") > 0) & (F.col("px0") < F.col("px1")) & (F.col("py0") < F.col("py1")))


def _covered(rows: DataFrame) -> DataFrame:
    """A row a pixel; sequence() counts down where its end lies before its start, so empty ranges must be gone."""
    return rows.withColumn("y", F.explode(F.sequence("py0", F.col("py1") - 1))).withColumn("x", F.explode(F.sequence("px0", F.col("px1") - 1)))


def _ranked(rects: DataFrame, keys: tuple[str, ...], seq: str) -> DataFrame:
    """Rectangles with ``_top``: their paint order within the keys in the high half, their id in the low half.

    The order is ranked before the pixels exist, so that the many pixel rows carry one long and meet in a hash
    aggregate by its maximum. Only rectangles of one layer can meet, so ranks are those within a window's layer. Ids of
    2^31 and more raise.
    """
    order = F.row_number().over(Window.partitionBy(*keys, "layer").orderBy(seq)).cast("long")
    cid = F.greatest(F.col("cid"), F.lit(0)).cast("long")
    cid = F.when(cid >= 1 << 31, F.raise_error(F.lit("conductor id of 2^31 or more")).cast("long")).otherwise(cid)
    return rects.withColumn("_top", F.shiftleft(order, 32).bitwiseOR(cid))


def paint(rects: DataFrame, keys: tuple[str, ...] = ("window_id",), seq: str = "seq") -> DataFrame:
    """Conductor per pixel; of rectangles that overlap the last by ``seq`` wins."""
    kind = dict(rects.dtypes)["cid"]
    rows = _covered(_ranked(active(rects), keys, seq).select(*keys, "layer", "px0", "px1", "py0", "py1", "_top"))
    return rows.groupBy(*keys, "layer", "y", "x").agg(F.max("_top").bitwiseAND(F.lit((1 << 32) - 1)).cast(kind).alias("cid"))


def legacy_density(rects: DataFrame, keys: tuple[str, ...] = ("window_id",), seq: str = "seq") -> DataFrame:
    """Density 1 for every pixel a block covers, with the last named conductor's id or 0 (ground, unnamed)."""
    kind = dict(rects.dtypes)["cid"]
    solid = rects.where((F.col("layer") >= 0) & (F.col("px0") < F.col("px1")) & (F.col("py0") < F.col("py1")))
    rows = _covered(_ranked(solid, keys, seq).select(*keys, "layer", "cid", "px0", "px1", "py0", "py1", "_top"))
    painted = F.max(F.when(F.col("cid") > 0, F.col("_top"))).bitwiseAND(F.lit((1 << 32) - 1)).cast(kind)
    return rows.groupBy(*keys, "layer", "y", "x").agg(F.coalesce(painted, F.lit(0).cast(kind)).alias("cid"), F.lit(1.0).alias("density"))


def dense_ids(rows: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Ids from 1 by sorted name within the keys."""
    return rows.withColumn("cid", F.dense_rank().over(Window.partitionBy(*keys).orderBy(name)))


def centroids(pixels: DataFrame, keys: list[str]) -> DataFrame:
    return pixels.where("cid > 0").groupBy(*keys, "cid").agg(F.avg("layer").alias("c_layer"), F.avg("y").alias("c_y"), F.avg("x").alias("c_x"))


def pixel_counts(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels per conductor with an index from 1 by id; the background has index 0 and counts as one pixel."""
    counted = pixels.where("cid > 0").groupBy(*keys, "cid").agg(F.count("*").alias("n"))
    local = counted.withColumn("local_id", F.row_number().over(Window.partitionBy(*keys).orderBy("cid")))
    empty = pixels.select(*keys).distinct().withColumns({"cid": F.lit(0), "n": F.lit(1).cast("long"), "local_id": F.lit(0)})
    return local.unionByName(empty.withColumn("cid", F.col("cid").cast(dict(pixels.dtypes)["cid"])))


def content_box(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """First and last row and column that hold a conductor on any layer."""
    return pixels.where("cid > 0").groupBy(*keys).agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))


def square_bounds(rects: DataFrame, keys: list[str]) -> DataFrame:
    """Bounds of rectangles, padded to a square of the larger side around their centre."""
    b = rects.groupBy(*keys).agg(F.min("x0").alias("bx0"), F.min("y0").alias("by0"), F.max("x1").alias("bx1"), F.max("y1").alias("by1"))
    half = F.greatest(F.col("bx1") - F.col("bx0"), F.col("by1") - F.col("by0")) / 2
    cx, cy = (F.col("bx0") + F.col("bx1")) / 2, (F.col("by0") + F.col("by1")) / 2
    return b.select(*keys, (cx - half).alias("x0"), (cy - half).alias("y0"), (cx + half).alias("x1"), (cy + half).alias("y1"))


def window_bounds(windows: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Bounds of each window: its own, else those of all its blocks. windows: (keys, x0 …), null where unknown; blocks: (keys, x0 …)."""
    found = blocks.groupBy(*keys).agg(*[f(c).alias(f"b_{c}") for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])
    known = F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull()
    return windows.join(found, keys, "full_outer").select(*keys, *[F.when(known, F.col(c)).otherwise(F.col(f"b_{c}")).alias(c) for c in ("x0", "y0", "x1", "y1")])


def trimmed(pixels: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Content box cut out and resized to ``size`` by nearest neighbour: target i takes source floor(i * n / size)."""
    box = content_box(pixels, keys)
    rows = pixels.join(box.withColumnRenamed("y0", "_y0").withColumnRenamed("y1", "_y1").withColumnRenamed("x0", "_x0").withColumnRenamed("x1", "_x1"), keys)
    # All targets whose source is this pixel: i in [ceil(s * size / n), ceil((s + 1) * size / n)).
    def targets(v: str, lo: str, hi: str) -> Column:
        s, n = F.col(v) - F.col(lo), F.col(hi) - F.col(lo) + 1
        first, last = F.ceil(s * size / n).cast("int"), (F.ceil((s + 1) * size / n) - 1).cast("int")
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    rows = rows.withColumn("_ty", F.explode(targets("y", "_y0", "_y1"))).withColumn("_tx", F.explode(targets("x", "_x0", "_x1")))
    return rows.select(*keys, "layer", F.col("_ty").alias("y"), F.col("_tx").alias("x"), "cid")


def coarse(pixels: DataFrame, keys: list[str], source: int, target: int) -> DataFrame:
    """Mean density of tiles whose edges are ``i * source / target`` cut to whole numbers; empty tiles are left out."""
    edge = lambda i: F.floor(i * F.lit(float(source)) / target)

    def tile(v: str) -> Column:
        guess = F.floor(F.col(v) * F.lit(float(target)) / source)
        return F.when(edge(guess + 1) <= F.col(v), guess + 1).otherwise(guess).cast("int")

    span = lambda t: F.greatest(edge(F.col(t) + 1) - edge(F.col(t)), F.lit(1))
    summed = pixels.withColumn("ty", tile("y")).withColumn("tx", tile("x")).groupBy(*keys, "layer", "ty", "tx").agg(F.sum("density").alias("s"))
    return summed.select(*keys, "layer", "ty", "tx", (F.col("s") / (span("ty") * span("tx"))).alias("density"))


def sample_positions(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Per conductor the whole-number centroid in the first layer that holds it."""
    per = pixels.where("cid > 0").groupBy(*keys, "cid", "layer").agg(F.avg("y").cast("int").alias("y"), F.avg("x").cast("int").alias("x"))
    first = per.groupBy(*keys, "cid").agg(F.min_by(F.struct("layer", "y", "x"), "layer").alias("p"))
    return first.select(*keys, "cid", "p.layer", "p.y", "p.x")


def layer_has_density(pixels: DataFrame, keys: list[str]) -> DataFrame:
    return pixels.groupBy(*keys, "layer").agg(F.bool_or(F.col("cid") > 0).alias("has_density"))


def active_layers(layers: DataFrame) -> DataFrame:
    """Layers that hold density in any window, in order of first sight."""
    seen = layers.where("has_density").groupBy("layer").agg(F.min(F.struct("window_id", "position")).alias("at"))
    return seen.select("layer", F.row_number().over(Window.orderBy("at")).alias("position"))


def signed_occupancy(pixels: DataFrame, keys: list[str], masters: DataFrame) -> DataFrame:
    """Per master and painted pixel: -1 on the master, 1 on other conductors; the rest is 0."""
    return pixels.where("cid > 0").join(masters, keys).withColumn("occupancy", F.when(F.col("cid") == F.col("master"), -1).otherwise(1))


def highlighted(density: Column, cid: Column, positive: Column, negative: Column | None = None) -> Column:
    """Features of a sample: the master's pixels raised by 1, the slave's with turned sign."""
    out = F.when(cid == positive, density + 1)
    return (out if negative is None else out.when(cid == negative, -density)).otherwise(density)


def mask(pixels: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels of the listed conductors, value 1."""
    return pixels.join(ids, [*keys, "cid"], "left_semi").withColumn("mask", F.lit(1.0))


def mismatches(a: DataFrame, b: DataFrame, keys: list[str], share: float = 0.05, area: int | None = None) -> DataFrame:
    """Per layer the pixels that only one side occupies, those both occupy, and whether the count is tolerable."""
    x, y = (d.where("cid > 0").select(*keys, "layer", "y", "x", F.lit(1).alias(n)) for d, n in ((a, "_a"), (b, "_b")))
    both = x.join(y, [*keys, "layer", "y", "x"], "full_outer").groupBy(*keys, "layer")
    one = F.col("_a").isNull() | F.col("_b").isNull()
    out = both.agg(F.count_if(one).alias("mismatched"), F.count_if(~one).alias("agreed"))
    limit = F.floor(F.lit(area) * share) if area else F.floor((F.col("mismatched") + F.col("agreed")) * share)
    return out.withColumn("tolerable", F.col("mismatched") <= limit)


def _top(counted: DataFrame, keys: list[str], ties: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), *ties)
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def top_ids(a: DataFrame, b: DataFrame, keys: list[str], most: int = 6) -> DataFrame:
    """Per layer the conductors of ``a`` with most pixels that ``b`` leaves empty."""
    on = [*keys, "layer", "y", "x"]
    lone = a.where("cid > 0").join(b.where("cid > 0").select(*on), on, "left_anti")
    return _top(lone.groupBy(*keys, "layer", "cid").agg(F.count("*").alias("n")), [*keys, "layer"], ["cid"], most)


def top_name_pairs(a: DataFrame, b: DataFrame, keys: list[str], most: int = 6) -> DataFrame:
    """Per layer the pairs of names (``name``) that most often meet at a pixel and differ."""
    on = [*keys, "layer", "y", "x"]
    met = a.select(*on, F.col("name").alias("name_a")).join(b.select(*on, F.col("name").alias("name_b")), on).where("name_a <> name_b")
    return _top(met.groupBy(*keys, "layer", "name_a", "name_b").agg(F.count("*").alias("n")), [*keys, "layer"], ["name_a", "name_b"], most)


def owned_tiles(pixels: DataFrame, keys: list[str], tile: int, width: int) -> DataFrame:
    """Per conductor and tile the number of pixels and their flat places within the tile, ascending."""
    place = (F.col("y") % tile) * tile + F.col("x") % tile
    return pixels.where("cid > 0").groupBy(*keys, "layer", "cid", F.floor(F.col("y") / tile).alias("ty"), F.floor(F.col("x") / tile).alias("tx")).agg(
        F.count("*").alias("n"), F.sort_array(F.collect_list(place.cast("int"))).alias("places")
    )
