"""Window lists: placement on tiles, caps, merges, work left to do."""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Windows a tile by size.
PER_TILE = {"small": 4, "medium": 4, "large": 1}


MARGIN = 0.5  # least distance of a structure from its tile's left and bottom edge


def grid_size(die: tuple[float, float, float, float], sides: dict[str, tuple[float, float]], most: int = 32) -> int:
    """Tiles a side: as many as hold the windows with a quarter and a tenth to spare, squared down; three at least."""
    x0, y0, x1, y1 = die
    fit = lambda length, k: int(length / ((sides["large"][k] + sides["medium"][k]) * 1.25 * 1.1))
    return min(max(math.isqrt(fit(x1 - x0, 0) * fit(y1 - y0, 1)), 3), most)


def place(spark: SparkSession, design: str, die: tuple[float, float, float, float], sides: dict[str, tuple[float, float]], seed: int = 42, grid: int | None = None) -> DataFrame:
    """Nine touching windows in each tile of a design's square grid, in a seeded order: one large, four medium, four small.

    The grid has :func:`grid_size` tiles a side, a thousand tiles at most. The large window lies at a seeded offset in the tile, a medium one at its
    right, three below; the small ones form a square on top of the first medium one. Tiles that the structure
    does not fit are left out; numbers go on over a design's windows, coordinates have three decimals.
    """
    (lw, lh), (mw, mh), (sw, sh) = (sides[k] for k in ("large", "medium", "small"))
    n = grid or grid_size(die, sides)
    x0, y0, x1, y1 = die
    dx, dy = (x1 - x0) / n, (y1 - y0) / n
    draw, order = random.Random(seed), [(x0 + c * dx, y0 + r * dy, x0 + c * dx + dx, y0 + r * dy + dy) for r in range(n) for c in range(n)]
    draw.shuffle(order)
    at = []
    for x0, y0, x1, y1 in order:
        room = (x1 - x0 - lw - mw, y1 - y0 - lh - mh)
        if min(room) >= 1.0:
            at.append((len(at), *(a + draw.uniform(MARGIN, max(MARGIN, r - MARGIN)) for a, r in zip((x0, y0), room, strict=True))))
    # Place of each window's least corner from the large one's, and its sides.
    spots = [("large", 0.0, 0.0, lw, lh), ("medium", lw, 0.0, mw, mh), ("medium", lw, -mh, mw, mh), ("medium", mw, -mh, mw, mh), ("medium", 0.0, -mh, mw, mh)]
    spots += [("small", lw + i * sw, mh + j * sh, sw, sh) for j in (0, 1) for i in (0, 1)]
    names = ("spot", "size", "dx", "dy", "w", "h")
    spot = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, (k, *s), strict=True)]) for k, s in enumerate(spots)]))
    rows = spark.createDataFrame(at, "tile_order int, x double, y double").select("*", spot.alias("s")).select("*", "s.*")
    x, y = F.col("x") + F.col("dx"), F.col("y") + F.col("dy")
    name = F.concat(F.lit("W"), (F.col("tile_order") * len(spots) + F.col("spot")).cast("string"))
    return rows.select(F.lit(design).alias("design"), name.alias("name"), "tile_order", "spot", "size", F.round(x, 3).alias("x1"), F.round(y, 3).alias("y1"), F.round(x + F.col("w"), 3).alias("x2"), F.round(y + F.col("h"), 3).alias("y2"))


def capped(rows: DataFrame, grid: int) -> DataFrame:
    """At most grid squared times the tile's number of windows per design and size."""
    cap = F.create_map(*[x for k, v in PER_TILE.items() for x in (F.lit(k), F.lit(v * grid * grid))])
    k = F.row_number().over(Window.partitionBy("design", "size").orderBy("tile_order", "spot"))
    return rows.withColumn("_k", k).where(F.col("_k") <= F.element_at(cap, F.col("size"))).drop("_k")


def merged(existing: DataFrame, new: DataFrame, key: str = "name") -> DataFrame:
    """Existing rows first, then new ones whose key does not exist yet; each key once. Both have ``position``."""
    both = existing.withColumn("_s", F.lit(0)).unionByName(new.withColumn("_s", F.lit(1)))
    first = F.row_number().over(Window.partitionBy(key).orderBy("_s", "position"))
    kept = both.withColumn("_f", first).where("_f = 1")
    from .ranks import numbered

    placed = numbered(kept.withColumnRenamed("position", "_p").drop("_f"), ["_s", "_p"], "position")
    return placed.withColumn("position", F.col("position").cast("int")).drop("_s", "_p")


def unsolved(tasks: DataFrame, outputs: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks without output yet."""
    return tasks.join(outputs.select(*keys), keys, "left_anti")


def labelled(windows: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """The first windows, by number, that have a label."""
    from .names import window_number

    return windows.join(labels.select("window_id").distinct(), "window_id", "left_semi").orderBy(window_number(F.col("window_id")), "window_id").limit(most)
