"""Technology stacks: running heights, layer lists, z extents, dielectrics, matching by height.

Stacks are ``(tech, pos, name, type, thickness, er, wmin)``; vias are ``(tech, via, from_metal, to_metal, wmin)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_order():
    return Window.partitionBy("tech").orderBy("pos")


def with_heights(stack: DataFrame) -> DataFrame:
    """``z0`` and ``z1``: running sums of the thickness below and including each entry."""
    z1 = F.sum("thickness").over(in_order().rowsBetween(Window.unboundedPreceding, 0))
    return stack.withColumn("z1", z1).withColumn("z0", F.col("z1") - F.col("thickness"))


def metals(stack: DataFrame) -> DataFrame:
    """Metal layers in order, with a position from 1."""
    return with_heights(stack).where(F.lower("type") == "metal").withColumn("level", F.row_number().over(in_order()))


def conductor_layers(stack: DataFrame, vias: DataFrame) -> DataFrame:
    """Metals in order with the via between a metal and the next interleaved.

    A metal's z is its top; a via's is the mean of the tops that it joins.
    """
    m = metals(stack).select("tech", "name", "z1", "level", F.lead("name").over(in_order()).alias("next"), F.lead("z1").over(in_order()).alias("next_z"))
    v = vias.select("tech", F.col("via"), F.col("from_metal").alias("name"), F.col("to_metal").alias("next"))
    between = m.join(v, ["tech", "name", "next"]).select("tech", F.col("via").alias("layer"), ((F.col("z1") + F.col("next_z")) / 2).alias("z"), (2 * F.col("level")).alias("slot"), F.lit("via").alias("kind"))
    own = m.select("tech", F.col("name").alias("layer"), F.col("z1").alias("z"), (2 * F.col("level") - 1).alias("slot"), F.lit("metal").alias("kind"))
    both = own.unionByName(between)
    return both.withColumn("position", F.row_number().over(Window.partitionBy("tech").orderBy("slot", "layer"))).drop("slot")


def limited(layers: DataFrame, most: int) -> DataFrame:
    return layers.where(F.col("position") <= most)


def channel_count(layers: DataFrame) -> DataFrame:
    return layers.groupBy("tech").agg(F.count("*").alias("channels"))


def min_widths(stack: DataFrame, vias: DataFrame) -> DataFrame:
    """Smallest widths of metals and vias that state one."""
    return stack.where(F.lower("type") == "metal").select("tech", F.col("name").alias("layer"), "wmin").unionByName(vias.select("tech", F.col("via").alias("layer"), "wmin")).where("wmin is not null")


def z_extents(stack: DataFrame, vias: DataFrame) -> DataFrame:
    """Extents of metals and of vias, which run from the lower metal's top to the upper's bottom; inverted ones raise."""
    h = with_heights(stack).where(F.lower("type") == "metal")
    low = h.select("tech", F.col("name").alias("from_metal"), F.col("z1").alias("zb"))
    high = h.select("tech", F.col("name").alias("to_metal"), F.col("z0").alias("zt"))
    v = vias.join(low, ["tech", "from_metal"]).join(high, ["tech", "to_metal"])
    top = F.when(F.col("zb") > F.col("zt"), F.raise_error(F.concat(F.lit("inverted via "), F.col("via"))).cast("double")).otherwise(F.col("zt"))
    return h.select("tech", F.col("name").alias("layer"), "z0", "z1").unionByName(v.select("tech", F.col("via").alias("layer"), F.col("zb").alias("z0"), top.alias("z1")))


def selected(layers: DataFrame, bottom: Column, top: Column) -> DataFrame:
    """Layers from the one named ``bottom`` to the one named ``top``; missing or inverted names raise."""
    whole = Window.partitionBy("tech")
    b, t = (F.max(F.when(F.col("layer") == n, F.col("position"))).over(whole) for n in (bottom, top))
    bad = b.isNull() | t.isNull() | (b > t)
    keep = F.when(bad, F.raise_error(F.concat(F.lit("layer range of "), F.col("tech"))).cast("boolean")).otherwise(F.col("position").between(b, t))
    return layers.withColumn("_keep", keep).where("_keep").drop("_keep")


FEW = 1024  # media of a tech that stand in one array


def dielectric_at(points: DataFrame, media: DataFrame, tolerance: float = 1e-9, few: int = FEW) -> DataFrame:
    """``er`` at each point's z. At an interface the mean of both media, else the lowest medium that reaches z, else
    the topmost; 1.0 without media. media: (tech, er, z_top).

    Where no tech has more than ``few`` media, they become one sorted array a tech, so that points meet them without a range join and
    find theirs by bisection. A longer array would be copied for every point: there points and media are sorted together.
    """
    if media.groupBy("tech").count().where(F.col("count") > few).limit(1).count():
        return _sorted_dielectric(points, media, tolerance)
    stack = media.groupBy("tech").agg(F.array_sort(F.collect_list(F.struct("z_top", "er"))).alias("m"))
    n, z = F.size("m"), F.col("z")

    def halved(s: Column, _: Column) -> Column:
        """One step of the search for the first medium whose top isn't below z."""
        middle = F.shiftright(s["lo"] + s["hi"], 1)
        low = (s["lo"] < s["hi"]) & (F.get("m", middle)["z_top"] < z - tolerance)
        high = (s["lo"] < s["hi"]) & ~(F.get("m", middle)["z_top"] < z - tolerance)
        return F.struct(F.when(low, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(high, middle).otherwise(s["hi"]).alias("hi"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(n + 1)).cast("int"))
    found = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), n.alias("hi")), halved)["lo"]
    rows = points.join(stack, "tech", "left").withColumn("_k", F.when(F.col("m").isNotNull(), found))
    k, er = F.col("_k"), lambda i: F.get("m", i)["er"]
    at = F.abs(F.get("m", k)["z_top"] - z) <= tolerance
    value = F.when(F.col("m").isNull(), 1.0).when(at & (k < n - 1), (er(k) + er(k + 1)) / 2).when(k < n, er(k)).otherwise(er(n - 1))
    return rows.withColumn("er", value).drop("m", "_k")


def _sorted_dielectric(points: DataFrame, media: DataFrame, tolerance: float) -> DataFrame:
    """From the top down, the last medium before a point is the lowest that reaches it."""
    from .ranks import carried

    up = Window.partitionBy("tech").orderBy("z_top", "er")
    known = media.where("tech is not null")
    found = F.struct("z_top", "er", F.lead("er").over(up).alias("above"), F.lead(F.lit(True)).over(up).alias("more"))
    depth = lambda z: (F.lit(0.0) - z).alias("_depth")
    tops = known.select("tech", depth(F.col("z_top")), F.lit(0).alias("_kind"), (-F.row_number().over(up)).alias("_least"), found.alias("_medium"))
    held = points.select("tech", depth(F.nanvl(F.col("z"), F.lit(float("inf"))) - F.lit(tolerance)), F.lit(1).alias("_kind"), F.struct(*points.columns).alias("_point"))
    rows = carried(tops.unionByName(held, allowMissingColumns=True), ["tech"], ["_depth", "_kind", "_least"], F.col("_medium"), "_m").where("_kind = 1")
    last = known.groupBy("tech").agg(F.max_by("er", F.struct("z_top", "er")).alias("_top"), F.lit(True).alias("_known"))
    rows = rows.select("tech", "_point", "_m").join(last, "tech", "left")
    m = F.col("_m")
    at = F.abs(m["z_top"] - F.col("_point.z")) <= tolerance
    value = F.when(F.col("_known").isNull(), 1.0).when(m.isNull(), F.col("_top")).when(at & m["more"], (m["er"] + m["above"]) / 2).otherwise(m["er"])
    return rows.select("_point.*", value.alias("_er")).withColumn("er", F.col("_er")).drop("_er")


def matched_by_height(a: DataFrame, b: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Layers of two lists paired by rank of (z, name) per tech; nothing where the counts differ.

    ``close`` tells whether the heights agree, ``same_name`` whether the names do.
    """
    rank = lambda d, n: d.select("tech", F.col("layer").alias(f"layer_{n}"), F.col("z").alias(f"z_{n}"), F.row_number().over(Window.partitionBy("tech").orderBy("z", "layer")).alias("rank"), F.count("*").over(Window.partitionBy("tech")).alias(f"n_{n}"))
    both = rank(a, "a").join(rank(b, "b"), ["tech", "rank"]).where("n_a = n_b")
    return both.select("tech", "rank", "layer_a", "layer_b", (F.abs(F.col("z_a") - F.col("z_b")) <= tolerance).alias("close"), (F.lower("layer_a") == F.lower("layer_b")).alias("same_name"))


def reversed_heights(stack: DataFrame) -> DataFrame:
    """Intervals of a stack listed from the top: z sums run from the last entry up."""
    up = Window.partitionBy("tech").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    z1 = F.sum("thickness").over(up)
    return stack.withColumn("z1", z1).withColumn("z0", F.col("z1") - F.col("thickness"))
