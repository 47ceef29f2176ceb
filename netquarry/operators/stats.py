"""Statistics of windows, designs, runtimes and stacks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runtime_summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, sample deviation (0 for a single value) and sum."""
    return rows.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.sum(value).alias("total")
    )


def average_walks(rows: DataFrame, keys: list[str], walks: str) -> DataFrame:
    """Total and whole-number average of walk counts."""
    return rows.groupBy(*keys).agg(F.sum(walks).alias("walks"), F.floor(F.sum(walks) / F.count(walks)).alias("avg_walks"))


def distribution(value: str) -> list[Column]:
    return [F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")]


def window_statistics(blocks: DataFrame, group: str) -> DataFrame:
    """Per group the distribution of blocks a window, with windows, conductors and totals; most blocks first."""
    each = blocks.groupBy(group, "window_id").agg(F.count("*").alias("blocks"), F.count_distinct("conductor").alias("conductors"))
    from .quantiles import with_median

    counts = [F.count("*").alias("windows"), F.sum("blocks").alias("total_blocks"), F.sum("conductors").alias("total_conductors")]
    return with_median(each, [group], "blocks", [*counts, *distribution("blocks")])


def outcome_counts(files: DataFrame, group: str) -> DataFrame:
    """Per group the files read and those that failed; files: (group, window_id, error)."""
    each = files.groupBy(group, "window_id").agg(F.count("error").alias("e"))
    return each.groupBy(group).agg(F.count_if(F.col("e") == 0).alias("succeeded"), F.count_if(F.col("e") > 0).alias("failed"))


def layer_histogram(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("layer").agg(F.count("*").alias("blocks"))


def design_metrics(components: DataFrame, classes: DataFrame, nets: DataFrame) -> DataFrame:
    """Per design the macros, standard cells and nets; cells of a class other than CORE are macros, of unknown class standard."""
    cells = components.join(classes, "cell", "left")
    macro = F.coalesce(~F.upper("cell_class").startswith("CORE"), F.lit(False))
    counted = cells.groupBy("design").agg(F.count_if(macro).alias("macros"), F.count_if(~macro).alias("std_cells"))
    return counted.join(nets.groupBy("design").agg(F.count("*").alias("nets")), "design", "left").fillna(0, ["nets"])


def core_size(rows: DataFrame) -> DataFrame:
    """Per design the extent of its placement rows."""
    return rows.groupBy("design").agg((F.max("x1") - F.min("x0")).alias("width"), (F.max("y1") - F.min("y0")).alias("height"))


def coverage_percent(windows: DataFrame, dies: DataFrame) -> DataFrame:
    """Window area over die area in per cent; null for an empty or unknown die."""
    side = lambda a, b: F.greatest(F.col(b) - F.col(a), F.lit(0.0))
    area = windows.groupBy("design").agg(F.sum(side("x1", "x2") * side("y1", "y2")).alias("area"))
    die = dies.select("design", ((F.col("dx1") - F.col("dx0")) * (F.col("dy1") - F.col("dy0"))).alias("die_area"))
    both = die.join(area, "design", "left").fillna(0.0, ["area"])
    return both.select("design", F.when(F.col("die_area") > 0, 100 * F.col("area") / F.col("die_area")).alias("percent"))


def stage_counters(planned: DataFrame, done: DataFrame) -> DataFrame:
    """Per stage the units planned, done before, and left."""
    marked = planned.join(done.select("stage", "unit").distinct().withColumn("_done", F.lit(1)), ["stage", "unit"], "left")
    return marked.groupBy("stage").agg(F.count("*").alias("total"), F.count("_done").alias("existing"), F.count_if(F.col("_done").isNull()).alias("pending"))


def cluster_conflicts(rows: DataFrame) -> DataFrame:
    """Clusters whose shapes carry more than one name."""
    return rows.groupBy("cluster").agg(F.count_distinct("name").alias("names"), F.count("*").alias("shapes")).where("names > 1")


def merge_net_metadata(rows: DataFrame) -> DataFrame:
    """Per net its use (supply uses win, then the first by ``seq``) and the union of its connections."""
    rank = F.when(F.col("use").isin("POWER", "GROUND"), 0).otherwise(1)
    # Nets meet their connections once each before lists are made; a net without any has a row without position.
    ends = rows.select("net", "use", F.struct(rank, F.col("seq")).alias("first"), F.posexplode_outer("connections").alias("_at", "end"))
    ends = ends.groupBy("net", "end", F.col("_at").isNotNull().alias("has")).agg(F.min_by("use", "first").alias("use"), F.min("first").alias("first"))
    found = F.transform(F.sort_array(F.collect_list(F.when(F.col("has"), F.struct("end")))), lambda x: x["end"])
    return ends.groupBy("net").agg(F.min_by("use", "first").alias("use"), found.alias("connections"))


# Thickness of a layer by what its name holds, in micrometres.
THICKNESS = {"metal": 0.14, "via": 0.08, "mcon": 0.05}


def layer_stack_summary(blocks: DataFrame, layers: DataFrame, media: DataFrame) -> DataFrame:
    """Per file its layers from the bottom up: name, type, z_bottom, z_top, thickness, position.

    blocks: conductor blocks (window_id, layer index, z0); layers: declared ones (window_id, layer, name, type); media:
    plate media (window_id, name, z_top). A medium reaches from the one below. A declared layer lies at the mean base
    height of its blocks, with a thickness by its name; ``via`` in the name or among the types of one name makes it a
    via. In a file with media, layers that no block places are left out.
    """
    below = F.coalesce(F.lag("z_top").over(Window.partitionBy("window_id").orderBy("z_top", "name")), F.lit(0.0))
    plates = media.select("window_id", "name", F.lit("dielectric").alias("type"), below.alias("z_bottom"), "z_top", F.lit(0).alias("_s"), F.lit(0).alias("_k"))
    via = F.lower("name").contains("via") | (F.col("type") == "via")
    first = F.min_by(F.coalesce(F.nullif("type", F.lit("")), F.lit("interconnect")), "layer")
    named = layers.groupBy("window_id", "name").agg(F.when(F.bool_or(via), "via").otherwise(first).alias("type"), F.min("layer").alias("_k"))
    means = blocks.groupBy("window_id", "layer").agg(F.avg("z0").alias("z_top"))
    # Of the indices that share a name the last placed one counts.
    placed = layers.join(means, ["window_id", "layer"]).groupBy("window_id", "name").agg(F.max_by("z_top", "layer").alias("z_top"))
    n = F.lower("name")
    thick = reduce(lambda c, kv: c.when(n.contains(kv[0]), kv[1]), THICKNESS.items(), F.when(F.lit(False), 0.0)).otherwise(0.0)
    found = named.join(placed, ["window_id", "name"], "left").withColumn("z_bottom", F.coalesce(F.col("z_top") - thick, F.lit(0.0)))
    found = found.select("window_id", "name", "type", "z_bottom", F.coalesce("z_top", F.lit(0.0)).alias("z_top"), F.lit(1).alias("_s"), "_k")
    known = media.select("window_id").distinct().withColumn("_media", F.lit(True))
    both = plates.unionByName(found).join(known, "window_id", "left").where("_media is null or z_top > 0")
    place = F.row_number().over(Window.partitionBy("window_id").orderBy("z_top", "_s", "_k", "name"))
    return both.select("window_id", "name", "type", "z_bottom", "z_top", (F.col("z_top") - F.col("z_bottom")).alias("thickness"), place.alias("position"))


def value_histogram(rows: DataFrame, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts by equal bins from ``lo`` to ``hi``; 0 holds what is below, ``bins + 1`` what is at or above the end."""
    return rows.groupBy(F.width_bucket(F.col(value), F.lit(lo), F.lit(hi), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))
