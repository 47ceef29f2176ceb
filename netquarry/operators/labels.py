"""Label algebra over capacitance rows: totals, couplings, pair folds, thresholds.

Capacitance rows are ``(window_id, net, node_a, node_b, value_f, seq)``; ``node_b`` is null for ground rows.
Pairs are unordered: ``net_lo <= net_hi``. Three pair semantics exist side by side and are never merged:
directional mean, running half-mean in file order, and last write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUND = "GROUND"


def ground_and_coupling(caps: DataFrame) -> DataFrame:
    """Per window and net the sums of ground rows and of coupling rows."""
    ground = F.col("node_b").isNull()
    return caps.groupBy("window_id", "net").agg(
        F.coalesce(F.sum(F.when(ground, F.col("value_f"))), F.lit(0.0)).alias("ground_f"),
        F.coalesce(F.sum(F.when(~ground, F.col("value_f"))), F.lit(0.0)).alias("coupling_f"),
    )


def net_totals(nets: DataFrame) -> DataFrame:
    """Declared total per net; of repeated declarations the last by ``seq`` wins."""
    return nets.groupBy("window_id", "net").agg(F.max_by("total_f", "seq").alias("total_f"))


def with_pair(rows: DataFrame, a: str = "node_a", b: str = "node_b") -> DataFrame:
    return rows.withColumn("net_lo", F.least(a, b)).withColumn("net_hi", F.greatest(a, b))


def directional_pairs(caps: DataFrame) -> DataFrame:
    """Mean over owners of what each owner reports for a pair: first summed per owner, then averaged."""
    couplings = with_pair(caps.where(F.col("node_b").isNotNull() & (F.col("node_a") != F.col("node_b"))))
    owned = couplings.groupBy("window_id", "net_lo", "net_hi", "net").agg(F.sum("value_f").alias("v"))
    return owned.groupBy("window_id", "net_lo", "net_hi").agg(F.avg("v").alias("value_f"))


def folded_pairs(rows: DataFrame, keys: list[str], value: str = "value_f", seq: str = "seq") -> DataFrame:
    """Running half-mean in file order: the first value, then ``(old + new) / 2`` for each further one."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(value).alias("v"))))
    folded = F.aggregate(ordered, F.lit(None).cast("double"), lambda acc, x: F.when(acc.isNull(), x["v"]).otherwise((acc + x["v"]) / 2))
    return rows.groupBy(*keys).agg(folded.alias(value))


def folded_self(rows: DataFrame, keys: list[str], value: str = "value_f", seq: str = "seq", master: str = "is_master") -> DataFrame:
    """Self value in file order: a master row sets it, another row replaces it only if larger in magnitude."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(value).alias("v"), F.col(master).alias("m"))))
    take = lambda acc, x: F.when(x["m"] | acc.isNull() | (F.abs(acc) < F.abs(x["v"])), x["v"]).otherwise(acc)
    return rows.groupBy(*keys).agg(F.aggregate(ordered, F.lit(None).cast("double"), take).alias(value))


def last_write_pairs(rows: DataFrame) -> DataFrame:
    """The last row by ``seq`` of each pair."""
    return with_pair(rows).groupBy("window_id", "net_lo", "net_hi").agg(F.max_by("value_f", "seq").alias("value_f"))


def magnitude_filter(rows: DataFrame, threshold_f: float, drop_nets: tuple[str, ...] = ()) -> DataFrame:
    """Rows of at least the threshold's magnitude whose ends are not among the dropped nets."""
    keep = F.abs("value_f") >= threshold_f
    for end in ("net_lo", "net_hi"):
        keep = keep & ~F.col(end).isin(*drop_nets) if drop_nets else keep
    return rows.where(keep)


def with_selfs(pairs: DataFrame, selfs: DataFrame) -> DataFrame:
    """Pairs with ``self_lo`` and ``self_hi``; 0 where an end has no self capacitance."""
    lo = selfs.select("window_id", F.col("net").alias("net_lo"), F.abs("value_f").alias("self_lo"))
    hi = selfs.select("window_id", F.col("net").alias("net_hi"), F.abs("value_f").alias("self_hi"))
    joined = pairs.join(lo, ["window_id", "net_lo"], "left").join(hi, ["window_id", "net_hi"], "left")
    return joined.fillna(0.0, ["self_lo", "self_hi"])


def passes(mode: str, ratio: float) -> Column:
    """Threshold on a pair with both selfs: ``any`` end suffices, or ``both`` ends must exist and pass."""
    c = F.abs("value_f")
    if mode == "any":
        return ((F.col("self_lo") > 0) & (c >= ratio * F.col("self_lo"))) | ((F.col("self_hi") > 0) & (c >= ratio * F.col("self_hi")))
    if mode == "both":
        return (F.col("self_lo") > 0) & (F.col("self_hi") > 0) & (c >= ratio * F.col("self_lo")) & (c >= ratio * F.col("self_hi"))
    raise ValueError(mode)


def threshold_pairs(pairs: DataFrame, selfs: DataFrame, mode: str, ratio: float) -> DataFrame:
    return with_selfs(pairs, selfs).where(passes(mode, ratio)).select(*pairs.columns)


def threshold_counts(pairs: DataFrame, selfs: DataFrame, mode: str, ratio: float) -> DataFrame:
    """Per window the pairs considered (an end has a self) and removed; each pair counts once."""
    known = with_selfs(pairs, selfs).where((F.col("self_lo") > 0) | (F.col("self_hi") > 0))
    return known.groupBy("window_id").agg(F.count("*").alias("considered"), F.count_if(~passes(mode, ratio)).alias("removed"))


def prune_orphans(pairs: DataFrame, selfs: DataFrame) -> DataFrame:
    """Pairs of which at least one end has a self capacitance; with ground, the other end must have it."""
    joined = with_selfs(pairs, selfs)
    lo, hi = F.col("self_lo") > 0, F.col("self_hi") > 0
    keep = F.when(F.col("net_lo") == GROUND, hi).when(F.col("net_hi") == GROUND, lo).otherwise(lo | hi)
    return joined.where(keep).select(*pairs.columns)


def discrepancy(selfs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per window the sums of selfs and of couplings at each end, their difference and its ratio to the selfs."""
    ends = pairs.select("window_id", F.explode(F.array("net_lo", "net_hi")).alias("net"), "value_f").where(F.col("net") != GROUND)
    coupled = ends.groupBy("window_id").agg(F.sum("value_f").alias("coupling_sum"))
    totals = selfs.groupBy("window_id").agg(F.sum("value_f").alias("self_sum"))
    both = totals.join(coupled, "window_id", "left").fillna(0.0, ["coupling_sum"])
    gap = F.abs(F.col("self_sum") - F.col("coupling_sum"))
    ratio = F.when(F.col("self_sum") != 0, gap / F.abs("self_sum")).when(gap > 0, F.lit(float("inf"))).otherwise(0.0)
    return both.withColumn("gap", gap).withColumn("ratio", ratio)


def positive_couplings(pairs: DataFrame, least: float = 1e-20) -> DataFrame:
    return pairs.where(F.col("value_f") > least)
