"""Exact order statistics of groups of any size, without a task that holds a group.

A round sketches the values still in question (a mergeable quantile sketch with partial aggregation) and keeps, for each
wanted rank, those between two of its cuts that certainly enclose it; what lies below is counted exactly. After a few
rounds some thousand values a rank are left, which are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS = 64  # of a sketch
ACCURACY = 4_000  # of a sketch: ranks are right to a four-thousandth, so that the cuts next but one enclose a rank
FEW = 100_000  # values of a rank that are ranked at once
ROUNDS = 40
STATES = 200_000  # wanted ranks that are sent to all tasks, some 100 bytes each


def _ranked(rows: DataFrame, keys: list[str], value: str, wanted: DataFrame) -> DataFrame:
    """(keys, want, value): the values at ranks ``rank`` (from 0) of wanted (keys, want, rank)."""
    from ..lineage import ensure_checkpoints

    ensure_checkpoints(rows.sparkSession)
    by = [*keys, "want"]
    rows = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("value")).checkpoint()
    none = F.lit(None).cast(dict(rows.dtypes)["value"])
    # ``rank`` counts within the values in question, those between ``lo`` and ``hi`` (both excluded; null is open).
    state = wanted.select(*by, "rank", none.alias("lo"), none.alias("hi")).checkpoint()
    small = state.count() <= STATES
    sent = (lambda d: F.broadcast(d)) if small else (lambda d: d)

    def held(state: DataFrame) -> DataFrame:
        within = (F.col("lo").isNull() | (F.col("value") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("value") < F.col("hi")))
        return rows.join(sent(state), keys).where(within)

    out = None
    for _ in range(ROUNDS):
        seen = held(state).groupBy(*by, "rank", "lo", "hi").agg(F.count("*").alias("n")).checkpoint()
        few = F.col("n") <= FEW
        at = F.row_number().over(Window.partitionBy(*by).orderBy("value")) - 1
        part = held(seen.where(few).drop("n")).withColumn("_at", at).where(F.col("_at") == F.col("rank")).select(*by, "value").checkpoint()
        out = part if out is None else out.unionByName(part)
        many = seen.where(~few)
        if not many.limit(1).count():
            return out
        cuts = F.percentile_approx("value", [i / CUTS for i in range(CUTS + 1)], ACCURACY)
        cut = held(many.drop("n")).groupBy(*by).agg(cuts.alias("cuts")).join(many, by)
        place = F.floor(F.col("rank") / F.col("n") * CUTS).cast("int")
        low = F.when(place > 1, F.element_at("cuts", F.greatest(place, F.lit(1))))
        high = F.when(place + 2 < CUTS, F.element_at("cuts", F.least(place + 3, F.lit(CUTS + 1))))
        narrow = cut.select(*by, "rank", "lo", "hi", low.alias("a"), high.alias("b")).checkpoint()
        v, a, b = F.col("value"), F.col("a"), F.col("b")
        # Five parts: below a, at a, between, at b, above b. Whichever holds the rank is the next to look at, or the answer.
        parts = {"n0": v < a, "n1": v == a, "n2": (a.isNull() | (v > a)) & (b.isNull() | (v < b)), "n3": (v == b) & ~a.eqNullSafe(b), "n4": v > b}
        found = held(narrow).groupBy(*by, "rank", "lo", "hi", "a", "b").agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in parts.items()])
        before = {k: sum((F.col(f"n{i}") for i in range(k)), F.lit(0)) for k in range(6)}
        which = F.when(F.col("rank") < before[1], 0).when(F.col("rank") < before[2], 1).when(F.col("rank") < before[3], 2).when(F.col("rank") < before[4], 3).otherwise(4)
        found = found.withColumn("which", which).checkpoint()
        w = F.col("which")
        out = out.unionByName(found.where(w.isin(1, 3)).select(*by, F.when(w == 1, a).otherwise(b).alias("value")))
        gone = F.when(w == 2, before[2]).when(w == 4, before[4]).otherwise(F.lit(0))
        # Only part 2 lies between a and b; part 0 below a, part 4 above b.
        lo, hi = F.when(w == 0, F.col("lo")).when(w == 2, F.coalesce(a, F.col("lo"))).otherwise(b), F.when(w == 0, a).when(w == 2, F.coalesce(b, F.col("hi"))).otherwise(F.col("hi"))
        state = found.where(~w.isin(1, 3)).select(*by, (F.col("rank") - gone).alias("rank"), lo.alias("lo"), hi.alias("hi")).checkpoint()
        if not state.limit(1).count():
            return out
    raise RuntimeError("values didn't separate")


def _keyed(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    return (rows, keys) if keys else (rows.withColumn("_all", F.lit(0)), ["_all"])


def order_statistic(rows: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """(keys, value): each group's k-th least value (from 1); groups with fewer values have no row."""
    rows, by = _keyed(rows, keys)
    wanted = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") >= k)
    wanted = wanted.select(*by, F.lit(0).alias("want"), F.lit(k - 1).cast("long").alias("rank"))
    return _ranked(rows, by, value, wanted).select(*keys, "value")


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """(keys, share, value): exact quantiles, between two values in proportion, as ``percentile`` gives them."""
    from ..lineage import ensure_checkpoints

    ensure_checkpoints(rows.sparkSession)
    rows, by = _keyed(rows.withColumn(value, F.col(value).cast("double")), keys)
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"))
    at: Column = F.col("share") * (F.col("n") - 1)
    spread = counted.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).withColumn("at", at)
    ends = F.array(F.struct(F.floor("at").alias("rank"), (1 - F.col("at") + F.floor("at")).alias("w")), F.struct(F.ceil("at").alias("rank"), (F.col("at") - F.floor("at")).alias("w")))
    wanted = spread.select(*by, "share", F.explode(ends).alias("e")).select(*by, "share", F.col("e.rank").cast("long").alias("want"), F.col("e.w").alias("w")).where("w > 0").checkpoint()
    values = _ranked(rows, by, value, wanted.select(*by, "want", F.col("want").alias("rank")).distinct())
    return wanted.join(values, [*by, "want"]).groupBy(*keys, "share").agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def with_median(rows: DataFrame, keys: list[str], value: str, aggregates: list[Column]) -> DataFrame:
    """Aggregates of each group (one row where ``keys`` are none) and its exact ``median``; the rows are computed once."""
    from ..lineage import ensure_checkpoints

    ensure_checkpoints(rows.sparkSession)
    rows = rows.checkpoint()
    middle = quantiles(rows, keys, value, [0.5]).select(*keys, F.col("value").alias("median"))
    out = rows.groupBy(*keys).agg(*aggregates)
    if keys:
        return out.join(middle, keys, "left")
    found = middle.first()  # one number
    return out.withColumn("median", F.lit(None if found is None else found["median"]).cast("double"))
