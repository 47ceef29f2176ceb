"""Comparison of two label sets and summaries of their errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR = 1e-20  # least magnitude of a reference value that divides


def errors(a: DataFrame, b: DataFrame, keys: list[str], reference: str = "a") -> DataFrame:
    """Inner join on the keys; per row ``a``, ``b``, ``abs_err``, signed ``diff`` and ``rel_err``.

    ``reference`` names the side taken as truth, whose magnitude divides.
    """
    joined = a.select(*keys, F.col("value_f").alias("a")).join(b.select(*keys, F.col("value_f").alias("b")), keys)
    truth, other = ("a", "b") if reference == "a" else ("b", "a")
    diff = F.col(other) - F.col(truth)
    return joined.select(*keys, "a", "b", F.abs(diff).alias("abs_err"), diff.alias("diff"), (F.abs(diff) / F.greatest(F.abs(truth), F.lit(FLOOR))).alias("rel_err"))


def summary(rows: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """Count, mean, exact median, population deviation, mean magnitude, maximum and minimum, of all rows or each group.

    The median comes from refined quantiles, so that no task holds a group's values.
    """
    from .quantiles import with_median

    rows = rows.select(*(keys or []), column)
    c = F.col(column)
    return with_median(rows, keys or [], column, [
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.avg(F.abs(c)).alias("mean_abs"), F.max(c).alias("max"), F.min(c).alias("min"),
    ])


def histogram(rows: DataFrame, column: str = "rel_err") -> DataFrame:
    """Counts below 1 %, up to 5 %, up to 10 %, and beyond."""
    e = F.col(column)
    return rows.agg(
        F.count_if(e < 0.01).alias("below_1"), F.count_if((e >= 0.01) & (e < 0.05)).alias("below_5"),
        F.count_if((e >= 0.05) & (e < 0.1)).alias("below_10"), F.count_if(e >= 0.1).alias("rest"),
    )


def worst(rows: DataFrame, k: int, *ties: str, column: str = "rel_err") -> DataFrame:
    """The k largest errors; ties by the given columns."""
    return rows.orderBy(F.desc(column), *ties).limit(k)


def coverage(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of either side with the side that holds them: ``both``, ``a`` or ``b``."""
    x, y = (d.select(key).distinct().withColumn(f"in_{n}", F.lit(True)) for d, n in ((a, "a"), (b, "b")))
    side = F.when(F.col("in_a") & F.col("in_b"), "both").when(F.col("in_a"), "a").otherwise("b")
    return x.join(y, key, "full_outer").select(key, side.alias("side"))


def loss_metrics(prediction: str = "prediction", target: str = "target", eps: float = 1e-8) -> list[Column]:
    """MSE, MSRE, MARE and RMSE; relative ones divide by target plus ``eps``."""
    d = F.col(prediction) - F.col(target)
    rel = d / (F.col(target) + eps)
    return [F.avg(d * d).alias("mse"), F.avg(rel * rel).alias("msre"), F.avg(F.abs(rel)).alias("mare"), F.sqrt(F.avg(d * d)).alias("rmse")]


def batch_weighted(batches: DataFrame, names: tuple[str, ...] = ("mse", "msre", "mare", "rmse"), weight: str = "n") -> DataFrame:
    """Means of per-batch metrics weighted by batch size; RMSE too is averaged, not pooled."""
    return batches.agg(*[(F.sum(F.col(c) * F.col(weight)) / F.sum(weight)).alias(c) for c in names])


def scatter_points(rows: DataFrame, most: int, *order: str) -> DataFrame:
    """The first ``most`` points of a plot, in a stated order."""
    return rows.orderBy(*order).limit(most)
