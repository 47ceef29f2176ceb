"""Scalar functions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def resize_index(i: Column, source: Column, target: Column) -> Column:
    """Nearest-neighbour source index of target i, cut to the source."""
    return F.least(F.greatest(F.floor(i * source / target), F.lit(0)), source - 1).cast("int")


def duration(seconds: Column) -> Column:
    """``h:mm:ss``."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def inverted(m: Column) -> Column:
    """A map with keys and values exchanged; of equal values the least key stays."""
    entries = F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k"))))
    firsts = F.filter(entries, lambda e, i: (i == 0) | (F.get(entries, i - 1)["v"] != e["v"]))
    return F.map_from_entries(firsts)


def cross(a: Column, b: Column) -> Column:
    return F.array(*[a[(i + 1) % 3] * b[(i + 2) % 3] - a[(i + 2) % 3] * b[(i + 1) % 3] for i in range(3)])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
