"""Reports: CSV, JSON, markdown tables and window lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files, a file a partition."""
    df.write.mode("overwrite").option("header", True).csv(path)


def to_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def split_csv(df: DataFrame, path: str) -> None:
    """One folder of CSV files per value of ``split``."""
    df.write.mode("overwrite").partitionBy("split").option("header", True).csv(path)


def point_clouds(points: DataFrame, path: str) -> None:
    """A folder a window, its points in order of index: (window_id, p_idx, …)."""
    points.repartition("window_id").sortWithinPartitions("window_id", "p_idx").write.mode("overwrite").partitionBy("window_id").parquet(path)


def markdown(df: DataFrame) -> str:
    """A table of all rows, on the driver: for summaries, which are short. Others are exported as files."""
    rows = df.collect()
    show = lambda v: "n/a" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(show, r)) + " |" for r in rows)]) + "\n"


def window_yaml(windows: DataFrame, designs: DataFrame) -> DataFrame:
    """One text of the window list: designs with their files, windows in order.

    windows: (design, name, position, size_category, x1, y1, x2, y2); designs: (name, gds, def, stack, tech_node, layermap).
    """
    num = lambda c: F.format_string("%.3f", F.col(c).cast("double"))
    entry = F.concat(F.lit("  - {name: "), "name", F.lit(", size_category: "), "size_category", *[x for c in ("x1", "y1", "x2", "y2") for x in (F.lit(f", {c}: "), num(c))], F.lit("}"))
    per = windows.groupBy("design").agg(F.array_sort(F.collect_list(F.struct("position", entry.alias("e")))).alias("w"))
    head = F.concat(F.lit("- name: "), "name", *[x for c in ("gds", "def", "stack", "tech_node", "layermap") for x in (F.lit(f"\n  {c}: "), F.col(c))], F.lit("\n  windows:\n"))
    both = designs.join(per, designs["name"] == per["design"], "left")
    body = F.concat(head, F.coalesce(F.array_join(F.transform("w", lambda x: x["e"]), "\n"), F.lit("")))
    return both.select(body.alias("b"), "name").agg(F.concat(F.lit("designs:\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "b"))), lambda x: x["b"]), "\n"), F.lit("\n")).alias("text"))
