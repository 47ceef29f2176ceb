"""Solver outputs by line patterns, on DataFrame operations: the context of a line is carried by a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.labels import folded_pairs, folded_self
from .text import lines

# Line patterns of the formats.
NUMBER = r"([+\-]?[0-9]*\.?[0-9]+(?:[eE][+\-]?[0-9]+)?)"
TASK = r"^Task\s+(.+?):\s"
MASTER = rf"^Master\s+(.+?)\s*:\s*{NUMBER}\s*F\s*$"
CAP_ON = rf"^Capacitance on\s+(.+?)\s*=\s*{NUMBER}\s*F\s*$"
BLOCK_CAP = rf"^C\s+(\d+)\s+(\d+)\s+{NUMBER}\s+([0-9.]+)%?$"

PREPARATION = r"Preparation cost:\s*([\d.]+)sec"
INITIALIZATION = r"Task .*? initialization cost\s*([\d.]+)sec"
WALK = r"Task .*? random walk cost\s*([\d.]+)sec"
WALKS = r"RWCap has run (\d+) walks"
WALKS_LOOSE = r"RWCap has run\s+(\d+)\s+walks"
RAPHAEL_RUN = r"\*\|Raphael runtime:\s*([\d.]+)\s*s"
DSPF_FILE = r"\*\|DSPF FILE:.*?/W(\d+)_Net"
ELAPSED = r"Elapsed time:\s*([\d.]+)sec"


def so_far():
    """The lines of a file up to this one."""
    return Window.partitionBy("window_id", "path").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)


def carried(value: Column) -> Column:
    """The last value seen up to this line of the file."""
    return F.last(value, ignorenulls=True).over(so_far())


def group(pattern: str, k: int) -> Column:
    """Group k of the line's match; null without a match (a line that begins the pattern may still fail it)."""
    return F.when(F.col("line").rlike(pattern), F.regexp_extract("line", pattern, k))


def with_pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.withColumns({"net_lo": F.least(a, b), "net_hi": F.greatest(a, b)})


def rwcap_nets(files: DataFrame, threshold_f: float = 0.0, drop_nets: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Self values (window_id, net, value_f) and pairs (window_id, net_lo, net_hi, value_f) of net-level output.

    A master row sets its net's self value; a capacitance on the current task's own net replaces it if larger in
    magnitude. Other rows are couplings of the task's net, positive, folded in file order. A master before any
    task makes its net current.
    """
    rows = lines(files).withColumns({"task": group(TASK, 1), "master": group(MASTER, 1), "m_val": group(MASTER, 2).cast("double"), "on": group(CAP_ON, 1), "c_val": group(CAP_ON, 2).cast("double")})
    tasks = F.last("task", ignorenulls=True).over(so_far())
    first_master = F.first("master", ignorenulls=True).over(so_far())
    rows = rows.withColumn("net", F.coalesce(tasks, first_master))
    own = F.col("on") == F.col("net")
    selfs = rows.where(F.col("master").isNotNull() | own).select("window_id", F.coalesce("master", "net").alias("net"), F.coalesce("m_val", "c_val").alias("value_f"), F.col("master").isNotNull().alias("is_master"), "seq")
    couplings = rows.where(F.col("on").isNotNull() & F.col("net").isNotNull() & ~own & (F.abs("c_val") >= threshold_f))
    couplings = couplings.where(~F.col("on").isin(*drop_nets)) if drop_nets else couplings
    couplings = with_pairs(couplings.select("window_id", "net", "on", F.abs("c_val").alias("value_f"), "seq"), "net", "on")
    return folded_self(selfs, ["window_id", "net"]), folded_pairs(couplings, ["window_id", "net_lo", "net_hi"])


def rwcap_blocks(files: DataFrame, threshold_f: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Self values and pairs of block-level output; block ids are numbers, the diagonal is self."""
    trimmed = lines(files).withColumn("line", F.trim("line"))
    rows = trimmed.where(F.col("line").rlike(BLOCK_CAP)).select("window_id", "seq", group(BLOCK_CAP, 1).cast("int").alias("i"), group(BLOCK_CAP, 2).cast("int").alias("j"), group(BLOCK_CAP, 3).cast("double").alias("value_f"))
    rows = rows.where(F.abs("value_f") >= threshold_f)
    selfs = folded_self(rows.where("i = j").select("window_id", F.col("i").alias("net"), "value_f", F.lit(False).alias("is_master"), "seq"), ["window_id", "net"])
    pairs = with_pairs(rows.where("i <> j").withColumn("value_f", F.abs("value_f")), "i", "j")
    return selfs, folded_pairs(pairs, ["window_id", "net_lo", "net_hi"])


def raphael_nets(files: DataFrame, threshold_f: float = 0.0, drop_nets: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Totals and pairs of DSPF text: ``*|NET name total`` opens a net; C rows count only if the net is an end."""
    rows = lines(files).withColumn("line", F.trim("line")).withColumn("f", F.split("line", r"\s+"))
    opens = F.startswith("line", F.lit("*|NET"))
    known = opens & (F.size("f") >= 3)
    # A net line without a total closes the current net, which an empty name stands for.
    rows = rows.withColumn("net", F.nullif(carried(F.when(known, F.col("f")[1]).when(opens, F.lit(""))), F.lit("")))
    totals = rows.where(known).groupBy("window_id", F.col("f")[1].alias("net")).agg(F.max_by(F.coalesce(F.col("f")[2].try_cast("double"), F.lit(0.0)), "seq").alias("value_f"))
    caps = rows.where(F.col("net").isNotNull() & F.upper("line").startswith("C") & (F.size("f") >= 4))
    caps = caps.select("window_id", "net", "seq", F.col("f")[1].alias("a"), F.col("f")[2].alias("b"), F.abs(F.element_at("f", -1).try_cast("double")).alias("value_f"))
    other = F.when(F.col("a") == F.col("net"), F.col("b")).when(F.col("b") == F.col("net"), F.col("a"))
    caps = caps.withColumn("other", other).where(F.col("other").isNotNull() & (F.col("value_f") >= threshold_f))
    if drop_nets:
        caps = caps.where(~F.col("net").isin(*drop_nets) & ~F.col("other").isin(*drop_nets))
    return totals, folded_pairs(with_pairs(caps, "net", "other"), ["window_id", "net_lo", "net_hi"])


def numbers(pattern: str) -> Column:
    """All numbers that a pattern's group 1 finds in the text."""
    return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda x: x.cast("double"))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def rwcap_times(files: DataFrame) -> DataFrame:
    """Per file the first preparation, sums of initialisation and walk times, first walk count and nets; 0 where missing."""
    rows = files.select("window_id", numbers(PREPARATION).alias("prep"), numbers(INITIALIZATION).alias("init"), numbers(WALK).alias("walk"), numbers(WALKS).alias("walks"))
    first = lambda c: F.coalesce(F.get(c, F.lit(0)), F.lit(0.0))
    rows = rows.select("window_id", first("prep").alias("prep_s"), total(F.col("init")).alias("init_s"), total(F.col("walk")).alias("walk_s"), first("walks").cast("long").alias("walks"), F.size("init").alias("nets"))
    return rows.withColumn("total_s", F.col("prep_s") + F.col("init_s") + F.col("walk_s"))


def rwcap_outputs(files: DataFrame) -> DataFrame:
    """Per file the last walk count and the last elapsed time; null where missing."""
    last = lambda p: F.try_element_at(numbers(p), F.lit(-1))
    return files.select("window_id", last(WALKS_LOOSE).cast("long").alias("walks"), last(ELAPSED).alias("elapsed_s"))


def raphael_times(files: DataFrame) -> DataFrame:
    """Per window the run times summed over its file; the window is the last that a ``DSPF FILE`` line names, else the
    parent folder. Of several files of a window the last by path counts."""
    w = F.try_element_at(F.regexp_extract_all("text", F.lit(DSPF_FILE), F.lit(1)), F.lit(-1))
    parent = F.element_at(F.split("path", "/"), -2)
    rows = files.select(F.coalesce(F.concat(F.lit("W"), w), parent).alias("window_id"), "path", total(numbers(RAPHAEL_RUN)).alias("runtime_s"))
    return rows.groupBy("window_id").agg(F.max_by("runtime_s", "path").alias("runtime_s"))
