"""Names: canonical forms, lookups by ladders of ever looser keys, unique names."""

from __future__ import annotations

from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Supply nets, the prefix of conductors without a net, and those of names that a tool made up.
GROUND_NETS = ("VSS", "VSSPE", "VGND", "GND", "GROUND")
POWER_NETS = ("VDD", "VDDPE", "VPWR", "POWER")
INTERNAL = "__internal__."
MADE_UP = ("Net.", "SpecialNet.", "__lef__/")


def layer_key(name: Column) -> Column:
    """Alphanumeric characters, lower case."""
    return F.lower(F.regexp_replace(name, r"[^A-Za-z0-9]", ""))


def def_layer(name: Column) -> Column:
    """``poly``, ``contact``, ``metalN`` or ``viaN``, by what the name holds anywhere; null for other layers."""
    n = F.lower(name)
    numbered = lambda kind, marks: F.concat(F.lit(kind), F.regexp_replace(F.regexp_extract(n, rf"(?:{marks})\s*([0-9]+)", 1), "^0+(?=[0-9])", ""))
    return (
        F.when(n.contains("poly"), "poly").when(n.contains("licon") | n.contains("contact"), "contact")
        .when(n.rlike(r"m\s*[0-9]|(?:metal|met)\s*[0-9]"), numbered("metal", "metal|met|m"))
        .when(n.rlike(r"(?:via|v)\s*[0-9]"), numbered("via", "via|v"))
    )


def base_net(name: Column) -> Column:
    """Without a trailing ``.N``."""
    return F.regexp_replace(name, r"\.[0-9]+$", "")


def bracket_index(name: Column) -> Column:
    """Trimmed, brackets unescaped, and numbers in brackets without them: ``a\\[3\\]`` and ``a[3]`` are ``a3``."""
    plain = F.replace(F.replace(F.trim(name), F.lit("\\["), F.lit("[")), F.lit("\\]"), F.lit("]"))
    return F.regexp_replace(plain, r"\[([0-9]+)\]", "$1")


def is_generic(name: Column) -> Column:
    """Whether a tool made the name up, or there is none."""
    n = F.trim(F.coalesce(name, F.lit("")))
    return reduce(or_, [F.startswith(n, F.lit(p)) for p in MADE_UP], n == "")


def supply(name: Column) -> Column:
    up = F.upper(name)
    return F.when(up.isin(*GROUND_NETS), "GROUND").when(up.isin(*POWER_NETS), "POWER").otherwise("SIGNAL")


def solver_of(comment: Column) -> Column:
    """What a header comment names after ``solver:`` or ``solver=``; null without that."""
    return F.nullif(F.regexp_extract(F.coalesce(comment, F.lit("")), r"(?i)solver\s*[:=]\s*(\S+)", 1), F.lit(""))


def sanitized(name: Column) -> Column:
    """Letters, digits, underscores and dots alone; NET where nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(F.coalesce(name, F.lit("")), "[^A-Za-z0-9_.]", ""), F.lit("")), F.lit("NET"))


def unique_names(rows: DataFrame, key: str, name: str, seq: str) -> DataFrame:
    """Sanitized names made unique within a key in order of first appearance: ``x``, ``x_1``, ``x_2``, …

    Rows of one name share it. A suffixed name may itself be taken by a later original, so the choice is sequential
    within a key; keys are windows, of bounded size.
    """
    firsts = rows.groupBy(key, name).agg(F.min(seq).alias(seq)).withColumn("_clean", sanitized(F.col(name)))

    def choose(g: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        g = g.sort_values(seq)
        for clean in g["_clean"]:
            free, k = clean, 0
            while free in taken:
                k += 1
                free = f"{clean}_{k}"
            taken.add(free)
            out.append(free)
        return pd.DataFrame({key: g[key], name: g[name], "unique_name": out})

    kinds = dict(rows.dtypes)
    named = firsts.groupBy(key).applyInPandas(choose, f"{key} {kinds[key]}, {name} {kinds[name]}, unique_name string")
    named = named.withColumnsRenamed({key: "_key", name: "_name"})
    return rows.join(named, rows[key].eqNullSafe(named["_key"]) & rows[name].eqNullSafe(named["_name"])).drop("_key", "_name")


def internal_names(rows: DataFrame, key: str, name: str, synthetic: str, seq: str) -> DataFrame:
    """``canonical``: synthetic conductors numbered ``__internal__.k`` per key, others by their unique sanitized name.

    A given name that comes to begin with that prefix is an error.
    """
    run = F.sum(F.col(synthetic).cast("int")).over(Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0))
    made = rows.withColumn("_k", run).where(synthetic).withColumn("canonical", F.concat(F.lit(INTERNAL), F.col("_k").cast("string"))).drop("_k")
    real = unique_names(rows.where(~F.col(synthetic)), key, name, seq)
    reserved = F.raise_error(F.concat(F.lit("reserved name: "), F.col(name)))
    real = real.withColumn("canonical", F.when(F.startswith("unique_name", F.lit(INTERNAL)), reserved).otherwise(F.col("unique_name")))
    return made.unionByName(real.drop("unique_name"))


def ladder(rows: DataFrame, known: DataFrame, name: str, steps: list, target: str = "net") -> DataFrame:
    """``resolved``: the known name that the first step of the ladder finds; null where none does.

    A step is a pair of functions that make a lookup key of the sought and of the known name. Of known names
    with one key the least is taken.
    """
    out, found = rows, []
    for i, (of_row, of_known) in enumerate(steps):
        keyed = known.select(of_known(F.col(target)).alias(f"_k{i}"), F.col(target).alias("_n")).where(F.col(f"_k{i}").isNotNull()).groupBy(f"_k{i}").agg(F.min("_n").alias(f"_f{i}"))
        out = out.join(keyed, of_row(F.col(name)) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
        found.append(F.col(f"_f{i}"))
    return out.withColumn("resolved", F.coalesce(*found)).drop(*[f"_f{i}" for i in range(len(steps))])


def same(c: Column) -> Column:
    return c


def no_dots(c: Column) -> Column:
    return F.replace(c, F.lit("."), F.lit(""))


def before(mark: str):
    return lambda c: F.substring_index(c, mark, 1)


#: Alignment of solver names with a name map: exact, without dots, before the first dot, lower, lower without dots.
#: Only the sought name is loosened.
ALIGN = [(same, same), (no_dots, same), (before("."), same), (F.lower, same), (lambda c: F.lower(no_dots(c)), same)]
#: Endpoint of a coupling: exact, or the part before ``:``, ``/`` or a backslash.
ENDPOINT = [(same, same), (before(":"), same), (before("/"), same), (before("\\"), same)]


def cloud_key(name: Column) -> Column:
    """Lower case, without slashes, brackets, braces, dollar signs and blanks."""
    return F.lower(F.regexp_replace(name, r"[/\\\[\]{}$\s]", ""))


#: Point-cloud conductor.
CLOUD = [(cloud_key, cloud_key)]


def aligned(rows: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """``resolved``: the known name that a solver's name stands for, or the name itself where none fits."""
    return ladder(rows, known, name, ALIGN).withColumn("resolved", F.coalesce("resolved", F.col(name)))


def aligned_labels(selfs: DataFrame, pairs: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels under known names: totals (window_id, net, value_f) that fall together add up, pairs (window_id, net_lo,
    net_hi, value_f, seq) take the running mean in order, and a pair whose ends fall together goes."""
    totals = aligned(selfs, known, "net").groupBy("window_id", F.col("resolved").alias("net")).agg(F.sum("value_f").alias("value_f"))
    ends = aligned(aligned(pairs, known, "net_lo").withColumnRenamed("resolved", "_a"), known, "net_hi").withColumnRenamed("resolved", "_b")
    values = F.transform(F.array_sort(F.collect_list(F.struct("seq", "value_f"))), lambda x: x["value_f"])
    met = ends.where("_a <> _b").groupBy("window_id", F.least("_a", "_b").alias("net_lo"), F.greatest("_a", "_b").alias("net_hi")).agg(values.alias("_v"))
    fold = F.aggregate(F.slice("_v", 2, F.greatest(F.size("_v") - 1, F.lit(0))), F.col("_v")[0], lambda a, x: (a + x) / 2)
    return totals, met.select("window_id", "net_lo", "net_hi", fold.alias("value_f"))


def abbreviated(n: Column) -> Column:
    """Counts as text with K, M or B, rounded to a tenth as Python's ``.1f``: by the double's exact value, ties to even.

    Numbers below a thousand are rounded to whole ones, ties to even.
    """
    sign, n = F.when(n < 0, "-").otherwise(""), F.abs(n)

    def f(d: float, s: str) -> Column:
        q = n / d
        # 20 q is a + b, which are exact; twice + rest is their sum without error.
        a, b = q * 16, q * 4
        twice = a + b
        rest = (a - (twice - (twice - a))) + (b - (twice - a))
        tenths = F.floor(twice / 2)
        over = twice - (2 * tenths + 1)
        up = (over > 0) | ((over == 0) & ((rest > 0) | ((rest == 0) & (tenths % 2 == 1))))
        tenths = tenths + up.cast("long")
        exact = F.concat(F.floor(tenths / 10), F.lit("."), tenths % 10, F.lit(s))
        return F.when(q < 1e14, exact).otherwise(F.format_string("%.1f" + s, q))

    return F.concat(sign, F.when(n >= 1e9, f(1e9, "B")).when(n >= 1e6, f(1e6, "M")).when(n >= 1e3, f(1e3, "K")).otherwise(F.rint(n).cast("long").cast("string")))


def window_number(name: Column) -> Column:
    """Digits of a window's name as a number, to sort W2 before W10."""
    return F.coalesce(F.nullif(F.regexp_replace(name, "[^0-9]", ""), F.lit("")).cast("int"), F.lit(0))
