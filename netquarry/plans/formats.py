"""Queries that write the formats from the tables, read them back and give what was read.

Each takes a whole table: labels, blocks, placements and logs become texts, one a window, and the readers' rows are held
against SQL over the same table. Texts stay columns but where files are the point (shards, reports).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import scratch
from ..operators import labels, layout
from ..sinks import export, npz as npz_sink, shards, text as text_sink
from ..sources import cap3d, catalog, lefdef, npz, solver, spef
from . import base
from .base import CAPS, query, rounded, table


def texts(df: DataFrame, window: str = "window_id") -> DataFrame:
    """Texts as the readers take them."""
    return df.select(F.concat(F.lit("/in/"), F.col(window).cast("string"), F.lit(".txt")).alias("path"), F.col(window).cast("string").alias("window_id"), "text")


def log(rows: DataFrame, window: str, order: list[str], line: Column) -> DataFrame:
    """A text per window of lines in order."""
    lines = F.sort_array(F.collect_list(F.struct(*order, line.alias("line"))))
    return texts(rows.groupBy(window).agg(F.array_join(lines["line"], "\n").alias("text")), window)


def say(*parts: str | Column) -> Column:
    """Text of parts; strings are literal."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def out_folder(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


# Labels in picofarads, as label files hold them.


def _label_text(spark: SparkSession, sf_dir: str, both_ends: bool = False) -> DataFrame:
    pico = lambda d: d.withColumn("value_f", F.col("value_f") * 1e-12).withColumn("window_id", F.col("window_id").cast("string"))
    pairs = labels.directional_pairs(base.caps(spark, sf_dir))
    return texts(text_sink.spef(pico(base.selfs(spark, sf_dir)), pico(pairs), "top", both_ends))


@query(f"WITH {CAPS} SELECT CAST(window_id AS VARCHAR) AS window_id, net, round(value_f, 4) AS total_pf FROM selfs")
def s17_spef_nets(spark, sf_dir):
    found = spef.nets(spef.read_spef(_label_text(spark, sf_dir)))
    return found.select("window_id", "net", F.round(F.col("total_f") * 1e12, 4).alias("total_pf"))


@query(f"WITH {CAPS} SELECT CAST(window_id AS VARCHAR) AS window_id, net_lo AS net, net_lo AS node_a, net_hi AS node_b, round(value_f, 3) AS value_pf FROM pairs")
def s18_spef_couplings(spark, sf_dir):
    found = spef.caps(spef.read_spef(_label_text(spark, sf_dir))).where("node_b is not null")
    return found.select("window_id", "net", "node_a", "node_b", F.round(F.col("value_f") * 1e12, 3).alias("value_pf"))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS window_id, k AS key, v AS value FROM (SELECT DISTINCT l_orderkey FROM lineitem), (VALUES ('DESIGN', 'top'), ('DIVIDER', '/'), ('DELIMITER', ':'), ('SPEF', 'IEEE 1481-1998')) h(k, v)")
def s19_spef_headers(spark, sf_dir):
    return spef.headers(spef.read_spef(_label_text(spark, sf_dir)))


@query(f"WITH {CAPS} SELECT CAST(window_id AS VARCHAR) AS window_id, net_lo, net_hi, round(value_f, 3) AS value_pf FROM pairs")
def s20_simple_couplings(spark, sf_dir):
    found = spef.simple_couplings(_label_text(spark, sf_dir))
    return found.select("window_id", "net_lo", "net_hi", F.round(F.col("value_f") * 1e12, 3).alias("value_pf"))


@query(f"WITH {CAPS} SELECT CAST(window_id AS VARCHAR) AS window_id, net, count(*) AS rows FROM (SELECT window_id, net_lo AS net FROM pairs UNION ALL SELECT window_id, net_hi FROM pairs) GROUP BY ALL")
def k06_couplings_at_both_ends(spark, sf_dir):
    return spef.caps(spef.read_spef(_label_text(spark, sf_dir, True))).where("node_b is not null").groupBy("window_id", "net").agg(F.count("*").alias("rows"))


# Solver outputs: a task per net, what it reports of itself and of the next net.
_TASKS = """n AS (SELECT l_orderkey AS w, l_linenumber AS i, max(l_quantity) AS q, max(l_suppkey % 7 + 1) AS c FROM lineitem GROUP BY ALL),
t AS (SELECT w, concat('N', i) AS net, 'N' || lead(i) OVER (PARTITION BY w ORDER BY i) AS other, q, c, i FROM n)"""


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("w"), F.col("l_linenumber").alias("i")).agg(F.max("l_quantity").alias("q"), F.max(F.col("l_suppkey") % 7 + 1).alias("c"))
    after = F.lead("i").over(Window.partitionBy("w").orderBy("i"))
    return rows.select("w", "i", say("N", F.col("i")).alias("net"), say("N", after).alias("other"), "q", "c")


def _rwcap_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each task's block of lines; a first task's coupling is repeated, smaller, by a second run."""
    body = say("Task ", F.col("net"), ": run\nTask ", F.col("net"), ": initialization cost 0.5sec\nMaster ", F.col("net"), " : ", F.format_string("%.3e", F.col("q") * 1e-15), " F\nCapacitance on ", F.col("net"), " = -1e-16 F\nCapacitance on GROUND = -2e-18 F")
    body = F.concat(body, F.when(F.col("other").isNotNull(), say("\nCapacitance on ", F.col("other"), " = -", F.format_string("%.3e", F.col("c") * 1e-16), " F\nCapacitance on ", F.col("other"), " = ", F.format_string("%.3e", F.col("c") * 5e-17), " F")).otherwise(""))
    return log(_tasks(spark, sf_dir), "w", ["i"], body)


@query(f"WITH {_TASKS} SELECT CAST(w AS VARCHAR) AS window_id, net, round(q, 3) AS value_ff FROM t")
def s21_rwcap_totals(spark, sf_dir):
    found, _ = solver.rwcap_nets(_rwcap_text(spark, sf_dir), 1e-17)
    return found.select("window_id", "net", F.round(F.col("value_f") * 1e15, 3).alias("value_ff"))


@query(f"WITH {_TASKS} SELECT CAST(w AS VARCHAR) AS window_id, net AS net_lo, other AS net_hi, round(c * 0.075, 4) AS value_ff FROM t WHERE other IS NOT NULL")
def s21_rwcap_couplings(spark, sf_dir):
    _, found = solver.rwcap_nets(_rwcap_text(spark, sf_dir), 1e-17)
    return found.select("window_id", "net_lo", "net_hi", F.round(F.col("value_f") * 1e15, 4).alias("value_ff"))


_BLOCKS = "b AS (SELECT l_orderkey AS w, l_linenumber AS i, l_suppkey % 9 + 1 AS j, l_quantity * CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END AS v FROM lineitem)"


def _block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    v = F.col("l_quantity") * F.when(F.col("l_linenumber") % 2 == 0, -1).otherwise(1)
    rows = li.select(F.col("l_orderkey").alias("w"), "l_linenumber", "l_partkey", "l_suppkey", say("C ", F.col("l_linenumber"), " ", F.col("l_suppkey") % 9 + 1, " ", F.format_string("%.1f", v), " 0.5%").alias("line"))
    return log(rows, "w", ["l_linenumber", "l_partkey", "l_suppkey"], F.col("line"))


@query(f"WITH {_BLOCKS} SELECT CAST(w AS VARCHAR) AS window_id, CAST(i AS INTEGER) AS net, v AS value_f FROM b WHERE i = j QUALIFY row_number() OVER (PARTITION BY w, i ORDER BY abs(v) DESC, v) = 1")
def s22_block_totals(spark, sf_dir):
    return solver.rwcap_blocks(_block_text(spark, sf_dir))[0]


@query(f"WITH {_BLOCKS} SELECT CAST(w AS VARCHAR) AS window_id, count(DISTINCT (least(i, j), greatest(i, j))) AS pairs, min(abs(v)) FILTER (n = 1) AS least FROM (SELECT *, count(*) OVER (PARTITION BY w, least(i, j), greatest(i, j)) AS n FROM b WHERE i <> j) GROUP BY w")
def s22_block_pairs(spark, sf_dir):
    found = solver.rwcap_blocks(_block_text(spark, sf_dir))[1]
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("window_id"), F.least("l_linenumber", F.col("l_suppkey") % 9 + 1).cast("int").alias("net_lo"), F.greatest("l_linenumber", F.col("l_suppkey") % 9 + 1).cast("int").alias("net_hi"))
    single = li.groupBy("window_id", "net_lo", "net_hi").agg(F.count("*").alias("n"))
    return found.join(single, ["window_id", "net_lo", "net_hi"]).groupBy("window_id").agg(F.count("*").alias("pairs"), F.min(F.when(F.col("n") == 1, F.col("value_f"))).alias("least"))


@query(f"WITH {_TASKS} SELECT CAST(w AS VARCHAR) AS window_id, net, round(q, 3) AS total_ff, round(c * 0.1, 4) AS coupling_ff FROM t")
def s23_raphael_nets(spark, sf_dir):
    rows = _tasks(spark, sf_dir)
    body = F.concat(say("*|NET ", F.col("net"), " ", F.format_string("%.4e", F.col("q") * 1e-15)), F.when(F.col("other").isNotNull(), say("\nC1 ", F.col("net"), " ", F.col("other"), " ", F.format_string("%.4e", F.col("c") * 1e-16), "\nC2 X Y 9e-15")).otherwise(""))
    totals, pairs = solver.raphael_nets(log(rows, "w", ["i"], body))
    pairs = pairs.select("window_id", F.col("net_lo").alias("net"), F.round(F.col("value_f") * 1e15, 4).alias("coupling_ff"))
    last = rows.where("other is null").select(F.col("w").cast("string").alias("window_id"), "net", F.round(F.col("c") * 0.1, 4).alias("own"))
    out = totals.join(pairs, ["window_id", "net"], "left").join(last, ["window_id", "net"], "left")
    return out.select("window_id", "net", F.round(F.col("value_f") * 1e15, 3).alias("total_ff"), F.coalesce("coupling_ff", "own").alias("coupling_ff"))


# Logs of runs: events of a user.
_EVENTS = "e AS (SELECT user_id AS w, event_id AS k, event_type AS t, floor(value * 10) / 10 AS s FROM events)"


def _event_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.floor(F.col("value") * 10) / 10
    name = say("Task n", F.col("event_id"), " ")
    line = F.when(F.col("event_type") == "click", say(name, "initialization cost ", s, "sec")).when(F.col("event_type") == "view", say(name, "random walk cost ", s, "sec"))
    line = line.when(F.col("event_type") == "purchase", say("RWCap has run ", F.col("event_id"), " walks\nElapsed time: ", s, "sec")).otherwise(say("Preparation cost: ", s, "sec"))
    return log(table(spark, sf_dir, "events"), "user_id", ["event_id"], line)


@query(f"""WITH {_EVENTS} SELECT CAST(w AS VARCHAR) AS window_id, coalesce(arg_min(s, k) FILTER (t NOT IN ('click', 'view', 'purchase')), 0) AS prep_s, round(coalesce(sum(s) FILTER (t = 'click'), 0), 4) AS init_s, round(coalesce(sum(s) FILTER (t = 'view'), 0), 4) AS walk_s,
    coalesce(min(k) FILTER (t = 'purchase'), 0) AS walks, CAST(count(*) FILTER (t = 'click') AS INTEGER) AS nets FROM e GROUP BY w""")
def s24_rwcap_times(spark, sf_dir):
    return rounded(solver.rwcap_times(_event_text(spark, sf_dir)).drop("total_s"), "init_s", "walk_s").withColumns({c: F.round(c, 4) for c in ("init_s", "walk_s")})


@query(f"WITH {_EVENTS} SELECT CAST(w AS VARCHAR) AS window_id, max(k) FILTER (t = 'purchase') AS walks, arg_max(s, k) FILTER (t = 'purchase') AS elapsed_s FROM e GROUP BY w")
def s25_rwcap_outputs(spark, sf_dir):
    return solver.rwcap_outputs(_event_text(spark, sf_dir))


@query("SELECT concat('W', user_id) AS window_id, round(sum(floor(value * 10) / 10), 4) AS runtime_s FROM events GROUP BY 1")
def s26_raphael_times(spark, sf_dir):
    line = say("*|DSPF FILE: run/W", F.col("user_id"), "_Net", F.col("event_id"), ".dspf\n*|Raphael runtime: ", F.floor(F.col("value") * 10) / 10, " s")
    return solver.raphael_times(log(table(spark, sf_dir, "events"), "user_id", ["event_id"], line)).withColumn("runtime_s", F.round("runtime_s", 4))


# Layouts: parts are macros and blocks, customers placements and routes.


@query("""SELECT p_brand AS window_id, concat('net', p_size % 7) AS parent, CAST(p_partkey AS VARCHAR) AS name, CAST(p_size % 4 AS INTEGER) AS layer, round(p_size / 8.0, 4) AS x0, round(p_size / 8.0 + p_retailprice / 1000, 4) AS x1 FROM part""")
def s03_cap3d_blocks(spark, sf_dir):
    """Conductor blocks through CAP3D text; vectors are single precision there, so lengths are compared to four places."""
    n = F.col("p_size")
    vec = lambda *v: F.array(*[x.cast("double") if isinstance(x, Column) else F.lit(float(x)) for x in v])
    blocks = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("window_id"), say("net", n % 7).alias("parent"), F.col("p_partkey").cast("string").alias("name"), (n % 4).alias("layer"), F.col("p_partkey").alias("seq"),
        vec(n / 8, 0, 1).alias("base"), vec(F.col("p_retailprice") / 1000, 0, 0).alias("v1"), vec(0, 2, 0).alias("v2"), vec(0, 0, 0.25).alias("hvec"),
    )
    windows = blocks.select("window_id", vec(0, 0, 0).alias("v1"), vec(99, 99, 9).alias("v2")).distinct()
    layers = windows.select("window_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("id")).select("window_id", "id", say("M", F.col("id")).alias("name"), F.lit("metal").alias("type"))
    found = cap3d.compact(cap3d.read_cap3d(texts(text_sink.cap3d(blocks, layers, windows))))
    names = cap3d.blocks(cap3d.read_cap3d(texts(text_sink.cap3d(blocks, layers, windows)))).select("window_id", "seq", "name")
    return found.join(names, ["window_id", "seq"]).select("window_id", "parent", "name", "layer", F.round(F.col("x0").cast("double"), 4).alias("x0"), F.round(F.col("x1").cast("double"), 4).alias("x1"))


@query("""SELECT p_brand AS window_id, count(*) AS blocks, count(DISTINCT p_size % 7) AS nets FROM part GROUP BY 1""")
def s36_block_counter(spark, sf_dir):
    body = say("<conductor>\n  name net", F.col("p_size") % 7, "\n<block>\n  name ", F.col("p_partkey"), "\n</block>\n</conductor>")
    return cap3d.count_tags(log(table(spark, sf_dir, "part"), "p_brand", ["p_partkey"], body)).select("window_id", "blocks", "nets")


_PLACED = "c AS (SELECT c_nationkey AS w, c_custkey AS k, ['N', 'S', 'FN', 'E'][c_custkey % 4 + 1] AS o, c_custkey % 800 / 8.0 AS x, c_custkey % 50 * 1.4 AS y FROM customer)"


def _placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    orient = F.element_at(F.array(*map(F.lit, ("N", "S", "FN", "E"))), (k % 4 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("window_id"), say("u", k).alias("name"), F.col("c_mktsegment").alias("cell"), (k % 800 / 8).alias("x"), (k % 50 * F.lit(1.4)).alias("y"), orient.alias("orient"), F.lit("PLACED").alias("status"))


def _def_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placements and routes of each nation, through the text of a window at (1, 2)."""
    comps = _placements(spark, sf_dir)
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    routes = comps.select("window_id", F.concat(F.lit("net_"), "name").alias("net"), F.lit(0).alias("seq"), F.lit("metal1").alias("layer"), F.lit(0.14).alias("width"), F.array(point(F.col("x"), F.col("y")), point(F.col("x") + 3, F.col("y")), point(F.col("x") + 3, F.col("y") + 5)).alias("points"))
    windows = comps.select("window_id").distinct().select("window_id", F.lit(1.0).alias("x0"), F.lit(2.0).alias("y0"), F.lit(101.0).alias("x1"), F.lit(102.0).alias("y1"))
    return lefdef.read_def(texts(text_sink.windowed_def("top", 2000, comps, routes, windows)))


@query(f"WITH {_PLACED} SELECT CAST(w AS VARCHAR) AS window_id, concat('u', k) AS name, o AS orient, round(x - 1, 4) AS x, round(y - 2, 4) AS y FROM c")
def s10_def_components(spark, sf_dir):
    found = _def_rows(spark, sf_dir).where("kind = 'component'")
    return found.select("window_id", "name", "orient", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(f"""WITH {_PLACED}, l AS (SELECT w, k, x - 1 AS ax, y - 2 AS ay, x + 2 AS bx, y - 2 AS byy, 0 AS leg FROM c UNION ALL SELECT w, k, x + 2, y - 2, x + 2, y + 3, 1 FROM c)
    SELECT CAST(w AS VARCHAR) AS window_id, concat('net_u', k) AS net, leg, round(ax - 0.07, 3) AS x0, round(ay - 0.07, 3) AS y0, round(bx + 0.07, 3) AS x1, round(byy + 0.07, 3) AS y1 FROM l""")
def s12_def_routes(spark, sf_dir):
    found = lefdef.route_rects(_def_rows(spark, sf_dir))
    return found.select("window_id", "net", F.col("leg").cast("int").alias("leg"), *[F.round(c, 3).alias(c) for c in ("x0", "y0", "x1", "y1")])


def _lef_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("p_size"), F.col("p_partkey")
    macro = say("MACRO m", k, " # made\n  CLASS ", F.when(n % 3 == 0, "BLOCK").otherwise("CORE"), " ;\n  SIZE ", n / 8, " BY ", n / 4, " ;\n  PIN A\n    USE ", F.when(n % 2 == 0, "POWER").otherwise("SIGNAL"), " ;\n    PORT\n      LAYER metal", n % 4 + 1, " ;\n      RECT 0 0 ", n / 16, " 1 ;\n    END\n  END A\n  OBS\n    LAYER metal1 ;\n    RECT 1 1 2 2 ;\n  END\nEND m", k)
    return log(table(spark, sf_dir, "part"), "p_brand", ["p_partkey"], macro)


@query("SELECT concat('m', p_partkey) AS cell, p_size / 8.0 AS w, p_size / 4.0 AS h, CASE WHEN p_size % 3 = 0 THEN 'BLOCK' ELSE 'CORE' END AS cell_class FROM part")
def s13_lef_macros(spark, sf_dir):
    rows = lefdef.read_lef(_lef_text(spark, sf_dir))
    return lefdef.macro_sizes(rows).join(lefdef.macro_classes(rows), "cell")


@query("SELECT concat('m', p_partkey) AS macro, 'A' AS pin, CASE WHEN p_size % 2 = 0 THEN 'POWER' ELSE 'SIGNAL' END AS use, concat('metal', p_size % 4 + 1) AS layer, p_size / 16.0 AS x1 FROM part UNION ALL SELECT concat('m', p_partkey), NULL, NULL, 'metal1', 2 FROM part")
def s15_lef_rects(spark, sf_dir):
    return lefdef.read_lef(_lef_text(spark, sf_dir)).where("kind in ('pin_rect', 'obs_rect')").select("macro", "pin", "use", "layer", "x1")


_CELL = """MACRO {cell}
  SIZE 4 BY 4 ;
  PIN A
    LAYER metal1 ;
    RECT 0 0 1 2 ;
  END A
  PIN VDD
    USE POWER ;
    LAYER metal1 ;
    RECT 0 3.5 4 4 ;
  END VDD
  OBS
    LAYER metal2 ;
    RECT 0 3 0.5 4 ;
    RECT 1 1 2 2 ;
    RECT 2 1 3 1.5 ;
  END
END {cell}
"""


@query("""WITH c AS (SELECT c_nationkey AS w, c_custkey AS k, c_custkey % 4 AS o, c_custkey % 800 / 8.0 AS x, c_custkey % 50 * 1.5 AS y FROM customer),
    r(label, layer, x0, y0, x1, y1) AS (VALUES ('PIN_A', 'metal1', 0.0, 0.0, 1.0, 2.0), ('SUPPLY_POWER', 'metal1', 0.0, 3.5, 4.0, 4.0), ('OBS0', 'metal2', 0.0, 3.0, 0.5, 4.0), ('OBS1', 'metal2', 1.0, 1.0, 2.0, 2.0), ('OBS1', 'metal2', 2.0, 1.0, 3.0, 1.5))
    SELECT CAST(w AS VARCHAR) AS window_id, concat('__lef__/u', k, '/', label) AS conductor, true AS synthetic, layer, round(x + CASE WHEN o IN (1, 2) THEN 4 - x1 ELSE x0 END, 4) AS x0, round(x + CASE WHEN o IN (1, 2) THEN 4 - x0 ELSE x1 END, 4) AS x1,
      round(y + CASE WHEN o IN (1, 3) THEN 4 - y1 ELSE y0 END, 4) AS y0, round(y + CASE WHEN o IN (1, 3) THEN 4 - y0 ELSE y1 END, 4) AS y1 FROM c, r
    UNION ALL SELECT CAST(w AS VARCHAR), concat('net_u', k), false, 'metal1', round(x - 0.07, 4), round(x + 3.07, 4), round(y - 0.07, 4), round(y + 0.07, 4) FROM c""")
def r07_def_rects(spark, sf_dir):
    """Routes, pins, supplies and obstructions of all placements, in all upright orientations."""
    k = F.col("c_custkey")
    comps = _placements(spark, sf_dir).drop("orient", "y").join(
        table(spark, sf_dir, "customer").select(say("u", k).alias("name"), F.element_at(F.array(*map(F.lit, ("N", "S", "FN", "FS"))), (k % 4 + 1).cast("int")).alias("orient"), (k % 50 * F.lit(1.5)).alias("y")), "name"
    )
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    routes = comps.select("window_id", F.concat(F.lit("net_"), "name").alias("net"), F.lit(0).alias("seq"), F.lit("metal1").alias("layer"), F.lit(0.14).alias("width"), F.array(point(F.col("x"), F.col("y")), point(F.col("x") + 3, F.col("y"))).alias("points"))
    windows = comps.select("window_id").distinct().select("window_id", *[F.lit(v).alias(c) for c, v in (("x0", 0.0), ("y0", 0.0), ("x1", 200.0), ("y1", 200.0))])
    design = lefdef.read_def(texts(text_sink.windowed_def("top", 2000, comps, routes, windows)))
    cells = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("cell")).distinct()
    macros = lefdef.read_lef(texts(cells.select(F.col("cell").alias("window_id"), F.replace(F.lit(_CELL), F.lit("{cell}"), F.col("cell")).alias("text"))))
    found = layout.def_rects(design, macros)
    return found.select("window_id", "conductor", "synthetic", "layer", *[F.round(c, 4).alias(c) for c in ("x0", "x1", "y0", "y1")])


@query("SELECT concat('Layer', p_partkey) AS layer_name, CAST(p_size AS INTEGER) AS gds, CAST(CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_partkey % 5 END AS INTEGER) AS dtype FROM part")
def s29_layermap(spark, sf_dir):
    k = F.col("p_partkey")
    line = say(F.col("p_size"), F.when(k % 3 == 0, F.lit("")).otherwise(say("/", k % 5)), " : Layer", k, F.when(k % 2 == 0, " # a remark").otherwise(say(" (", F.col("p_size"), "/0)")))
    return catalog.layermap(log(table(spark, sf_dir, "part"), "p_brand", ["p_partkey"], line))


# Stores and reports are really written.
_PIXELS = f"""{base.RECTS}, w AS (SELECT window_id, CAST(row_number() OVER (ORDER BY CAST(window_id AS VARCHAR)) - 1 AS INTEGER) AS k FROM (SELECT DISTINCT window_id FROM rects))"""


@query(f"WITH {_PIXELS} SELECT CAST(window_id AS VARCHAR) AS window_id, k // 4 AS shard_id, k % 4 AS shard_offset, count(x) AS pixels, CAST(coalesce(sum(cid), 0) AS BIGINT) AS ids FROM w LEFT JOIN pixels USING (window_id) GROUP BY ALL")
def k10_shards(spark, sf_dir):
    pixels = base.painted(spark, sf_dir).select(F.col("window_id").cast("string").alias("window_id"), "layer", "y", "x", F.lit(1.0).alias("density"), F.col("cid").cast("long").alias("cid"))
    windows = base.rects(spark, sf_dir).select(F.col("window_id").cast("string").alias("window_id")).distinct()
    windows = windows.select("window_id", F.array(F.lit("M1")).alias("layer_names"), F.array(F.lit(True)).alias("layer_has_density"), F.lit(64).alias("height"), F.lit(64).alias("width"))
    folder = out_folder(spark, "shards")
    shards.write(pixels, windows, folder, 4)
    rows, index = shards.read(spark, folder)
    sums = rows.groupBy("window_id").agg(F.count("x").alias("pixels"), F.sum("cid").alias("ids"))
    found = index.join(sums, "window_id", "left")
    return found.select("window_id", "shard_id", "shard_offset", F.coalesce("pixels", F.lit(0)).cast("long").alias("pixels"), F.coalesce("ids", F.lit(0)).cast("long").alias("ids"))


@query("SELECT vec_id AS p_idx, CAST(label AS VARCHAR) AS window_id, round(CAST(embedding[1] AS DOUBLE), 6) AS x FROM embeddings")
def k11_point_clouds(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    folder = out_folder(spark, "clouds")
    export.point_clouds(e.select(F.col("label").cast("string").alias("window_id"), F.col("vec_id").alias("p_idx"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")]), folder)
    return spark.read.schema("p_idx long, x double, y double, z double, window_id string").parquet(folder).select("p_idx", "window_id", F.round("x", 6).alias("x"))


@query("SELECT p_partkey, p_name, CASE WHEN p_size % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM part")
def k15_split_csv(spark, sf_dir):
    folder = out_folder(spark, "csv")
    export.split_csv(table(spark, sf_dir, "part").select("p_partkey", "p_name", F.when(F.col("p_size") % 5 == 0, "test").otherwise("train").alias("split")), folder)
    return spark.read.option("header", True).schema("p_partkey long, p_name string, split string").csv(folder)


# Large files: nets of all orders in eight label files, components and nets of all customers in four designs.


def _folder_of_files(lines, spark: SparkSession, name: str) -> str:
    """Writes (file, place, value) as one text a file, lines in order of place, by Spark's text writer."""
    folder = out_folder(spark, name)
    lines.repartition("file").sortWithinPartitions("file", "place").select("file", "value").write.partitionBy("file").text(folder)
    return folder


def _file_of(path: str = "path") -> Column:
    return F.regexp_extract(path, r"file=(\d+)", 1).cast("int")


@query("""WITH n AS (SELECT l_orderkey AS k, l_linenumber AS j, max(l_quantity) AS q, max(l_suppkey % 7 + 1) AS c FROM lineitem GROUP BY ALL)
    SELECT CAST(k % 8 AS INTEGER) AS file, concat('net_', k, '_', j) AS net, CASE WHEN node = 0 THEN NULL ELSE concat('net_', k, '_', j, ':1') END AS node_b, round(CASE WHEN node = 0 THEN q ELSE c / 4.0 END * CASE WHEN k % 8 < 4 THEN 1 ELSE 1000 END, 6) AS value_ff
    FROM n, range(0, 2) t(node)""")
def s17_split_labels(spark, sf_dir):
    """Grounds and couplings of label files that are read in splits, their names through the map, in two units."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("j")).agg(F.max("l_quantity").alias("q"), F.max(F.col("l_suppkey") % 7 + 1).alias("c"))
    rows = rows.withColumns({"file": (F.col("k") % 8).cast("int"), "id": F.col("k") * 8 + F.col("j")})
    star = say("*", F.col("id"))
    place = lambda part: F.struct(F.lit(part).alias("part"), "id").alias("place")
    head = rows.select("file").distinct().select("file", F.struct(F.lit(0).alias("part"), F.lit(0).cast("long").alias("id")).alias("place"), say('*SPEF "x"\n*C_UNIT 1 ', F.when(F.col("file") < 4, "FF").otherwise("PF"), "\n*NAME_MAP").alias("value"))
    names = rows.select("file", place(1), say(star, " net_", F.col("k"), "_", F.col("j")).alias("value"))
    gap = head.select("file", F.struct(F.lit(2).alias("part"), F.lit(0).cast("long").alias("id")).alias("place"), F.lit("").alias("value"))
    body = rows.select("file", place(3), say("*D_NET ", star, " ", F.col("q"), "\n*CAP\n1 ", star, " ", F.col("q"), "\n2 ", star, " ", star, ":1 ", F.col("c") / 4, "\n*END").alias("value"))
    folder = _folder_of_files(head.unionByName(names).unionByName(gap).unionByName(body), spark, "labels")
    found = spef.read_spef_files(spark, folder).where("kind = 'cap'")
    return found.select(_file_of().alias("file"), "net", "node_b", F.round(F.col("value_f") * 1e15, 6).alias("value_ff"))


@query("""SELECT CAST(c_nationkey % 4 AS INTEGER) AS file, 'component' AS kind, concat('c', c_custkey) AS name, c_mktsegment AS what, round(c_custkey / 100.0, 6) AS x FROM customer
    UNION ALL SELECT CAST(c_nationkey % 4 AS INTEGER), 'net', concat('n', c_custkey), concat('c', c_custkey, '/A,PIN/p'), NULL FROM customer
    UNION ALL SELECT CAST(c_nationkey % 4 AS INTEGER), 'route', concat('n', c_custkey), 'm1', round((c_custkey % 500) / 100.0, 6) FROM customer""")
def s08_split_designs(spark, sf_dir):
    """Components, nets and routes of designs that are read in splits: sections and units reach every record."""
    c = table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 4).cast("int").alias("file"), F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("cell"))
    mark = lambda part, *lines: c.select("file").distinct().select("file", F.struct(F.lit(part).alias("part"), F.lit(0).cast("long").alias("k")).alias("place"), F.lit("\n".join(lines)).alias("value"))
    row = lambda part, *text: c.select("file", F.struct(F.lit(part).alias("part"), "k").alias("place"), say(*text).alias("value"))
    k = F.col("k")
    parts = [
        mark(0, "VERSION 5.8 ;", "DESIGN top ;", "UNITS DISTANCE MICRONS 100 ;", "COMPONENTS 1 ;"), row(1, "- c", k, " ", F.col("cell"), " + PLACED ( ", k, " 7 ) N ;"), mark(2, "END COMPONENTS", "NETS 1 ;"),
        row(3, "- n", k, " ( c", k, " A ) ( PIN p )\n  + ROUTED m1 ( ", k % 500, " 5 ) ( ", k % 500 + 10, " * )\n ;"), mark(4, "END NETS", "END DESIGN"),
    ]
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.unionByName(p)
    found = lefdef.read_def_files(spark, _folder_of_files(lines, spark, "designs"))
    what = F.when(F.col("kind") == "component", F.col("cell")).when(F.col("kind") == "net", F.array_join("connections", ",")).otherwise(F.col("layer"))
    return found.where(F.col("kind").isin("component", "net", "route")).select(_file_of().alias("file"), "kind", "name", what.alias("what"), F.round(F.coalesce("x", F.get("points", F.lit(0))), 6).alias("x"))


# Archives: pixels and clouds are written as NumPy files and read through the data sources.


@query(f"""WITH {_PIXELS} SELECT CAST(window_id AS VARCHAR) AS window_id, format('shard_{{:06d}}.npz', k // 4) AS shard, k % 4 AS shard_offset, layer, count(*) AS pixels, CAST(sum(cid) AS BIGINT) AS ids, CAST(sum(y * 64 + x) AS BIGINT) AS places,
    round(sum(cid % 8 / 8.0), 4) AS density FROM w JOIN pixels USING (window_id) GROUP BY ALL""")
def s31_npz_shards(spark, sf_dir):
    pixels = base.painted(spark, sf_dir).select(F.col("window_id").cast("string").alias("window_id"), "layer", "y", "x", (F.col("cid") % 8 / 8).alias("density"), F.col("cid").cast("long").alias("cid"))
    windows = base.rects(spark, sf_dir).select(F.col("window_id").cast("string").alias("window_id")).distinct()
    folder = out_folder(spark, "npz")
    npz_sink.write_shards(pixels, windows, folder, 8, 64, 64, 4)
    return npz.shards(spark, folder).groupBy("window_id", "shard", "shard_offset", "layer").agg(F.count("*").alias("pixels"), F.sum("cid").alias("ids"), F.sum(F.col("y") * 64 + F.col("x")).alias("places"), F.round(F.sum("density"), 4).alias("density"))


@query("""SELECT concat('W', vec_id // 64) AS window_id, row_number() OVER (PARTITION BY vec_id // 64 ORDER BY vec_id) - 1 AS p_idx, round(CAST(embedding[1] AS DOUBLE), 6) AS x, round(CAST(embedding[2] AS DOUBLE), 6) AS nx,
    CASE WHEN label < 5 THEN 1.0 ELSE -1.0 END AS flux, CASE WHEN vec_id // 64 % 2 = 0 THEN concat('net', label) ELSE CAST(label AS VARCHAR) END AS net FROM embeddings""")
def s34_npz_clouds(spark, sf_dir):
    """Clouds of 64 points; those of every other window have names, the others take them from their ids."""
    k, label = F.col("vec_id"), F.col("label")
    at = lambda i: F.col("embedding")[i]
    points = table(spark, sf_dir, "embeddings").select(
        say("W", F.expr("vec_id div 64")).alias("window_id"), k.alias("p_idx"), at(0).alias("x"), at(1).alias("nx"), F.when(label < 5, 1.0).otherwise(-1.0).alias("flux"), label.alias("net_id"),
        F.when(F.expr("vec_id div 64") % 2 == 0, say("net", label)).alias("net"),
    )
    folder = out_folder(spark, "npz-clouds")
    npz_sink.write_clouds(points, folder)
    return npz.clouds(spark, folder).select("window_id", "p_idx", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("x", "nx")], F.col("flux").cast("double").alias("flux"), "net")
