"""Queries over statistics, stacks and clouds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import geometry, points, stack, stats
from .base import query, r6, rounded, table


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, round(sum(value), 4) AS total FROM events GROUP BY 1")
def a11_runtime_summary(spark, sf_dir):
    out = stats.runtime_summary(table(spark, sf_dir, "events"), ["event_type"], "value")
    return out.select("event_type", "n", r6("mean").alias("mean"), r6("std").alias("std"), F.round("total", 4).alias("total"))


@query("SELECT user_id, sum(event_id % 1000) AS walks, CAST(floor(sum(event_id % 1000) / count(*)) AS BIGINT) AS avg_walks FROM events GROUP BY 1")
def a11_average_walks(spark, sf_dir):
    return stats.average_walks(table(spark, sf_dir, "events").withColumn("w", F.col("event_id") % 1000), ["user_id"], "w")


_HIERARCHY = """blocks AS (SELECT r_name AS tech, c_custkey AS window_id, o_orderkey AS block, o_orderpriority AS conductor, o_orderstatus AS layer
    FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey)"""


def _blocks(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    return (
        t("region").join(t("nation"), F.col("n_regionkey") == F.col("r_regionkey")).join(t("customer"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("orders"), F.col("o_custkey") == F.col("c_custkey"))
        .select(F.col("r_name").alias("tech"), F.col("c_custkey").alias("window_id"), F.col("o_orderkey").alias("block"), F.col("o_orderpriority").alias("conductor"), F.col("o_orderstatus").alias("layer"))
    )


@query(f"""WITH {_HIERARCHY}, e AS (SELECT tech, window_id, count(*) AS blocks, count(DISTINCT conductor) AS conductors FROM blocks GROUP BY ALL)
    SELECT tech, count(*) AS windows, CAST(sum(blocks) AS BIGINT) AS total_blocks, CAST(sum(conductors) AS BIGINT) AS total_conductors, round(avg(blocks), 6) AS mean, round(stddev_pop(blocks), 6) AS std, median(blocks) AS median, min(blocks) AS min, max(blocks) AS max FROM e GROUP BY tech""")
def a12_window_statistics(spark, sf_dir):
    return rounded(stats.window_statistics(_blocks(spark, sf_dir), "tech"), "mean", "std")


@query(f"WITH {_HIERARCHY} SELECT layer, count(*) AS blocks FROM blocks GROUP BY 1")
def a12_layer_histogram(spark, sf_dir):
    return stats.layer_histogram(_blocks(spark, sf_dir))


@query("""SELECT n_name AS design, count(*) FILTER (m) AS macros, count(*) FILTER (NOT m) AS std_cells, any_value(nets) AS nets FROM
    (SELECT n_nationkey, n_name, c_mktsegment IN ('BUILDING', 'FURNITURE') AS m FROM customer JOIN nation ON c_nationkey = n_nationkey) JOIN
    (SELECT c_nationkey AS k, count(*) AS nets FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1) ON k = n_nationkey GROUP BY 1""")
def a28_design_metrics(spark, sf_dir):
    comp = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    nets = comp.join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("n_name").alias("design"))
    classes = spark.createDataFrame([("BUILDING", "BLOCK BLACKBOX"), ("FURNITURE", "pad"), ("MACHINERY", "core spacer"), ("AUTOMOBILE", "CORE")], "cell string, cell_class string")
    return stats.design_metrics(comp.select(F.col("n_name").alias("design"), F.col("c_mktsegment").alias("cell")), classes, nets)


@query("""SELECT n_name AS design, CASE WHEN (max(c_custkey) - min(c_custkey)) > 0 THEN round(100.0 * sum(4) / ((max(c_custkey) - min(c_custkey)) * 10), 6) END AS percent
    FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def a37_coverage(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    x = F.col("c_custkey").cast("double")
    wins = rows.select(F.col("n_name").alias("design"), x.alias("x1"), (x + 2).alias("x2"), F.lit(0.0).alias("y1"), F.lit(2.0).alias("y2"))
    dies = rows.groupBy(F.col("n_name").alias("design")).agg(F.min(x).alias("dx0"), F.max(x).alias("dx1"), F.lit(0.0).alias("dy0"), F.lit(10.0).alias("dy1"))
    return rounded(stats.coverage_percent(wins, dies), "percent")


@query("""SELECT o_orderpriority AS stage, count(*) AS total, count(k) AS existing, count(*) FILTER (k IS NULL) AS pending
    FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R') ON k = o_orderkey GROUP BY 1""")
def a36_stage_counters(spark, sf_dir):
    planned = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("stage"), F.col("o_orderkey").alias("unit"))
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("unit"))
    return stats.stage_counters(planned, planned.join(done, "unit", "left_semi"))


@query("""SELECT l_suppkey AS cluster, count(DISTINCT l_linenumber) AS names, count(*) AS shapes FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) > 1""")
def a29_cluster_conflicts(spark, sf_dir):
    return stats.cluster_conflicts(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cluster"), F.col("l_linenumber").alias("name")))


@query("""WITH r AS (SELECT l_suppkey AS net, CASE l_returnflag WHEN 'R' THEN 'POWER' WHEN 'A' THEN 'SIGNAL' ELSE 'CLOCK' END AS u, struct_pack(a := l_orderkey, b := l_linenumber, c := l_partkey) AS seq, l_linenumber AS c FROM lineitem)
    SELECT net, arg_min(u, struct_pack(k := CASE WHEN u = 'POWER' THEN 0 ELSE 1 END, s := seq)) AS use, array_to_string(list_sort(list(DISTINCT c)), ',') AS connections FROM r GROUP BY net""")
def a30_net_metadata(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    use = F.when(F.col("l_returnflag") == "R", "POWER").when(F.col("l_returnflag") == "A", "SIGNAL").otherwise("CLOCK")
    seq = F.struct(F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b"), F.col("l_partkey").alias("c"))
    out = stats.merge_net_metadata(li.select(F.col("l_suppkey").alias("net"), use.alias("use"), seq.alias("seq"), F.array("l_linenumber").alias("connections")))
    return out.withColumn("connections", F.array_join(F.transform("connections", lambda c: c.cast("string")), ","))


# A file per brand; its declared layers by size, blocks by part, media by retail price.
_FILES = """parts AS (SELECT p_brand AS w, p_partkey AS k, p_size % 6 AS l, p_retailprice / 100 AS z FROM part),
declared AS (SELECT DISTINCT w, l, ['metal1', 'via1', 'mcon', 'metal2', 'poly', 'VIA_x'][l + 1] AS name, CASE WHEN l = 2 THEN 'via' WHEN l = 4 THEN '' ELSE 'interconnect' END AS type FROM parts),
media AS (SELECT w, concat('m', k) AS name, z AS z_top FROM parts WHERE k % 10 = 0)"""


@query(f"""WITH {_FILES}, a AS (
      SELECT w, name, 'dielectric' AS type, coalesce(lag(z_top) OVER (PARTITION BY w ORDER BY z_top, name), 0) AS z0, z_top AS z1, 0 AS s, 0 AS l FROM media
      UNION ALL SELECT w, name, CASE WHEN l IN (1, 2, 5) THEN 'via' ELSE 'interconnect' END, z - CASE WHEN l IN (0, 3) THEN 0.14 WHEN l IN (1, 5) THEN 0.08 WHEN l = 2 THEN 0.05 ELSE 0 END, z, 1, l
        FROM declared JOIN (SELECT w, l, avg(z) AS z FROM parts WHERE k % 3 = 0 GROUP BY ALL) USING (w, l)
      UNION ALL SELECT w, name, CASE WHEN l IN (1, 2, 5) THEN 'via' ELSE 'interconnect' END, 0, 0, 1, l FROM declared d
        WHERE NOT EXISTS (SELECT 1 FROM parts p WHERE p.w = d.w AND p.l = d.l AND p.k % 3 = 0) AND w NOT IN (SELECT w FROM media))
    SELECT w AS window_id, name, type, round(z0, 6) AS z_bottom, round(z1, 6) AS z_top, round(z1 - z0, 6) AS thickness, CAST(row_number() OVER (PARTITION BY w ORDER BY z1, s, l, name) AS INTEGER) AS position FROM a""")
def a34_layer_stack(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("window_id"), F.col("p_partkey").alias("k"), (F.col("p_size") % 6).alias("layer"), (F.col("p_retailprice") / 100).alias("z0"))
    name = F.element_at(F.array(*map(F.lit, ("metal1", "via1", "mcon", "metal2", "poly", "VIA_x"))), F.col("layer") + 1)
    kind = F.when(F.col("layer") == 2, "via").when(F.col("layer") == 4, "").otherwise("interconnect")
    declared = parts.select("window_id", "layer", name.alias("name"), kind.alias("type")).distinct()
    media = parts.where("k % 10 = 0").select("window_id", F.concat(F.lit("m"), "k").alias("name"), F.col("z0").alias("z_top"))
    return rounded(stats.layer_stack_summary(parts.where("k % 3 = 0"), declared, media), "z_bottom", "z_top", "thickness")


@query("SELECT CASE WHEN value < 10 THEN 0 WHEN value >= 90 THEN 9 ELSE CAST(floor((value - 10) / 10) AS BIGINT) + 1 END AS bin, count(*) AS n FROM events GROUP BY 1")
def a39_value_histogram(spark, sf_dir):
    return stats.value_histogram(table(spark, sf_dir, "events"), "value", 10.0, 90.0, 8)


# Stacks: a technology per brand, entries by part key; every second entry is a metal.
_STACK = """parts AS (SELECT p_brand AS tech, p_partkey AS pos, p_size / 16.0 AS thickness, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part),
stack AS (SELECT tech, pos, concat('L', k) AS name, CASE WHEN k % 2 = 0 THEN 'metal' ELSE 'dielectric' END AS type, thickness, k FROM parts),
h AS (SELECT *, sum(thickness) OVER (PARTITION BY tech ORDER BY pos) AS z1 FROM stack),
m AS (SELECT *, row_number() OVER (PARTITION BY tech ORDER BY pos) AS level FROM h WHERE type = 'metal'),
vias AS (SELECT a.tech, concat('V', a.k) AS via, a.name AS from_metal, b.name AS to_metal FROM m a JOIN m b ON a.tech = b.tech AND b.level = a.level + 1 WHERE a.k % 4 = 0)"""


def _stack(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("tech").orderBy("pos"))
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("tech"), F.col("p_partkey").alias("pos"), (F.col("p_size") / 16).alias("thickness")).withColumn("k", k)
    kind = F.when(F.col("k") % 2 == 0, "metal").otherwise("dielectric")
    rows = rows.select("tech", "pos", F.concat(F.lit("L"), F.col("k").cast("string")).alias("name"), kind.alias("type"), "thickness", "k", (F.col("k") / 10).alias("wmin"))
    via = rows.where("k % 4 = 0").select("tech", F.concat(F.lit("V"), F.col("k").cast("string")).alias("via"), F.col("name").alias("from_metal"), F.concat(F.lit("L"), (F.col("k") + 2).cast("string")).alias("to_metal"), F.lit(0.5).alias("wmin"))
    return rows, via.join(rows.select("tech", F.col("name").alias("to_metal")), ["tech", "to_metal"], "left_semi")


@query(f"WITH {_STACK} SELECT tech, name, round(z1 - thickness, 6) AS z0, round(z1, 6) AS z1 FROM h")
def w01_running_heights(spark, sf_dir):
    return rounded(stack.with_heights(_stack(spark, sf_dir)[0]).select("tech", "name", "z0", "z1"), "z0", "z1")


@query(f"""WITH {_STACK}, a AS (SELECT tech, name AS layer, z1 AS z, 2 * level - 1 AS slot, 'metal' AS kind FROM m UNION ALL
    SELECT v.tech, via, (a.z1 + b.z1) / 2, 2 * a.level, 'via' FROM vias v JOIN m a ON a.tech = v.tech AND a.name = from_metal JOIN m b ON b.tech = v.tech AND b.name = to_metal)
    SELECT tech, layer, round(z, 6) AS z, kind, CAST(row_number() OVER (PARTITION BY tech ORDER BY slot, layer) AS INTEGER) AS position FROM a""")
def f16_conductor_layers(spark, sf_dir):
    return rounded(stack.conductor_layers(*_stack(spark, sf_dir)), "z")


@query(f"WITH {_STACK} SELECT tech, count(*) AS channels FROM (SELECT tech FROM m UNION ALL SELECT tech FROM vias) GROUP BY 1")
def f17_channel_count(spark, sf_dir):
    return stack.channel_count(stack.conductor_layers(*_stack(spark, sf_dir)))


@query(f"WITH {_STACK} SELECT tech, name AS layer, k / 10.0 AS wmin FROM m UNION ALL SELECT tech, via, 0.5 FROM vias")
def f17_min_widths(spark, sf_dir):
    return stack.min_widths(*_stack(spark, sf_dir))


@query(f"""WITH {_STACK} SELECT tech, name AS layer, round(z1 - thickness, 6) AS z0, round(z1, 6) AS z1 FROM m UNION ALL
    SELECT v.tech, via, round(a.z1, 6), round(b.z1 - b.thickness, 6) FROM vias v JOIN m a ON a.tech = v.tech AND a.name = from_metal JOIN m b ON b.tech = v.tech AND b.name = to_metal""")
def f18_z_extents(spark, sf_dir):
    return rounded(stack.z_extents(*_stack(spark, sf_dir)), "z0", "z1")


@query(f"WITH {_STACK}, l AS (SELECT tech, name, row_number() OVER (PARTITION BY tech ORDER BY pos) AS level FROM m) SELECT tech, name AS layer FROM l WHERE level BETWEEN 2 AND 4")
def f15_layer_range(spark, sf_dir):
    layers = stack.metals(_stack(spark, sf_dir)[0]).select("tech", F.col("name").alias("layer"), F.col("level").alias("position"))
    deep = layers.groupBy("tech").agg(F.max("position").alias("n")).where("n >= 4").select("tech")
    few = layers.join(deep, "tech", "left_anti").where("position between 2 and 4").select("tech", "layer")
    return stack.selected(layers.join(deep, "tech", "left_semi"), F.lit("L4"), F.lit("L8")).select("tech", "layer").unionAll(few)


@query(f"""WITH {_STACK}, media AS (SELECT tech, 1 + k / 10.0 AS er, z1 AS z_top, k FROM h),
    p AS (SELECT p_brand AS tech, p_partkey, p_retailprice % 40 + 0.003 AS z FROM part),
    i AS (SELECT p.*, (SELECT arg_min(er, z_top) FROM media m WHERE m.tech = p.tech AND z <= z_top) AS up, (SELECT arg_max(er, z_top) FROM media m WHERE m.tech = p.tech) AS top FROM p)
    SELECT p_partkey, round(coalesce(up, top), 6) AS er FROM i""")
def f38_dielectric(spark, sf_dir):
    rows, _ = _stack(spark, sf_dir)
    media = stack.with_heights(rows).select("tech", (1 + F.col("k") / 10).alias("er"), F.col("z1").alias("z_top"))
    pts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("tech"), "p_partkey", (F.col("p_retailprice") % 40 + 0.003).alias("z"))
    return rounded(stack.dielectric_at(pts, media, 0.0).select("p_partkey", "er"), "er")


@query("""WITH m AS (SELECT p_brand AS tech, CAST(p_size AS DOUBLE) AS z_top, 1 + (p_size * 7 % 13) / 4.0 AS er FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY tech ORDER BY z_top) - 1 AS i, count(*) OVER (PARTITION BY tech) AS n, lead(er) OVER (PARTITION BY tech ORDER BY z_top) AS above FROM m),
    p AS (SELECT p_partkey, p_brand AS tech, p_partkey % 55 + CASE p_partkey % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1e-10 ELSE 0 END AS z FROM part),
    f AS (SELECT p_partkey, z, min(z_top) AS z_top, arg_min(er, z_top) AS er, arg_min(coalesce(above, -1), z_top) AS above FROM p JOIN r ON p.tech = r.tech AND z_top >= z - 1e-9 GROUP BY ALL)
    SELECT p.p_partkey, round(CASE WHEN f.er IS NULL THEN (SELECT arg_max(er, z_top) FROM m WHERE m.tech = p.tech) WHEN abs(f.z_top - f.z) <= 1e-9 AND f.above >= 0 THEN (f.er + f.above) / 2 ELSE f.er END, 6) AS er FROM p LEFT JOIN f ON p.p_partkey = f.p_partkey""")
def f38_interfaces(spark, sf_dir):
    """Permittivity at heights of which two of three lie on an interface, or a tenth of a tolerance beside it."""
    size = F.col("p_size")
    media = table(spark, sf_dir, "part").select(F.col("p_brand").alias("tech"), size.cast("double").alias("z_top"), (1 + size * 7 % 13 / 4).alias("er")).distinct()
    k = F.col("p_partkey")
    pts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("tech"), "p_partkey", (k % 55 + F.when(k % 3 == 0, 0.5).when(k % 3 == 1, 1e-10).otherwise(0.0)).alias("z"))
    return rounded(stack.dielectric_at(pts, media).select("p_partkey", "er"), "er")


@query(f"""WITH {_STACK}, a AS (SELECT tech, name, z1, row_number() OVER (PARTITION BY tech ORDER BY z1, name) AS rank FROM m),
    b AS (SELECT tech, name, z1 + CASE WHEN k % 3 = 0 THEN 0.01 ELSE 0 END AS z1, row_number() OVER (PARTITION BY tech ORDER BY z1 + CASE WHEN k % 3 = 0 THEN 0.01 ELSE 0 END, name) AS rank FROM m)
    SELECT a.tech, CAST(a.rank AS INTEGER) AS rank, a.name AS layer_a, b.name AS layer_b, abs(a.z1 - b.z1) <= 1e-4 AS close, lower(a.name) = lower(b.name) AS same_name FROM a JOIN b ON a.tech = b.tech AND a.rank = b.rank""")
def j11_matched_by_height(spark, sf_dir):
    m = stack.metals(_stack(spark, sf_dir)[0])
    a = m.select("tech", F.col("name").alias("layer"), F.col("z1").alias("z"))
    b = m.select("tech", F.col("name").alias("layer"), (F.col("z1") + F.when(F.col("k") % 3 == 0, 0.01).otherwise(0.0)).alias("z"))
    return stack.matched_by_height(a, b)


@query(f"WITH {_STACK} SELECT tech, name, round(sum(thickness) OVER (PARTITION BY tech ORDER BY pos DESC), 6) AS z1 FROM stack")
def s40_reversed_heights(spark, sf_dir):
    return rounded(stack.reversed_heights(_stack(spark, sf_dir)[0]).select("tech", "name", "z1"), "z1")


@query("""WITH c AS (SELECT c_nationkey AS design, CAST(c_custkey * 3 % 1000 AS DOUBLE) * 0.19 AS x FROM customer),
    d AS (SELECT design, x, x - lag(x) OVER (PARTITION BY design ORDER BY x) AS d FROM (SELECT DISTINCT design, x FROM c)),
    k AS (SELECT design, CAST(round_even(d * 1000, 0) AS BIGINT) AS d, row_number() OVER (PARTITION BY design ORDER BY x) AS k FROM d WHERE d > 0.01),
    g AS (SELECT design, list_reduce(list_prepend(CAST(0 AS BIGINT), list(d)), lambda a, b: gcd(a, b)) AS g FROM k WHERE k <= 20 GROUP BY 1),
    r AS (SELECT s_nationkey AS design, s_suppkey AS seq, s_suppkey * 7 % 50 * 1.4 AS y, CASE WHEN s_nationkey % 2 = 0 THEN 2.1 ELSE 0 END AS step FROM supplier),
    p AS (SELECT design, min(y) AS oy, arg_min(step, seq) AS s, min(abs(gap)) AS d FROM (SELECT *, y - lag(y) OVER (PARTITION BY design ORDER BY seq) AS gap FROM r) GROUP BY 1)
    SELECT o.design, round(ox, 6) AS offset_x, round(coalesce(oy, 0), 6) AS offset_y, round(CASE WHEN s > 0 THEN s ELSE coalesce(d, 2.8) END, 6) AS pitch_y, round(coalesce(g / 1000.0, 0.38), 6) AS pitch_x
    FROM (SELECT design, min(x) AS ox FROM c GROUP BY 1) o LEFT JOIN g ON g.design = o.design LEFT JOIN p ON p.design = o.design""")
def a31_cell_grid(spark, sf_dir):
    comps = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("design"), ((F.col("c_custkey") * 3 % 1000).cast("double") * 0.19).alias("x"))
    step = F.when(F.col("s_nationkey") % 2 == 0, 2.1).otherwise(0.0)
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("design"), F.col("s_suppkey").alias("seq"), (F.col("s_suppkey") * 7 % 50 * 1.4).alias("y"), step.alias("step_y"))
    return rounded(geometry.cell_grid(comps, rows), "offset_x", "offset_y", "pitch_y", "pitch_x")


@query("""WITH w AS (SELECT c_custkey, (c_custkey % 100) / 8.0 AS y0, (c_custkey % 100) / 8.0 + (c_custkey % 7) / 2.0 AS y1 FROM customer),
    s AS (SELECT *, 0.25 + ceil((y0 - 0.25) / 1.5 - 1e-9) * 1.5 AS a, 0.25 + floor((y1 - 0.25) / 1.5 + 1e-9) * 1.5 AS b FROM w)
    SELECT c_custkey, round(CASE WHEN b - a >= 1.5 - 1e-9 THEN a ELSE y0 END, 6) AS y0, round(CASE WHEN b - a >= 1.5 - 1e-9 THEN b ELSE y1 END, 6) AS y1 FROM s""")
def f35_snapped_windows(spark, sf_dir):
    k = F.col("c_custkey")
    y0, y1 = (k % 100) / 8, (k % 100) / 8 + (k % 7) / 2
    a, b = geometry.snapped(y0, y1, F.lit(0.25), F.lit(1.5))
    return table(spark, sf_dir, "customer").select("c_custkey", r6(a).alias("y0"), r6(b).alias("y1"))


# Clouds: the first three components of embeddings, by label.
_CLOUD = "cloud AS (SELECT label, vec_id AS idx, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"


def _cloud(spark, sf_dir, p=""):
    e = table(spark, sf_dir, "embeddings")
    return e.select("label", F.col("vec_id").alias(f"{p}idx"), *[F.col("embedding")[i].cast("double").alias(f"{p}{c}") for i, c in enumerate("xyz")])


@query(f"""WITH {_CLOUD}, d AS (SELECT q.label, q.idx AS q_idx, p.idx AS p_idx, (q.x - p.x) ** 2 + (q.y - p.y) ** 2 + (q.z - p.z) ** 2 AS d2 FROM cloud q JOIN cloud p ON q.label = p.label WHERE q.idx % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY label, q_idx ORDER BY d2, p_idx) AS rank FROM d)
    SELECT label, q_idx, CAST(rank AS INTEGER) AS rank, p_idx, round(d2, 6) AS d2 FROM r WHERE rank <= 4""")
def j18_nearest(spark, sf_dir):
    return rounded(points.nearest(_cloud(spark, sf_dir, "q_").where("q_idx % 20 = 0"), _cloud(spark, sf_dir, "p_"), ["label"], 4), "d2")


@query(f"""WITH {_CLOUD}, d AS (SELECT q.label, q.idx AS q_idx, list_sort(list(p.idx))[1:6] AS ids FROM cloud q JOIN cloud p ON q.label = p.label AND (q.x - p.x) ** 2 + (q.y - p.y) ** 2 + (q.z - p.z) ** 2 <= 0.01 WHERE q.idx % 20 = 0 GROUP BY ALL)
    SELECT label, q_idx, array_to_string(list_resize(ids, 6, ids[1]), ',') AS ids FROM d""")
def j19_ball_query(spark, sf_dir):
    found = points.ball(_cloud(spark, sf_dir, "q_").where("q_idx % 20 = 0"), _cloud(spark, sf_dir, "p_"), ["label"], 0.1, 6)
    return found.select("label", "q_idx", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@query(f"""WITH {_CLOUD}, m AS (SELECT label, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM cloud GROUP BY 1), c AS (SELECT label, idx, x - mx AS x, y - my AS y, z - mz AS z FROM cloud JOIN m USING (label)),
    r AS (SELECT label, max(sqrt(x * x + y * y + z * z)) AS r FROM c GROUP BY 1) SELECT label, idx, round(x / r, 6) AS x, round(y / r, 6) AS y, round(z / r, 6) AS z FROM c JOIN r USING (label)""")
def r18_normalized(spark, sf_dir):
    return rounded(points.normalized(_cloud(spark, sf_dir), ["label"]).select("label", "idx", "x", "y", "z"), "x", "y", "z")


@query(f"WITH {_CLOUD} SELECT label, round(avg(x), 6) AS c_x, round(avg(y), 6) AS c_y, round(avg(z), 6) AS c_z FROM cloud GROUP BY 1")
def a15_cloud_centroids(spark, sf_dir):
    return rounded(points.centroids(_cloud(spark, sf_dir), ["label"]), "c_x", "c_y", "c_z")


@query(f"WITH {_CLOUD} SELECT idx, round(sqrt(x * x + y * y + z * z), 6) AS r, round(atan(sqrt(x * x + y * y) / (z + 1e-15)), 6) AS theta, round(atan(y / (x + 1e-15)), 6) AS phi FROM cloud")
def r16_polar(spark, sf_dir):
    return rounded(points.polar(_cloud(spark, sf_dir)).select("idx", "r", "theta", "phi"), "r", "theta", "phi")


@query(f"WITH {_CLOUD} SELECT label, idx, -x AS x, y, z FROM cloud")
def r17_mirrored(spark, sf_dir):
    return points.mirrored(_cloud(spark, sf_dir), "x").select("label", "idx", "x", "y", "z")


def _interval(c, n):
    """Interval of a coordinate between ``n`` edges from -0.2 to 0.2, in SQL."""
    return f"CASE WHEN {c} < -0.2 OR {c} > 0.2 THEN -1 ELSE CAST(least(floor(({c} - -0.2) / (0.2 - -0.2) * {n - 1}), {n - 2}) AS INTEGER) END AS g{c}"


@query(f"WITH {_CLOUD} SELECT idx, {_interval('x', 8)}, {_interval('y', 8)}, {_interval('z', 8)} FROM cloud")
def r15_grid_cells(spark, sf_dir):
    return points.grid_cells(_cloud(spark, sf_dir), {c: (-0.2, 0.2) for c in "xyz"}, 8).select("idx", "gx", "gy", "gz")


@query(f"""WITH RECURSIVE {_CLOUD}, p AS (SELECT label, idx, {_interval('x', 7)}, {_interval('y', 7)}, {_interval('z', 7)} FROM cloud),
    held AS (SELECT label, gx, gy, gz, count(*) AS points, bool_or(idx % 50 = 0) AS seed FROM p WHERE least(gx, gy, gz) >= 0 GROUP BY ALL),
    grid AS (SELECT label, a.i AS gx, b.i AS gy, c.i AS gz FROM (SELECT DISTINCT label FROM held), range(7) a(i), range(7) b(i), range(7) c(i)),
    far AS (SELECT g.label, g.gx, g.gy, g.gz, min(abs(g.gx - s.gx) + abs(g.gy - s.gy) + abs(g.gz - s.gz)) AS far FROM grid g LEFT JOIN held s ON s.label = g.label AND s.seed GROUP BY ALL),
    cells AS (SELECT far.*, coalesce(points, 0) AS points FROM far LEFT JOIN held USING (label, gx, gy, gz)),
    walk AS (SELECT label, gx, gy, gz, points, 0 AS step, CAST(0.9 AS DOUBLE) AS density FROM cells WHERE far = 0
      UNION ALL SELECT label, gx, gy, gz, points, step, least * CASE WHEN through THEN 0.8 ELSE 1.0 END FROM (
        SELECT c.label, c.gx, c.gy, c.gz, c.points, w.step + 1 AS step, min(w.density) AS least, bool_or(w.points > 0) AS through FROM walk w JOIN cells c
          ON c.label = w.label AND c.far = w.step + 1 AND abs(c.gx - w.gx) + abs(c.gy - w.gy) + abs(c.gz - w.gz) = 1 GROUP BY c.label, c.gx, c.gy, c.gz, c.points, w.step + 1))
    SELECT label, CAST(gx AS INTEGER) AS gx, CAST(gy AS INTEGER) AS gy, CAST(gz AS INTEGER) AS gz, CAST(points AS BIGINT) AS points, round(coalesce(density, 0), 9) AS density FROM cells LEFT JOIN (SELECT label, gx, gy, gz, density FROM walk) USING (label, gx, gy, gz)""")
def r15_spread_density(spark, sf_dir):
    """The density of every cell of each label's grid, spread from cells of seeds through cells with points and empty ones."""
    cells = points.grid_cells(_cloud(spark, sf_dir), {c: (-0.2, 0.2) for c in "xyz"}, 7)
    out = points.spread_density(cells.withColumn("is_seed", F.col("idx") % 50 == 0), "label", 7, decay=0.8, start=0.9)
    return out.withColumn("density", F.round("density", 9))


_FARTHEST = f"""WITH RECURSIVE {_CLOUD}, walk(label, step, chosen) AS (
      SELECT label, 0, [arg_min(struct_pack(i := idx, x := x, y := y, z := z), idx)] FROM cloud GROUP BY label
      UNION ALL SELECT label, step + 1, list_append(chosen, next) FROM (
        SELECT w.label, w.step, w.chosen, arg_min(struct_pack(i := c.idx, x := c.x, y := c.y, z := c.z), struct_pack(d := -list_min(list_transform(w.chosen, lambda p: (c.x - p.x) ** 2 + (c.y - p.y) ** 2 + (c.z - p.z) ** 2)), i := c.idx)) AS next
        FROM walk w JOIN cloud c ON c.label = w.label WHERE w.step < 15 GROUP BY ALL))
    SELECT label, CAST(k - 1 AS BIGINT) AS "order", chosen[k].i AS p_idx FROM walk, range(1, 17) r(k) WHERE step = least(15, (SELECT max(step) FROM walk)) AND k <= len(chosen)"""


@query(_FARTHEST)
def r19_farthest_points(spark, sf_dir):
    return points.farthest(_cloud(spark, sf_dir).withColumnRenamed("idx", "p_idx"), "label", 16, start=0)


@query(_FARTHEST)
def r19_farthest_in_rounds(spark, sf_dir):
    """The same, by the way of large clouds: a partial argmax a round over all clouds."""
    return points.farthest(_cloud(spark, sf_dir).withColumnRenamed("idx", "p_idx"), "label", 16, start=0, grouped=0)


@query(f"WITH {_CLOUD}, c AS (SELECT label, count(*) AS m FROM cloud GROUP BY 1) SELECT label, CAST(200 AS BIGINT) AS n, least(m, 200) AS points, CASE WHEN m >= 200 THEN 1 ELSE 200 // m END AS least, CASE WHEN m >= 200 THEN 1 ELSE CAST(ceil(200 / m) AS BIGINT) END AS most FROM c")
def r14_resampled(spark, sf_dir):
    """Points in all, different ones, and how often the least and most frequent come."""
    found = points.resampled(_cloud(spark, sf_dir).withColumnRenamed("idx", "p_idx"), ["label"], 200, 7)
    each = found.groupBy("label", "p_idx").agg(F.count("*").alias("k"))
    return each.groupBy("label").agg(F.sum("k").alias("n"), F.count("*").alias("points"), F.min("k").alias("least"), F.max("k").alias("most"))


# Tilted blocks in windows of suppliers and parts: two slanted edges and one upright.
_TILTED = """b AS (SELECT p_partkey % 50 AS window_id, p_partkey AS block, p_brand AS net, p_partkey % 3 AS medium, 1.0 + p_size % 4 AS ax, (p_size % 2) * 0.5 AS ay, (p_partkey % 4) * -0.3 AS bx, 1.0 + p_partkey % 2 AS by_ FROM part),
    c AS (SELECT *, sqrt(ax * ax + ay * ay) AS u, sqrt(bx * bx + by_ * by_) AS v FROM b), a AS (SELECT *, 2 * (u * v + u * 0.5 + v * 0.5) AS area FROM c)"""


def _tilted_blocks(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    v = lambda *xs: F.array(*[(x if not isinstance(x, (int, float)) else F.lit(x)).cast("double") for x in xs])
    frame = points.block_frame(v(k % 11, k % 13, k % 3 * 4 + 1), v(1 + s % 4, s % 2 * 0.5, 0), v(k % 4 * -0.3, 1 + k % 2, 0), v(0, 0, 0.5))
    return table(spark, sf_dir, "part").select((k % 50).alias("window_id"), k.alias("block"), F.col("p_brand").alias("net"), F.lit("t").alias("tech"), frame.alias("frame"))


@query()
def r12_surface_points(spark, sf_dir):
    return points.surface_points(_tilted_blocks(spark, sf_dir), ["window_id"], 1024, 11)


@query(f"""WITH {_TILTED}, n AS (SELECT window_id, block, greatest(1, CAST(floor(1024 * area / sum(area) OVER (PARTITION BY window_id)) AS BIGINT)) AS n FROM a)
    SELECT window_id, block, n AS points, n AS on_faces FROM n""")
def r12_surface_counts(spark, sf_dir):
    """Points per block, and how many lie on exactly the face that their normal names: their shares of the three edges say so."""
    blocks = _tilted_blocks(spark, sf_dir)
    rows = points.surface_points(blocks, ["window_id"], 1024, 11).join(blocks.select("window_id", "block", "frame"), ["window_id", "block"])
    at = lambda v, i: F.col(f"frame.{v}")[i]
    px, py, pz = (F.col(c) - at("base", i) for i, c in enumerate("xyz"))
    # The first two edges lie level, so their shares solve a system of two.
    det = at("v1", 0) * at("v2", 1) - at("v1", 1) * at("v2", 0)
    shares = ((px * at("v2", 1) - py * at("v2", 0)) / det, (py * at("v1", 0) - px * at("v1", 1)) / det, pz / at("h", 2))
    ok = F.lit(True)
    for share, n in zip(shares, ("nx", "ny", "nz"), strict=True):
        ok = ok & F.when(F.col(n) == 0, share.between(-1e-9, 1 + 1e-9)).otherwise(F.abs(share - F.when(F.col(n) > 0, 1.0).otherwise(0.0)) < 1e-9)
    one = F.abs("nx") + F.abs("ny") + F.abs("nz") == 1
    return rows.groupBy("window_id", "block").agg(F.count("*").alias("points"), F.count_if(ok & one).alias("on_faces"))


@query(f"""WITH {_TILTED}, n AS (SELECT *, greatest(1, CAST(floor(4096 * area / sum(area) OVER (PARTITION BY window_id)) AS BIGINT)) AS n FROM a), t AS (SELECT *, sum(n) OVER (PARTITION BY window_id) AS total FROM n)
    SELECT window_id, CAST(least(4096, max(total)) AS BIGINT) AS points, CAST(least(4096, max(total)) AS BIGINT) AS different, bool_and(true) AS right_ FROM t GROUP BY 1""")
def r12_surface_cloud(spark, sf_dir):
    """Points of each window's cloud, all different, with the permittivity of their block's medium and the flux of its net."""
    blocks = _tilted_blocks(spark, sf_dir)
    media = spark.createDataFrame([("t", 2.0, 3.0), ("t", 3.5, 7.0), ("t", 5.0, 20.0)], "tech string, er double, z_top double")
    masters = blocks.groupBy("window_id").agg(F.min("net").alias("pos"), F.max("net").alias("neg"))
    cloud = points.surface_cloud(blocks, media, masters, ["window_id"], 4096, 5).join(masters, "window_id")
    er = F.element_at(F.array(*map(F.lit, (2.0, 3.5, 5.0))), (F.col("block") % 3 + 1).cast("int"))
    flux = F.when(F.col("net") == F.col("pos"), 1.0).when(F.col("net") == F.col("neg"), -1.0).otherwise(0.0)
    good = (F.col("er") == er) & (F.col("flux") == flux)
    return cloud.groupBy("window_id").agg(F.count("*").alias("points"), F.count_distinct("block", "k").alias("different"), F.bool_and(good).alias("right_"))


@query(f"""WITH {_TILTED}, n AS (SELECT *, greatest(1, CAST(floor(4096 * area / sum(area) OVER (PARTITION BY window_id)) AS BIGINT)) AS n FROM a)
    SELECT window_id, block, n, 2.0 + 1.5 * medium AS er, CASE WHEN net = min(net) OVER (PARTITION BY window_id) THEN 1.0 WHEN net = max(net) OVER (PARTITION BY window_id) THEN -1.0 ELSE 0.0 END AS flux FROM n""")
def r12_surface_flux(spark, sf_dir):
    """Points, permittivity and flux of each block of a cloud of which nothing is drawn away."""
    blocks = _tilted_blocks(spark, sf_dir)
    media = spark.createDataFrame([("t", 2.0, 3.0), ("t", 3.5, 7.0), ("t", 5.0, 20.0)], "tech string, er double, z_top double")
    masters = blocks.groupBy("window_id").agg(F.min("net").alias("pos"), F.max("net").alias("neg"))
    rows = points.surface_points(blocks, ["window_id"], 4096, 5).join(blocks.select("window_id", "block", "tech"), ["window_id", "block"])
    cloud = points.charged(rows, media, masters, ["window_id"])
    return cloud.groupBy("window_id", "block").agg(F.count("*").alias("n"), F.avg("er").alias("er"), F.avg("flux").alias("flux"))
