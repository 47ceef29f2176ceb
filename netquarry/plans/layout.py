"""Queries over layouts, window lists and work that is left."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import components, compare, geometry, layout, ranks, raster, samples, spatial, windows
from ..sources import catalog
from . import base
from .base import RECTS, query, r6, rounded, table
from .raster import _TILES, _tiles


@query(f"""WITH {RECTS} SELECT window_id, layer, layer - 1 AS channel, cid, CAST(dense_rank() OVER (PARTITION BY window_id ORDER BY cid) AS INTEGER) AS conductor, count(*) AS n FROM px
    WHERE layer >= 0 AND cid > 0 AND px0 < px1 AND py0 < py1 GROUP BY window_id, layer, cid""")
def r01_raster_prepare(spark, sf_dir):
    rows = raster.active(base.rects(spark, sf_dir)).groupBy("window_id", "layer", "cid").agg(F.count("*").alias("n"))
    ranked = raster.dense_ids(rows.withColumnRenamed("cid", "name"), "name", ["window_id"])
    return ranked.select("window_id", "layer", (F.col("layer") - 1).alias("channel"), F.col("name").alias("cid"), F.col("cid").alias("conductor"), "n")


@query(f"""WITH {RECTS}, {_TILES} SELECT tile, layer, cid, round(greatest(x0, w_x0) - w_x0, 6) AS x0, round(greatest(y0, w_y0) - w_y0, 6) AS y0, round(least(x1, w_x1) - w_x0, 6) AS x1, round(least(y1, w_y1) - w_y0, 6) AS y1
    FROM rects JOIN tiles ON x1 > w_x0 AND x0 < w_x1 AND y1 > w_y0 AND y0 < w_y1 WHERE layer IN (1, 2)""")
def r21_window_clip(spark, sf_dir):
    shapes = base.rects(spark, sf_dir).select("layer", "cid", "x0", "y0", "x1", "y1")
    out = layout.window_clip(shapes, _tiles(spark), 10.0, (1, 2))
    return rounded(out.select("tile", "layer", "cid", "x0", "y0", "x1", "y1"), "x0", "y0", "x1", "y1")


@query(f"WITH {RECTS} SELECT layer, count(*) AS n FROM rects WHERE layer > 3 OR least(x1 - x0, y1 - y0) >= 0.8 * layer * 2.01 - 1e-9 GROUP BY layer")
def r24_width_filter(spark, sf_dir):
    widths = spark.createDataFrame([(i, i * 2.01) for i in (1, 2, 3)], "layer int, wmin double")
    return layout.wide_enough(base.rects(spark, sf_dir), widths).groupBy("layer").agg(F.count("*").alias("n"))


@query(f"""WITH {RECTS}, g AS (SELECT layer, x0 - 0.25 AS ax0, y0 - 0.25 AS ay0, x1 + 0.25 AS ax1, y1 + 0.25 AS ay1, greatest(x0 - 0.75, 2) AS ox0, greatest(y0 - 0.75, 2) AS oy0, least(x1 + 0.75, 60) AS ox1, least(y1 + 0.75, 60) AS oy1 FROM rects WHERE layer = 1),
    e AS (SELECT greatest(ax0, 2) AS x0, greatest(ay0, 2) AS y0, least(ax1, 60) AS x1, least(ay1, 60) AS y1 FROM g), o AS (SELECT *, greatest(x0 - 0.5, 2) AS ox0, greatest(y0 - 0.5, 2) AS oy0, least(x1 + 0.5, 60) AS ox1, least(y1 + 0.5, 60) AS oy1 FROM e),
    p AS (SELECT ox0 AS x0, oy0 AS y0, ox1 AS x1, y0 AS y1 FROM o UNION ALL SELECT ox0, y1, ox1, oy1 FROM o UNION ALL SELECT ox0, y0, x0, y1 FROM o UNION ALL SELECT x1, y0, ox1, y1 FROM o)
    SELECT count(*) AS shells, round(sum((x1 - x0) * (y1 - y0)), 4) AS area FROM p WHERE x0 < x1 AND y0 < y1""")
def r25_conformal_shells(spark, sf_dir):
    shapes = base.rects(spark, sf_dir)
    profile = spark.createDataFrame([(1, -0.25, 0.5, 4.2)], "layer int, etch double, thickness double, er double")
    bounds = shapes.select("window_id").distinct().withColumns({f"b_{c}": F.lit(v) for c, v in zip(layout.COLS, (2.0, 2.0, 60.0, 60.0), strict=True)})
    out = layout.conformal_shells(shapes, profile, bounds)
    return out.agg(F.count("*").alias("shells"), F.round(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))), 4).alias("area"))


@query("""WITH p AS (SELECT p_brand AS cell, concat('P', p_size % 3) AS pin, p_partkey % 4 + 0.0 AS x0, p_partkey AS k FROM part),
    n AS (SELECT c_custkey AS component, concat('P', c_custkey % 3) AS pin, concat('net', max(c_custkey // 10)) AS net FROM customer GROUP BY 1, 2),
    c AS (SELECT c_custkey AS component, 'Brand#' || (c_custkey % 5 + 1) || (c_nationkey % 5 + 1) AS cell, CAST(c_custkey AS DOUBLE) AS x FROM customer)
    SELECT component, pin, coalesce(net, concat('__lef__/', component, '/', pin)) AS conductor, net IS NULL AS synthetic, round(x + x0, 6) AS x0 FROM c JOIN p USING (cell) LEFT JOIN n USING (component, pin)""")
def j12_bound_pins(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    part, cust = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    at = (k % 4).cast("double")
    pins = part.select(F.col("p_brand").alias("macro"), F.concat(F.lit("P"), s % 3).alias("pin"), F.lit("m1").alias("layer"), at.alias("x0"), F.lit(0.0).alias("y0"), (at + 1).alias("x1"), F.lit(1.0).alias("y1"))
    c = F.col("c_custkey")
    comps = cust.select(c.cast("string").alias("component"), F.concat(F.lit("Brand#"), c % 5 + 1, F.col("c_nationkey") % 5 + 1).alias("cell"), c.cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit("N").alias("orient"), F.lit(8.0).alias("w"), F.lit(4.0).alias("h"))
    nets = cust.select(c.cast("string").alias("component"), F.concat(F.lit("P"), c % 3).alias("pin"), F.concat(F.lit("net"), F.expr("c_custkey div 10")).alias("net"), F.lit(1).alias("seq"))
    out = layout.bound_pins(comps, pins, nets)
    return out.select(F.col("component").cast("long").alias("component"), "pin", "conductor", "synthetic", r6("x0").alias("x0"))


@query("""WITH p AS (SELECT p_partkey // 10 AS m, p_partkey AS k, p_partkey % 4 + 0.5 AS x0, p_size % 3 + 0.25 AS y0, p_partkey % 4 + 1.5 AS x1, p_size % 3 + 2.25 AS y1 FROM part),
    c AS (SELECT c_custkey AS component, c_custkey // 10 AS m, CAST(c_custkey AS DOUBLE) AS px, CAST(c_nationkey AS DOUBLE) AS py, ['N', 'S', 'E', 'W', 'FN', 'FS', 'FE', 'FW'][c_custkey % 8 + 1] AS o FROM customer),
    r AS (SELECT component, k, o, px, py, unnest([x0, x1]) * CASE WHEN o[1] = 'F' THEN -1 ELSE 1 END AS x, unnest([y0, y1]) AS y, CASE WHEN o[1] = 'F' THEN o[2] ELSE o END AS turn, o[1] = 'F' AS f FROM c JOIN p USING (m)),
    t AS (SELECT component, k, px, py, CASE turn WHEN 'N' THEN x WHEN 'S' THEN -x WHEN 'E' THEN y ELSE -y END AS x, CASE turn WHEN 'N' THEN y WHEN 'S' THEN -y WHEN 'E' THEN -x ELSE x END AS y,
        least(0, CASE turn WHEN 'N' THEN 1 WHEN 'S' THEN -1 ELSE 0 END * CASE WHEN f THEN -8 ELSE 8 END) + CASE WHEN turn = 'W' THEN -5 ELSE 0 END AS low_x,
        least(0, CASE turn WHEN 'E' THEN -1 WHEN 'W' THEN 1 ELSE 0 END * CASE WHEN f THEN -8 ELSE 8 END) + CASE WHEN turn = 'S' THEN -5 ELSE 0 END AS low_y FROM r)
    SELECT component, k, round(min(px + x - low_x), 6) AS x0, round(min(py + y - low_y), 6) AS y0, round(max(px + x - low_x), 6) AS x1, round(max(py + y - low_y), 6) AS y1 FROM t GROUP BY component, k""")
def j12_oriented_pins(spark, sf_dir):
    """Pins of macros of 8 by 5 placed in all eight orientations, least corner at the placement."""
    k = F.col("p_partkey")
    pins = table(spark, sf_dir, "part").select(F.expr("p_partkey div 10").cast("string").alias("macro"), k.cast("string").alias("pin"), F.lit("m1").alias("layer"), (k % 4 + 0.5).alias("x0"), (F.col("p_size") % 3 + 0.25).alias("y0"), (k % 4 + 1.5).alias("x1"), (F.col("p_size") % 3 + 2.25).alias("y1"))
    c = F.col("c_custkey")
    orient = F.element_at(F.array(*map(F.lit, ("N", "S", "E", "W", "FN", "FS", "FE", "FW"))), (c % 8 + 1).cast("int"))
    comps = table(spark, sf_dir, "customer").select(c.cast("string").alias("component"), F.expr("c_custkey div 10").cast("string").alias("cell"), c.cast("double").alias("x"), F.col("c_nationkey").cast("double").alias("y"), orient.alias("orient"), F.lit(8.0).alias("w"), F.lit(5.0).alias("h"))
    nets = comps.select("component", F.lit("none").alias("pin"), F.lit("n").alias("net"), F.lit(0).alias("seq"))
    out = layout.bound_pins(comps, pins, nets)
    return out.select(F.col("component").cast("long").alias("component"), F.col("pin").cast("long").alias("k"), *[r6(x).alias(x) for x in layout.COLS])


@query(f"""WITH {_TILES}, p AS (SELECT o_orderkey AS probe, (o_orderkey % 160) / 2.0 AS px, (o_custkey % 160) / 2.0 AS py FROM orders)
    SELECT probe, tile FROM p JOIN tiles ON px BETWEEN w_x0 AND w_x1 AND py BETWEEN w_y0 AND w_y1""")
def j14_point_probe(spark, sf_dir):
    half = lambda c: (F.col(c) % 160) / 2
    probes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("probe"), half("o_orderkey").alias("px"), half("o_custkey").alias("py"))
    return spatial.point_join(probes, _tiles(spark), "px", "py", "w_", 10.0).select("probe", "tile")


@query("""WITH e AS (SELECT o_orderkey AS net, concat('c', o_custkey % 50) AS component FROM orders UNION ALL SELECT o_orderkey, 'PIN' FROM orders WHERE o_orderkey % 7 = 0),
    i AS (SELECT DISTINCT c_nationkey % 5 AS window_id, concat('c', c_custkey % 50) AS component FROM customer)
    SELECT DISTINCT window_id, net FROM e JOIN i USING (component) UNION SELECT DISTINCT w.window_id, net FROM e, (SELECT DISTINCT window_id FROM i) w WHERE e.component = 'PIN'""")
def j08_nets_of_components(spark, sf_dir):
    pin = F.when(F.col("o_orderkey") % 7 == 0, F.array(F.lit("PIN"))).otherwise(F.array().cast("array<string>"))
    nets = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("net"), F.concat(F.array(F.concat(F.lit("c"), F.col("o_custkey") % 50)), pin).alias("connections"))
    inc = table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 5).alias("window_id"), F.concat(F.lit("c"), F.col("c_custkey") % 50).alias("component"))
    return spatial.nets_of_components(nets, inc)


@query("""SELECT o_orderkey, CASE WHEN count(*) OVER w > 1 THEN concat('net', o_custkey, '.', row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)) ELSE concat('net', o_custkey) END AS piece_name FROM orders WINDOW w AS (PARTITION BY o_custkey)""")
def w06_suffixed(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("net"), F.col("o_custkey")).alias("net"))
    return spatial.suffixed(rows, [], "net", "o_orderkey").select("o_orderkey", "piece_name")


@query("""WITH s AS (SELECT DISTINCT concat('n', o_custkey % 40) AS base, o_orderkey % 3 AS cluster FROM orders)
    SELECT base, cluster, CASE WHEN count(*) OVER (PARTITION BY base) > 1 THEN concat(base, '.', row_number() OVER (PARTITION BY base ORDER BY cluster)) ELSE base END AS net FROM s""")
def r23_regrouped_nets(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 40
    shapes = table(spark, sf_dir, "orders").select(F.concat(F.lit("n"), c, F.lit("."), k).alias("name"), (k % 3).alias("cluster"))
    return components.regrouped_nets(shapes).select("base", "cluster", "net").distinct()


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def j17_unsolved(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return windows.unsolved(table(spark, sf_dir, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("""SELECT name, CAST(row_number() OVER (ORDER BY s, position) - 1 AS INTEGER) AS position FROM (SELECT name, s, position, row_number() OVER (PARTITION BY name ORDER BY s, position) AS k FROM
    (SELECT n_name AS name, 0 AS s, n_nationkey AS position FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_name, 1, 25 - n_nationkey FROM nation)) WHERE k = 1""")
def k13_merged_windows(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    old = n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("position"))
    return windows.merged(old, n.select(F.col("n_name").alias("name"), (25 - F.col("n_nationkey")).alias("position")))


@query("""SELECT design, size, count(*) AS n FROM (SELECT c_nationkey AS design, CASE c_custkey % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'medium' ELSE 'large' END AS size,
    row_number() OVER (PARTITION BY c_nationkey, c_custkey % 3 ORDER BY c_custkey) AS k FROM customer) WHERE k <= CASE size WHEN 'large' THEN 1 ELSE 4 END * 4 GROUP BY ALL""")
def t06_capped_windows(spark, sf_dir):
    c = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("design"), F.when(c % 3 == 0, "small").when(c % 3 == 1, "medium").otherwise("large").alias("size"), c.alias("tile_order"), F.lit(0).alias("spot"))
    return windows.capped(rows, 2).groupBy("design", "size").agg(F.count("*").alias("n"))


@query("SELECT concat('W', o_orderkey) AS window_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) ORDER BY o_orderkey LIMIT 20")
def t07_labelled_windows(spark, sf_dir):
    name = lambda d, c: d.select(F.concat(F.lit("W"), F.col(c)).alias("window_id"))
    return windows.labelled(name(table(spark, sf_dir, "orders"), "o_orderkey"), name(table(spark, sf_dir, "lineitem"), "l_orderkey"), 20)


@query("""SELECT l_shipmode_like AS kind, count(*) AS n FROM (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'total' ELSE 'coupling' END AS l_shipmode_like, l_extendedprice * 1e-20 AS cap, (l_quantity + l_suppkey % 10) / nullif(l_partkey % 90, 0) AS share FROM lineitem)
    WHERE cap >= 1e-17 AND (l_shipmode_like = 'total' OR share > 0.4) GROUP BY 1""".replace("l_shipmode_like", "kind_of"))
def f28_clean_annotations(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    rows = li.select((F.col("l_extendedprice") * 1e-20).alias("cap"), F.col("l_quantity").alias("electrode1_point_num"), (F.col("l_suppkey") % 10).alias("electrode2_point_num"), (F.col("l_partkey") % 90).alias("point_num"), F.when(F.col("l_linenumber") % 2 == 0, "total").otherwise("coupling").alias("kind"))
    parts = [catalog.clean_annotations(rows.where(F.col("kind") == k), k) for k in ("total", "coupling")]
    return parts[0].unionAll(parts[1]).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT event_id, format('{}:{:02d}:{:02d}', s // 3600, s % 3600 // 60, s % 60) AS text FROM (SELECT event_id, CAST(floor(value * 100) AS BIGINT) AS s FROM events)")
def f31_durations(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalars.duration(F.col("value") * 100).alias("text"))


@query("SELECT p_partkey, CAST(least(floor((p_partkey % (10 + p_size)) * (1 + p_partkey % 90) / CAST(10 + p_size AS DOUBLE)), p_partkey % 90) AS INTEGER) AS source FROM part")
def r09_resize_index(spark, sf_dir):
    """Source rows of images of 1 to 90 rows resized to 11 and more."""
    size = F.lit(10) + F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", scalars.resize_index(F.col("p_partkey") % size, F.lit(1) + F.col("p_partkey") % 90, size).alias("source"))


@query("""WITH b AS (SELECT p_partkey, p_size AS s, p_partkey % 7 AS t, p_retailprice / 500 AS r FROM part)
    SELECT p_partkey, round(abs(s * 2.0 - t * t) * (3 + r), 4) AS volume, round(1 + (s + t) / 2.0, 4) AS cx, round(r + 1 + t / 2.0, 4) AS cy, round(-1 + (3 + r) / 2.0, 4) AS cz,
      CAST(1 AS DOUBLE) AS x0, CAST(1 + s + t AS DOUBLE) AS x1, round(r, 4) AS y0, round(r + 2 + t, 4) AS y1, CAST(-1 AS DOUBLE) AS z0, round(2 + r, 4) AS z1 FROM b""")
def f01_block_geometry(spark, sf_dir):
    """Volume, centre and bounds of cuboids whose edges are not all along the axes."""
    v = lambda *xs: F.array(*[x.cast("double") if not isinstance(x, (int, float)) else F.lit(float(x)) for x in xs])
    s, t, r = F.col("p_size"), F.col("p_partkey") % 7, F.col("p_retailprice") / 500
    base_, v1, v2, h = v(1, r, -1), v(s, t, 0), v(t, 2, 0), v(0, 0, 3 + r)
    # The edges span s * 2 - t * t; blocks that are mirrored by it have the same volume.
    lo, hi = geometry.box3(base_, v1, v2, h)
    c = geometry.center3(base_, v1, v2, h)
    rows = table(spark, sf_dir, "part").select("p_partkey", geometry.volume3(v1, v2, h).alias("volume"), *[c[i].alias(f"c{a}") for i, a in enumerate("xyz")], *[e[i].alias(f"{a}{k}") for k, e in enumerate((lo, hi)) for i, a in enumerate("xyz")])
    return rows.select("p_partkey", *[F.round(x, 4).alias(x) for x in rows.columns[1:]])


@query("""WITH d AS (SELECT o_custkey AS case_id, o_totalprice AS gap, o_orderkey AS k FROM orders) SELECT k, gap FROM d ORDER BY gap DESC, k LIMIT 5""")
def t02_top_discrepancies(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("gap"))
    return compare.worst(rows, 5, "k", column="gap")


@query("""SELECT CAST(conv_id AS VARCHAR) AS window_id, position, samples FROM (SELECT conv_id, CAST(row_number() OVER (ORDER BY CAST(conv_id AS VARCHAR) DESC) - 1 AS INTEGER) AS position FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 7 = 1))
    JOIN (SELECT conv_id, count(*) AS samples FROM conversations GROUP BY 1) USING (conv_id)""")
def l08_window_subset(spark, sf_dir):
    """A subset of windows in an order of the caller's, with what comes along."""
    from ..serve import WindowSamples

    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("window_id"), F.col("turn").alias("sample"))
    index = turns.select("window_id", F.lit(0).alias("position")).distinct()
    wanted = ranks.numbered(index.where(F.col("window_id").cast("long") % 7 == 1).select("window_id"), [F.desc("window_id")], "position").withColumn("position", F.col("position").cast("int"))
    kept = WindowSamples(turns, index, turns, turns).subset(wanted)
    return kept.index.join(kept.samples.groupBy("window_id").agg(F.count("*").alias("samples")), "window_id").select("window_id", "position", "samples")


@query("""SELECT CAST(conv_id AS VARCHAR) AS window_id, CAST(k // 4 AS INTEGER) AS shard_id, CAST(k % 4 AS INTEGER) AS shard_offset FROM (SELECT conv_id, row_number() OVER (ORDER BY conv_id % 2, conv_id) - 1 AS k FROM (SELECT DISTINCT conv_id FROM conversations))""")
def k08_arrival_shards(spark, sf_dir):
    """Two batches of windows, each in order of arrival; the second goes on in the first one's last shard."""
    from ..sinks import shards
    from .formats import out_folder

    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("window_id"), "conv_id", F.lit(0).alias("layer"), F.lit(0).alias("y"), F.col("turn").alias("x"), F.lit(1.0).alias("density"), (F.col("turn") + 1).cast("long").alias("cid"))
    windows = turns.select("window_id", "conv_id", F.array(F.lit("M1")).alias("layer_names"), F.array(F.lit(True)).alias("layer_has_density"), F.lit(64).alias("height"), F.lit(64).alias("width")).distinct()
    folder = out_folder(spark, "shards")
    for batch in (0, 1):
        here = F.col("conv_id") % 2 == batch
        index = shards.append(turns.where(here).drop("conv_id"), windows.where(here), folder, 4, arrival="conv_id")
    return index.select("window_id", "shard_id", "shard_offset")
