"""Queries over rectangles, pixels and space."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import components, geometry, raster, spatial
from . import base
from .base import RECTS, query, rounded, table


@query(f"WITH {RECTS} SELECT * FROM pixels")
def r02_paint(spark, sf_dir):
    return base.painted(spark, sf_dir)


@query(f"""WITH {RECTS}, covered AS (SELECT DISTINCT window_id, layer, y, unnest(range(px0, px1)) AS x FROM (SELECT *, unnest(range(py0, py1)) AS y FROM px WHERE px0 < px1 AND py0 < py1))
    SELECT c.window_id, c.layer, CAST(c.y AS INTEGER) AS y, CAST(c.x AS INTEGER) AS x, coalesce(cid, 0) AS cid, CAST(1 AS DOUBLE) AS density
    FROM covered c LEFT JOIN pixels p ON p.window_id = c.window_id AND p.layer = c.layer AND p.y = c.y AND p.x = c.x""")
def r05_legacy_density(spark, sf_dir):
    return raster.legacy_density(base.rects(spark, sf_dir))


@query(f"WITH {RECTS} SELECT window_id, cid, round(avg(layer), 6) AS c_layer, round(avg(y), 6) AS c_y, round(avg(x), 6) AS c_x FROM pixels GROUP BY ALL")
def a14_centroids(spark, sf_dir):
    return rounded(raster.centroids(base.painted(spark, sf_dir), ["window_id"]), "c_layer", "c_y", "c_x")


@query(f"""WITH {RECTS} SELECT window_id, cid, n, CAST(row_number() OVER (PARTITION BY window_id ORDER BY cid) AS INTEGER) AS local_id FROM (SELECT window_id, cid, count(*) AS n FROM pixels GROUP BY ALL)
    UNION ALL SELECT DISTINCT window_id, 0, 1, 0 FROM pixels""")
def a18_pixel_counts(spark, sf_dir):
    return raster.pixel_counts(base.painted(spark, sf_dir), ["window_id"])


@query(f"WITH {RECTS} SELECT window_id, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM pixels GROUP BY 1")
def a19_content_box(spark, sf_dir):
    return raster.content_box(base.painted(spark, sf_dir), ["window_id"])


@query(f"""WITH {RECTS}, b AS (SELECT window_id, min(x0) AS a, min(y0) AS b, max(x1) AS c, max(y1) AS d FROM rects GROUP BY 1)
    SELECT window_id, round((a + c) / 2 - greatest(c - a, d - b) / 2, 6) AS x0, round((b + d) / 2 - greatest(c - a, d - b) / 2, 6) AS y0,
    round((a + c) / 2 + greatest(c - a, d - b) / 2, 6) AS x1, round((b + d) / 2 + greatest(c - a, d - b) / 2, 6) AS y1 FROM b""")
def a20_square_bounds(spark, sf_dir):
    return rounded(raster.square_bounds(base.rects(spark, sf_dir), ["window_id"]), "x0", "y0", "x1", "y1")


@query(f"WITH {RECTS} SELECT DISTINCT window_id, cid FROM pixels WHERE cid > 0")
def a25_present_ids(spark, sf_dir):
    return base.painted(spark, sf_dir).where("cid > 0").select("window_id", "cid").distinct()


@query(f"""WITH {RECTS}, e AS (SELECT i, CAST(floor(i * 64.0 / 10) AS INTEGER) AS lo, CAST(floor((i + 1) * 64.0 / 10) AS INTEGER) AS hi FROM range(10) t(i))
    SELECT window_id, layer, CAST(a.i AS INTEGER) AS ty, CAST(b.i AS INTEGER) AS tx, round(count(*) / CAST((a.hi - a.lo) * (b.hi - b.lo) AS DOUBLE), 6) AS density
    FROM pixels JOIN e a ON y >= a.lo AND y < a.hi JOIN e b ON x >= b.lo AND x < b.hi GROUP BY window_id, layer, a.i, b.i, a.hi, a.lo, b.hi, b.lo""")
def a26_coarse_density(spark, sf_dir):
    return rounded(raster.coarse(base.painted(spark, sf_dir).withColumn("density", F.lit(1.0)), ["window_id"], 64, 10), "density")


@query(f"""WITH {RECTS}, p AS (SELECT window_id, cid, layer, CAST(trunc(avg(y)) AS INTEGER) AS y, CAST(trunc(avg(x)) AS INTEGER) AS x FROM pixels GROUP BY ALL)
    SELECT window_id, cid, min(layer) AS layer, arg_min(y, layer) AS y, arg_min(x, layer) AS x FROM p GROUP BY ALL""")
def a27_sample_positions(spark, sf_dir):
    return raster.sample_positions(base.painted(spark, sf_dir), ["window_id"])


@query(f"WITH {RECTS} SELECT window_id, layer, bool_or(cid > 0) AS has_density FROM pixels GROUP BY ALL")
def a24_layer_density(spark, sf_dir):
    return raster.layer_has_density(base.painted(spark, sf_dir), ["window_id"])


@query(f"""WITH {RECTS}, b AS (SELECT window_id, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM pixels GROUP BY 1),
    s AS (SELECT p.window_id, layer, cid, CAST(ceil((y - y0) * 32.0 / (y1 - y0 + 1)) AS INTEGER) AS ya, CAST(ceil((y - y0 + 1) * 32.0 / (y1 - y0 + 1)) AS INTEGER) AS yb,
      CAST(ceil((x - x0) * 32.0 / (x1 - x0 + 1)) AS INTEGER) AS xa, CAST(ceil((x - x0 + 1) * 32.0 / (x1 - x0 + 1)) AS INTEGER) AS xb FROM pixels p JOIN b ON b.window_id = p.window_id),
    u AS (SELECT window_id, layer, cid, xa, xb, unnest(range(ya, yb)) AS y FROM s WHERE ya < yb)
    SELECT window_id, layer, CAST(y AS INTEGER) AS y, CAST(unnest(range(xa, xb)) AS INTEGER) AS x, cid FROM u WHERE xa < xb""")
def r09_trim_and_resize(spark, sf_dir):
    return raster.trimmed(base.painted(spark, sf_dir), ["window_id"], 32)


@query(f"""WITH {RECTS}, m AS (SELECT window_id, min(cid) AS master FROM pixels GROUP BY 1)
    SELECT window_id, master, layer, count(*) FILTER (cid = master) AS own, count(*) FILTER (cid <> master) AS other FROM pixels JOIN m USING (window_id) GROUP BY ALL""")
def f40_signed_occupancy(spark, sf_dir):
    px = base.painted(spark, sf_dir)
    occ = raster.signed_occupancy(px, ["window_id"], px.groupBy("window_id").agg(F.min("cid").alias("master")))
    return occ.groupBy("window_id", "master", "layer").agg(F.count_if(F.col("occupancy") == -1).alias("own"), F.count_if(F.col("occupancy") == 1).alias("other"))


@query(f"""WITH {RECTS}, m AS (SELECT window_id, min(cid) AS pos, max(cid) AS neg FROM pixels GROUP BY 1)
    SELECT window_id, layer, CAST(sum(CASE WHEN cid = pos THEN 2.0 WHEN cid = neg THEN -1.0 ELSE 1.0 END) AS DOUBLE) AS total FROM pixels JOIN m USING (window_id) GROUP BY ALL""")
def f41_highlight(spark, sf_dir):
    px = base.painted(spark, sf_dir)
    ends = px.groupBy("window_id").agg(F.min("cid").alias("pos"), F.max("cid").alias("neg"))
    feature = raster.highlighted(F.lit(1.0), F.col("cid"), F.col("pos"), F.col("neg"))
    return px.join(ends, "window_id").groupBy("window_id", "layer").agg(F.sum(feature).alias("total"))


@query(f"WITH {RECTS} SELECT window_id, layer, y, x, cid, CAST(1 AS DOUBLE) AS mask FROM pixels WHERE cid IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0)")
def f43_masks(spark, sf_dir):
    ids = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("cid"))
    return raster.mask(base.painted(spark, sf_dir), ids, [])


@query(f"""WITH {RECTS}, q AS (SELECT window_id, layer, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x FROM exploded WHERE seq.a % 5 <> 0 GROUP BY ALL)
    SELECT window_id, layer, count(*) FILTER (p.x IS NULL OR q.x IS NULL) AS mismatched, count(*) FILTER (p.x IS NOT NULL AND q.x IS NOT NULL) AS agreed,
    count(*) FILTER (p.x IS NULL OR q.x IS NULL) <= floor(count(*) * 0.05) AS tolerable
    FROM pixels p FULL JOIN q USING (window_id, layer, y, x) GROUP BY window_id, layer""")
def a35_mismatches(spark, sf_dir):
    return raster.mismatches(base.painted(spark, sf_dir), raster.paint(base.rects(spark, sf_dir).where("seq.a % 5 <> 0")), ["window_id"])


@query(f"WITH {RECTS} SELECT window_id, layer, cid, CAST(y // 16 AS BIGINT) AS ty, CAST(x // 16 AS BIGINT) AS tx, count(*) AS n, array_to_string(list_sort(list(CAST((y % 16) * 16 + x % 16 AS INTEGER))), ',') AS places FROM pixels GROUP BY ALL")
def a38_owned_tiles(spark, sf_dir):
    tiles = raster.owned_tiles(base.painted(spark, sf_dir), ["window_id"], 16, 64)
    return tiles.withColumn("places", F.array_join(F.transform("places", lambda p: p.cast("string")), ","))


@query(f"WITH {RECTS} SELECT window_id, layer, cid, px0, px1, py0, py1 FROM px WHERE layer >= 0 AND cid > 0 AND px0 < px1 AND py0 < py1")
def f12_pixel_ranges(spark, sf_dir):
    return raster.active(base.rects(spark, sf_dir)).select("window_id", "layer", "cid", "px0", "px1", "py0", "py1")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, least(l_quantity, l_quantity + l_tax * 100, l_quantity - l_discount * 100, l_quantity + l_tax * 100 - l_discount * 100) AS x0,
    least(0, l_discount * 50, l_tax * 20, l_discount * 50 + l_tax * 20) AS y0, greatest(l_quantity, l_quantity + l_tax * 100, l_quantity - l_discount * 100, l_quantity + l_tax * 100 - l_discount * 100) AS x1,
    greatest(0, l_discount * 50, l_tax * 20, l_discount * 50 + l_tax * 20) AS y1 FROM lineitem""".replace("least(0", "least(0.0").replace("greatest(0", "greatest(0.0"))
def f02_footprints(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    box = geometry.footprint(F.col("l_quantity"), F.lit(0.0), F.col("l_tax") * 100, F.col("l_discount") * 50, -F.col("l_discount") * 100, F.col("l_tax") * 20)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", *box)


@query("""SELECT p_partkey, p_size + 0.0 AS x0, CAST(p_partkey % 7 AS DOUBLE) AS y0, p_size + CASE WHEN o IN ('E', 'W', 'FE', 'FW') THEN 2.5 ELSE 4.0 END AS x1,
    p_partkey % 7 + CASE WHEN o IN ('E', 'W', 'FE', 'FW') THEN 4.0 ELSE 2.5 END AS y1
    FROM (SELECT *, ['N', 'S', 'E', 'W', 'FN', 'FS', 'FE', 'FW'][p_partkey % 8 + 1] AS o FROM part)""")
def f03_component_boxes(spark, sf_dir):
    orient = F.element_at(F.array(*map(F.lit, ("N", "S", "E", "W", "FN", "FS", "FE", "FW"))), (F.col("p_partkey") % 8 + 1).cast("int"))
    box = geometry.component_box(F.col("p_size").cast("double"), (F.col("p_partkey") % 7).cast("double"), orient, F.lit(4.0), F.lit(2.5))
    return table(spark, sf_dir, "part").select("p_partkey", *box)


_TILES = "tiles AS (SELECT i * 8 + j AS tile, i * 10.0 AS w_x0, j * 10.0 AS w_y0, i * 10.0 + 10 AS w_x1, j * 10.0 + 10 AS w_y1 FROM range(8) a(i), range(8) b(j))"


def _tiles(spark):
    i, j = F.floor(F.col("id") / 8), F.col("id") % 8
    return spark.range(64).select(F.col("id").alias("tile"), (i * 10.0).alias("w_x0"), (j * 10.0).alias("w_y0"), (i * 10.0 + 10).alias("w_x1"), (j * 10.0 + 10).alias("w_y1"))


def _boxes(spark, sf_dir, p):
    rows = base.rects(spark, sf_dir)
    return rows.select("window_id", "layer", "cid", *[F.col(c).alias(f"{p}{c}") for c in ("x0", "y0", "x1", "y1")])


@query(f"WITH {RECTS}, {_TILES} SELECT tile, layer, count(*) AS n, round(sum((least(x1, w_x1) - greatest(x0, w_x0)) * (least(y1, w_y1) - greatest(y0, w_y0))), 4) AS area FROM rects JOIN tiles ON x1 > w_x0 AND x0 < w_x1 AND y1 > w_y0 AND y0 < w_y1 GROUP BY ALL")
def j10_bin_join(spark, sf_dir):
    cut = geometry.clipped(spatial.overlap_join(_boxes(spark, sf_dir, "r_"), _tiles(spark), "r_", "w_", 10.0), "r_", "w_")
    return cut.groupBy("tile", "layer").agg(F.count("*").alias("n"), F.round(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))), 4).alias("area"))


@query(f"""WITH {_TILES}, c AS (SELECT p_partkey AS component, p_size + 0.0 AS x, CAST(p_partkey % 70 AS DOUBLE) AS y, p_brand AS cell FROM part),
    s AS (SELECT DISTINCT p_brand AS cell, 3.0 AS w, 2.0 AS h FROM part WHERE p_brand < 'Brand#3')
    SELECT tile AS window_id, component FROM c LEFT JOIN s USING (cell) JOIN tiles ON CASE WHEN w IS NULL THEN x BETWEEN w_x0 AND w_x1 AND y BETWEEN w_y0 AND w_y1 ELSE x + w > w_x0 AND x < w_x1 AND y + h > w_y0 AND y < w_y1 END""")
def j07_components_in_windows(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    comps = part.select(F.col("p_partkey").alias("component"), F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 70).cast("double").alias("y"), F.col("p_brand").alias("cell"), F.lit("N").alias("orient"))
    sizes = part.where("p_brand < 'Brand#3'").select(F.col("p_brand").alias("cell"), F.lit(3.0).alias("w"), F.lit(2.0).alias("h")).distinct()
    return spatial.components_in_windows(comps, sizes, _tiles(spark).withColumnRenamed("tile", "window_id"), 10.0)


def _tiled_lines(spark, lines):
    """Polylines (net, points) with the tiles that their box touches; spread first, since the table may be one small file."""
    lines = lines.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "net")
    box = lines.withColumns({"l_x0": F.array_min("points.x"), "l_x1": F.array_max("points.x"), "l_y0": F.array_min("points.y"), "l_y1": F.array_max("points.y")})
    return spatial.overlap_join(box, _tiles(spark), "l_", "w_", 10.0, closed=True)


@query(f"""WITH {_TILES}, s AS (SELECT o_orderkey AS net, o_orderkey % 90 - 5.0 AS px, o_custkey % 80 + 0.5 AS py, o_custkey % 90 - 5.0 AS qx, o_custkey % 80 + 0.5 AS qy FROM orders)
    SELECT net, tile, round(greatest(least(px, qx), w_x0), 6) AS x_lo, round(least(greatest(px, qx), w_x1), 6) AS x_hi FROM s JOIN tiles ON py BETWEEN w_y0 AND w_y1 AND greatest(px, qx) >= w_x0 AND least(px, qx) <= w_x1
    WHERE least(greatest(px, qx), w_x1) - greatest(least(px, qx), w_x0) > 1e-9""")
def j09_clipped_polylines(spark, sf_dir):
    """Level lines cut to tiles; those of no length have no piece."""
    x = lambda c: (F.col(c) % 90 - 5).cast("double")
    y = F.col("o_custkey") % 80 + 0.5
    point = lambda c: F.struct(x(c).alias("x"), y.cast("double").alias("y"))
    lines = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("net"), F.array(point("o_orderkey"), point("o_custkey")).alias("points"))
    pieces = geometry.polyline_pieces(_tiled_lines(spark, lines), ["net", "tile"])
    return pieces.select("net", "tile", F.round(F.array_min("points.x"), 6).alias("x_lo"), F.round(F.array_max("points.x"), 6).alias("x_hi"))


@query(f"""WITH {_TILES}, s AS (SELECT o_orderkey AS net, i AS leg, (o_orderkey * (2 * i + 3) % 97) - 8.0 AS px, (o_custkey * (i + 2) % 89) - 4.0 AS py, (o_orderkey * (2 * i + 5) % 97) - 8.0 AS qx, (o_custkey * (i + 3) % 89) - 4.0 AS qy FROM orders, range(0, 4) r(i)),
    t AS (SELECT *, qx - px AS dx, qy - py AS dy FROM s JOIN tiles ON least(px, qx) <= w_x1 AND greatest(px, qx) >= w_x0 AND least(py, qy) <= w_y1 AND greatest(py, qy) >= w_y0),
    c AS (SELECT *, greatest(0.0, CASE WHEN dx = 0 THEN 0.0 ELSE least((w_x0 - px) / dx, (w_x1 - px) / dx) END, CASE WHEN dy = 0 THEN 0.0 ELSE least((w_y0 - py) / dy, (w_y1 - py) / dy) END) AS t0,
      least(1.0, CASE WHEN dx = 0 THEN 1.0 ELSE greatest((w_x0 - px) / dx, (w_x1 - px) / dx) END, CASE WHEN dy = 0 THEN 1.0 ELSE greatest((w_y0 - py) / dy, (w_y1 - py) / dy) END) AS t1 FROM t),
    k AS (SELECT net, tile, leg, px + t0 * dx AS ax, py + t0 * dy AS ay, px + t1 * dx AS bx, py + t1 * dy AS by_ FROM c WHERE t0 <= t1 AND (t1 - t0) * greatest(abs(dx), abs(dy)) > 1e-9),
    f AS (SELECT *, CASE WHEN lag(leg) OVER q = leg - 1 AND abs(lag(bx) OVER q - ax) <= 1e-9 AND abs(lag(by_) OVER q - ay) <= 1e-9 THEN 0 ELSE 1 END AS first FROM k WINDOW q AS (PARTITION BY net, tile ORDER BY leg)),
    p AS (SELECT *, sum(first) OVER (PARTITION BY net, tile ORDER BY leg) AS piece FROM f)
    SELECT net, tile, CAST(piece AS BIGINT) AS piece, count(*) + 1 AS points, round(arg_min(ax, leg), 7) AS ax, round(arg_min(ay, leg), 7) AS ay, round(arg_max(bx, leg), 7) AS bx, round(arg_max(by_, leg), 7) AS by_ FROM p GROUP BY net, tile, piece""")
def f37_polyline_pieces(spark, sf_dir):
    """Sloping lines of four legs that leave tiles and come back: pieces with their points, first and last."""
    point = lambda i: F.struct((F.col("o_orderkey") * (2 * i + 3) % 97 - 8).cast("double").alias("x"), (F.col("o_custkey") * (i + 2) % 89 - 4).cast("double").alias("y"))
    lines = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("net"), F.array(*[point(i) for i in range(5)]).alias("points"))
    pieces = geometry.polyline_pieces(_tiled_lines(spark, lines), ["net", "tile"])
    end = lambda i, c: F.round(F.element_at("points", i)[c], 7)
    return pieces.select("net", "tile", "piece", F.size("points").cast("long").alias("points"), end(1, "x").alias("ax"), end(1, "y").alias("ay"), end(-1, "x").alias("bx"), end(-1, "y").alias("by_"))


@query(f"""WITH {RECTS}, {_TILES}, c AS (SELECT tile AS window_id, layer, unnest(range(CAST(floor(greatest(x0, w_x0)) AS INTEGER), CAST(ceil(least(x1, w_x1)) AS INTEGER))) AS x, CAST(floor(greatest(y0, w_y0)) AS INTEGER) AS a, CAST(ceil(least(y1, w_y1)) AS INTEGER) AS b
      FROM rects JOIN tiles ON x1 > w_x0 AND x0 < w_x1 AND y1 > w_y0 AND y0 < w_y1)
    SELECT window_id, layer, count(*) / 100.0 AS density FROM (SELECT DISTINCT window_id, layer, x, unnest(range(a, b)) AS y FROM c) GROUP BY ALL""")
def r27_viewport_density(spark, sf_dir):
    return spatial.viewport_density(_boxes(spark, sf_dir, "r_").drop("window_id"), _tiles(spark).withColumnRenamed("tile", "window_id"), 10.0, 1.0)


@query("""WITH RECURSIVE r AS (SELECT s_suppkey AS id, (s_suppkey * 7) % 60 + 0.0 AS x0, (s_suppkey * 13) % 60 + 0.0 AS y0, s_nationkey % 3 AS layer FROM supplier),
    e AS (SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.layer = b.layer AND a.id <> b.id AND a.x0 + 4 >= b.x0 AND b.x0 + 4 >= a.x0 AND a.y0 + 4 >= b.y0 AND b.y0 + 4 >= a.y0),
    t AS (SELECT id AS node, id AS reach FROM r UNION SELECT t.node, e.b FROM t JOIN e ON e.a = t.reach)
    SELECT node, min(reach) AS root FROM t GROUP BY node""")
def r11_connected_components(spark, sf_dir):
    s = F.col("s_suppkey")
    x, y = (s * 7 % 60).cast("double"), (s * 13 % 60).cast("double")
    shapes = table(spark, sf_dir, "supplier").select(s.alias("id"), (F.col("s_nationkey") % 3).alias("layer"), x.alias("x0"), y.alias("y0"), (x + 4).alias("x1"), (y + 4).alias("y1"))
    return components.touching_components(shapes, 8.0)
