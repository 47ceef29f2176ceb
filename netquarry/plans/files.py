"""Queries over texts and files whose parts the other queries leave out: whole CAP3D and DEF contents, names, paths, annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare, layout, names, raster, samples, stats, views
from ..sinks import export
from ..sources import cap3d, catalog, lefdef
from . import base
from .base import CAPS, query, r6, rounded, table
from .formats import log, out_folder, say

# A CAP3D text an order: its layers, plate media, window, a medium with two blocks, its line items as conductors, and tasks.
_CAP3D = """o AS (SELECT o_orderkey AS w, o_custkey AS c FROM orders), l AS (SELECT l_orderkey AS w, l_linenumber AS j, max(l_quantity) AS q, max(l_suppkey % 3) AS s FROM lineitem GROUP BY ALL)"""


def _cap3d(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    orders = table(spark, sf_dir, "orders")
    head = orders.select(
        k.alias("w"), F.lit(0).alias("part"), F.lit(0).alias("j"),
        say(
            "<!-- made -->\n<layer>\n name M1\n id 1\n type metal\n</layer>\n<layer>\n name V", c, "\n id 2\nvia\n</layer>\n<plate_medium>\n name low\n diel ", c % 7, ".5\n z_top ", k % 9, ".25\n</plate_medium>\n<window>\n name W", k,
            "\n v1(0, 0, 0)\n v2(", k % 50, ", 7, 1.5)\n dirichlet\n</window>\n<medium>\n name air\n<block>\n name m\n basepoint(0, 0, ", c % 5, ")\n v1(1, 0, 0)\n v2(0, 1, 0)\n hvector(0, 0, 1)\n</block>\n diel ", c % 4, ".0\n</medium>",
        ).alias("line"),
    )
    item = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("w"), F.col("l_linenumber").alias("j")).agg(F.max("l_quantity").alias("q"), F.max(F.col("l_suppkey") % 3).alias("s"))
    block = say("<conductor>\n name N", F.col("s"), "\n<block>\n name b", F.col("j"), "\n layer ", F.col("s"), "\n basepoint(", F.col("q"), ", 0, ", F.col("j") % 4, ")\n v1(1, 0, 0)\n v2(0, 2, 0)\n hvector(0, 0, 0.5)\n</block>\n<poly>\n name p\n layer 1\n basepoint(0, 0, 0)\n v1(1, 0, 0)\n v2(0, 1, 0)\n hvector(0, 0, 1)\n<coord>(0 0) (", F.col("q"), " 0) (0 ", F.col("j"), ")</coord>\n</poly>\n</conductor>\n<task>\n<capacitance>\nN", F.col("s"), "\n</capacitance>\n</task>")
    body = item.select("w", F.lit(1).alias("part"), "j", block.alias("line"))
    return cap3d.read_cap3d(log(head.join(body.select("w").distinct(), "w").unionByName(body), "w", ["part", "j"], F.col("line")))


@query(f"""WITH {_CAP3D}, k AS (SELECT o.* FROM o WHERE w IN (SELECT w FROM l))
    SELECT CAST(w AS VARCHAR) AS window_id, 'layer' AS kind, 'M1' AS name, 'metal' AS type, CAST(1 AS DOUBLE) AS a, CAST(NULL AS DOUBLE) AS b FROM k UNION ALL SELECT CAST(w AS VARCHAR), 'layer', concat('V', c), 'via', 2, NULL FROM k
    UNION ALL SELECT CAST(w AS VARCHAR), 'plate_medium', 'low', NULL, c % 7 + 0.5, w % 9 + 0.25 FROM k UNION ALL SELECT CAST(w AS VARCHAR), 'window', concat('W', w), 'dirichlet', w % 50, 1.5 FROM k
    UNION ALL SELECT CAST(w AS VARCHAR), 'block', 'm', NULL, c % 4, c % 5 FROM k UNION ALL SELECT CAST(w AS VARCHAR), 'target', concat('N', s), NULL, NULL, NULL FROM l""")
def s04_cap3d_parts(spark, sf_dir):
    """Layers, plate media, windows, blocks of media with the permittivity that follows them, and tasks."""
    rows, kind = _cap3d(spark, sf_dir), F.col("kind")
    found = rows.where(kind.isin("layer", "plate_medium", "window", "target") | (kind == "block") & (F.col("section") == "medium"))
    a = F.when(kind == "layer", F.col("id")).when(kind == "window", F.col("v2")[0]).otherwise(F.col("diel"))
    b = F.when(kind == "window", F.col("v2")[2]).when(kind == "block", F.col("base")[2]).otherwise(F.col("z_top"))
    return found.select("window_id", "kind", "name", "type", a.cast("double").alias("a"), b.cast("double").alias("b"))


@query(f"""WITH {_CAP3D} SELECT CAST(w AS VARCHAR) AS window_id, concat('N', s) AS parent, count(*) AS polys, CAST(sum(q * j) AS DOUBLE) / 2 AS area FROM l GROUP BY w, s""")
def s06_cap3d_polygons(spark, sf_dir):
    """Polygons with their corners, from coordinate text."""
    polys = _cap3d(spark, sf_dir).where("kind = 'poly'")
    return polys.groupBy("window_id", "parent").agg(F.count("*").alias("polys"), (F.sum(F.col("xy")[2] * F.col("xy")[5]) / 2).alias("area"))


@query(f"""WITH {_CAP3D} SELECT CAST(w AS VARCHAR) AS window_id, concat('N', arg_min(s, (j % 4) * 100 + j)) AS ground FROM l GROUP BY w""")
def a22_ground_net(spark, sf_dir):
    return cap3d.ground_net(_cap3d(spark, sf_dir))


@query(f"""WITH {_CAP3D}, n AS (SELECT w, s, count(*) AS n, min(j) AS first FROM l GROUP BY ALL) SELECT CAST(w AS VARCHAR) AS window_id, concat('N', arg_min(s, -n * 100 + first)) AS master FROM n GROUP BY w""")
def a23_master_net(spark, sf_dir):
    return cap3d.master_net(_cap3d(spark, sf_dir))


@query(f"""WITH {_CAP3D} SELECT CAST(l.w AS VARCHAR) AS window_id, CASE s WHEN 1 THEN 'M1' WHEN 2 THEN concat('V', c) ELSE 'N0' END AS layer_name, count(*) AS blocks FROM l JOIN o USING (w) GROUP BY ALL
    UNION ALL SELECT CAST(w AS VARCHAR), 'air', 1 FROM o WHERE w IN (SELECT w FROM l)""")
def j13_layer_names(spark, sf_dir):
    return cap3d.layer_names(_cap3d(spark, sf_dir)).groupBy("window_id", "layer_name").agg(F.count("*").alias("blocks"))


@query(f"""WITH {_CAP3D} SELECT CAST(w AS VARCHAR) AS window_id, count(*) AS conductor_blocks, 1 AS medium_blocks, count(*) AS polys, 2 AS layers, count(DISTINCT s) AS nets FROM l GROUP BY w""".replace("1 AS medium", "CAST(1 AS BIGINT) AS medium").replace("2 AS layers", "CAST(2 AS BIGINT) AS layers"))
def s41_cap3d_counts(spark, sf_dir):
    return cap3d.stats(_cap3d(spark, sf_dir))


# A DEF text a customer: design, die, rows, nets with uses, special nets, vias.


def _designs(spark, sf_dir, compact: bool = False):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    text = say(
        "VERSION 5.8 ;\nDESIGN d", k, " ;\nUNITS DISTANCE MICRONS ", F.when(k % 2 == 0, 1000).otherwise(2000), " ;\nDIEAREA ( 0 0 ) ( ", k * 1000, " 4000 ) ;\nROW r0 core ", k % 7 * 1000, " 2000 FS DO ", n + 1, " BY 1 STEP 2000 0 ;\nVIAS 1 ;\n- v", n,
        "\n + RECT m1 ( -1000 -1000 ) ( ", n * 1000, " 1000 ) ;\nEND VIAS\nCOMPONENTS 2 ;\n- a INV + FIXED ( ", k % 9 * 1000, " 0 ) N ;\n- b BUF ;\nEND COMPONENTS\nNETS 1 ;\n- n", k, " ( a A ) ( b Z )\n + ROUTED m1 ( 0 0 ) ( ", k % 5 * 1000 + 1000, " * )\n + USE ",
        F.when(n % 2 == 0, "CLOCK").otherwise("SIGNAL"), "\n ;\nEND NETS\nSPECIALNETS 2 ;\n- VSS ( * VSS )\n + ROUTED m2 400 ( 0 0 ) ( 0 1000 )\n ;\n- VDD ( * VDD ) ;\nEND SPECIALNETS\nEND DESIGN",
    )
    files = table(spark, sf_dir, "customer").select(say("/in/d", k, ".def").alias("path"), k.cast("string").alias("window_id"), text.alias("text"))
    return lefdef.read_def(files, compact)


_UNIT = "CASE WHEN c_custkey % 2 = 0 THEN 1.0 ELSE 0.5 END"


@query(f"""SELECT CAST(c_custkey AS VARCHAR) AS window_id, 'design' AS kind, 'design' AS name, concat('d', c_custkey) AS text, CAST(NULL AS DOUBLE) AS a, CAST(NULL AS DOUBLE) AS b FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'design', 'version', '5.8', NULL, NULL FROM customer
    UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'die', NULL, NULL, c_custkey * {_UNIT}, 4 * {_UNIT} FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'row', 'r0', 'FS', c_custkey % 7 * {_UNIT}, c_nationkey + 1 FROM customer
    UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'via_rect', concat('v', c_nationkey), 'm1', -1 * {_UNIT}, c_nationkey * {_UNIT} FROM customer""")
def s09_def_design(spark, sf_dir):
    """Names, dies, placement rows and rectangles of vias, in two units."""
    rows, kind = _designs(spark, sf_dir), F.col("kind")
    nums = lambda i: F.get("nums", F.lit(i))
    a = F.when(kind == "die", nums(2)).when(kind == "row", F.col("x")).when(kind == "via_rect", nums(0))
    b = F.when(kind == "die", nums(3)).when(kind == "row", nums(0)).when(kind == "via_rect", nums(2))
    text = F.when(kind == "row", F.col("orient")).when(kind == "via_rect", F.col("layer")).otherwise(F.col("text"))
    return rows.where(kind.isin("design", "die", "row", "via_rect")).select("window_id", "kind", "name", text.alias("text"), a.alias("a"), b.alias("b"))


@query(f"""SELECT CAST(c_custkey AS VARCHAR) AS window_id, concat('n', c_custkey) AS name, CASE WHEN c_nationkey % 2 = 0 THEN 'CLOCK' ELSE 'SIGNAL' END AS use, false AS special, 'a/A,b/Z' AS ends, (c_custkey % 5 + 1) * {_UNIT} AS length, CAST(NULL AS DOUBLE) AS width FROM customer
    UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'VSS', 'GROUND', true, '*/VSS', {_UNIT}, 0.4 * {_UNIT} FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'VDD', 'POWER', true, '*/VDD', NULL, NULL FROM customer""")
def s11_def_nets(spark, sf_dir):
    """Nets with use, connections and their routes' extent; special nets, a star for every component, widths."""
    rows = _designs(spark, sf_dir)
    point = lambda i: F.get("points", F.lit(i))
    routes = rows.where("kind = 'route'").groupBy("window_id", "name").agg(F.sum(F.abs(point(2) - point(0)) + F.abs(point(3) - point(1))).alias("length"), F.max("width").alias("width"))
    found = rows.where("kind = 'net'").drop("width").join(routes, ["window_id", "name"], "left")
    return rounded(found.select("window_id", "name", "use", "special", F.array_join("connections", ",").alias("ends"), "length", "width"), "length", "width")


@query(f"""SELECT CAST(c_custkey AS VARCHAR) AS window_id, 'a' AS name, 'INV' AS cell, 'FIXED' AS status, c_custkey % 9 * {_UNIT} AS x FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'b', 'BUF', 'PLACED', 0 FROM customer""")
def s16_compact_def(spark, sf_dir):
    """The compact scan takes short component lines too, and gives neither rows nor vias."""
    rows = _designs(spark, sf_dir, compact=True).where(F.col("kind").isin("component", "row", "via"))
    return rows.select("window_id", "name", "cell", "status", "x")


# Annotations, registries, paths and names.


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_extendedprice * 1e-20 AS cap, CAST(l_quantity AS INTEGER) AS e1, CAST(l_suppkey % 10 AS INTEGER) AS e2, CAST(l_partkey % 90 AS INTEGER) AS n FROM lineitem)
    SELECT n, count(*) AS rows, count(*) FILTER (cap >= 1e-17) AS total, count(*) FILTER (cap >= 1e-17 AND (e1 + e2) / CAST(nullif(n, 0) AS DOUBLE) > 0.4) AS coupling, round(sum(cap) * 1e18, 3) AS cap FROM l GROUP BY n""")
def s35_annotations(spark, sf_dir):
    """Annotations written as CSV and read with their types, and those that are clean as totals and as couplings."""
    li = table(spark, sf_dir, "lineitem")
    folder = out_folder(spark, "annotations")
    rows = li.select((F.col("l_extendedprice") * 1e-20).alias("cap"), F.lit("t").alias("cap_type"), F.lit(2).alias("conductor_num"), (F.col("l_partkey") % 90).alias("point_num"), F.col("l_quantity").cast("int").alias("electrode1_point_num"), (F.col("l_suppkey") % 10).alias("electrode2_point_num"), F.concat(F.lit("p"), "l_orderkey", F.lit(".npz")).alias("point_cloud_path"))
    export.to_csv(rows, folder)
    found = catalog.annotations(spark, folder)
    kept = [catalog.clean_annotations(found, k).groupBy(F.col("point_num").alias("n")).agg(F.count("*").alias(k)) for k in ("total", "coupling")]
    every = found.groupBy(F.col("point_num").alias("n")).agg(F.count("*").alias("rows"), F.round(F.sum("cap") * 1e18, 3).alias("cap"))
    return every.join(kept[0], "n", "left").join(kept[1], "n", "left").fillna(0, ["total", "coupling"])


@query("""WITH d AS (SELECT concat(n_name, '/', ['small', 'medium', 'large'][c_custkey % 3 + 1], '/', c_custkey) AS dataset_id, c_custkey AS k, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT dataset_id, n_name AS process_node, 'windows.yaml' AS windows_file, CASE k % 2 WHEN 0 THEN 'zip' ELSE 'tar' END AS kind, k % 2 = 1 AS preferred, CASE k % 3 WHEN 0 THEN 'def' ELSE 'cap3d,def' END AS missing FROM d""")
def s27_registry(spark, sf_dir):
    """Datasets from JSON with their defaults, and their artifacts that aren't there."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    size = F.element_at(F.array(*map(F.lit, ("small", "medium", "large"))), (k % 3 + 1).cast("int"))
    source = F.struct(F.lit("s").alias("name"), F.lit("u").alias("url"), F.lit("f").alias("filename"), F.when(k % 2 == 1, "tar").alias("kind"), F.when(k % 2 == 1, True).alias("preferred"))
    # A JSON document a dataset; a registry may come in several.
    told = rows.select(F.array(F.struct(F.concat_ws("/", "n_name", size, k.cast("string")).alias("dataset_id"), F.col("n_name").alias("process_node"), F.create_map(F.lit("cap3d"), F.lit("c"), F.lit("def"), F.lit("d")).alias("artifacts"), F.array(source).alias("sources"))).alias("datasets"))
    folder = out_folder(spark, "registry")
    export.to_json(told, folder)
    found = catalog.registry(spark, folder, lines=True)
    number = F.element_at(F.split("dataset_id", "/"), -1).cast("int")
    present = found.where(number % 3 == 0).select("dataset_id", F.lit("c").alias("path"))
    missing = catalog.missing_artifacts(found, present).groupBy("dataset_id").agg(F.array_join(F.array_sort(F.collect_list("artifact")), ",").alias("missing"))
    first = F.col("sources")[0]
    return found.join(missing, "dataset_id").select("dataset_id", "process_node", "windows_file", first["kind"].alias("kind"), first["preferred"].alias("preferred"), "missing")


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'density_maps' WHEN 1 THEN 'labels_rwcap' WHEN 2 THEN 'point_clouds' ELSE 'gds' END AS artifact FROM supplier""")
def f29_artifact_names(spark, sf_dir):
    said = F.element_at(F.array(*map(F.lit, (" CNN ", "rwcap", "Pct", "gds"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", catalog.canonical_artifact(said).alias("artifact"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'n7' WHEN 1 THEN 'nangate45' END AS node, CASE WHEN o_orderkey % 2 = 0 THEN concat('w/W', o_orderkey, '.spef.gz') ELSE concat('/else/W', o_orderkey, '.spef.gz') END AS below, concat('W', o_orderkey) AS stem FROM orders""")
def f31_paths(spark, sf_dir):
    """The process node that a path names, the path below a root, and its stem."""
    k = F.col("o_orderkey")
    folder = F.when(k % 3 == 0, "N7").when(k % 3 == 1, "NanGate45").otherwise("n70")
    node = views.node_of_path(say("/data/", folder, "/W", k), ("n7", "nangate45"))
    path = F.when(k % 2 == 0, say("/root/w/W", k, ".spef.gz")).otherwise(say("/else/W", k, ".spef.gz"))
    return table(spark, sf_dir, "orders").select("o_orderkey", node.alias("node"), views.relative(path, F.lit("/root//")).alias("below"), views.stem(path).alias("stem"))


@query("SELECT p_brand, count(*) FILTER (p_brand IN ('Brand#11', 'Brand#32')) AS listed, count(*) AS every FROM part GROUP BY 1")
def f32_filters(spark, sf_dir):
    some, all_ = (views.matches_filter(F.col("p_brand"), f) for f in (" brand#11,BRAND#32 ,, ", None))
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count_if(some).alias("listed"), F.count_if(all_).alias("every"))


@query("""SELECT concat('W', o_orderkey) AS stem, concat('/a/W', o_orderkey, '.spef') AS path_a, concat('/b/x/W', o_orderkey, '.out.gz') AS path_b FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def j21_paired_files(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(say("/a/W", F.col("o_orderkey"), ".spef").alias("path"))
    b = table(spark, sf_dir, "lineitem").select(say("/b/x/W", F.col("l_orderkey"), ".out.gz").alias("path")).distinct()
    return views.paired(a, b)


@query("""SELECT l_orderkey // 1000 AS window_id, bool_or(l_quantity - 0.2 <= 7.3 AND l_quantity + l_tax + 0.2 >= 7.3) AS near, CAST(greatest(0, max(l_quantity + l_tax)) AS DOUBLE) AS top FROM lineitem GROUP BY 1""")
def f44_near_height(spark, sf_dir):
    blocks = table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey div 1000").alias("window_id"), F.col("l_quantity").alias("z0"), (F.col("l_quantity") + F.col("l_tax")).alias("z1"))
    return views.near_height(blocks, 7.3).join(views.uppermost(blocks).withColumnRenamed("z", "top"), "window_id")


@query("""WITH c AS (SELECT label, vec_id AS i, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
    d AS (SELECT q.label, q.i AS q_idx, p.i AS p_idx, p.x - q.x AS dx, row_number() OVER (PARTITION BY q.label, q.i ORDER BY (q.x - p.x) ** 2 + (q.y - p.y) ** 2 + (q.z - p.z) ** 2, p.i) AS r FROM c q JOIN c p ON q.label = p.label AND q.i % 20 = 0)
    SELECT label, q_idx, string_agg(p_idx, ',' ORDER BY r) AS ids, round(sum(dx), 6) AS dx FROM d WHERE r <= 3 GROUP BY ALL""")
def r20_grouped_neighbours(spark, sf_dir):
    """The three nearest points of each twentieth point, relative to it."""
    e = table(spark, sf_dir, "embeddings")
    cloud = lambda p: e.select("label", F.col("vec_id").alias(f"{p}idx"), *[F.col("embedding")[i].cast("double").alias(f"{p}{c}") for i, c in enumerate("xyz")])
    found = views.grouped_neighbours(cloud("q_").where("q_idx % 20 = 0"), cloud("p_"), ["label"], 3)
    return found.select("label", "q_idx", F.array_join(F.transform("group", lambda g: g["p_idx"].cast("string")), ",").alias("ids"), F.round(F.aggregate("group", F.lit(0.0), lambda s, g: s + g["x"]), 6).alias("dx"))


@query("""WITH l AS (SELECT n_nationkey AS layer_id, n_nationkey * 2.0 AS z0, n_nationkey * 2.0 + 1 + n_regionkey AS z1 FROM nation) SELECT p_partkey, coalesce((SELECT arg_min(layer_id, z0) FROM l WHERE z0 <= p_retailprice % 60 AND p_retailprice % 60 <= z1), -1) AS layer_id FROM part""")
def r13_layered_points(spark, sf_dir):
    n = F.col("n_nationkey")
    layers = table(spark, sf_dir, "nation").select(n.alias("layer_id"), (n * 2.0).alias("z0"), (n * 2.0 + 1 + F.col("n_regionkey")).alias("z1"))
    return views.layered_points(table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") % 60).alias("z")), layers).select("p_partkey", "layer_id")


@query("SELECT event_type, CAST(sum(user_id) AS BIGINT) AS walks, CAST(sum(user_id) // count(user_id) AS BIGINT) AS avg_walks FROM events GROUP BY 1")
def a13_average_walks(spark, sf_dir):
    return stats.average_walks(table(spark, sf_dir, "events"), ["event_type"], "user_id")


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN min(l_quantity) ELSE 1.0 END AS x0, CASE WHEN o_orderkey % 3 = 0 THEN min(l_tax) ELSE 2.0 END AS y0, CASE WHEN o_orderkey % 3 = 0 THEN max(l_quantity) + 1 ELSE 3.0 END AS x1, CASE WHEN o_orderkey % 3 = 0 THEN max(l_tax) + 2 ELSE 4.0 END AS y1
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def a21_window_bounds(spark, sf_dir):
    """Bounds given for two windows of three, else those of their blocks."""
    k = F.col("o_orderkey")
    given = table(spark, sf_dir, "orders").select(k.alias("k"), *[F.when(k % 3 != 0, v).alias(c) for c, v in (("x0", 1.0), ("y0", 2.0), ("x1", 3.0), ("y1", 4.0))])
    blocks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("x0"), F.col("l_tax").alias("y0"), (F.col("l_quantity") + 1).alias("x1"), (F.col("l_tax") + 2).alias("y1"))
    return raster.window_bounds(given, blocks.join(given.select("k"), "k", "left_semi"), ["k"])


@query("SELECT o_orderkey AS k, o_totalprice AS x FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 40")
def t05_scatter_points(spark, sf_dir):
    return compare.scatter_points(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("x")), 40, "x", "k")


@query(f"""WITH {CAPS}, c AS (SELECT window_id, net, row_number() OVER (PARTITION BY window_id ORDER BY net) AS cid FROM nets WHERE net <> 'N4'), d AS (SELECT window_id, net_lo, net_hi, value_f, i, value_f * 1e-15 * (1 + i) AS v FROM pairs, range(0, 3) r(i))
    SELECT d.window_id, CAST(a.cid AS INTEGER) AS pos_id, CAST(b.cid AS INTEGER) AS neg_id, round(max_by(v, i) * 1e15, 6) AS target FROM d JOIN c a ON a.window_id = d.window_id AND a.net = net_lo JOIN c b ON b.window_id = d.window_id AND b.net = net_hi GROUP BY ALL""")
def l13_last_labels(spark, sf_dir):
    """Pairs labelled three times take their last label."""
    from ..operators.labels import directional_pairs
    from .samples import _conductors

    pairs = directional_pairs(base.caps(spark, sf_dir)).withColumn("seq", F.explode(F.array(*map(F.lit, range(3)))))
    pairs = pairs.withColumn("value_f", F.col("value_f") * 1e-15 * (1 + F.col("seq")))
    out = samples.coupling_samples(pairs, _conductors(spark, sf_dir), last=True)
    return out.select("window_id", F.col("pos_id").cast("int").alias("pos_id"), F.col("neg_id").cast("int").alias("neg_id"), r6("target").alias("target"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN concat('net', c_custkey % 50) WHEN 1 THEN concat('net', c_custkey % 50) WHEN 2 THEN concat('net', c_custkey % 50) ELSE concat('odd', c_custkey) END AS resolved FROM customer""")
def f26_cloud_names(spark, sf_dir):
    """Conductors of clouds, written with brackets, slashes and in capitals, by the names that they stand for."""
    k = F.col("c_custkey")
    said = F.when(k % 4 == 0, say("NET", k % 50)).when(k % 4 == 1, say("/net[", k % 50, "]")).when(k % 4 == 2, say("{net} ", k % 50)).otherwise(say("odd", k))
    known = spark.range(50).select(say("net", F.col("id")).alias("net"))
    found = names.ladder(table(spark, sf_dir, "customer").select("c_custkey", said.alias("name")), known, "name", names.CLOUD)
    return found.select("c_custkey", F.coalesce("resolved", "name").alias("resolved"))


# A store of shards with its conductors, and label files for two windows of three.
_STORE = f"""{base.RECTS}, t AS (SELECT window_id, cid, CAST(count(*) AS DOUBLE) AS q FROM rects WHERE window_id % 3 <> 0 GROUP BY ALL), n AS (SELECT window_id, count(*) AS n FROM pixels GROUP BY 1), own AS (SELECT window_id, cid, count(*) AS m FROM pixels GROUP BY ALL)"""


def _loaded(spark, sf_dir):
    from .. import serve
    from ..sinks import shards, text as text_sink

    rects = base.rects(spark, sf_dir)
    window = F.col("window_id").cast("string").alias("window_id")
    pixels = base.painted(spark, sf_dir).select(window, "layer", "y", "x", F.lit(0.5).alias("density"), F.col("cid").cast("long").alias("cid"))
    entry = F.struct(say("N", F.col("cid")).alias("k"), F.col("cid").cast("int").alias("v"))
    windows = rects.groupBy(window).agg(F.map_from_entries(F.collect_set(entry)).alias("conductor_id_map"))
    windows = windows.withColumns({"layer_names": F.array(F.lit("M1")), "layer_has_density": F.array(F.lit(True)), "height": F.lit(64), "width": F.lit(64)})
    folder = out_folder(spark, "store")
    shards.write(pixels, windows, folder, 4)
    selfs = rects.where("window_id % 3 <> 0").groupBy(window, say("N", F.col("cid")).alias("net")).agg((F.count("*") * 1e-12).alias("value_f"))
    pairs = selfs.where("false").select("window_id", F.col("net").alias("net_lo"), F.col("net").alias("net_hi"), "value_f")
    files = text_sink.spef(selfs, pairs, "top").select("window_id", F.lit("raphael").alias("solver"), F.concat(F.lit("/l/"), "window_id", F.lit(".spef")).alias("path"), "text")
    return serve.load(spark, folder, files, "self", highlight=2.0)


@query(f"""WITH {_STORE} SELECT CAST(window_id AS VARCHAR) AS window_id, CAST(cid AS INTEGER) AS pos_id, round(q * 1000, 3) AS target FROM t""")
def l01_store_samples(spark, sf_dir):
    """Self samples of a store's labelled windows: conductors through the index, labels through SPEF text."""
    return _loaded(spark, sf_dir).samples.select("window_id", F.col("pos_id").cast("int").alias("pos_id"), F.round("target", 3).alias("target"))


@query(f"""WITH {_STORE}, f AS (SELECT window_id, min(cid) AS cid FROM t GROUP BY 1) SELECT CAST(f.window_id AS VARCHAR) AS window_id, CAST(f.cid AS INTEGER) AS pos_id, n.n AS pixels, round(n.n * 0.5 + coalesce(own.m, 0) * 2.0, 6) AS total FROM f JOIN n USING (window_id) LEFT JOIN own ON own.window_id = f.window_id AND own.cid = f.cid""")
def l04_store_features(spark, sf_dir):
    """Features of the sample of each window's least conductor: the density of its pixels, raised on its own."""
    data = _loaded(spark, sf_dir)
    wanted = data.samples.groupBy("window_id").agg(F.min("pos_id").alias("pos_id")).withColumn("neg_id", F.lit(0))
    return data.features(wanted).groupBy("window_id", F.col("pos_id").cast("int").alias("pos_id")).agg(F.count("*").alias("pixels"), F.round(F.sum("feature"), 6).alias("total"))


@query(f"""WITH {_STORE}, w AS (SELECT window_id, count(*) AS n FROM t GROUP BY 1), o AS (SELECT CAST(window_id AS VARCHAR) AS window_id, n, CAST(sum(n) OVER (ORDER BY CAST(window_id AS VARCHAR)) AS BIGINT) AS e FROM w) SELECT window_id, n, e - n AS start, e AS "end" FROM o""")
def l10_store_ranges(spark, sf_dir):
    return _loaded(spark, sf_dir).ranges()


@query(f"WITH {base.RECTS}, p AS (SELECT window_id, layer, count(*) AS n FROM pixels GROUP BY ALL) SELECT w.window_id, CAST(l.i AS INTEGER) AS layer, concat('M', l.i) AS layer_name, coalesce(p.n, 0) AS n FROM (SELECT DISTINCT window_id FROM pixels) w CROSS JOIN range(0, 10) l(i) LEFT JOIN p ON p.window_id = w.window_id AND p.layer = l.i")
def r06_all_layers(spark, sf_dir):
    """Pixels of each window on every layer of a technology, painted or not."""
    layers = spark.range(10).select(F.col("id").cast("int").alias("layer"), say("M", F.col("id")).alias("layer_name"))
    return layout.with_all_layers(base.painted(spark, sf_dir), layers).select("window_id", "layer", "layer_name", "n")


@query("""WITH n AS (SELECT l_orderkey AS w, l_linenumber AS j, max(l_quantity) AS q FROM lineitem GROUP BY ALL)
    SELECT CAST(w AS VARCHAR) AS window_id, 'total' AS kind, concat('block_', j) AS net, CAST(NULL AS VARCHAR) AS other, round(q, 3) AS pf FROM n
    UNION ALL SELECT CAST(a.w AS VARCHAR), 'pair', least(concat('block_', a.j), concat('block_', b.j)), greatest(concat('block_', a.j), concat('block_', b.j)), round(least(a.q, b.q) / 4, 3) FROM n a JOIN n b ON a.w = b.w AND b.j = a.j + 1""")
def k05_block_labels(spark, sf_dir):
    """Labels of blocks by number, written as SPEF text and read back."""
    from ..sinks import text as text_sink
    from ..sources import spef
    from .formats import texts

    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("window_id"), F.col("l_linenumber").alias("net")).agg(F.max("l_quantity").alias("q"))
    after = n.select("window_id", (F.col("net") - 1).alias("net"), F.col("net").alias("net_hi"), F.col("q").alias("q2"))
    pairs = n.join(after, ["window_id", "net"]).select("window_id", F.col("net").alias("net_lo"), "net_hi", (F.least("q", "q2") / 4 * 1e-12).alias("value_f"))
    rows = spef.read_spef(texts(text_sink.block_spef(n.select("window_id", "net", (F.col("q") * 1e-12).alias("value_f")), pairs, "top")))
    pf = lambda c: F.round(F.col(c) * 1e12, 3).alias("pf")
    totals = spef.nets(rows).select("window_id", F.lit("total").alias("kind"), "net", F.lit(None).cast("string").alias("other"), pf("total_f"))
    found = spef.caps(rows).where("node_b is not null")
    return totals.unionAll(found.select("window_id", F.lit("pair").alias("kind"), F.least("node_a", "node_b").alias("net"), F.greatest("node_a", "node_b").alias("other"), pf("value_f")))
