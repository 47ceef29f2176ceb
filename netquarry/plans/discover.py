"""Queries over listings of files that the tables' keys name."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import discover
from .base import query, table
from .formats import say


def _files(spark, sf_dir):
    """A listing: CAP3D and labels of orders by customer's nation, window lists, temporary folders, LEF and stack files."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    size = F.when(k % 2 == 0, "small").otherwise("large")
    orders = table(spark, sf_dir, "orders")
    root = say("/d/t", c % 7, "/", size)
    parts = [
        orders.select(say(root, "/cap3d/W", k, F.when(k % 11 == 0, ".txt").otherwise(".cap3d")).alias("path")), orders.where("o_orderkey % 3 = 0").select(say(root, "/labels_raphael/W", k, "/", F.when(k % 4 == 0, "other").otherwise("all_nets.dspf")).alias("path")),
        orders.where("o_orderkey % 5 = 0").select(say(root, "/windows.yaml").alias("path")).distinct(), orders.where("o_custkey % 9 = 0").select(say(root, "/gds.tmp/part", k).alias("path")),
        orders.where("o_custkey % 4 = 0").select(say("/s/", c, "/index.json").alias("path")).distinct(), orders.where("o_custkey % 4 = 1").select(say("/s/", c, "/index/p", k, ".parquet").alias("path")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


_FILES = """r AS (SELECT o_orderkey AS k, o_custkey AS c, concat('/d/t', o_custkey % 7, '/', CASE WHEN o_orderkey % 2 = 0 THEN 'small' ELSE 'large' END) AS root FROM orders)"""


@query(f"WITH {_FILES} SELECT concat('t', c % 7, '_', CASE WHEN k % 2 = 0 THEN 'small' ELSE 'large' END) AS dataset, concat(root, '/cap3d') AS folder, count(*) AS files FROM r WHERE k % 11 <> 0 GROUP BY ALL")
def s37_datasets(spark, sf_dir):
    return discover.datasets(_files(spark, sf_dir))


@query(f"WITH {_FILES} SELECT concat('W', k) AS window_id, concat(root, '/labels_raphael/W', k) AS folder, k AS number FROM r WHERE k % 3 = 0 AND k % 4 <> 0")
def s37_window_folders(spark, sf_dir):
    return discover.window_folders(_files(spark, sf_dir)).select("window_id", "folder", F.col("number").cast("long").alias("number"))


@query(f"""WITH {_FILES}, a AS (SELECT root, 'cap3d' AS artifact FROM r UNION ALL SELECT root, 'labels_raphael' FROM r WHERE k % 3 = 0 UNION ALL SELECT DISTINCT root, 'windows.yaml' FROM r WHERE k % 5 = 0)
    SELECT root, artifact, count(*) AS files FROM a GROUP BY ALL""")
def f30_artifacts(spark, sf_dir):
    """What the folders of all datasets hold; stores lie elsewhere."""
    files = _files(spark, sf_dir)
    roots = files.select(F.regexp_extract("path", "^(/d/[^/]+/[^/]+)/", 1).alias("root")).where("root <> ''")
    return discover.artifacts(files, roots)


@query(f"WITH {_FILES} SELECT DISTINCT concat(root, '/gds.tmp') AS folder FROM r WHERE c % 9 = 0")
def f30_stale_folders(spark, sf_dir):
    return discover.stale(_files(spark, sf_dir))


@query("SELECT DISTINCT concat('/s/', o_custkey) AS store FROM orders WHERE o_custkey % 4 IN (0, 1)")
def s33_stores(spark, sf_dir):
    return discover.stores(_files(spark, sf_dir))


@query("""WITH d AS (SELECT c_custkey AS k FROM customer), f AS (SELECT DISTINCT o_custkey AS k FROM orders)
    SELECT d.k, CASE WHEN d.k % 6 = 5 THEN NULL WHEN d.k % 6 = 4 THEN concat('/b/g', d.k, '.def') WHEN f.k IS NOT NULL AND d.k % 2 = 0 THEN concat('/a/g', d.k, '.def') WHEN f.k IS NOT NULL THEN concat('/b/g', d.k, '.def') ELSE concat('g', d.k, '.def') END AS path
    FROM d LEFT JOIN f ON d.k = f.k""")
def j15_resolved_paths(spark, sf_dir):
    """Paths of designs, which lie below the first search root, the second, or both, or nowhere."""
    k = F.col("c_custkey")
    have = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct()
    files = have.where("k % 2 = 0").select(say("/a/g", F.col("k"), ".def").alias("path")).unionAll(have.select(say("/b/g", F.col("k"), ".def").alias("path")))
    raw = F.when(k % 6 == 5, "").when(k % 6 == 4, say("/b/g", k, ".def")).otherwise(say("g", k, ".def"))
    return discover.resolved(table(spark, sf_dir, "customer").select(k.alias("k"), raw.alias("raw")), files, ["/a", "/b/"]).select("k", "path")


@query("""WITH d AS (SELECT c_custkey AS k FROM customer), c AS (SELECT k, 0 AS i, concat('/t/n', k, '.lef') AS path FROM d WHERE k % 2 = 0 UNION ALL SELECT k, 1, concat('/t/node', k % 5, '.lef') FROM d WHERE k % 5 <> 4 UNION ALL SELECT k, 2, concat('/t/node', k % 5, '.tlef') FROM d WHERE k % 5 = 1)
    SELECT k AS design, CAST(row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS INTEGER) AS place, path FROM c""")
def j15_lef_files(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    files = c.where("c_custkey % 2 = 0").select(say("/t/n", k, ".lef").alias("path")).unionAll(c.where("c_custkey % 5 <> 4").select(say("/t/node", k % 5, ".lef").alias("path"))).unionAll(c.where("c_custkey % 5 = 1").select(F.lit("/t/node1.tlef").alias("path")))
    designs = c.select(k.alias("design"), say("/t/n", k, ".yaml").alias("stack"), say("Node", k % 5).alias("tech"))
    return discover.lef_files(designs, files)


@query("""SELECT concat('W', o_orderkey) AS window_id, a AS artifact, concat('/o/', a, '/W', o_orderkey, e) AS path FROM orders, (VALUES ('gds', '.gds'), ('def', '.def'), ('cap3d', '.cap3d'), ('point_clouds', '.npz'), ('density_maps', '')) t(a, e)""")
def j15_output_paths(spark, sf_dir):
    return discover.output_paths(table(spark, sf_dir, "orders").select(say("W", F.col("o_orderkey")).alias("window_id")), "/o/")
