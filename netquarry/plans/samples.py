"""Queries over samples, splits and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels, ranks, samples
from . import base
from .base import CAPS, query, rounded, table

# Conductors of a window: its nets with ids by name; net N4 has no conductor.
_CONDUCTORS = "conductors AS (SELECT window_id, net, row_number() OVER (PARTITION BY window_id ORDER BY net) AS cid FROM nets WHERE net <> 'N4')"
_CENTROIDS = "centroids AS (SELECT window_id, cid, cid * 7 % 5 AS d FROM conductors)"


def _conductors(spark, sf_dir):
    from ..operators.raster import dense_ids

    return dense_ids(base.nets(spark, sf_dir).where("net <> 'N4'").select("window_id", "net"), "net", ["window_id"])


@query("""SELECT window_id, CAST(row_number() OVER (PARTITION BY window_id ORDER BY net) AS INTEGER) AS pos_id, 0 AS neg_id, round(q * 4 * 1e15, 2) AS target
    FROM (SELECT l_orderkey AS window_id, concat('N', l_linenumber) AS net, max(l_quantity) AS q FROM lineitem GROUP BY ALL) WHERE net <> 'N4'""")
def j01_self_samples(spark, sf_dir):
    found = samples.self_samples(base.selfs(spark, sf_dir).withColumn("seq", F.lit(0)), _conductors(spark, sf_dir))
    return found.withColumn("target", F.round("target", 2))


_SAMPLES = f"""{CAPS}, {_CONDUCTORS}, {_CENTROIDS}, j AS (SELECT p.window_id, a.cid AS lo, b.cid AS hi, (a.cid * 7 % 5) AS d_lo, (b.cid * 7 % 5) AS d_hi, p.value_f FROM pairs p
    JOIN conductors a ON a.window_id = p.window_id AND a.net = net_lo JOIN conductors b ON b.window_id = p.window_id AND b.net = net_hi),
samples AS (SELECT window_id, CAST(CASE WHEN d_lo <= d_hi THEN lo ELSE hi END AS INTEGER) AS pos_id, CAST(CASE WHEN d_lo <= d_hi THEN hi ELSE lo END AS INTEGER) AS neg_id, value_f AS target FROM j)"""


def _samples(spark, sf_dir):
    conductors = _conductors(spark, sf_dir)
    at = conductors.select("window_id", "cid", (F.col("cid") * 7 % 5).alias("c_layer"), F.lit(0).alias("c_y"), F.lit(0).alias("c_x"))
    pairs = labels.directional_pairs(base.caps(spark, sf_dir)).withColumn("seq", F.lit(0))
    return samples.coupling_samples(pairs, conductors, at).withColumn("target", F.col("target") / samples.FEMTO)


@query(f"WITH {_SAMPLES} SELECT window_id, pos_id, neg_id, round(target, 6) AS target FROM samples")
def j02_coupling_samples(spark, sf_dir):
    return rounded(_samples(spark, sf_dir), "target")


@query(f"""WITH {_SAMPLES}, c AS (SELECT a.window_id, a.cid AS master, b.cid AS slave FROM conductors a JOIN conductors b ON a.window_id = b.window_id AND a.cid <> b.cid)
    SELECT c.window_id, CAST(master AS INTEGER) AS master, count(*) AS n, count(target) AS valid, round(sum(coalesce(target, 0)), 5) AS total,
    array_to_string(list(slave ORDER BY slave), ',') AS slaves FROM c LEFT JOIN samples s ON s.window_id = c.window_id AND least(pos_id, neg_id) = least(master, slave) AND greatest(pos_id, neg_id) = greatest(master, slave) GROUP BY ALL""")
def j20_grouped_cases(spark, sf_dir):
    cases = samples.grouped_cases(_conductors(spark, sf_dir), _samples(spark, sf_dir))
    return cases.select(
        "window_id", "master", F.size("slaves").cast("long").alias("n"), F.size(F.filter("slaves", lambda s: s["valid"])).cast("long").alias("valid"),
        F.round(F.aggregate("slaves", F.lit(0.0), lambda a, s: a + s["target"]), 5).alias("total"), F.array_join(F.transform("slaves", lambda s: s["slave"].cast("string")), ",").alias("slaves"),
    )


# Windows with samples: conversations and their turns.
def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("window_id"), F.col("turn").alias("sample"))


_OFFSETS = "o AS (SELECT window_id, n, CAST(sum(n) OVER (ORDER BY window_id) AS BIGINT) AS e FROM (SELECT conv_id AS window_id, count(*) AS n FROM conversations GROUP BY 1))"


@query(f'WITH {_OFFSETS} SELECT window_id, n, e - n AS start, e AS "end" FROM o')
def w04_offsets(spark, sf_dir):
    return samples.offsets(_turns(spark, sf_dir))


@query(f'WITH {_OFFSETS} SELECT i AS "index", window_id, i - (e - n) AS place FROM o JOIN (SELECT unnest(range(CAST(sum(n) AS BIGINT))) AS i FROM o) ON i >= e - n AND i < e')
def l06_global_index(spark, sf_dir):
    ranges = samples.offsets(_turns(spark, sf_dir))
    total = ranges.agg(F.max("end")).first()[0] or 0
    return samples.locate(spark.range(total).select(F.col("id").alias("index")), ranges)


@query("SELECT conv_id AS window_id, turn AS sample, CAST(k // 4 AS BIGINT) AS batch, CAST(k % 4 AS INTEGER) AS in_batch FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations)")
def l11_batches(spark, sf_dir):
    return samples.batches(_turns(spark, sf_dir), 4)


@query("""SELECT conv_id AS window_id, turn AS sample, CAST(k // 3 AS BIGINT) AS batch, CAST(k % 3 AS INTEGER) AS in_batch
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE (k // 3 + 1) * 3 <= n""")
def l11_batches_drop_last(spark, sf_dir):
    return samples.batches(_turns(spark, sf_dir), 3, drop_last=True)


@query("SELECT conv_id AS window_id, turn, CASE WHEN turn % 3 = 0 THEN concat('W', conv_id, ':', turn + 1) ELSE concat('W', conv_id, ':', turn + 1, '|', turn % 3) END AS label FROM conversations")
def l12_sample_labels(spark, sf_dir):
    name = samples.sample_label(F.concat(F.lit("W"), F.col("conv_id")), F.col("turn") + 1, F.col("turn") % 3)
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("window_id"), "turn", name.alias("label"))


@query("""SELECT n_nationkey, CAST(k // 4 AS INTEGER) AS shard_id, CAST(k % 4 AS INTEGER) AS shard_offset FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_name) - 1 AS k FROM nation)""")
def w05_shards(spark, sf_dir):
    order = ranks.numbered(table(spark, sf_dir, "nation"), ["n_name"], "position")
    return samples.shards(order, 4).select("n_nationkey", "shard_id", "shard_offset")


@query("""WITH w AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT conv_id FROM conversations)),
    c AS (SELECT CAST(floor(max(n) * 0.7) AS BIGINT) AS a, CAST(floor(max(n) * 0.15) AS BIGINT) AS b, max(n) AS n, CAST(sum(conv_id) AS BIGINT) AS ids FROM w)
    SELECT split, m AS n, ids FROM (SELECT unnest(['train', 'val', 'test']) AS split, unnest([a, b, n - a - b]) AS m, ids FROM c) WHERE m > 0""")
def l09_window_split(spark, sf_dir):
    """Windows of each split, and the sum of all splits' ids: each window is in one of them."""
    split = samples.split_windows(table(spark, sf_dir, "conversations"), key="conv_id")
    total = split.agg(F.sum("conv_id").alias("ids"))
    return split.groupBy("split").agg(F.count("*").alias("n")).join(F.broadcast(total))  # one row


@query("""SELECT conv_id AS window_id, count(DISTINCT CASE WHEN (conv_id + turn) % 7 < 4 OR conv_id % 3 = 0 THEN 'train' WHEN (conv_id + turn) % 7 = 4 THEN 'val' ELSE 'test' END) AS n
    FROM conversations GROUP BY 1 HAVING n > 1""")
def u03_leakage(spark, sf_dir):
    """Windows that leak: turns of a third of them all go to one split, those of the others where they may."""
    k = (F.col("conv_id") + F.col("turn")) % 7
    split = F.when((k < 4) | (F.col("conv_id") % 3 == 0), "train").when(k == 4, "val").otherwise("test")
    return samples.leaks(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("window_id"), split.alias("split")))


@query("""WITH w AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS k FROM (SELECT DISTINCT conv_id FROM conversations))
    SELECT count(*) AS n, min(k) AS least, max(k) AS most, CAST(sum(k) AS BIGINT) AS places, CAST(sum(conv_id) AS BIGINT) AS ids, count(*) > 3 AS moved FROM w""")
def k09_permuted_windows(spark, sf_dir):
    """Places of a seeded permutation of all windows: each place once, and not the order of ids."""
    order = samples.permutation(table(spark, sf_dir, "conversations"), 0, "numpy", "conv_id")
    straight = samples.permutation(table(spark, sf_dir, "conversations"), None, key="conv_id").withColumnRenamed("position", "k")
    both = order.join(straight, "conv_id")
    p = F.col("position")
    return both.agg(F.count_distinct("position").alias("n"), F.min(p).alias("least"), F.max(p).alias("most"), F.sum(p).alias("places"), F.sum("conv_id").alias("ids"), F.coalesce(F.bool_or(p != F.col("k")), F.lit(False)).alias("moved"))


@query("""SELECT p_partkey, CASE WHEN row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) <= floor(count(*) OVER (PARTITION BY p_brand) * 0.8) THEN 'train' ELSE 'test' END AS split FROM part""")
def l14_stratified_split(spark, sf_dir):
    return samples.stratified_split(table(spark, sf_dir, "part"), "p_brand", [F.col("p_retailprice"), F.col("p_partkey")]).select("p_partkey", "split")


@query("SELECT vec_id, CASE WHEN label = 1 THEN 1.0 WHEN label = 2 THEN -1.0 ELSE 0.0 END::DOUBLE AS flux FROM embeddings")
def f45_flux(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", samples.flux(F.col("label"), F.lit(1), F.lit(2)).alias("flux"))


@query("""WITH f AS (SELECT o_custkey AS window_id, CASE o_orderstatus WHEN 'F' THEN 'rwcap' WHEN 'O' THEN 'raphael' ELSE 'other' END AS solver, concat(o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '.spef.gz' ELSE '.spef' END) AS path FROM orders),
    r AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY CASE solver WHEN 'rwcap' THEN 1 ELSE 2 END, path LIKE '%.gz', path) AS k FROM f WHERE solver <> 'other')
    SELECT c_custkey AS window_id, solver, path FROM customer JOIN r ON window_id = c_custkey WHERE k = 1""")
def j03_label_files(spark, sf_dir):
    st, k = F.col("o_orderstatus"), F.col("o_orderkey")
    files = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("window_id"), F.when(st == "F", "rwcap").when(st == "O", "raphael").otherwise("other").alias("solver"),
        F.concat(k, F.when(k % 2 == 0, ".spef.gz").otherwise(".spef")).alias("path"),
    )
    return samples.label_files(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("window_id")), files)
