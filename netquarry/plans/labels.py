"""Queries over label sets, couplings and their comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare, labels, sets
from . import base
from .base import CAPS, LABELS, query, r6, rounded, table

_ERR = f"WITH {LABELS}, e AS (SELECT window_id, net, a, b, abs(b - a) AS abs_err, b - a AS diff, abs(b - a) / greatest(abs(a), 1e-20) AS rel_err FROM labels_ab)"


def _errors(spark, sf_dir):
    a, b = base.labels(spark, sf_dir)
    return compare.errors(a, b, ["window_id", "net"])


@query(f"{_ERR} SELECT window_id, net, round(a, 6) AS a, round(b, 6) AS b, round(abs_err, 6) AS abs_err, round(diff, 6) AS diff, round(rel_err, 6) AS rel_err FROM e")
def j04_compare_totals(spark, sf_dir):
    return rounded(_errors(spark, sf_dir), "a", "b", "abs_err", "diff", "rel_err")


@query(f"""{_ERR} SELECT count(*) AS n, round(avg(rel_err), 6) AS mean, round(median(rel_err), 6) AS median, round(stddev_pop(rel_err), 6) AS std,
    round(avg(abs(rel_err)), 6) AS mean_abs, round(max(rel_err), 6) AS max, round(min(rel_err), 6) AS min FROM e""")
def a07_error_summary(spark, sf_dir):
    return rounded(compare.summary(_errors(spark, sf_dir), "rel_err"), "mean", "median", "std", "mean_abs", "max", "min")


@query(f"""{_ERR} SELECT count(*) FILTER (rel_err < 0.01) AS below_1, count(*) FILTER (rel_err >= 0.01 AND rel_err < 0.05) AS below_5,
    count(*) FILTER (rel_err >= 0.05 AND rel_err < 0.1) AS below_10, count(*) FILTER (rel_err >= 0.1) AS rest FROM (SELECT round(rel_err, 9) AS rel_err FROM e)""")
def a09_error_histogram(spark, sf_dir):
    return compare.histogram(_errors(spark, sf_dir).withColumn("rel_err", F.round("rel_err", 9)))


@query(f"{_ERR} SELECT window_id, count(*) AS n, round(avg(rel_err), 6) AS mean, round(median(rel_err), 6) AS median FROM e GROUP BY window_id")
def a10_window_errors(spark, sf_dir):
    return _errors(spark, sf_dir).groupBy("window_id").agg(F.count("*").alias("n"), r6(F.avg("rel_err")).alias("mean"), r6(F.median("rel_err")).alias("median"))


@query(f"{_ERR} SELECT window_id, net, round(rel_err, 6) AS rel_err FROM e ORDER BY round(rel_err, 6) DESC, window_id, net LIMIT 5")
def t01_worst_errors(spark, sf_dir):
    return compare.worst(_errors(spark, sf_dir).select("window_id", "net", r6("rel_err").alias("rel_err")), 5, "window_id", "net")


@query("""WITH k AS (SELECT o_orderkey AS window_id FROM orders), l AS (SELECT DISTINCT l_orderkey AS window_id FROM lineitem WHERE l_quantity > 25)
    SELECT coalesce(k.window_id, l.window_id) AS window_id, CASE WHEN k.window_id IS NOT NULL AND l.window_id IS NOT NULL THEN 'both' WHEN k.window_id IS NOT NULL THEN 'a' ELSE 'b' END AS side
    FROM k FULL JOIN l ON k.window_id = l.window_id""")
def j06_exclusive_windows(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("window_id"))
    b = table(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("window_id"))
    return compare.coverage(a, b, "window_id")


@query(f"WITH {CAPS} SELECT window_id, net, round(coalesce(sum(value_f) FILTER (node_b IS NULL), 0), 6) AS ground_f, round(coalesce(sum(value_f) FILTER (node_b IS NOT NULL), 0), 6) AS coupling_f FROM caps GROUP BY window_id, net")
def a01_ground_and_coupling(spark, sf_dir):
    return rounded(labels.ground_and_coupling(base.caps(spark, sf_dir)), "ground_f", "coupling_f")


@query("SELECT l_orderkey AS window_id, l_linenumber AS net, arg_max(l_extendedprice, struct_pack(a := l_partkey, b := l_suppkey, c := l_extendedprice)) AS total_f FROM lineitem GROUP BY ALL")
def a02_net_totals(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    seq = F.struct(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_extendedprice").alias("c"))
    return labels.net_totals(li.select(F.col("l_orderkey").alias("window_id"), F.col("l_linenumber").alias("net"), F.col("l_extendedprice").alias("total_f"), seq.alias("seq")))


@query(f"WITH {CAPS} SELECT window_id, net_lo, net_hi, round(value_f, 6) AS value_f FROM pairs")
def a03_directional_pairs(spark, sf_dir):
    return rounded(labels.directional_pairs(base.caps(spark, sf_dir)), "value_f")


@query("""WITH RECURSIVE o AS (SELECT user_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    f AS (SELECT user_id, k, v FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.k, (f.v + o.v) / 2 FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)
    SELECT user_id, round(arg_max(v, k), 6) AS value_f FROM f GROUP BY user_id""")
def a04_folded_pairs(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", F.col("value").alias("value_f"), F.struct("ts", "event_id").alias("seq"))
    return rounded(labels.folded_pairs(ev, ["user_id"]), "value_f")


@query("""WITH RECURSIVE o AS (SELECT user_id, value AS v, event_type = 'purchase' AS m, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    f AS (SELECT user_id, k, v FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.k, CASE WHEN o.m OR abs(f.v) < abs(o.v) THEN o.v ELSE f.v END FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)
    SELECT user_id, round(arg_max(v, k), 6) AS value_f FROM f GROUP BY user_id""")
def a05_folded_self(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", F.col("value").alias("value_f"), F.struct("ts", "event_id").alias("seq"), (F.col("event_type") == "purchase").alias("is_master"))
    return rounded(labels.folded_self(ev, ["user_id"]), "value_f")


@query(f"""WITH {CAPS}, c AS (SELECT window_id, sum(2 * value_f) AS coupling_sum FROM pairs GROUP BY 1), s AS (SELECT window_id, sum(value_f) AS self_sum FROM selfs GROUP BY 1)
    SELECT s.window_id, round(self_sum, 6) AS self_sum, round(coalesce(coupling_sum, 0), 6) AS coupling_sum, round(abs(self_sum - coalesce(coupling_sum, 0)), 6) AS gap,
    round(abs(self_sum - coalesce(coupling_sum, 0)) / abs(self_sum) + 1e-10, 6) AS ratio FROM s LEFT JOIN c ON s.window_id = c.window_id""")
def a06_discrepancy(spark, sf_dir):
    found = labels.discrepancy(base.selfs(spark, sf_dir), labels.directional_pairs(base.caps(spark, sf_dir)))
    return rounded(found, "self_sum", "coupling_sum", "gap").withColumn("ratio", r6(F.col("ratio") + 1e-10))


_WITH_SELFS = f"WITH {CAPS}, w AS (SELECT p.*, coalesce(x.value_f, 0) AS self_lo, coalesce(y.value_f, 0) AS self_hi FROM pairs p LEFT JOIN selfs x ON x.window_id = p.window_id AND x.net = net_lo LEFT JOIN selfs y ON y.window_id = p.window_id AND y.net = net_hi)"


@query(f"{_WITH_SELFS} SELECT window_id, net_lo, net_hi, round(value_f, 6) AS value_f FROM w WHERE value_f >= 0.2501 * self_lo OR value_f >= 0.2501 * self_hi")
def f08_threshold_any(spark, sf_dir):
    return rounded(labels.threshold_pairs(labels.directional_pairs(base.caps(spark, sf_dir)), base.selfs(spark, sf_dir), "any", 0.2501), "value_f")


@query(f"{_WITH_SELFS} SELECT window_id, net_lo, net_hi, round(value_f, 6) AS value_f FROM w WHERE value_f >= 0.1501 * self_lo AND value_f >= 0.1501 * self_hi")
def f09_threshold_both(spark, sf_dir):
    return rounded(labels.threshold_pairs(labels.directional_pairs(base.caps(spark, sf_dir)), base.selfs(spark, sf_dir), "both", 0.1501), "value_f")


@query(f"{_WITH_SELFS} SELECT window_id, count(*) AS considered, count(*) FILTER (NOT (value_f >= 0.2501 * self_lo OR value_f >= 0.2501 * self_hi)) AS removed FROM w GROUP BY window_id")
def f08_threshold_counts(spark, sf_dir):
    return labels.threshold_counts(labels.directional_pairs(base.caps(spark, sf_dir)), base.selfs(spark, sf_dir), "any", 0.2501)


@query(f"WITH {CAPS} SELECT window_id, net_lo, net_hi, round(value_f, 6) AS value_f FROM pairs WHERE abs(value_f) >= 20 AND net_lo NOT IN ('N1') AND net_hi NOT IN ('N1')")
def f07_magnitude_filter(spark, sf_dir):
    return rounded(labels.magnitude_filter(labels.directional_pairs(base.caps(spark, sf_dir)), 20.0, ("N1",)), "value_f")


@query(f"WITH {CAPS} SELECT window_id, net_lo, net_hi, round(arg_max(value_f, seq), 6) AS value_f FROM (SELECT *, least(node_a, node_b) AS net_lo, greatest(node_a, node_b) AS net_hi FROM caps WHERE node_b IS NOT NULL) GROUP BY ALL")
def s20_last_write_pairs(spark, sf_dir):
    return rounded(labels.last_write_pairs(base.caps(spark, sf_dir).where("node_b is not null")), "value_f")


@query(f"""WITH {CAPS}, b AS (SELECT window_id, least(node_a, node_b) AS net_lo, greatest(node_a, node_b) AS net_hi, min(value_f) AS v FROM caps WHERE node_b IS NOT NULL GROUP BY ALL)
    SELECT p.window_id, p.net_lo, p.net_hi, round(p.value_f, 6) AS a, round(v, 6) AS b, round(abs(v - p.value_f) / greatest(abs(p.value_f), 1e-20), 6) AS rel_err FROM pairs p JOIN b USING (window_id, net_lo, net_hi)""")
def j05_compare_couplings(spark, sf_dir):
    rows = base.caps(spark, sf_dir)
    low = labels.with_pair(rows.where("node_b is not null")).groupBy("window_id", "net_lo", "net_hi").agg(F.min("value_f").alias("value_f"))
    found = compare.errors(labels.directional_pairs(rows), low, ["window_id", "net_lo", "net_hi"])
    return rounded(found.select("window_id", "net_lo", "net_hi", "a", "b", "rel_err"), "a", "b", "rel_err")


@query("""WITH p AS (SELECT d.doc_id, CAST(quality AS DOUBLE) AS t, CAST(toxic AS DOUBLE) + n_chars / 10000.0 AS p FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
    SELECT round(avg((p - t) ** 2), 6) AS mse, round(avg(((p - t) / (t + 2)) ** 2), 6) AS msre, round(avg(abs((p - t) / (t + 2))), 6) AS mare, round(sqrt(avg((p - t) ** 2)), 6) AS rmse FROM p""")
def a32_loss_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = rows.select(F.col("quality").cast("double").alias("target"), (F.col("toxic").cast("double") + F.col("n_chars") / 10000.0).alias("prediction"))
    return rounded(rows.agg(*compare.loss_metrics(eps=2.0)), "mse", "msre", "mare", "rmse")


@query("""WITH p AS (SELECT d.doc_id // 100 AS batch, CAST(quality AS DOUBLE) AS t, CAST(toxic AS DOUBLE) + n_chars / 10000.0 AS p FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
    m AS (SELECT batch, count(*) AS n, avg((p - t) ** 2) AS mse, avg(((p - t) / (t + 2)) ** 2) AS msre, avg(abs((p - t) / (t + 2))) AS mare, sqrt(avg((p - t) ** 2)) AS rmse FROM p GROUP BY 1)
    SELECT round(sum(mse * n) / sum(n), 6) AS mse, round(sum(msre * n) / sum(n), 6) AS msre, round(sum(mare * n) / sum(n), 6) AS mare, round(sum(rmse * n) / sum(n), 6) AS rmse FROM m""")
def a33_batch_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = rows.select(F.expr("doc_id div 100").alias("batch"), F.col("quality").cast("double").alias("target"), (F.col("toxic").cast("double") + F.col("n_chars") / 10000.0).alias("prediction"))
    return rounded(compare.batch_weighted(rows.groupBy("batch").agg(F.count("*").alias("n"), *compare.loss_metrics(eps=2.0))), "mse", "msre", "mare", "rmse")


@query("SELECT doc_id AS key FROM documents INTERSECT SELECT item_id FROM benchmark")
def u01_common_keys(spark, sf_dir):
    return sets.common(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key")), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key")))


@query("SELECT doc_id AS key FROM documents EXCEPT SELECT item_id FROM benchmark")
def u01_only_keys(spark, sf_dir):
    return sets.only(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key")), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key")))


@query("SELECT key FROM (SELECT doc_id AS key FROM documents UNION ALL SELECT item_id FROM benchmark) GROUP BY key HAVING count(*) = 1")
def u04_once_keys(spark, sf_dir):
    return sets.once(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key")), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key")))


@query(f"WITH {CAPS} SELECT window_id, net FROM selfs UNION SELECT window_id, net_lo FROM pairs UNION SELECT window_id, net_hi FROM pairs")
def u05_nets(spark, sf_dir):
    return sets.nets_of(base.selfs(spark, sf_dir), labels.directional_pairs(base.caps(spark, sf_dir)))
