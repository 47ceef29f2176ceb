"""Registration of queries with their SQL, and the adapter views over the driver's tables.

Layout data do not occur in the tables, so each operator runs over a relation of its shape: label sets and
rectangles from ``lineitem``, ordered folds and logs from ``events``, stacks from ``part``, clouds from
``embeddings``, windows and samples from ``conversations``. Every view has its SQL twin beside it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name; ``sql`` gives the same rows and columns."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


# Label sets: window and net with two values each; the keys repeat in the table, so they are aggregated first.
LABELS = """labels_ab AS (SELECT l_orderkey AS window_id, l_linenumber AS net, max(l_extendedprice) AS a,
    max(l_extendedprice * (1 - l_discount)) AS b FROM lineitem GROUP BY ALL)"""


def labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("window_id"), F.col("l_linenumber").alias("net"))
    rows = rows.agg(F.max("l_extendedprice").alias("a"), F.max(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("b"))
    return rows.select("window_id", "net", F.col("a").alias("value_f")), rows.select("window_id", "net", F.col("b").alias("value_f"))


# Directional couplings: within a window each net reports one to each other net.
CAPS = """nets AS (SELECT l_orderkey AS window_id, concat('N', l_linenumber) AS net, max(l_quantity) AS q, max(l_tax) AS t FROM lineitem GROUP BY ALL),
caps AS (SELECT x.window_id, x.net AS net, x.net AS node_a, y.net AS node_b, least(x.q, y.q) * (1 + x.t) AS value_f,
    CAST(substr(x.net, 2) AS INTEGER) * 10 + CAST(substr(y.net, 2) AS INTEGER) AS seq
    FROM nets x JOIN nets y ON x.window_id = y.window_id AND x.net <> y.net
  UNION ALL SELECT window_id, net, net, NULL, q, CAST(substr(net, 2) AS INTEGER) * 10 FROM nets),
selfs AS (SELECT window_id, net, q * 4 AS value_f FROM nets),
pairs AS (SELECT window_id, net_lo, net_hi, avg(v) AS value_f FROM
  (SELECT window_id, least(node_a, node_b) AS net_lo, greatest(node_a, node_b) AS net_hi, net, sum(value_f) AS v FROM caps WHERE node_b IS NOT NULL GROUP BY ALL)
  GROUP BY ALL)"""


def nets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("window_id"), F.concat(F.lit("N"), F.col("l_linenumber").cast("string")).alias("net"))
    return rows.agg(F.max("l_quantity").alias("q"), F.max("l_tax").alias("t"))


def caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = nets(spark, sf_dir)
    y = x.select("window_id", F.col("net").alias("node_b"), F.col("q").alias("q_b"))
    number = lambda c: F.substring(c, 2, 9).cast("int")
    both = x.join(y, "window_id").where("net <> node_b")
    couplings = both.select("window_id", "net", F.col("net").alias("node_a"), "node_b", (F.least("q", "q_b") * (1 + F.col("t"))).alias("value_f"), (number("net") * 10 + number("node_b")).alias("seq"))
    ground = x.select("window_id", "net", F.col("net").alias("node_a"), F.lit(None).cast("string").alias("node_b"), F.col("q").alias("value_f"), (number("net") * 10).alias("seq"))
    return couplings.unionAll(ground)


def selfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nets(spark, sf_dir).select("window_id", "net", (F.col("q") * 4).alias("value_f"))


# Rectangles in paint order, in windows of a thousand orders: micrometre boxes and pixels of a 64 x 64 raster.
RECTS = """rects AS (SELECT l_orderkey // 1000 AS window_id, l_linenumber AS layer, l_suppkey AS cid,
    l_quantity AS x0, l_quantity + 1 + l_discount * 100 AS x1, CAST(day(l_shipdate) AS DOUBLE) AS y0, day(l_shipdate) + 1 + l_tax * 100 AS y1,
    struct_pack(a := l_orderkey, b := l_linenumber, c := l_partkey, d := l_suppkey, e := l_extendedprice) AS seq FROM lineitem),
px AS (SELECT *, CAST(least(greatest(floor(x0), 0), 64) AS INTEGER) AS px0, CAST(least(greatest(ceil(x1), 0), 64) AS INTEGER) AS px1,
    CAST(least(greatest(floor(y0), 0), 64) AS INTEGER) AS py0, CAST(least(greatest(ceil(y1), 0), 64) AS INTEGER) AS py1 FROM rects),
exploded AS (SELECT window_id, layer, cid, seq, y, unnest(range(px0, px1)) AS x FROM (SELECT *, unnest(range(py0, py1)) AS y FROM px WHERE layer >= 0 AND cid > 0 AND px0 < px1 AND py0 < py1)),
pixels AS (SELECT window_id, layer, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, arg_max(cid, seq) AS cid FROM exploded GROUP BY ALL)"""


def rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.geometry import pixels

    li = table(spark, sf_dir, "lineitem")
    day = F.dayofmonth("l_shipdate")
    rows = li.select(
        F.expr("l_orderkey div 1000").alias("window_id"), F.col("l_linenumber").alias("layer"), F.col("l_suppkey").alias("cid"),
        F.col("l_quantity").alias("x0"), (F.col("l_quantity") + 1 + F.col("l_discount") * 100).alias("x1"),
        day.cast("double").alias("y0"), (day + 1 + F.col("l_tax") * 100).alias("y1"),
        F.struct(F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b"), F.col("l_partkey").alias("c"), F.col("l_suppkey").alias("d"), F.col("l_extendedprice").alias("e")).alias("seq"),
    )
    px0, px1 = pixels(F.col("x0"), F.col("x1"), F.lit(0.0), F.lit(1.0), F.lit(64))
    py0, py1 = pixels(F.col("y0"), F.col("y1"), F.lit(0.0), F.lit(1.0), F.lit(64))
    return rows.withColumns({"px0": px0, "px1": px1, "py0": py0, "py1": py1})


def painted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.raster import paint

    return paint(rects(spark, sf_dir))
