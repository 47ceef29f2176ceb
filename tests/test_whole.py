"""Queries over all rows of small tables, each against plain Python."""

import re

from pyspark.sql import functions as F

from netquarry.operators import names, stats
from netquarry.registry import QUERIES


def run(spark, folder, name, **tables):
    """Rows of a query over tables given as (rows, schema)."""
    for t, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{t}.parquet")
    return sorted(map(tuple, QUERIES[name](spark, str(folder)).collect()))


def test_sanitized_reads_whole_texts(spark, tmp_path):
    texts = ["a-b " * 90 + "end; end: new.1", "", "  x", " ".join(f"w{i}" for i in range(20_000))]
    want = []
    for i, t in enumerate(texts):
        ws = t.split(" ")
        want.append((i, len(ws), len({re.sub("[^A-Za-z0-9_.]", "", w) or "NET" for w in ws})))
    assert run(spark, tmp_path, "f19_sanitized", documents=(list(enumerate(texts)), "doc_id long, text string")) == want


def test_sanitized_merges_rows_of_an_id(spark, tmp_path):
    spark.createDataFrame([(1, "a b-c"), (1, "bc d"), (2, "x"), (None, "p q"), (None, "q"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n, r.clean) for r in QUERIES["f19_sanitized"](spark, str(tmp_path)).collect()}
    assert got == {1: (4, 3), 2: (1, 1), None: (3, 2)}


def test_net_metadata_merges_all_orders(spark, tmp_path):
    data = [(k, n, p, s, f) for k, n, p, s, f in [(1, 1, 5, 7, "A"), (50, 2, 5, 7, "N"), (51, 3, 5, 7, "R"), (2, 4, 6, 8, "N"), (3, 4, 6, 8, "A"), (100, 1, 1, 9, "A"), (101, 10, 1, 9, "A")]]
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string"
    got = run(spark, tmp_path, "a30_net_metadata", lineitem=(data, schema))
    assert got == [(7, "POWER", "1,2,3"), (8, "CLOCK", "4"), (9, "SIGNAL", "1,10")]


def test_net_metadata_keeps_nets_without_connections(spark):
    rows = spark.createDataFrame([("a", "CLOCK", 2, ["y", "x", None]), ("a", "SIGNAL", 1, ["x"]), ("b", "GROUND", 1, []), (None, None, 1, None)], "net string, use string, seq int, connections array<string>")
    got = {r.net: (r.use, r.connections) for r in stats.merge_net_metadata(rows).collect()}
    assert got == {"a": ("SIGNAL", [None, "x", "y"]), "b": ("GROUND", []), None: (None, [])}


def test_pins_of_all_parts_are_bound(spark, tmp_path):
    parts = [(k, f"Brand#{k % 5 + 1}{k % 3 + 1}", k % 7) for k in range(55, 200)]
    custs = [(c, c % 25) for c in range(1, 40)]
    want = []
    for c, n in custs:
        for k, brand, s in parts:
            if brand == f"Brand#{c % 5 + 1}{n % 5 + 1}":
                pin = f"P{s % 3}"
                own = pin == f"P{c % 3}"
                want.append((c, pin, f"net{c // 10}" if own else f"__lef__/{c}/{pin}", not own, float(c + k % 4)))
    got = run(spark, tmp_path, "j12_bound_pins", part=(parts, "p_partkey long, p_brand string, p_size int"), customer=(custs, "c_custkey long, c_nationkey long"))
    assert got == sorted(want) and len(got) > 0


def test_every_global_index_is_located(spark, tmp_path):
    turns = [(w, t) for w, n in ((4, 3), (1, 2500), (9, 1)) for t in range(n)]
    want = [(i, w, p) for i, (w, p) in enumerate(sorted(turns))]
    assert run(spark, tmp_path, "l06_global_index", conversations=(turns, "conv_id long, turn int")) == want


def test_indices_end_with_the_table(spark, tmp_path):
    assert run(spark, tmp_path, "l06_global_index", conversations=([], "conv_id long, turn int")) == []
    spark.range(1_000_003).selectExpr("id div 500000 as conv_id", "cast(id % 500000 as int) as turn").write.parquet(f"{tmp_path}/long/conversations.parquet")
    got = QUERIES["l06_global_index"](spark, f"{tmp_path}/long")
    assert got.count() == 1_000_003 and got.where("index = 1000002").first()["place"] == 2


def test_nets_of_all_placements(spark, tmp_path):
    orders, custs = [(k, k * 13 % 97) for k in range(1, 60)], [(c, c % 7) for c in range(1, 30)]
    present = {(n % 5, f"c{c % 50}") for c, n in custs}
    want = {(w, k) for k, c in orders for w in {w for w, _ in present} if (w, f"c{c % 50}") in present or k % 7 == 0}
    got = run(spark, tmp_path, "j08_nets_of_components", orders=(orders, "o_orderkey long, o_custkey long"), customer=(custs, "c_custkey long, c_nationkey long"))
    assert got == sorted(want)


def test_regrouped_nets_of_all_orders(spark, tmp_path):
    orders = [(5, 5), (10, 45), (7, 2), (1, 80), (3, 40)]
    got = run(spark, tmp_path, "r23_regrouped_nets", orders=(orders, "o_orderkey long, o_custkey long"))
    assert got == [("n0", 0, "n0.1"), ("n0", 1, "n0.2"), ("n2", 1, "n2"), ("n5", 1, "n5.1"), ("n5", 2, "n5.2")]


def test_abbreviated_rounds_like_python(spark):
    def text(p):
        for d, s in ((1e9, "B"), (1e6, "M"), (1e3, "K")):
            if abs(p) >= d:
                return f"{p / d:.1f}{s}"
        return f"{p:.0f}"

    prices = [1250.0, 1350.0, 1150.0, -1750.0, 2050.0, 999.99, 0.5, 1.5, 999_950.0, 1.25e6, 2.25e9, *[k * 50.0 for k in range(4000)], *[k * 50 + 0.01 for k in range(2000)]]
    d = spark.createDataFrame(list(enumerate(prices)), "i int, p double")
    assert [r[1] for r in sorted(d.select("i", names.abbreviated(F.col("p"))).collect())] == list(map(text, prices))
