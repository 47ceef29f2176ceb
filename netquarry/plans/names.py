"""Queries over names and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import names
from .base import query, table

_WORDS = "w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents)"


def _words(docs):
    return docs.select("doc_id", F.explode(F.split("text", " ")).alias("word"))


@query("SELECT p_partkey, lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) AS key FROM part")
def f21_layer_key(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", names.layer_key(F.col("p_brand")).alias("key"))


@query("""WITH n AS (SELECT p_partkey, lower(CASE p_size % 8 WHEN 0 THEN concat('MET_', p_size) WHEN 1 THEN concat('x_via', p_size) WHEN 2 THEN 'npPoly' WHEN 3 THEN 'licon1' WHEN 4 THEN concat('M0', p_size) WHEN 5 THEN concat('metal', p_size, '_fill')
      WHEN 6 THEN 'Contact' ELSE 'nwell' END) AS n FROM part)
    SELECT p_partkey, CASE WHEN contains(n, 'poly') THEN 'poly' WHEN contains(n, 'licon') OR contains(n, 'contact') THEN 'contact' WHEN regexp_matches(n, '(metal|met|m)\\s*[0-9]') THEN concat('metal', CAST(regexp_extract(n, '(?:metal|met|m)\\s*([0-9]+)', 1) AS INTEGER))
      WHEN regexp_matches(n, '(via|v)\\s*[0-9]') THEN concat('via', CAST(regexp_extract(n, '(?:via|v)\\s*([0-9]+)', 1) AS INTEGER)) END AS layer FROM n""")
def f22_def_layer(spark, sf_dir):
    n = F.col("p_size")
    given = [F.concat(F.lit("MET_"), n), F.concat(F.lit("x_via"), n), F.lit("npPoly"), F.lit("licon1"), F.concat(F.lit("M0"), n), F.concat(F.lit("metal"), n, F.lit("_fill")), F.lit("Contact"), F.lit("nwell")]
    name = F.element_at(F.array(*given), n % 8 + 1)
    return table(spark, sf_dir, "part").select("p_partkey", names.def_layer(name).alias("layer"))


@query("SELECT o_orderkey, concat('net', o_custkey % 50) AS base FROM orders")
def f23_base_net(spark, sf_dir):
    name = F.concat(F.lit("net"), F.col("o_custkey") % 50, F.lit("."), F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", names.base_net(name).alias("base"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN concat('a', k) WHEN 1 THEN concat('a_', k, '_') WHEN 2 THEN concat('b', k, '.c[x]') ELSE concat('Net.', k) END AS name, o_orderkey % 4 = 3 AS made_up FROM (SELECT o_orderkey, o_orderkey % 9 AS k FROM orders)""")
def f27_bracket_index(spark, sf_dir):
    k, way = F.col("o_orderkey") % 9, (F.col("o_orderkey") % 4 + 1).cast("int")
    raw = F.element_at(F.array(F.concat(F.lit(" a["), k, F.lit("]")), F.concat(F.lit("a_"), k, F.lit("_")), F.concat(F.lit("b\\["), k, F.lit("\\].c[x] ")), F.concat(F.lit("Net.["), k, F.lit("]"))), way)
    return table(spark, sf_dir, "orders").select("o_orderkey", names.bracket_index(raw).alias("name"), names.is_generic(raw).alias("made_up"))


@query(f"WITH {_WORDS} SELECT doc_id, count(*) AS n, count(DISTINCT CASE WHEN s = '' THEN 'NET' ELSE s END) AS clean FROM (SELECT doc_id, regexp_replace(word, '[^A-Za-z0-9_.]', '', 'g') AS s FROM w) GROUP BY 1")
def f19_sanitized(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    # Words are counted within the row; only those of ids with several rows have to meet.
    again = docs.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select(F.col("doc_id").alias("_id"))
    n_again = again.count()
    words = F.split("text", " ")
    count = lambda d: d.select("doc_id", F.size(words).cast("long").alias("n"), F.size(F.array_distinct(F.transform(words, names.sanitized))).cast("long").alias("clean"))
    if n_again == 0:
        return count(docs)
    again = F.broadcast(again) if n_again < 200_000 else again
    same = docs["doc_id"].eqNullSafe(again["_id"])
    met = _words(docs.join(again, same, "left_semi")).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct(names.sanitized(F.col("word"))).alias("clean"))
    return count(docs.join(again, same, "left_anti")).unionAll(met)


_MARKED = "p AS (SELECT p_brand AS window_id, concat('n', p_size % 5, ['$', '/', '[', ''][p_partkey % 4 + 1]) AS name, p_partkey AS seq, p_size % 3 = 0 AS s FROM part)"


def _marked(spark, sf_dir):
    mark = F.element_at(F.array(F.lit("$"), F.lit("/"), F.lit("["), F.lit("")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("window_id"), F.concat(F.lit("n"), F.col("p_size") % 5, mark).alias("name"), F.col("p_partkey").alias("seq"), (F.col("p_size") % 3 == 0).alias("s"))


# The names that fall together are told apart by number in order of their first row; none of the numbered names is taken.
_UNIQUE = """u AS (SELECT window_id, name, CASE WHEN r = 0 THEN c ELSE concat(c, '_', r) END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY window_id, c ORDER BY seq) - 1 AS r
    FROM (SELECT window_id, name, regexp_replace(name, '[^A-Za-z0-9_.]', '', 'g') AS c, min(seq) AS seq FROM {rows} GROUP BY ALL)))"""


@query(f"WITH {_MARKED}, {_UNIQUE.format(rows='p')} SELECT window_id, name, seq, unique_name FROM p JOIN u USING (window_id, name)")
def f19_unique_names(spark, sf_dir):
    return names.unique_names(_marked(spark, sf_dir), "window_id", "name", "seq").select("window_id", "name", "seq", "unique_name")


@query(f"""WITH {_MARKED}, r AS (SELECT * FROM p WHERE NOT s), {_UNIQUE.format(rows='r')}
    SELECT window_id, seq, CASE WHEN s THEN concat('__internal__.', CAST(sum(CAST(s AS INTEGER)) OVER (PARTITION BY window_id ORDER BY seq) AS VARCHAR)) ELSE unique_name END AS canonical FROM p LEFT JOIN u USING (window_id, name)""")
def f20_internal_names(spark, sf_dir):
    return names.internal_names(_marked(spark, sf_dir), "window_id", "name", "s", "seq").select("window_id", "seq", "canonical")


@query("""WITH r AS (SELECT o_orderkey, o_custkey % 9 AS c, o_orderkey % 7 AS k FROM orders)
    SELECT o_orderkey, CASE k WHEN 0 THEN concat('N', c) WHEN 1 THEN concat('N', c) WHEN 2 THEN concat('n', c) WHEN 3 THEN 'ZZ' WHEN 4 THEN concat('low', c) WHEN 5 THEN concat('N', c) ELSE concat('low', c) END AS resolved FROM r""")
def f24_name_ladder(spark, sf_dir):
    k, c = (F.col("o_orderkey") % 7 + 1).cast("int"), F.col("o_custkey") % 9
    # Exact; before the dot; lower case, which no known name has; unknown; lower case of a lower name; without dots; both.
    given = [F.concat(F.lit("N"), c), F.concat(F.lit("N"), c, F.lit(".x")), F.concat(F.lit("n"), c), F.lit("ZZ"), F.concat(F.lit("LOW"), c), F.concat(F.lit(".N"), c), F.concat(F.lit("L.OW"), c)]
    known = spark.range(9).select(F.explode(F.array(F.concat(F.lit("N"), F.col("id")), F.concat(F.lit("low"), F.col("id")))).alias("net"))
    return names.aligned(table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(F.array(*given), k).alias("name")), known, "name").select("o_orderkey", "resolved")


# Labels by supplier under names of two spellings that align to one.
_SPELLED = """l AS (SELECT l_orderkey AS w, l_suppkey % 5 AS i, CASE WHEN l_linenumber % 2 = 0 THEN '.x' ELSE '' END AS a, l_suppkey % 4 AS j, l_quantity AS v FROM lineitem)"""


@query(f"WITH {_SPELLED} SELECT w AS window_id, concat('N', i) AS net, round(sum(v), 4) AS value_f FROM l GROUP BY ALL")
def f24_aligned_totals(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    net = F.concat(F.lit("N"), F.col("l_suppkey") % 5, F.when(F.col("l_linenumber") % 2 == 0, ".x").otherwise(""))
    selfs = li.select(F.col("l_orderkey").alias("window_id"), net.alias("net"), F.col("l_quantity").alias("value_f"))
    known = spark.range(5).select(F.concat(F.lit("N"), F.col("id")).alias("net"))
    totals, _ = names.aligned_labels(selfs, spark.createDataFrame([], "window_id long, net_lo string, net_hi string, value_f double, seq int"), known)
    return totals.select("window_id", "net", F.round("value_f", 4).alias("value_f"))


@query("""WITH r AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN concat('N', o_custkey % 9) WHEN 1 THEN concat('N', o_custkey % 9, ':3') WHEN 2 THEN concat('N', o_custkey % 9, '/a') WHEN 3 THEN concat('N', o_custkey % 9, '\\b') ELSE 'Q:N1' END AS name FROM orders)
    SELECT o_orderkey, CASE WHEN name LIKE 'N%' THEN substr(name, 1, 2) END AS resolved FROM r""")
def f25_endpoint_ladder(spark, sf_dir):
    k, n = F.col("o_orderkey") % 5, F.concat(F.lit("N"), F.col("o_custkey") % 9)
    name = F.when(k == 0, n).when(k == 1, F.concat(n, F.lit(":3"))).when(k == 2, F.concat(n, F.lit("/a"))).when(k == 3, F.concat(n, F.lit("\\b"))).otherwise("Q:N1")
    known = spark.range(9).select(F.concat(F.lit("N"), F.col("id")).alias("net"))
    return names.ladder(table(spark, sf_dir, "orders").select("o_orderkey", name.alias("name")), known, "name", names.ENDPOINT).select("o_orderkey", "resolved")


@query("SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN 'GROUND' WHEN n_nationkey < 9 THEN 'POWER' ELSE 'SIGNAL' END AS use FROM nation")
def f33_supply_nets(spark, sf_dir):
    given = [F.lit(n) for n in ("vss", "VSSPE", "vgnd", "Gnd", "GROUND", "VDD", "vddpe", "VPWR", "power", "VCC")]
    name = F.coalesce(F.get(F.array(*given), F.col("n_nationkey").cast("int")), F.col("n_name"))
    return table(spark, sf_dir, "nation").select("n_nationkey", names.supply(name).alias("use"))


@query("SELECT event_id, CASE event_type WHEN 'purchase' THEN 'RWCap' WHEN 'click' THEN 'raphael,' END AS solver FROM events")
def f34_solver(spark, sf_dir):
    c = F.when(F.col("event_type") == "purchase", "made by Solver: RWCap 2").when(F.col("event_type") == "click", "solver=raphael, rwcap no").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", names.solver_of(c).alias("solver"))


@query("SELECT o_orderkey, CASE WHEN abs(v) >= 1e9 THEN format('{:.1f}B', v / 1e9) WHEN abs(v) >= 1e6 THEN format('{:.1f}M', v / 1e6) WHEN abs(v) >= 1e3 THEN format('{:.1f}K', v / 1e3) ELSE format('{:.0f}', v) END AS text FROM (SELECT o_orderkey, o_totalprice * [1, -1, 1e-3, 25, 1e4][o_orderkey % 5 + 1] AS v FROM orders)")
def s29_abbreviated(spark, sf_dir):
    scale = F.element_at(F.array(*map(F.lit, (1.0, -1.0, 1e-3, 25.0, 1e4))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", names.abbreviated(F.col("o_totalprice") * scale).alias("text"))


@query("SELECT o_orderkey, o_orderkey % 37 AS number FROM orders")
def t03_window_number(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", names.window_number(F.concat(F.lit("W"), F.col("o_orderkey") % 37)).cast("long").alias("number"))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<p>')) AS INTEGER) AS blocks, CAST(len(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))) AS INTEGER) AS nets FROM pages")
def s36_tag_counter(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_count("html", F.lit("<p>")).alias("blocks"), F.size(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))).alias("nets"))


@query("SELECT doc_id, array_to_string(regexp_extract_all(text, '\\(([^)]+)\\)', 1), ';') AS pairs FROM documents")
def s06_coordinate_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.regexp_extract_all("text", F.lit(r"\(([^)]+)\)"), F.lit(1)), ";").alias("pairs"))
