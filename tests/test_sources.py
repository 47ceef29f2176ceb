"""Parsers, solver scans and writers on small hand-written texts."""

import pytest
from pyspark.sql import functions as F

from netquarry.operators import labels, samples
from netquarry.sinks import shards, text as text_sink
from netquarry.sources import cap3d, catalog, lefdef, solver, spef
from netquarry.sources.text import lines, read_files

SPEF = """*SPEF "IEEE 1481-1998"
*COMMENT "made by RWCap"
*COMMENT "second"
*C_UNIT 1 FF

*NAME_MAP
*1 NET_A
*2 "NET_B"

*D_NET *1 3
*CAP
1 *1 3
2 *1:3 *2:1 0.5
*END

*D_NET *2 4
*CONN
*P x
*CAP
1 *2 4
2 *2 *1 0.5
3 *2 *1 bad
*END
"""


def files(spark, **texts):
    return spark.createDataFrame([(f"/x/{k}.txt", k, v) for k, v in texts.items()], "path string, window_id string, text string")


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda r: tuple((v is None, v) if not isinstance(v, (str, type(None))) else (v is None, v or "") for v in r))


def test_spef(spark):
    r = spef.read_spef(files(spark, W0=SPEF, W1="")).cache()
    assert rows(spef.nets(r), "net", "total_f") == [("NET_A", pytest.approx(3e-15)), ("NET_B", pytest.approx(4e-15))]
    assert [x[:3] for x in rows(spef.caps(r), "net", "node_a", "node_b") if x[2]] == [("NET_A", "NET_A:3", "NET_B:1"), ("NET_B", "NET_B", "NET_A"), ("NET_B", "NET_B", "NET_A")]
    assert ("COMMENT", "made by RWCap") in rows(spef.headers(r), "key", "value")
    ends = rows(spef.resolved_caps(r).where("node_b is not null"), "node_a", "node_b")
    assert ends[0] == ("NET_A", "NET_B")
    pairs = labels.directional_pairs(spef.resolved_caps(r)).collect()
    assert [(p.net_lo, p.net_hi, round(p.value_f * 1e15, 6)) for p in pairs] == [("NET_A", "NET_B", 0.5)]
    conductors = spark.createDataFrame([("W0", "NET_A", 1), ("W0", "NET_B", 2)], "window_id string, net string, cid int")
    selfs = spef.nets(r).select("window_id", "net", F.col("total_f").alias("value_f"), "seq")
    assert rows(samples.self_samples(selfs, conductors), "pos_id", "neg_id", "target") == [(1, 0, pytest.approx(3.0)), (2, 0, pytest.approx(4.0))]
    both = samples.coupling_samples(labels.directional_pairs(spef.resolved_caps(r)).withColumn("seq", F.lit(0)), conductors)
    assert rows(both, "pos_id", "neg_id", "target") == [(1, 2, pytest.approx(0.5))]


def test_spef_round_trip(spark):
    selfs = spark.createDataFrame([("W0", "a", 3e-15), ("W0", "b", 4e-15)], "window_id string, net string, value_f double")
    pairs = spark.createDataFrame([("W0", "a", "b", 5e-16), ("W0", "GROUND", "b", 1e-16)], "window_id string, net_lo string, net_hi string, value_f double")
    text = text_sink.spef(selfs, pairs, "d").first()["text"]
    back = spef.read_spef(files(spark, W0=text)).cache()
    assert rows(spef.nets(back), "net", "total_f") == [("a", pytest.approx(3e-15)), ("b", pytest.approx(4e-15))]
    assert rows(spef.caps(back).where("node_b is not null"), "net", "node_a", "node_b") == [("a", "a", "b"), ("b", "b", "GROUND")]
    twice = text_sink.spef(selfs, pairs, "d", both_ends=True).first()["text"]
    assert spef.caps(spef.read_spef(files(spark, W0=twice))).where("node_b is not null").count() == 3
    assert spef.simple_couplings(files(spark, W0=text)).count() == 1


def test_rwcap(spark):
    text = """Task a: start
Master a : 1e-15 F
Capacitance on a = 2e-15 F
Capacitance on b = -4e-16 F
Capacitance on GROUND = -1e-16 F
Task b: start
Master b : 3e-15 F
Capacitance on a = -2e-16 F
Task a: again
Capacitance on b = -1e-16 F
Capacitance on c = -1e-20 F
"""
    selfs, pairs = solver.rwcap_nets(files(spark, W0=text), 1e-19)
    assert rows(selfs, "net", "value_f") == [("a", 2e-15), ("b", 3e-15)]
    assert rows(pairs, "net_lo", "net_hi", "value_f") == [("GROUND", "a", 1e-16), ("a", "b", pytest.approx(2e-16))]
    assert solver.rwcap_nets(files(spark, W0=text), 0.0, ("GROUND",))[1].count() == 2


def test_rwcap_blocks_and_raphael(spark):
    selfs, pairs = solver.rwcap_blocks(files(spark, W0="CIRCUIT c\nBLOCK NUMBER 2\nC 1 1 2.0 1%\nC 1 1 -3.0 1%\nC 1 2 -1.0 1%\nC 2 1 2.0 1%\n"))
    assert rows(selfs, "net", "value_f") == [(1, -3.0)]
    assert rows(pairs, "net_lo", "net_hi", "value_f") == [(1, 2, 1.5)]
    totals, pairs = solver.raphael_nets(files(spark, W0="*|NET a 3e-15\nC1 a b 1e-15\nC2 b c 9e-15\n*|GROUND x\n*|NET b 2e-15\nC3 a b 3e-15\nC4 a\n"))
    assert rows(totals, "net", "value_f") == [("a", 3e-15), ("b", 2e-15)]
    assert rows(pairs, "net_lo", "net_hi", "value_f") == [("a", "b", pytest.approx(2e-15))]


CAP3D = """<!-- comment -->
<layer>
name M1
id 0
type metal
</layer>
<window>
v1(0, 0, 0)
v2(2, 2, 2)
dirichlet
</window>
<medium>
name ox
<block>
name m0
basepoint(0, 0, 0)
v1(2, 0, 0)
v2(0, 2, 0)
hvector(0, 0, 1)
</block>
diel 3.9
</medium>
<conductor>
name NET_A
<block>
name b0
layer 0
basepoint(0.5, 0.5, 0)
v1(1, 0, 0)
v2(0, 1, 0)
hvector(0, 0, 0.5)
</block>
<block>
name broken
basepoint(0, 0, 0)
</block>
</conductor>
<task>
<capacitance>
NET_A
</capacitance>
</task>
"""


def test_cap3d(spark):
    r = cap3d.read_cap3d(files(spark, W8=CAP3D)).cache()
    assert rows(r.where("kind = 'block'"), "section", "parent", "name", "diel") == [("conductor", "NET_A", "b0", None), ("medium", "ox", "m0", 3.9)]
    assert rows(cap3d.compact(r), "parent", "layer_name", "conductor_idx", "x0", "y0", "x1", "y1") == [("NET_A", "M1", 0, 0.5, 0.5, 1.5, 1.5)]
    assert cap3d.stats(r).first()["conductor_blocks"] == 1
    assert cap3d.ground_net(r).first()["ground"] == "NET_A" and cap3d.master_net(r).first()["master"] == "NET_A"
    w = cap3d.window(r)
    assert w.first()["type"] == "dirichlet"
    layers = r.where("kind = 'layer'").select("window_id", "id", "name", "type")
    text = text_sink.cap3d(cap3d.blocks(r), layers, w).first()["text"]
    again = cap3d.read_cap3d(files(spark, W8=text))
    assert rows(cap3d.compact(again), "parent", "x0", "x1") == [("NET_A", 0.5, 1.5)]
    assert rows(again.where("kind = 'target'"), "name") == [("NET_A",)]


def test_cap3d_with_media_and_ground(spark):
    vec = lambda *v: [float(x) for x in v]
    cols = "window_id string, parent string, name string, layer int, seq long, base array<double>, v1 array<double>, v2 array<double>, hvec array<double>"
    blocks = spark.createDataFrame([("W0", "n", "1", 1, 1, vec(1, 1, 0.5), vec(2, 0, 0), vec(0, 1, 0), vec(0, 0, 0.25))], cols)
    media = spark.createDataFrame([("W0", "conf", "0", 2, 0, vec(0, 0, 0.5), vec(4, 0, 0), vec(0, 4, 0), vec(0, 0, 0.1), 3.5)], cols + ", diel double")
    plates = spark.createDataFrame([("W0", "high", 4.0, 2.0), ("W0", "low", 2.5, 0.4)], "window_id string, name string, diel double, z_top double")
    layers = spark.createDataFrame([("W0", 1, "M1", "metal"), ("W0", 2, "ox", "interconnect")], "window_id string, id int, name string, type string")
    extents = spark.createDataFrame([("W0", 0.0, 0.0, 10.0, 20.0)], "window_id string, x0 double, y0 double, x1 double, y1 double")
    windows, ground = text_sink.with_margins(extents, plates.groupBy("window_id").agg(F.max("z_top").alias("z_top")))
    text = text_sink.cap3d(blocks.unionByName(ground), layers, windows, plates, media).first()["text"]
    r = cap3d.read_cap3d(files(spark, W0=text)).cache()
    near = lambda v: [round(x, 3) for x in v]
    assert near(cap3d.window(r).first()["v1"]) == [-1.0, -2.0, -0.01] and near(cap3d.window(r).first()["v2"]) == [11.0, 22.0, 2.0]
    g = cap3d.blocks(r).where("parent = 'GROUND'").first()
    assert near(g["base"]) == [-1.0, -2.0, -0.01] and near(g["v1"]) == [12.0, 0, 0] and near(g["v2"]) == [0, 24.0, 0] and near(g["hvec"]) == [0, 0, 0.1]
    assert cap3d.ground_net(r).first()["ground"] == "GROUND" and rows(r.where("kind = 'target'"), "name") == [("n",)]
    assert rows(r.where("kind = 'plate_medium'"), "name", "diel", "z_top") == [("high", 4.0, 2.0), ("low", 2.5, 0.4)]
    m = cap3d.blocks(r, "medium").first()
    assert (m["parent"], m["diel"], near(m["hvec"])) == ("conf", 3.5, [0, 0, 0.1])
    # What was read can be written again.
    kept = r.where("kind = 'block'").withColumnRenamed("diel", "er").withColumn("diel", F.col("er"))
    again = text_sink.cap3d(kept.where("section = 'conductor'"), r.where("kind = 'layer'").select("window_id", "id", "name", "type"), cap3d.window(r), r.where("kind = 'plate_medium'"), kept.where("section = 'medium'"))
    assert again.first()["text"] == text


def test_bad_file_is_a_row(spark):
    r = cap3d.read_cap3d(files(spark, W0=CAP3D.replace("v1(1, 0, 0)", "v1(1, x, 0)"), W1=CAP3D))
    assert [x.window_id for x in r.where("error is not null").collect()] == ["W0"]
    assert r.where("window_id = 'W1' and kind = 'block'").count() == 2


DEF = """VERSION 5.7 ;
DESIGN top ;
UNITS DISTANCE MICRONS 1000 ;
DIEAREA ( 0 0 ) ( 10000 20000 ) ;
ROW R0 site 0 1400 N DO 10 BY 1 STEP 380 0 ;
COMPONENTS 2 ;
- u1 INV + PLACED ( 1000 1400 ) N ;
- u2 INV ;
END COMPONENTS
NETS 1 ;
- n1 ( u1 A ) ( PIN x )
  + ROUTED metal1 140 ( 1000 1000 ) ( 3000 * )
  NEW metal2 ( 3000 1000 ) ( * 5000 )
  + USE CLOCK
  ;
END NETS
SPECIALNETS 1 ;
- VSS ( * VSS )
  + ROUTED metal1 WIDTH 200 ( 0 0 ) ( 10000 0 ) ;
END SPECIALNETS
"""


def test_def_and_lef(spark):
    r = lefdef.read_def(files(spark, d=DEF)).cache()
    assert rows(r.where("kind = 'component'"), "name", "x", "y", "orient") == [("u1", 1.0, 1.4, "N")]
    assert rows(r.where("kind = 'net'"), "name", "use", "special") == [("VSS", "GROUND", True), ("n1", "CLOCK", False)]
    routes = rows(r.where("kind = 'route'"), "name", "layer", "width", "points")
    assert routes == [("VSS", "metal1", 0.2, [0.0, 0.0, 10.0, 0.0]), ("n1", "metal1", 0.14, [1.0, 1.0, 3.0, 1.0]), ("n1", "metal2", None, [3.0, 1.0, 3.0, 5.0])]
    box = lefdef.route_rects(r.where("width is not null")).where("net = 'n1'").first()
    assert (round(box.x0, 3), round(box.y0, 3), round(box.x1, 3), round(box.y1, 3)) == (0.93, 0.93, 3.07, 1.07)
    lef = "MACRO INV # c\n  CLASS CORE ;\n  SIZE 1.5 BY 2 ;\n  PIN A\n    USE SIGNAL ;\n    PORT\n      LAYER metal1 ;\n        RECT 0 0 1 1 ;\n    END\n  END A\n  OBS\n    LAYER metal1 ;\n    RECT 1 1 2 2 ;\n  END\nEND INV\n"
    m = lefdef.read_lef(files(spark, a=lef, b=lef.replace("1.5 BY 2", "3 BY 4"))).cache()
    assert rows(lefdef.macro_sizes(m), "cell", "w", "h") == [("INV", 3.0, 4.0)]
    assert rows(lefdef.macro_classes(m), "cell", "cell_class") == [("INV", "CORE")]
    assert rows(m.where("kind in ('pin_rect', 'obs_rect') and path like '%a.txt'"), "kind", "pin", "x1") == [("obs_rect", None, 2.0), ("pin_rect", "A", 1.0)]


def test_catalog(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"datasets": [{"dataset_id": "n/large", "process_node": "N", "artifacts": {"cap3d": "c"}}, {"dataset_id": "n/small", "process_node": "N", "sources": [{"name": "s"}]}]}')
    r = catalog.registry(spark, str(tmp_path / "r.json"))
    assert [x.dataset_id for x in catalog.select_datasets(r, "n").collect()] == ["n/small", "n/large"]
    assert [x.dataset_id for x in catalog.select_datasets(r, "n/large").collect()] == ["n/large"]
    assert r.where("dataset_id = 'n/small'").first()["sources"][0]["kind"] == "zip"
    assert catalog.missing_artifacts(r, spark.createDataFrame([], "dataset_id string, path string")).count() == 1
    (tmp_path / "m.layermap").write_text("11/0 : metal1 (11/0)\n12 : Via1  # no type\n# only a comment\n")
    assert rows(catalog.layermap(read_files(spark, str(tmp_path / "m.layermap"))), "layer_name", "gds", "dtype") == [("Via1", 12, 0), ("metal1", 11, 0)]
    w = catalog.windows(spark, "designs:\n- {name: a, gds: g, def: d, stack: s, layermap: l, windows: [{name: x, x1: 0, y1: 0, x2: 1, y2: 1}]}\n- {name: b, gds: g, def: d, stack: s, layermap: l, windows: [{name: x, x1: 0, y1: 0, x2: 1, y2: 1}]}\n")
    assert rows(w, "window_id", "design") == [("W0", "a"), ("W1", "b")]
    with pytest.raises(ValueError):
        catalog.windows(spark, "designs:\n- {name: a}\n")


def test_shards(spark, tmp_path):
    names = ["W0", "W1", "W2", "W3"]
    windows = spark.createDataFrame([(w, ["M1", "M2"], [True, True], 2, 2, i) for i, w in enumerate(names)], "window_id string, layer_names array<string>, layer_has_density array<boolean>, height int, width int, at int")
    pixels = spark.createDataFrame([(w, 0, 0, 0, 0.5, 1) for w in names], "window_id string, layer int, y int, x int, density double, cid long")
    index = shards.write(pixels, windows.where("at < 3"), str(tmp_path / "a"), 2, arrival="at")
    assert rows(index, "window_id", "shard_id") == [("W0", 0), ("W1", 0), ("W2", 1)]
    index = shards.write(pixels, windows, str(tmp_path / "b"), 2, seed=0)
    assert {frozenset(w for w, s in rows(index, "window_id", "shard_id") if s == k) for k in (0, 1)} == {frozenset({"W0", "W2"}), frozenset({"W1", "W3"})}
    assert shards.window_pixels(spark, str(tmp_path / "b"), "W3").first()["density"] == 0.5
    with pytest.raises(ValueError):
        shards.write(pixels, windows.union(windows.limit(1)), str(tmp_path / "c"), 2)


def test_shards_are_added_in_batches(spark, tmp_path):
    path = str(tmp_path / "s")
    windows = lambda *ids: spark.createDataFrame([(w, ["M1"], [True], 2, 2) for w in ids], "window_id string, layer_names array<string>, layer_has_density array<boolean>, height int, width int")
    pixels = lambda *ids: spark.createDataFrame([(w, 0, 0, 0, 0.5, k + 1) for k, w in enumerate(ids)], "window_id string, layer int, y int, x int, density double, cid long")
    assert not shards.is_store(spark, path)
    shards.append(pixels("a", "b", "c"), windows("a", "b", "c"), path, 2)
    index = shards.append(pixels("e", "d"), windows("e", "d"), path, 2)
    assert rows(index, "window_id", "shard_id", "shard_offset") == [("a", 0, 0), ("b", 0, 1), ("c", 1, 0), ("d", 1, 1), ("e", 2, 0)]
    with pytest.raises(ValueError):
        shards.append(pixels("f", "a"), windows("f", "a"), path, 2)
    # A batch whose pixels were written but whose index wasn't doesn't count, and may come again.
    spark.read.parquet(f"{path}/pixels").where("window_id = 'a'").withColumns({"window_id": F.lit("g"), "batch": F.lit("lost"), "cid": F.lit(99).cast("long")}).write.mode("append").partitionBy("shard_id").parquet(f"{path}/pixels")
    assert shards.read(spark, path)[0].where("window_id = 'g'").count() == 0
    shards.append(pixels("g"), windows("g"), path, 2)
    assert shards.is_store(spark, path) and [r.cid for r in shards.window_pixels(spark, path, "g").collect()] == [1]


def test_compact_def(spark):
    text = DEF.replace("- u2 INV ;", "- u2 INV ;\n- u3 INV + PLACED ( oops 1400 ) N ;").replace("( 3000 * )", "( x 1000 ) ( 3000 * )")
    r = lefdef.read_def(files(spark, d=text), compact=True)
    assert rows(r.where("kind = 'component'"), "name", "x", "y") == [("u1", 1.0, 1.4), ("u2", 0.0, 0.0), ("u3", 0.0, 1.4)]
    assert rows(r.where("name = 'n1' and layer = 'metal1'"), "points") == [([1.0, 1.0, 0.0, 1.0, 3.0, 1.0],)]
    assert r.where("kind in ('row', 'via')").count() == 0 and lefdef.read_def(files(spark, d=DEF)).where("kind = 'row'").count() == 1


def test_run_times(spark):
    out = "Preparation cost: 1.5sec\nTask n1 initialization cost 0.25sec\nTask n1 random walk cost 2sec\nTask n2 initialization cost 0.5sec\nRWCap has run 1200 walks\nRWCap has run 9 walks\nElapsed time: 4.5sec\n"
    assert rows(solver.rwcap_times(files(spark, W0=out, W1="")), "window_id", "prep_s", "init_s", "walk_s", "walks", "nets", "total_s") == [("W0", 1.5, 0.75, 2.0, 1200, 2, 4.25), ("W1", 0.0, 0.0, 0.0, 0, 0, 0.0)]
    assert rows(solver.rwcap_outputs(files(spark, W0=out)), "walks", "elapsed_s") == [(9, 4.5)] and solver.rwcap_outputs(files(spark, W1="")).first()["walks"] is None
    dspf = "*|DSPF FILE: x/W12_Net3\n*|Raphael runtime: 2.5 s\n*|Raphael runtime: 1 s\n"
    assert rows(solver.raphael_times(files(spark, a=dspf)), "window_id", "runtime_s") == [("W12", 3.5)]


def test_tag_counter(spark):
    text = "<conductor>\n  name Net.1\n  <block>\n  name 7\n  </block>\n<block a>\n</conductor>\n<conductor>\nname Net.1\n</conductor>\nname outside\n<BLOCK>"
    r = cap3d.count_tags(files(spark, W0=text)).first()
    assert (r.blocks, r.nets, r.names) == (3, 1, ["Net.1"])


def test_gzip_and_lines(spark, tmp_path):
    import gzip

    (tmp_path / "W3.spef.gz").write_bytes(gzip.compress(SPEF.encode()))
    f = read_files(spark, str(tmp_path))
    assert [x.window_id for x in f.collect()] == ["W3"]
    assert spef.nets(spef.read_spef(f)).count() == 2
    assert lines(f).count() == SPEF.count("\n") + 1


def test_streaming(spark, tmp_path):
    from netquarry.streaming.ingest import current_totals, ingest_totals

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "W0.spef").write_text(SPEF)
    go = lambda: ingest_totals(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    go()
    (tmp_path / "in" / "W1.spef").write_text(SPEF.replace("*D_NET *1 3", "*D_NET *1 7"))
    go()
    go()
    assert rows(current_totals(spark, str(tmp_path / "out")), "window_id", "net", "total_f") == [("W0", "NET_A", pytest.approx(3e-15)), ("W0", "NET_B", pytest.approx(4e-15)), ("W1", "NET_A", pytest.approx(7e-15)), ("W1", "NET_B", pytest.approx(4e-15))]


def test_folders_are_listed_and_cleaned(spark, tmp_path):
    from netquarry.sources import discover

    for name in ("t/small/cap3d/W1.cap3d", "t/small/gds.tmp/x", "t/small/windows.yaml", "r/W2/all_nets.dspf", "r/W10/all_nets.dspf", "r/W3/else", "s/index.json"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    files = discover.listing(spark, str(tmp_path))
    assert files.count() == 7 and files.where("length <> 1").count() == 0
    assert rows(discover.datasets(files), "dataset", "files") == [("t_small", 1)]
    assert [r.window_id for r in discover.window_folders(files).orderBy("number").collect()] == ["W2", "W10"]
    assert rows(discover.stores(files), "store") == [(f"{tmp_path}/s",)]
    roots = spark.createDataFrame([(f"{tmp_path}/t/small",)], "root string")
    assert rows(discover.artifacts(files, roots), "artifact", "files") == [("cap3d", 1), ("windows.yaml", 1)]
    assert discover.remove_stale(spark, str(tmp_path)) == [f"{tmp_path}/t/small/gds.tmp"] and not (tmp_path / "t/small/gds.tmp").exists()
    assert discover.remove_stale(spark, str(tmp_path)) == [] and (tmp_path / "t/small/cap3d/W1.cap3d").exists()
