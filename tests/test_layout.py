"""Macro pins, DEF rasters, samples served from a store, exports."""

import pytest
from pyspark.sql import functions as F

from netquarry import serve
from netquarry.operators import layout, raster
from netquarry.sinks import export, shards
from netquarry.sources import catalog

SPEF = "*C_UNIT 1 FF\n\n*NAME_MAP\n*1 NET_A\n*2 NET_B\n\n*D_NET *1 3\n*CAP\n1 *1 3\n2 *1 *2 0.5\n*END\n*D_NET *2 4\n*CAP\n1 *2 4\n2 *2 *1 0.5\n*END\n"


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_orientations_keep_rectangles_inside(spark):
    want = {"N": (1, 0, 2, 1), "S": (2, 2, 3, 3), "FN": (2, 0, 3, 1), "FS": (1, 2, 2, 3), "E": (0, 2, 1, 3), "W": (2, 1, 3, 2), "FE": (0, 1, 1, 2), "FW": (2, 2, 3, 3)}
    d = spark.createDataFrame([(o,) for o in want], "o string")
    got = d.select("o", *[c.alias(n) for c, n in zip(layout.transformed(F.col("o"), F.lit(4), F.lit(3), F.lit(1), F.lit(0), F.lit(2), F.lit(1)), layout.COLS, strict=True)]).collect()
    for r in got:
        w, h = (3, 4) if r.o in ("E", "W", "FE", "FW") else (4, 3)
        assert 0 <= r.x0 < r.x1 <= w and 0 <= r.y0 < r.y1 <= h and (r.x1 - r.x0) * (r.y1 - r.y0) == 1
    by = {r.o: (r.x0, r.y0, r.x1, r.y1) for r in got}
    assert by["N"] == want["N"] and by["S"] == want["S"] and by["FN"] == want["FN"] and by["FS"] == want["FS"]


def test_pins_and_raster(spark):
    comp = spark.createDataFrame([("u1", "INV", 10.0, 0.0, "N", 4.0, 4.0)], "component string, cell string, x double, y double, orient string, w double, h double")
    pins = spark.createDataFrame([("INV", "A", "m1", 0.0, 0.0, 1.0, 1.0), ("INV", "Z", "m1", 2.0, 2.0, 4.0, 4.0)], "macro string, pin string, layer string, x0 double, y0 double, x1 double, y1 double")
    nets = spark.createDataFrame([("u1", "A", "n0", 1), ("u1", "A", "n1", 2)], "component string, pin string, net string, seq int")
    bound = layout.bound_pins(comp, pins, nets)
    assert rows(bound, "conductor", "synthetic", "x0", "x1") == [("__lef__/u1/Z", True, 12.0, 14.0), ("n1", False, 10.0, 11.0)]
    windows = spark.createDataFrame([("W0", 10.0, 0.0, 14.0, 4.0)], "window_id string, w_x0 double, w_y0 double, w_x1 double, w_y1 double")
    r = layout.to_raster(bound.withColumn("seq", F.lit(0)), windows, 4, 5.0)
    assert raster.paint(r).count() == 5
    assert rows(layout.window_clip(bound, windows, 5.0), "conductor", "x0", "y1") == [("__lef__/u1/Z", 2.0, 4.0), ("n1", 0.0, 1.0)]
    assert layout.wide_enough(bound, spark.createDataFrame([("m1", 2.0)], "layer string, wmin double")).count() == 1
    assert layout.recipes(pins.withColumn("use", F.lit("SIGNAL"))).count() == 2


def test_probes_and_shells(spark):
    clusters = spark.createDataFrame([(1, "m1", 0.0, 0.0, 1.0, 1.0), (2, "m1", 5.0, 5.0, 6.0, 6.0)], "cluster int, layer string, c_x0 double, c_y0 double, c_x1 double, c_y1 double")
    probes = spark.createDataFrame([("a", "m1", 1.0, 1.0)], "name string, layer string, px double, py double")
    assert rows(layout.probed_names(clusters, probes, 2.0), "cluster", "name") == [(1, "a"), (2, "Net.1")]
    shapes = spark.createDataFrame([("w", "m1", 1, 2.0, 2.0, 4.0, 4.0)], "window_id string, layer string, seq int, x0 double, y0 double, x1 double, y1 double")
    profile = spark.createDataFrame([("m1", 0.0, 1.0, 5.0)], "layer string, etch double, thickness double, er double")
    bounds = spark.createDataFrame([("w", 0.0, 0.0, 9.0, 9.0)], "window_id string, b_x0 double, b_y0 double, b_x1 double, b_y1 double")
    assert layout.conformal_shells(shapes, profile, bounds).count() == 4


@pytest.fixture()
def store(spark, tmp_path):
    names = ["W0", "W1", "W2", "W3"]
    windows = spark.createDataFrame([(w, ["M1", "M2"], [True, True], 2, 2, {"NET_A": 1, "NET_B": 2}) for w in names], "window_id string, layer_names array<string>, layer_has_density array<boolean>, height int, width int, conductor_id_map map<string,int>")
    pixels = spark.createDataFrame([p for w in names for p in ((w, 0, 0, 0, 0.5, 1), (w, 1, 1, 1, 0.75, 2))], "window_id string, layer int, y int, x int, density double, cid long")
    shards.write(pixels, windows, str(tmp_path / "s"), 2)
    files = spark.createDataFrame([(w, "rwcap", f"/l/{w}.spef", SPEF) for w in names[:3]] + [("W3", "rwcap", "/l/W3.spef", "")], "window_id string, solver string, path string, text string")
    return str(tmp_path / "s"), files


def test_self_samples_and_highlight(spark, store):
    d = serve.load(spark, *store, "self")
    assert rows(d.samples.where("window_id = 'W0'"), "pos_id", "neg_id", "target") == [(1, 0, pytest.approx(3.0)), (2, 0, pytest.approx(4.0))]
    t = d.tensors(d.samples.where("window_id = 'W0'"), 2, 2, 2).collect()
    by = {r.pos_id: r.features for r in t}
    assert by[1][0] == 1.5 and by[1][7] == 0.75 and by[2][0] == 0.5 and by[2][7] == 1.75
    assert rows(d.ranges(), "window_id", "start", "end") == [("W0", 0, 2), ("W1", 2, 4), ("W2", 4, 6)]


def test_coupling_samples_and_splits(spark, store):
    d = serve.load(spark, *store, "coupling")
    assert rows(d.samples.where("window_id = 'W1'"), "pos_id", "neg_id", "target") == [(1, 2, pytest.approx(0.5))]
    f = {(r.layer, r.y, r.x): r.feature for r in d.features(d.samples.where("window_id = 'W1'")).collect()}
    assert f == {(0, 0, 0): 1.5, (1, 1, 1): -0.75}
    assert d.cases().where("window_id = 'W1' and master = 1").first()["slaves"][0]["valid"]
    parts = d.split(train=0.67, val=0.0, seed=0)
    assert parts["train"].samples.count() == 2 and parts["test"].samples.count() == 1
    assert d.batches(1, 3).count() == 3
    ids = serve.load(spark, *store, "coupling", ids_as_density=True)
    assert {abs(r.feature) for r in ids.features(ids.samples).collect()} == {2.0, 1.0}


def test_exports(spark, tmp_path):
    d = spark.createDataFrame([("a", 1.5), ("b", None)], "name string, v double")
    assert export.markdown(d) == "| name | v |\n|---|---|\n| a | 1.5 |\n| b | n/a |\n"
    export.to_csv(d, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    designs = spark.createDataFrame([("a", "g", "d", "s", "t", "l")], "name string, gds string, def string, stack string, tech_node string, layermap string")
    windows = spark.createDataFrame([("a", "W0", 0, "small", 0.0, 0.0, 1.0, 1.0)], "design string, name string, position int, size_category string, x1 double, y1 double, x2 double, y2 double")
    text = export.window_yaml(windows, designs).first()["text"]
    assert rows(catalog.windows(spark, text), "window_id", "original_name", "x2") == [("W0", "W0", 1.0)]


RASTER_LEF = """MACRO INV
  CLASS CORE ;
  SIZE 4 BY 2 ;
  PIN A
    USE SIGNAL ;
    LAYER metal1 ;
    RECT 0 0 1 1 ;
  END A
  PIN Y
    LAYER metal1 ;
    RECT 3 0 4 1 ;
  END Y
  PIN VDD
    USE POWER ;
    LAYER metal1 ;
    RECT 0 1.5 4 2 ;
  END VDD
  OBS
    LAYER metal2 ;
    RECT 1 1 2 2 ;
    RECT 3 1 4 2 ;
    RECT 2 1 3 2 ;
    RECT 0 0 0.5 0.5 ;
  END
END INV
"""
RASTER_DEF = """DESIGN top ;
UNITS DISTANCE MICRONS 1000 ;
COMPONENTS 1 ;
- u1 INV + PLACED ( 2000 2000 ) FN ;
END COMPONENTS
NETS 1 ;
- b ( u1 A ) ( PIN x )
  + ROUTED metal2 1000 ( 1000 6500 ) ( 6000 6500 )
  ;
END NETS
SPECIALNETS 2 ;
- VDD ( * VDD )
  + ROUTED metal1 1000 ( 500 500 ) ( 7500 500 ) ;
- GROUND ( * VSS )
  + ROUTED metal1 1000 ( 500 7500 ) ( 7500 7500 ) ;
END SPECIALNETS
"""


def test_def_raster(spark):
    from netquarry.sources import lefdef

    one = lambda text: spark.createDataFrame([("/in/W0.txt", "W0", text)], "path string, window_id string, text string")
    design, macros = lefdef.read_def(one(RASTER_DEF)).cache(), lefdef.read_lef(one(RASTER_LEF)).cache()
    windows = spark.createDataFrame([("W0", 0.0, 0.0, 8.0, 8.0)], "window_id string, w_x0 double, w_y0 double, w_x1 double, w_y1 double")
    for fed in (False, True):
        pixels, conductors = layout.def_raster(design, macros, windows, ["metal1", "metal2"], 8, fed)
        names = {r.cid: (r.conductor, r.synthetic) for r in conductors.collect()}
        real = ["GROUND", "VDD", "b"] if fed else ["VDD", "b"]
        made = ["PIN_Y", *([] if fed else ["SUPPLY_POWER"]), "OBS0", "OBS1"]
        assert list(map(names.get, range(1, len(names) + 1))) == [(n, False) for n in real] + [(f"__lef__/u1/{m}", True) for m in made]
        got = {(r.layer, r.y, r.x): names[r.cid][0].split("/")[-1] for r in pixels.collect()}
        want = {}
        paint = lambda layer, xs, ys, name: want.update({(layer, y, x): name for x in xs for y in ys})
        paint(1, range(0, 7), [6], "b")  # ends are extended by half the width
        paint(0, range(8), [0], "VDD")
        if fed:
            paint(0, range(8), [7], "GROUND")
        # Mirrored in x: A at the right, Y at the left.
        paint(0, [5], [2], "b")
        paint(0, [2], [2], "PIN_Y")
        paint(0, range(2, 6), [3], "VDD" if fed else "SUPPLY_POWER")
        paint(1, range(2, 5), [3], "OBS0")
        paint(1, [5], [2], "OBS1")
        assert got == want


def test_def_raster_refuses_quarter_turns(spark):
    from netquarry.sources import lefdef

    one = lambda text: spark.createDataFrame([("/in/W0.txt", "W0", text)], "path string, window_id string, text string")
    for bad, why in ((RASTER_DEF.replace(") FN", ") E"), "orientation"), (RASTER_DEF.replace("u1 INV", "u1 XOR"), "unknown macro")):
        rects = layout.def_rects(lefdef.read_def(one(bad)), lefdef.read_lef(one(RASTER_LEF)))
        with pytest.raises(Exception, match=why):
            rects.collect()
