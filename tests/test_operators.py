"""Properties and edge cases of operators that the tables don't reach."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from netquarry.operators import components, geometry, labels, names, points, raster, samples, spatial, stack, stats, windows


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_fold_is_the_mean_of_two_only(spark):
    d = spark.createDataFrame([("p", 1, 4.0), ("p", 2, 2.0), ("q", 1, 4.0), ("q", 3, 0.0), ("q", 2, 2.0)], "k string, seq int, value_f double")
    assert rows(labels.folded_pairs(d, ["k"]), "k", "value_f") == [("p", 3.0), ("q", 1.5)]


def test_paint_against_loop(spark):
    rng = np.random.default_rng(3)
    rects = [(int(rng.integers(2)), int(rng.integers(3)), int(a), int(a + w), int(b), int(b + h), i) for i, (a, w, b, h) in enumerate(zip(*rng.integers(0, 6, (4, 60)), strict=True))]
    want = {}
    for layer, cid, x0, x1, y0, y1, _ in rects:
        for y in range(y0, y1):
            for x in range(x0, x1):
                if cid > 0:
                    want[layer, y, x] = cid
    d = spark.createDataFrame([("w", *r) for r in rects], "window_id string, layer int, cid int, px0 int, px1 int, py0 int, py1 int, seq int")
    for parts in (1, 5):
        got = {(r.layer, r.y, r.x): r.cid for r in raster.paint(d.repartition(parts)).collect()}
        assert got == want


def test_float_and_double_pixels_differ(spark):
    for kind, want in (("float", 3), ("double", 2)):
        lo, _ = geometry.pixels(F.lit(0.3), F.lit(0.4), F.lit(0.0), F.lit(0.1), F.lit(9), kind)
        assert spark.range(1).select(lo.alias("v")).first()["v"] == want


def test_highlight(spark):
    d = spark.createDataFrame([(0.5, 1), (0.75, 2), (0.0, 0)], "density double, cid int")
    one = [r[0] for r in d.select(raster.highlighted(F.col("density"), F.col("cid"), F.lit(1))).collect()]
    two = [r[0] for r in d.select(raster.highlighted(F.col("density"), F.col("cid"), F.lit(1), F.lit(2))).collect()]
    assert one == [1.5, 0.75, 0.0] and two == [1.5, -0.75, 0.0]


def test_polyline_pieces(spark):
    pts = [(-1.0, 0.5), (0.5, 0.5), (0.5, 2.0), (0.8, 2.0), (0.8, 0.2)]
    d = spark.createDataFrame([("n", [{"x": x, "y": y} for x, y in pts], 0.0, 0.0, 1.0, 1.0)], "net string, points array<struct<x:double,y:double>>, w_x0 double, w_y0 double, w_x1 double, w_y1 double")
    got = [[(round(p.x, 9), round(p.y, 9)) for p in r.points] for r in geometry.polyline_pieces(d, ["net"]).orderBy("piece").collect()]
    assert got == [[(0.0, 0.5), (0.5, 0.5), (0.5, 1.0)], [(0.8, 1.0), (0.8, 0.2)]]
    named = spatial.suffixed(geometry.polyline_pieces(d, ["net"]), [], "net", "piece")
    assert [r.piece_name for r in named.orderBy("piece").collect()] == ["n.1", "n.2"]


def test_touching_is_no_overlap(spark):
    a = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0)], "a_x0 double, a_y0 double, a_x1 double, a_y1 double")
    b = spark.createDataFrame([(1.0, 0.0, 2.0, 1.0), (0.5, 0.5, 3.0, 3.0)], "b_x0 double, b_y0 double, b_x1 double, b_y1 double")
    assert spatial.overlap_join(a, b, "a_", "b_", 0.3).count() == 1
    assert spatial.overlap_join(a, b, "a_", "b_", 0.3, closed=True).count() == 2


def test_unique_names_meet_taken_suffixes(spark):
    d = spark.createDataFrame([("w", "a/b", 1), ("w", "ab", 2), ("w", "ab_1", 3), ("w", "a-b", 4), ("w", "$", 5), ("w", "a.b", 6), ("w", "ab", 7)], "k string, n string, s int")
    assert rows(names.unique_names(d, "k", "n", "s"), "s", "unique_name") == [(1, "ab"), (2, "ab_1"), (3, "ab_1_1"), (4, "ab_2"), (5, "NET"), (6, "a.b"), (7, "ab_1")]


def test_internal_names(spark):
    d = spark.createDataFrame([("w", "n/1", False, 1), ("w", "x", True, 2), ("w", "n1", False, 3), ("w", "x", True, 4), ("w", "__internal__x", False, 5)], "k string, n string, y boolean, s int")
    assert rows(names.internal_names(d, "k", "n", "y", "s"), "s", "canonical") == [(1, "n1"), (2, "__internal__.1"), (3, "n1_1"), (4, "__internal__.2"), (5, "__internal__x")]


def test_reserved_name_raises(spark):
    d = spark.createDataFrame([("w", "__internal__/.1", False, 1)], "k string, n string, y boolean, s int")
    with pytest.raises(Exception, match="reserved"):
        names.internal_names(d, "k", "n", "y", "s").collect()


def of(spark, f, values):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in sorted(d.select("i", f(F.col("v"))).collect())]


def test_name_forms(spark):
    assert of(spark, names.def_layer, ["Poly2", "li_licon", "contact", "metal1_fill", "MET 007", "via12", "xv3", "nwell", None]) == ["poly", "contact", "contact", "metal1", "metal7", "via12", "via3", None, None]
    assert of(spark, names.sanitized, ["a/b", "net.1", "x[3]", " $", None]) == ["ab", "net.1", "x3", "NET", "NET"]
    assert of(spark, names.bracket_index, [" a\\[3\\] ", "a[3][12]", "a_3_", "a[x]", ""]) == ["a3", "a312", "a_3_", "a[x]", ""]
    assert of(spark, names.is_generic, ["", "  ", "Net.4", "SpecialNet.1", "__lef__/u1/A", "net.4", "__internal__.1", None]) == [True, True, True, True, True, False, False, True]
    assert of(spark, names.cloud_key, ["Top/U1\\A[3]{x}$ b", "plain_x"]) == ["topu1a3xb", "plain_x"]
    assert of(spark, names.supply, ["vddpe", "VPWR", "Power", "vsspe", "GND", "VCC", "clk"]) == ["POWER", "POWER", "POWER", "GROUND", "GROUND", "SIGNAL", "SIGNAL"]
    assert of(spark, names.solver_of, ["by SOLVER : rwcap v2", "solver=Raphael", "rwcap", None]) == ["rwcap", "Raphael", None, None]
    assert of(spark, lambda c: names.abbreviated(c.cast("double")), ["999", "0.5", "1.5", "1250", "-1250000", "1e9", "2.5e9"]) == ["999", "0", "2", "1.2K", "-1.2M", "1.0B", "2.5B"]


def test_aligned_labels(spark):
    known = spark.createDataFrame([("N3",), ("ab",)], "net string")
    got = names.aligned(spark.createDataFrame([(v,) for v in ("N3", "n3", "N3.x", "A.B", "a.b", "zz.1")], "net string"), known, "net")
    assert {r.net: r.resolved for r in got.collect()} == {"N3": "N3", "n3": "n3", "N3.x": "N3", "A.B": "ab", "a.b": "ab", "zz.1": "zz.1"}
    selfs = spark.createDataFrame([("w", "N3", 1.0), ("w", "N3.x", 2.0), ("w", "q", 4.0)], "window_id string, net string, value_f double")
    pairs = spark.createDataFrame([("w", "N3", "N3.x", 1.0, 1), ("w", "N3", "q", 2.0, 2), ("w", "N3.x", "q", 4.0, 3), ("w", "N3.y", "q", 5.0, 4)], "window_id string, net_lo string, net_hi string, value_f double, seq int")
    totals, met = names.aligned_labels(selfs, pairs, known)
    assert rows(totals, "net", "value_f") == [("N3", 3.0), ("q", 4.0)] and rows(met, "net_lo", "net_hi", "value_f") == [("N3", "q", 4.0)]


def test_unknown_orientation_raises(spark):
    d = spark.createDataFrame([("MXR90",), ("s",), ("FE",)], "o string")
    got = d.select(*geometry.oriented_size(F.col("o"), F.lit(2), F.lit(1))).collect()
    assert [tuple(r) for r in got] == [(1, 2), (2, 1), (1, 2)]
    with pytest.raises(Exception, match="unknown orientation"):
        spark.createDataFrame([("MX90",)], "o string").select(*geometry.oriented_size(F.col("o"), F.lit(2), F.lit(1))).collect()


def test_cell_grid(spark):
    xs = [0.0, 0.005, 0.76, 1.9, 1.9, 4.18]
    comps = spark.createDataFrame([("d", x) for x in xs] + [("e", 1.0)], "design string, x double")
    lines = spark.createDataFrame([("d", 1, 2.0, 0.0), ("d", 2, 8.0, 5.0), ("d", 3, 5.2, 5.0)], "design string, seq int, y double, step_y double")
    got = {r.design: r for r in geometry.cell_grid(comps, lines).collect()}
    # Distances 0.755, 1.14, 2.28 (0.005 is none): the GCD of 755, 1140, 2280 nm is 5.
    assert got["d"].pitch_x == 0.005 and got["d"].offset_x == 0.0 and got["d"].offset_y == 2.0 and got["d"].pitch_y == pytest.approx(2.8)
    assert tuple(got["e"])[1:] == (1.0, 0.0, 2.8, 0.38)


def test_polar_angles_are_of_quotients(spark):
    d = spark.createDataFrame([(1.0, 1.0, -1.0), (-1.0, 1.0, 0.0)], "x double, y double, z double")
    a, b = points.polar(d).collect()
    assert a.theta == pytest.approx(-0.9553166) and a.phi == pytest.approx(0.7853982)
    assert b.theta == pytest.approx(1.5707963) and b.phi == pytest.approx(-0.7853982)


def test_design_metrics_and_coverage(spark):
    cells = spark.createDataFrame([("d", c) for c in ("ram", "pad", "inv", "tap", "none")], "design string, cell string")
    classes = spark.createDataFrame([("ram", "BLOCK"), ("pad", "PAD INPUT"), ("inv", "core"), ("tap", "CORE WELLTAP")], "cell string, cell_class string")
    assert rows(stats.design_metrics(cells, classes, cells.limit(2)), "macros", "std_cells", "nets") == [(2, 3, 2)]
    wins = spark.createDataFrame([("d", 0.0, 0.0, 2.0, 1.0), ("d", 3.0, 0.0, 1.0, 9.0), ("e", 0.0, 0.0, 1.0, 1.0)], "design string, x1 double, y1 double, x2 double, y2 double")
    dies = spark.createDataFrame([("d", 0.0, 0.0, 4.0, 1.0), ("e", 0.0, 0.0, 0.0, 5.0)], "design string, dx0 double, dy0 double, dx1 double, dy1 double")
    assert rows(stats.coverage_percent(wins, dies), "design", "percent") == [("d", 50.0), ("e", None)]


def test_layer_stack(spark):
    blocks = spark.createDataFrame([("f", 0, 1.0), ("f", 0, 2.0), ("f", 1, 3.0), ("g", 0, 0.5)], "window_id string, layer int, z0 double")
    layers = spark.createDataFrame([("f", 0, "metal1", "interconnect"), ("f", 1, "v_Via1", ""), ("f", 2, "poly", ""), ("g", 0, "mcon", "via"), ("g", 1, "far", "")], "window_id string, layer int, name string, type string")
    media = spark.createDataFrame([("f", "low", 0.9), ("f", "high", 2.5)], "window_id string, name string, z_top double")
    got = rows(stats.layer_stack_summary(blocks, layers, media), "window_id", "position", "name", "type", "z_bottom", "z_top")
    assert [(w, k, n, t, round(a, 6), b) for w, k, n, t, a, b in got] == [
        ("f", 1, "low", "dielectric", 0.0, 0.9), ("f", 2, "metal1", "interconnect", 1.36, 1.5), ("f", 3, "high", "dielectric", 0.9, 2.5), ("f", 4, "v_Via1", "via", 2.92, 3.0),
        ("g", 1, "far", "interconnect", 0.0, 0.0), ("g", 2, "mcon", "via", 0.45, 0.5),
    ]


def test_dielectric(spark):
    media = spark.createDataFrame([("t", 2.0, 1.0), ("t", 4.0, 2.0)], "tech string, er double, z_top double")
    p = spark.createDataFrame([("t", z) for z in (0.5, 1.0, 1.5, 2.0, 9.0)] + [("u", 1.0)], "tech string, z double")
    assert [r.er for r in stack.dielectric_at(p, media).orderBy("tech", "z").collect()] == [2.0, 3.0, 4.0, 4.0, 4.0, 1.0]


def test_split_is_seeded_and_disjoint(spark):
    order = sorted(f"W{i}" for i in range(20))
    ids = spark.createDataFrame([(w,) for w in order[::-1]] * 2, "window_id string")
    a, b = (rows(samples.split_windows(ids, seed=42), "window_id", "split") for _ in range(2))
    assert a == b and len({w for w, _ in a}) == 20
    assert sum(s == "train" for _, s in a) == 14 and sum(s == "val" for _, s in a) == 3
    assert samples.leaks(samples.split_windows(ids)).count() == 0
    random.Random(42).shuffle(order)
    assert [r.window_id for r in samples.permutation(ids, 42).orderBy("position").collect()] == order
    drawn = [sorted(order)[i] for i in np.random.default_rng(0).permutation(20)]
    assert [r.window_id for r in samples.permutation(ids, 0, "numpy").orderBy("position").collect()] == drawn


def test_shuffled_batches_keep_windows(spark):
    s = spark.createDataFrame([(f"W{i % 4}", i) for i in range(22)], "window_id string, sample int")
    placed = spark.createDataFrame([(f"W{i}", i // 2) for i in range(4)], "window_id string, shard_id int")
    got = samples.shuffled_batches(s.repartition(3), placed, 4, 7)
    assert got.groupBy("window_id", "batch").count().where("count > 4").count() == 0
    assert rows(got, "window_id", "sample", "batch") == rows(samples.shuffled_batches(s, placed, 4, 7), "window_id", "sample", "batch")
    assert rows(got, "window_id", "sample", "batch") != rows(samples.shuffled_batches(s, placed, 4, 7, epoch=1), "window_id", "sample", "batch")


def test_components_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r.root for r in components.components(e).where("node <= 40").collect()} == {0}


def test_regrouped_nets(spark):
    d = spark.createDataFrame([("n.3", 1), ("n.4", 2), ("m", 1)], "name string, cluster int")
    assert rows(components.regrouped_nets(d), "name", "net") == [("m", "m"), ("n.3", "n.1"), ("n.4", "n.2")]


def test_farthest_points_spread(spark):
    d = spark.createDataFrame([("c", i, float(i), 0.0, 0.0) for i in range(11)], "k string, p_idx int, x double, y double, z double")
    got = [r.p_idx for r in points.farthest(d, "k", 3).orderBy("order").collect()]
    assert set(got[1:]) & {0, 10} and len(set(got)) == 3


FRAMED = "k string, block int, net string, frame struct<base: array<double>, v1: array<double>, v2: array<double>, h: array<double>>"


def test_surface_points_lie_on_faces(spark):
    b = spark.createDataFrame([("w", 1, "n", ([0.0] * 3, [2.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]))], FRAMED)
    for r in points.surface_points(b, ["k"], 200, 1).collect():
        on = [(r.x, 0, 2, r.nx), (r.y, 0, 1, r.ny), (r.z, 0, 1, r.nz)]
        assert sum(n != 0 for *_, n in on) == 1
        assert all(v == (hi if n > 0 else lo) for v, lo, hi, n in on if n) and all(lo <= v <= hi for v, lo, hi, _ in on)


def test_windows(spark):
    sides = {"small": (2.0, 1.0), "medium": (4.0, 3.0), "large": (8.0, 6.0)}
    assert windows.grid_size((0.0, 0.0, 100.0, 100.0), sides) == 6 and windows.grid_size((0.0, 0.0, 1.0, 1.0), sides) == 3 and windows.grid_size((0.0, 0.0, 1e6, 1e6), sides) == 32
    w = windows.place(spark, "d", (0.0, 0.0, 100.0, 100.0), sides, grid=2)
    assert w.count() == 36 and windows.capped(w, 1).count() == 9
    # The structure of the first tile: sides that touch, at a seeded place.
    tiles = [(x, y) for y in (0.0, 50.0) for x in (0.0, 50.0)]
    draw = random.Random(42)
    draw.shuffle(tiles)
    x, y = tiles[0][0] + draw.uniform(0.5, 50 - 12 - 0.5), tiles[0][1] + draw.uniform(0.5, 50 - 9 - 0.5)
    want = [("large", x, y, x + 8, y + 6), ("medium", x + 8, y, x + 12, y + 3), ("medium", x + 8, y - 3, x + 12, y), ("medium", x + 4, y - 3, x + 8, y), ("medium", x, y - 3, x + 4, y)]
    want += [("small", x + 8 + dx, y + 3 + dy, x + 10 + dx, y + 4 + dy) for dx, dy in ((0, 0), (2, 0), (0, 1), (2, 1))]
    got = [tuple(r) for r in w.where("tile_order = 0").orderBy("spot").select("size", "x1", "y1", "x2", "y2").collect()]
    assert [g[0] for g in got] == [s for s, *_ in want] and all(a == pytest.approx(b, abs=1e-3) for g, v in zip(got, want, strict=True) for a, b in zip(g[1:], v[1:], strict=True))
    assert [r.name for r in w.orderBy("tile_order", "spot").collect()] == [f"W{i}" for i in range(36)]
    old = spark.createDataFrame([("a", 0), ("b", 1)], "name string, position int")
    new = spark.createDataFrame([("b", 0), ("c", 1)], "name string, position int")
    assert rows(windows.merged(old, new), "position", "name") == [(0, "a"), (1, "b"), (2, "c")]


def test_dense_features(spark):
    d = spark.createDataFrame([("s", 0, 0, 1, 0.5), ("s", 1, 1, 1, 0.75)], "k string, layer int, y int, x int, feature double")
    assert samples.dense_features(d, 2, 2, 2, ["k"]).first()["features"] == [0.0, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0, 0.75]


def test_ring_and_grow(spark):
    box = [F.lit(v) for v in (2.0, 2.0, 4.0, 4.0)]
    bounds = [F.lit(v) for v in (0.0, 1.5, 10.0, 10.0)]
    got = spark.range(1).select(geometry.ring(box, F.lit(1.0), bounds).alias("r")).first()["r"]
    assert sum((p.x1 - p.x0) * (p.y1 - p.y0) for p in got) == pytest.approx((5 - 1) * (5 - 1.5) - 4)


def test_mismatch_reports(spark):
    px = lambda *v: spark.createDataFrame([("w", 0, y, x, c, n) for y, x, c, n in v], "k string, layer int, y int, x int, cid int, name string")
    a, b = px((0, 0, 1, "p"), (0, 1, 1, "p"), (0, 2, 2, "q"), (1, 0, 3, "r")), px((0, 0, 4, "s"), (0, 2, 2, "q"), (1, 0, 3, "t"))
    assert rows(raster.top_ids(a, b, ["k"]), "cid", "n", "rank") == [(1, 1, 1)]
    assert rows(raster.top_name_pairs(a, b, ["k"], 1), "name_a", "name_b", "n") == [("p", "s", 1)]


def test_bounds_fall_back_to_blocks(spark):
    cols = "k string, x0 double, y0 double, x1 double, y1 double"
    w = spark.createDataFrame([("a", 0.0, 0.0, 9.0, 9.0), ("b", None, 0.0, 1.0, 1.0)], cols)
    blocks = spark.createDataFrame([("a", 1.0, 1.0, 2.0, 2.0), ("b", 1.0, 2.0, 3.0, 4.0), ("b", 0.5, 3.0, 2.0, 5.0), ("c", 1.0, 1.0, 2.0, 2.0)], cols)
    assert rows(raster.window_bounds(w, blocks, ["k"]), "k", "x0", "y0", "x1", "y1") == [("a", 0.0, 0.0, 9.0, 9.0), ("b", 0.5, 2.0, 3.0, 5.0), ("c", 1.0, 1.0, 2.0, 2.0)]


def test_outcomes(spark):
    f = spark.createDataFrame([("g", "W0", None), ("g", "W0", None), ("g", "W1", "bad"), ("h", "W2", None)], "g string, window_id string, error string")
    assert rows(stats.outcome_counts(f, "g"), "g", "succeeded", "failed") == [("g", 1, 1), ("h", 1, 0)]


def test_surface_cloud(spark):
    b = spark.createDataFrame([("w", "t", k, f"n{k}", ([0.0, 0.0, 2.0 * k], [2.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0])) for k in range(3)], FRAMED.replace("k string", "k0 string, tech string"))
    media = spark.createDataFrame([("t", 2.0, 1.5), ("t", 4.0, 9.0)], "tech string, er double, z_top double")
    masters = spark.createDataFrame([("w", "n0", "n2")], "k0 string, pos string, neg string")
    for n in (50, 400):
        got = points.surface_cloud(b, media, masters, ["k0"], n, 3).collect()
        assert len(got) == n // 3 * 3 and {r.flux for r in got} == {1.0, -1.0, 0.0}
        assert all(r.flux == {"n0": 1.0, "n1": 0.0, "n2": -1.0}[r.net] and r.er == (2.0 if r.z < 1.5 else 4.0) for r in got)


def test_surface_cloud_of_tilted_blocks(spark):
    """Faces by area, places even within them, and exactly n by the final draw."""
    frames = [([1.0, 2.0, 3.0], [4.0, 1.0, 0.0], [-1.0, 2.0, 0.5], [0.2, 0.0, 1.0]), ([0.0] * 3, [0.0] * 3, [0.0] * 3, [0.0] * 3)]
    b = spark.createDataFrame([("w", k, "n", f) for k, f in enumerate(frames)], FRAMED)
    got = points.surface_points(b, ["k"], 6000, 3).collect()
    base, v1, v2, h = (np.array(x) for x in frames[0])
    size = [np.linalg.norm(np.cross(a, c)) for a, c in ((v1, v2), (v1, h), (v2, h))]
    mine = [r for r in got if r.block == 0]
    for axis, share in zip("zyx", np.array(size) / sum(size), strict=True):
        on = [r for r in mine if r[f"n{axis}"]]
        assert abs(len(on) / len(mine) - share) < 0.03 and abs(sum(r[f"n{axis}"] > 0 for r in on) / len(on) - 0.5) < 0.05
    shares = np.linalg.solve(np.column_stack([v1, v2, h]), (np.array([[r.x, r.y, r.z] for r in mine]) - base).T)
    assert shares.min() > -1e-9 and shares.max() < 1 + 1e-9 and (np.minimum(abs(shares), abs(shares - 1)).min(0) < 1e-9).all()
    assert [tuple(r)[4:7] for r in got if r.block == 1] and all((r.x, r.y, r.z) == (0, 0, 0) for r in got if r.block == 1)
    many = spark.createDataFrame([("w", k, "n", frames[0]) for k in range(300)] + [("v", 0, "n", frames[0])], FRAMED.replace("k string", "k0 string"))
    drawn = points.drawn(points.surface_points(many, ["k0"], 100, 3), ["k0"], ["block", "k"], 100, 9)
    assert {r.k0: r.n for r in drawn.groupBy("k0").agg(F.count("*").alias("n")).collect()} == {"w": 100, "v": 100}


def test_draws_are_exact(spark, monkeypatch):
    from netquarry.operators import quantiles

    monkeypatch.setattr(quantiles, "FEW", 50)
    d = spark.range(3000).select((F.col("id") % 3).alias("g"), F.col("id").alias("i")).unionAll(spark.createDataFrame([(7, 1), (7, 2), (8, 5), (8, 5)], "g long, i long"))
    got = points.drawn(d, ["g"], ["i"], 400, 1)
    assert got.columns == ["g", "i"] and {r.g: r.n for r in got.groupBy("g").agg(F.count("*").alias("n")).collect()} == {0: 400, 1: 400, 2: 400, 7: 2, 8: 2}
    assert got.where("g < 3").distinct().count() == 1200 and sorted(r.i for r in got.where("g = 0").collect()) != list(range(0, 1200, 3))
    assert points.drawn(d, ["g"], ["i"], 1, 1).groupBy("g").count().where("count <> 1").count() == 0


@pytest.mark.parametrize("few", [8, 100_000])
def test_quantiles(spark, monkeypatch, few):
    from netquarry.operators import quantiles

    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "CUTS", 8)
    rng = random.Random(few)
    groups = {
        "even": [float(i) for i in range(1000)], "wide": [(-1) ** i * 10.0 ** rng.uniform(-300, 300) for i in range(999)], "ties": [1.0] * 700 + [2.0] * 299 + [3.0],
        "one": [5.0], "two": [1.0, 4.0], "steps": [float(2**k) for k in range(60)] * 9, "null": [None], "some": [None, 3.0, None, 1.0],
    }
    d = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double").repartition(5)
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.share): r.value for r in quantiles.quantiles(d, ["g"], "v", shares).collect()}
    want = {(g, s): float(np.quantile([v for v in vs if v is not None], s)) for g, vs in groups.items() for s in shares if any(v is not None for v in vs)}
    assert set(got) == set(want) and all(got[k] == pytest.approx(v, rel=1e-12) for k, v in want.items())
    assert quantiles.quantiles(d.where("g = 'even'"), [], "v", [0.5]).first()["value"] == 499.5
    assert rows(quantiles.order_statistic(d, ["g"], "v", 2), "g", "value") == sorted((g, sorted(v for v in vs if v is not None)[1]) for g, vs in groups.items() if sum(v is not None for v in vs) > 1)
    assert quantiles.quantiles(d.limit(0), ["g"], "v", [0.5]).count() == 0


def test_no_task_sees_all_rows(spark):
    """Orders and medians over all rows have no plan with a single partition."""
    from netquarry.operators import compare, quantiles, ranks

    seen = []
    d = spark.range(2000).select((F.col("id") * 7919 % 2000).alias("k"), F.rand(1).alias("v")).repartition(4)
    for df in (ranks.numbered(d, ["k"], "n"), samples.offsets(d.select((F.col("k") % 50).alias("window_id"))), samples.permutation(d.select(F.col("k").cast("string").alias("window_id")), 3)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        seen.append("SinglePartition" in plan)
        df.count()
    assert not any(seen)
    assert compare.summary(d, "v").first()["median"] == pytest.approx(quantiles.quantiles(d, [], "v", [0.5]).first()["value"])


def test_nearest_like_all_pairs(spark):
    rng = random.Random(4)
    cloud = [("a", i, *[rng.gauss(0, 1) for _ in range(3)]) for i in range(400)] + [("a", 1000 + i, 50.0 + i, 50.0, 50.0) for i in range(3)]
    cloud += [("b", i, float(i % 5), float(i % 3), 0.0) for i in range(60)] + [("c", i, 1.0, 1.0, 1.0) for i in range(9)] + [("d", 0, 5.0, 5.0, 5.0)]
    cloud += [("e", i, float(i), 0.0, 0.0) for i in range(300)] + [("e", 900 + i, 1e5, 1e-3 * i, 0.0) for i in range(40)]
    asked = [(k, i, x, y, z) for k, i, x, y, z in cloud if i % 7 == 0 or i >= 900] + [("a", 5000, -90.0, 0.0, 3.0), ("a", 5001, 25.0, 25.0, 25.0), ("e", 5002, 4e4, 0.0, 0.0), ("none", 1, 0.0, 0.0, 0.0)]
    p = spark.createDataFrame(cloud, "k string, p_idx int, p_x double, p_y double, p_z double")
    q = spark.createDataFrame(asked, "k string, q_idx int, q_x double, q_y double, q_z double")
    want = []
    for k, i, *at in asked:
        near = sorted((sum((a - b) ** 2 for a, b in zip(at, v, strict=True)), j) for c, j, *v in cloud if c == k)[:4]
        want += [(k, i, r + 1, j) for r, (_, j) in enumerate(near)]
    assert rows(points.nearest(q, p, ["k"], 4), "k", "q_idx", "rank", "p_idx") == sorted(want)


def test_grid_samples(spark):
    rng = random.Random(2)
    cloud = [("c", i, rng.uniform(0, 1), rng.uniform(0, 1), rng.uniform(0, 1), float(i % 10 == 0)) for i in range(500)] + [("c", 900, 3.0, 0.5, 0.5, 1.0), ("c", 901, 1.0, 1.0, 1.0, 0.0)]
    d = spark.createDataFrame(cloud, "k string, p_idx int, x double, y double, z double, flux double")
    cells = points.grid_cells(d, {c: (0.0, 1.0) for c in "xyz"}, 5)
    assert {r.gx for r in cells.where("p_idx = 900").collect()} == {-1} and {r.gx for r in cells.where("p_idx = 901").collect()} == {3}
    got = points.grid_sample(d, "k", {c: (0.0, 1.0) for c in "xyz"}, 5, 60, 1).collect()
    assert len(got) == 60 and all(0 < r.weight <= 0.9 for r in got) and 900 not in {r.p_idx for r in got}
    assert sorted(map(tuple, got)) == sorted(map(tuple, points.grid_sample(d.repartition(7), "k", {c: (0.0, 1.0) for c in "xyz"}, 5, 60, 1).collect()))


def test_density_passes_gaps_and_decays_in_conductors(spark):
    # A line of cells: seed, points, empty, empty, points, empty.
    held = [("c", 0, True), ("c", 1, False), ("c", 4, False), ("no", 0, False)]
    d = spark.createDataFrame([(k, x, 0, 0, s) for k, x, s in held], "k string, gx int, gy int, gz int, is_seed boolean")
    got = {(r.k, r.gx): round(r.density, 9) for r in points.spread_density(d, "k", 6, decay=0.5, start=0.8).where("gy = 0 and gz = 0").collect()}
    assert [got["c", x] for x in range(6)] == [0.8, 0.4, 0.2, 0.2, 0.2, 0.1] and {got["no", x] for x in range(6)} == {0.0}


def test_farthest_in_rounds_like_groups(spark):
    rng = random.Random(6)
    d = spark.createDataFrame([(k, i, *[float(rng.randrange(5)) for _ in range(3)]) for k, n in (("a", 90), ("b", 7), ("c", 40)) for i in range(n)], "k string, p_idx long, x double, y double, z double")
    for seed, start in ((3, None), (0, 5)):
        want = rows(points.farthest(d, "k", 36, seed, start), "k", "order", "p_idx")
        assert rows(points.farthest(d, "k", 36, seed, start, grouped=0), "k", "order", "p_idx") == want
        assert rows(points.farthest(d, "k", 36, seed, start, grouped=40), "k", "order", "p_idx") == want


def test_large_ids_raise(spark):
    d = spark.createDataFrame([("w", 0, 1 << 31, 0, 1, 0, 1, 0)], "window_id string, layer int, cid long, px0 int, px1 int, py0 int, py1 int, seq int")
    with pytest.raises(Exception, match="2.31"):
        raster.paint(d).collect()
