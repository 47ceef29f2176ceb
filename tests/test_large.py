"""What keeps large tables off the driver and groups out of single tasks, on small ones."""

import random

from pyspark.sql import functions as F

from netquarry.registry import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_pixels_of_samples_are_not_broadcast(spark):
    from netquarry.serve import WindowSamples

    pixels = spark.range(100).selectExpr("cast(id % 2 as string) as window_id", "0 as layer", "0 as y", "cast(id as int) as x", "0.5d as density", "id as cid")
    wanted = spark.createDataFrame([("1", 1, 0)], "window_id string, pos_id int, neg_id int")
    found = WindowSamples(pixels, None, None, None).features(wanted)
    assert found.count() == 50 and "Broadcast" not in plan(found)


def test_pixels_of_shards_are_summed_before_they_meet_the_index(spark):
    tree = plan(QUERIES["k10_shards"](spark, SF))
    assert tree.index("Join") < tree.index("Aggregate")


def test_copies_of_a_rectangle_never_meet(spark, monkeypatch):
    from netquarry.operators import components

    made = []
    edges = components.touching_edges
    monkeypatch.setattr(components, "touching_edges", lambda *a: made.append(edges(*a)) or made[-1])
    boxes = [(i, (i % 7 * 2) % 9, i % 2) for i in range(400)]
    shapes = [(100 - i, layer, float(at), 0.0, float(at + 1), 1.0) for i, at, layer in boxes] + [(900, 0, None, 0.0, 1.0, 1.0), (901, 0, None, 0.0, 1.0, 1.0)]
    found = components.touching_components(spark.createDataFrame(shapes, "id int, layer int, x0 double, y0 double, x1 double, y1 double"), 8.0)
    got = {r.node: r.root for r in found.collect()}
    want = {k: k for k, *_ in shapes}
    changed = True
    while changed:
        changed = False
        for a, la, xa, _, ya, _ in shapes:
            low = min([want[b] for b, lb, xb, _, yb, _ in shapes if la == lb and None not in (xa, xb) and xa <= yb and xb <= ya], default=a)
            changed |= low < want[a]
            want[a] = min(low, want[a])
    assert got == want and made[0].count() < 50


def test_sorted_media_are_those_of_the_array(spark):
    from netquarry.operators import stack

    rng = random.Random(5)
    media = [(t, float(rng.randint(1, 9)), rng.randint(0, 30) / 2) for t in ("a", "b", None) for _ in range(40)]
    points = [(t, z, k) for k, (t, z) in enumerate((t, z) for t in ("a", "b", "c", None) for z in [None, float("nan"), -1.0, *(rng.randint(-2, 34) / 2 + rng.choice((0, 1e-10, 0.2)) for _ in range(60))])]
    m, p = spark.createDataFrame(media, "tech string, er double, z_top double"), spark.createDataFrame(points, "tech string, z double, k int")
    for tolerance in (0.0, 1e-9):
        small, large = (stack.dielectric_at(p, m, tolerance, few) for few in (1000, 1))
        assert small.columns == large.columns
        assert {r.k: r.er for r in small.collect()} == {r.k: r.er for r in large.collect()}
        assert "array_sort" not in plan(large)


def test_segments_are_cut_in_batches(spark):
    """Against a plain clip of each segment; no expression goes over arrays element by element."""
    from netquarry.operators import geometry

    rng = random.Random(3)
    some = lambda: rng.choice((rng.uniform(-2, 3), float(rng.randint(-1, 2))))
    lines = [(k, [(some(), some()) for _ in range(rng.randint(0, 7))]) for k in range(200)] + [(900, None), (901, [(0.2, 0.2), (0.4, None), (0.6, 0.6), (0.8, 0.6)])]
    got = geometry.polyline_pieces(spark.createDataFrame(lines, "net int, points array<struct<x:double,y:double>>").selectExpr("*", "0 as w_x0", "0 as w_y0", "1 as w_x1", "1.0d as w_y1"), ["net"])
    assert "lambda" not in plan(got)
    want = []
    for net, points in lines:
        pieces, last = [], None
        for k, (p, q) in enumerate(zip(points or [], (points or [])[1:], strict=False)):
            lo, hi = 0.0, 1.0
            if None in (*p, *q):
                continue
            for a, b in zip(p, q, strict=True):
                if a == b:
                    lo, hi = (lo, hi) if 0 <= a <= 1 else (1.0, 0.0)
                else:
                    lo, hi = max(lo, min(-a / (b - a), (1 - a) / (b - a))), min(hi, max(-a / (b - a), (1 - a) / (b - a)))
            if (hi - lo) * max(abs(q[0] - p[0]), abs(q[1] - p[1])) <= 1e-9:
                continue
            ends = [tuple(a + t * (b - a) for a, b in zip(p, q, strict=True)) for t in (lo, hi)]
            if last == k - 1 and max(abs(u - v) for u, v in zip(pieces[-1][-1], ends[0], strict=True)) <= 1e-9:
                pieces[-1].append(ends[1])
            else:
                pieces.append(ends)
            last = k
        want += [(net, i + 1, [(round(x, 9) + 0.0, round(y, 9) + 0.0) for x, y in p]) for i, p in enumerate(pieces)]
    assert sorted((r.net, r.piece, [(round(p.x, 9) + 0.0, round(p.y, 9) + 0.0) for p in r.points]) for r in got.collect()) == sorted(want)


def test_labels_of_a_text_are_computed_twice_at_most(spark):
    from netquarry.sinks import text

    pairs = spark.range(40).selectExpr("cast(id % 3 as string) as window_id", "concat('a', id) as net_lo", "concat('b', id) as net_hi", "id * 1e-15 as value_f")
    selfs = spark.range(7).selectExpr("cast(id % 3 as string) as window_id", "concat('a', id) as net", "1e-15d as value_f")
    tree = plan(text.spef(selfs, pairs, "top"))
    tree = tree[: tree.index("Initial Plan")] if "Initial Plan" in tree else tree
    assert tree.count("Range (0, 40") <= 2 and "lambda" not in tree
