from pyspark.sql import functions as F

from netquarry.operators import views


def test_heights_and_layers(spark):
    b = spark.createDataFrame([("w", 0.0, 1.0), ("w", 2.0, 3.0)], "window_id string, z0 double, z1 double")
    near = {z: views.near_height(b, z).first()["near"] for z in (-0.3, -0.15, 0.5, 1.0, 1.15, 1.5, 1.85, 3.3)}
    assert near == {-0.3: False, -0.15: True, 0.5: True, 1.0: True, 1.15: True, 1.5: False, 1.85: True, 3.3: False}
    assert views.uppermost(b).first()["z"] == 3.0 and views.uppermost(b.select("window_id", F.lit(-3.0).alias("z0"), F.lit(-1.0).alias("z1"))).first()["z"] == 0.0
    p = spark.createDataFrame([(0.5,), (1.5,), (1.0,)], "z double")
    layers = spark.createDataFrame([(1, 0.0, 1.0), (2, 1.0, 1.2)], "layer_id int, z0 double, z1 double")
    assert sorted((r.z, r.layer_id) for r in views.layered_points(p, layers).collect()) == [(0.5, 1), (1.0, 1), (1.5, -1)]


def test_scalars(spark):
    d = spark.createDataFrame([("/data/Nangate45/small/W2.def", 11, 5.0, "metal3"), ("/x/y/W10.def", None, 1.0, "VIA2")], "path string, layer int, er double, name string")
    got = d.select(views.node_of_path(F.col("path"), ("nangate45", "asap7")), views.relative(F.col("path"), F.lit("/data/")), views.stem(F.col("path")), views.colour(F.coalesce("layer", F.lit(25))), views.medium_style(F.col("er")), views.layer_group(F.col("layer"), F.col("er") + 0.26)).collect()
    assert tuple(got[0]) == ("nangate45", "Nangate45/small/W2.def", "W2", 11, [0.9, 0.4, 0.2, 0.35], "L:11")
    assert tuple(got[1]) == (None, "/x/y/W10.def", "W10", 1, [0.2, 0.4, 0.8, 0.15], "Z:1.3")
    assert d.where(views.matches_filter(F.col("name"), "metal3, x")).count() == 1 and d.where(views.matches_filter(F.col("name"), None)).count() == 2


def test_pairs_and_groups(spark):
    a, b = (spark.createDataFrame([(f"/{s}/W{i}.{s}",) for i in n], "path string") for s, n in (("cap3d", (10, 2, 3)), ("def", (2, 10))))
    assert [r.stem for r in views.paired(a, b).collect()] == ["W2", "W10"]
    pts = spark.createDataFrame([("c", i, float(i), 0.0, 0.0) for i in range(5)], "k string, i int, x double, y double, z double")
    side = lambda p: pts.withColumnsRenamed({"i": f"{p}idx", **{c: f"{p}{c}" for c in "xyz"}})
    g = views.grouped_neighbours(side("q_").where("q_idx = 2"), side("p_"), ["k"], 3).first()["group"]
    assert [(x.p_idx, x.x) for x in g] == [(2, 0.0), (1, -1.0), (3, 1.0)]
