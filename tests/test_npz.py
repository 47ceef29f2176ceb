"""NumPy archives: what is written is read, and a filter opens only the files that hold its windows."""

import json

import numpy as np
import pytest
from netquarry.sinks import npz as sink
from netquarry.sources import npz

PIXELS = "window_id string, layer int, y int, x int, density double, cid long"
ROWS = [(f"W{w}", layer, w % 3, 1, 0.5 + w, 300 * w + layer) for w in range(7) for layer in range(2)]


@pytest.fixture
def store(spark, tmp_path):
    windows = spark.createDataFrame([(f"W{w}",) for w in range(8)], "window_id string")  # W7 has no pixels
    index = sink.write_shards(spark.createDataFrame(ROWS, PIXELS), windows, str(tmp_path), 2, 3, 3, 3)
    assert sorted((r.window_id, r.shard_id, r.shard_offset) for r in index.collect()) == [(f"W{w}", w // 3, w % 3) for w in range(8)]
    return str(tmp_path)


def asked(path, *windows):
    return npz.ShardReader(path, frozenset(windows)).partitions()


def test_shards_round_trip(spark, store):
    rows = npz.shards(spark, store)
    assert sorted(map(tuple, rows.select("window_id", "layer", "y", "x", "density", "cid").collect())) == sorted(ROWS)
    one = npz.shards(spark, store, ["W4"]).where("layer = 1")
    assert [tuple(r)[:3] for r in one.collect()] == [("W4", "shard_000001.npz", 1)]
    assert one.rdd.getNumPartitions() == 1 and rows.rdd.getNumPartitions() == 3
    with np.load(f"{store}/shards/shard_000002.npz") as z:
        assert z["density"].shape == (2, 2, 3, 3) and z["id"].dtype == np.uint16 and list(z["window_ids"]) == ["W6", "W7"]


def test_filters_choose_shards(store):
    assert [(p.path.rsplit("/", 1)[-1], p.windows) for p in asked(store, "W4")] == [("shard_000001.npz", frozenset({"W4"}))]
    assert [len(p.windows) for p in asked(store, "W0", "W7", "W2")] == [2, 1]
    assert asked(store, "none") == [] and asked(store) == []
    assert len(npz.ShardReader(store).partitions()) == 3


def test_json_index_and_none(spark, store, tmp_path):
    for kind in ("json", "none"):
        root = tmp_path / kind
        (root / "shards").mkdir(parents=True)
        for k in range(2):
            np.savez_compressed(root / "shards" / f"s{k}.npz", density=np.full((2, 1, 2, 2), k + 1.0, dtype=np.float32), id=np.zeros((2, 1, 2, 2), dtype=np.uint8), window_ids=np.array([f"A{k}", f"B{k}"]))
        if kind == "json":
            told = {"shards": [{"id": k, "path": f"shards/s{k}.npz"} for k in range(2)], "windows": {f"{c}{k}": {"shard_id": k, "shard_offset": i} for i, c in enumerate("AB") for k in range(2)}}
            (root / "index.json").write_text(json.dumps(told))
        rows = npz.shards(spark, str(root), ["B1"])
        assert {(r.window_id, r.shard_offset, r.density) for r in rows.collect()} == {("B1", 1, 2.0)} and rows.count() == 4
        assert len(asked(str(root), "B1")) == (1 if kind == "json" else 2)


def test_negative_ids_raise(spark, tmp_path):
    with pytest.raises(Exception, match="negative"):
        sink.write_shards(spark.createDataFrame([("W", 0, 0, 0, 1.0, -1)], PIXELS), spark.createDataFrame([("W",)], "window_id string"), str(tmp_path), 1, 1, 1)


def test_clouds(spark, tmp_path):
    points = spark.createDataFrame([("a", 2, 1.0, 7.0, "n"), ("a", 1, 2.0, 8.0, "m"), ("b", 0, 3.0, 9.0, None)], "window_id string, p_idx long, x double, net_id double, net string")
    sink.write_clouds(points, str(tmp_path))
    np.savez(tmp_path / "c.npz", points=np.ones((1, 9)), point_net_names=np.array(["z"], dtype=object))
    rows = npz.clouds(spark, str(tmp_path))
    assert sorted((r.window_id, r.p_idx, r.x, r.ny, r.net) for r in rows.collect()) == [("a", 0, 2.0, 0.0, "m"), ("a", 1, 1.0, 0.0, "n"), ("b", 0, 3.0, 0.0, "9"), ("c", 0, 1.0, 1.0, "1")]
    assert npz.clouds(spark, str(tmp_path), ["b"]).rdd.getNumPartitions() == 1 and rows.where("window_id = 'b'").count() == 1 and rows.count() == 4
