"""NumPy archives as Spark data sources: density shards and point clouds.

:func:`shards` and :func:`clouds` read the formats ``npz_shards`` and ``npz_clouds``, which have a partition a file. The windows that are
asked for go to the source with the option ``windows``: of shards, those that the store's index names for them are opened;
of clouds, which hold one window each, the files of that name. Where a store has no index all shards are opened, and each
gives only the windows asked for. Archives are read member by member through pyarrow's file systems, on the executors.

Filters of the plan are not taken over (``pushFilters``): Spark 4.1 keeps a source's partitions from one query to the next, so
that a filtered query would leave its filter to later ones on the same table.

A shard holds the members ``density`` (window, layer, y, x), ``id`` (of the same shape) and ``window_ids``. An index is either a
folder ``windows`` of Parquet files (window_id, shard, …) or one ``index.json`` whose ``windows`` name a ``shard_id`` each and whose
``shards`` name their files.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PIXELS = "window_id string, shard string, shard_offset int, layer int, y int, x int, density double, cid long"
POINTS = "window_id string, p_idx long, x float, y float, z float, nx float, ny float, nz float, diel float, flux float, net_id float, net string"
FEATURES = ("x", "y", "z", "nx", "ny", "nz", "diel", "flux", "net_id")


def opened(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Archive(InputPartition):
    path: str
    windows: frozenset[str] | None  # None: all

    def __init__(self, path: str, windows: frozenset[str] | None):
        super().__init__(path)
        self.path, self.windows = path, windows


class ArchiveReader(DataSourceReader):
    """What both readers share: the files, and the windows asked for."""

    def __init__(self, path: str, wanted: frozenset[str] | None = None):
        self.path, self.wanted = path.rstrip("/"), wanted

    def files(self) -> list[str]:
        from pyarrow import fs

        system, at = opened(self.path)
        found = system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
        return sorted(f.path for f in found if f.is_file and f.base_name.endswith(".npz"))

    def batch(self, columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

    def loaded(self, path: str):
        system, _ = opened(self.path)
        return system.open_input_file(path)


class ShardReader(ArchiveReader):
    def partitions(self) -> list[Archive]:
        files = self.files()
        held = self.index() if self.wanted is not None else None
        if held is None:
            return [Archive(f, self.wanted) for f in files]
        return [Archive(f, frozenset(w)) for f in files if (w := held.get(f.rsplit("/", 1)[-1]))]

    def index(self) -> dict[str, list[str]] | None:
        """Per shard's file name the wanted windows that it holds; None without an index."""
        import pyarrow.dataset as ds
        from pyarrow import fs

        if not self.wanted:
            return {}
        system, at = opened(self.path)
        kinds = {f.base_name: f.type for f in system.get_file_info(fs.FileSelector(at, allow_not_found=True))}
        out: dict[str, list[str]] = {}
        if kinds.get("windows") == fs.FileType.Directory:
            table = ds.dataset(f"{at}/windows", filesystem=system, format="parquet").to_table(columns=["window_id", "shard"], filter=ds.field("window_id").isin(sorted(self.wanted)))
            for window, shard in zip(*(table[c].to_pylist() for c in ("window_id", "shard")), strict=True):
                out.setdefault(shard, []).append(window)
        elif "index.json" in kinds:
            with system.open_input_file(f"{at}/index.json") as f:
                told = json.loads(f.read())
            names = {s["id"]: s["path"].rsplit("/", 1)[-1] for s in told["shards"]}
            for window in self.wanted & told["windows"].keys():
                out.setdefault(names[told["windows"][window]["shard_id"]], []).append(window)
        else:
            return None
        return out

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("window_id", pa.string()), ("shard", pa.string()), ("shard_offset", pa.int32()), ("layer", pa.int32()), ("y", pa.int32()), ("x", pa.int32()), ("density", pa.float64()), ("cid", pa.int64())])
        with self.loaded(partition.path) as file, np.load(file, allow_pickle=False) as z:
            windows = [str(w) for w in z["window_ids"]]
            here = [k for k, w in enumerate(windows) if partition.windows is None or w in partition.windows]
            if not here:
                return
            density, ids = z["density"], z["id"]
            for k in here:
                layer, y, x = np.nonzero((density[k] != 0) | (ids[k] != 0))
                n = len(layer)
                yield self.batch({"window_id": [windows[k]] * n, "shard": [partition.path.rsplit("/", 1)[-1]] * n, "shard_offset": np.full(n, k), "layer": layer, "y": y, "x": x, "density": density[k][layer, y, x].astype("f8"), "cid": ids[k][layer, y, x].astype("i8")}, schema)


class CloudReader(ArchiveReader):
    def partitions(self) -> list[Archive]:
        stem = lambda f: f.rsplit("/", 1)[-1].split(".")[0]
        return [Archive(f, None) for f in self.files() if self.wanted is None or stem(f) in self.wanted]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("window_id", pa.string()), ("p_idx", pa.int64()), *[(c, pa.float32()) for c in FEATURES], ("net", pa.string())])
        with self.loaded(partition.path) as file, np.load(file, allow_pickle=False) as z:
            p = z["points"].astype(np.float32)
            key = next((k for k in ("names", "point_net_names") if k in z.files), None)
            try:
                names = None if key is None else [str(x) for x in z[key]]
            except ValueError:
                names = None  # an array of Python objects, which isn't loaded
        n = len(p)
        names = [str(int(i)) for i in p[:, 8]] if names is None else names
        window = partition.path.rsplit("/", 1)[-1].split(".")[0]
        yield self.batch({"window_id": [window] * n, "p_idx": np.arange(n), **{c: p[:, k] for k, c in enumerate(FEATURES)}, "net": names}, schema)


class NpzShards(DataSource):
    READER, SCHEMA = ShardReader, PIXELS

    @classmethod
    def name(cls) -> str:
        return "npz_shards"

    def schema(self) -> str:
        return self.SCHEMA

    def reader(self, schema) -> DataSourceReader:
        wanted = self.options.get("windows")
        return self.READER(self.options["path"], None if wanted is None else frozenset(json.loads(wanted)))


class NpzClouds(NpzShards):
    READER, SCHEMA = CloudReader, POINTS

    @classmethod
    def name(cls) -> str:
        return "npz_clouds"


def _load(spark: SparkSession, source: type[NpzShards], path: str, windows: list[str] | None) -> DataFrame:
    spark.dataSource.register(source)
    reader = spark.read.format(source.name()).option("path", path)
    return (reader if windows is None else reader.option("windows", json.dumps(windows))).load()


def shards(spark: SparkSession, path: str, windows: list[str] | None = None) -> DataFrame:
    """Sparse pixels of a store of shards, or of some of its windows."""
    return _load(spark, NpzShards, path, windows)


def clouds(spark: SparkSession, path: str, windows: list[str] | None = None) -> DataFrame:
    """Points of a folder of clouds, or of some of its windows; names fall back to the id as text."""
    return _load(spark, NpzClouds, path, windows)
