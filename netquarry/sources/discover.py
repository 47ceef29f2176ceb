"""What lies in folders: files by listing, datasets, windows, stores and the files that designs name.

A listing is a table of paths, so that finding things is a filter or a join over it, however many files there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.names import layer_key, window_number
from .catalog import ARTIFACTS

# What a window's output folders hold, by artifact.
OUTPUTS = {"gds": "gds/%s.gds", "def": "def/%s.def", "cap3d": "cap3d/%s.cap3d", "point_clouds": "point_clouds/%s.npz", "density_maps": "density_maps/%s"}


def listing(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, length) of all files below a folder; contents aren't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(root).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length")


def folder_of(path: str = "path"):
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def datasets(files: DataFrame) -> DataFrame:
    """(dataset, folder, files): folders ``<tech>/<size>/cap3d`` that hold CAP3D files, named ``<tech>_<size>``."""
    parts = F.regexp_extract("path", r"^(.*/)?([^/]+)/([^/]+)/cap3d/[^/]+\.cap3d$", 2), F.regexp_extract("path", r"^(.*/)?([^/]+)/([^/]+)/cap3d/[^/]+\.cap3d$", 3)
    found = files.select(parts[0].alias("tech"), parts[1].alias("size"), folder_of().alias("folder")).where("tech <> ''")
    return found.groupBy(F.concat_ws("_", "tech", "size").alias("dataset"), "folder").agg(F.count("*").alias("files"))


def artifacts(files: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, artifact, files): what each dataset's folder holds; an artifact is there if its folder has a file.

    roots: (root), folders of datasets. The window list counts as the artifact ``windows.yaml``.
    """
    at = F.regexp_extract("path", rf"^(.*)/({'|'.join(ARTIFACTS.values())})/.+$", 1), F.regexp_extract("path", rf"^(.*)/({'|'.join(ARTIFACTS.values())})/.+$", 2)
    held = files.select(at[0].alias("root"), at[1].alias("artifact")).where("artifact <> ''")
    lists = files.where(F.col("path").endswith("/windows.yaml")).select(folder_of().alias("root"), F.lit("windows.yaml").alias("artifact"))
    return held.unionAll(lists).join(roots.select("root").distinct(), "root", "left_semi").groupBy("root", "artifact").agg(F.count("*").alias("files"))


def stale(files: DataFrame) -> DataFrame:
    """(folder): temporary folders of artifacts, ``<artifact>.tmp``, that an installation left behind."""
    found = F.regexp_extract("path", rf"^(.*/({'|'.join(ARTIFACTS.values())})\.tmp)/", 1)
    return files.select(found.alias("folder")).where("folder <> ''").distinct()


def remove_stale(spark: SparkSession, root: str) -> list[str]:
    """Removes what :func:`stale` finds below a folder, by way of Spark's file system; returns the folders."""
    gone = sorted(r["folder"] for r in stale(listing(spark, root)).toLocalIterator())
    for folder in gone:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def window_folders(files: DataFrame, holds: str = "all_nets.dspf") -> DataFrame:
    """(window_id, folder, number): folders ``W…`` that hold a file of that name; ``number`` orders them."""
    found = files.where(F.col("path").endswith(f"/{holds}")).select(folder_of().alias("folder"))
    named = found.withColumn("window_id", F.element_at(F.split("folder", "/"), -1)).where(F.col("window_id").startswith("W"))
    return named.select("window_id", "folder", window_number(F.col("window_id")).alias("number"))


def stores(files: DataFrame) -> DataFrame:
    """(store): folders of density shards, known by their index (a JSON file, or a folder of Parquet files)."""
    found = F.coalesce(*[F.nullif(F.regexp_extract("path", p, 1), F.lit("")) for p in (r"^(.*)/index\.json$", r"^(.*)/(?:index|windows)/[^/]+\.parquet$")])
    return files.select(found.alias("store")).where("store is not null").distinct()


def resolved(wanted: DataFrame, files: DataFrame, roots: list[str]) -> DataFrame:
    """``wanted`` (raw, …) with ``path``: the first search root below which the path exists, else the path as it is.

    Absolute paths are taken as they are; nulls and empty paths give null.
    """
    raw = F.nullif(F.col("raw"), F.lit(""))
    tries = F.array(*[F.struct(F.lit(i).alias("i"), F.when(raw.startswith("/"), raw).otherwise(F.concat(F.lit(r.rstrip("/") + "/"), raw)).alias("p")) for i, r in enumerate(roots)])
    asked = wanted.select("raw").distinct().where(raw.isNotNull()).select("raw", F.explode(tries).alias("t")).select("raw", "t.i", F.col("t.p").alias("path"))
    found = asked.join(files.select("path").distinct(), "path").groupBy("raw").agg(F.min_by("path", "i").alias("path"))
    return wanted.join(found, "raw", "left").withColumn("path", F.coalesce("path", raw))


def lef_files(designs: DataFrame, files: DataFrame) -> DataFrame:
    """(design, place, path): the LEF files that belong to a design's stack file, in order, each once.

    designs: (design, stack, tech). They are the stack's own name with ``.lef``, then the technology's key in its folder with ``.lef``
    and ``.tlef``, as far as these exist.
    """
    key = layer_key(F.col("tech"))
    own = F.concat(F.regexp_replace("stack", r"\.[^/.]*$", ""), F.lit(".lef"))
    by_tech = [F.when(F.length(key) > 0, F.concat(folder_of("stack"), F.lit("/"), key, F.lit(e))) for e in (".lef", ".tlef")]
    tries = F.filter(F.array(own, *by_tech), lambda p: p.isNotNull())
    asked = designs.select("design", F.posexplode(F.array_distinct(tries)).alias("i", "path"))
    found = asked.join(files.select("path").distinct(), "path", "left_semi")
    place = F.row_number().over(Window.partitionBy("design").orderBy("i")) - 1
    return found.select("design", place.alias("place"), "path")


def output_paths(windows: DataFrame, root: str) -> DataFrame:
    """(window_id, artifact, path): where each window's outputs go below a dataset's folder."""
    each = F.array(*[F.struct(F.lit(a).alias("artifact"), F.format_string(f"{root.rstrip('/')}/{p}", "window_id").alias("path")) for a, p in OUTPUTS.items()])
    return windows.select("window_id", F.explode(each).alias("o")).select("window_id", "o.*")
