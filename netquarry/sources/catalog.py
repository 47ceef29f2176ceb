"""Dataset registry, window lists, technology stacks, layer maps and annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import lines

# Artifacts by canonical name, and the names they also go by.
ARTIFACTS = {"cap3d": "cap3d", "def": "def", "gds": "gds", "density_maps": "density_maps", "point_clouds": "point_clouds", "labels_rwcap": "labels_rwcap", "labels_raphael": "labels_raphael"}
ALIASES = {"density": "density_maps", "cnn": "density_maps", "pct": "point_clouds", "rwcap": "labels_rwcap", "raphael": "labels_raphael"}
SIZES = ("small", "medium", "large")
REGISTRY = (
    "datasets array<struct<dataset_id:string, version:string, description:string, process_node:string, path_parts:array<string>, windows_file:string, "
    "artifacts:map<string,string>, sources:array<struct<name:string, url:string, filename:string, kind:string, preferred:boolean>>>>"
)


def registry(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Datasets by id; sources default to kind zip and not preferred, the window list to windows.yaml. ``lines``: a document a line."""
    rows = spark.read.schema(REGISTRY).option("multiLine", not lines).json(path).select(F.explode("datasets").alias("d")).select("d.*")
    filled = F.transform("sources", lambda s: F.struct(s["name"].alias("name"), s["url"].alias("url"), s["filename"].alias("filename"), F.coalesce(s["kind"], F.lit("zip")).alias("kind"), F.coalesce(s["preferred"], F.lit(False)).alias("preferred")))
    return rows.withColumns({"sources": filled, "windows_file": F.coalesce("windows_file", F.lit("windows.yaml"))}).orderBy("dataset_id")


def canonical_artifact(name: Column) -> Column:
    """Canonical artifact name; unknown names raise."""
    key = F.lower(F.trim(name))
    known = {**{k: k for k in ARTIFACTS}, **ALIASES}
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), F.raise_error(F.concat(F.lit("unknown artifact "), name)).cast("string"))


def select_datasets(rows: DataFrame, selector: str) -> DataFrame:
    """The dataset of that id, else all of that process node, by node and size."""
    exact = F.max(F.when(F.col("dataset_id") == selector, 1).otherwise(0)).over(_everything())
    size = F.element_at(F.split("dataset_id", "/"), -1)
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SIZES)), size), F.lit(0)), F.lit(len(SIZES) + 1))
    hit = rows.withColumn("_e", exact).where(F.when(F.col("_e") == 1, F.col("dataset_id") == selector).otherwise(F.lower("process_node") == selector.lower()))
    return hit.withColumn("_r", rank).orderBy("process_node", "_r", "dataset_id").drop("_e", "_r")


def _everything():
    from pyspark.sql import Window

    return Window.partitionBy()  # the registry is a packaged list of datasets


def artifact_status(rows: DataFrame, present: DataFrame) -> DataFrame:
    """(dataset_id, artifact, exists). present: (dataset_id, path) of what lies on disk."""
    wanted = rows.select("dataset_id", F.explode("artifacts").alias("artifact", "path"))
    return wanted.join(present.distinct().withColumn("_p", F.lit(True)), ["dataset_id", "path"], "left").select("dataset_id", "artifact", "path", F.col("_p").isNotNull().alias("exists"))


def missing_artifacts(rows: DataFrame, present: DataFrame) -> DataFrame:
    return artifact_status(rows, present).where("not exists").select("dataset_id", "artifact")


def windows(spark: SparkSession, text: str) -> DataFrame:
    """Windows of a window list, renamed W0, W1, … across designs in file order; designs lacking a file raise."""
    import yaml

    rows = []
    for d in (yaml.safe_load(text) or {}).get("designs") or []:
        lacking = [k for k in ("gds", "def", "stack", "layermap") if not d.get(k)]
        if lacking:
            raise ValueError(f"design {d.get('name')} lacks {', '.join(lacking)}")
        for w in d.get("windows") or []:
            rows.append((f"W{len(rows)}", w.get("name"), d.get("name"), d.get("tech_node"), w.get("size_category"), *[float(w[k]) for k in ("x1", "y1", "x2", "y2")]))
    return spark.createDataFrame(rows, "window_id string, original_name string, design string, tech string, size string, x1 double, y1 double, x2 double, y2 double")


def tech_stack(spark: SparkSession, tech: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Stack entries in order, and vias."""
    import yaml

    doc = yaml.safe_load(text) or {}
    num = lambda v: None if v is None else float(v)
    stack = [(tech, i, e["name"], e.get("type"), float(e.get("thickness_um") or 0), num(e.get("er")), num(e.get("wmin_um"))) for i, e in enumerate(doc.get("stack") or [])]
    vias = [(tech, k, v.get("from"), v.get("to"), num(v.get("wmin_um"))) for k, v in (doc.get("vias") or {}).items()]
    return (
        spark.createDataFrame(stack, "tech string, pos int, name string, type string, thickness double, er double, wmin double"),
        spark.createDataFrame(vias, "tech string, via string, from_metal string, to_metal string, wmin double"),
    )


def layermap(files: DataFrame, lower: bool = False) -> DataFrame:
    """(layer_name, gds, dtype) of lines ``gds/dtype : name (gds/dtype)``; the data type defaults to 0, ``#`` comments."""
    line = F.regexp_replace("line", r"\s*#.*$", "")
    pattern = r"^\s*(\d+)(?:\s*/\s*(\d+))?\s*:\s*([^\s(]+)"
    rows = lines(files).where(line.rlike(pattern)).select(F.regexp_extract(line, pattern, 3).alias("layer_name"), F.regexp_extract(line, pattern, 1).cast("int").alias("gds"), F.coalesce(F.regexp_extract(line, pattern, 2).try_cast("int"), F.lit(0)).alias("dtype"))
    return rows.withColumn("layer_name", F.lower("layer_name")) if lower else rows


def annotations(spark: SparkSession, path: str) -> DataFrame:
    schema = "cap double, cap_type string, conductor_num int, point_num int, electrode1_point_num int, electrode2_point_num int, point_cloud_path string"
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def clean_annotations(rows: DataFrame, kind: str) -> DataFrame:
    """Capacitances of 1e-17 at least; couplings need more than two fifths of the points on the two electrodes."""
    ok = F.col("cap") >= 1e-17
    return rows.where(ok if kind == "total" else ok & (F.try_divide(F.col("electrode1_point_num") + F.col("electrode2_point_num"), F.col("point_num")) > 0.4))
