"""Density shards as NumPy archives, one a shard, with a Parquet index of their windows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import numbered
from ..operators.samples import shards
from ..sources.npz import opened


def id_type(most: int) -> str:
    """The least of 1, 2, 4 and 8 bytes that hold the largest conductor id."""
    return next(t for t, bits in (("u1", 8), ("u2", 16), ("u4", 32), ("u8", 64)) if most < 1 << bits)


def write_shards(pixels: DataFrame, windows: DataFrame, path: str, layers: int, height: int, width: int, per_shard: int = 64) -> DataFrame:
    """Writes pixels (window_id, layer, y, x, density, cid) as dense archives of ``per_shard`` windows, in order of id.

    ``windows`` (window_id, …) lists the windows, those without pixels too. A task makes one shard at a time, so it holds that
    many windows' tensors; a file appears under its name when it is complete. Returns the index, which goes last.
    """
    spark = pixels.sparkSession
    placed = shards(numbered(windows, ["window_id"], "position"), per_shard)
    name = F.format_string("shard_%06d.npz", "shard_id")
    index = placed.withColumn("shard", name).drop("position")
    rows = index.select("window_id", "shard", "shard_offset").join(pixels, "window_id", "left")

    def write(g: pd.DataFrame) -> pd.DataFrame:
        import io
        import uuid

        import numpy as np

        ids = g.drop_duplicates("shard_offset").sort_values("shard_offset")["window_id"].astype(str).tolist()
        held = g[g["layer"].notna()]
        if (held["cid"] < 0).any():
            raise ValueError("negative conductor id")
        at = tuple(held[c].to_numpy(dtype=np.int64) for c in ("shard_offset", "layer", "y", "x"))
        density = np.zeros((len(ids), layers, height, width), dtype=np.float32)
        cids = np.zeros(density.shape, dtype=id_type(int(held["cid"].max()) if len(held) else 0))
        density[at], cids[at] = held["density"], held["cid"].to_numpy(dtype=np.int64)
        data = io.BytesIO()
        np.savez_compressed(data, density=density, id=cids, window_ids=np.array(ids, dtype=str))
        system, folder = opened(f"{path}/shards")
        system.create_dir(folder, recursive=True)
        shard = g["shard"].iloc[0]
        part = f"{folder}/.{shard}.{uuid.uuid4().hex}"
        with system.open_output_stream(part) as f:
            f.write(data.getvalue())
        system.move(part, f"{folder}/{shard}")
        return pd.DataFrame({"shard": [shard], "windows": [len(ids)]})

    wide = rows.withColumns({"cid": F.col("cid").cast("double"), "density": F.col("density").cast("double")})
    wide.groupBy("shard").applyInPandas(write, "shard string, windows long").write.mode("overwrite").parquet(f"{path}/written")
    index.write.mode("overwrite").parquet(f"{path}/windows")
    return spark.read.parquet(f"{path}/windows")


def write_clouds(points: DataFrame, path: str) -> None:
    """Writes an archive a window: members ``points`` (x, y, z, nx, ny, nz, diel, flux, net_id) and ``names``, in order of p_idx.

    points: the columns of ``sources.npz.POINTS``; missing ones are 0, missing names the id as text. A window's cloud is
    one file and one task's work, as readers take it.
    """
    from ..sources.npz import FEATURES

    given = [F.coalesce(F.col(c).cast("float"), F.lit(0.0)).cast("float").alias(c) if c in points.columns else F.lit(0.0).cast("float").alias(c) for c in FEATURES]
    net = F.col("net").cast("string") if "net" in points.columns else F.lit(None).cast("string")

    def write(g: pd.DataFrame) -> pd.DataFrame:
        import io
        import uuid

        import numpy as np

        g = g.sort_values("p_idx")
        names = {} if g["net"].isna().any() else {"names": g["net"].to_numpy(dtype=str)}
        data = io.BytesIO()
        np.savez_compressed(data, points=g[list(FEATURES)].to_numpy(dtype=np.float32), **names)
        system, folder = opened(path)
        system.create_dir(folder, recursive=True)
        window = g["window_id"].iloc[0]
        part = f"{folder}/.{window}.{uuid.uuid4().hex}"
        with system.open_output_stream(part) as f:
            f.write(data.getvalue())
        system.move(part, f"{folder}/{window}.npz")
        return pd.DataFrame({"window_id": [window], "points": [len(g)]})

    rows = points.select(F.col("window_id").cast("string").alias("window_id"), "p_idx", *given, net.alias("net"))
    written = rows.groupBy("window_id").applyInPandas(write, "window_id string, points long")
    written.write.format("noop").mode("overwrite").save()
