"""Where lineage is cut: the checkpoint folder of the session."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession


_LOCAL: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A folder that driver and executors share, below ``spark.checkpoint.dir``; on a local master without it a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/") + "/netquarry"
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="netquarry-"))
        atexit.register(shutil.rmtree, _LOCAL[0], True)
    return _LOCAL[0]


def ensure_checkpoints(spark: SparkSession) -> None:
    """Leaves ``spark.checkpoint.dir`` alone; where it is unset on a local master, sets a temporary folder."""
    sc = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir():
        return
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="netquarry-checkpoints-")
    atexit.register(shutil.rmtree, folder, True)
    sc.setCheckpointDir(folder)
