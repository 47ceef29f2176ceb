"""What the operators of this subpackage share: the scratch folder, cut lineage, checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A side of a join is broadcast only when its measured size is at most this many bytes.
BROADCAST_BYTES = 32 << 20
#: What a row of a broadcast hash table takes besides its values.
ROW_OVERHEAD = 96

#: Rows and bytes of an Arrow batch that goes to Python: bound a worker's memory also when texts are long.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "256", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}

_LOCAL: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where that is unset and the master is local (tests), a temporary folder, removed at exit.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/") + "/netquarry"
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="netquarry-")
        atexit.register(shutil.rmtree, _LOCAL["dir"], True)
    return _LOCAL["dir"]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{scratch(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: lineage ends there, on every executor's reach."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_rows(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A table of rows at hand. As an Arrow table, it starts no Python workers on the executors, which a list of rows does."""
    types = to_arrow_schema(StructType.fromDDL(schema))
    return spark.createDataFrame(pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(types)], schema=types))


def fits(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of ``df`` (cheap to count, as after :func:`materialize`) measure ``limit`` at most."""
    return df.count() * (row_bytes + ROW_OVERHEAD) <= limit


def if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, marked for broadcast if it :func:`fits`.

    Beyond it the join is left to the planner: exchanges of both sides, of which skewed parts are split.
    """
    return F.broadcast(df) if fits(df, row_bytes, limit) else df


def bound_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of lazy results by rows and bytes; all operators set the same values."""
    for k, v in ARROW.items():
        spark.conf.set(k, v)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Other bounds for what is materialized inside; puts the options back."""
    before = {k: spark.conf.get(k, None) for k in ARROW}
    bound_batches(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def block_of(text: Column, chars: int) -> Column:
    """The text, or of a longer one a block of ``chars`` code points at a place that its hash draws: for bounded samples."""
    place = F.pmod(F.xxhash64(text), F.greatest(F.length(text) - chars + 1, F.lit(1))).cast("int")
    return F.when(F.length(text) <= chars, text).otherwise(F.substring(text, place + 1, F.lit(chars)))


def cleanup(spark: SparkSession) -> None:
    """Removes everything that operators wrote to the shared folder; their lazy results can't be read after that."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
