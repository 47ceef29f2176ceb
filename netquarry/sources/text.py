"""Text files as DataFrames: a row a file, parsed on the executors into typed rows.

A file that can't be parsed gives one row whose ``error`` tells why, so that a batch goes on and bad files can
be listed. Plain and gzip files read alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


HELD = 5_000  # rows of small files that are given out together


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, window_id, text): the window is the file's name up to its first extension."""
    reader = spark.read.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return named(reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def named(files: DataFrame) -> DataFrame:
    return files.withColumn("window_id", F.regexp_extract("path", r"([^/]+?)(?:\.[^/.]+)*$", 1)).select("path", "window_id", "text")


def parsed(files: DataFrame, rows_of: Callable[[str], Iterator[dict]], schema: str) -> DataFrame:
    """Typed rows of all files: window_id, path, seq, the schema's fields and ``error``.

    ``rows_of`` yields dicts with a subset of the fields; ``seq`` numbers a file's rows.
    """
    fields = [f.strip().split(" ")[0] for f in schema.split(", ")]
    columns = ["window_id", "path", "seq", *fields, "error"]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for b in batches:
            for path, window, text in zip(b["path"], b["window_id"], b["text"], strict=True):
                rows: list[tuple] = []
                try:
                    for k, r in enumerate(rows_of(text or "")):
                        rows.append((window, path, k, *[r.get(f) for f in fields], None))
                except (ValueError, IndexError, KeyError) as e:
                    rows = [(window, path, 0, *[None] * len(fields), f"{type(e).__name__}: {e}")]
                held += rows
                if len(held) >= HELD:
                    yield pd.DataFrame(held, columns=columns, dtype=object)
                    held = []
        yield pd.DataFrame(held, columns=columns, dtype=object)

    return files.select("path", "window_id", "text").mapInPandas(parse, f"window_id string, path string, seq long, {schema}, error string")


def lines(files: DataFrame) -> DataFrame:
    """(window_id, path, seq, line): a row a line, in place order."""
    return files.select("window_id", "path", F.posexplode(F.split("text", r"\r?\n")).alias("seq", "line"))


def number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None
