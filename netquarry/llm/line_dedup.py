"""Line dedup by two Bloom filters: lines once seen, and lines seen twice.

A line's key is the line stripped of ASCII space at both ends, A-Z lower-cased. Each task gathers the distinct long
keys of each of its documents and sets their bits: in its once filter for every key, in its twice filter for keys of
several documents. Filters meet segment by segment: what is set in both once filters is set in the twice filter. Only
segments with set bits travel, as sorted positions where few are set. The once filter stays in those segments, as large
as the corpus asks for, and never comes together; of the twice filter the halves are laid over each other until it has
``MOST_SEGMENTS`` (32 MB), which can only add suspects. So no repeated key is missed at any size.

Only keys that the twice filter suspects are hashed in full (SHA-256) and shuffled, one a document, pre-aggregated:
their documents are counted and the largest id that holds them is chosen. Where the keys to be dropped measure under the
bound they go to the scans; beyond it the keys that each document loses come by a join, which only the documents
that lose lines enter.

Defined results: a null or empty text is one empty line; every row is a document, also where ids repeat; rows of the
largest id that holds a line all keep it, with its repeats; a null id is smaller than any id; a text that loses all its
lines is empty; key lengths count code points; an empty table gives an empty result; other columns don't matter to
the results and stay as they are in :func:`drop_repeated_lines`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exact_dedup import BITMAP_BITS, bitmap, marked
from .runtime import BROADCAST_BYTES, batches_of, bound_batches, materialize

LEAST_CHARS = 40
LEAST_DOCS = 5
SEGMENT = 1 << 16  # bits
BITS_PER_KEY = 16
LEAST_SEGMENTS, MOST_SEGMENTS = 1 << 10, 1 << 12  # of a filter; the most of the twice filter when it is sent
HELD = 1 << 20  # keys' hashes that a task holds before it gives out its filters
DROP_BYTES = 256  # of a key that is sent to the scans, in a worker's dictionary

FILTERS = "segment long, once binary, twice binary"


def lines_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split(b"\n")


def key_of(line: bytes, least: int) -> bytes | None:
    """The key, None where it is shorter than ``least`` code points."""
    key = line.strip()  # of bytes: the six ASCII spaces
    if len(key) < least or not key.isascii() and len(key.decode("utf-8", "replace")) < least:
        return None
    return key.lower()  # of bytes: A-Z


def positions_of(hashes: np.ndarray, segments: int) -> np.ndarray:
    """Two bits for each hash, both in the hash's segment."""
    at = (hashes >> np.uint64(32)) % np.uint64(segments) * np.uint64(SEGMENT)
    return np.concatenate([at + (hashes & np.uint64(SEGMENT - 1)), at + (hashes >> np.uint64(16) & np.uint64(SEGMENT - 1))])


def packed(flags: np.ndarray) -> bytes:
    """A segment's set bits: positions, or the bits themselves where that is shorter."""
    at = np.flatnonzero(flags)
    return at.astype("<u2").tobytes() if len(at) * 2 < SEGMENT // 8 else np.packbits(flags).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    """Positions of the set bits."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8))) if len(data) == SEGMENT // 8 else np.frombuffer(data, "<u2")


def task_filters(docs: DataFrame, text_col: str, segments: int, least: int) -> DataFrame:
    """Filters of each task's documents, a row for each segment that has bits."""

    def cut(positions: np.ndarray) -> dict[int, np.ndarray]:
        positions = np.unique(positions)
        at = positions // np.uint64(SEGMENT)
        ends = np.flatnonzero(np.diff(at)) + 1
        starts = np.concatenate([[0], ends]).astype(int) if len(at) else []
        return {int(at[s]): p % np.uint64(SEGMENT) for s, p in zip(starts, np.split(positions, ends), strict=True)} if len(at) else {}

    def given(hashes: list[np.ndarray]) -> pd.DataFrame:
        seen, times = np.unique(np.concatenate(hashes), return_counts=True)
        once, twice = cut(positions_of(seen, segments)), cut(positions_of(seen[times > 1], segments))

        def bits(p: np.ndarray | None) -> bytes:
            flags = np.zeros(SEGMENT, dtype=bool)
            if p is None:
                return b""
            flags[p] = True
            return packed(flags)

        return pd.DataFrame({"segment": list(once), "once": [bits(p) for p in once.values()], "twice": [bits(twice.get(s)) for s in once]})

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_64_intdigest

        held, n = [], 0
        for b in batches:
            for text in b["text"]:
                keys = {xxh3_64_intdigest(k) for line in lines_of(text) if (k := key_of(line, least)) is not None}
                if keys:
                    held.append(np.fromiter(keys, dtype=np.uint64, count=len(keys)))
                    n += len(keys)
                if n >= HELD:
                    yield given(held)
                    held, n = [], 0
        if held:
            yield given(held)

    return docs.select(F.col(text_col).alias("text")).mapInPandas(gather, FILTERS)


def merged(filters: DataFrame) -> DataFrame:
    """One row a segment. Of two filters: once is either's once, twice is either's twice or both's once."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, once, twice = None, None, None

        def out() -> pd.DataFrame:
            return pd.DataFrame({"segment": [now], "once": [b""], "twice": [packed(twice)]})

        for b in batches:
            for segment, seen, again in zip(b["segment"], b["once"], b["twice"], strict=True):
                if segment != now:
                    if now is not None and twice.any():
                        yield out()
                    now, once, twice = segment, np.zeros(SEGMENT, dtype=bool), np.zeros(SEGMENT, dtype=bool)
                at = unpacked(seen)
                twice[at[once[at]]] = True
                once[at] = True
                twice[unpacked(again)] = True
        if now is not None and twice.any():
            yield out()

    parts = max(1, int(filters.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return filters.repartition(parts, "segment").sortWithinPartitions("segment").mapInPandas(fold, FILTERS)


class Suspects:
    """The twice filter as the scans see it: ``MOST_SEGMENTS`` segments at most, whatever the corpus's size."""

    def __init__(self, docs: DataFrame, text_col: str, least: int):
        spark = docs.sparkSession
        size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
        # A key has ``least`` bytes and more; that many again between the lines of a text is usual.
        wanted = size // (2 * max(least, 1)) * BITS_PER_KEY // SEGMENT
        self.full = max(LEAST_SEGMENTS, 1 << int(wanted).bit_length())
        self.segments = min(self.full, MOST_SEGMENTS)
        filters = materialize(merged(task_filters(docs, text_col, self.full, least)), "lines-twice")
        if self.full > self.segments:
            # Laid over each other: segment counts are powers of two, so a hash's folded segment is its own remainder.
            filters = materialize(merged(filters.select((F.col("segment") % self.segments).alias("segment"), "once", "twice")), "lines-folded")
        bits = np.zeros((self.segments, SEGMENT // 8), dtype=np.uint8)
        for r in filters.select("segment", "twice").toLocalIterator():
            flags = np.zeros(SEGMENT, dtype=bool)
            flags[unpacked(bytes(r["twice"]))] = True
            bits[r["segment"]] |= np.packbits(flags)
        self.bits = spark.sparkContext.broadcast(bits)

    def hit(self, hashes: np.ndarray) -> np.ndarray:
        p = positions_of(hashes, self.segments)
        found = self.bits.value.reshape(-1)[p >> np.uint64(3)] >> (np.uint8(7) - (p & np.uint64(7)).astype(np.uint8)) & 1
        return (found[: len(hashes)] & found[len(hashes) :]).astype(bool)


def suspected(docs: DataFrame, suspects: Suspects, least: int) -> DataFrame:
    """``docs`` (id, text and others) without text, and ``keys``: SHA-256 of the document's distinct suspected keys."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf("array<binary>")
    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from hashlib import sha256

        from xxhash import xxh3_64_intdigest

        for texts in batches:
            out = []
            for text in texts:
                found = list({k for line in lines_of(text) if (k := key_of(line, least)) is not None})
                hit = suspects.hit(np.array([xxh3_64_intdigest(k) for k in found], dtype=np.uint64)) if found else []
                out.append([sha256(k).digest() for k, h in zip(found, hit, strict=True) if h])
            yield pd.Series(out, dtype=object)

    return docs.withColumn("keys", keys("text")).drop("text")


def without(lines: list[bytes], drop, least: int) -> tuple[int, str | None]:
    """Lines dropped, and what stays joined (None if all)."""
    from hashlib import sha256

    stay = [x for x in lines if (k := key_of(x, least)) is None or not drop(sha256(k).digest())]
    return len(lines) - len(stay), None if len(stay) == len(lines) else b"\n".join(stay).decode("utf-8", "replace")


VERDICT = "n_lines long, n_dropped long, rest string"


def _with_lines(docs: DataFrame, id_col: str, text_col: str, least: int, least_docs: int, limit: int, bits: int) -> DataFrame:
    """Columns ``doc`` (the row) and ``of`` (its verdict)."""
    spark = docs.sparkSession
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    suspects = Suspects(docs, text_col, least)
    slim = rows.select("id", "text")
    with batches_of(spark, 256):
        found = suspected(slim, suspects, least).select("id", F.explode("keys").alias("key"))
        drops = found.groupBy("key").agg(F.count("*").alias("c"), F.max("id").alias("keep_id")).where(F.col("c") >= least_docs)
        drops = materialize(drops.select("key", F.col("keep_id").cast("string")), "lines-drops")
    of_id = F.col("id").cast("string")  # nulls among integers would come to Python as doubles
    bound_batches(spark)
    if drops.count() * DROP_BYTES <= limit:
        table = spark.sparkContext.broadcast({bytes(r["key"]): r["keep_id"] for r in drops.toLocalIterator()})

        @F.pandas_udf(VERDICT)
        def verdicts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            for ids, texts in batches:
                keep, out = table.value, []
                for own, text in zip(ids, texts, strict=True):
                    lines = lines_of(text)
                    out.append((len(lines), *(without(lines, lambda k: k in keep and keep[k] != own, least) if keep else (0, None))))  # noqa: B023
                yield pd.DataFrame(out, columns=["n_lines", "n_dropped", "rest"])

        return rows.select("doc", verdicts(of_id, "text").alias("of"))

    # Many keys: what each document loses, by its id and its text's hash, joined to the documents that lose any.
    @F.pandas_udf(VERDICT)
    def losses(texts: pd.Series, keys: pd.Series) -> pd.DataFrame:
        out = []
        for text, gone in zip(texts, keys, strict=True):
            lines, gone = lines_of(text), set() if gone is None else {bytes(k) for k in gone}
            out.append((len(lines), *(without(lines, gone.__contains__, least) if gone else (0, None))))
        return pd.DataFrame(out, columns=["n_lines", "n_dropped", "rest"])

    hashed = F.xxhash64(F.coalesce("text", F.lit("")))
    with batches_of(spark, 256):
        lost = suspected(slim.withColumn("its", hashed), suspects, least).distinct().select("id", "its", F.explode("keys").alias("key"))
        lost = lost.join(drops, "key").where(~F.col("id").cast("string").eqNullSafe(F.col("keep_id")))
        lost = materialize(lost.groupBy("id", "its").agg(F.collect_set("key").alias("gone")), "lines-lost")
    at = bitmap(lost.select("id", "its", F.lit(2).alias("c")), ["id", "its"], bits)
    judged = marked(rows.withColumn("its", hashed), [F.col("id"), F.col("its")], at, "hit")
    clean = judged.where("not hit").select("doc", "text", F.lit(None).cast("array<binary>").alias("gone"))
    lost = lost.select(F.col("id").alias("of_id"), F.col("its").alias("of_text"), "gone")
    dirty = judged.where("hit").join(lost, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("its") == F.col("of_text")), "left").select("doc", "text", "gone")
    return clean.unionByName(dirty).select("doc", losses("text", "gone").alias("of"))


def _kept(text: Column) -> Column:
    return F.coalesce("of.rest", text, F.lit(""))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, limit: int = BROADCAST_BYTES, bits: int = BITMAP_BITS) -> DataFrame:
    """Per row: the id, ``n_lines`` before dropping, ``n_dropped`` and ``kept``, the text that stays.

    Keys of at least ``least_chars`` code points in at least ``least_docs`` documents lose their lines but for
    those of the largest id.
    """
    out = _with_lines(docs, id_col, text_col, least_chars, least_docs, limit, bits)
    return out.select(F.col(f"doc.{id_col}").alias(id_col), "of.n_lines", "of.n_dropped", _kept(F.col(f"doc.{text_col}")).alias("kept"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``docs`` with the text that stays in place of the text (null stays null); all columns as they came."""
    out = _with_lines(docs, id_col, text_col, least_chars, least_docs, BROADCAST_BYTES, BITMAP_BITS)
    text = F.coalesce("of.rest", F.col(f"doc.{text_col}"))
    return out.select(*[text.alias(c) if c == text_col else F.col(f"doc.{c}").alias(c) for c in docs.columns])
