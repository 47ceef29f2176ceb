"""Hard negatives of anchors, by Strassen products of integer tiles and mergeable heaps.

Vectors are floored to integers and dealt by hash into blocks sorted by label; anchors likewise into chunks. Blocks are
dealt into groups, and each (group, chunk) is a task's work: the chunk's rows come first, then the group's blocks one
by one, so that a task holds one chunk and one block. The scores of a tile, anchors times candidates, are a Strassen
product: halves are multiplied by seven products of sums, odd sides padded with zeros, down to ``LEAF``. Sums are
exact in 64-bit integers (they wrap, and wrap back, as long as scores fit); tiles whose scores may not fit multiply
Python integers by the same recursion.

Two passes: the first fills a heap of each anchor's best of its own label (tiles whose labels don't meet are not
multiplied). The second, which knows the positives, fills a heap for each (anchor, positive) from the rows of other
labels within the positive's window. A heap keeps its ``k`` best, tiles and tasks merge into it in any order, and what
tasks leave over is ranked by anchor.

Defined results: rows with a null id, label or vector, or a null, NaN or infinite component, take no part; shorter
vectors count as padded with zeros; rows that share an anchor's id are its own and not its candidates; anchors that
repeat an id are one anchor, of the least label and vector; rows that repeat an id are candidates each; scores beyond 64
bits are cut to 64 bits; anchors with fewer positives or negatives return all; a negative positive score has an empty
window; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runtime import batches_of, materialize
from .topk import SCALE, quantized, usable

POSITIVES, NEGATIVES = 5, 5
LOW, HIGH = (80, 100), (100, 100)  # of a positive's score, as fractions
LEAF = 8
BLOCK = 1_024  # candidates of a tile, about
LEAST = 64  # candidates of a block where tasks would be few
CHUNK = 2_048  # anchors that travel together
TILE = 256  # anchors of a tile
GROUP = 64  # blocks of a group, at most

PACKED = "block long, ids binary, labels binary, mat binary"


def even(m: np.ndarray) -> np.ndarray:
    """``m`` with a row and a column of zeros where their numbers are odd."""
    rows, columns = m.shape
    if rows % 2 == columns % 2 == 0:
        return m
    out = np.full((rows + rows % 2, columns + columns % 2), 0, dtype=m.dtype)
    out[:rows, :columns] = m
    return out


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` by seven products of quarters, recursively; odd sides are padded with zeros."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    a, b = even(a), even(b)
    i, j, r = a.shape[0] // 2, b.shape[1] // 2, a.shape[1] // 2
    (a11, a12), (a21, a22) = (a[:i, :r], a[:i, r:]), (a[i:, :r], a[i:, r:])
    (b11, b12), (b21, b22) = (b[:r, :j], b[:r, j:]), (b[r:, :j], b[r:, j:])
    both = strassen(a11 + a22, b11 + b22, leaf)
    low, right = strassen(a21 + a22, b11, leaf), strassen(a11, b12 - b22, leaf)
    down, top = strassen(a22, b21 - b11, leaf), strassen(a11 + a12, b22, leaf)
    out = np.empty((2 * i, 2 * j), dtype=a.dtype)
    out[:i, :j] = both + down - top + strassen(a12 - a22, b21 + b22, leaf)
    out[:i, j:] = right + top
    out[i:, :j] = low + down
    out[i:, j:] = both - low + right + strassen(a21 - a11, b11 + b12, leaf)
    return out[:m, :n]


class Tiles:
    """Dimension and value range: how vectors are stored and multiplied."""

    def __init__(self, dim: int, most: float):
        self.dim = max(dim, 1)
        self.dtype = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
        self.fits = self.dim * most * most < 2**63

    def packed(self, vectors) -> bytes:
        out = np.zeros((len(vectors), self.dim), dtype=self.dtype)
        for row, v in zip(out, vectors, strict=True):
            row[: len(v)] = v
        return out.tobytes()

    def matrix(self, data: bytes) -> np.ndarray:
        m = np.frombuffer(data, self.dtype).reshape(-1, self.dim)
        return m.astype(np.int64) if self.fits else np.frompyfunc(int, 1, 1)(m)

    def scores(self, anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
        s = strassen(anchors, rows.T)
        return s if self.fits else np.clip(s, -(2**63), 2**63 - 1).astype(np.int64)


class Heaps:
    """The ``k`` best (score, id) of each of ``n`` owners, best first; ties to smaller ids. Merges in any order."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.owner = self.ids = self.score = np.zeros(0, dtype=np.int64)
        self.floor, self.last = np.full(n, -(2**63), dtype=np.int64), np.full(n, 2**63 - 1, dtype=np.int64)

    def push(self, owner: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Candidates that a full heap's last doesn't beat are left out at once."""
        floor = self.floor[owner]
        good = (score > floor) | (score == floor) & (ids <= self.last[owner])
        if not good.any():
            return
        o, i, s = (np.concatenate(x) for x in ((self.owner, owner[good]), (self.ids, ids[good]), (self.score, score[good])))
        order = np.lexsort((i, ~s, o))  # not -s, which overflows at the least score
        o, i, s = o[order], i[order], s[order]
        place = np.arange(len(o)) - np.searchsorted(o, o)
        keep = place < self.k
        self.owner, self.ids, self.score = o[keep], i[keep], s[keep]
        full = place[keep] == self.k - 1
        self.floor[self.owner[full]], self.last[self.owner[full]] = self.score[full], self.ids[full]

    def push_tile(self, owner: np.ndarray, ids: np.ndarray, score: np.ndarray, allowed: np.ndarray) -> None:
        """A tile's rows are owners', its columns candidates; ``allowed`` says which count."""
        floor, last = self.floor[owner][:, None], self.last[owner][:, None]
        allowed = allowed & ((score > floor) | (score == floor) & (ids <= last))
        if len(ids) > 4 * self.k and allowed.sum() > 4 * self.k * len(owner):
            # A row's k-th best is a floor at once; what ties with it stays.
            best = np.where(allowed, score, -(2**63))
            kth = np.partition(best, len(ids) - self.k, axis=1)[:, len(ids) - self.k, None]
            allowed = allowed & (score >= kth)
        a, b = np.nonzero(allowed)
        self.push(owner[a], ids[b], score[a, b])


def blocks_of(rows: DataFrame, tiles: Tiles, count: int, by: list[str], most: int) -> DataFrame:
    """Rows (id, label, v) dealt by a hash of ``by`` into ``count`` blocks of ``most`` at most (more blocks if need be), sorted by label."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = rows.select("id", "label", "v", F.pmod(F.xxhash64(*by), F.lit(max(1, count))).alias("block"))
    ordered = keyed.repartition(parts, "block").sortWithinPartitions("block", "label", "id")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, of, number = [], None, 0

        def run() -> pd.DataFrame:
            ids, labels = (np.array([r[i] for r in held], dtype="<i8").tobytes() for i in (0, 1))
            return pd.DataFrame([(of << 24 | number, ids, labels, tiles.packed([r[2] for r in held]))], columns=["block", "ids", "labels", "mat"])

        for b in batches:
            for row in zip(b["id"], b["label"], b["v"], b["block"], strict=True):
                if held and (row[3] != of or len(held) == most):
                    yield run()
                    held, number = [], number + 1 if row[3] == of else 0
                of = int(row[3])
                held.append(row)
        if held:
            yield run()

    return ordered.mapInPandas(pack, PACKED)


def dealt(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """Chunks and blocks as rows of their (group, chunk): the chunk first, then the group's blocks.

    A block travels once for each chunk, a chunk once for each group; groups hold up to ``GROUP`` blocks, fewer where
    tasks would be few.
    """
    parts = max(1, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    n, named = max(1, blocks.count()), [r["block"] for r in chunks.select("block").collect()]
    groups = min(n, max(-(-n // GROUP), -(-4 * parts // max(1, len(named)))))
    each = F.array(*[F.lit(c).cast("long") for c in named])
    held = blocks.select(F.lit(1).alias("kind"), F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("part"), F.explode(each).alias("chunk"), *blocks.columns, F.lit(None).cast("binary").alias("windows"))
    sent = chunks.select(F.lit(0).alias("kind"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), F.col("block").alias("chunk"), *blocks.columns, "windows")
    tasks = max(parts, min(groups * len(named), 4 * parts))
    return sent.unionByName(held).repartition(tasks, "part", "chunk").sortWithinPartitions("part", "chunk", "kind", "block")


def shares(labels: np.ndarray, their_labels: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """Tiles of equal labels, both sides sorted by label."""
    for label in np.intersect1d(labels, their_labels):
        (i, j), (a, b) = (np.searchsorted(x, [label, label], "left") + [0, np.count_nonzero(x == label)] for x in (labels, their_labels))
        for t in range(i, j, TILE):
            yield slice(t, min(j, t + TILE)), slice(a, b)


def search(work: DataFrame, tiles: Tiles, k: int, same: bool) -> DataFrame:
    """A row for each heap of each (group, chunk): ``owner`` (anchor's id), ``place`` (of its window), ids, scores.

    ``same``: candidates of the anchor's label; otherwise those of other labels within each of its windows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None

        def out() -> pd.DataFrame:
            return pd.DataFrame({"anchor_id": ids[heaps.owner // wide], "place": (heaps.owner % wide).astype(np.int32), "vec_id": heaps.ids, "score": heaps.score})

        for b in batches:
            for r in b.itertuples(index=False):
                if r.kind == 0:
                    if now is not None and len(heaps.owner):
                        yield out()
                    now = (r.part, r.chunk)
                    ids, labels, m = np.frombuffer(r.ids, "<i8"), np.frombuffer(r.labels, "<i8"), tiles.matrix(r.mat)
                    windows = None if same else np.frombuffer(r.windows, "<i8").reshape(len(ids), -1, 2)
                    wide = 1 if same else windows.shape[1]
                    heaps = Heaps(len(ids) * wide, k)
                elif now == (r.part, r.chunk):
                    theirs, their_labels, rows = np.frombuffer(r.ids, "<i8"), np.frombuffer(r.labels, "<i8"), tiles.matrix(r.mat)
                    for own, other in shares(labels, their_labels) if same else [(slice(t, t + TILE), slice(None)) for t in range(0, len(ids), TILE)]:
                        allowed = ids[own, None] != theirs[other]
                        if not same:
                            allowed &= labels[own, None] != their_labels[other]
                        s = tiles.scores(m[own], rows[other])
                        for w in range(wide):
                            within = allowed if same else allowed & (windows[own, w, :1] <= s) & (s <= windows[own, w, 1:])
                            heaps.push_tile((own.start + np.arange(len(s))) * wide + w, theirs[other], s, within)
        if now is not None and len(heaps.owner):
            yield out()

    return work.mapInPandas(run, "anchor_id long, place int, vec_id long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """Heaps of several tasks merged: the ``k`` best of each (anchor_id, place), with ``rank``."""
    rank = F.row_number().over(W.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def windows_of(chunks: DataFrame, positives: DataFrame, k: int, low: tuple[int, int], high: tuple[int, int]) -> DataFrame:
    """Chunks with ``windows``: for each anchor and rank the least and the largest negative score that counts."""

    def fill(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in left.itertuples(index=False):
            place = {int(i): p for p, i in enumerate(np.frombuffer(r.ids, "<i8"))}
            w = np.empty((len(place), k, 2), dtype=np.int64)
            w[:, :, 0], w[:, :, 1] = 2**63 - 1, -(2**63)  # no score lies within
            for anchor, rank, score in zip(right["anchor_id"].tolist(), right["rank"].tolist(), right["score"].tolist(), strict=True):
                # In Python integers: least n with low * score <= n, largest with n <= high * score.
                least, most = -(-low[0] * score // low[1]), high[0] * score // high[1]
                w[place[anchor], rank - 1] = np.clip([least, most], -(2**63), 2**63 - 1) if least <= most else [2**63 - 1, -(2**63)]
            out.append((*r, w.tobytes()))
        return pd.DataFrame(out, columns=[*left.columns, "windows"])

    places = chunks.select(F.col("block").alias("of"), F.explode(_ids_of("ids")).alias("anchor_id"))
    keyed = positives.join(places, "anchor_id").select("of", "anchor_id", "rank", "score")
    return chunks.groupBy("block").cogroup(keyed.groupBy("of")).applyInPandas(fill, PACKED + ", windows binary")


def _ids_of(col: str) -> Column:
    @F.pandas_udf("array<long>")
    def ids(data: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(x, "<i8") for x in data], dtype=object)

    return ids(col)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column | None = None, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = SCALE,
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: tuple[int, int] = LOW, high: tuple[int, int] = HIGH,
) -> DataFrame:
    """Rows ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``is_anchor`` and ``label`` (the label column where None) are expressions over ``vectors``. Of an anchor's first
    ``positives`` rows of its label each gets the first ``negatives`` rows of other labels whose score lies between
    ``low`` and ``high`` times the positive's.
    """
    spark = vectors.sparkSession
    label = (F.col(label_col) if label is None else label).cast("long")
    flat = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vec_col).alias("raw"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    rows = flat.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("raw"))).select("id", "label", "asks", quantized(F.col("raw"), scale).alias("v"))
    size = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(F.array_max(F.transform("v", F.abs))), F.lit(0.0)), F.count("*"), F.count_if("asks")).first()
    tiles, parts = Tiles(int(size[0]), float(size[1])), int(spark.conf.get("spark.sql.shuffle.partitions"))
    with batches_of(spark, BLOCK):
        blocks = materialize(blocks_of(rows, tiles, max(-(-size[2] // BLOCK), min(4 * parts, size[2] // LEAST)), ["id", "v"], 2 * BLOCK), "negatives-blocks")
    asked = rows.where("asks").groupBy("id").agg(F.min(F.struct("label", "v")).alias("own")).select("id", "own.label", "own.v")
    with batches_of(spark, CHUNK):
        chunks = materialize(blocks_of(asked, tiles, -(-size[3] // CHUNK), ["id"], 2 * CHUNK), "negatives-chunks")
    with batches_of(spark, 8):
        work = dealt(chunks.withColumn("windows", F.lit(None).cast("binary")), blocks)
        found = materialize(search(work, tiles, positives, same=True), "negatives-positives")
        best = materialize(ranked(found, positives), "negatives-best")
        windowed = materialize(windows_of(chunks, best, positives, low, high), "negatives-windows")
        found = materialize(search(dealt(windowed, blocks), tiles, negatives, same=False), "negatives-found")
    best = best.select("anchor_id", F.col("vec_id").alias("positive_id"), (F.col("rank") - 1).alias("place"), F.col("score").alias("positive_score"))
    out = ranked(found, negatives).join(best, ["anchor_id", "place"])
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
