"""Exact top-k inner products by a pivot-distance index.

Vectors get one coordinate more, the root of (largest squared length - own squared length), and queries a zero
there; then the inner product is largest where the distance is smallest. Pivots are chosen on a bounded sample
by farthest-first. Every vector is keyed by its nearest pivot and the distance to it, and range-sorted by that
key (ties by id, so that one vector that a third of all rows repeat still spreads) into blocks: annuli around a
pivot. By the triangle inequality no vector of annulus [lo, hi] around p is nearer to q than lo - d(q, p) or
d(q, p) - hi.

Queries go in chunks. Which chunk meets which annulus is decided on slim rows without vectors: the annulus's pivot, lo
and hi, the chunk's distances to the pivots and its reach, the distance of the k-th neighbour known so far. First, every
chunk visits its ``FIRST`` annuli of least bound, starting from the k-th best of the sample, and its reach shrinks to
what they hold. Then the other annuli within reach get their vectors; each task visits its own in order of the bound
and stops a chunk at the first that lies beyond reach.

All rows but queries' own are candidates and every visited block is scored exactly (integer arithmetic in doubles
below 2^53, in Python integers above), so results are exact; ties go to the smaller id. Where the vectors have many
independent dimensions, bounds rule out little and the search is a product of queries and rows in blocks.

Defined results: vectors that are null or hold null, NaN or infinite components take no part; shorter vectors
count as padded with zeros; rows that share a query's id are its own; a null id takes no part; scores beyond 64
bits are cut to 64 bits; queries with fewer candidates than k return all; rows that repeat an id are candidates each;
queries that repeat an id are one query, of the smallest vector; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runtime import batches_of, if_small, materialize

SAMPLE = 2_048  # vectors that choose pivots and give first bounds
PIVOTS = 24
BLOCK = 2_048  # vectors of an annulus at most
CHUNK = 1_024  # queries that travel together
FIRST = 8  # annuli that a chunk visits before its reach is fixed
UNIT = 64  # annuli, about, that a task visits for one chunk
SCALE = 256


def usable(v: Column) -> Column:
    """Whether a vector has only finite components."""
    return F.coalesce(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def quantized(v: Column, scale: int = SCALE) -> Column:
    return F.transform(v, lambda x: F.call_function("floor", x.cast("double") * scale).cast("double"))


class Space:
    """Dimension, value range and pivots; small, and sent with the functions that need it."""

    def __init__(self, dim: int, most: float, longest: float, ids: np.ndarray, sample: np.ndarray):
        self.dim, self.square = dim, longest
        self.dtype = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
        self.exact = dim * most * most < 2**53
        self.sample_ids, self.sample = ids, sample
        lifted = self.lift(sample)
        # Farthest-first: each pivot is the sample's vector farthest from those chosen.
        chosen = [0] if len(lifted) else []
        far = np.full(len(lifted), np.inf)
        while chosen and len(chosen) < min(PIVOTS, len(lifted)):
            far = np.minimum(far, ((lifted - lifted[chosen[-1]]) ** 2).sum(1))
            if far.max() <= 0:
                break
            chosen.append(int(far.argmax()))
        self.pivots = lifted[chosen]

    def matrix(self, vectors) -> np.ndarray:
        out = np.zeros((len(vectors), self.dim))
        for i, v in enumerate(vectors):
            out[i, : len(v)] = v
        return out

    def lift(self, m: np.ndarray, query: bool = False) -> np.ndarray:
        extra = np.zeros(len(m)) if query else np.sqrt(np.clip(self.square - (m * m).sum(1), 0, None))
        return np.column_stack([m, extra])

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        """To every pivot."""
        d = (lifted * lifted).sum(1)[:, None] + (self.pivots * self.pivots).sum(1) - 2 * lifted @ self.pivots.T
        return np.sqrt(np.clip(d, 0, None))

    def scores(self, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if self.exact:
            return (queries @ rows.T).astype(np.int64)
        as_int = np.frompyfunc(int, 1, 1)
        wide = as_int(queries).dot(as_int(rows).T)
        return np.clip(wide, -(2**63), 2**63 - 1).astype(np.int64)


def fit(rows: DataFrame) -> Space:
    """``Space`` of rows (id, v): two aggregates over all rows and the sample of least hash."""
    size = rows.agg(
        F.coalesce(F.max(F.size("v")), F.lit(0)),
        F.coalesce(F.max(F.array_max(F.transform("v", F.abs))), F.lit(0.0)),
        F.coalesce(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), F.lit(0.0)),
    ).first()
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("id", "v").collect()
    dim = max(int(size[0]), 1)
    m = np.zeros((len(sample), dim))
    for i, r in enumerate(sample):
        m[i, : len(r["v"])] = r["v"]
    return Space(dim, float(size[1]), float(size[2]), np.array([r["id"] for r in sample], dtype=np.int64), m)


KEYED = "id long, pivot int, dist double, vec binary"
BLOCKS = "block long, pivot int, lo double, hi double, ids binary, mat binary"


def keyed(rows: DataFrame, space: Space, query: bool) -> DataFrame:
    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b) and len(space.pivots):
                m = space.matrix(b["v"])
                d = space.distances(space.lift(m, query))
                near = d.argmin(1)
                packed = [r.tobytes() for r in m.astype(space.dtype)]
                yield pd.DataFrame({"id": b["id"], "pivot": near.astype(np.int32), "dist": d[np.arange(len(m)), near], "vec": packed})

    return rows.select("id", "v").mapInPandas(key, KEYED)


def packed(rows: DataFrame, most: int, by_pivot: bool) -> DataFrame:
    """Range-sorted runs of keyed rows, ``most`` a run at most; with ``by_pivot`` a run has one pivot."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(parts, "pivot", "dist", "id").sortWithinPartitions("pivot", "dist", "id")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        at, held = TaskContext.get().partitionId() << 32, []

        def run(rows: list[tuple]) -> pd.DataFrame:
            nonlocal at
            at += 1
            ids = np.array([r[0] for r in rows], dtype="<i8").tobytes()
            return pd.DataFrame([(at, rows[0][1], min(r[2] for r in rows), max(r[2] for r in rows), ids, b"".join(r[3] for r in rows))], columns=["block", "pivot", "lo", "hi", "ids", "mat"])

        for b in batches:
            for row in zip(b["id"], b["pivot"], b["dist"], b["vec"], strict=True):
                if held and (len(held) == most or by_pivot and held[0][1] != row[1]):
                    yield run(held)
                    held = []
                held.append(row)
        if held:
            yield run(held)

    return ordered.mapInPandas(pack, BLOCKS)


def directions(chunks: DataFrame, space: Space, k: int) -> DataFrame:
    """Per chunk and pivot: least and largest distance of its queries, and the chunk's reach after the sample."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                found, n = Found(r.ids, r.mat, space, k), len(space.pivots)
                yield pd.DataFrame({"chunk": [r.block] * n, "pivot": np.arange(n, dtype=np.int32), "near": found.dist.min(0), "far": found.dist.max(0), "reach": [found.reach().max()] * n})

    return chunks.mapInPandas(deal, "chunk long, pivot int, near double, far double, reach double")


def meetings(ways: DataFrame, annuli: DataFrame, count: int) -> DataFrame:
    """Slim pairs of chunks and annuli within reach: chunk, block, bound. Pivots are salted, ``count`` annuli in all."""
    salts = max(1, count // (PIVOTS * 1_024))
    left = ways.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    right = annuli.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))
    bound = F.greatest(F.col("lo") - F.col("far"), F.col("near") - F.col("hi"), F.lit(0.0))
    return left.join(right, ["pivot", "salt"]).withColumn("bound", bound).where("bound <= reach").select("chunk", "block", "bound")


class Found:
    """A chunk's queries and the k best found for each, as flat arrays: query's place, id, score."""

    def __init__(self, ids: bytes, mat: bytes, space: Space, k: int, floor: bytes | None = None):
        self.space, self.k = space, k
        self.ids = np.frombuffer(ids, "<i8")
        self.m = np.frombuffer(mat, space.dtype).reshape(-1, space.dim).astype(float)
        self.dist, self.norm = space.distances(space.lift(self.m, query=True)), (self.m**2).sum(1)
        self.q = self.i = self.s = np.zeros(0, dtype=np.int64)
        n = len(self.ids)
        # A query is full once k candidates are known, found or of the sample; others can't be among its best below the floor.
        if floor is None:
            self.full, self.floor = np.zeros(n, dtype=bool), np.full(n, -(2**63), dtype=np.int64)
            first = space.scores(self.m, space.sample)
            for j, own in enumerate(self.ids[:, None] == space.sample_ids):
                if (~own).sum() >= k:
                    self.full[j], self.floor[j] = True, np.sort(first[j][~own])[-k]
        else:
            both = np.frombuffer(floor, "<i8").reshape(2, n)
            self.full, self.floor = both[0].astype(bool), both[1].copy()

    def reach(self) -> np.ndarray:
        """Distance beyond which no vector can be among a query's best."""
        d = np.sqrt(np.clip(self.norm + self.space.square - 2 * self.floor.astype(float), 0, None)) * (1 + 1e-9) + 1e-3
        return np.where(self.full, d, np.inf)

    def visit(self, pivot: int, lo: float, hi: float, ids: bytes, mat: bytes) -> None:
        d = self.dist[:, pivot]
        live = np.nonzero(np.maximum(lo - d, d - hi) <= self.reach())[0]
        if not len(live):
            return
        rows = np.frombuffer(ids, "<i8")
        s = self.space.scores(self.m[live], np.frombuffer(mat, self.space.dtype).reshape(-1, self.space.dim).astype(float))
        good = (self.ids[live][:, None] != rows) & (~self.full[live][:, None] | (s >= self.floor[live][:, None]))
        a, b = np.nonzero(good)
        q, i, s = np.concatenate([self.q, live[a]]), np.concatenate([self.i, rows[b]]), np.concatenate([self.s, s[a, b]])
        order = np.lexsort((i, ~s, q))  # not -s, which overflows at the least score
        q, i, s = q[order], i[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.k
        self.q, self.i, self.s = q[keep], i[keep], s[keep]
        last = place[keep] == self.k - 1
        self.full[self.q[last]] = True
        self.floor[self.q[last]] = np.maximum(self.floor[self.q[last]], self.s[last])


def search(pairs: DataFrame, space: Space, k: int) -> DataFrame:
    """Visits rows (chunk with queries, block with vectors) in order of chunk and bound, until a chunk's reach ends.

    A row per run of a chunk: its reach then, each query's floor, the blocks visited, and (query_id, vec_id, score).
    """

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, found, seen = None, None, []

        def out() -> pd.DataFrame:
            floor = np.stack([found.full.astype("<i8"), found.floor]).astype("<i8").tobytes()
            row = (chunk, float(found.reach().max()), floor, seen, found.ids[found.q].tolist(), found.i.tolist(), found.s.tolist())
            return pd.DataFrame([row], columns=["chunk", "reach", "floor", "seen", "query_ids", "vec_ids", "scores"])

        for b in batches:
            for r in b.itertuples(index=False):
                if r.chunk != chunk:
                    if found is not None:
                        yield out()
                    chunk, found, seen, open_ = r.chunk, Found(r.q_ids, r.q_mat, space, k, r.floor), [], True
                # Bounds rise within a chunk: beyond its reach nothing is left for it.
                open_ = open_ and r.bound <= found.reach().max()
                if open_:
                    found.visit(r.pivot, r.lo, r.hi, r.ids, r.mat)
                    seen.append(r.block)
        if found is not None:
            yield out()

    return pairs.mapInPandas(visit, "chunk long, reach double, floor binary, seen array<long>, query_ids array<long>, vec_ids array<long>, scores array<long>")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Per query and rank: ``query_id``, ``rank``, ``vec_id``, ``score``; ``is_query`` is an expression over ``vectors``."""
    spark = vectors.sparkSession
    flat = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("raw"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = flat.where(F.col("id").isNotNull() & usable(F.col("raw"))).select("id", "asks", quantized(F.col("raw"), scale).alias("v"))
    space = fit(rows)
    with batches_of(spark, BLOCK):
        blocks = materialize(packed(keyed(rows, space, query=False), BLOCK, by_pivot=True), "topk-blocks")
        asked = rows.where("asks").groupBy("id").agg(F.min("v").alias("v"))
        chunks = materialize(packed(keyed(asked, space, query=True), CHUNK, by_pivot=False), "topk-chunks")
    with batches_of(spark, 8):
        annuli = blocks.select("block", "pivot", "lo", "hi")
        ways = materialize(directions(chunks, space, k), "topk-ways")
        count = annuli.count()
        size = BLOCK * (8 + space.dim * np.dtype(space.dtype).itemsize)

        def visited(pairs: DataFrame, floors: DataFrame | None, fan: int, label: str) -> DataFrame:
            asking = chunks.select(F.col("block").alias("chunk"), F.col("ids").alias("q_ids"), F.col("mat").alias("q_mat"))
            asking = asking.withColumn("floor", F.lit(None).cast("binary")) if floors is None else asking.join(floors.select("chunk", "floor"), "chunk")
            met = pairs.join(if_small(asking, size), "chunk").join(blocks, "block")
            # A chunk's annuli spread over ``fan`` tasks.
            met = met.repartition("chunk", F.pmod(F.xxhash64("block"), F.lit(fan))).sortWithinPartitions("chunk", "bound", "block")
            return materialize(search(met, space, k), label)

        rank = F.row_number().over(W.partitionBy("chunk").orderBy("bound", "block"))
        nearest = meetings(ways, annuli, count).withColumn("r", rank).where(F.col("r") <= FIRST).drop("r")
        first = visited(nearest, None, 1, "topk-first")
        # What the nearest annuli hold narrows the reach before any other annulus gets its vectors.
        known = first.select("chunk", F.col("reach").alias("now"), "seen")
        left = meetings(ways.join(known, "chunk").withColumn("reach", F.least("reach", "now")).drop("now", "seen"), annuli, count)
        left = left.join(known, "chunk").where(~F.array_contains("seen", F.col("block"))).select("chunk", "block", "bound")
        rest = visited(left, first, max(1, count // UNIT), "topk-rest")
    found = first.unionByName(rest).select(F.explode(F.arrays_zip("query_ids", "vec_ids", "scores")).alias("f"))
    found = found.select(F.col("f.query_ids").alias("query_id"), F.col("f.vec_ids").alias("vec_id"), F.col("f.scores").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
