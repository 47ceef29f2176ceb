"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold them). Token capacity flows from
patterns to source quotas: each pattern offers its size once for nothing, a second and third time at rising
cost, and every source takes its target. The flow gives each pattern the words that the mix takes from it:
whole repeats of all its documents, and a remainder for which documents are selected in a seeded order. The
remainder's cut is found by refining histograms of the order (1,024 ranges a level), so that a pattern with a
third of all rows is never sorted in one task.

Only aggregates reach the driver: a row a pattern, ``MAX_PATTERNS`` at most.

Defined results: null texts have size 0 and are taken as 0; a null source is a source, the last; the seeded order
follows the id, and for null ids the text, so that rows that repeat both are taken alike; no documents, or none with a
word, give targets of 0; an empty table gives an empty result; columns other than id, text and source are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Hashable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runtime import if_small, local_rows, materialize

COPIES = 3  # times that a document can be taken
COSTS = (0, 1, 3)  # of a word taken once, again, a third time: convex
WEIGHTS = (1, 2, 3)
SEED = 20240607
BITS = 10  # ranges of the seeded order that a level tells apart, as a power of two
LEVELS = 2
MAX_PATTERNS = 200_000


def words(text: Column) -> Column:
    """Number of words: runs of other characters than the six ASCII blanks."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quotas(sizes: dict[Hashable, int], weights: dict[Hashable, float], copies: int = COPIES) -> dict[Hashable, float]:
    """Shares of the total by weight, at most ``copies`` times a source's size; the excess is shared again."""
    total, target, open_ = float(sum(sizes.values())), {}, list(sizes)
    left = total
    while open_:
        weight = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / weight > copies * sizes[s]]
        if not over:
            target |= {s: left * weights[s] / weight for s in open_}
            break
        target |= {s: float(copies * sizes[s]) for s in over}
        left = total - sum(target.values())
        open_ = [s for s in open_ if s not in target]
    return target


def whole(target: dict[Hashable, float]) -> dict[Hashable, int]:
    """Integer quotas with the same sum, by largest remainder."""
    out = {s: int(t) for s, t in target.items()}
    short = round(sum(target.values())) - sum(out.values())
    for s in sorted(target, key=lambda s: -(target[s] - int(target[s])))[: max(0, short)]:
        out[s] += 1
    return out


def min_cost_flow(capacity: list[int], members: list[list[int]], quota: list[int], costs: tuple[int, ...] = COSTS) -> list[list[int]]:
    """Words from pattern i to source j, by the primal-dual method: a phase for each path cost, all its paths at once.

    capacity: of each pattern, per copy; members: the sources of each pattern; quota: of each source. Fills the
    quotas as far as the copies allow, at least total cost.
    """
    n, m = len(capacity), len(quota)
    src, dst = n + m, n + m + 1
    to, room, cost, out = [], [], [], [[] for _ in range(n + m + 2)]

    def arc(a: int, b: int, c: int, w: int) -> None:
        for x, y, r, p in ((a, b, c, w), (b, a, 0, -w)):
            out[x].append(len(to))
            to.append(y)
            room.append(r)
            cost.append(p)

    for i, c in enumerate(capacity):
        for w in costs:
            arc(src, i, c, w)
        for j in members[i]:
            arc(i, n + j, c * len(costs), 0)
    for j, q in enumerate(quota):
        arc(n + j, dst, q, 0)
    height = [0] * (n + m + 2)
    while _raise_heights(src, dst, to, room, cost, out, height):
        _push_cheapest(src, dst, to, room, cost, out, height)
    flow = [[0] * m for _ in range(n)]
    for i in range(n):
        for e in out[i]:
            if n <= to[e] < n + m:
                flow[i][to[e] - n] = room[e ^ 1]
    return flow


def _raise_heights(src: int, dst: int, to: list, room: list, cost: list, out: list, height: list) -> bool:
    """Adds least path costs to the potentials, so that cheapest paths cost nothing; whether there is a path."""
    dist, done, heap = {src: 0}, set(), [(0, src)]
    while heap:
        d, x = heapq.heappop(heap)
        if x in done:
            continue
        done.add(x)
        for e in out[x]:
            y = to[e]
            if room[e] and y not in done and (k := d + cost[e] + height[x] - height[y]) < dist.get(y, 1 << 62):
                dist[y] = k
                heapq.heappush(heap, (k, y))
    if dst not in dist:
        return False
    far = max(dist.values())
    height[:] = [h + dist.get(x, far) for x, h in enumerate(height)]
    return True


def _push_cheapest(src: int, dst: int, to: list, room: list, cost: list, out: list, height: list) -> None:
    """Fills paths of no reduced cost, shortest first, until none is left."""
    free = lambda e, x: room[e] and cost[e] + height[x] - height[to[e]] == 0
    while True:
        level, front = {src: 0}, [src]
        while front and dst not in level:
            nxt = []
            for x in front:
                for e in out[x]:
                    if to[e] not in level and free(e, x):
                        level[to[e]] = level[x] + 1
                        nxt.append(to[e])
            front = nxt
        if dst not in level:
            return
        at, path, x = [0] * len(out), [], src
        while True:
            if x == dst:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                k = next(i for i, e in enumerate(path) if not room[e])
                x, path = to[path[k] ^ 1], path[:k]
            elif at[x] < len(out[x]):
                e = out[x][at[x]]
                if free(e, x) and level.get(to[e], -1) == level[x] + 1:
                    path.append(e)
                    x = to[e]
                else:
                    at[x] += 1
            elif path:
                x = to[path.pop() ^ 1]
                at[x] += 1
            else:
                break


def cut(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per pattern the seeded order's place before which documents are selected: sizes there sum to ``rest``, nearly.

    rows: (p, o, size), o the place (63 bits); wanted: (p, rest). Result: (p, place).
    """
    state = wanted.select("p", "rest", F.lit(0).cast("long").alias("from"))
    left = rows
    for level in range(LEVELS):
        shift = 63 - BITS * (level + 1)
        ranged = left.select("p", F.shiftright("o", shift).alias("r"), "size").groupBy("p", "r").agg(F.sum("size").alias("size"))
        upto = F.sum("size").over(W.partitionBy("p").orderBy("r").rowsBetween(W.unboundedPreceding, -1))
        before = ranged.join(state.select("p", "rest"), "p").select("p", "r", "rest", F.coalesce(upto, F.lit(0)).alias("before"))
        # The last range that begins before the remainder is filled holds the cut.
        last = before.where("before <= rest").groupBy("p").agg(F.max_by(F.struct("r", "before", "rest"), "r").alias("l"))
        state = materialize(last.select("p", (F.col("l.rest") - F.col("l.before")).alias("rest"), F.shiftleft("l.r", shift).alias("from")), "mixing-cut")
        held = state.select("p", F.shiftright("from", shift).alias("r"))
        left = left.withColumn("r", F.shiftright("o", shift)).join(if_small(held, 64), ["p", "r"], "left_semi").select("p", "o", "size")
    places = left.groupBy("p", "o").agg(F.sum("size").alias("size"))
    order = W.partitionBy("p").orderBy("o")
    run = places.select("p", "o", F.sum("size").over(order).alias("upto"), "size").join(state.select("p", "rest"), "p")
    # A document across the cut is in where that comes nearer.
    ins = run.where(F.col("upto") - F.col("size") / 2 <= F.col("rest")).groupBy("p").agg(F.max("o").alias("o"))
    return state.join(ins, "p", "left").select("p", F.coalesce(F.col("o") + 1, F.col("from")).alias("place"))


def place(id_col: str, text_col: str, seed: int) -> Column:
    """A row's place in the seeded order: 63 bits of a hash."""
    key = F.xxhash64(F.lit(seed), F.col(id_col), F.when(F.col(id_col).isNull(), F.col(text_col)))
    return F.shiftrightunsigned(key, 1)


def plan(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Per membership pattern ``p`` of rows (p, o, size): ``full`` repeats of all its documents and the place ``upto``
    before which they are taken once more; size and target of its first source."""
    spark = rows.sparkSession
    found = rows.groupBy("p").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    found = sorted(found, key=lambda r: [(s is None, s or "") for s in r["p"]])
    names = sorted({s for r in found for s in r["p"]}, key=lambda s: (s is None, s or ""))
    sizes = dict.fromkeys(names, 0)
    for r in found:
        for s in r["p"]:
            sizes[s] += r["size"]
    # Sources that share documents count them once in the total that is shared out.
    total = sum(r["size"] for r in found)
    scale = total / max(sum(sizes.values()), 1)
    target = quotas({s: sizes[s] for s in names}, {s: weights[i % len(weights)] for i, s in enumerate(names)})
    target = {s: t * scale for s, t in target.items()} if scale < 1 else target
    quota, at = whole(target), {s: i for i, s in enumerate(names)}
    flow = min_cost_flow([r["size"] for r in found], [[at[s] for s in r["p"]] for r in found], [quota[s] for s in names])
    planned = []
    for r, f in zip(found, flow, strict=True):
        full, rest = divmod(sum(f), r["size"]) if r["size"] else (0, 0)
        first = r["p"][0] if r["p"] else None
        planned.append((list(r["p"]), full, rest, sizes.get(first, 0), float(target.get(first, 0.0))))
    out = materialize(local_rows(spark, planned, "p array<string>, full long, rest long, source_size long, target double"), "mixing-plan")
    places = materialize(cut(rows.select("p", "o", "size"), out.where("rest > 0").select("p", "rest")), "mixing-places")
    return materialize(out.join(places, "p", "left").select("p", "full", F.col("place").alias("upto"), "source_size", "target"), "mixing-plan")


def times(o: Column) -> Column:
    """How often a row at place ``o`` is taken, beside the columns of its pattern's plan."""
    return (F.col("full") + F.when(o < F.col("upto"), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, sources: Column, id_col: str = "doc_id", text_col: str = "text", weights: tuple[float, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """Per row: id, ``size``, ``source_size``, ``target`` (of its first source) and ``taken`` words.

    ``sources``: an array of the sources that hold a row's document, sorted and without repeats.
    """
    rows = materialize(docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("size"), sources.alias("p"), place(id_col, text_col, seed).alias("o")), "mixing-rows")
    out = rows.join(if_small(plan(rows, weights), 256), "p")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * times(F.col("o"))).alias("taken"))


def select_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """``docs`` with each row as often as the mix takes it (not at all, or up to ``COPIES`` times); same columns.

    The number of copies follows in the row from its pattern's plan, so that texts stay where they are.
    """
    keys = [F.array(F.col(source_col)).alias("p"), place(id_col, text_col, seed).alias("o"), words(F.col(text_col)).alias("size")]
    planned = plan(materialize(docs.select(*keys), "mixing-rows"), weights)
    rows = docs.select(F.struct(*docs.columns).alias("doc"), *keys).join(if_small(planned, 256), "p")
    # Documents without words cost nothing and stay once.
    copies = F.explode(F.array_repeat("doc", F.when(F.col("size") == 0, 1).otherwise(times(F.col("o")))))
    return rows.select(copies.alias("doc")).select("doc.*")
