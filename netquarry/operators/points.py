"""Point clouds: normalization, neighbours, sampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")


def normalized(points: DataFrame, keys: list[str]) -> DataFrame:
    """Centroid moved to the origin, largest radius scaled to 1; a single place stays at 0.

    Means and radius are aggregates joined back, so a large cloud is never one task.
    """
    mean = points.groupBy(*keys).agg(*[F.avg(c).alias(f"m_{c}") for c in XYZ])
    moved = points.join(mean, keys).withColumns({c: F.col(c) - F.col(f"m_{c}") for c in XYZ}).drop(*[f"m_{c}" for c in XYZ])
    radius = moved.groupBy(*keys).agg(F.max(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)).alias("r"))
    return moved.join(radius, keys).withColumns({c: F.when(F.col("r") > 0, F.col(c) / F.col("r")).otherwise(0.0) for c in XYZ}).drop("r")


TINY = 1e-15  # keeps the quotients of angles finite


def polar(points: DataFrame) -> DataFrame:
    """Radius, and the arcs of rho over z and of y over x of centred points: angles of quotients, in (-pi/2, pi/2]."""
    rho2 = F.col("x") ** 2 + F.col("y") ** 2
    arc = lambda a, b: F.atan(a / (b + TINY))
    return points.withColumns({"r": F.sqrt(rho2 + F.col("z") ** 2), "theta": arc(F.sqrt(rho2), F.col("z")), "phi": arc(F.col("y"), F.col("x"))})


def mirrored(points: DataFrame, axis: str | None) -> DataFrame:
    return points if axis is None else points.withColumn(axis, -F.col(axis))


def centroids(points: DataFrame, keys: list[str]) -> DataFrame:
    return points.groupBy(*keys).agg(*[F.avg(c).alias(f"c_{c}") for c in XYZ])


def square_distance(a: str, b: str) -> Column:
    return sum(((F.col(f"{a}{c}") - F.col(f"{b}{c}")) ** 2 for c in XYZ[1:]), (F.col(f"{a}x") - F.col(f"{b}x")) ** 2)


def nearest(queries: DataFrame, points: DataFrame, keys: list[str], k: int, per_cell: int = 8) -> DataFrame:
    """The k nearest points of a cloud per query point, ties to the smaller index. Clouds meet by key.

    queries: (keys, q_idx, q_x …); points: (keys, p_idx, p_x …). Points lie in the cells of a grid, some ``per_cell`` to a
    cell. A query looks into the cells around it ring by ring, first one, then twice as many; once it has k points it
    visits those other cells that lie nearer than the k-th, and no more. Queries that three rounds of rings don't satisfy
    look through the list of cells that hold points.
    """
    from ..lineage import ensure_checkpoints

    ensure_checkpoints(points.sparkSession)
    cell = [f"_{c}" for c in XYZ]
    lo, hi = (lambda c: F.col(f"_lo_{c}")), (lambda c: F.col(f"_hi_{c}"))
    span = points.groupBy(*keys).agg(F.count("*").alias("_n"), *[f(f"p_{c}").alias(f"_{e}_{c}") for c in XYZ for e, f in (("lo", F.min), ("hi", F.max))])
    # The cell's side: as long as a cube that holds ``per_cell`` points where they fill their box evenly.
    widest = F.greatest(*[hi(c) - lo(c) for c in XYZ])
    volume = F.lit(1.0)
    for c in XYZ:
        volume = volume * F.greatest(hi(c) - lo(c), widest / 64)
    side = F.when(widest > 0, F.cbrt(volume * per_cell / F.col("_n"))).otherwise(1.0)
    span = span.select(*keys, side.alias("_s"))
    held = points.join(span, keys)
    held = held.withColumns({f"_{c}": F.floor(F.col(f"p_{c}") / F.col("_s")) for c in XYZ}).select(*keys, "p_idx", *[f"p_{c}" for c in XYZ], *cell, "_s").checkpoint()
    cells = held.select(*keys, *cell).distinct()
    home = {f"_h{c}": F.floor(F.col(f"q_{c}") / F.col("_s")) for c in XYZ}
    asked = queries.join(span, keys).withColumns(home).select(*keys, "q_idx", *[f"q_{c}" for c in XYZ], *home, "_s").checkpoint()
    best = Window.partitionBy(*keys, "q_idx").orderBy("d2", "p_idx")

    def seen(visits: DataFrame) -> DataFrame:
        """The k best of the visited cells' points."""
        pairs = visits.join(held.drop("_s"), [*keys, *cell]).withColumn("d2", square_distance("q_", "p_"))
        return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(*keys, "q_idx", "rank", "p_idx", "d2")

    def ring(rows: DataFrame, inner: int, outer: int) -> DataFrame:
        """Visits of the cells more than ``inner`` and up to ``outer`` away (``inner`` -1: the home cell too)."""
        out = rows
        for c in XYZ:
            out = out.withColumn(f"_o{c}", F.explode(F.sequence(F.lit(-outer), F.lit(outer))))
        far = F.greatest(*[F.abs(f"_o{c}") for c in XYZ])
        return out.where(far > inner).withColumns({f"_{c}": F.col(f"_h{c}") + F.col(f"_o{c}") for c in XYZ})

    def gap() -> Column:
        """Squared distance of a query from a cell's box, a little less for rounding."""
        out = F.lit(0.0)
        for c in XYZ:
            low = F.col(f"_{c}") * F.col("_s")
            away = F.greatest(low - F.col(f"q_{c}"), F.col(f"q_{c}") - low - F.col("_s"), F.lit(0.0))
            out = out + away * away
        return out * (1 - 1e-9)

    found, left, inner = None, asked, -1
    for outer in (1, 2, 4):
        here = seen(ring(left, inner, outer))
        here = here if found is None else found.join(left.select(*keys, "q_idx"), [*keys, "q_idx"], "left_semi").unionByName(here).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        here = here.checkpoint()
        reach = here.groupBy(*keys, "q_idx").agg(F.max("rank").alias("_m"), F.max("d2").alias("_d2"))
        state = left.join(reach, [*keys, "q_idx"], "left")
        # Beyond the rings everything is ``outer`` sides away at least.
        full, settled = F.coalesce(F.col("_m") == k, F.lit(False)), F.col("_d2") < (outer * F.col("_s")) ** 2 * (1 - 1e-9)
        more = state.where(full & ~settled).withColumn("_outer", F.lit(outer))
        bounded = more if inner < 0 else bounded.unionByName(more)
        found = here if found is None else found.join(left.select(*keys, "q_idx"), [*keys, "q_idx"], "left_anti").unionByName(here)
        left, inner = state.where(~full).drop("_m", "_d2").checkpoint(), outer
        if not left.limit(1).count():
            break
    # What is full looks into the occupied cells within its k-th distance, what isn't into all that hold points.
    rest = bounded.unionByName(left.withColumns({"_m": F.lit(0), "_d2": F.lit(None).cast("double"), "_outer": F.lit(inner)}))
    within = F.col("_d2").isNull() | (gap() <= F.col("_d2"))
    new = F.greatest(*[F.abs(F.col(f"_{c}") - F.col(f"_h{c}")) for c in XYZ]) > F.col("_outer")
    last = seen(rest.join(cells, keys).where(within & new))
    return found.drop("rank").unionByName(last.drop("rank")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(*keys, "q_idx", "rank", "p_idx", "d2")


def ball(queries: DataFrame, points: DataFrame, keys: list[str], radius: float, n: int) -> DataFrame:
    """Per query the first ``n`` point indices within the radius, ascending, padded with the first.

    Candidates come from a grid of the radius' size: a query meets its own and the 26 cells around.
    """
    cell = lambda p: [F.floor(F.col(f"{p}{c}") / radius).alias(f"_{c}") for c in XYZ]
    around = F.sequence(F.lit(-1), F.lit(1))
    q = queries.select("*", *cell("q_"))
    for c in XYZ:
        q = q.withColumn("_d", F.explode(around)).withColumn(f"_{c}", F.col(f"_{c}") + F.col("_d")).drop("_d")
    near = q.join(points.select("*", *cell("p_")), [*keys, "_x", "_y", "_z"]).where(square_distance("q_", "p_") <= radius * radius)
    found = near.groupBy(*keys, "q_idx").agg(F.slice(F.array_sort(F.collect_list("p_idx")), 1, n).alias("ids"))
    return found.withColumn("ids", F.concat("ids", F.array_repeat(F.col("ids")[0], F.lit(n) - F.size("ids"))))


GROUPED = 100_000  # points of a cloud that one task takes at most
PENDING = 16  # rounds after which least distances are written down


def farthest(points: DataFrame, key: str, n: int, seed: int = 0, start: int | None = None, grouped: int = GROUPED) -> DataFrame:
    """Farthest point sampling per cloud: ``order`` and ``p_idx`` of n points, the first drawn by seed or at place ``start``.

    Clouds of ``grouped`` points at most are picked from in one task each. Larger ones go in rounds, all clouds at once: each
    round is a partial argmax of the least distances so far, ties to the smaller index as in the groups.
    """
    from ..lineage import ensure_checkpoints

    ensure_checkpoints(points.sparkSession)
    kind, index = dict(points.dtypes)[key], dict(points.dtypes)["p_idx"]
    sizes = points.groupBy(key).agg(F.count("*").alias("_n")).checkpoint()

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("p_idx")
        xyz = g[list(XYZ)].to_numpy(dtype=float)
        at = _start(len(xyz), seed, start)
        far, out = np.full(len(xyz), np.inf), []
        for _ in range(min(n, len(xyz))):
            out.append(at)
            far = np.minimum(far, ((xyz - xyz[at]) ** 2).sum(1))
            at = int(far.argmax())
        return pd.DataFrame({key: g[key].iloc[0], "order": np.arange(len(out)), "p_idx": g["p_idx"].to_numpy()[out]})

    schema = f"{key} {kind}, order long, p_idx {index}"
    small = points.join(sizes.where(F.col("_n") <= grouped), key, "left_semi").groupBy(key).applyInPandas(pick, schema)
    large = sizes.where(F.col("_n") > grouped)
    if not large.limit(1).count():
        return small
    rounds = _farthest_in_rounds(points.join(large.select(key), key, "left_semi"), large, key, n, seed, start)
    return rounds if not sizes.where(F.col("_n") <= grouped).limit(1).count() else small.unionByName(rounds)


def _start(size: int, seed: int, start: int | None) -> int:
    return int(np.random.default_rng(seed).integers(size)) if start is None else start % size


def _farthest_in_rounds(points: DataFrame, sizes: DataFrame, key: str, n: int, seed: int, start: int | None) -> DataFrame:
    from .quantiles import _ranked

    @F.pandas_udf("long")
    def place(size: pd.Series) -> pd.Series:
        return size.map(lambda s: _start(int(s), seed, start))

    first = _ranked(points, [key], "p_idx", sizes.select(key, F.lit(0).alias("want"), place("_n").alias("rank"))).select(key, F.col("value").alias("p_idx"))
    spot = F.struct("p_idx", *XYZ)
    chosen = points.join(first, [key, "p_idx"]).groupBy(key).agg(F.first(spot).alias("c")).select(key, F.array("c").alias("new"), F.lit(0).cast("long").alias("order")).checkpoint()
    state = points.select(key, "p_idx", *XYZ, F.lit(float("inf")).alias("far")).checkpoint()
    small = sizes.count() <= 100_000  # a row a cloud
    out = chosen.select(key, "order", F.col("new")[0]["p_idx"].alias("p_idx"))
    gap = lambda c: sum(((F.col(x) - c[x]) ** 2 for x in XYZ[1:]), (F.col("x") - c["x"]) ** 2)
    left = sizes
    for k in range(1, n):
        left = left.where(F.col("_n") > k)
        going = chosen.join(left.select(key), key, "left_semi")
        near = state.join(F.broadcast(going) if small else going, key).withColumn("far", F.least("far", F.array_min(F.transform("new", gap))))
        if k % PENDING == 0:
            state = near.select(key, "p_idx", *XYZ, "far").checkpoint()
            near = state.withColumn("new", F.array().cast(dict(chosen.dtypes)["new"]))
        best = near.groupBy(key).agg(F.max_by(spot, F.struct("far", (-F.col("p_idx")).alias("i"))).alias("c"), F.first("new").alias("new"))
        chosen = best.select(key, F.concat("new", F.array("c")).alias("new"), F.lit(k).cast("long").alias("order")).checkpoint()
        if not chosen.limit(1).count():
            break
        out = out.unionAll(chosen.select(key, "order", F.element_at("new", -1)["p_idx"].alias("p_idx")))
    return out


def resampled(points: DataFrame, keys: list[str], n: int, seed: int) -> DataFrame:
    """Exactly n rows per cloud by a seeded order; clouds with fewer repeat their rows in turn."""
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), "p_idx"), "p_idx")) - 1
    rows = points.withColumn("_k", k).withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where(F.col("_k") < n)
    times = F.floor((F.lit(n) - 1 - F.col("_k")) / F.col("_n")) + 1
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), times - 1))).drop("_k", "_n")


def block_frame(base: Column, v1: Column, v2: Column, h: Column) -> Column:
    """A block as the struct that :func:`surface_points` takes: a corner and three edge vectors, arrays of three."""
    return F.struct(base.alias("base"), v1.alias("v1"), v2.alias("v2"), h.alias("h"))


def _cross(a: Column, b: Column) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _length(v) -> Column:
    return F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


def face_counts(blocks: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Points per block (``count``) by its share of the window's surface, one at least.

    A block's surface counts as that of a cuboid with its edges' lengths; a block without any counts as 1.
    """
    a, b, c = (_length(F.col(f"frame.{v}")) for v in ("v1", "v2", "h"))
    area = 2 * (a * b + a * c + b * c)
    sized = blocks.withColumn("_area", F.when((area > 0) & (area < float("inf")), area))
    total = sized.groupBy(*keys).agg(F.sum("_area").alias("_sum"), F.count("*").alias("_n"))
    total = total.select(*keys, F.when(F.col("_sum") > 0, F.col("_sum")).otherwise(F.col("_n")).alias("_total"))
    return sized.join(total, keys).withColumn("count", F.greatest(F.lit(1), F.floor(n * F.coalesce("_area", F.lit(1.0)) / F.col("_total")))).drop("_area", "_total")


def surface_points(blocks: DataFrame, keys: list[str], n: int, seed: int) -> DataFrame:
    """Points on the surfaces of blocks, tilted ones too: faces by their area, uniform within, with the face's normal.

    blocks: (keys, block, net, frame), ``frame`` as :func:`block_frame` gives it. Normals are those of the block's upright
    faces: -z and z where the first two edges span the face, -y and y for the first and third, -x and x for the others.
    Draws are hashes of seed, block and number, so reruns agree.
    """
    # Draws of 40 bits.
    draw = lambda i: (F.pmod(F.xxhash64(F.lit(seed), F.lit(i), "block", "k"), F.lit(1 << 40)) / float(1 << 40))
    base, v1, v2, h = (F.col(f"frame.{v}") for v in ("base", "v1", "v2", "h"))
    areas = {f"_a{i}": F.coalesce(_length(_cross(a, b)), F.lit(0.0)) for i, (a, b) in enumerate([(v1, v2), (v1, h), (v2, h)])}
    rows = face_counts(blocks, keys, n).withColumns(areas).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))))
    all_ = F.col("_a0") + F.col("_a1") + F.col("_a2")
    at, none = draw(3) * all_, all_ == 0
    pair = F.when(none, F.floor(draw(3) * 3).cast("int")).when(at < F.col("_a0"), 0).when(at < F.col("_a0") + F.col("_a1"), 1).otherwise(2)
    rows = rows.withColumns({"_pair": pair, "_far": draw(4) >= 0.5, "_u": draw(1), "_v": draw(2)})
    is_pair = lambda i: F.col("_pair") == i
    far = F.when(F.col("_far"), 1.0).otherwise(0.0)
    # Shares of the three edges: two drawn, the third at one end.
    along = (F.when(is_pair(2), far).otherwise(F.col("_u")), F.when(is_pair(0), F.col("_v")).when(is_pair(1), far).otherwise(F.col("_u")), F.when(is_pair(0), far).otherwise(F.col("_v")))
    out = {c: base[i] + along[0] * v1[i] + along[1] * v2[i] + along[2] * h[i] for i, c in enumerate(XYZ)}
    out |= {f"n{c}": F.when(is_pair(i), 2 * far - 1).otherwise(0.0) for c, i in zip(XYZ, (2, 1, 0), strict=True)}
    return rows.withColumns(out).select(*keys, "block", "net", "k", *XYZ, "nx", "ny", "nz")


def drawn(rows: DataFrame, keys: list[str], ids: list[str], n: int, seed: int) -> DataFrame:
    """``n`` rows of each group (all, if fewer) by a seeded draw without replacement: those of least hash of ``ids``.

    The group's n-th least hash is found by refined quantiles, so that no task holds a group; ties go by ``ids``.
    """
    from .quantiles import order_statistic

    hashed = rows.withColumn("_h", F.xxhash64(F.lit(seed), *ids))
    last = order_statistic(hashed.select(*keys, "_h"), keys, "_h", n).withColumnRenamed("value", "_last")
    near = hashed.join(last, keys, "left").where(F.col("_last").isNull() | (F.col("_h") <= F.col("_last")))
    tied = near.where(F.col("_h") == F.col("_last")).withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*ids)))
    room = near.where(F.col("_h") < F.col("_last")).groupBy(*keys).agg(F.count("*").alias("_below"))
    tied = tied.join(room, keys, "left").where(F.col("_k") <= F.lit(n) - F.coalesce("_below", F.lit(0))).drop("_k", "_below")
    return near.where(F.col("_last").isNull() | (F.col("_h") < F.col("_last"))).unionByName(tied).drop("_h", "_last")


def surface_cloud(blocks: DataFrame, media: DataFrame, masters: DataFrame, keys: list[str], n: int, seed: int) -> DataFrame:
    """At most n points per window on its conductors' surfaces, with normals, permittivity and flux.

    blocks: as in :func:`surface_points`, with ``tech``; media: (tech, er, z_top); masters: (keys, pos, neg). Flux is 1 on
    the positive conductor's points, -1 on the negative's, else 0. Every block has its share of points, one at least; of
    more than n in all n are drawn without replacement.
    """
    rows = drawn(surface_points(blocks, keys, n, seed), keys, ["block", "k"], n, seed + 1)
    return charged(rows.join(blocks.select(*keys, "tech").distinct(), keys), media, masters, keys)


def charged(rows: DataFrame, media: DataFrame, masters: DataFrame, keys: list[str]) -> DataFrame:
    """Points (keys, tech, net, z …) with the permittivity at their height and the flux of their net."""
    from .samples import flux
    from .stack import dielectric_at

    return dielectric_at(rows, media).join(masters, keys).withColumn("flux", flux(F.col("net"), F.col("pos"), F.col("neg"))).drop("pos", "neg", "tech")


def grid_cells(points: DataFrame, bounds: dict[str, tuple[Column | float, Column | float]], n: int) -> DataFrame:
    """Interval number per axis between ``n`` evenly spaced edges, the last edge included: 0 to n - 2; -1 outside the bounds.

    bounds: least and largest value of each axis, numbers or columns.
    """
    def cell(c: str) -> Column:
        lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in bounds[c])
        step = F.least(F.floor((F.col(c) - lo) / (hi - lo) * (n - 1)), F.lit(n - 2))
        return F.when((F.col(c) < lo) | (F.col(c) > hi) | (hi <= lo), -1).otherwise(step).cast("int")

    return points.withColumns({f"g{c}": cell(c) for c in XYZ})


def spread_density(points: DataFrame, key: str, n: int, decay: float = 0.9, start: float = 0.9) -> DataFrame:
    """The density of every cell of each cloud's ``n`` x ``n`` x ``n`` grid: (key, gx, gy, gz, points, density).

    points: (key, gx, gy, gz, is_seed). Cells with a seed point have ``start``; from there density spreads to the six
    neighbours, step by step: a cell takes the least density of its neighbours that are reached already, times ``decay`` if
    one of these holds points, unchanged if it comes through empty cells alone. A cloud without seeds has none.

    Points are counted by cell before a cloud's cells meet, so that a group holds ``n`` to the third rows at most.
    """
    kind = dict(points.dtypes)[key]
    cells = points.where((F.col("gx") >= 0) & (F.col("gy") >= 0) & (F.col("gz") >= 0))
    cells = cells.groupBy(key, "gx", "gy", "gz").agg(F.count("*").alias("points"), F.bool_or("is_seed").alias("is_seed"))

    def around(grid: np.ndarray, fill: float) -> list[np.ndarray]:
        wide = np.pad(grid, 1, constant_values=fill)
        return [np.roll(wide, by, axis)[1:-1, 1:-1, 1:-1] for axis in range(3) for by in (1, -1)]

    def spread(g: pd.DataFrame) -> pd.DataFrame:
        held, density = np.zeros((n, n, n), dtype=np.int64), np.full((n, n, n), np.inf)
        at = tuple(g[c].to_numpy() for c in ("gx", "gy", "gz"))
        held[at] = g["points"]
        seeds = g["is_seed"].fillna(False).to_numpy(dtype=bool)
        density[tuple(a[seeds] for a in at)] = start
        while True:
            reached = np.isfinite(density)
            least = np.minimum.reduce(around(density, np.inf))
            through = np.logical_or.reduce(around(reached & (held > 0), False))
            new = ~reached & np.isfinite(least)
            if not new.any():
                break
            density[new] = (np.where(through, decay, 1.0) * np.where(np.isfinite(least), least, 0.0))[new]
        x, y, z = (a.ravel() for a in np.indices((n, n, n)))
        return pd.DataFrame({key: g[key].iloc[0], "gx": x, "gy": y, "gz": z, "points": held.ravel(), "density": np.where(np.isfinite(density), density, 0.0).ravel()})

    return cells.groupBy(key).applyInPandas(spread, f"{key} {kind}, gx int, gy int, gz int, points long, density double")


def grid_sample(points: DataFrame, key: str, bounds: dict[str, tuple[Column | float, Column | float]], n: int, most: int, seed: int, decay: float = 0.9, start: float = 0.9) -> DataFrame:
    """``most`` points a cloud (all, if fewer), those of largest ``weight``: a seeded draw times the density of their cell.

    points: (key, p_idx, x, y, z, flux); points of the two electrodes (flux not 0) are seeds. Points outside the bounds
    have weight 0.
    """
    placed = grid_cells(points, bounds, n)
    density = spread_density(placed.withColumn("is_seed", F.col("flux") != 0), key, n, decay, start).drop("points")
    draw = F.pmod(F.xxhash64(F.lit(seed), "p_idx"), F.lit(1 << 40)) / float(1 << 40)
    weighed = placed.join(density, [key, "gx", "gy", "gz"], "left").withColumn("weight", draw * F.coalesce("density", F.lit(0.0)))
    return weighted_top(weighed, [key], F.col("weight"), most).drop("gx", "gy", "gz", "density")


def weighted_top(points: DataFrame, keys: list[str], weight: Column, n: int) -> DataFrame:
    """The n points of largest weight per cloud, ties by index."""
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(weight.desc(), F.col("p_idx")))
    return points.withColumn("_k", k).where(F.col("_k") <= n).drop("_k")
