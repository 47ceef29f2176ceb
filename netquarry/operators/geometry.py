"""Geometry on columns: cuboids, boxes, orientation, clipping, pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

EPS = 1e-9


def corners(base: Column, v1: Column, v2: Column, h: Column) -> Column:
    """The eight corners of a cuboid given as three-component arrays, as an array of arrays."""
    add = lambda *vs: F.array(*[sum((v[i] for v in vs[1:]), vs[0][i]) for i in range(3)])
    return F.array(base, add(base, v1), add(base, v2), add(base, v1, v2), add(base, h), add(base, v1, h), add(base, v2, h), add(base, v1, v2, h))


def box3(base: Column, v1: Column, v2: Column, h: Column) -> tuple[Column, Column]:
    """Least and largest coordinates of a cuboid."""
    c = corners(base, v1, v2, h)
    axis = lambda f, i: f(F.transform(c, lambda p: p[i]))
    return F.array(*[axis(F.array_min, i) for i in range(3)]), F.array(*[axis(F.array_max, i) for i in range(3)])


def center3(base: Column, v1: Column, v2: Column, h: Column) -> Column:
    return F.array(*[base[i] + (v1[i] + v2[i] + h[i]) / 2 for i in range(3)])


def volume3(v1: Column, v2: Column, h: Column) -> Column:
    """Magnitude of the triple product."""
    cross = [v2[(i + 1) % 3] * h[(i + 2) % 3] - v2[(i + 2) % 3] * h[(i + 1) % 3] for i in range(3)]
    return F.abs(sum((v1[i] * cross[i] for i in range(1, 3)), v1[0] * cross[0]))


def footprint(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> list[Column]:
    """Bounding box (x0, y0, x1, y1) of the four corners that two edge vectors span from a base."""
    xs, ys = F.array(x, x + ax, x + bx, x + ax + bx), F.array(y, y + ay, y + by, y + ay + by)
    return [F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1")]


# Orientations that keep width and height, and those that swap them, with their other names.
UPRIGHT = ("N", "S", "FN", "FS", "R0", "R180", "MY", "MX")
TURNED = ("E", "W", "FE", "FW", "R90", "R270", "MYR90", "MXR90")


def oriented_size(orient: Column, w: Column, h: Column) -> tuple[Column, Column]:
    """Width and height after one of eight orientations; quarter turns swap them. Another orientation is an error."""
    up = F.upper(orient)
    turned = F.when(up.isin(*TURNED), True).when(up.isin(*UPRIGHT), False).otherwise(F.raise_error(F.concat(F.lit("unknown orientation: "), F.coalesce(orient, F.lit("null")))).cast("boolean"))
    return F.when(turned, h).otherwise(w), F.when(turned, w).otherwise(h)


def component_box(x: Column, y: Column, orient: Column, w: Column, h: Column) -> list[Column]:
    """Box of a placed macro: its least corner is the placement in every orientation."""
    ow, oh = oriented_size(orient, w, h)
    return [x.alias("x0"), y.alias("y0"), (x + ow).alias("x1"), (y + oh).alias("y1")]


def overlaps(a: str, b: str) -> Column:
    """Open overlap of boxes whose columns carry the prefixes: touching is no overlap."""
    c = lambda p, n: F.col(f"{p}{n}")
    return (c(a, "x1") > c(b, "x0")) & (c(a, "x0") < c(b, "x1")) & (c(a, "y1") > c(b, "y0")) & (c(a, "y0") < c(b, "y1"))


def touches(a: str, b: str) -> Column:
    """Closed overlap on one layer."""
    c = lambda p, n: F.col(f"{p}{n}")
    return (c(a, "layer") == c(b, "layer")) & (c(a, "x1") >= c(b, "x0")) & (c(a, "x0") <= c(b, "x1")) & (c(a, "y1") >= c(b, "y0")) & (c(a, "y0") <= c(b, "y1"))


def inside(x: Column, y: Column, w: str) -> Column:
    """Closed: a point on the border is inside."""
    c = lambda n: F.col(f"{w}{n}")
    return x.between(c("x0"), c("x1")) & y.between(c("y0"), c("y1"))


def clipped(rows: DataFrame, r: str, w: str) -> DataFrame:
    """Rows with the part of box ``r`` inside box ``w`` as x0, y0, x1, y1; rows without area go."""
    c = lambda p, n: F.col(f"{p}{n}")
    out = rows.withColumns({
        "x0": F.greatest(c(r, "x0"), c(w, "x0")), "y0": F.greatest(c(r, "y0"), c(w, "y0")),
        "x1": F.least(c(r, "x1"), c(w, "x1")), "y1": F.least(c(r, "y1"), c(w, "y1")),
    })
    return out.where((F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1")))


def pixels(lo: Column, hi: Column, origin: Column, resolution: Column, size: Column, kind: str = "double") -> tuple[Column, Column]:
    """Pixel range [floor, ceil) of an interval, cut to [0, size]; ``kind`` pins the arithmetic (float or double)."""
    at = lambda v: (v.cast(kind) - origin.cast(kind)) / resolution.cast(kind)
    # Division of floats widens in Spark; the quotient is narrowed again to keep the kind's rounding.
    first = F.floor(at(lo).cast(kind))
    last = F.ceil(at(hi).cast(kind))
    cut = lambda v: F.least(F.greatest(v, F.lit(0)), size).cast("int")
    return cut(first), cut(last)


def segment_clip(p: tuple[Column, Column], q: tuple[Column, Column], w: str = "w_") -> tuple[Column, Column, Column]:
    """Closed-form parametric clip of the segment from p to q: enter, leave, and whether an axis doesn't rule it out.

    A part is inside if none rules it out and enter doesn't come after leave.
    """
    enter, leave, ok = F.lit(0.0), F.lit(1.0), F.lit(True)
    for a, b, lo, hi in ((p[0], q[0], F.col(f"{w}x0"), F.col(f"{w}x1")), (p[1], q[1], F.col(f"{w}y0"), F.col(f"{w}y1"))):
        d = b - a
        t0, t1 = F.try_divide(lo - a, d), F.try_divide(hi - a, d)
        flat = F.abs(d) < 1e-300
        enter = F.when(flat, enter).otherwise(F.greatest(enter, F.least(t0, t1)))
        leave = F.when(flat, leave).otherwise(F.least(leave, F.greatest(t0, t1)))
        ok = ok & (~flat | a.between(lo, hi))
    return enter, leave, ok


def polyline_pieces(lines: DataFrame, keys: list[str], w: str = "w_") -> DataFrame:
    """Polylines (``points`` array of x, y) clipped to a window: one row per connected piece with its points.

    Segments inside follow each other in one piece while the earlier one leaves where the next begins. All of it
    happens within the row, so that nothing but the join that brought line and window together is shuffled. Lines of
    one segment, which most are, are clipped as plain columns, the segments of others in Arrow batches.
    """
    n = F.size("points")
    return _single_pieces(lines.where(n == 2), keys, w).unionByName(_chained_pieces(lines.where(n > 2), keys, w))


def _single_pieces(lines: DataFrame, keys: list[str], w: str) -> DataFrame:
    p, q = F.col("points")[0], F.col("points")[1]
    flat = lines.select(*keys, *[F.col(f"{w}{c}") for c in ("x0", "y0", "x1", "y1")], p["x"].alias("_px"), p["y"].alias("_py"), q["x"].alias("_qx"), q["y"].alias("_qy"))
    enter, leave, ok = segment_clip((F.col("_px"), F.col("_py")), (F.col("_qx"), F.col("_qy")), w)
    dx, dy = F.col("_qx") - F.col("_px"), F.col("_qy") - F.col("_py")
    cut = flat.withColumns({"_t0": enter, "_t1": leave, "_ok": ok}).where("_ok and _t0 <= _t1").where((F.col("_t1") - F.col("_t0")) * F.greatest(F.abs(dx), F.abs(dy)) > EPS)
    end = lambda t: F.struct((F.col("_px") + F.col(t) * dx).alias("x"), (F.col("_py") + F.col(t) * dy).alias("y"))
    return cut.select(*keys, F.lit(1).cast("long").alias("piece"), F.array(end("_t0"), end("_t1")).alias("points"))


def _chained_pieces(lines: DataFrame, keys: list[str], w: str) -> DataFrame:
    window = [f"{w}{c}" for c in ("x0", "y0", "x1", "y1")]
    asked = lines.select(*keys, *[F.col(c).cast("double").alias(c) for c in window], F.col("points").cast("array<struct<x:double,y:double>>").alias("points"))
    schema = StructType([*asked.select(*keys).schema.fields, *StructType.fromDDL("piece long, points array<struct<x:double,y:double>>").fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = b.column("points")
            at = points.flatten()
            x, y = (at.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y"))
            box = [b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in window]
            row, piece, offsets, px, py = _cut_lines(points.value_lengths().to_numpy(zero_copy_only=False), x, y, box)
            of = pa.array(row)
            cut = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(px), pa.array(py)], ["x", "y"]))
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(of) for k in keys], pa.array(piece), cut], [*keys, "piece", "points"])

    return asked.mapInArrow(cut, schema)


def _cut_lines(count: np.ndarray, x: np.ndarray, y: np.ndarray, box: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Pieces of lines of ``count`` points each, which stand behind each other in x and y, in a box a line.

    Returns per piece its line, its number from 1 and where its points begin (and the end), and the points. All segments are cut at
    once, as :func:`segment_clip` does; one with a coordinate that isn't known has no part inside.
    """
    line = np.repeat(np.arange(len(count)), count - 1)
    start = np.arange(len(line)) + line  # a line has a segment less than points
    x0, y0, x1, y1 = (v[line] for v in box)
    enter, leave, ok = np.zeros(len(line)), np.ones(len(line)), np.ones(len(line), dtype=bool)
    with np.errstate(all="ignore"):
        for v, lo, hi in ((x, x0, x1), (y, y0, y1)):
            a = v[start]
            d = v[start + 1] - a
            flat = np.abs(d) < 1e-300
            t0, t1 = (lo - a) / d, (hi - a) / d
            enter = np.where(flat, enter, np.maximum(enter, np.minimum(t0, t1)))
            leave = np.where(flat, leave, np.minimum(leave, np.maximum(t0, t1)))
            ok &= np.where(flat, (a >= lo) & (a <= hi), ~np.isnan(d))
        dx, dy = x[start + 1] - x[start], y[start + 1] - y[start]
        ok &= (enter <= leave) & ((leave - enter) * np.maximum(np.abs(dx), np.abs(dy)) > EPS)
    held = np.flatnonzero(ok)
    dx, dy, enter, leave, start, line = dx[held], dy[held], enter[held], leave[held], start[held], line[held]
    ax, ay, bx, by = x[start] + enter * dx, y[start] + enter * dy, x[start] + leave * dx, y[start] + leave * dy
    # A piece begins at a segment that the one before it doesn't lead into.
    first = np.ones(len(held), dtype=bool)
    first[1:] = (np.diff(held) > 1) | (np.diff(line) > 0) | (np.abs(bx[:-1] - ax[1:]) > EPS) | (np.abs(by[:-1] - ay[1:]) > EPS)
    number = np.cumsum(first) - 1
    begin = np.flatnonzero(first)
    offsets = np.append(begin, len(held)) + np.arange(len(begin) + 1)
    px, py = np.empty(len(held) + len(begin)), np.empty(len(held) + len(begin))
    after = np.arange(len(held)) + number + 1
    px[after], py[after] = bx, by
    px[offsets[:-1]], py[offsets[:-1]] = ax[begin], ay[begin]
    row = line[begin]
    fresh = np.ones(len(row), dtype=bool)
    fresh[1:] = np.diff(row) > 0
    piece = np.arange(len(row)) - np.maximum.accumulate(np.where(fresh, np.arange(len(row)), 0)) + 1
    return row, piece.astype(np.int64), offsets, px, py


def snapped(y0: Column, y1: Column, offset: Column, pitch: Column, min_cells: int = 1) -> tuple[Column, Column]:
    """Window edges moved inward to the row grid; unchanged where fewer than ``min_cells`` rows would be left."""
    a = offset + F.ceil((y0 - offset) / pitch - 1e-9) * pitch
    b = offset + F.floor((y1 - offset) / pitch + 1e-9) * pitch
    fits = b - a >= min_cells * pitch - 1e-9
    return F.when(fits, a).otherwise(y0), F.when(fits, b).otherwise(y1)


def cell_grid(components: DataFrame, rows: DataFrame | None = None, first: int = 20, pitch_y: float = 2.8, pitch_x: float = 0.38) -> DataFrame:
    """Per design the placement grid: x pitch and offset from components (design, x), y from rows (design, seq, y, step_y).

    The x pitch is the GCD, in nm, of the first distances over 0.01 between neighbouring distinct component x, from
    the left; the y pitch the first row's step, or the least distance of rows that follow each other. Defaults
    where there are none.
    """
    xs = components.select("design", "x").distinct()
    step = F.col("x") - F.lag("x").over(Window.partitionBy("design").orderBy("x"))
    steps = xs.withColumn("d", step).where("d > 0.01")
    # rint rounds halves to even.
    least = steps.select("design", F.rint(F.col("d") * 1000).cast("long").alias("d"), F.row_number().over(Window.partitionBy("design").orderBy("x")).alias("k")).where(F.col("k") <= first)
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    # Sixty-four halving steps of Euclid's algorithm reach the GCD of any two 64-bit numbers that occur here.
    euclid = lambda a, b: F.aggregate(F.sequence(F.lit(1), F.lit(64)), pair(a, b), lambda s, _: F.when(s["b"] == 0, s).otherwise(pair(s["b"], s["a"] % F.greatest(s["b"], F.lit(1)))))["a"]
    gcd = F.aggregate(F.sort_array(F.collect_list("d")), F.lit(0).cast("long"), euclid)
    out = components.groupBy("design").agg(F.min("x").alias("offset_x")).join(least.groupBy("design").agg(gcd.alias("g")), "design", "left")
    if rows is None:
        out = out.withColumns({"offset_y": F.lit(0.0), "py": F.lit(pitch_y)})
    else:
        gap = F.abs(F.col("y") - F.lag("y").over(Window.partitionBy("design").orderBy("seq")))
        found = rows.withColumn("d", gap).groupBy("design").agg(F.min("y").alias("oy"), F.min_by("step_y", "seq").alias("s"), F.min("d").alias("d"))
        found = found.select("design", F.col("oy").alias("offset_y"), F.when(F.col("s") > 0, F.col("s")).otherwise(F.coalesce("d", F.lit(pitch_y))).alias("py"))
        out = out.join(found, "design", "left").fillna({"offset_y": 0.0, "py": pitch_y})
    return out.select("design", "offset_x", "offset_y", F.col("py").alias("pitch_y"), F.coalesce(F.col("g") / 1000, F.lit(pitch_x)).alias("pitch_x"))


def grown(box: list[Column], delta: Column, bounds: list[Column]) -> list[Column]:
    """A box expanded on every side (etched, with a negative delta) and cut to bounds."""
    x0, y0, x1, y1 = box
    bx0, by0, bx1, by1 = bounds
    return [F.greatest(x0 - delta, bx0), F.greatest(y0 - delta, by0), F.least(x1 + delta, bx1), F.least(y1 + delta, by1)]


def ring(box: list[Column], thickness: Column, bounds: list[Column]) -> Column:
    """The up to four boxes (bottom, top, left, right) of a shell around a box, cut to bounds."""
    x0, y0, x1, y1 = box
    ox0, oy0, ox1, oy1 = grown(box, thickness, bounds)
    make = lambda a, b, c, d: F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1"))
    parts = F.array(make(ox0, oy0, ox1, y0), make(ox0, y1, ox1, oy1), make(ox0, y0, x0, y1), make(x1, y0, ox1, y1))
    return F.filter(parts, lambda r: (r["x0"] < r["x1"]) & (r["y0"] < r["y1"]))
