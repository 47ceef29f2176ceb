"""GDSII stream files: elements by cell, polygons and rectangles in micrometres, placed by their hierarchy.

Hierarchy is flattened one level at a time by joins, so that a cell placed often is read once.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Record types of the format.
UNITS, ENDSTR, STRNAME, BOUNDARY, PATH, SREF, AREF, TEXT = 0x03, 0x07, 0x06, 0x08, 0x09, 0x0A, 0x0B, 0x0C
LAYER, DATATYPE, WIDTH, XY, ENDEL, SNAME, COLROW, STRANS, MAG, ANGLE, BOX = 0x0D, 0x0E, 0x0F, 0x10, 0x11, 0x12, 0x13, 0x1A, 0x1B, 0x1C, 0x2D
PATHTYPE, BGNEXTN, ENDEXTN = 0x21, 0x30, 0x31
FLUSH, ROUND, SQUARE, GIVEN = 0, 1, 2, 4  # ends of paths
ELEMENTS = {BOUNDARY: "boundary", PATH: "path", SREF: "ref", AREF: "array", TEXT: "text", BOX: "box"}
SCHEMA = "path string, seq long, cell string, kind string, layer int, dtype int, width long, name string, mirrored boolean, angle double, mag double, cols int, rows int, xy array<long>, dbu double, ends int, start_ext long, end_ext long"
ROUND_STEPS = 8  # corners of a round end


def real8(b: bytes) -> float:
    """Excess-64 base-16 floating point."""
    exponent, mantissa = (b[0] & 0x7F) - 64, int.from_bytes(b[1:], "big") / 2**56
    return (-1 if b[0] & 0x80 else 1) * mantissa * 16.0**exponent


def records(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 4 <= len(data):
        size, kind = struct.unpack_from(">HB", data, at)
        if size < 4:
            return  # padding after the end
        yield kind, data[at + 4 : at + size]
        at += size


def elements(data: bytes) -> Iterator[dict]:
    dbu, cell, e = 0.001, None, None
    for kind, body in records(data):
        if kind == UNITS:
            dbu = real8(body[8:16]) * 1e6  # metres a unit, as micrometres
        elif kind == STRNAME:
            cell = body.rstrip(b"\0").decode("latin-1")
        elif kind == ENDSTR:
            cell = None
        elif kind in ELEMENTS:
            e = {"cell": cell, "kind": ELEMENTS[kind], "dbu": dbu, "mirrored": False, "angle": 0.0, "mag": 1.0}
        elif e is not None:
            if kind in (LAYER, DATATYPE):
                e["layer" if kind == LAYER else "dtype"] = struct.unpack(">h", body)[0]
            elif kind in (WIDTH, BGNEXTN, ENDEXTN):
                e[{WIDTH: "width", BGNEXTN: "start_ext", ENDEXTN: "end_ext"}[kind]] = struct.unpack(">i", body)[0]
            elif kind == PATHTYPE:
                e["ends"] = struct.unpack(">h", body)[0]
            elif kind == XY:
                e["xy"] = list(struct.unpack(f">{len(body) // 4}i", body))
            elif kind == SNAME:
                e["name"] = body.rstrip(b"\0").decode("latin-1")
            elif kind == COLROW:
                e["cols"], e["rows"] = struct.unpack(">hh", body)
            elif kind == STRANS:
                e["mirrored"] = bool(body[0] & 0x80)
            elif kind in (ANGLE, MAG):
                e["angle" if kind == ANGLE else "mag"] = real8(body)
            elif kind == ENDEL:
                yield e
                e = None


def read_gds(spark: SparkSession, path: str) -> DataFrame:
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, content in zip(b["path"], b["content"], strict=True):
                rows = [(file, k, *[e.get(n) for n in names[2:]]) for k, e in enumerate(elements(bytes(content)))]
                yield pd.DataFrame(rows, columns=names, dtype=object)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gds").load(path).select("path", "content").mapInPandas(parse, SCHEMA)


def rectangles(rows: DataFrame) -> DataFrame:
    """Bounding boxes of boundaries and boxes in micrometres; ``exact`` tells whether the shape is its box."""
    n = F.size("xy")
    xs, ys = F.filter("xy", lambda v, i: i % 2 == 0), F.filter("xy", lambda v, i: i % 2 == 1)
    r = rows.where(F.col("kind").isin("boundary", "box") & (n >= 8)).withColumns({"_x": xs, "_y": ys})
    on = lambda a: F.size(F.array_distinct(F.col(a))) == 2
    um = lambda v: v * F.col("dbu")
    return r.select(
        "path", "seq", "cell", "layer", "dtype", um(F.array_min("_x")).alias("x0"), um(F.array_min("_y")).alias("y0"), um(F.array_max("_x")).alias("x1"), um(F.array_max("_y")).alias("y1"), (on("_x") & on("_y") & (n == 10)).alias("exact")
    )


def flattened(rows: DataFrame, top: str) -> DataFrame:
    """Rectangles of a top cell with those of placed cells, moved, mirrored and turned by quarter turns.

    Each round places the cells that the last round found; other angles and magnifications raise. Cells nest as deep as
    there are cells at most; deeper, a cell holds itself, which raises.
    """
    from ..lineage import ensure_checkpoints

    spark = rows.sparkSession
    ensure_checkpoints(spark)
    shapes = rectangles(rows).select("cell", "layer", "dtype", "x0", "y0", "x1", "y1")
    i, j = F.sequence(F.lit(0), F.coalesce("cols", F.lit(1)) - 1), F.sequence(F.lit(0), F.coalesce("rows", F.lit(1)) - 1)
    at = lambda k: F.get("xy", F.lit(k)).cast("double")
    odd = (F.pmod(F.col("angle"), F.lit(90.0)) != 0) | (F.col("mag") != 1)
    turn = F.when(odd, F.raise_error(F.concat(F.lit("angle or magnification of "), F.col("name"))).cast("int")).otherwise((F.pmod(F.col("angle"), F.lit(360.0)) / 90).cast("int"))
    refs = rows.where(F.col("kind").isin("ref", "array")).withColumn("_i", F.explode(i)).withColumn("_j", F.explode(j))
    step = lambda a, b, k, n: F.when(F.coalesce(n, F.lit(1)) > 1, (at(a) - at(b)) / n * F.col(k)).otherwise(0.0)
    refs = refs.select("cell", "name", (F.when(F.col("mirrored"), -1).otherwise(1)).alias("m"), turn.alias("t"), ((at(0) + step(2, 0, "_i", F.col("cols")) + step(4, 0, "_j", F.col("rows"))) * F.col("dbu")).alias("dx"), ((at(1) + step(3, 1, "_i", F.col("cols")) + step(5, 1, "_j", F.col("rows"))) * F.col("dbu")).alias("dy"))
    # A placement maps (x, y) to (a x + b y + dx, c x + d y + dy).
    cos, sin = F.element_at(F.array(*map(F.lit, (1, 0, -1, 0))), F.col("t") + 1), F.element_at(F.array(*map(F.lit, (0, 1, 0, -1))), F.col("t") + 1)
    refs = refs.select("cell", "name", cos.alias("ra"), (-sin * F.col("m")).alias("rb"), sin.alias("rc"), (cos * F.col("m")).alias("rd"), "dx", "dy")
    placed = spark.createDataFrame([(top, 1, 0, 0, 1, 0.0, 0.0)], "name string, a int, b int, c int, d int, px double, py double")
    out = None
    for _ in range(rows.select("cell").distinct().count() + 1):
        here = placed.join(shapes, placed["name"] == shapes["cell"])
        x = lambda u, v: F.col("a") * F.col(u) + F.col("b") * F.col(v) + F.col("px")
        y = lambda u, v: F.col("c") * F.col(u) + F.col("d") * F.col(v) + F.col("py")
        part = here.select("layer", "dtype", F.least(x("x0", "y0"), x("x1", "y1")).alias("x0"), F.least(y("x0", "y0"), y("x1", "y1")).alias("y0"), F.greatest(x("x0", "y0"), x("x1", "y1")).alias("x1"), F.greatest(y("x0", "y0"), y("x1", "y1")).alias("y1"))
        out = part if out is None else out.unionAll(part)
        inner = placed.withColumnRenamed("name", "parent").join(refs, F.col("parent") == F.col("cell"))
        mul = lambda p, q, r, s: (F.col(p) * F.col(q) + F.col(r) * F.col(s)).cast("int")
        placed = inner.select(
            "name", mul("a", "ra", "b", "rc").alias("a"), mul("a", "rb", "b", "rd").alias("b"), mul("c", "ra", "d", "rc").alias("c"), mul("c", "rb", "d", "rd").alias("d"),
            (F.col("a") * F.col("dx") + F.col("b") * F.col("dy") + F.col("px")).alias("px"), (F.col("c") * F.col("dx") + F.col("d") * F.col("dy") + F.col("py")).alias("py"),
        ).checkpoint()
        if not placed.limit(1).count():
            return out
    raise RuntimeError("a cell is placed within itself")


def outline(xy: list[float], width: float, ends: int = FLUSH, start: float = 0.0, end: float = 0.0) -> list[float]:
    """Corners of a path's outline: mitred at turns up to a right angle, beyond it cut square half a width out.

    Ends are flush, round (``ROUND_STEPS`` corners), square (half a width longer) or given lengths longer. A path without
    width or length is empty, unless its ends give it one.
    """
    p = np.asarray(xy, dtype=float).reshape(-1, 2)
    p = p[np.concatenate([[True], (np.diff(p, axis=0) != 0).any(1)])] if len(p) else p
    h = abs(width) / 2
    start, end = {FLUSH: (0.0, 0.0), ROUND: (0.0, 0.0), GIVEN: (start, end)}.get(ends, (h, h))
    if not h or not len(p) or len(p) == 1 and ends != ROUND and start + end <= 0:
        return []
    d = np.diff(p, axis=0) if len(p) > 1 else np.array([[1.0, 0.0]])
    d /= np.hypot(*d.T)[:, None]
    n = np.column_stack([-d[:, 1], d[:, 0]])
    left, right = [p[0] - d[0] * start + n[0] * h], [p[0] - d[0] * start - n[0] * h]
    for k in range(1, len(p) - 1):
        turn, along = d[k - 1, 0] * d[k, 1] - d[k - 1, 1] * d[k, 0], d[k - 1] @ d[k]
        reach = (n[k - 1] + n[k]) / (1 + along) * h if along > -1 + 1e-12 else None
        if along >= -1e-12:
            left.append(p[k] + reach)
            right.append(p[k] - reach)
            continue
        outer, inner, side = (right, left, -1) if turn > 0 else (left, right, 1)
        outer += [p[k] + (side * n[k - 1] + d[k - 1]) * h, p[k] + (side * n[k] - d[k]) * h]
        short = min(np.hypot(*(p[k] - p[k - 1])), np.hypot(*(p[k + 1] - p[k])))
        inner += [p[k] - side * reach] if reach is not None and np.hypot(*reach) <= short else [p[k]]
    left.append(p[-1] + d[-1] * end + n[-1] * h)
    right.append(p[-1] + d[-1] * end - n[-1] * h)
    if ends == ROUND:
        arc = np.pi * np.arange(1, ROUND_STEPS) / ROUND_STEPS
        far = [p[-1] + h * (n[-1] * np.cos(t) + d[-1] * np.sin(t)) for t in arc]
        near = [p[0] + h * (-n[0] * np.cos(t) - d[0] * np.sin(t)) for t in arc]
        return np.concatenate([left, far, right[::-1], near]).ravel().tolist()
    return np.concatenate([left, right[::-1]]).ravel().tolist()


def polygons(rows: DataFrame) -> DataFrame:
    """Shapes of cells as polygons: (path, seq, cell, layer, dtype, xy) in micrometres, closed by themselves.

    Boundaries and boxes lose their repeated last corner; paths become their outline. What encloses nothing is left out.
    """

    @F.pandas_udf("array<double>")
    def outlines(xy: pd.Series, width: pd.Series, ends: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
        return pd.Series([outline(list(p), w, int(e), a, b) for p, w, e, a, b in zip(xy, width, ends, start, end, strict=True)], dtype=object)

    n, first = F.size("xy"), lambda i: F.get("xy", F.lit(i))
    whole = F.when((first(0) == F.element_at("xy", -2)) & (first(1) == F.element_at("xy", -1)), F.slice("xy", 1, n - 2)).otherwise(F.col("xy"))
    um = lambda c: F.transform(c, lambda v: v * F.col("dbu"))
    head = ("path", "seq", "cell", "layer", "dtype")
    drawn = rows.where(F.col("kind").isin("boundary", "box") & (n >= 6)).select(*head, um(whole).alias("xy"))
    scaled = lambda c: F.coalesce(F.col(c), F.lit(0)) * F.col("dbu")
    paths = rows.where((F.col("kind") == "path") & (n >= 2))
    paths = paths.select(*head, outlines(um(F.col("xy")), scaled("width"), F.coalesce("ends", F.lit(FLUSH)), scaled("start_ext"), scaled("end_ext")).alias("xy"))
    return drawn.unionAll(paths).where(F.size("xy") >= 6)


def placements(rows: DataFrame, top: str) -> DataFrame:
    """Every instance of a cell below ``top`` (and of itself): (cell, a, b, c, d, px, py).

    A corner (x, y) of the cell lies at (a x + b y + px, c x + d y + py): mirrored at the x axis, magnified, turned by any
    angle and moved, level by level. Each round places the cells that the last round found, by a join; a cell within itself
    raises.
    """
    from ..lineage import ensure_checkpoints

    spark = rows.sparkSession
    ensure_checkpoints(spark)
    at = lambda k: F.get("xy", F.lit(k)).cast("double") * F.col("dbu")
    count = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(1)), F.lit(1))
    refs = rows.where(F.col("kind").isin("ref", "array"))
    refs = refs.withColumn("_i", F.explode(F.sequence(F.lit(0), count("cols") - 1))).withColumn("_j", F.explode(F.sequence(F.lit(0), count("rows") - 1)))
    # An array's second and third corners lie all its columns and all its rows away.
    off = lambda k: at(k) + F.coalesce((at(k + 2) - at(k)) / count("cols") * F.col("_i"), F.lit(0.0)) + F.coalesce((at(k + 4) - at(k)) / count("rows") * F.col("_j"), F.lit(0.0))
    quarter = F.pmod(F.col("angle") / 90, F.lit(4.0))
    exact = lambda f, *values: F.when(quarter == F.floor(quarter), F.element_at(F.array(*map(F.lit, values)), quarter.cast("int") + 1)).otherwise(f(F.radians("angle"))) * F.col("mag")
    cos, sin, flip = exact(F.cos, 1.0, 0.0, -1.0, 0.0), exact(F.sin, 0.0, 1.0, 0.0, -1.0), F.when(F.col("mirrored"), -1.0).otherwise(1.0)
    refs = refs.select(F.col("cell").alias("_in"), F.col("name").alias("_of"), cos.alias("ra"), (-sin * flip).alias("rb"), sin.alias("rc"), (cos * flip).alias("rd"), off(0).alias("dx"), off(1).alias("dy"))
    now = spark.createDataFrame([(top, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0)], "cell string, a double, b double, c double, d double, px double, py double")
    out, c = now, F.col
    for _ in range(rows.select("cell").distinct().count() + 1):
        below = now.join(refs, c("cell") == c("_in"))
        now = below.select(
            c("_of").alias("cell"), (c("a") * c("ra") + c("b") * c("rc")).alias("a"), (c("a") * c("rb") + c("b") * c("rd")).alias("b"), (c("c") * c("ra") + c("d") * c("rc")).alias("c"), (c("c") * c("rb") + c("d") * c("rd")).alias("d"),
            (c("a") * c("dx") + c("b") * c("dy") + c("px")).alias("px"), (c("c") * c("dx") + c("d") * c("dy") + c("py")).alias("py"),
        ).checkpoint()
        if not now.limit(1).count():
            return out
        out = out.unionAll(now)
    raise RuntimeError("a cell is placed within itself")


def flat_polygons(rows: DataFrame, top: str) -> DataFrame:
    """Polygons of ``top`` with those of all placed cells, any angle and magnification: (cell, layer, dtype, seq, xy)."""
    shapes = polygons(rows).drop("path")
    moved = placements(rows, top).join(shapes, "cell")
    corner = lambda i: F.get("xy", i)
    places = F.sequence(F.lit(0), F.size("xy") - 2, F.lit(2))
    at = F.flatten(F.transform(places, lambda i: F.array(F.col("a") * corner(i) + F.col("b") * corner(i + 1) + F.col("px"), F.col("c") * corner(i) + F.col("d") * corner(i + 1) + F.col("py"))))
    return moved.select("cell", "layer", "dtype", "seq", at.alias("xy"))
