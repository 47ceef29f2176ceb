"""A hand-made GDSII stream."""

import math
import struct

import pytest

from netquarry.sources import gds


def rec(kind, dtype, body=b""):
    body += b"\0" * (len(body) % 2)
    return struct.pack(">HBB", len(body) + 4, kind, dtype) + body


def real8(v):
    if v == 0:
        return b"\0" * 8
    e = 64
    while v >= 1:
        v, e = v / 16, e + 1
    while v < 1 / 16:
        v, e = v * 16, e - 1
    return bytes([e]) + int(v * 2**56).to_bytes(7, "big")


def rect(layer, x0, y0, x1, y1):
    xy = struct.pack(">10i", x0, y0, x1, y0, x1, y1, x0, y1, x0, y0)
    return rec(0x08, 0) + rec(0x0D, 2, struct.pack(">h", layer)) + rec(0x0E, 2, struct.pack(">h", 0)) + rec(0x10, 3, xy) + rec(0x11, 0)


def ref(name, x, y, angle=0.0, mirrored=False):
    extra = rec(0x1A, 1, b"\x80\0" if mirrored else b"\0\0") + rec(0x1C, 5, real8(angle))
    return rec(0x0A, 0) + rec(0x12, 6, name.encode()) + extra + rec(0x10, 3, struct.pack(">2i", x, y)) + rec(0x11, 0)


def array(name, cols, rows, x, y, dx, dy):
    xy = struct.pack(">6i", x, y, x + cols * dx, y, x, y + rows * dy)
    return rec(0x0B, 0) + rec(0x12, 6, name.encode()) + rec(0x13, 2, struct.pack(">hh", cols, rows)) + rec(0x10, 3, xy) + rec(0x11, 0)


def cell(name, *body):
    return rec(0x05, 2, b"\0" * 24) + rec(0x06, 6, name.encode()) + b"".join(body) + rec(0x07, 0)


def test_gds(spark, tmp_path):
    data = rec(0x00, 2, b"\0\x05") + rec(0x03, 5, real8(1e-3) + real8(1e-9)) + cell("A", rect(1, 0, 0, 2000, 1000)) + cell("B", ref("A", 10000, 0, 90.0), rect(2, 0, 0, 1000, 1000)) + cell("TOP", ref("B", 0, 5000), array("A", 2, 1, 0, 0, 5000, 0), ref("A", 0, 0, 0.0, True)) + rec(0x04, 0)
    (tmp_path / "x.gds").write_bytes(data)
    rows = gds.read_gds(spark, str(tmp_path)).cache()
    boxes = gds.rectangles(rows)
    assert sorted((r.cell, r.layer, r.x1, r.exact) for r in boxes.collect()) == [("A", 1, pytest.approx(2.0), True), ("B", 2, pytest.approx(1.0), True)]
    flat = sorted(tuple(round(v, 6) + 0.0 for v in (r.layer, r.x0, r.y0, r.x1, r.y1)) for r in gds.flattened(rows, "TOP").collect())
    assert flat == [(1, 0, -1, 2, 0), (1, 0, 0, 2, 1), (1, 5, 0, 7, 1), (1, 9, 5, 10, 7), (2, 0, 5, 1, 6)]


def boundary(layer, *xy):
    closed = (*xy, *xy[:2])
    return rec(0x08, 0) + rec(0x0D, 2, struct.pack(">h", layer)) + rec(0x0E, 2, struct.pack(">h", 0)) + rec(0x10, 3, struct.pack(f">{len(closed)}i", *closed)) + rec(0x11, 0)


def path(layer, width, ends, *xy, given=None):
    body = rec(0x09, 0) + rec(0x0D, 2, struct.pack(">h", layer)) + rec(0x0E, 2, struct.pack(">h", 5))
    body += b"" if ends is None else rec(0x21, 2, struct.pack(">h", ends))
    body += rec(0x0F, 3, struct.pack(">i", width))
    if given:
        body += rec(0x30, 3, struct.pack(">i", given[0])) + rec(0x31, 3, struct.pack(">i", given[1]))
    return body + rec(0x10, 3, struct.pack(f">{len(xy)}i", *xy)) + rec(0x11, 0)


def area(xy):
    p = list(zip(xy[::2], xy[1::2], strict=True))
    return abs(sum(a * d - b * c for (a, b), (c, d) in zip(p, p[1:] + p[:1], strict=True))) / 2


def stream(tmp_path, *cells):
    data = rec(0x00, 2, b"\0\x05") + rec(0x03, 5, real8(1e-3) + real8(1e-9)) + b"".join(cells) + rec(0x04, 0)
    (tmp_path / "x.gds").write_bytes(data)
    return str(tmp_path)


def test_gds_polygons_and_paths(spark, tmp_path):
    folder = stream(tmp_path, cell("A", boundary(1, 0, 0, 4000, 0, 4000, 1000, 1000, 1000, 1000, 3000, 0, 3000), path(2, 200, None, 0, 0, 1000, 0, 1000, 500), path(3, 200, 2, 0, 0, 1000, 0), path(4, 200, 4, 0, 0, 0, 1000, given=(50, 300)), path(5, 200, 1, 0, 0, 1000, 0), path(6, 200, 2, 7000, 7000), path(7, 200, 0, 7000, 7000), path(8, 100, 0, 0, 0, 1000, 0, 0, 400)))
    found = {r.layer: r for r in gds.polygons(gds.read_gds(spark, folder)).collect()}
    assert sorted(found) == [1, 2, 3, 4, 5, 6, 8] and {found[2].dtype, found[1].dtype} == {5, 0}
    corners = lambda k: sorted((round(x, 6), round(y, 6)) for x, y in zip(found[k].xy[::2], found[k].xy[1::2], strict=True))
    assert area(found[1].xy) == pytest.approx(6.0) and len(found[1].xy) == 12
    assert corners(2) == sorted([(0, 0.1), (0.9, 0.1), (0.9, 0.5), (1.1, 0.5), (1.1, -0.1), (0, -0.1)])  # mitred
    assert corners(3) == [(-0.1, -0.1), (-0.1, 0.1), (1.1, -0.1), (1.1, 0.1)]
    assert corners(4) == [(-0.1, -0.05), (-0.1, 1.3), (0.1, -0.05), (0.1, 1.3)]
    assert 0.2 < area(found[5].xy) < 0.2 + 3.1416 * 0.01 and min(found[5].xy[::2]) == pytest.approx(-0.1)
    assert corners(6) == [(6.9, 6.9), (6.9, 7.1), (7.1, 6.9), (7.1, 7.1)]
    assert max(found[8].xy[::2]) == pytest.approx(1 + 0.05 * (1 + 0.4) / math.hypot(1, 0.4))  # a sharp turn is cut half a width out


def test_gds_free_angles(spark, tmp_path):
    a = cell("A", boundary(1, 0, 0, 1000, 0, 0, 2000))
    turned = rec(0x0A, 0) + rec(0x12, 6, b"A") + rec(0x1A, 1, b"\x80\0") + rec(0x1B, 5, real8(2.0)) + rec(0x1C, 5, real8(30.0)) + rec(0x10, 3, struct.pack(">2i", 5000, 1000)) + rec(0x11, 0)
    rows = gds.read_gds(spark, stream(tmp_path, a, cell("B", turned, array("A", 2, 3, 0, 0, 5000, 7000)), cell("TOP", ref("B", 0, 0, 45.0), ref("A", 100, 200, 90.0))))
    place = lambda x, y: (5 + 2 * (x * math.cos(math.pi / 6) + y * math.sin(math.pi / 6)), 1 + 2 * (x * math.sin(math.pi / 6) - y * math.cos(math.pi / 6)))
    turn = lambda x, y: ((x - y) / math.sqrt(2), (x + y) / math.sqrt(2))
    shape = [(0, 0), (1, 0), (0, 2)]
    want = [[turn(*place(x, y)) for x, y in shape], [(0.1 - y, 0.2 + x) for x, y in shape]]
    want += [[turn(5 * i + x, 7 * j + y) for x, y in shape] for i in range(2) for j in range(3)]
    got = [list(zip(r.xy[::2], r.xy[1::2], strict=True)) for r in gds.flat_polygons(rows, "TOP").collect()]
    close = lambda p: [(round(x, 6) + 0.0, round(y, 6) + 0.0) for x, y in p]
    assert sorted(map(close, got)) == sorted(map(close, want))
    assert gds.placements(rows, "TOP").groupBy("cell").count().collect().__len__() == 3
    loop = gds.read_gds(spark, stream(tmp_path, cell("TOP", ref("TOP", 0, 0))))
    with pytest.raises(RuntimeError):
        gds.placements(loop, "TOP")
