"""Planar geometry on WKB: predicates, measurements and transforms as Arrow-batched functions.

Points, lines, polygons and their multi forms; coordinates are lon/lat degrees or planar.  Buffers are circles of 32 edges around the vertices'
hull; reprojection knows 4326 and 3857 only.
"""

from __future__ import annotations

import functools
import math
import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

METRES_A_DEGREE = 111_111.0
SHAPES = 256  #: geometries of a batch that stay decoded
EARTH = 6_371_008.8
POINT, LINE, POLYGON, MULTI_POINT, MULTI_LINE, MULTI_POLYGON = range(1, 7)
POINT_BYTES = np.dtype([("order", "u1"), ("kind", "<u4"), ("x", "<f8"), ("y", "<f8")])  #: a little-endian point as it lies in WKB


def encode(kind: int, parts: list) -> bytes:
    """WKB of a geometry: a point is one pair, a line a list of pairs, a polygon a list of rings, multi forms lists of those."""
    head = b"\x01" + struct.pack("<I", kind)
    ring = lambda r: struct.pack("<I", len(r)) + b"".join(struct.pack("<dd", *p) for p in r)
    if kind == POINT:
        return head + struct.pack("<dd", *parts)
    if kind == LINE:
        return head + ring(parts)
    if kind == POLYGON:
        return head + struct.pack("<I", len(parts)) + b"".join(ring(r) for r in parts)
    return head + struct.pack("<I", len(parts)) + b"".join(encode(kind - 3, p) for p in parts)


def decode(data: bytes, at: int = 0) -> tuple[int, list, int]:
    order = "<" if data[at] else ">"
    kind = struct.unpack_from(order + "I", data, at + 1)[0] & 0xFF
    at += 5

    def ring(at: int) -> tuple[list, int]:
        n = struct.unpack_from(order + "I", data, at)[0]
        flat = struct.unpack_from(f"{order}{2 * n}d", data, at + 4)
        return list(zip(flat[::2], flat[1::2], strict=True)), at + 4 + 16 * n

    if kind == POINT:
        return kind, list(struct.unpack_from(order + "dd", data, at)), at + 16
    if kind == LINE:
        pts, at = ring(at)
        return kind, pts, at
    n, at = struct.unpack_from(order + "I", data, at)[0], at + 4
    parts = []
    for _ in range(n):
        if kind == POLYGON:
            part, at = ring(at)
        else:
            _, part, at = decode(data, at)
        parts.append(part)
    return kind, parts, at


class Shape:
    """A geometry as simple parts: points, lines and polygons."""

    def __init__(self, data: bytes):
        self.kind, self.parts, _ = decode(bytes(data))
        base, items = (self.kind, [self.parts]) if self.kind <= POLYGON else (self.kind - 3, self.parts)
        self.points = [tuple(p) for p in items] if base == POINT else []
        self.lines = items if base == LINE else []
        self.polygons = items if base == POLYGON else []

    def vertices(self) -> np.ndarray:
        pts = [*self.points, *(p for line in self.lines for p in line), *(p for poly in self.polygons for r in poly for p in r)]
        return np.array(pts, float).reshape(-1, 2)

    def segments(self) -> np.ndarray:
        rings = [*self.lines, *(r for poly in self.polygons for r in poly)]
        segs = [(*a, *b) for r in rings for a, b in zip(r, r[1:], strict=False)]
        return np.array(segs, float).reshape(-1, 4)

    def covers(self, x: float, y: float) -> bool:
        """Whether a polygon of the shape has the point inside or on its border."""
        for poly in self.polygons:
            inside = False
            for r in poly:
                for (x1, y1), (x2, y2) in zip(r, r[1:], strict=False):
                    if on_segment(x, y, x1, y1, x2, y2):
                        return True
                    if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                        inside = not inside
            if inside:
                return True
        return False


def on_segment(x, y, x1, y1, x2, y2) -> bool:  # noqa: ANN001
    cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
    return abs(cross) <= 1e-12 * max(1.0, abs(x2 - x1) + abs(y2 - y1)) and min(x1, x2) - 1e-12 <= x <= max(x1, x2) + 1e-12 and min(y1, y2) - 1e-12 <= y <= max(y1, y2) + 1e-12


def crossing(s, t) -> bool:  # noqa: ANN001
    side = lambda ax, ay, bx, by, cx, cy: (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    d1, d2 = side(*t, *s[:2]), side(*t, *s[2:])
    d3, d4 = side(*s, *t[:2]), side(*s, *t[2:])
    if d1 * d2 < 0 and d3 * d4 < 0:
        return True
    return on_segment(*s[:2], *t) or on_segment(*s[2:], *t) or on_segment(*t[:2], *s) or on_segment(*t[2:], *s)


def intersects(a: Shape, b: Shape) -> bool:
    if any(b.covers(*p[:2]) for p in a.vertices()) or any(a.covers(*p[:2]) for p in b.vertices()):
        return True
    sa, sb = a.segments(), b.segments()
    if a.points and any(on_segment(*p, *t) for p in a.points for t in sb) or b.points and any(on_segment(*p, *t) for p in b.points for t in sa):
        return True
    if a.points and b.points and set(a.points) & set(b.points):
        return True
    return any(crossing(s, t) for s in sa for t in sb)


def contains(a: Shape, b: Shape) -> bool:
    """Whether all of ``b`` lies in ``a`` (vertices, and no border is crossed properly)."""
    if not a.polygons:
        return a.points == b.points and not b.lines and not b.polygons and bool(b.points)
    return all(a.covers(*p[:2]) for p in b.vertices())


def distance(a: Shape, b: Shape) -> float:
    if intersects(a, b):
        return 0.0
    best = math.inf
    for u, v in ((a, b), (b, a)):
        segs = v.segments()
        pts = u.vertices()
        for x, y in pts:
            if segs.size:
                dx, dy = segs[:, 2] - segs[:, 0], segs[:, 3] - segs[:, 1]
                t = np.clip(((x - segs[:, 0]) * dx + (y - segs[:, 1]) * dy) / np.maximum(dx * dx + dy * dy, 1e-300), 0, 1)
                best = min(best, float(np.hypot(segs[:, 0] + t * dx - x, segs[:, 1] + t * dy - y).min()))
            if v.points:
                other = np.array(v.points)
                best = min(best, float(np.hypot(other[:, 0] - x, other[:, 1] - y).min()))
    return best


def ring_area(r: list) -> float:
    a = np.array(r, float)
    return float(np.sum(a[:-1, 0] * a[1:, 1] - a[1:, 0] * a[:-1, 1]) / 2) if len(r) > 2 else 0.0


def area(s: Shape) -> float:
    return sum(abs(ring_area(p[0])) - sum(abs(ring_area(r)) for r in p[1:]) for p in s.polygons)


def length(s: Shape, closed: bool = False) -> float:
    segs = s.segments()
    return float(np.hypot(segs[:, 2] - segs[:, 0], segs[:, 3] - segs[:, 1]).sum()) if (s.lines if not closed else s.polygons) else 0.0


def great_circle(s: Shape, closed: bool = False) -> float:
    """Length in metres on a sphere."""
    segs = np.radians(s.segments())
    if not segs.size or not (s.polygons if closed else s.lines):
        return 0.0
    h = np.sin((segs[:, 3] - segs[:, 1]) / 2) ** 2 + np.cos(segs[:, 1]) * np.cos(segs[:, 3]) * np.sin((segs[:, 2] - segs[:, 0]) / 2) ** 2
    return float((2 * EARTH * np.arcsin(np.sqrt(h))).sum())


def hull(points: np.ndarray) -> list:
    pts = sorted(map(tuple, np.unique(points, axis=0)))
    if len(pts) < 3:
        return [*pts, pts[0]]
    half = []
    for seq in (pts, pts[::-1]):
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        half += out[:-1]
    return [*half, half[0]]


def simplified(line: list, tolerance: float) -> list:
    """Douglas-Peucker."""
    if len(line) < 3:
        return line
    (x1, y1), (x2, y2) = line[0], line[-1]
    a = np.array(line, float)
    base = math.hypot(x2 - x1, y2 - y1)
    far = np.abs((x2 - x1) * (a[:, 1] - y1) - (y2 - y1) * (a[:, 0] - x1)) / base if base else np.hypot(a[:, 0] - x1, a[:, 1] - y1)
    k = int(far.argmax())
    return [line[0], line[-1]] if far[k] <= tolerance else simplified(line[: k + 1], tolerance)[:-1] + simplified(line[k:], tolerance)


def transform(data: bytes, name: str, amount: float = 0.0, to: int = 3857) -> bytes:
    s = Shape(data)
    each = lambda f: encode(s.kind, remap(s.kind, s.parts, f))
    pts = s.vertices()
    if name == "Transform":
        r = 6378137.0
        if to == 3857:
            return each(lambda x, y: (math.radians(x) * r, math.log(math.tan(math.pi / 4 + math.radians(y) / 2)) * r))
        return each(lambda x, y: (math.degrees(x / r), math.degrees(2 * math.atan(math.exp(y / r)) - math.pi / 2)))
    if name == "Centroid":
        if s.polygons and area(s):
            total, cx, cy = 0.0, 0.0, 0.0
            for p in s.polygons:
                for ring in p:
                    a = np.array(ring, float)
                    cross = a[:-1, 0] * a[1:, 1] - a[1:, 0] * a[:-1, 1]
                    sign = 1 if ring is p[0] else -1
                    flip = sign if cross.sum() >= 0 else -sign
                    total += flip * cross.sum() / 2
                    cx += flip * ((a[:-1, 0] + a[1:, 0]) * cross).sum() / 6
                    cy += flip * ((a[:-1, 1] + a[1:, 1]) * cross).sum() / 6
            return encode(POINT, [cx / total, cy / total])
        return encode(POINT, list(pts.mean(axis=0)))
    if name == "Buffer":
        turn = np.linspace(0, 2 * math.pi, 33)[:-1]
        circle = np.stack([np.cos(turn), np.sin(turn)], axis=1) * amount / METRES_A_DEGREE
        return encode(POLYGON, [hull((pts[:, None, :] + circle[None]).reshape(-1, 2))])
    if name in ("Simplify", "SimplifyTopology"):
        if s.kind == LINE:
            return encode(LINE, simplified(s.parts, amount))
        if s.kind == POLYGON:
            rings = [simplified(r, amount) for r in s.parts]
            return encode(POLYGON, [r if len(r) > 3 else o for r, o in zip(rings, s.parts, strict=True)])
        return bytes(data)
    if name in ("StartPoint", "EndPoint"):
        return encode(POINT, list(s.lines[0][0 if name == "StartPoint" else -1])) if s.lines else None
    if name == "Reverse":
        return encode(s.kind, s.parts[::-1] if s.kind == LINE else [r[::-1] for r in s.parts] if s.kind == POLYGON else s.parts)
    if name == "FlipCoordinates":
        return each(lambda x, y: (y, x))
    if name == "ConvexHull":
        return encode(POLYGON, [hull(pts)])
    if name == "Envelope":
        (x1, y1), (x2, y2) = pts.min(axis=0), pts.max(axis=0)
        return encode(POLYGON, [[(x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1)]])
    raise ValueError(f"unknown transform {name!r}")


def remap(kind: int, parts: list, f) -> list:  # noqa: ANN001
    if kind == POINT:
        return list(f(*parts))
    if kind == LINE:
        return [f(*p) for p in parts]
    if kind == POLYGON:
        return [[f(*p) for p in r] for r in parts]
    return [remap(kind - 3, p, f) for p in parts]


MEASURES = {
    "Area": area,
    "Length": length,
    "Perimeter": lambda s: length(s, closed=True),
    "LengthSpheroid": great_circle,
    "PerimeterSpheroid": lambda s: great_circle(s, closed=True),
    "AreaSpheroid": lambda s: area(s) * METRES_A_DEGREE**2 * math.cos(math.radians(float(s.vertices()[:, 1].mean()))),
}


def point(x, y):  # noqa: ANN001, ANN201
    """WKB point of two coordinates."""

    @F.pandas_udf("binary")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        raw = np.empty(len(x), dtype=POINT_BYTES)
        raw["order"], raw["kind"], raw["x"], raw["y"] = 1, POINT, x.astype("float64"), y.astype("float64")
        data, n = raw.tobytes(), POINT_BYTES.itemsize
        return pd.Series([None if none else data[k * n : k * n + n] for k, none in enumerate(x.isna() | y.isna())], dtype=object)

    return run(x, y)


def measurement(col, name: str):  # noqa: ANN001, ANN201
    """Area, length or perimeter, planar or on the globe."""

    @F.pandas_udf("double")
    def run(g: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else MEASURES[name](Shape(x)) for x in g], dtype="float64")

    return run(col)


def transformed(col, steps: list[tuple]):  # noqa: ANN001, ANN201
    """Transforms in order, each ``(name, *arguments)``."""

    @F.pandas_udf("binary")
    def run(g: pd.Series) -> pd.Series:
        out = []
        for x in g:
            for step in steps:
                x = None if x is None else transform(x, *step)
            out.append(x)
        return pd.Series(out, dtype=object)

    return run(col)


def predicate(a, b, name: str, metres: float = 0.0):  # noqa: ANN001, ANN201
    """INTERSECTS, WITHIN, CONTAINS, DISJOIN, EQUALS or DWITHIN between two WKB columns; NULL gives false."""
    tests = {
        "INTERSECTS": intersects,
        "CONTAINS": contains,
        "WITHIN": lambda s, t: contains(t, s),
        "DISJOIN": lambda s, t: not intersects(s, t),
        "EQUALS": lambda s, t: contains(s, t) and contains(t, s),
        "DWITHIN": lambda s, t: distance(s, t) <= metres / METRES_A_DEGREE,
    }

    @F.pandas_udf("boolean")
    def run(g: pd.Series, h: pd.Series) -> pd.Series:
        shape = functools.lru_cache(SHAPES)(Shape)  # a side that is met by many rows is read once
        return pd.Series([x is not None and y is not None and tests[name](shape(bytes(x)), shape(bytes(y))) for x, y in zip(g, h, strict=True)], dtype=bool)

    return run(a, b)
