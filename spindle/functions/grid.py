"""Cells of a lon/lat grid with sixteen resolutions: a pluggable stand-in for hexagonal cells of like sizes (ids are its own)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from spindle.functions import geo


def cell_degrees(resolution: int) -> float:
    """Edge of a cell in degrees; each resolution has a seventh of the area of the one before."""
    if not 0 <= resolution <= 15:
        raise ValueError("resolution must be 0 to 15")
    return 20.0 / 7 ** (resolution / 2)


def index(lon: Column, axis: int, size: float) -> Column:
    return F.floor((lon + (180.0 if axis == 0 else 90.0)) / F.lit(size)).cast("long")


def pack(x: Column, y: Column, resolution: int) -> Column:
    return F.lit(resolution << 58).cast("long") + x * F.lit(1 << 29) + y


def point_cell(lon: Column, lat: Column, resolution: int) -> Column:
    """Cell id of a point, without Python."""
    size = cell_degrees(resolution)
    return pack(index(lon, 0, size), index(lat, 1, size), resolution)


def hex_id(cell: Column) -> Column:
    return F.lower(F.hex(cell))


def cell_centre(cell: Column, resolution: int) -> Column:
    size = cell_degrees(resolution)
    rest = cell - F.lit(resolution << 58).cast("long")
    x, y = F.floor(rest / F.lit(1 << 29)), F.pmod(rest, F.lit(1 << 29))
    return F.struct(((x + 0.5) * size - 180).alias("lon"), ((y + 0.5) * size - 90).alias("lat"))


def bounds(geometry: Column, metres: float = 0.0) -> Column:
    """Bounding box of a WKB geometry, widened on all sides.

    Marked as not deterministic: filters that Spark infers from a join (no side of a box is null) would otherwise be moved below it and
    compute it a second time, with Python processes of their own in each task.
    """
    wider = metres / geo.METRES_A_DEGREE
    point = geo.encode(geo.POINT, [0.0, 0.0])

    def run(g: pd.Series) -> pd.DataFrame:
        out = np.full((len(g), 4), np.nan)
        points = []
        for k, x in enumerate(g):
            if x is None:
                continue
            if len(x) == len(point) and x[:5] == point[:5]:
                points.append(k)
                continue
            pts = geo.Shape(x).vertices()
            out[k] = [*(pts.min(axis=0) - wider), *(pts.max(axis=0) + wider)]
        raw = np.frombuffer(b"".join(g.iloc[points]), dtype=geo.POINT_BYTES)
        for axis, name in enumerate(("x", "y")):
            out[points, axis], out[points, axis + 2] = raw[name] - wider, raw[name] + wider
        return pd.DataFrame(out, columns=["x1", "y1", "x2", "y2"])

    return F.pandas_udf(run, "struct<x1: double, y1: double, x2: double, y2: double>").asNondeterministic()(geometry)


def covering(box: Column, resolution: int) -> Column:
    """Ids of the cells that a box touches."""
    size = cell_degrees(resolution)
    xs = F.sequence(index(box["x1"], 0, size), index(box["x2"], 0, size))
    ys = F.sequence(index(box["y1"], 1, size), index(box["y2"], 1, size))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: pack(x, y, resolution))))


def geometry_cells(geometry: Column, resolution: int, metres: float = 0.0) -> Column:
    """Cells whose centre lies in the geometry, or the cell of its first vertex if there is none."""
    size = cell_degrees(resolution)

    @F.pandas_udf("array<bigint>")
    def run(g: pd.Series) -> pd.Series:
        out = []
        for data in g:
            if data is None:
                out.append(None)
                continue
            shape = geo.Shape(geo.transform(data, "Buffer", metres) if metres else data)
            pts = shape.vertices()
            (x1, y1), (x2, y2) = np.floor((pts.min(axis=0) + [180, 90]) / size), np.floor((pts.max(axis=0) + [180, 90]) / size)
            found = [
                (resolution << 58) + int(x) * (1 << 29) + int(y)
                for x in np.arange(x1, x2 + 1)
                for y in np.arange(y1, y2 + 1)
                if shape.covers((x + 0.5) * size - 180, (y + 0.5) * size - 90)
            ]
            first = np.floor((pts[0] + [180, 90]) / size).astype(int)
            out.append(found or [(resolution << 58) + int(first[0]) * (1 << 29) + int(first[1])])
        return pd.Series(out, dtype=object)

    return run(geometry)


def cell_polygon(cell: Column, resolution: int) -> Column:
    """WKB outline of a cell."""
    half = cell_degrees(resolution) / 2

    @F.pandas_udf("binary")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        turn = ((-half, -half), (half, -half), (half, half), (-half, half), (-half, -half))
        return pd.Series([geo.encode(geo.POLYGON, [[(a + i, b + j) for i, j in turn]]) for a, b in zip(x, y, strict=True)], dtype=object)

    centre = cell_centre(cell, resolution)
    return run(centre["lon"], centre["lat"])
