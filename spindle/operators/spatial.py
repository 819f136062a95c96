"""Spatial joins and grid-cell analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindle.functions import geo, grid

MAX_BUFFER = 5000.0  #: metres


def spatial_join(left: DataFrame, right: DataFrame, left_geometry: str, right_geometry: str, kind: str = "INTERSECTS", metres: float = 0.0,
                 resolution: int = 4, how: str = "inner") -> DataFrame:
    """Pairs of rows whose geometries meet the predicate (``how`` inner), or the left rows with or without a partner (semi, anti).

    Both sides are spread over the grid cells that their boxes touch and equi-joined by cell.  A pair that shares several cells is taken in one
    of them only, the one with the lower left corner of the boxes' overlap, so no distinct is needed.  DISJOIN is the anti form of INTERSECTS.
    """
    if not 0 <= metres <= MAX_BUFFER:
        raise ValueError(f"buffer must be 0 to {MAX_BUFFER:g} m")
    if kind == "DISJOIN":
        return spatial_join(left, right, left_geometry, right_geometry, "INTERSECTS", metres, resolution, "anti")
    exact = "DWITHIN" if metres and kind in ("INTERSECTS", "DWITHIN") else kind
    size = grid.cell_degrees(resolution)
    keyed = left.withColumn("_left_row", F.struct(*left.columns)) if how != "inner" else left
    a = keyed.withColumn("_box_l", grid.bounds(F.col(left_geometry), metres)).withColumn("_cell", F.explode(grid.covering(F.col("_box_l"), resolution)))
    b = right.select(*[F.col(c).alias(f"_r_{c}") for c in right.columns])
    b = b.withColumn("_box_r", grid.bounds(F.col(f"_r_{right_geometry}"))).withColumn("_cell", F.explode(grid.covering(F.col("_box_r"), resolution)))
    l, r = F.col("_box_l"), F.col("_box_r")  # noqa: E741
    overlap = (l["x1"] <= r["x2"]) & (r["x1"] <= l["x2"]) & (l["y1"] <= r["y2"]) & (r["y1"] <= l["y2"])
    corner = grid.pack(grid.index(F.greatest(l["x1"], r["x1"]), 0, size), grid.index(F.greatest(l["y1"], r["y1"]), 1, size), resolution)
    met = a.join(b, "_cell").where(overlap & (F.col("_cell") == corner))
    met = met.where(geo.predicate(F.col(left_geometry), F.col(f"_r_{right_geometry}"), exact, metres))
    if how == "inner":
        names = [F.col(f"_r_{c}").alias(c if c not in left.columns else f"right_{c}") for c in right.columns]
        return met.select(*left.columns, *names)
    hits = met.select(F.to_json("_left_row").alias("_hit")).distinct()
    return left.join(hits, F.to_json(F.struct(*left.columns)) == F.col("_hit"), f"left_{how}")


def by_cell(df: DataFrame, cells: Column, measures: dict[str, Column], divide: bool = False) -> DataFrame:
    """Aggregates by cell; ``cells`` is one id or an array.  With ``divide`` a row counts for 1 / its cells in each."""
    several = "array" in df.select(cells.alias("c")).dtypes[0][1]
    listed = cells if several else F.array(cells)
    spread = df.withColumn("_n", F.size(listed)).withColumn("_cell", F.explode(listed)).withColumn("_share", F.lit(1.0) / F.col("_n") if divide else F.lit(1.0))
    sums = [F.sum(c * F.col("_share")).alias(name) for name, c in measures.items()]
    return spread.groupBy("_cell").agg(F.sum("_share").cast("long").alias("_rows_count"), *sums)


def merged(parts: dict[str, DataFrame]) -> DataFrame:
    """Cell aggregates of several sources side by side, one row for each cell of any."""
    out = None
    for name, df in parts.items():
        df = df.select("_cell", *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != "_cell"])
        out = df if out is None else out.join(df, "_cell", "full")
    return out


def distribution(numerator: DataFrame, denominator: DataFrame, key: str, value: str, weight: str, by: list[str] | None = None) -> DataFrame:
    """Each ``value`` of ``numerator`` (by ``key``) spread over the cells of ``denominator`` in proportion to ``weight``."""
    by = by or []
    total = Window.partitionBy(key, *by)
    shares = denominator.withColumn("ratio", F.try_divide(F.col(weight), F.sum(weight).over(total)))
    return numerator.join(shares, key, "left").withColumn("spread", F.col(value) * F.col("ratio"))


def extent(df: DataFrame, geometry: str, keys: list[str] | None = None) -> DataFrame:
    """Bounding box of all geometries of a group, from the boxes of the single ones."""
    boxed = df.withColumn("_box", grid.bounds(F.col(geometry)))
    ends = [F.min("_box.x1").alias("x1"), F.min("_box.y1").alias("y1"), F.max("_box.x2").alias("x2"), F.max("_box.y2").alias("y2")]
    return boxed.groupBy(*(keys or [])).agg(*ends)
