"""Results: JSON text with ISO times, flattened columns, GeoJSON, and a cache of results."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindle.functions import geo


def rendered(col: Column, kind: T.DataType) -> Column:
    """A value as it stands in JSON: RFC 3339 times, ISO dates, structs and lists member by member."""
    if isinstance(kind, T.TimestampType):
        return F.date_format(F.to_utc_timestamp(col, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if isinstance(kind, T.TimestampNTZType):
        return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSS")
    if isinstance(kind, T.StructType):
        return F.when(col.isNotNull(), F.struct(*[rendered(col[f.name], f.dataType).alias(f.name) for f in kind]))
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: rendered(x, kind.elementType))
    if isinstance(kind, T.BinaryType):
        return F.base64(col)
    return col


def to_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as a JSON object; NULLs are written."""
    row = F.struct(*[rendered(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])
    return df.select(F.to_json(row, {"ignoreNullFields": "false"}).alias(name))


def flattened(df: DataFrame, sep: str = ".") -> DataFrame:
    """Struct fields as columns of their own (``a.b``); lists and maps as JSON text."""

    def walk(col: Column, kind: T.DataType, name: str) -> list[Column]:
        if isinstance(kind, T.StructType):
            return [c for f in kind for c in walk(col[f.name], f.dataType, f"{name}{sep}{f.name}")]
        if isinstance(kind, (T.ArrayType, T.MapType)):
            return [F.to_json(col).alias(name)]
        return [col.alias(name)]

    return df.select(*[c for f in df.schema for c in walk(F.col(f"`{f.name}`"), f.dataType, f.name)])


def arrow(df: DataFrame) -> pa.Table:
    return df.toArrow()


def geojson(df: DataFrame, geometry: str, identity: str | None = None) -> DataFrame:
    """Each row as a GeoJSON feature."""
    kinds = {geo.POINT: "Point", geo.LINE: "LineString", geo.POLYGON: "Polygon", geo.MULTI_POINT: "MultiPoint", geo.MULTI_LINE: "MultiLineString", geo.MULTI_POLYGON: "MultiPolygon"}

    @F.pandas_udf("string")
    def text(g: pd.Series) -> pd.Series:
        out = []
        for x in g:
            kind, parts, _ = geo.decode(bytes(x)) if x is not None else (None, None, 0)
            out.append("null" if kind is None else json.dumps({"type": kinds[kind], "coordinates": parts}))
        return pd.Series(out, dtype=object)

    rest = F.to_json(F.struct(*[c for c in df.columns if c != geometry]), {"ignoreNullFields": "false"})
    head = F.concat(F.lit('"id":'), F.to_json(F.array(identity)).substr(F.lit(2), F.length(F.to_json(F.array(identity))) - 2), F.lit(",")) if identity else F.lit("")
    return df.select(F.concat(F.lit('{"type":"Feature",'), head, F.lit('"geometry":'), text(geometry), F.lit(',"properties":'), rest, F.lit("}")).alias("feature"))


class ResultCache:
    """Results kept by key and tags for a time; keys hold the role and user, so nobody sees another's rows."""

    def __init__(self) -> None:
        self.entries: dict[tuple, tuple[float, set[str], DataFrame]] = {}

    def get(self, key: tuple, make: Callable[[], DataFrame], ttl: float = 60.0, tags: tuple[str, ...] = ()) -> DataFrame:
        hit = self.entries.get(key)
        if hit and hit[0] > time.time():
            return hit[2]
        if hit:
            hit[2].unpersist()
        df = make().persist()
        self.entries[key] = (time.time() + ttl, set(tags), df)
        return df

    def invalidate(self, *tags: str) -> int:
        gone = [k for k, (_, own, _) in self.entries.items() if not tags or own & set(tags)]
        for k in gone:
            self.entries.pop(k)[2].unpersist()
        return len(gone)
