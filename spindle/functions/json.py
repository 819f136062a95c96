"""JSON text: typed extraction by path, key tests, containment and canonical equality."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CASTS = {"number": "double", "string": "string", "bool": "boolean", "timestamp": "timestamp", "datetime": "timestamp_ntz", "int": "bigint"}


def json_path(path: str) -> str:
    return path if path.startswith("$") else "$." + path


def extract(col: Column, path: str, kind: str = "string") -> Column:
    """The value at a path; NULL where it is absent or is not of the kind."""
    text = F.get_json_object(col, json_path(path))
    return text if kind == "string" else text.try_cast(CASTS[kind])


def keys_of(col: Column, path: str | None = None) -> Column:
    return F.json_object_keys(F.get_json_object(col, json_path(path)) if path else col)


def has(col: Column, path: str) -> Column:
    """Whether the key exists, whatever its value."""
    parent, _, key = path.rpartition(".")
    return F.coalesce(F.array_contains(keys_of(col, parent or None), key), F.lit(False))


def has_all(col: Column, paths: list[str]) -> Column:
    return F.coalesce(*[F.lit(None)], F.lit(True)) if not paths else _all([has(col, p) for p in paths])


def _all(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def equals(col: Column, value: object) -> Column:
    """Equality of canonical JSON texts."""
    return F.to_json(F.parse_json(col)) == F.lit(value if isinstance(value, str) else json.dumps(value, separators=(",", ":")))


def contains(col: Column, value: object, path: str = "$") -> Column:
    """Whether the document has every leaf of ``value`` at its place; list members may be anywhere in the list."""
    if isinstance(value, dict):
        parts = [contains(col, v, f"{path}.{k}") for k, v in value.items()]
        return _all(parts) if parts else F.get_json_object(col, path).isNotNull()
    text = F.get_json_object(col, path)
    if isinstance(value, list):
        items = F.from_json(text, "array<string>")
        parts = [F.array_contains(items, v if isinstance(v, str) else json.dumps(v)) for v in value]
        return F.coalesce(_all(parts), F.lit(False)) if parts else text.startswith("[")
    if value is None:
        return F.coalesce(has(col, path.removeprefix("$.")) & text.isNull(), F.lit(False))
    if isinstance(value, bool):
        return F.coalesce(text == str(value).lower(), F.lit(False))
    if isinstance(value, (int, float)):
        return F.coalesce(text.try_cast("double") == float(value), F.lit(False))
    return F.coalesce(text == value, F.lit(False))


def to_struct(col: Column, ddl: str) -> Column:
    """Projection of JSON text to a struct."""
    return F.from_json(col, ddl)


def cast_result(df: DataFrame, col: Column, ddl: str) -> Column:
    """``json_cast`` of a function's result: JSON text, or any struct, list or map by way of JSON, as the declared structure."""
    kind = df.select(col).schema[0].dataType
    return F.from_json(col if isinstance(kind, T.StringType) else F.to_json(col), ddl)
