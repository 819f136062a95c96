"""Scalar vocabulary: which filters and aggregates a Spark type offers."""

from __future__ import annotations

from pyspark.sql import types as T

ORDERED = ("eq", "ne", "gt", "gte", "lt", "lte", "in", "is_null")
COMMON = ("count", "list", "any", "last")
NUMERIC = (*COMMON, "sum", "avg", "min", "max")

#: scalar: its filters and its aggregates
VOCABULARY = {
    "String": (("eq", "ne", "in", "like", "ilike", "regex", "is_null"), (*COMMON, "string_agg", "min", "max")),
    "Int": (ORDERED, NUMERIC),
    "BigInt": (ORDERED, NUMERIC),
    "Float": (ORDERED, NUMERIC),
    "Boolean": (("eq", "is_null"), (*COMMON, "bool_and", "bool_or")),
    "Date": (ORDERED, (*COMMON, "min", "max")),
    "Timestamp": (ORDERED, (*COMMON, "min", "max")),
    "DateTime": (ORDERED, (*COMMON, "min", "max")),
    "Interval": (ORDERED, COMMON),
    "Vector": (("is_null",), COMMON),
    "List": (("eq", "contains", "intersects", "is_null"), COMMON),
    "Struct": (("is_null",), COMMON),
}


def scalar_of(kind: T.DataType) -> str:
    """The scalar a Spark type stands for; narrower and decimal types fold into the wider ones."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return "Int"
    if isinstance(kind, T.LongType):
        return "BigInt"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "Float"
    if isinstance(kind, T.ArrayType):
        return "Vector" if isinstance(kind.elementType, (T.FloatType, T.DoubleType)) else "List"
    names = {T.BooleanType: "Boolean", T.DateType: "Date", T.TimestampType: "Timestamp", T.TimestampNTZType: "DateTime", T.StructType: "Struct", T.DayTimeIntervalType: "Interval"}
    return names.get(type(kind), "String")


def check_operator(kind: T.DataType, operator: str) -> None:
    scalar = scalar_of(kind)
    if operator not in VOCABULARY[scalar][0] and not (scalar == "Vector" and operator in VOCABULARY["List"][0]):
        raise ValueError(f"{scalar} has no filter {operator!r}")
