"""Ranges as structs ``(lower, upper, lower_inc, upper_inc)``; a NULL bound is open."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def make(lower: Column, upper: Column, lower_inc: bool = True, upper_inc: bool = False) -> Column:
    return F.struct(lower.alias("lower"), upper.alias("upper"), F.lit(lower_inc).alias("lower_inc"), F.lit(upper_inc).alias("upper_inc"))


def parse(text: str, cast=int) -> dict:  # noqa: ANN001
    """``[1,5)`` and the like; an empty side is unbounded."""
    m = re.fullmatch(r"\s*([\[(])\s*([^,]*?)\s*,\s*([^,]*?)\s*([\])])\s*", text)
    if not m:
        raise ValueError(f"not a range: {text!r}")
    side = lambda s: cast(s) if s else None
    return {"lower": side(m[2]), "upper": side(m[3]), "lower_inc": m[1] == "[", "upper_inc": m[4] == "]"}


def literal(value: dict | str, cast=int) -> Column:  # noqa: ANN001
    v = parse(value, cast) if isinstance(value, str) else value
    return make(F.lit(v["lower"]), F.lit(v["upper"]), v.get("lower_inc", True), v.get("upper_inc", False))


def contains(r: Column, x: Column) -> Column:
    above = r["lower"].isNull() | (x > r["lower"]) | (r["lower_inc"] & (x == r["lower"]))
    below = r["upper"].isNull() | (x < r["upper"]) | (r["upper_inc"] & (x == r["upper"]))
    return above & below


def intersects(a: Column, b: Column) -> Column:
    def starts_before_end(x: Column, y: Column) -> Column:
        return x["lower"].isNull() | y["upper"].isNull() | (x["lower"] < y["upper"]) | (x["lower_inc"] & y["upper_inc"] & (x["lower"] == y["upper"]))

    return starts_before_end(a, b) & starts_before_end(b, a)


def includes(a: Column, b: Column) -> Column:
    """Whether ``a`` covers all of ``b``."""
    low = a["lower"].isNull() | (b["lower"].isNotNull() & ((a["lower"] < b["lower"]) | ((a["lower"] == b["lower"]) & (a["lower_inc"] | ~b["lower_inc"]))))
    high = a["upper"].isNull() | (b["upper"].isNotNull() & ((a["upper"] > b["upper"]) | ((a["upper"] == b["upper"]) & (a["upper_inc"] | ~b["upper_inc"]))))
    return F.coalesce(low, F.lit(False)) & F.coalesce(high, F.lit(False))


def equals(a: Column, b: Column) -> Column:
    return a["lower"].eqNullSafe(b["lower"]) & a["upper"].eqNullSafe(b["upper"]) & (a["lower_inc"] == b["lower_inc"]) & (a["upper_inc"] == b["upper_inc"])
