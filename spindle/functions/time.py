"""Time transforms: buckets, interval buckets anchored as calendars expect, parts, and gap filling."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNITS = ("minute", "hour", "day", "week", "month", "quarter", "year")
PARTS = {"minute": "MINUTE", "hour": "HOUR", "day": "DAY", "doy": "DOY", "iso_dow": "DOW_ISO", "week": "WEEK", "month": "MONTH", "year": "YEAR", "iso_year": "YEAROFWEEK", "quarter": "QUARTER"}
ANCHOR_US = 946_857_600_000_000  #: Monday 2000-01-03, the origin of interval buckets of days and less
SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 2592000, "year": 31536000}


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column, kind: T.DataType) -> Column:
    return F.timestamp_micros(us).cast(kind)


def bucket(ts: Column, unit: str, kind: T.DataType) -> Column:
    """Start of the unit, in the type of the input."""
    if unit not in UNITS:
        raise ValueError(f"unknown bucket {unit!r}")
    return F.date_trunc(unit, ts).cast(kind)


def seconds(text: str | float) -> float:
    """Length of an interval: seconds, words ("2 hours"), Go durations ("1h30m") or ISO-8601 ("P1DT2H"); a month is 30 days, a year 365."""
    if isinstance(text, (int, float)):
        return float(text)
    s = text.strip()
    if re.fullmatch(r"-?\d+(\.\d+)?", s):
        return float(s)
    if m := re.fullmatch(r"(-?)P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?", s):
        total = sum(float(n or 0) * u for n, u in zip(m.groups()[1:], (31536000, 2592000, 604800, 86400, 3600, 60, 1), strict=True))
        return -total if m[1] else total
    if re.fullmatch(r"-?(\d+(\.\d+)?(ns|us|ms|h|m|s))+", s):
        units = {"h": 3600, "m": 60, "s": 1, "ms": 1e-3, "us": 1e-6, "ns": 1e-9}
        total = sum(float(n) * units[u] for n, _, u in re.findall(r"(\d+(\.\d+)?)(ns|us|ms|h|m|s)", s))
        return -total if s.startswith("-") else total
    found = re.findall(r"(-?\d+(?:\.\d+)?)\s*([a-z]+?)s?\b", s.lower())
    if not found or any(u not in SECONDS for _, u in found):
        raise ValueError(f"not an interval: {text!r}")
    return sum(float(n) * SECONDS[u] for n, u in found)


def bucket_interval(ts: Column, width: str | float, kind: T.DataType) -> Column:
    """Start of the interval of this width that holds ``ts``; intervals are counted from Monday 2000-01-03."""
    step = int(seconds(width) * 1_000_000)
    us = micros(ts)
    return from_micros(us - F.pmod(us - F.lit(ANCHOR_US), F.lit(step)), kind)


def part(ts: Column, name: str, divide: int | None = None) -> Column:
    """A calendar part as BIGINT (``epoch`` as DOUBLE; Sunday is day 0 of ``dow``); ``divide`` gives floor(part / divide)."""
    if name == "epoch":
        out = micros(ts) / F.lit(1_000_000.0)
    elif name == "dow":
        out = (F.dayofweek(ts) - 1).cast("long")
    else:
        out = F.date_part(F.lit(PARTS[name]), ts).cast("long")
    return F.floor(out / divide).cast("long") if divide else out


def gapfill(df: DataFrame, column: str, step: str) -> DataFrame:
    """``df``, one row for each bucket, with the missing buckets between its first and last one added (other columns NULL)."""
    kind = df.schema[column].dataType
    ends = df.agg(F.min(column).cast("timestamp").alias("a"), F.max(column).cast("timestamp").alias("b")).where("a is not null")
    spine = ends.select(F.explode(F.expr(f"sequence(a, b, interval {step})")).alias("spot")).select(F.col("spot").cast(kind).alias(column))
    return spine.join(df, column, "left").select(*df.columns)
