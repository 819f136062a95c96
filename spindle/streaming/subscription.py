"""Subscriptions: queries that run again at intervals, and event-time windows over streams."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ticks(query: Callable[[], DataFrame], interval: float = 0.0, count: int = 1) -> Iterator[DataFrame]:
    """The query's result, planned anew each time, ``count`` times (0: for ever) with ``interval`` seconds between."""
    k = 0
    while not count or k < count:
        if k and interval:
            time.sleep(interval)
        yield query()
        k += 1


def ticked(query: Callable[[], DataFrame], count: int) -> DataFrame:
    """The results of ``count`` ticks in one frame, with the tick's number."""
    return reduce(DataFrame.unionByName, [df.withColumn("tick", F.lit(k + 1)) for k, df in enumerate(ticks(query, 0.0, count))])


def subscribe(paths: dict[str, Callable[[], DataFrame]], on_batch: Callable[[str, int, DataFrame], None], interval: float = 0.0, count: int = 1) -> None:
    """Runs several queries side by side, each on its own schedule, and hands every result to ``on_batch``."""

    def run(item: tuple[str, Callable[[], DataFrame]]) -> None:
        for k, df in enumerate(ticks(item[1], interval, count)):
            on_batch(item[0], k + 1, df)

    with ThreadPoolExecutor(max_workers=max(1, len(paths))) as pool:
        list(pool.map(run, paths.items()))


def batches(df: DataFrame, rows: int = 10_000) -> Iterator[list]:
    """A result as batches of rows, without gathering it."""
    held: list = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == rows:
            yield held
            held = []
    if held:
        yield held


def windowed(stream: DataFrame, time_col: str, width: str, slide: str | None, late: str, keys: list[str], value: str) -> DataFrame:
    """Counts and sums by event-time window; rows later than ``late`` behind the newest one are left out."""
    slot = F.window(time_col, width, slide) if slide else F.window(time_col, width)
    return stream.withWatermark(time_col, late).groupBy(slot, *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def sessions(stream: DataFrame, time_col: str, gap: str, late: str, keys: list[str]) -> DataFrame:
    """Counts by session: rows of one key with less than ``gap`` between them."""
    return stream.withWatermark(time_col, late).groupBy(F.session_window(time_col, gap), *keys).agg(F.count(F.lit(1)).alias("n"))


def file_stream(spark: SparkSession, folder: str, schema, files: int = 1) -> DataFrame:  # noqa: ANN001
    """New Parquet files of a folder as a stream, ``files`` of them a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
