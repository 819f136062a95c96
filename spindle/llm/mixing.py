"""Operator 6: mixing sources to target weights by Pfair scheduling.

The weights are exact fractions.  The mix is the longest one that they allow: it ends where the first source has given its last row, and each
source is in it with the whole rows of its target.  In blocks of ``BLOCK_DOCS`` rows that makes a share for each source, and the shares add up to
the ``Q`` slots of the schedule.

A source with ``share`` out of ``Q`` slots owns, for its k-th block, the window [floor((k-1)Q/share), ceil(kQ/share)).
Earliest-deadline-first over the released blocks places each one inside its window, so after any number of slots each
source has received its target within less than one block.  The slots are laid out once (``SLOTS`` and one for each source at most: blocks grow
with the table beyond that) and every block finds its slot by a join with them.  Rows that are left over repeat the schedule after its end.

Defined cases: a null source is a source of its own; rows with a null id come last within their source; rows repeated
with one id take successive places; an empty table gives an empty result.  Where so few sources are given that ``CAP`` can't hold for all of
them, they get equal weights.  A source whose target is below one row gets no slot; by default there is none.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindle.llm.common import cut, partitions

PERIOD = 10_000  #: slots of a period, where shares of a given number of slots are asked for
SLOTS = 200_000  #: blocks of a mix, besides one for each source; larger tables have larger blocks
BLOCK_DOCS = 4  #: documents of a block
CAP = Fraction(1, 5)  #: no source may have more than this part of the mix
MAX_SOURCES = 100_000  #: sources whose counts may be gathered on the driver


def capped_weights(counts: dict, cap: Fraction = CAP) -> dict:
    """Weights in proportion to ``counts``, those of large sources cut to ``cap``, or to equal parts where ``cap`` is less than these."""
    cap = max(cap, Fraction(1, max(1, len(counts))))
    rest, capped = dict(counts), {}
    while rest:
        left, total = 1 - cap * len(capped), sum(rest.values())
        over = [s for s, n in rest.items() if n * left > cap * total]
        if not over:
            break
        capped |= dict.fromkeys(over, cap)
        rest = {s: n for s, n in rest.items() if s not in capped}
    total, left = sum(rest.values()), 1 - cap * len(capped)
    return capped | {s: Fraction(n, total) * left for s, n in rest.items()}


def capped_shares(counts: dict, cap: Fraction = CAP, period: int = PERIOD) -> dict:
    """The capped weights as integer shares of about ``period`` slots."""
    return {s: max(1, int(w * period)) for s, w in capped_weights(counts, cap).items()}


def mixed_rows(counts: dict, weights: dict) -> dict:
    """Rows of each source in the longest mix with these weights: it ends where the first source has given all its rows."""
    length = min((counts[s] / w for s, w in weights.items()), default=0)
    return {s: int(w * length) for s, w in weights.items()}


def slot_table(shares: dict) -> list[tuple]:
    """One period of the schedule, ``(source, turn, slot)``: earliest deadline first among the released blocks."""
    period = sum(shares.values())
    order = sorted(shares, key=lambda s: (s is not None, s))
    waiting = [(0, k, 0) for k in range(len(order))]  # release time, source, turn
    ready: list[tuple[int, int, int]] = []
    out = []
    heapq.heapify(waiting)
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, k, turn = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(turn + 1) * period // shares[order[k]]), k, turn))
        _, k, turn = heapq.heappop(ready)
        out.append((order[k], turn, slot))
        if turn + 1 < shares[order[k]]:
            heapq.heappush(waiting, ((turn + 1) * period // shares[order[k]], k, turn + 1))
    return out


def ordinals(docs: DataFrame, id_col: str, source_col: str, extra: list[str]) -> DataFrame:
    """``(doc_id, source, ordinal)``, counted from 0 in id order within each source.

    Ranges of (source, id) are numbered on their own and shifted by the rows before them: a hot source spreads over many ranges.
    """
    spark = docs.sparkSession
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_last(), *(F.col(c) for c in extra)]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), *extra)
    ranged = cut(rows.repartitionByRange(partitions(spark), *order).withColumn("range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("source", "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    within = Window.partitionBy("source", "range").orderBy(F.col("doc_id").asc_nulls_last(), *extra)
    numbered = ranged.withColumn("k", F.row_number().over(within) - 1)
    joined = numbered.join(shift, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    return joined.select("doc_id", "source", *extra, (F.col("shift") + F.col("k")).alias("ordinal"))


def mix(
    docs: DataFrame,
    shares: dict | None = None,
    block_docs: int = BLOCK_DOCS,
    id_col: str = "doc_id",
    source_col: str = "source",
    extra: list[str] | None = None,
) -> DataFrame:
    """``(doc_id, source, block, slot, share, in_mix)`` for every row, and the columns named in ``extra``.

    ``shares`` are integers by source (missing sources get none and stay out); by default sources keep their proportions and those
    above ``CAP`` are cut to it.  ``slot`` orders the blocks; ``share`` is the number of slots of the source in the mix.  ``in_mix`` holds for
    the rows of the longest mixture with the target weights.
    """
    spark, extra = docs.sparkSession, extra or []
    rows = cut(ordinals(docs, id_col, source_col, extra), "ordinals")
    sizes = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()}
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: group them first")
    weights = capped_weights(sizes) if shares is None else {s: Fraction(n) for s, n in shares.items() if s in sizes and n > 0}
    chosen = {s: n for s, n in mixed_rows(sizes, weights).items() if n}
    block_docs = max(block_docs, -(-sum(chosen.values()) // SLOTS))
    blocks = {s: -(-n // block_docs) for s, n in chosen.items()}
    layout = slot_table(blocks)
    number = {s: k for k, s in enumerate(chosen)}
    places = pa.table([pa.array([f(x) for x in layout], pa.int64()) for f in (lambda x: number[x[0]], lambda x: x[1], lambda x: x[2])], names=["k", "turn", "place"])
    by_source = pa.table([pa.array(list(chosen), pa.string()), *(pa.array(list(x.values()), pa.int64()) for x in (number, blocks, chosen))], names=["s", "k", "share", "chosen"])
    out = (
        rows.withColumn("block", F.floor(F.col("ordinal") / block_docs))
        .join(F.broadcast(spark.createDataFrame(by_source)), F.col("source").eqNullSafe(F.col("s")), "left")
        .withColumn("turn_of", F.col("block") % F.col("share"))
        .withColumnRenamed("k", "k_of")
        .join(F.broadcast(spark.createDataFrame(places)), (F.col("k_of") == F.col("k")) & (F.col("turn_of") == F.col("turn")), "left")
    )
    slot = F.floor(F.col("block") / F.col("share")) * len(layout) + F.col("place")
    return out.select(
        "doc_id", "source", *extra, "block", slot.cast("long").alias("slot"), "share", F.coalesce(F.col("ordinal") < F.col("chosen"), F.lit(False)).alias("in_mix")
    )
