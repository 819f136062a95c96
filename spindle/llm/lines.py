"""Operator 7: line deduplication by a deletion-neighbourhood join.

The symbols of a line are its words (runs of anything but ASCII white space).  Two lines are duplicates if their word sequences are equal or,
where the shorter one has at least ``min_words`` words, if one insertion, deletion or substitution of a word makes them equal (one, so
that every line is included, compares "a b" with "a c" as well; the default asks for one edit in ten words at most).  A line of a document goes if the same line, or one within the bound, occurs first at an earlier place (smaller id, then line number); it is
judged on the input, not on what is left.

Each line stands for itself and for its variants with one word deleted, as hashed keys.  Lines that differ in word i share the variant
without it, at place i; a line with one word more has the shorter line itself as a variant.  So within a key it is enough to compare a
line with the earliest one of its place and with the one that is whole: a key held by many lines gives one pair for each of them.
Variants are emitted for lines that share a half with another line only: one edit leaves the other half of a line as it was.
What a half or a variant has in common is found by grouped minima and maxima, which are combined before the shuffle, and goes back to the
lines by ``hot_join``: a half or a variant that a third of all lines share never meets in one task.

Defined cases: null text stays null; lines without words are kept; a null id sorts last; rows repeated as a whole are treated alike;
an empty table gives an empty result; the other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.llm.common import boxed, cut, drop, hot_join, order_id, packed, row_key, unpacked
from spindle.llm.shingles import UNPLACE, WordHashes, hashed, mix, powers

MIN_WORDS = 10  #: default of ``min_words``: words from which on a line may differ in one of them
BATCH_DOCS = 200  #: documents whose words are hashed together


def pieces(part: np.ndarray, back: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of word runs ``start`` to ``stop`` from the running sums over all words, whatever stands before them."""
    return (part[stop] - part[start]) * back[start]


def batch_lines(h: np.ndarray, sizes: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Names of lines of ``sizes`` words each, and four half keys of each line (0 where it has none).

    A line may meet lines of as many words, of one more and of one less: with ``least`` words in the shorter of two, one edit leaves the first
    ``least // 2`` words or the other ones at the end as they were.
    """
    part = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(h * powers(h.size), dtype=np.uint64)])
    back = powers(h.size + 1, UNPLACE)
    stop = np.cumsum(sizes)
    start = stop - sizes
    names = mix(pieces(part, back, start, stop) + sizes.astype(np.uint64)).view(np.int64)
    keys = np.zeros((sizes.size, 4), dtype=np.int64)
    for k, least in enumerate((sizes, sizes - 1)):
        p, ok = least // 2, least >= max(min_words, 1)
        for side, (a, b) in enumerate(((start, start + p), (stop - (least - p), stop))):
            found = mix(pieces(part, back, a[ok], b[ok]) + (2 * least[ok] + side).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            keys[ok, 2 * k + side] = found.view(np.int64)
    return names, keys


def variants(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, place, hash)`` of the variants of lines of ``sizes`` words each: the line itself (place -1) and it without its k-th word (place k)."""
    part = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(h * powers(h.size), dtype=np.uint64)])
    back = powers(h.size + 1, UNPLACE)
    stop = np.cumsum(sizes)
    start = stop - sizes
    whole = mix(pieces(part, back, start, stop) + sizes.astype(np.uint64))
    row = np.repeat(np.arange(sizes.size), sizes)
    at = np.arange(h.size)
    rest = (part[at] - part[start[row]] + (part[stop[row]] - part[at + 1]) * np.uint64(UNPLACE)) * back[start[row]]
    short = mix(rest + (sizes[row] - 1).astype(np.uint64))
    rows, places = np.concatenate([np.arange(sizes.size), row]), np.concatenate([np.full(sizes.size, -1), at - start[row]])
    return rows, places.astype(np.int32), np.concatenate([whole, short]).view(np.int64)


def one_edit(a: list[bytes], b: list[bytes]) -> bool:
    """Whether at most one insertion, deletion or substitution of a word turns ``a`` into ``b``."""
    if abs(len(a) - len(b)) > 1:
        return False
    start = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    skip_a, skip_b = int(len(a) >= len(b)), int(len(b) >= len(a))
    return a[start + skip_a :] == b[start + skip_b :]


def keyed(docs: DataFrame) -> DataFrame:
    return row_key(docs).withColumn("_o", order_id())


def occurrences(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(_o, _tag, line_no, line, halves)`` of each line that has words."""
    halves = pa.list_(pa.int64())
    out = pa.schema([("_o", pa.int64()), ("_tag", pa.int64()), ("line_no", pa.int32()), ("line", pa.int64()), ("halves", halves)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for big in batches:
            for first in range(0, big.num_rows, BATCH_DOCS):
                batch = big.slice(first, BATCH_DOCS)
                found: list[bytes] = []
                o, tag, number, sizes = [], [], [], []
                for own, own_tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    for k, line in enumerate((text.as_py() or "").encode("utf-8", "surrogatepass").split(b"\n")):
                        words = line.split()
                        if words:
                            found += words
                            o.append(own)
                            tag.append(own_tag)
                            number.append(k)
                            sizes.append(len(words))
                if not sizes:
                    continue
                names, keys = batch_lines(hashed(found, cache), np.array(sizes, dtype=np.int64), min_words)
                real = keys != 0
                ends = np.concatenate([[0], np.cumsum(real.sum(axis=1))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[real]))
                yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()), pa.array(tag, pa.int64()), pa.array(number, pa.int32()), pa.array(names), lists], schema=out)

    return keyed(docs).select("_o", "_tag", "text").mapInArrow(run, "_o long, _tag long, line_no int, line long, halves array<long>")


def shared_keys(keys: DataFrame, key: str) -> DataFrame:
    """``(key, n)`` of the keys that more than one line has, ``n`` = rows."""
    return keys.groupBy(key).agg(F.min("line").alias("lo"), F.max("line").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select(key, "n")


def suspects(docs: DataFrame, seen: DataFrame, first: DataFrame) -> DataFrame:
    """``(line, _fo, _ft, _fn, text)`` of the lines that share a half with another one, with their first place."""
    keys = seen.where(F.size("halves") > 0).select("line", F.explode("halves").alias("bucket"))
    shared = cut(shared_keys(keys, "bucket"), "halves")
    names = hot_join(keys, shared, "bucket", "n").select("line").distinct()
    places = first.join(names, "line").groupBy("_fo", "_ft").agg(F.collect_list(F.struct("_fn", "line")).alias("_lines"))  # within one document
    places = cut(places, "places")
    rows = packed(keyed(docs).select("_o", "_tag", "text"))
    rows = rows.join(places.hint("merge"), (F.col("_o") == F.col("_fo")) & (F.col("_tag") == F.col("_ft")))  # neither side has a bound
    names = ["line", "_fo", "_ft", "_fn", "text"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for fo, ft, listed, z in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = unpacked(z).split("\n")
                out += [(x["line"], fo, ft, x["_fn"], parts[x["_fn"]]) for x in listed]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types], names=names)

    return rows.select("_fo", "_ft", "_lines", "z").mapInArrow(run, "line long, _fo long, _ft long, _fn int, text string")


def neighbours(lines: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of lines that share a variant, each line with the earliest of its place and with the whole one."""
    out = pa.schema([("key", pa.int64()), ("place", pa.int32()), ("line", pa.int64()), ("_fo", pa.int64()), ("_ft", pa.int64()), ("_fn", pa.int32())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for big in batches:
            for first in range(0, big.num_rows, BATCH_DOCS):
                batch = big.slice(first, BATCH_DOCS)
                found = [(t.as_py() or "").encode().split() for t in batch.column(4)]
                sizes = np.array([len(x) for x in found], dtype=np.int64)
                row, place, key = variants(hashed([w for x in found for w in x], cache), sizes)
                same = [batch.column(k).take(pa.array(row)) for k in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(place), *same], schema=out)

    rows = lines.select("line", "_fo", "_ft", "_fn", "text").mapInArrow(run, "key long, place int, line long, _fo long, _ft long, _fn int")
    rows = cut(rows, "variants")
    shared = cut(shared_keys(rows, "key"), "shared")
    met = hot_join(rows, shared, "key", "n").select("key", F.struct("key", "place").alias("spot"), "place", "line", F.struct("_fo", "_ft", "_fn", "line").alias("f"))
    met = cut(met, "met")
    drop(rows)
    cutting = F.col("place") >= 0
    of_place = met.where(cutting).groupBy("spot").agg(F.min("f")["line"].alias("earliest"), F.count(F.lit(1)).alias("n"))
    of_key = met.groupBy("key").agg(
        F.max(F.when(~cutting, F.col("line"))).alias("whole"),
        F.min(F.when(cutting, F.col("f")))["line"].alias("longer"),
        F.count(F.lit(1)).alias("n"),
    )
    of_key = cut(of_key.where("whole is not null and longer is not null"), "wholes")
    same_place = hot_join(met.where(cutting), cut(of_place.where("n > 1"), "places"), "spot", "n").select("line", F.col("earliest").alias("other"))
    with_whole = hot_join(met, of_key, "key", "n").select("line", F.when(cutting, F.col("whole")).otherwise(F.col("longer")).alias("other"))
    pairs = same_place.union(with_whole).where("other <> line")
    return pairs.select(F.least("line", "other").alias("a"), F.greatest("line", "other").alias("b")).distinct()


def replaced(docs: DataFrame, seen: DataFrame, first: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The lines that have an earlier one within the bound (and differ from it)."""
    lines = cut(suspects(docs, seen, first), "suspects")
    pairs = cut(neighbours(lines), "pairs")
    side = lambda s: lines.select(F.col("line").alias(s), F.struct("_fo", "_ft", "_fn").alias(f"f_{s}"), F.col("text").alias(f"text_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    @F.pandas_udf("boolean")
    def close(a, b):  # noqa: ANN001, ANN202
        import pandas as pd

        out = []
        for x, y in zip(a, b, strict=True):
            u, v = (x or "").encode().split(), (y or "").encode().split()
            out.append(min(len(u), len(v)) >= min_words and one_edit(u, v))
        return pd.Series(out, dtype=bool)

    both = both.where(close("text_a", "text_b"))
    return both.select(F.when(F.col("f_a") < F.col("f_b"), F.col("b")).otherwise(F.col("a")).alias("line")).distinct()


def removals(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(_o, _tag, _gone)``: the line numbers that go, for each document that loses any."""
    seen = cut(occurrences(docs, min_words), "lines")
    first = seen.groupBy("line").agg(F.min(F.struct("_o", "_tag", "line_no")).alias("f"), F.count(F.lit(1)).alias("n"))
    first = cut(first.select("line", "n", F.col("f._o").alias("_fo"), F.col("f._tag").alias("_ft"), F.col("f.line_no").alias("_fn")), "first")
    late = replaced(docs, seen, first, min_words).withColumn("late", F.lit(True))
    fate = first.join(late, "line", "left").where("n > 1 or late")
    fate = cut(fate.withColumn("late", F.coalesce("late", F.lit(False))), "fate")
    rows = hot_join(seen.drop("halves"), fate, "line", "n")
    earliest = (F.col("_o") == F.col("_fo")) & (F.col("_tag") == F.col("_ft")) & (F.col("line_no") == F.col("_fn"))
    gone = rows.where(F.col("late") | ~earliest)
    return gone.groupBy("_o", "_tag").agg(F.collect_set("line_no").alias("_gone"))  # within one document


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] = ("n_lines", "n_removed"), min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the lines that go taken out of the text, and ``n_lines``, ``n_removed`` (or ``counts``), in place of columns of these names."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    gone = cut(removals(narrow, min_words), "removals").select(F.col("_o").alias("_o2"), F.col("_tag").alias("_t2"), "_gone")
    others = [c for c in docs.columns if c != text_col]
    rows = packed(boxed(docs, id_col, text_col).withColumn("_row", F.struct(*[F.col("_row")[c].alias(c) for c in others])))
    rows = rows.join(gone.hint("merge"), (F.col("_o") == F.col("_o2")) & (F.col("_tag") == F.col("_t2")), "left")  # neither side has a bound

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_removed = [], [], []
            for z, lost in zip(batch.column(1), batch.column(2), strict=True):
                text, gone_lines = unpacked(z.as_py()), set(lost.as_py() or ())
                parts = [] if text is None else text.split("\n")
                texts.append("\n".join(p for k, p in enumerate(parts) if k not in gone_lines) if gone_lines else text)
                n_lines.append(len(parts))
                n_removed.append(len(gone_lines))
            made = [pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["_row", "_text", "n_lines", "n_removed"])

    moved = rows.select("_row", "z", "_gone")
    out = moved.mapInArrow(run, moved.drop("z", "_gone").schema.add("_text", "string").add("n_lines", "long").add("n_removed", "long"))
    own = [F.col("_text").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns if c not in counts]
    return out.select(*own, F.col("n_lines").alias(counts[0]), F.col("n_removed").alias(counts[1]))
