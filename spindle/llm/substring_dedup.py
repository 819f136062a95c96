"""Operator 1: removal of repeated passages with an FM-index per shard.

A window is ``WINDOW`` consecutive words of a document.  Its anchor is the ``GRAM``-gram in it with the smallest hash (the first of equal
ones), so equal windows have equal anchors.  The windows around one anchor form a fragment; fragments whose anchor occurs once can't repeat
and are left out.  Equal fragments are one content, of which the first place is kept.  Contents are sharded by anchor, so all windows that may
equal one another meet in one shard: there an FM-index is built over the contents, and backward search of the same contents gives the matching
statistics; windows with a full match that also occurs at an earlier place are reported as intervals.  At the other places of a
content all windows are repeats.

Tasks report an anchor once and only count its further places, so a passage in very many documents doesn't meet in one task.  An anchor with
more than ``HOT_CONTENTS`` different contents is split by window: equal windows become one content, which goes to the shard of its own hash,
so no shard holds more than a bounded number of contents of one anchor.

Defined cases: null and empty texts have no words; documents shorter than a window lose nothing; a null id sorts last; rows
repeated as a whole are treated alike; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindle.llm.common import cut, drop, hot_join, order_id, packed, partitions, row_key
from spindle.llm.fm_index import FMIndex
from spindle.llm.shingles import PLACE, UNPLACE, WordHashes, hashed, mix, powers, windows

WINDOW, GRAM = 20, 8
SECOND = np.uint64(0xD6E8FEB86659FD93)  #: odd multiplier of the second half of a name
HOT_CONTENTS = 5_000
SHARD_TOKENS = 400_000  #: words in a shard, about
SEARCH_ROWS = 50_000  #: windows that are searched at once
SEEN_CONTENTS = 200_000
NO_RUNS = {name: pd.Series(dtype=kind) for name, kind in (("_o", "int64"), ("_tag", "int64"), ("a", "int32"), ("b", "int32"))}


def names_of(h: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
    """128-bit names of the word runs ``start`` to ``stop`` of a text, as two hashes from running sums."""
    out = []
    for words, base, inverse in ((h, PLACE, UNPLACE), (mix(h ^ SECOND), int(SECOND), pow(int(SECOND), -1, 1 << 64))):
        part = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(words * powers(h.size, base), dtype=np.uint64)])
        out.append(mix((part[stop] - part[start]) * powers(h.size + 1, inverse)[start] + (stop - start).astype(np.uint64)))
    return out


def as_binary(first: np.ndarray, second: np.ndarray) -> pa.Array:
    """Names as 16 bytes each."""
    both = np.ascontiguousarray(np.stack([first, second], axis=1))
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), first.size, [None, pa.py_buffer(both)]).cast(pa.binary())


def fragments_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first and last window start of each fragment."""
    if h.size < WINDOW:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    grams = windows(h, GRAM)
    ahead = np.lib.stride_tricks.sliding_window_view(grams, WINDOW - GRAM + 1)
    at = ahead.argmin(axis=1) + np.arange(ahead.shape[0])
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    ends = np.concatenate([starts[1:], [at.size]]) - 1
    return grams[at[starts]].view(np.int64), starts, ends


def anchors_at(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Anchor hashes of the windows that start there."""
    ahead = np.lib.stride_tricks.sliding_window_view(windows(h, GRAM), WINDOW - GRAM + 1)
    return ahead[starts].min(axis=1).view(np.int64)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return row_key(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).withColumn("_o", order_id())


def anchors(rows: DataFrame) -> DataFrame:
    """``(key, salt, places, _o, _tag, a, n)``: the fragments of all documents as ``n`` window starts from ``a``.

    The first place of an anchor in a batch has the anchor as key, no salt and counts the batch's places.  The others are repeats for
    certain; the salt gives them keys of their own.
    """
    names = ["key", "salt", "places", "_o", "_tag", "a", "n"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            found: list[list[np.ndarray]] = [[], [], [], [], []]
            for o, tag, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                anchor, a, b = fragments_of(hashed((t.as_py() or "").encode("utf-8", "surrogatepass").split(), cache))
                for column, x in zip(found, (anchor, np.full(anchor.size, o), np.full(anchor.size, tag), a, b - a + 1), strict=True):
                    column.append(x)
            if found[0]:
                anchor, o, tag, a, n = (np.concatenate(x).astype(t) for x, t in zip(found, (np.int64,) * 3 + (np.int32,) * 2, strict=True))
                _, first, which, counts = np.unique(anchor, return_index=True, return_inverse=True, return_counts=True)
                salt = (mix((tag + a).view(np.uint64)) >> np.uint64(33)).astype(np.int32) | 1
                salt[first] = 0
                columns = [salted(anchor, salt), salt, counts[which].astype(np.int32), o, tag, a, n]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)

    return rows.select("_o", "_tag", "text").mapInArrow(run, "key long, salt int, places int, _o long, _tag long, a int, n int")


def salted(key: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """The key under a salt, or the other way round; salt 0 changes nothing."""
    return key ^ np.where(salt == 0, 0, mix(salt.astype(np.uint64)).view(np.int64))


def repeated_anchors(rows: DataFrame) -> DataFrame:
    """``(_o2, _t2, found)``: for each document the fragments ``(a, n)`` whose anchor occurs again; the anchors follow from the text."""
    spread = anchors(rows).repartition(partitions(rows.sparkSession), "key")
    spread = spread.withColumn("total", F.sum("places").over(Window.partitionBy("key", "salt"))).where("salt <> 0 or total > 1")
    return spread.groupBy(F.col("_o").alias("_o2"), F.col("_tag").alias("_t2")).agg(F.collect_set(F.struct("a", "n")).alias("found"))  # within one document


def fragments(rows: DataFrame, by_doc: DataFrame) -> DataFrame:
    """``(content, shard_key, _o, _tag, a, n, words)`` of every place of a repeated anchor; ``words`` at least once for each content and task."""
    joined = packed(rows.select("_o", "_tag", "text"))
    joined = joined.join(by_doc.hint("merge"), (F.col("_o") == F.col("_o2")) & (F.col("_tag") == F.col("_t2")))  # neither side has a bound
    names = ["content", "shard_key", "_o", "_tag", "a", "n", "words"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, seen = WordHashes(), set()
        for batch in batches:
            columns: list[list[np.ndarray]] = [[], [], [], [], [], [], []]
            texts: list[bytes | None] = []
            places = batch.column(3)
            flat = places.values if hasattr(places, "values") else places.flatten()
            fields = [flat.field(k).to_numpy(zero_copy_only=False) for k in range(2)]  # a, n
            ends = places.offsets.to_numpy()
            for row, (o, tag, z) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True)):
                found = zlib.decompress(z.as_py()).split()
                a, n = (f[ends[row] : ends[row + 1]].astype(np.int64) for f in fields)
                h = hashed(found, cache)
                first, second = names_of(h, a, a + n + (WINDOW - 1))
                for column, x in zip(columns, (first, second, anchors_at(h, a), np.full(a.size, o), np.full(a.size, tag), a, n), strict=True):
                    column.append(x)
                for name, x, y in zip(zip(first.tolist(), second.tolist(), strict=True), a.tolist(), (a + n).tolist(), strict=True):
                    if name in seen:
                        texts.append(None)
                        continue
                    if len(seen) >= SEEN_CONTENTS:
                        seen.clear()
                    seen.add(name)
                    texts.append(b" ".join(found[x : y + WINDOW - 1]))
            if columns[0]:
                named = as_binary(np.concatenate(columns[0]), np.concatenate(columns[1]))
                arrays = [pa.array(np.concatenate(c).astype(t)) for c, t in zip(columns[2:], (np.int64,) * 3 + (np.int32,) * 2, strict=True)]
                yield pa.RecordBatch.from_arrays([named, *arrays, pa.array(texts, pa.binary())], names=names)

    return joined.select("_o", "_tag", "z", "found").mapInArrow(
        run, "content binary, shard_key long, _o long, _tag long, a int, n int, words binary"
    )


def repeats_in_shard(pieces: pd.DataFrame) -> pd.DataFrame:
    """``(_o, _tag, a, b)``: windows of the contents' first places that also start earlier, as runs of window starts.

    A content that is alone with its anchor can't repeat and is left out; all of an anchor meet in this shard.
    """
    cache = WordHashes()
    pieces = pieces[pieces["single"] | pieces["shard_key"].duplicated(keep=False)]
    if pieces.empty:
        return pd.DataFrame(NO_RUNS)
    hashes = [hashed(w.split(), cache) for w in pieces["words"]]
    sizes = np.array([h.size for h in hashes])
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    flat = np.zeros(ends[-1], dtype=np.int64)
    _, flat_ids = np.unique(np.concatenate(hashes), return_inverse=True)
    inside = np.ones(flat.size, dtype=bool)
    inside[ends - 1] = False
    flat[inside] = flat_ids + 1
    index = FMIndex(flat, WINDOW + 1)

    owner = np.repeat(np.arange(sizes.size), pieces["n"].to_numpy())
    offset = np.concatenate([np.arange(n) for n in pieces["n"]])
    at = starts[owner] + offset
    place = np.lexsort((pieces["a"].to_numpy()[owner] + offset, pieces["_tag"].to_numpy()[owner], pieces["_o"].to_numpy()[owner]))
    rank = np.empty(place.size, dtype=np.int64)
    rank[place] = np.arange(place.size)
    rank_at = np.full(flat.size + 1, np.iinfo(np.int64).max)
    rank_at[at] = rank
    by_suffix = rank_at[index.order]
    late = np.zeros(at.size, dtype=bool)
    for k in range(0, at.size, SEARCH_ROWS):
        part = at[k : k + SEARCH_ROWS]
        statistic, lo, hi = index.matches(flat[part[:, None] + np.arange(WINDOW)])
        for_all = np.flatnonzero(statistic == WINDOW)
        if for_all.size:
            spans, which = np.unique(np.stack([lo[for_all], hi[for_all]], axis=1), axis=0, return_inverse=True)
            edges = np.append(spans.ravel(), by_suffix.size)
            earliest = np.minimum.reduceat(np.append(by_suffix, np.iinfo(np.int64).max), edges)[:-1:2]
            late[k + for_all] = rank[k + for_all] > earliest[which.ravel()]
    hit = np.flatnonzero(late)
    if not hit.size:
        return pd.DataFrame(NO_RUNS)
    new = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]])])
    first = hit[new]
    last = np.append(hit[np.flatnonzero(new)[1:] - 1], hit[-1])
    of = owner[first]
    base = pieces["a"].to_numpy()[of]
    return pd.DataFrame({"_o": pieces["_o"].to_numpy()[of], "_tag": pieces["_tag"].to_numpy()[of],
                         "a": (base + offset[first]).astype(np.int32), "b": (base + offset[last]).astype(np.int32)})


def single_windows(contents: DataFrame) -> DataFrame:
    """The first places of contents as one content for each different window, with the other places of each: ``(content, f, places, words)``."""
    names = ["content", "_o", "_tag", "a", "words"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            out: list[tuple] = []
            for o, tag, a, n, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found, start = words.split(), np.arange(n)
                named = as_binary(*names_of(hashed(found, cache), start, start + WINDOW)).to_pylist()
                out += [(name, o, tag, a + k, b" ".join(found[k : k + WINDOW])) for k, name in enumerate(named)]
            types = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types], names=names)

    return contents.select("_o", "_tag", "a", "n", "words").mapInArrow(run, "content binary, _o long, _tag long, a int, words binary")


def later_places(found: DataFrame, several: DataFrame) -> DataFrame:
    """``(_o, _tag, a, n)`` of the places of contents (columns ``content``, ``places``, first place ``f``) that are not the first."""
    rows = hot_join(found.select("content", "_o", "_tag", "a", "n"), several, "content", "places")
    return rows.where(F.struct("_o", "_tag", "a") != F.col("f")).select("_o", "_tag", "a", "n")


def repeats(rows: DataFrame) -> DataFrame:
    """``(_o, _tag, spans)``: for each document with repeats the window starts that are repeats, as runs ``(a, b)``."""
    spark = rows.sparkSession
    by_doc = cut(repeated_anchors(rows), "anchors")
    drop()
    found = cut(fragments(rows, by_doc), "fragments")
    drop(by_doc)
    contents = found.groupBy("content").agg(
        F.min(F.struct("_o", "_tag", "a")).alias("f"), F.count(F.lit(1)).alias("places"), F.max("n").alias("n"), F.max("words").alias("words"),
        F.max("shard_key").alias("shard_key"),
    )
    contents = cut(contents.select("content", "f.*", "places", "n", "words", "shard_key"), "contents")
    drop()

    sizes = contents.groupBy("shard_key").agg(F.count(F.lit(1)).alias("c"))
    crowded = cut(sizes.where(F.col("c") > HOT_CONTENTS).select("shard_key"), "crowded")  # one key for that many contents: mostly known to be small
    hot = cut(single_windows(contents.join(crowded, "shard_key", "left_semi")), "windows")
    drop()
    alone = hot.groupBy("content").agg(F.min(F.struct("_o", "_tag", "a")).alias("f"), F.count(F.lit(1)).alias("places"), F.max("words").alias("words"))
    alone = cut(alone, "window_contents")
    drop()
    pieces = contents.join(crowded, "shard_key", "left_anti").select("shard_key", "_o", "_tag", "a", "n", "words", F.lit(False).alias("single")).unionByName(
        alone.select(F.xxhash64("content").alias("shard_key"), "f.*", F.lit(1).alias("n"), "words", F.lit(True).alias("single"))
    )
    tokens = (contents.agg(F.sum(F.col("n") + WINDOW)).first()[0] or 0) + alone.count() * (WINDOW + 1)
    shards = max(partitions(spark), -(-int(tokens) // SHARD_TOKENS))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("shard_key"), F.lit(shards)))
    inner = pieces.groupBy("shard").applyInPandas(repeats_in_shard, "_o long, _tag long, a int, b int")

    again = later_places(found, contents.where("places > 1").select("content", "places", F.struct("_o", "_tag", "a").alias("f")))
    again = again.unionByName(later_places(hot.withColumn("n", F.lit(1)), alone.where("places > 1").select("content", "places", "f")))
    again = again.select("_o", "_tag", "a", (F.col("a") + F.col("n") - 1).cast("int").alias("b"))
    out = cut(inner.unionByName(again).groupBy("_o", "_tag").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "repeats")  # within one document
    drop(found, contents, crowded, hot, alone)
    return out


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_removed, kept, kept_sha256, spans)`` for every row.

    ``kept`` are the words that stay, joined by one space; ``spans`` the runs of removed words as ``(start, length)``.
    """
    rows = keyed(docs, id_col, text_col)
    gone = repeats(rows).select(F.col("_o").alias("_o2"), F.col("_tag").alias("_t2"), "spans")
    joined = packed(rows.select("_o", "_tag", "doc_id", "text")).join(gone.hint("merge"), (F.col("_o") == F.col("_o2")) & (F.col("_tag") == F.col("_t2")), "left")
    span = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), span]
    names = ["doc_id", "n_words", "n_removed", "kept", "kept_sha256", "spans"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, z, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                found = zlib.decompress(z.as_py()).split() if z.is_valid else []
                stay = np.ones(len(found) + 1, dtype=bool)
                for s in spans or ():
                    stay[s["a"] : s["b"] + WINDOW] = False
                stay[-1] = True
                kept = b" ".join(w for w, ok in zip(found, stay, strict=False) if ok) if spans else b" ".join(found)
                turns = np.flatnonzero(np.diff(np.concatenate([[1], stay.astype(np.int8)])))
                runs = [{"start": int(a), "length": int(b - a)} for a, b in zip(turns[::2], turns[1::2], strict=True)]
                row = (doc_id, len(found), int(len(found) + 1 - stay.sum()), kept.decode(), hashlib.sha256(kept).hexdigest(), runs)
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    return joined.select("doc_id", "z", "spans").mapInArrow(
        run, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string, spans array<struct<start: int, length: int>>"
    )
