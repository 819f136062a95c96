"""Operator 5: n-gram Jaccard self-join by parity sketches.

Each set of word shingles is split by hash into k blocks; a block's sketch is a wide bit vector (one bit for each 64-bit hash) in which every
shingle flips its bit.  Every shingle of the symmetric difference flips one bit of one block, so the Hamming distance of two sketches is at most
the size of that difference.  Within a band of set sizes the threshold bounds the difference by d; with k = d + 1 + m blocks, two linked sets
agree in at least 1 + m whole blocks.  Sets that share a (band, block, sketch) bucket are candidates and are verified on their shingles.  So wide
a sketch is sparse: it is kept as a hash of its odd places, and unrelated blocks don't agree by chance unless both are empty.

Empty blocks get no bucket.  A set with at most m of them still meets each partner, since they agree in at least one block that isn't empty.
A set with more of them is split anew under the next seed, too, until it has at most m: two linked sets meet under the first seed that leaves
one of them with so few.  (A set that never gets there has buckets for its empty blocks under the last seed.)

Equal sets are one node.  Bucket rows are sorted into ranges of (bucket, node), so a bucket of any size is spread over many tasks; each range has
a centre for its part of a bucket, and the centres of the parts are compared with one another.  A bucket never emits all its pairs: its nodes
are first compared with one centre, and only nodes that are still in different components are compared further, so a large group of near copies
costs about one comparison per member and bucket.  No pair that could still change a component is left out.

Defined cases: null counts as empty; empty texts have no shingles and link with nothing; a text with fewer words than a shingle is one
shingle; equal sets are linked; rows repeat as they do in the input; a null id never becomes ``component_id`` unless the whole
component has null ids; other columns are ignored.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterable, Iterator
from functools import cache as remembered

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.llm.common import cut, drop, hot_join, packed, partitions, row_key, unpacked
from spindle.llm.components import components
from spindle.llm.shingles import WordHashes, mix, shingle_set

WORDS, PERCENT = 5, 80  #: words of a shingle and least similarity, where the caller states none
BAND = 1.4  #: upper over lower set size of a band
SEEDS = 64  #: how often a set with many empty blocks is split anew
SEEN_NODES = 200_000  #: nodes that a task remembers in order not to emit a set's buckets twice
SKETCH_WORDS = 16  #: 64-bit words of the whole-set sketch that candidates are compared by
ROUNDS = 2  #: how often the nodes of open buckets are compared with one centre before the rest is compared in full


def band_edges(limit: int = 1 << 40) -> np.ndarray:
    edges = [1]
    while edges[-1] < limit:
        edges.append(max(edges[-1] + 1, int(edges[-1] * BAND)))
    return np.array(edges, dtype=np.int64)


EDGES = band_edges()


def band_of(size: int) -> int:
    return int(np.searchsorted(EDGES, size, side="right")) - 1


def most_different(band: int, percent: int) -> int:
    """Largest symmetric difference of two linked sets the smaller of which is in ``band``."""
    return int((EDGES[band + 1] - 1) * (100 - percent) // percent)


@remembered
def blocks_of(band: int, percent: int) -> tuple[int, int]:
    """Number of blocks in a band and m, the number of empty ones that a set may have; no blocks where linked sets are equal."""
    most = most_different(band, percent)
    if most < 1:
        return 0, 0
    m = 0
    for _ in range(12):  # what a set of the least size in the band has about, and half a deviation more
        k = most + 1 + m
        empty = k * np.exp(-EDGES[band] / k)
        m = max(m, int(empty + 0.5 * np.sqrt(empty)))
    return most + 1 + m, m


def node_of(s: np.ndarray) -> int:
    """A set's name: 64 bits of its shingles."""
    if not s.size:
        return 0
    both = np.array([np.bitwise_xor.reduce(s), s.sum(dtype=np.uint64) + np.uint64(s.size)], dtype=np.uint64)
    return int(mix(mix(both[:1]) + both[1:])[0].astype(np.int64))


def sketch_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """The buckets of a set: one for each block that isn't empty, in each band in which the set can meet a partner."""
    low = -(-s.size * percent // 100)
    keys = []
    for band in range(band_of(low), band_of(s.size) + 1):
        blocks, spare = blocks_of(band, percent)
        if not blocks:  # linked sets of this band are equal: they are one node already
            continue
        for seed in range(SEEDS):
            h = mix(s + np.uint64(seed))
            at = (((h & np.uint64(0xFFFFFFFF)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64)
            sketch, held = np.zeros(blocks, dtype=np.uint64), np.zeros(blocks, dtype=bool)
            np.bitwise_xor.at(sketch, at, mix(h))  # the hash of a parity sketch: the XOR of its odd places' hashes
            held[at] = True
            empty = blocks - int(np.count_nonzero(held))
            full = np.arange(blocks) if seed == SEEDS - 1 and empty > spare else np.flatnonzero(held)
            place = mix(full.astype(np.uint64) + np.uint64((band << 48) + (seed << 40)))
            keys.append(mix(sketch[full] + place * np.uint64(3)))
            if empty <= spare:
                break
    return np.concatenate(keys) if keys else s[:0]


def whole_sketch(s: np.ndarray) -> np.ndarray:
    """Parity sketch of a whole set, of one width for all sets."""
    out = np.zeros(SKETCH_WORDS, dtype=np.uint64)
    np.bitwise_xor.at(out, (s & np.uint64(SKETCH_WORDS - 1)).astype(np.int64), np.uint64(1) << (s >> np.uint64(58)))
    return out.view(np.int64)


def sketched(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, _tag, n_shingles, node, sketch, keys)`` of every row; an empty set has a null node, a set that the task has seen no keys."""
    longs = pa.list_(pa.int64())
    out = pa.schema([("doc_id", pa.int64()), ("_tag", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("sketch", longs), ("keys", longs)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, seen = WordHashes(), set()
        for batch in batches:
            sizes, names, sketches, keys = [], [], [], []
            for t in batch.column(2):
                s = shingle_set(t.as_py(), n, cache)
                node = node_of(s) if s.size else None
                sizes.append(s.size)
                names.append(node)
                sketches.append(whole_sketch(s))
                new = node is not None and node not in seen
                keys.append(sketch_keys(s, percent).view(np.int64) if new else None)
                if new:
                    if len(seen) >= SEEN_NODES:
                        seen.clear()
                    seen.add(node)
            arrays = [pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), pa.array(sketches, longs), pa.array(keys, longs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], schema=out)

    rows = row_key(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).select("doc_id", "_tag", "text")
    return rows.mapInArrow(run, "doc_id long, _tag long, n_shingles long, node long, sketch array<long>, keys array<long>")


def met_in_range(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted ``(bucket, node)`` rows those of buckets with several nodes, with the least node here as ``lo``; of the first and the
    last bucket of the range also the least node alone, marked as ``edge``."""
    names = ["bucket", "node", "lo", "edge"]
    none = np.zeros(0, dtype=np.int64)
    bucket, node, lo = none, none, none  # the last row so far, whose bucket may go on, and the least node of that bucket
    alone = first = True  # whether that row is the only one of its bucket

    def out(b: np.ndarray, v: np.ndarray, low: np.ndarray, edge: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(b), pa.array(v), pa.array(low), pa.array(np.full(b.size, edge))], names=names)

    for batch in batches:
        b, v = (c.to_numpy() for c in batch.columns)
        if not b.size:
            continue
        if first:
            yield out(b[:1], v[:1], v[:1], True)
            first = False
        b, v = np.concatenate([bucket, b]), np.concatenate([node, v])
        fresh = np.concatenate([[True], (b[1:] != b[:-1]) | (v[1:] != v[:-1])])
        carried = bucket.size > 0
        b, v = b[fresh], v[fresh]
        starts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        sizes = np.diff(np.append(starts, b.size))
        least = np.repeat(v[starts], sizes)
        if carried:
            least[: sizes[0]] = lo[0]
        shown = np.repeat(sizes > 1, sizes)
        if carried and not alone:
            shown[0] = False  # it was given out with the batch before
        if sizes[-1] == 1 and not (carried and starts.size == 1 and not alone):
            alone = True
        else:
            alone = False
        yield out(b[shown], v[shown], least[shown], False)
        bucket, node, lo = b[-1:], v[-1:], least[-1:]
    if not first:
        yield out(bucket, lo, lo, True)


def shared_buckets(keys: DataFrame) -> DataFrame:
    """``(bucket, node, lo)``: the rows of buckets that hold more than one node, with the centre that each is compared with first."""
    spread = keys.repartitionByRange(partitions(keys.sparkSession), "bucket", "node").sortWithinPartitions("bucket", "node")
    found = cut(spread.mapInArrow(met_in_range, "bucket long, node long, lo long, edge boolean"), "buckets")
    edges = found.where("edge").select("bucket", "node")  # two rows a range
    ends = edges.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("bucket", "lo")
    shared = cut(found.where("not edge").select("bucket", "node", "lo").unionByName(edges.join(ends, "bucket").distinct()), "shared")
    drop(found)
    return shared


def texts_of(facts: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(node, z)``: one compressed text for each node of ``facts``."""
    texts = packed(row_key(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))))
    holders = facts.select("node", F.col("doc_id").alias("_id"), F.col("_tag").alias("_tag2"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_tag") == F.col("_tag2"))
    return texts.join(holders.hint("merge"), same).select("node", "z").dropDuplicates(["node"])  # neither side has a bound


def verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of nodes whose sets are similar enough."""
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("z").alias("z_b")), "b")
    both = both.join(texts.select(F.col("node").alias("a"), F.col("z").alias("z_a")), "a")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, kept = WordHashes(), OrderedDict()

        def of(name: int, value: pa.Scalar) -> np.ndarray:
            if name not in kept:
                if len(kept) >= 64:
                    kept.popitem(last=False)
                kept[name] = shingle_set(unpacked(value.as_py()), n, cache)
            return kept[name]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = []
            for k, (x, y) in enumerate(zip(a, b, strict=True)):
                s, t = of(x, batch.column(2)[k]), of(y, batch.column(3)[k])
                both = np.intersect1d(s, t, assume_unique=True).size
                if 100 * both >= percent * (s.size + t.size - both):
                    good.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in good], pa.int64()), pa.array([b[k] for k in good], pa.int64())], schema=out)

    return cut(both.select("a", "b", "z_a", "z_b").mapInArrow(run, "a long, b long"), "links")


def ordered(a, b) -> list:  # noqa: ANN001
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def may_link(a: str, b: str, percent: int) -> Column:
    """Whether the Hamming distance of two sketches leaves room for a link: it is at most the symmetric difference, which is
    (size + size) (1 - t) / (1 + t) at most."""
    flips = sum((F.bit_count(F.get(f"{a}.sketch", F.lit(k)).bitwiseXOR(F.get(f"{b}.sketch", F.lit(k)))) for k in range(1, SKETCH_WORDS)),
                F.bit_count(F.get(f"{a}.sketch", F.lit(0)).bitwiseXOR(F.get(f"{b}.sketch", F.lit(0)))))  # spelled out: compiled, unlike a fold
    return flips * (100 + percent) <= (F.col(f"{a}.n_shingles") + F.col(f"{b}.n_shingles")) * (100 - percent)


def link_components(shared: DataFrame, facts: DataFrame, percent: int, check) -> DataFrame:  # noqa: ANN001
    """``(node, root)`` of the linked nodes in shared buckets; ``check`` verifies pairs ``(a, b)``.

    A round compares each node with one other: the centre that it shares the most buckets with.  Rounds go on while they find links and buckets with many nodes in different
    components are left; then all pairs of a bucket that are still in different components and that the sketches don't rule out are verified.
    """
    facts_of = lambda name: facts.select(F.col("node").alias(name), F.struct("n_shingles", "sketch").alias(f"f_{name}"))

    def sifted(pairs: DataFrame) -> DataFrame:
        both = pairs.distinct().join(facts_of("a"), "a").join(facts_of("b"), "b")
        return cut(both.where(may_link("f_a", "f_b", percent)).select("a", "b"), "pairs")

    def one_each(pairs: DataFrame) -> DataFrame:
        """For each node the one of its partners that it shares the most buckets with."""
        counts = pairs.groupBy("node", "other").agg(F.count(F.lit(1)).alias("n"))
        return counts.groupBy("node").agg(F.max(F.struct("n", "other")).alias("m")).select(*ordered("node", F.col("m.other")))

    tried = sifted(one_each(shared.where("node <> lo").select("node", F.col("lo").alias("other"))))
    links = check(tried)
    n_links = links.count()
    near = shared.select("bucket", "node")
    for round_no in range(1, ROUNDS + 1):
        roots = cut(components(links), "roots")
        placed = cut(near.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
        sizes = placed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"), F.max("node").alias("any"))
        main = sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("roots"), F.sum("n").alias("all"), F.max(F.struct("n", "root", "any")).alias("m"))
        main = main.where("roots > 1").select("bucket", "all", F.col("m.n").alias("n"), F.col("m.root").alias("main"), F.col("m.any").alias("centre"))
        main = cut(main, "main")
        left = main.agg(F.sum(F.col("all") * (F.col("all") - F.col("n"))).alias("pairs"), F.sum("all").alias("rows")).first()
        if not left["rows"]:
            drop(placed, main)
            return roots
        if round_no == ROUNDS or left["pairs"] <= 8 * left["rows"] or not n_links:
            break
        rest = placed.join(main, "bucket").where("root <> main").select("node", F.col("centre").alias("other"))
        new = sifted(one_each(rest).join(tried, ["a", "b"], "left_anti"))
        tried = tried.unionByName(new)
        found = check(new)
        n_links = found.count()
        links = links.unionByName(found)
        near = cut(placed.join(main.select("bucket"), "bucket", "left_semi").select("bucket", "node"), "near")  # the others are settled
        drop(placed, main, roots)
    open_rows = cut(placed.join(main.select("bucket", "main"), "bucket").join(facts_of("node"), "node"), "open")
    drop(placed, main)
    rest = open_rows.where("root <> main")
    other = open_rows.select("bucket", F.col("node").alias("node2"), F.col("root").alias("root2"), F.col("f_node").alias("f_node2"))
    apart = (F.col("root") != F.col("root2")) & ((F.col("root2") == F.col("main")) | (F.col("node") < F.col("node2")))
    new = rest.join(other, (rest["bucket"] == other["bucket"]) & apart & may_link("f_node", "f_node2", percent)).select(*ordered("node", "node2"))
    new = cut(new.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
    drop(open_rows)
    found = check(new)
    return components(links.unionByName(found)) if not found.isEmpty() else roots


def jaccard_components(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, _tag, n_shingles, component_id)`` for every row; ``_tag`` tells apart texts with one id."""
    wide = cut(sketched(docs, n, percent, id_col, text_col), "sketched")
    shared = shared_buckets(wide.where("keys is not null").select(F.explode("keys").alias("bucket"), "node"))
    met = shared.select("node").distinct()
    holder = F.struct(F.coalesce("doc_id", F.lit(-1)).alias("i"), "_tag", "doc_id")
    facts = wide.join(met, "node", "left_semi").groupBy("node").agg(F.min(holder).alias("r"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    facts = cut(facts.select("node", "n_shingles", "sketch", "r.doc_id", "r._tag"), "facts")
    rows = cut(wide.select("doc_id", "_tag", "n_shingles", "node"), "nodes")
    drop(wide)
    texts = cut(texts_of(facts, docs, id_col, text_col), "texts")
    roots = cut(link_components(shared, facts, percent, lambda pairs: verified(pairs, texts, n, percent)), "components")
    drop(shared, facts, texts)
    by_node = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("size"))
    by_node = by_node.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    by_root = by_node.groupBy("root").agg(F.min("first").alias("component_id"))
    by_node = cut(by_node.join(by_root, "root").select("node", "size", "component_id"), "by_node")
    joined = hot_join(rows.where("node is not null"), by_node, "node", "size", "inner").select("doc_id", "_tag", "n_shingles", "component_id")
    return joined.unionByName(rows.where("node is null").select("doc_id", "_tag", "n_shingles", F.col("doc_id").alias("component_id")))
