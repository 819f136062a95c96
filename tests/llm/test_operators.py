"""The corpus operators against brute force on small frames: nulls, ties, empty and long texts, repeated rows, extra columns, empty tables."""

import hashlib
import os
import random
import time
import zlib
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spindle.llm import common, components, exact_dedup, fm_index, html_extract, jaccard, language, lines, matroska, mixing, sentencepiece_lattice, substring_dedup, toxicity
from spindle.llm.shingles import WordHashes, shingle_set

SCHEMA = "doc_id long, text string, _tag string, node string, extra int"
ODD = [(None, "a b c d", "x", "n", 1), (7, None, None, None, None), (8, "", "", "", 0), (9, "  \n\t ", "x", "n", 1), (10, "same words here", "x", "n", 1), (10, "same words here", "x", "n", 1), (11, "Ä " * 3000, "x", "n", 1)]


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def corpus(seed, n=120, vocabulary="abcdef"):
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.5:
            w = rng.choice(texts).split(" ")
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary) * rng.randint(1, 2)
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(rng.choice(vocabulary) * rng.randint(1, 3) for _ in range(rng.randint(1, 60))))
    return list(enumerate(texts))


# exact dedup ------------------------------------------------------------------------------------------------------


def test_digest_index_over_batches(spark):
    rows = [(1, "a  b"), (2, "a b"), (3, None), (4, ""), (5, "c"), (5, "c"), (None, "c")]
    index = exact_dedup.DigestIndex(spark)
    out = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in index.ingest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {(1, 1, 2, True), (2, 1, 2, False), (3, 3, 2, True), (4, 3, 2, False), (5, 5, 3, True), (None, 5, 3, False)}
    later = index.ingest(spark.createDataFrame([(0, "a\nb"), (9, "new")], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in later} == {(0, 1, False), (9, 9, True)} and index.rows().count() == 4
    kept = exact_dedup.DigestIndex(spark)
    assert exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), kept).count() == len(rows)
    again = exact_dedup.exact_dedup(spark.createDataFrame([(0, "c"), (7, "c "), (8, None)], "doc_id long, text string"), kept)
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in again.collect()} == {(0, 5, 1, False), (7, 7, 1, True), (8, 3, 1, False)}
    late = spark.createDataFrame([(k, f"t{k % 7}") for k in range(40)], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(late).collect()}
    assert got == {k: (k % 7, 6 if k % 7 < 5 else 5) for k in range(40)}
    assert exact_dedup.exact_dedup(odd(spark)).count() == len(ODD) and exact_dedup.exact_dedup(odd(spark).limit(0)).count() == 0


# substring dedup --------------------------------------------------------------------------------------------------


def brute_substrings(rows, width=substring_dedup.WINDOW):
    seen, gone = set(), {}
    for i, t in sorted(rows):
        w = t.encode().split()
        gone[i] = set()
        for s in range(len(w) - width + 1):
            key = tuple(w[s : s + width])
            if key in seen:
                gone[i] |= set(range(s, s + width))
            seen.add(key)
    return {i: b" ".join(x for k, x in enumerate(t.encode().split()) if k not in gone[i]).decode() for i, t in rows}


@pytest.mark.parametrize("hot", [5_000, 1])
def test_substrings_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT_CONTENTS", hot)
    monkeypatch.setattr(substring_dedup, "SHARD_TOKENS", 500)
    rows = [(i, t + " " + t[: len(t) // 2]) for i, t in corpus(1, 150, "ab")]
    got = {r["doc_id"]: r["kept"] for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_substrings(rows)


def test_substrings_of_odd_rows(spark):
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.dedup_substrings(odd(spark)).collect()), key=str)
    assert got == sorted([(None, 4, 0), (7, 0, 0), (8, 0, 0), (9, 0, 0), (10, 3, 0), (10, 3, 0), (11, 3000, 2999)], key=str)
    assert substring_dedup.dedup_substrings(odd(spark).limit(0)).count() == 0


def test_dropping_frees_the_last_step(spark):
    """Shuffle files of a finished step go with ``drop``, not only when the next step has ended."""

    def files():
        return {f for top, _, names in os.walk(spark.conf.get("spark.local.dir")) for f in names if f.startswith("shuffle_") and f.endswith(".data")}

    before = files()
    step = spark.range(2000).groupBy((F.col("id") % 100).alias("x")).agg(F.max("id").alias("m")).mapInArrow(lambda batches: batches, "x long, m long")
    done = common.cut(step, "step")
    made = files() - before
    assert made
    common.drop(done)
    for _ in range(50):
        if not made & files():
            break
        time.sleep(0.1)
    assert not made & files()


def test_later_steps_hold_no_lattice(spark, monkeypatch):
    pieces = sentencepiece_lattice.Pieces.load()
    assert pieces.allowed(pieces.id["▁the"], pieces.id["▁of"]) and pieces.spines and pieces.beside
    assert pieces.forget() is pieces and not pieces.spines and not pieces.beside
    seen = []
    monkeypatch.setattr(sentencepiece_lattice, "viterbi", lambda grid, pieces: seen.append(grid.rdd.getNumPartitions()) or grid.select("word", "n", F.lit(None).cast("array<int>").alias("path")))
    docs = spark.createDataFrame([("one two",)], "text string")
    sentencepiece_lattice.word_paths(docs, pieces)
    assert seen == [sentencepiece_lattice.LATTICE_PARTS * common.partitions(spark)]


def test_substrings_move_texts_and_anchors_once(spark):
    """Contents go to their shard by one exchange; what marks a repeated anchor is its place only."""
    rows = substring_dedup.keyed(spark.createDataFrame([(k, f"{k} " + " ".join(f"w{j}" for j in range(40))) for k in range(6)], "doc_id long, text string"), "doc_id", "text")
    marked = substring_dedup.repeated_anchors(rows)
    assert marked.schema["found"].dataType.elementType.names == ["a", "n"]
    found = substring_dedup.fragments(rows, marked).toPandas()
    text = " ".join(["0", *(f"w{j}" for j in range(40))]).encode().split()
    h = substring_dedup.hashed(text, substring_dedup.WordHashes())
    anchor, start, _ = substring_dedup.fragments_of(h)
    own = found[found["_o"] == 0].sort_values("a")
    want = dict(zip(start.tolist(), anchor.tolist(), strict=True))
    assert len(own) and all(want[a] == k for a, k in zip(own["a"], own["shard_key"], strict=True))


def test_backward_search_counts_occurrences():
    rng = np.random.default_rng(5)
    tokens = rng.integers(0, 4, 500)
    index = fm_index.FMIndex(tokens, 6)
    patterns = rng.integers(1, 4, (200, 5))
    statistic, lo, hi = index.matches(patterns, least=1)
    for p, m, a, b in zip(patterns, statistic, lo, hi, strict=True):
        counts = [sum(np.array_equal(tokens[k : k + j], p[5 - j :]) for k in range(500 - j + 1)) for j in range(6)]
        assert m == max(j for j in range(6) if counts[j] >= 1)
        if m == 5:
            assert b - a == counts[5] and all(np.array_equal(tokens[k : k + 5], p) for k in index.order[a:b])


# language ---------------------------------------------------------------------------------------------------------


def test_language_held_out_and_evidence(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, table = language.fit(docs.where("doc_id % 2 = 0"))
    held = docs.where("doc_id % 2 = 1")
    found = language.identify(held, names, table, ["doc_id"]).join(held.select("doc_id", F.col("lang").alias("truth")), "doc_id").collect()
    assert sum(r["lang"] == r["truth"] for r in found) >= 0.95 * len(found)
    few = spark.createDataFrame([(1, "la", "fr", "h"), (2, "x", "de", None), (3, "12 %", "de", "h"), (4, None, None, None)], "doc_id long, text string, d string, h string")
    got = {r["doc_id"]: r for r in language.identify(few, names, table, ["doc_id"], "d", "h", "h").collect()}
    assert got[1]["lang"] == "fr" and got[2]["lang"] == "de" and got[3]["lang"] == "und" and not got[3]["accepted"] and not got[4]["accepted"]
    assert language.identify_documents(spark.createDataFrame([], "doc_id long, text string, lang string, source string"), ["doc_id"]).count() == 0
    pages = spark.createDataFrame([(1, "https://u@www.x.de:80/a", "<html lang='DE-at'><p>hallo</p><script>var</script>"), (2, None, None)], "page_id long, url string, html string")
    one, two = language.page_evidence(pages).orderBy("page_id").collect()
    assert (one["declared"], one["host"], one["suffix"], one["text"].split()) == ("de", "www.x.de", "de", ["hallo"]) and two["declared"] is None and two["host"] is None


def test_more_labels_than_languages(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(("the", "of", "and")) for _ in range(20)), "en", "a1") for k in range(30)]
    rows += [(k, " ".join(rng.choice(("le", "les", "des")) for _ in range(20)), "fr", "b1") for k in range(30, 60)]
    rows += [(k, "les des le " * 5, f"x{k}", "b1") for k in range(60, 358)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    languages, table = language.fit(docs)
    assert len(languages) == language.MAX_LANGUAGES == table.shape[1] and {"en", "fr"} <= set(languages)
    found = {r["doc_id"]: r for r in language.identify_documents(docs, ["doc_id"]).collect()}
    assert len(found) == len(rows) and all(found[k]["text_lang"] == "en" == found[k]["lang"] for k in range(30))



# SentencePiece ----------------------------------------------------------------------------------------------------


def test_encoding_equals_the_library_and_decodes_exactly(spark, monkeypatch):
    import sentencepiece

    monkeypatch.setattr(sentencepiece_lattice, "HEAD_WORDS", 20)
    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_lattice.MODEL)
    rng = random.Random(2)
    texts = ["".join(rng.choice("aeiou thnrs.,\n  12éü日本Ａthe") for _ in range(rng.randint(0, 60))) for _ in range(150)] + ["a" * 700, "日本" * 300, " ", "\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (list(r["ids"]), r["text"]) for r in sentencepiece_lattice.decode(sentencepiece_lattice.encode(df)).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (model.encode(t), t)
    back = sentencepiece_lattice.decode(sentencepiece_lattice.encode(odd(spark))).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in back) == sorted((str(r[0]), str(r[1])) for r in ODD)
    tricky = spark.createDataFrame([(1, "▁a ▁ b")], "doc_id long, text string")
    assert sentencepiece_lattice.decode(sentencepiece_lattice.encode(tricky)).first()["text"] == "▁a ▁ b"


@pytest.mark.parametrize("head", [0, 1000])
def test_private_use_characters_and_own_marks_come_back(spark, monkeypatch, head):
    import sentencepiece

    monkeypatch.setattr(sentencepiece_lattice, "HEAD_WORDS", head)
    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_lattice.MODEL)
    rng = random.Random(5)
    texts = ["\ue000", "a\ue000b \uf8ff", "\ue000\uf8ff the", " \ue000 "] + ["".join(rng.choice("ab  \ue000\uf8ff\n") for _ in range(30)) for _ in range(30)]
    marked = ["▁", " ▁", "▁ ", "▁\ue000 ▁\uf8ff▁"] + ["".join(rng.choice("ab  ▁\ue000\uf8ff\n") for _ in range(30)) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts + marked)), "doc_id long, text string")
    got = {r["doc_id"]: (list(r["ids"]), r["text"]) for r in sentencepiece_lattice.decode(sentencepiece_lattice.encode(df)).collect()}
    assert [got[k][1] for k in range(len(got))] == texts + marked
    assert [got[k][0] for k in range(len(texts))] == [model.encode(t) for t in texts]


def test_cutting_by_chunks_equals_cutting_the_text():
    pieces, rng = sentencepiece_lattice.Pieces.load(), random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice("ab the\n\t,.1é²\u2581  ") for _ in range(rng.randrange(1, 30)))
        chunks = sentencepiece_lattice.chunks_of(text)
        if chunks is not None:
            assert [w for chunk in chunks for w in pieces.words(chunk)] == pieces.words(text)
        else:
            assert "  " in " " + text + " " or "\u2581" in text


def test_pruned_lattices_hold_the_one_path_of_merging():
    pieces, rng = sentencepiece_lattice.Pieces.load(), random.Random(6)
    words = ["\u2581" + "".join(rng.choice("theandiosr") for _ in range(rng.randrange(1, 14))) for _ in range(200)]
    rows = [sorted((e, s, pieces.id.get(w[s:e], -1)) for s in range(len(w)) for e in range(s + 1, len(w) + 1) if w[s:e] in pieces.id or e == s + 1) for w in words]
    rows = [[r for r in row if pieces.reachable(r[2])] for row in rows]
    ends, starts, found = (np.array([r[k] for row in rows for r in row]) for k in range(3))
    first = np.concatenate([[0], np.cumsum([len(row) for row in rows])])
    places, begin, before, each = pieces.alive(first, starts, ends, found)
    for k, word in enumerate(words):
        assert found[places[begin[k] : begin[k + 1]]].tolist() == sentencepiece_lattice.best_path(word, pieces)
        assert before[each[begin[k]] : each[begin[k + 1]]].tolist() == list(range(-1, begin[k + 1] - begin[k] - 1))


def test_verdicts_of_a_small_table_are_right(monkeypatch):
    monkeypatch.setattr(sentencepiece_lattice, "VERDICTS", 8)
    pieces, rng = sentencepiece_lattice.Pieces.load(), np.random.default_rng(7)
    some = np.append(rng.choice(sorted(pieces.text), 30), -1)
    for _ in range(20):
        a, b = rng.choice(some, (2, 200))
        assert pieces.verdicts(a, b).tolist() == [pieces.allowed(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert len(pieces.table[0]) == 8 and pieces.forget().table is None


def test_long_words_stay_out_of_the_dictionary(spark, monkeypatch):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_lattice.MODEL)
    texts = ["a" * 9000 + " the", "the " + "e" * 6000, "a" * 9000, "n" * 100 + " of", "in " + "n" * 100]
    docs, found = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), []
    collected = type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda self: found.append(collected(self)) or found[-1])
    got = {r["doc_id"]: list(r["ids"]) for r in sentencepiece_lattice.encode(docs).collect()}
    assert got == {k: model.encode(t) for k, t in enumerate(texts)}
    words = [w for t in found for w in t.column("word").to_pylist()]
    assert "▁the" in words and "▁" + "n" * 100 in words and max(map(len, words)) <= 4096


# media ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("lace", ["none", "xiph", "fixed", "ebml"])
@pytest.mark.parametrize("size", [0, 1, 576, 577, 300_000])
def test_container_round_trip(lace, size):
    payload = matroska.pad(random.Random(size).randbytes(size))
    blob = matroska.mux(payload, lace)
    box = matroska.Container(blob)
    assert box.payload() == payload and len(box.packets) == len(payload) // 576 and len(box.cues) == box.clusters
    assert [p[1] for p in box.packets] == [k * 72_000_000 for k in range(len(box.packets))]
    assert all(blob[at : at + 4] == matroska.id_bytes(matroska.CLUSTER) for _, _, at in box.cues)
    for stop in range(0, len(blob), max(1, len(blob) // 40)):
        matroska.Container(blob[:stop])


def test_uneven_laces_and_unknown_sizes():
    frames = [b"x" * n for n in (0, 255, 600, 3, 70_000, 1)]
    for mode in (matroska.XIPH_LACE, matroska.EBML_LACE):
        head = matroska.lace_header(frames, mode)
        sizes, at = matroska.frame_sizes(head + b"".join(frames), 0, len(head) + sum(map(len, frames)), mode)
        assert sizes == [len(f) for f in frames] and at == len(head)
    cluster = matroska.id_bytes(matroska.CLUSTER) + b"\x01" + b"\xff" * 7 + matroska.uint(matroska.TIMESTAMP, 5) + matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, b"\x81\0\2\0", b"hi"))
    blob = matroska.element(matroska.EBML) + matroska.id_bytes(matroska.SEGMENT) + b"\x01" + b"\xff" * 7 + cluster + cluster
    box = matroska.Container(blob)
    assert box.clusters == 2 and box.payload() == b"hihi" and {p[1] for p in box.packets} == {7_000_000}


def test_media_columns(spark):
    media = matroska.encode(odd(spark)).cache()
    rows = {str(r["doc_id"]): r for r in matroska.read_back(media).collect()}
    for i, t, *_ in ODD:
        payload = matroska.pad((t or "").encode())
        r = rows[str(i)]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert matroska.packets(media).where("doc_id = 11").agg(F.sum("byte_length")).first()[0] == rows["11"]["payload_bytes"]
    assert matroska.cues(media).count() == len(ODD) and matroska.read_back(matroska.encode(odd(spark).limit(0))).count() == 0


# Jaccard ----------------------------------------------------------------------------------------------------------


def brute_components(rows, n, percent):
    cache = WordHashes()
    sets = {i: set(shingle_set(t, n, cache).tolist()) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (2, 70)])
def test_components_match_brute_force(spark, n, percent):
    rows = corpus(n, 140)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df, n, percent).collect()}
    assert got == brute_components(rows, n, percent)


@pytest.mark.parametrize("rows_in_batch", [1, 3, 50])
def test_buckets_over_batches_and_ranges(rows_in_batch):
    rng = random.Random(rows_in_batch)
    rows = sorted((rng.randint(0, 12), rng.randint(0, 9)) for _ in range(60))
    cuts = [0, *sorted(rng.sample(range(60), 4)), 60]
    found, edges = set(), {}
    for a, b in zip(cuts, cuts[1:], strict=False):
        parts = [rows[k : min(b, k + rows_in_batch)] for k in range(a, b, rows_in_batch)]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], pa.int64()) for i in (0, 1)], names=["bucket", "node"]) for part in parts]
        here = [r for out in jaccard.met_in_range(iter(batches)) for r in out.to_pylist()]
        held = {}
        for x, v in rows[a:b]:
            held.setdefault(x, set()).add(v)
        assert sorted((r["bucket"], r["node"], r["lo"]) for r in here if not r["edge"]) == sorted((x, v, min(vs)) for x, vs in held.items() if len(vs) > 1 for v in vs)
        if held:
            assert {(r["bucket"], r["lo"]) for r in here if r["edge"]} == {(x, min(held[x])) for x in (min(held), max(held))}


@pytest.mark.parametrize("seeds", [1, 2, 64])
def test_linked_sets_share_a_bucket(monkeypatch, seeds):
    monkeypatch.setattr(jaccard, "SEEDS", seeds)
    rng = np.random.default_rng(seeds)
    for size in [*range(2, 40), 100, 300, 900]:
        for _ in range(20):
            s = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            t = np.unique(np.concatenate([s[rng.random(s.size) > 0.1], rng.integers(0, 1 << 63, rng.integers(0, max(1, size // 8) + 1)).astype(np.uint64)]))
            same = np.intersect1d(s, t).size
            if 100 * same >= 80 * (s.size + t.size - same) and jaccard.node_of(s) != jaccard.node_of(t):
                assert np.intersect1d(jaccard.sketch_keys(s, 80), jaccard.sketch_keys(t, 80)).size
    sets = [np.unique(rng.integers(0, 1 << 63, 500).astype(np.uint64)) for _ in range(60)]
    keys = np.concatenate([jaccard.sketch_keys(s, 80) for s in sets])
    assert np.unique(keys).size == keys.size or seeds == 1  # unrelated sets don't meet by chance


def test_jaccard_of_odd_rows(spark):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(odd(spark), 3, 90).collect()), key=str)
    assert got == sorted([(None, 2, None), (7, 0, 7), (8, 0, 8), (9, 0, 9), (10, 1, 10), (10, 1, 10), (11, 1, 11)], key=str)
    assert jaccard.jaccard_components(odd(spark).limit(0)).count() == 0


def test_large_star_small_star(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (5, 5)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


# mixing -----------------------------------------------------------------------------------------------------------


def test_schedule_stays_within_a_block():
    for seed in range(60):
        rng = random.Random(seed)
        shares = mixing.capped_shares({f"s{k}": rng.randint(1, 5000) for k in range(rng.randint(1, 9))}, period=400)
        layout, got = mixing.slot_table(shares), dict.fromkeys(shares, 0)
        for s, turn, slot in layout:
            assert turn == got[s]
            got[s] += 1
            assert all(abs(got[x] - shares[x] * (slot + 1) / len(layout)) < 1 for x in shares)
        assert got == shares


def test_mix_keeps_every_row_and_its_weights(spark):
    rows = [(k, "big" if k % 3 else ("b", "c", "d", "e", None)[k % 5]) for k in range(3000)] + [(None, "b"), (5, "b"), (5, "b")]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string")).collect()
    assert len(out) == len(rows)
    mixed = [r for r in out if r["in_mix"]]
    assert abs(sum(r["source"] == "big" for r in mixed) / len(mixed) - 0.2) < 0.01 and sum(r["source"] != "big" for r in mixed) > 0.98 * sum(r[1] != "big" for r in rows)
    sizes = {}
    for r in mixed:
        sizes.setdefault((r["source"], r["slot"]), []).append(r)
    slots = [s for _, s in sizes]
    assert len(slots) == len(set(slots)) and all(len(v) <= mixing.BLOCK_DOCS for v in sizes.values())
    given = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), shares={"big": 1, "b": 1, "zzz": 5})
    assert {r["source"] for r in given.where("in_mix").collect()} == {"big", "b"}
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string")).count() == 0


def brute_mixed(sizes):
    """Rows of each source: as many as there are, and of the large ones the most that leave none above the cap."""
    cap = max(mixing.CAP, Fraction(1, len(sizes)))
    most = max(m for m in range(1, max(sizes) + 1) if m <= cap * sum(min(n, m) for n in sizes) or m <= min(sizes))
    return [min(n, most) for n in sizes]


@pytest.mark.parametrize("sizes", [[50, 30, 20], [1 + k % 12 for k in range(5000)], [1 + k % 12 for k in range(4999)] + [9000], [1 + k % 3 for k in range(20000)]])
def test_mix_stage_matches_brute_force(spark, sizes):
    rows = [(k, s) for k, s in enumerate(f"s{s}" for s, n in enumerate(sizes) for _ in range(n))]
    docs = spark.createDataFrame(pd.DataFrame(rows, columns=["doc_id", "source"])).withColumn("text", F.lit("x"))
    kept = corpus_pipeline.mix_sources(spark, docs, "").toPandas()
    starts, want = np.concatenate([[0], np.cumsum(sizes)]), set()
    for s, n in enumerate(brute_mixed(sizes)):
        want |= set(range(starts[s], starts[s] + n))
    assert len(kept) == len(want) and set(kept["doc_id"]) == want

    out = mixing.mix(docs).where("in_mix").select("source", "slot", "share").distinct().orderBy("slot").toPandas()
    assert out["slot"].tolist() == list(range(len(out)))
    turn = out.groupby("source").cumcount()
    low, high = turn * len(out) // out["share"], -(-(turn + 1) * len(out) // out["share"])
    assert ((low <= out["slot"]) & (out["slot"] < high)).all()


def test_mix_in_larger_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS", 20)
    docs = spark.createDataFrame([(k, f"s{k % 7}") for k in range(700)], "doc_id long, source string")
    out = mixing.mix(docs).toPandas()
    assert out["in_mix"].all() and out["slot"].max() == out["slot"].nunique() - 1 <= 20 + 7


# lines ------------------------------------------------------------------------------------------------------------


def brute_lines(rows, min_words=lines.MIN_WORDS):
    first, places = {}, []
    for i, t in sorted(rows):
        for k, x in enumerate(t.split("\n")):
            w = tuple(x.encode().split())
            if w:
                first.setdefault(w, (i, k))
    late = {u for u in first for v in first if first[v] < first[u] and min(len(u), len(v)) >= min_words and lines.one_edit(list(v), list(u))}
    for i, t in rows:
        kept = [x for k, x in enumerate(t.split("\n")) if not x.split() or (tuple(x.encode().split()) not in late and first[tuple(x.encode().split())] == (i, k))]
        places.append((i, "\n".join(kept)))
    return dict(places)


def test_lines_match_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, "\n".join(" ".join(rng.choice("abc") if rng.random() < 0.15 else "a" for _ in range(rng.randint(8, 13))) for _ in range(3))) for i in range(120)]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_lines(rows)


@pytest.mark.parametrize("min_words", [1, 2, 4])
def test_lines_with_a_bound_on_short_ones(spark, min_words):
    rng = random.Random(min_words)
    rows = [(i, "\n".join(" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(3))) for i in range(150)]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_words=min_words).collect()}
    assert got == brute_lines(rows, min_words)


def test_a_template_line_with_many_numbers(spark):
    rows = [(i, f"page {i} of the very long list of all pages that follow here") for i in range(3000)] + [(i, "the same words in each of them, ten and more, without any change") for i in range(3000, 6000)]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: t for i, t in got.items() if t} == {0: rows[0][1], 3000: rows[3000][1]}


def test_lines_of_odd_rows(spark):
    out = lines.dedup_lines(odd(spark))
    assert out.columns == [*odd(spark).columns, "n_lines", "n_removed"]
    got = sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in out.collect()), key=str)
    assert got == sorted([(r[0], r[1], 0) for r in ODD], key=str) and lines.dedup_lines(odd(spark).limit(0)).count() == 0


def test_lines_beside_columns_of_the_same_names(spark, sf):
    docs = spark.createDataFrame([(1, "a b\na b", 9, 8, 7), (2, "c", 6, 5, 4)], "doc_id long, text string, n_lines int, n_removed int, n_chars long")
    assert [tuple(r) for r in lines.dedup_lines(docs).select("doc_id", "text", "n_lines", "n_removed").orderBy("doc_id").collect()] == [(1, "a b", 2, 1), (2, "c", 1, 0)]
    got = corpus_pipeline.line_dedup(spark, docs, sf)
    assert got.columns == docs.columns and [tuple(r) for r in got.orderBy("doc_id").collect()] == [(1, "a b", 9, 8, 3), (2, "c", 6, 5, 4)]


@pytest.mark.parametrize(("a", "b", "near"), [("a b c", "a b c", True), ("a b c", "a c", True), ("a b c", "a x c", True), ("a b c", "b c a", False), ("a", "b c", False), ("", "a", True)])
def test_one_edit(a, b, near):
    assert lines.one_edit(a.split(), b.split()) is near and lines.one_edit(b.split(), a.split()) is near


# toxicity ---------------------------------------------------------------------------------------------------------


def test_toxicity_learns_words_and_pairs(spark):
    rng = random.Random(4)
    rows, marks = [], []
    for k in range(1500):
        w = [rng.choice(["lorem", "ipsum", "dolor", "amet", "elit", "sed"]) for _ in range(12)]
        insult, group = rng.random() < 0.3, rng.random() < 0.3
        w += ["Dolt"] * insult + ["folk"] * group
        rng.shuffle(w)
        rows.append((k, " ".join(w)))
        marks.append((k, int(insult and group)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k in got)
    held = [k for k in got if got[k]["held_out"]]
    assert sum(got[k]["predicted"] == dict(marks)[k] for k in held) >= 0.97 * len(held)
    none = toxicity.score(odd(spark), toxicity.fit(odd(spark), labels.limit(0))).collect()
    assert len(none) == len(ODD) and all(r["score"] == 0 for r in none)
    assert toxicity.score(odd(spark).limit(0), None).count() == 0


# pages ------------------------------------------------------------------------------------------------------------

PAGE = """<html><body><header><a href=/>home</a></header><div class="cookie-notice"><p>We use cookies here, accept.</p></div><div class="sidebar"><ul><li><a>One</a><li><a>Two</a></ul></div>
<div class="{main}"><h2>Title</h2><p>First paragraph with quite some words,   and a <a href=q>link</a> inside it. It goes on.<p>Second&nbsp;paragraph &amp; more text, long enough to count as prose.</div>
<div class="comments"><p>Great article, I loved it, thanks for sharing.</p></div><form><label>Mail</label></form><footer>(c)</footer><script>"<p>no"</script></body></html>"""


def test_extraction_generalises_and_handles_odd_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    forest = html_extract.fit(pages)
    rows = [(1, "u", PAGE.format(main="content")), (2, None, PAGE.format(main="")), (3, "u", None), (None, "u", ""), (5, "u", "<p>a<p>b<!-- c"), (5, "u", "plain  &lt;text"), (6, "u", "<div><<p")]
    got = {(r["page_id"], r["n_chars"]): r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), forest).collect()}
    want = "Title\nFirst paragraph with quite some words, and a link inside it. It goes on.\nSecond paragraph & more text, long enough to count as prose."
    assert got[1, len(want)] == want and got[2, len(want)] == want and got[3, 0] == "" and got[None, 0] == "" and got[5, 11] == "plain <text"
    assert html_extract.fit(pages.limit(0)) is None and html_extract.extract(pages.limit(0), None).count() == 0


@pytest.mark.parametrize("html", ['<a "' * 250_000, "<b>x</i>" * 125_000, "<svg>" * 100_000, "<template>" * 100_000, "<div>" * 50_000 + "<li></li>" * 50_000, "x > " + "<!" * 300_000, "<i><div>" + "<b>x</i>" * 80_000])
def test_hostile_pages_take_linear_time(html):
    began = time.thread_time()
    html_extract.Page(html)
    assert time.thread_time() - began < 8


def test_text_of_embedded_elements_is_read():
    page = html_extract.Page("<p>a <svg><text>b</text></svg> <math><mi>c</mi></math> <noscript>d</noscript><select><option>x</select><script>y</script>")
    assert [t for t in page.text if t] == ["a b c d"]


def test_kept_nodes_have_kept_ancestors():
    page = html_extract.Page(PAGE.format(main="x"))
    rng = np.random.default_rng(1)
    for _ in range(50):
        keep = html_extract.decode(page, rng.normal(size=len(page.tag)))
        assert all(keep[page.parent[k]] for k in range(1, len(keep)) if keep[k])
