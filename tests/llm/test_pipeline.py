"""The pipeline's stages, each against brute force on its own input, and on odd rows."""

import pytest
import sentencepiece

import corpus_pipeline
from spindle.llm import sentencepiece_lattice
from tests.llm.test_operators import brute_components, brute_lines

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _tag string, _o int"


def test_stages_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 120").cache()
    steps = dict(corpus_pipeline.STAGES)
    kept = steps["language_id"](spark, docs, sf).cache()
    assert kept.columns == docs.columns and kept.count() == docs.count()

    cleaned = steps["line_dedup"](spark, kept, sf).cache()
    want = brute_lines([(r["doc_id"], r["text"]) for r in kept.collect()])
    got = {r["doc_id"]: r["text"] for r in cleaned.collect()}
    assert got == {i: t for i, t in want.items() if i in got} and all(not want[i].strip() for i in want if i not in got)
    assert all(r["n_chars"] == len(r["text"]) for r in cleaned.collect())

    single = steps["near_duplicates"](spark, cleaned, sf).cache()
    roots = brute_components([(r["doc_id"], r["text"]) for r in cleaned.collect()], 5, 80)
    assert {r["doc_id"] for r in single.collect()} == {i for i, (_, root) in roots.items() if root == i}

    mixed = steps["mix_sources"](spark, single, sf).cache()
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in single.collect()}

    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_lattice.MODEL)
    ids = {r["doc_id"]: list(r["ids"]) for r in steps["sentencepiece"](spark, mixed, sf).collect()}
    assert ids == {r["doc_id"]: model.encode(r["text"]) for r in mixed.collect()}


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_rows(spark, sf, empty):
    rows = [(1, "le la les et de", "fr", "s", 3, "x", 1), (2, None, None, None, None, None, None), (None, "le la des", "fr", None, 1, "y", 2), (4, "", "en", "t", 0, "z", 3), (5, "the of and", "en", "t", 9, "q", 4),
            (5, "the of and", "en", "t", 9, "q", 4)]
    docs = spark.createDataFrame([] if empty else rows, COLUMNS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    kept = docs.collect()
    assert {r["doc_id"] for r in kept} == (set() if empty else {1, None, 5}) and all(r["_tag"] in ("x", "y", "q") for r in kept)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == len(kept)
