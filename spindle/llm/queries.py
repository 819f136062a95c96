"""The registered queries of the corpus operators: thin wrappers that put each one on its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm import html_extract, jaccard, language, lines, matroska, mixing, sentencepiece_lattice, substring_dedup, toxicity
from spindle.llm.common import table
from spindle.llm.exact_dedup import exact_dedup


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_documents(table(spark, sf_dir, "documents"), ["doc_id"])


def pages_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_pages(table(spark, sf_dir, "pages"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentencepiece_lattice.decode(sentencepiece_lattice.encode(table(spark, sf_dir, "documents")))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
                      F.sha2("text", 256).alias("decoded_sha256"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.read_back(matroska.encode(table(spark, sf_dir, "documents")))


def media_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.packets(matroska.encode(table(spark, sf_dir, "documents")))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.jaccard_components(table(spark, sf_dir, "documents"), n=3, percent=90)
    return out.select("doc_id", "n_shingles", "component_id")


def op6_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.fit(pages))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_language_id": op2_language_id,
        "pages_language_id": pages_language_id,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_media_columns": op4_media_columns,
        "media_packets": media_packets,
        "op5_ngram_jaccard": op5_ngram_jaccard,
        "op6_mixing_sources": op6_mixing_sources,
        "op7_line_dedup": op7_line_dedup,
        "op8_toxicity": op8_toxicity,
        "op9_html_extraction": op9_html_extraction,
        "op10_exact_dedup": op10_exact_dedup,
    }
