"""The corpus pipeline: stages over ``documents``, each one of the corpus operators, each reading what the one before kept.

Language ID drops documents without an accepted language; line dedup takes repeated and nearly repeated lines out (a document that loses its
whole text goes); the n-gram Jaccard join keeps the first document of each group of near duplicates; mixing cuts a source that is larger than
its target weight and puts the rows in the order of the schedule; the last stage encodes the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm import jaccard, language, lines, mixing, sentencepiece_lattice
from spindle.llm.common import boxed, cut, order_id, partitions, row_key, table, without_rows


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted."""
    found = language.identify_documents(row_key(docs), ["doc_id", "_tag"])
    return without_rows(docs, cut(found.where(~F.col("accepted")).select("doc_id", "_tag"), "rejected"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; ``n_chars`` follows the text."""
    before, gone = (name + "_" * (1 + max(map(len, docs.columns))) for name in ("lines", "gone"))  # names that no column has
    out = lines.dedup_lines(docs, counts=(before, gone)).where((F.col(gone) == 0) | (F.trim(F.coalesce("text", F.lit(""))) != ""))
    return out.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group (five words a shingle, similarity of 0.8 or more)."""
    found = jaccard.jaccard_components(docs)
    return without_rows(docs, cut(found.where("not (doc_id <=> component_id)").select("doc_id", "_tag"), "duplicates"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture with capped source weights, in the order of their slots."""
    chosen = mixing.mix(row_key(docs), extra=["_tag"]).where("in_mix")
    chosen = cut(chosen.select(order_id().alias("_o2"), F.col("_tag").alias("_t2"), "slot").dropDuplicates(["_o2", "_t2"]), "mixture")
    rows = boxed(docs).drop("text").join(chosen.hint("merge"), (F.col("_o") == F.col("_o2")) & (F.col("_tag") == F.col("_t2")))  # neither side has a bound
    return rows.repartitionByRange(partitions(spark), "slot", "_o").sortWithinPartitions("slot", "_o").select("_row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id`` and the piece ids of each text, with their number."""
    return sentencepiece_lattice.encode(docs).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode),
]

#: The language, near-duplicate and encoding stages are not expressible in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
