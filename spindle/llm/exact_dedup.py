"""Operator 10: exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest.  A batch is reduced to one row per digest, compared with
the index by a sort-merge anti-join (the index side needs no shuffle) and what is new is appended.

Defined cases: a null text counts as empty; white space runs count as one space; a null ``doc_id`` never becomes
``keep_id`` unless all ids of the group are null; rows repeated with the same id and text are all returned and
all ``kept``; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm.common import SPACE_CLASS, cut, empty_if_null, hot_join, partitions


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, digest)``: SHA-256 of the UTF-8 of each text with white space runs replaced by one space."""
    normal = F.regexp_replace(empty_if_null(F.col(text_col)), SPACE_CLASS, " ")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(normal, 256)).alias("digest"))


class DigestIndex:
    """Append-only index ``(digest, keep_id)``, one row per digest ever seen, bucketed and sorted by digest."""

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.buckets = buckets or partitions(spark)

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, rows: DataFrame) -> None:
        """Append the digests of ``rows`` that the index doesn't hold yet, each with its smallest id."""
        fresh = rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"))
        if self.exists():
            fresh = fresh.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        fresh = fresh.select("digest", "keep_id").repartition(self.buckets, "digest")
        fresh.write.mode("append").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)

    def look_up(self, rows: DataFrame) -> DataFrame:
        """``(doc_id, digest, keep_id, group_size, kept)``; ``group_size`` counts the text's rows among ``rows``."""
        sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
        held = cut(self.rows().hint("merge").join(sizes, "digest"), "held")
        return hot_join(rows, held, "digest", "group_size").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Add a batch and look its rows up: ``keep_id`` is a row of an earlier batch, or else the smallest id of this one."""
        rows = cut(digests(docs, id_col, text_col), "digests")
        self.add(rows)
        return self.look_up(rows)


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deduplicate one corpus against a new index, or a given one that outlives the call.

    The corpus comes in two batches, the smaller ids first (null ids last): what the second one brings is new only if the anti-join
    finds it in neither the first nor an older batch.
    """
    index = index or DigestIndex(docs.sparkSession)
    rows = cut(digests(docs, id_col, text_col), "digests")
    middle = rows.agg(F.percentile_approx("doc_id", 0.5).alias("m")).first()["m"]
    first = F.coalesce(F.col("doc_id") <= F.lit(middle).cast("long"), F.lit(False))
    index.add(rows.where(first))
    index.add(rows.where(~first))
    return index.look_up(rows)
