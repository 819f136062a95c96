"""Helpers shared by the corpus operators: table access, scratch tables and joins that survive hot keys."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words in every contract of this package (ASCII space and \t \n \v \f \r).
SPACE_CLASS = r"[\x20\x09-\x0D]+"

#: Largest number of keys that is ever sent to all executors as "hot"; it bounds the broadcast whatever the input.
HOT_KEYS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; the path is only ever opened by Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir``; only a local session (tests) gets an own one where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = getattr(scratch_root, "own", None)
        if root is None:
            root = scratch_root.own = tempfile.mkdtemp(prefix="spark-spindle-")
    return root.rstrip("/")


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared scratch folder and read it back.

    The lineage ends there, so a lost executor costs a re-read and not a recomputation, and later passes
    read only the columns they need.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/spindle/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.scratch_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` has written and no later step reads; without any, only what finished steps have left behind.

    The driver's garbage collection that follows lets Spark remove the shuffle files of those steps.  The listener bus holds on to the last
    event it was sent, and the end of a query is an event with the query's plan, so a job of one row is run first: without it the files of the
    last step would stay until another one has ended.
    """
    context = SparkContext.getOrCreate()
    for df in tables:
        path = context._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    context._jsc.parallelize(context._jvm.java.util.Collections.singletonList("")).count()
    context._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_join(big: DataFrame, small: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """``big`` joined with ``small`` (one row per ``key``, ``weight`` = its rows in ``big``) without a hot task.

    The ``HOT_KEYS`` heaviest keys are resolved by a broadcast of at most that many rows, so a key that
    holds a third of ``big`` stays where it is; all the others go through an ordinary shuffled join.
    """
    hot = small.filter(F.col(weight) > 1).orderBy(F.desc(weight), key).limit(HOT_KEYS)
    near = big.join(F.broadcast(hot), key)
    far = big.join(F.broadcast(hot.select(key)), key, "left_anti").join(small, key, how)
    return near.unionByName(far)


def empty_if_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def row_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds ``_tag``, a hash of id and text: with the id it names a row; only rows repeated as a whole share it."""
    return docs.withColumn("_tag", tag(id_col, text_col))


def tag(id_col: str = "doc_id", text_col: str = "text") -> Column:
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def boxed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(_row, _o, _tag, text)``: whole rows as a struct beside their keys, so that no column of theirs can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), order_id(id_col).alias("_o"), tag(id_col, text_col).alias("_tag"), F.col(text_col).alias("text"))


def without_rows(docs: DataFrame, rejected: DataFrame, keep_listed: bool = False) -> DataFrame:
    """The rows of ``docs`` whose ``(doc_id, _tag)`` is not in ``rejected`` (or, with ``keep_listed``, is in it).

    ``rejected`` should be a table on disk: its size is then known when the join is planned, and a small one costs no shuffle.
    """
    listed = rejected.select(order_id().alias("_o2"), F.col("_tag").alias("_t2")).distinct()
    same = (F.col("_o") == F.col("_o2")) & (F.col("_tag") == F.col("_t2"))
    return boxed(docs).drop("text").join(listed, same, "left_semi" if keep_listed else "left_anti").select("_row.*")


def packed(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """``rows`` with ``z``, the compressed UTF-8 of the text, instead of it: for joins that move all texts.  Null stays null."""
    kept = [c for c in rows.columns if c != text_col]
    moved = rows.select(*kept, text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(kept))
            small = [zlib.compress(t.as_py().encode("utf-8", "surrogatepass"), 1) if t.is_valid else None for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(small, pa.binary())], names=[*kept, "z"])

    schema = moved.drop(text_col).schema.add("z", "binary")
    return moved.mapInArrow(run, schema)


def unpacked(z: bytes | None) -> str | None:
    return None if z is None else zlib.decompress(z).decode("utf-8", "surrogatepass")


#: Stands for a null id in orders and join keys: after all others.
LAST_ID = (1 << 63) - 1


def order_id(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID))
