"""Managed tables as versioned Parquet folders: append, update, delete and merge write a new version; a log of commits names the current one.

A transaction stages versions of several tables and commits them with one log entry, so readers see all of it or none.  Old versions stay
readable by number or time.  Only Spark opens the paths.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG = T.StructType([T.StructField("commit", T.LongType()), T.StructField("at", T.DoubleType()), T.StructField("name", T.StringType()), T.StructField("folder", T.StringType())])


@dataclass(frozen=True)
class Outcome:
    """What a mutation did."""

    success: bool
    affected_rows: int
    last_id: int | None = None
    message: str = ""


class Store:
    """Versioned tables under one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def log(self) -> DataFrame:
        try:
            return self.spark.read.schema(LOG).json(f"{self.root}/_log")
        except AnalysisException:
            return self.spark.createDataFrame([], LOG)

    def _entry(self, name: str, version: int | None = None, at: float | None = None):  # noqa: ANN202
        log = self.log().where(F.col("name") == name)
        if version is not None:
            log = log.where(F.col("commit") <= version)
        if at is not None:
            log = log.where(F.col("at") <= at)
        return log.orderBy(F.desc("commit")).first()

    def read(self, name: str, version: int | None = None, at: float | None = None) -> DataFrame:
        """The table now, as of a commit, or as of a time; exactly one of the two may be given."""
        if version is not None and at is not None:
            raise ValueError("give a version or a time, not both")
        entry = self._entry(name, version, at)
        if entry is None:
            raise KeyError(f"no version of {name!r}")
        return self.spark.read.parquet(f"{self.root}/{entry['folder']}")

    def versions(self, name: str) -> DataFrame:
        return self.log().where(F.col("name") == name).orderBy("commit")

    def begin(self) -> Transaction:
        return Transaction(self)

    def create(self, name: str, df: DataFrame) -> Outcome:
        with self.begin() as t:
            return t.put(name, df)


class Transaction:
    """Staged versions; they become current when the block ends without an error."""

    def __init__(self, store: Store):
        self.store, self.staged = store, {}

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:  # noqa: ANN001
        if kind is None and self.staged:
            last = self.store.log().agg(F.max("commit")).first()[0] or 0
            rows = [(last + 1, time.time(), name, folder) for name, folder in self.staged.items()]
            self.store.spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").json(f"{self.store.root}/_log")

    def read(self, name: str) -> DataFrame:
        return self.store.spark.read.parquet(f"{self.store.root}/{self.staged[name]}") if name in self.staged else self.store.read(name)

    def put(self, name: str, df: DataFrame) -> Outcome:
        folder = f"{name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.store.root}/{folder}")
        self.staged[name] = folder
        return Outcome(True, self.store.spark.read.parquet(f"{self.store.root}/{folder}").count())

    def insert(self, name: str, rows: DataFrame, key: str | None = None, stamp: dict | None = None) -> Outcome:
        """Appends rows; a missing ``key`` is numbered on from the largest one, ``stamp`` forces values over what was given."""
        now = self.read(name)
        for column, value in (stamp or {}).items():
            rows = rows.withColumn(column, F.lit(value))
        last = None
        if key:
            top = now.agg(F.max(key)).first()[0] or 0
            if key not in rows.columns:
                rows = rows.withColumn(key, F.lit(None).cast("long"))
            given, fresh = rows.where(F.col(key).isNotNull()), rows.where(F.col(key).isNull()).drop(key)
            top = max(top, given.agg(F.max(key)).first()[0] or 0)
            numbered = fresh.rdd.zipWithIndex().map(lambda x: (*x[0], x[1] + top + 1)).toDF(T.StructType([*fresh.schema.fields, T.StructField(key, T.LongType())])) if fresh.columns else fresh
            rows = given.unionByName(numbered.select(*given.columns))
        n = rows.count()
        if key:
            last = rows.agg(F.max(key)).first()[0]
        self.put(name, now.unionByName(rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in now.schema])))
        return Outcome(True, n, last)

    def insert_nested(self, parent: str, parent_row: DataFrame, parent_key: str, children: dict[str, tuple[DataFrame, str, str | None]]) -> Outcome:
        """A parent row and rows of to-many relations: the parent's new key goes into each child's foreign key."""
        out = self.insert(parent, parent_row, parent_key)
        total = out.affected_rows
        for name, (rows, foreign, key) in children.items():
            total += self.insert(name, rows.withColumn(foreign, F.lit(out.last_id)), key).affected_rows
        return Outcome(True, total, out.last_id)

    def update(self, name: str, values: dict, where: str, allowed: str = "true", stamp: dict | None = None) -> Outcome:
        """Sets columns (literals or SQL expressions as Columns) in the rows that match and that the role may change."""
        now = self.read(name)
        hit = F.coalesce(F.expr(f"({where}) AND ({allowed})"), F.lit(False))
        n = now.where(hit).count()
        new = {c: v if hasattr(v, "cast") and not isinstance(v, str) else F.lit(v) for c, v in ({**values, **(stamp or {})}).items()}
        self.put(name, now.select(*[F.when(hit, new[f.name].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in new else F.col(f.name) for f in now.schema]))
        return Outcome(True, n)

    def delete(self, name: str, where: str, allowed: str = "true", soft: dict | None = None) -> Outcome:
        """Removes the rows, or sets the ``soft`` columns that mark them as deleted."""
        if soft:
            return self.update(name, soft, where, allowed)
        now = self.read(name)
        hit = F.coalesce(F.expr(f"({where}) AND ({allowed})"), F.lit(False))
        n = now.where(hit).count()
        self.put(name, now.where(~hit))
        return Outcome(True, n)

    def merge(self, name: str, rows: DataFrame, keys: list[str]) -> Outcome:
        """Rows with a known key replace it, others are added."""
        now = self.read(name)
        self.put(name, now.join(rows.select(*keys), keys, "left_anti").unionByName(rows.select(*now.columns)))
        return Outcome(True, rows.count())
