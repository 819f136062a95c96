"""Sources: files of any format, JDBC databases, plug-ins; introspection of what they hold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.model import Catalog, DataObject, Field
from spindle.types import scalar_of

PLUGINS: dict[str, Callable[..., DataFrame]] = {}


def plugin(name: str) -> Callable:
    """Registers a source of one's own: a function ``(spark, **options) -> DataFrame``."""

    def note(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        PLUGINS[name] = f
        return f

    return note


def source(kind: str, **options) -> Callable[[SparkSession], DataFrame]:  # noqa: ANN003
    """A factory for ``DataObject.source``: parquet, orc, csv, json, text, jdbc, iceberg, delta, or a plug-in."""
    if kind in PLUGINS:
        return lambda spark: PLUGINS[kind](spark, **options)
    path = options.pop("path", None)
    schema = options.pop("schema", None)

    def load(spark: SparkSession) -> DataFrame:
        reader = spark.read.format(kind).options(**{k: str(v) for k, v in options.items()})
        reader = reader.schema(schema) if schema else reader
        return reader.load(path) if path else reader.load()

    return load


def jdbc(url: str, query: str, user: str = "", password: str = "", driver: str = "") -> Callable[[SparkSession], DataFrame]:
    """A whole sub-query answered by the database; needs the driver's jar on the class path."""
    return source("jdbc", url=url, query=query, user=user, password=password, **({"driver": driver} if driver else {}))


def files(spark: SparkSession, path: str) -> DataFrame:
    """Files below a path with their size and time."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")


def object_store(spark: SparkSession, scheme: str, settings: dict[str, str]) -> None:
    """Credentials and endpoints of an object store for this session, e.g. scheme ``s3a``."""
    for key, value in settings.items():
        spark.conf.set(f"spark.hadoop.fs.{scheme}.{key}", value)


def describe(name: str, df: DataFrame, **more) -> DataObject:  # noqa: ANN003
    """An object for a frame, with a field for each column."""
    return DataObject(name, lambda _: df, fields=tuple(Field(f.name) for f in df.schema), **more)


def objects_frame(catalog: Catalog) -> DataFrame:
    """The catalog's objects as rows."""
    rows = [(o.module, o.name, "view" if o.sql else "cube" if o.cube else "table", list(o.pk), o.description) for o in catalog.objects.values()]
    return catalog.spark.createDataFrame(rows, "module string, name string, kind string, pk array<string>, description string")


def fields_frame(catalog: Catalog, *names: str) -> DataFrame:
    """Fields with their Spark type and scalar."""
    from spindle.model import Context

    rows = []
    for n in names or catalog.objects:
        o = catalog.objects[n]
        if o.required_args:
            continue
        rows += [(n, f.name, f.dataType.simpleString(), scalar_of(f.dataType)) for f in catalog.scan(o, Context()).schema]
    return catalog.spark.createDataFrame(rows, "object string, name string, type string, scalar string")


def relations_frame(catalog: Catalog) -> DataFrame:
    rows = [(o.name, r.name, r.target, "m2m" if r.junction else r.kind, [f"{a}={b}" for a, b in r.keys]) for o in catalog.objects.values() for r in o.relations]
    return catalog.spark.createDataFrame(rows, "object string, name string, target string, kind string, keys array<string>")


def search(catalog: Catalog, text: str) -> DataFrame:
    """Objects by how many words of the text their names and descriptions hold."""
    words = F.array(*[F.lit(w) for w in text.lower().split()])
    found = objects_frame(catalog).withColumn("score", F.size(F.filter(words, lambda w: F.contains(F.lower(F.concat_ws(" ", "name", "module", "description")), w))))
    return found.where("score > 0").orderBy(F.desc("score"), "name")
