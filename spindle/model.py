"""The semantic catalog: data objects, their fields and relations, functions, and who may see what."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """A field of an object: a column, a renamed column (``source``; "-" gives NULL) or an expression (``sql``)."""

    name: str
    source: str | None = None
    sql: str | None = None
    filter_required: bool = False
    exclude_filter: bool = False
    measurement: str | None = None  # sum, avg, min, max or any: a measure of a cube


@dataclass(frozen=True)
class Relation:
    """A directed edge to another object.

    ``keys`` pairs own and target fields (NULL keys never match).  ``on`` adds a condition over the aliases ``l`` and ``r``.  ``junction`` names the
    object of a many-to-many relation, with ``junction_keys`` from own fields to it and ``keys`` from it to the target.
    """

    name: str
    target: str
    kind: str = "one"  # one, many
    keys: tuple[tuple[str, str], ...] = ()
    on: str | None = None
    junction: str | None = None
    junction_keys: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class DataObject:
    """A table, a view (``sql`` over registered names) or a view with named arguments."""

    name: str
    source: Callable[[SparkSession], DataFrame] | None = None
    sql: str | None = None
    args: tuple[str, ...] = ()
    required_args: tuple[str, ...] = ()
    pk: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    fields: tuple[Field, ...] = ()
    relations: tuple[Relation, ...] = ()
    soft_delete: str | None = None  # condition of the rows that are alive
    cube: bool = False
    module: str = ""
    description: str = ""

    def relation(self, name: str) -> Relation:
        for r in self.relations:
            if r.name == name:
                return r
        raise KeyError(f"{self.name} has no relation {name!r}")

    def field_of(self, name: str) -> Field:
        return next((f for f in self.fields if f.name == name), Field(name))


@dataclass(frozen=True)
class FunctionDef:
    """A named function: an SQL template with ``[arg]`` places, or a Python callable over columns; ``table`` ones give rows."""

    name: str
    sql: str | None = None
    call: Callable | None = None
    args: tuple[str, ...] = ()
    defaults: dict = field(default_factory=dict)  # argument: name of a context variable
    skip_null: bool = False
    table: bool = False


@dataclass(frozen=True)
class Permission:
    """What a role may do with a field of an object ("*": all): hidden, row filter, values stamped on writes."""

    object: str = "*"
    field: str = "*"
    disabled: bool = False
    hidden: bool = False
    filter: dict | None = None
    data: dict | None = None


@dataclass(frozen=True)
class Context:
    """Who asks: role, user and further variables that views, defaults and permissions may use."""

    role: str = "admin"
    user: str | None = None
    variables: dict = field(default_factory=dict)
    with_deleted: bool = False

    def value(self, name: str):  # noqa: ANN201
        known = {"role": self.role, "user": self.user, "user_id": self.user}
        return self.variables.get(name, known.get(name))


class Catalog:
    """Registry of objects, functions and permissions over one Spark session."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.objects: dict[str, DataObject] = {}
        self.functions: dict[str, FunctionDef] = {}
        self.permissions: dict[str, list[Permission]] = {}
        self.embedder: Callable[[str], list[float]] | None = None  # text to vector, for semantic search

    def add(self, *objects: DataObject) -> Catalog:
        for o in objects:
            if o.name in self.objects:
                raise ValueError(f"object {o.name!r} exists")
            self.objects[o.name] = o
        return self

    def extend(self, name: str, fields: tuple[Field, ...] = (), relations: tuple[Relation, ...] = ()) -> Catalog:
        """Overlay of another source: more fields and relations on an object that exists."""
        o = self.objects[name]
        self.objects[name] = replace(o, fields=o.fields + tuple(fields), relations=o.relations + tuple(relations))
        return self

    def add_function(self, *functions: FunctionDef) -> Catalog:
        self.functions |= {f.name: f for f in functions}
        return self

    def grant(self, role: str, *rules: Permission) -> Catalog:
        self.permissions.setdefault(role, []).extend(rules)
        return self

    def object(self, name: str) -> DataObject:
        if name not in self.objects:
            raise KeyError(f"no object {name!r}")
        return self.objects[name]

    def rule(self, ctx: Context, obj: str, field_name: str) -> Permission | None:
        """The most exact rule of the role: object and field, then object, then field, then all.  None: open."""
        ranked = [(2 * (r.object == obj) + (r.field == field_name), r) for r in self.permissions.get(ctx.role, ()) if r.object in (obj, "*") and r.field in (field_name, "*")]
        return max(ranked, key=lambda x: x[0])[1] if ranked else None

    def scan(self, obj: DataObject, ctx: Context, args: dict | None = None) -> DataFrame:
        """The object's rows with every declared field, soft-deleted ones left out unless the context asks for them."""
        args = args or {}
        missing = [a for a in obj.required_args if args.get(a) is None]
        unknown = [a for a in args if a not in obj.args + obj.required_args]
        if missing or unknown:
            raise ValueError(f"{obj.name}: missing arguments {missing}, unknown arguments {unknown}")
        if obj.sql is not None:
            names = {a: args.get(a) for a in obj.args + obj.required_args}
            names |= {f"auth_{k}": v for k, v in (ctx.variables | {"role": ctx.role, "user_id": ctx.user}).items() if f":auth_{k}" in obj.sql}
            df = self.spark.sql(obj.sql, args={k: v for k, v in names.items() if f":{k}" in obj.sql} or None)
        else:
            df = obj.source(self.spark)
        for f in obj.fields:
            if f.source == "-":
                df = df.withColumn(f.name, F.lit(None).cast("string"))
            elif f.source:
                df = df.withColumn(f.name, F.col(f.source))
            elif f.sql:
                df = df.withColumn(f.name, expand(f.sql, obj))
        if obj.soft_delete and not ctx.with_deleted:
            df = df.where(obj.soft_delete)
        return df


def expand(sql: str, obj: DataObject) -> Column:
    """A calculated field: ``[name]`` stands for another field, calculated ones included."""

    def inner(text: str, seen: tuple[str, ...]) -> str:
        for f in obj.fields:
            place = f"[{f.name}]"
            if place in text and f.sql:
                if f.name in seen:
                    raise ValueError(f"{obj.name}.{f.name} refers to itself")
                text = text.replace(place, f"({inner(f.sql, (*seen, f.name))})")
        return text.replace("[", "`").replace("]", "`")

    return F.expr(inner(sql, ()))
