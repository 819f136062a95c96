"""Queries over the catalog, composed as DataFrames: selections with nested relations, aggregates, buckets and their nesting."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindle.functions import json as J
from spindle.functions import time as X
from spindle.functions import vector as V
from spindle.model import Catalog, Context, DataObject, Relation
from spindle.plans.filters import Filter


@dataclass(frozen=True)
class Col:
    """A selected field with its transform: time bucket or part, JSON path, struct projection or vector distance."""

    name: str
    alias: str | None = None
    bucket: str | None = None
    bucket_interval: str | float | None = None
    extract: str | None = None
    divide: int | None = None
    path: str | None = None
    kind: str = "string"
    struct: tuple = ()
    json_struct: str | None = None
    distance: tuple | None = None  # vector, metric

    @property
    def label(self) -> str:
        return self.alias or self.name.split(".")[-1]


@dataclass(frozen=True)
class Agg:
    """An aggregate.  ``count`` counts distinct values; ``list`` keeps NULLs; ``last`` and ``any`` take the row that ``order`` puts last or first."""

    field: str
    fn: str = "count"
    alias: str | None = None
    path: str | None = None
    kind: str = "number"
    sep: str = ","
    distinct: bool = False
    order: str | None = None
    of: Col | None = None  # aggregate this transform (time part or bucket, distance, ...) of the field

    @property
    def label(self) -> str:
        return self.alias or (self.field if self.field == "_rows_count" else f"{self.field.replace('.', '_')}_{self.fn}")


@dataclass(frozen=True)
class Branch:
    """Aggregates of a bucket over the rows of a filter of their own."""

    aggs: tuple[Agg, ...]
    filter: dict | None = None
    prefix: str = ""


@dataclass(frozen=True)
class Rel:
    """A related object inside a selection.

    ``filter`` to ``distinct_on`` act on the whole related object before the join, the ``nested_`` ones per parent.  ``aggs`` (and ``key``) turn it
    into the aggregate (the buckets) of each parent's rows.  ``target`` and ``on`` make a join of the query's own.
    """

    name: str
    fields: tuple = ()
    alias: str | None = None
    filter: dict | None = None
    order_by: tuple = ()
    limit: int | None = None
    offset: int = 0
    distinct_on: tuple = ()
    nested_order_by: tuple = ()
    nested_limit: int | None = None
    nested_offset: int = 0
    inner: bool = False
    unnest: bool = False
    aggs: tuple[Agg, ...] = ()
    key: tuple = ()
    target: str | None = None
    on: tuple = ()
    args: dict = field(default_factory=dict)

    @property
    def label(self) -> str:
        return self.alias or self.name


def sort_columns(order_by: tuple) -> list[Column]:
    """Sort keys from ``name`` or ``(name, direction)``; NULLs come last either way."""
    out = []
    for item in order_by:
        name, direction = (item, "asc") if isinstance(item, str) else item
        out.append(F.col(name).desc_nulls_last() if direction.lower() == "desc" else F.col(name).asc_nulls_last())
    return out


def limited(df: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    """The first rows; an offset without a limit is ignored."""
    if limit is None:
        return df
    return (df.offset(offset) if offset else df).limit(limit)


def first_of(df: DataFrame, keys: tuple, order_by: tuple) -> DataFrame:
    """One row for each key: the first in the order."""
    own = Window.partitionBy(*keys).orderBy(*(sort_columns(order_by) or [F.lit(1)]))
    return df.withColumn("_rank", F.row_number().over(own)).where("_rank = 1").drop("_rank")


def agg_column(a: Agg, schema: T.StructType, cond: Column | None = None) -> Column:
    """The aggregate as one expression; ``cond`` restricts its rows, so several branches share one pass."""
    kept = (lambda c: F.when(cond, c)) if cond is not None else (lambda c: c)
    if a.field == "_rows_count":
        return F.count(kept(F.lit(1)))
    col = F.col(a.field)
    if a.path:
        numeric = a.fn in ("sum", "avg", "min", "max")
        col = J.extract(col, a.path, "bool" if a.fn.startswith("bool") else ("number" if numeric else "string"))
    c = kept(col)
    if a.fn in ("any", "last"):
        if a.order:
            by = kept(F.struct(F.col(a.order).isNotNull(), F.col(a.order)))
            return F.max_by(F.struct(col.alias("v")), by)["v"] if a.fn == "last" else F.min_by(col, F.when(col.isNotNull(), by))
        return F.any_value(c, F.lit(True)) if a.fn == "any" else F.last(c)
    if a.fn == "list":
        packed = (F.collect_set if a.distinct else F.collect_list)(kept(F.struct(col.alias("v"))))
        return F.transform(packed, lambda x: x["v"])
    if a.fn == "string_agg":
        text = c.cast("string")
        return F.array_join(F.array_sort(F.collect_set(text) if a.distinct else F.collect_list(text)), a.sep) if a.order == "value" else (
            F.listagg_distinct(text, F.lit(a.sep)) if a.distinct else F.listagg(text, F.lit(a.sep))
        )
    plain = {"count": F.count_distinct, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "bool_and": F.bool_and, "bool_or": F.bool_or}
    return plain[a.fn](c)


class Query:
    """Builds DataFrames for one catalog and one asking context."""

    def __init__(self, catalog: Catalog, ctx: Context | None = None):
        self.catalog, self.ctx = catalog, ctx or Context()

    # rows ---------------------------------------------------------------------------------------------------------

    def rows(self, obj: DataObject, ctx: Context | None = None, args: dict | None = None) -> DataFrame:
        """The object's rows that the role may see: soft deletes and row filters come before anything else."""
        df = self.catalog.scan(obj, ctx or self.ctx, args)
        rule = self.catalog.rule(self.ctx, obj.name, "*")
        if rule and rule.disabled:
            raise PermissionError(f"{obj.name} is not open to {self.ctx.role}")
        if rule and rule.filter is not None:
            tree = self.filled(rule.filter)
            maker = Filter(self.catalog, self.ctx, obj, lambda o, c: self.catalog.scan(o, c))
            columns = df.columns
            df, cond = maker.compile(df, tree)
            df = df.where(cond if cond is not None else F.lit(False)).select(*columns)  # a rule that says nothing denies
        return df

    def filled(self, tree: object) -> object:
        """A rule with ``[$auth.x]`` replaced by the context's values."""
        if isinstance(tree, dict):
            return {k: self.filled(v) for k, v in tree.items()}
        if isinstance(tree, list):
            return [self.filled(v) for v in tree]
        if isinstance(tree, str) and tree.startswith("[$auth.") and tree.endswith("]"):
            return self.ctx.value(tree[7:-1])
        return tree

    def check(self, obj: DataObject, name: str, shown: bool = False) -> None:
        """Whether the role may use the field; ``shown``: in a way that would give away a hidden one."""
        rule = self.catalog.rule(self.ctx, obj.name, name)
        if rule and (rule.disabled or (shown and rule.hidden)):
            raise PermissionError(f"{obj.name}.{name} is not open to {self.ctx.role}")

    def check_paths(self, obj: DataObject, paths: Iterable[str | None], shown: bool = False) -> None:
        """The same for dotted paths, which may run through relations or into structs."""
        for path in paths:
            if not path or path.startswith("_"):
                continue
            name, _, rest = path.partition(".")
            rel = next((r for r in obj.relations if r.name == name), None)
            self.check(obj, name, shown)
            if rel is not None and rest:
                self.check_paths(self.catalog.object(rel.target), [rest], shown)

    def check_filter(self, obj: DataObject, tree: dict | None) -> None:
        """The same for every field of a filter, in nested and related conditions too."""
        maker = Filter(self.catalog, self.ctx, obj, self.rows)
        for name, value in (tree or {}).items():
            if value is None:
                continue
            if name in ("_and", "_or"):
                for part in value:
                    self.check_filter(obj, part)
            elif name == "_not":
                self.check_filter(obj, value)
            else:
                self.check(obj, name)
                if rel := maker.relation_of(name, value):
                    asked = [value[k] for k in ("any_of", "all_of", "none_of") if k in value]
                    for part in asked or [value]:
                        self.check_filter(self.catalog.object(rel.target), part)

    def masked(self, obj: DataObject, df: DataFrame) -> DataFrame:
        """``df`` with NULL in the fields that are hidden from the role."""
        rules = {c: self.catalog.rule(self.ctx, obj.name, c) for c in df.columns if not c.startswith("_")}
        hidden = [c for c, rule in rules.items() if rule and rule.hidden]
        return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in hidden}) if hidden else df

    def base(self, obj: DataObject, filter=None, order_by=(), limit=None, offset=0, distinct_on=(), args=None) -> DataFrame:  # noqa: A002, ANN001
        df = self.rows(obj, args=args)
        self.check_filter(obj, filter)
        self.check_paths(obj, [x if isinstance(x, str) else x[0] for x in (*order_by, *distinct_on) if not isinstance(x, Column)] if limit is not None or distinct_on else [], shown=True)
        df = Filter(self.catalog, self.ctx, obj, lambda o, c: self.rows(o, c)).apply(df, filter)
        if distinct_on:
            df = first_of(df, tuple(distinct_on), tuple(order_by))
        if order_by and limit is not None:
            df = df.orderBy(*sort_columns(order_by))
        return limited(df, limit, offset)

    # selections ---------------------------------------------------------------------------------------------------

    def select(self, name: str, fields: list, filter: dict | None = None, order_by=(), limit: int | None = None, offset: int = 0,  # noqa: A002, ANN001
               distinct_on=(), args: dict | None = None, similarity: dict | None = None, semantic: dict | None = None) -> DataFrame:  # fmt: skip  # noqa: ANN001
        """A list of rows.  With inner relations the limit counts the rows that are left after them.

        ``similarity`` (a vector) or ``semantic`` (a text, embedded while planning) keeps the nearest rows of those that the filter leaves.
        """
        obj = self.catalog.object(name)
        if semantic:
            if similarity:
                raise ValueError("give similarity or semantic, not both")
            if self.catalog.embedder is None:
                raise ValueError("the catalog has no embedder")
            similarity = {**semantic, "vector": self.catalog.embedder(semantic["query"])}
        late = any(isinstance(f, Rel) and (f.inner or f.unnest) for f in fields)
        if similarity:
            df = self.base(obj, filter, args=args)
            df = V.nearest(df, similarity["name"], similarity["vector"], similarity.get("distance", "L2"), similarity["limit"], list(similarity.get("ties", obj.pk)))
        else:
            df = self.base(obj, filter, order_by, None if late else limit, offset, distinct_on, args)
        out = self.project(df, obj, fields, keep=[])
        if order_by:
            out = out.orderBy(*sort_columns(order_by))
        return limited(out, limit, offset) if late else out

    def select_one(self, name: str, fields: list, **keys) -> DataFrame:  # noqa: ANN003
        """The row with these unique values, if there is one."""
        return self.select(name, fields, {k: {"eq": v} for k, v in keys.items()}, limit=1)

    def column(self, f: Col, schema: T.StructType) -> Column:
        col = F.col(f.name)
        if f.bucket or f.bucket_interval is not None or f.extract:
            kind = schema[f.name].dataType
            if f.bucket:
                return X.bucket(col, f.bucket, kind)
            return X.bucket_interval(col, f.bucket_interval, kind) if f.bucket_interval is not None else X.part(col, f.extract, f.divide)
        if f.path:
            return J.extract(col, f.path, f.kind)
        if f.json_struct:
            return J.to_struct(col, f.json_struct)
        if f.distance:
            return V.distance(col, F.array(*[F.lit(float(x)) for x in f.distance[0]]), f.distance[1])
        if f.struct:
            return repacked(col, f.struct, schema[f.name].dataType)
        return col

    def project(self, df: DataFrame, obj: DataObject, fields: list, keep: list[str]) -> DataFrame:
        """Selected columns and relations of ``df``, and the columns ``keep`` as ``_keep_<name>``."""
        picked: dict[str, Column] = {}
        rels = [f for f in fields if isinstance(f, Rel)]
        plain = [Col(f) if isinstance(f, str) else f for f in fields if not isinstance(f, Rel)]
        for f in plain:
            if f.name == "__typename":
                picked[f.label] = F.lit(obj.name)
                continue
            self.check(obj, f.name)
            rule = self.catalog.rule(self.ctx, obj.name, f.name)
            picked[f.label] = F.lit(None).cast("string") if rule and rule.hidden else self.column(f, df.schema)
        if obj.cube:
            return self.cube(self.masked(obj, df), obj, plain)
        inner = {f"_own_{c}" for r in rels for c in self.own_keys(obj, r)}
        out = df.select(*[c.alias(a) for a, c in picked.items()], *[F.col(c).alias(f"_keep_{c}") for c in keep], *[F.col(c[5:]).alias(c) for c in sorted(inner)])
        order = [*picked]
        for r in rels:
            out, added = self.attach(out, obj, r)
            order += added
        return out.select(*order, *[f"_keep_{c}" for c in keep])

    def relation(self, obj: DataObject, r: Rel) -> Relation:
        return Relation(r.name, r.target, "many", tuple(r.on)) if r.target else obj.relation(r.name)

    def own_keys(self, obj: DataObject, r: Rel) -> list[str]:
        rel = self.relation(obj, r)
        extra = rel_columns(rel.on, "l") if rel.on else []
        return [a for a, _ in (rel.junction_keys or rel.keys)] + extra

    def attach(self, out: DataFrame, obj: DataObject, r: Rel) -> tuple[DataFrame, list[str]]:
        """``out`` joined with one relation, and the columns that this adds."""
        rel = self.relation(obj, r)
        target = self.catalog.object(rel.target)
        child = self.base(target, r.filter, r.order_by, r.limit, r.offset, r.distinct_on, r.args)
        keys = [t for _, t in rel.keys] + (rel_columns(rel.on, "r") if rel.on else [])
        if r.aggs:
            self.check_paths(target, [x for a in r.aggs for x in (a.field, a.order if a.order != "value" else None)])
            rows = self.masked(target, child.withColumns({f"_keep_{k}": F.col(k) for k in keys}))
            cols = []
        else:
            sorts = [x if isinstance(x, str) else x[0] for x in (*r.order_by, *r.nested_order_by)]
            rows = self.project(child, target, list(r.fields), keep=list(dict.fromkeys([*keys, *sorts])))
            cols = [c for c in rows.columns if not c.startswith("_keep_")]
        if rel.junction:
            link = self.rows(self.catalog.object(rel.junction))
            own = [j for _, j in rel.junction_keys]
            link = link.select(*[F.col(j).alias(f"_link_{k}") for k, j in enumerate(own)], *[F.col(j).alias(f"_jn_{k}") for k, (j, _) in enumerate(rel.keys)]).distinct()
            met = reduce(Column.__and__, [link[f"_jn_{k}"] == rows[f"_keep_{t}"] for k, (_, t) in enumerate(rel.keys)])
            rows = link.join(rows, met).drop(*[f"_jn_{k}" for k in range(len(rel.keys))])
            pairs = [(a, f"_link_{k}") for k, (a, _) in enumerate(rel.junction_keys)]
        else:
            pairs = [(a, f"_keep_{t}") for a, t in rel.keys]
        parent_keys = [k for _, k in pairs]
        how = "inner" if r.inner else "left"

        if rel.on:  # a condition that isn't equality: join the rows first, then group by parent
            return self.theta(out, r, rel, rows, pairs, cols, how)
        if r.unnest:
            on = reduce(Column.__and__, [out[f"_own_{a}"] == rows[k] for a, k in pairs])
            rows = rows.select(*[rows[c].alias(f"{r.label}_{c}") for c in cols], *parent_keys)
            on = reduce(Column.__and__, [out[f"_own_{a}"] == rows[k] for a, k in pairs])
            return out.join(rows, on, how).drop(*parent_keys), [f"{r.label}_{c}" for c in cols]
        packed = self.packed(rows, r, rel, parent_keys, cols)
        on = reduce(Column.__and__, [out[f"_own_{a}"] == packed[k] for a, k in pairs])
        return out.join(packed, on, how).drop(*parent_keys), [r.label]

    def packed(self, rows: DataFrame, r: Rel, rel: Relation, parent_keys: list[str], cols: list[str]) -> DataFrame:
        """One row for each parent key, with its struct, list of structs, aggregate or buckets."""
        rows = rows.dropna(subset=parent_keys)
        if r.aggs and not r.key:
            return rows.groupBy(*parent_keys).agg(F.struct(*[agg_column(a, rows.schema).alias(a.label) for a in r.aggs]).alias(r.label))
        if r.aggs:
            key = [Col(k) if isinstance(k, str) else k for k in r.key]
            cells = rows.select("*", *[self.column(k, rows.schema).alias(f"_key_{k.label}") for k in key]).groupBy(*parent_keys, *[f"_key_{k.label}" for k in key])
            cells = cells.agg(*[agg_column(a, rows.schema).alias(f"_agg_{a.label}") for a in r.aggs])
            cell = F.struct(F.struct(*[F.col(f"_key_{k.label}").alias(k.label) for k in key]).alias("key"), F.struct(*[F.col(f"_agg_{a.label}").alias(a.label) for a in r.aggs]).alias("aggregations"))
            return cells.groupBy(*parent_keys).agg(F.sort_array(F.collect_list(cell)).alias(r.label))
        one = F.struct(*cols)
        if rel.kind == "one" and not rel.junction:
            return rows.select(*parent_keys, one.alias(r.label))
        order = r.nested_order_by or r.order_by
        if order or r.nested_limit is not None:
            kept = tuple(f"_keep_{x}" if isinstance(x, str) else (f"_keep_{x[0]}", x[1]) for x in order)
            own = Window.partitionBy(*parent_keys).orderBy(*(sort_columns(kept) or [F.lit(1)]))
            rows = rows.withColumn("_rank", F.row_number().over(own))
            if r.nested_limit is not None:
                rows = rows.where((F.col("_rank") > r.nested_offset) & (F.col("_rank") <= r.nested_offset + r.nested_limit))
            gathered = F.transform(F.array_sort(F.collect_list(F.struct("_rank", one.alias("v")))), lambda x: x["v"])
        else:
            gathered = F.collect_list(one)
        return rows.groupBy(*parent_keys).agg(gathered.alias(r.label))

    def theta(self, out: DataFrame, r: Rel, rel: Relation, rows: DataFrame, pairs: list, cols: list[str], how: str) -> tuple[DataFrame, list[str]]:
        left = out if r.unnest else out.withColumn("_row", F.monotonically_increasing_id())  # equal parents stay apart
        cond = re.sub(r"\b([lr])\.(\w+)", lambda m: f"`_{'own' if m[1] == 'l' else 'keep'}_{m[2]}`", rel.on)
        on = F.expr(cond)
        for a, k in pairs:
            on = on & (F.col(f"_own_{a}") == F.col(k))
        rows = rows.select(*[F.col(c).alias(f"{r.label}_{c}") for c in cols], *[c for c in rows.columns if c not in cols])
        names = [f"{r.label}_{c}" for c in cols]
        if r.unnest:
            return left.join(rows, on, how).drop(*[c for c in rows.columns if c not in names]), names
        joined = left.join(rows, on, how)
        hit = F.col(next(c for c in rows.columns if c.startswith("_keep_"))).isNotNull()
        packed = F.collect_list(F.when(hit, F.struct(*[F.col(n).alias(c) for n, c in zip(names, cols, strict=True)])))
        first = [F.any_value(c).alias(c) for c in out.columns]
        got = joined.groupBy("_row").agg(*first, packed.alias(r.label)).drop("_row")
        return got.withColumn(r.label, F.when(F.size(r.label) > 0, F.col(r.label))), [r.label]

    def cube(self, df: DataFrame, obj: DataObject, plain: list[Col]) -> DataFrame:
        """Selected measures grouped by the other selected fields."""
        measures = [f for f in plain if obj.field_of(f.name).measurement]
        dims = [self.column(f, df.schema).alias(f.label) for f in plain if f not in measures]
        if not measures:
            return df.select(*dims)
        own = [agg_column(Agg(f.name, obj.field_of(f.name).measurement), df.schema).alias(f.label) for f in measures]
        return (df.groupBy(*dims) if dims else df).agg(*own).select(*[f.label for f in plain])

    # aggregates ---------------------------------------------------------------------------------------------------

    def derived(self, df: DataFrame, aggs: Iterable[Agg]) -> tuple[DataFrame, list[Agg]]:
        """``df`` with the transforms that the aggregates ask for as columns, and the aggregates over those."""
        made, out = {}, []
        for a in aggs:
            if a.of is None:
                out.append(a)
                continue
            if a.of.name != a.field:
                raise ValueError(f"{a.label}: the transform is of {a.of.name}, the aggregate of {a.field}")
            name = next((k for k, (of, _) in made.items() if of == a.of), f"_of_{len(df.columns) + len(made)}")
            made[name] = (a.of, self.column(a.of, df.schema))
            out.append(replace(a, field=name, alias=a.label, of=None))
        return df.withColumns({k: c for k, (_, c) in made.items()}), out

    def joined(self, obj: DataObject, joins: tuple) -> DataObject:
        """``obj`` with joins of the query's own as further relations."""
        return replace(obj, relations=(*obj.relations, *[Relation(r.label, r.target, "many", tuple(r.on)) for r in joins])) if joins else obj

    def flat(self, obj: DataObject, df: DataFrame, paths: list[str], joins: tuple = ()) -> DataFrame:
        """``df`` with the to-one or to-many relations that ``paths`` run through joined in as structs (to-many ones multiply the rows)."""
        asked = {r.label: r.filter for r in joins}
        for name in dict.fromkeys(p.split(".")[0] for p in paths if "." in p):
            rel = next((r for r in obj.relations if r.name == name), None)
            if rel is None:
                continue  # a struct column
            target = self.catalog.object(rel.target)
            inner = [p.split(".", 1)[1] for p in paths if p.startswith(f"{name}.")]
            self.check_filter(target, asked.get(name))
            own = Filter(self.catalog, self.ctx, target, lambda o, c: self.rows(o, c)).apply(self.rows(target), asked.get(name))
            child = self.flat(target, self.masked(target, own), inner)
            child = child.select(F.struct(*child.columns).alias(name), *[F.col(t).alias(f"_k_{t}") for _, t in rel.keys])
            if rel.junction:
                link = self.rows(self.catalog.object(rel.junction))
                link = link.select(*[F.col(j).alias(f"_l_{j}") for _, j in rel.junction_keys], *[F.col(j).alias(f"_j_{j}") for j, _ in rel.keys])
                child = link.join(child, reduce(Column.__and__, [F.col(f"_j_{j}") == F.col(f"_k_{t}") for j, t in rel.keys]))
                on = [(a, f"_l_{j}") for a, j in rel.junction_keys]
            else:
                on = [(a, f"_k_{t}") for a, t in rel.keys]
            keep = df.columns
            df = df.join(child, reduce(Column.__and__, [df[a] == child[k] for a, k in on]), "left").select(*[df[c] for c in keep], child[name])
        return df

    def aggregate(self, name: str, aggs: list[Agg], filter: dict | None = None, order_by=(), limit=None, offset=0, distinct_on=(), args=None, similarity=None, joins=()) -> DataFrame:  # noqa: A002, ANN001
        """One row of aggregates over the selected rows; ``joins`` are joins of the query's own, whose fields ``label.field`` names."""
        obj = self.catalog.object(name)
        df = self.base(obj, filter, order_by, limit, offset, distinct_on, args)
        if similarity:
            df = V.nearest(df, similarity["name"], similarity["vector"], similarity.get("distance", "L2"), similarity["limit"], list(similarity.get("ties", obj.pk)))
        obj = self.joined(obj, joins)
        self.check_paths(obj, [x for a in aggs for x in (a.field, a.order if a.order != "value" else None)])
        df = self.flat(obj, self.masked(obj, df), [a.field for a in aggs], joins)
        df, aggs = self.derived(df, aggs)
        return df.agg(*[agg_column(a, df.schema).alias(a.label) for a in aggs])

    def buckets(self, name: str, key: list, aggs: list[Agg] | None = None, branches: list[Branch] | None = None, filter: dict | None = None,  # noqa: A002
                order_by=(), limit=None, offset=0, args=None, joins=()) -> DataFrame:  # fmt: skip  # noqa: ANN001
        """Aggregates by key.  Branches with filters of their own share one pass; a key that no branch selects does not appear."""
        obj = self.joined(self.catalog.object(name), joins)
        key = [Col(k) if isinstance(k, str) else k for k in key]
        branches = branches or ([Branch(tuple(aggs))] if aggs else [])
        self.check_paths(obj, [k.name for k in key] + [x for b in branches for a in b.aggs for x in (a.field, a.order if a.order != "value" else None)])
        for b in branches:
            self.check_filter(obj, b.filter)
        df = self.masked(obj, self.base(obj, filter, args=args))
        df = self.flat(obj, df, [k.name for k in key] + [a.field for b in branches for a in b.aggs], joins)
        df, aggs = self.derived(df, [a for b in branches for a in b.aggs])
        left = iter(aggs)
        branches = [replace(b, aggs=tuple(next(left) for _ in b.aggs)) for b in branches]
        own = [(self.column(k, df.schema) if "." not in k.name else F.col(k.name)).alias(k.label) for k in key]
        if not branches:
            out = df.select(*own).distinct()
        else:
            maker = Filter(self.catalog, self.ctx, obj, lambda o, c: self.rows(o, c))
            cols, conds = [], []
            for b in branches:
                df, cond = maker.compile(df, b.filter)
                conds.append(cond)
                cols += [(b, a, cond) for a in b.aggs]
            if all(c is not None for c in conds):
                df = df.where(reduce(Column.__or__, conds))
            out = df.groupBy(*own).agg(*[agg_column(a, df.schema, cond).alias(b.prefix + a.label) for b, a, cond in cols])
        if order_by:
            out = out.orderBy(*sort_columns(order_by))
        return limited(out, limit, offset)

    def per_parent(self, obj: DataObject, path: str, inner: list[Agg], middle: tuple, filters: dict) -> tuple[DataFrame, list[tuple[str, str]]]:
        """Aggregates of the related rows at ``path``, one row for each parent key ``_k0``, ...; and the pairs of parent field and key."""
        name, _, rest = path.partition(".")
        rel = obj.relation(name)
        target = self.catalog.object(rel.target)
        self.check_paths(obj, [name])
        child = self.base(target, filters.get(name))
        for _, t in rel.keys:
            child = child.withColumn(f"_key_{t}", F.col(t))
        child = self.masked(target, child)
        if rest:
            lower, on = self.per_parent(target, rest, inner, middle[1:], filters)
            child = child.join(lower, reduce(Column.__and__, [child[a] == lower[k] for a, k in on]), "left").drop(*[k for _, k in on])
            aggs = [Agg(label, fn, label if label == "_rows_count" else f"{label}_{fn}") for label, fn in middle[0]]
        else:
            self.check_paths(target, [x for a in inner for x in (a.field, a.order if a.order != "value" else None)])
            child, aggs = self.derived(child, inner)
        if rel.junction:
            link = self.rows(self.catalog.object(rel.junction))
            link = link.select(*[F.col(j).alias(f"_l_{j}") for _, j in rel.junction_keys], *[F.col(j).alias(f"_j_{j}") for j, _ in rel.keys])
            child = link.join(child, reduce(Column.__and__, [F.col(f"_j_{j}") == F.col(f"_key_{t}") for j, t in rel.keys]))
            on = [(a, f"_l_{j}") for a, j in rel.junction_keys]
        else:
            on = [(a, f"_key_{t}") for a, t in rel.keys]
        per = child.groupBy(*[F.col(k).alias(f"_k{n}") for n, (_, k) in enumerate(on)]).agg(*[agg_column(a, child.schema).alias(a.label) for a in aggs])
        return per, [(a, f"_k{n}") for n, (a, _) in enumerate(on)]

    def sub_aggregate(self, name: str, relation: str, inner: list[Agg], outer: list[tuple[str, str]], filter: dict | None = None,  # noqa: A002
                      child_filter: dict | None = None, middle: tuple = ()) -> DataFrame:
        """Aggregates of each parent's aggregates: ``outer`` pairs an inner label with a function; ``_rows_count`` counts parents.

        ``relation`` may be of any kind, or a path: ``middle`` then has the pairs for each relation of it but the last, from the first on.
        ``child_filter`` has a filter for related rows by the relation's name.
        """
        if len(middle) != relation.count("."):
            raise ValueError(f"{relation}: one list of pairs is needed for each relation but the last")
        obj = self.catalog.object(name)
        parents = self.base(obj, filter)
        per, on = self.per_parent(obj, relation, inner, tuple(middle), child_filter or {})
        joined = parents.join(per, reduce(Column.__and__, [parents[a] == per[k] for a, k in on]), "left")
        made = [agg_column(Agg(label, fn), joined.schema).alias(label if label == "_rows_count" else f"{label}_{fn}") for label, fn in outer]
        return joined.agg(*made)

    def aggregate_function(self, name: str, aggs: list[Agg], key: tuple = (), **values) -> DataFrame:  # noqa: ANN003
        """Aggregates (by ``key``, if given) of the rows of a table function."""
        df, aggs = self.derived(self.table_function(name, **values), aggs)
        made = [agg_column(a, df.schema).alias(a.label) for a in aggs]
        key = [Col(k) if isinstance(k, str) else k for k in key]
        return df.groupBy(*[self.column(k, df.schema).alias(k.label) for k in key]).agg(*made)

    # functions ----------------------------------------------------------------------------------------------------

    def call(self, name: str, **values) -> Column:  # noqa: ANN003
        """A scalar function as a column; arguments are columns or literals, absent ones come from the context or are NULL."""
        fn = self.catalog.functions[name]
        given = {}
        for a in fn.args:
            v = values.get(a, self.ctx.value(fn.defaults[a]) if a in fn.defaults else None)
            if v is None and fn.skip_null:
                continue
            given[a] = v if isinstance(v, Column) else F.lit(v)
        if fn.call:
            return fn.call(**given)
        if any(isinstance(values.get(a), Column) for a in fn.args):
            raise TypeError("SQL functions take column names or literals")
        return F.expr(self.sql_of(fn, values))

    def sql_of(self, fn, values: dict) -> str:  # noqa: ANN001
        text = fn.sql
        for a in fn.args:
            v = values.get(a, self.ctx.value(fn.defaults[a]) if a in fn.defaults else None)
            text = text.replace(f"[{a}]", "NULL" if v is None else (v[1:] if isinstance(v, str) and v.startswith("$") else literal(v)))
        return text

    def lateral(self, df: DataFrame, name: str, alias: str, outer: bool = True, **columns) -> DataFrame:  # noqa: ANN003
        """``df`` with the members of an array-valued function of each row, one row for each (rows without any stay, if ``outer``)."""
        made = self.call(name, **columns)
        return df.select("*", (F.explode_outer if outer else F.explode)(made).alias(alias))

    def table_function(self, name: str, **values) -> DataFrame:  # noqa: ANN003
        """Rows of a table function."""
        fn = self.catalog.functions[name]
        return fn.call(self.catalog.spark, **values) if fn.call else self.catalog.spark.sql(self.sql_of(fn, values))


def literal(v: object) -> str:
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def merged(col: Column, **fields: Column) -> Column:
    """The struct with these fields set or added; NULL stays NULL."""
    for name, value in fields.items():
        col = col.withField(name, value)
    return col


def rel_columns(on: str, side: str) -> list[str]:
    return list(dict.fromkeys(re.findall(rf"\b{side}\.(\w+)", on)))


def repacked(col: Column, parts: tuple, kind: T.DataType) -> Column:
    """Chosen (and renamed) fields of a struct, or of each member of a list of structs; NULL stays NULL."""
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: repacked(x, parts, kind.elementType))
    made = []
    for p in parts:
        name, alias, inner = (p, p, ()) if isinstance(p, str) else (*p, ())[:3]
        made.append((repacked(col[name], inner, kind[name].dataType) if inner else col[name]).alias(alias))
    return F.when(col.isNotNull(), F.struct(*made))


def with_deleted(q: Query) -> Query:
    return Query(q.catalog, replace(q.ctx, with_deleted=True))
