"""Filters as nested dictionaries, compiled to columns and joins.

``{"field": {"op": value}}``; ``_and``, ``_or`` (lists), ``_not``; ``{"relation": {...}}`` on to-one relations and
``{"relation": {"any_of" | "all_of" | "none_of": {...}}}`` on to-many ones.  A condition whose value is None disappears, and so does a combinator that
is left empty; an empty ``in`` list matches nothing.
"""

from __future__ import annotations

import itertools
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindle.functions import json as J
from spindle.functions import ranges as R
from spindle.model import Catalog, Context, DataObject, Relation
from spindle.types import check_operator, scalar_of

if TYPE_CHECKING:
    from collections.abc import Callable

JSON_OPS = {"has": J.has, "has_all": J.has_all, "contains": J.contains, "json_eq": J.equals}
RANGE_FIELDS = {"lower", "upper", "lower_inc", "upper_inc"}
COMPARISONS = {"eq", "ne", "gt", "gte", "lt", "lte", "in", "like", "ilike", "regex", "is_null"}
names = itertools.count()


def is_range(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and set(kind.fieldNames()) == RANGE_FIELDS


def comparison(col: Column, kind: T.DataType, op: str, value: object) -> Column:
    """One operator on one column."""
    if op == "is_null":
        return col.isNull() if value else col.isNotNull()
    if op in JSON_OPS and isinstance(kind, T.StringType):
        return JSON_OPS[op](col, value)
    if op == "path":  # {"path": {"k": {"kind": "number", "gt": 5}}}
        parts = [
            comparison(J.extract(col, path, rule.get("kind", "string")), T.DoubleType() if rule.get("kind") == "number" else T.StringType(), k, v)
            for path, rule in value.items()
            for k, v in rule.items()
            if k != "kind" and v is not None
        ]
        return reduce(Column.__and__, parts)
    if is_range(kind):
        return range_test(col, op, value)
    check_operator(kind, op)
    scalar = scalar_of(kind)
    if scalar in ("List", "Vector") and op != "is_null":
        wanted = F.array(*map(F.lit, value)).cast(kind)
        if op == "eq":
            return col == wanted
        if op == "contains":
            return F.size(F.array_except(wanted, col)) == 0
        return F.coalesce(F.arrays_overlap(col, wanted), F.lit(False))
    if op == "in":
        return col.isin(list(value)) if value else F.lit(False)
    simple: dict[str, Callable[[], Column]] = {
        "eq": lambda: col == F.lit(value),
        "ne": lambda: col != F.lit(value),
        "gt": lambda: col > F.lit(value),
        "gte": lambda: col >= F.lit(value),
        "lt": lambda: col < F.lit(value),
        "lte": lambda: col <= F.lit(value),
        "like": lambda: col.like(value),
        "ilike": lambda: col.ilike(value),
        "regex": lambda: col.rlike(value),
    }
    return simple[op]()


def range_test(col: Column, op: str, value: object) -> Column:
    if op in ("lower", "upper"):
        return reduce(Column.__and__, [comparison(col[op], T.LongType(), k, v) for k, v in value.items() if v is not None])
    if op in ("lower_inclusive", "upper_inclusive"):
        return col[op.replace("lusive", "")] == F.lit(value)
    if op in ("lower_inf", "upper_inf"):
        test = col[op[:5]].isNull()
        return test if value else ~test
    if op == "contains" and not isinstance(value, (dict, str)):
        return R.contains(col, F.lit(value))
    other = R.literal(value)
    return {"eq": R.equals, "intersects": R.intersects, "includes": R.includes, "contains": R.includes}[op](col, other)


class Filter:
    """Compiles a filter of one object; relation conditions become flag columns of the frame they are applied to."""

    def __init__(self, catalog: Catalog, ctx: Context, obj: DataObject, rows: Callable):
        self.catalog, self.ctx, self.obj, self.rows = catalog, ctx, obj, rows

    def apply(self, df: DataFrame, tree: dict | None) -> DataFrame:
        """``df`` with the rows for which the tree is true.  Relation conditions that stand alone or under AND are semi- or anti-joins."""
        missing = [f.name for f in self.obj.fields if f.filter_required and not (tree or {}).get(f.name)]
        if missing:
            raise ValueError(f"{self.obj.name}: filters on {missing} are required")
        rest: list[dict] = []
        for name, value in (tree or {}).items():
            if value is None:
                continue
            if name == "_and":
                for part in value:
                    df = self.apply_part(df, part)
            elif name not in ("_or", "_not") and (rel := self.relation_of(name, value)):
                df = self.join_relation(df, rel, value)
            else:
                rest.append({name: value})
        columns = df.columns
        for part in rest:
            df, cond = self.compile(df, part)
            if cond is not None:
                df = df.where(cond)
        return df.select(*columns)

    def apply_part(self, df: DataFrame, part: dict | None) -> DataFrame:
        return Filter(self.catalog, self.ctx, DataObject(**{**self.obj.__dict__, "fields": tuple(f for f in self.obj.fields if not f.filter_required)}), self.rows).apply(df, part)

    def relation_of(self, name: str, value: object) -> Relation | None:
        """The relation that a condition is about; comparisons are about the column of that name."""
        if not isinstance(value, dict) or set(value) & COMPARISONS:
            return None
        return next((r for r in self.obj.relations if r.name == name), None)

    def compile(self, df: DataFrame, tree: dict | None) -> tuple[DataFrame, Column | None]:
        parts: list[Column] = []
        for name, value in (tree or {}).items():
            if value is None:
                continue
            if name in ("_and", "_or"):
                inner = []
                for sub in value:
                    df, c = self.compile(df, sub)
                    if c is not None:
                        inner.append(c)
                if inner:
                    parts.append(reduce(Column.__and__ if name == "_and" else Column.__or__, inner))
            elif name == "_not":
                df, c = self.compile(df, value)
                if c is not None:
                    parts.append(~c)
            elif rel := self.relation_of(name, value):
                df, c = self.flag(df, rel, value)
                if c is not None:
                    parts.append(c)
            else:
                parts += self.field(F.col(f"`{name}`"), df.schema[name].dataType, value)
        return df, (reduce(Column.__and__, parts) if parts else None)

    def field(self, col: Column, kind: T.DataType, ops: dict) -> list[Column]:
        if isinstance(kind, T.StructType) and not is_range(kind):  # filters of nested fields
            out = []
            for name, value in ops.items():
                if name == "is_null" and value is not None:
                    out.append(comparison(col, kind, name, value))
                elif isinstance(value, dict):
                    out += self.field(col[name], kind[name].dataType, value)
            return out
        return [comparison(col, kind, op, v) for op, v in ops.items() if v is not None]

    def matching(self, rel: Relation, tree: dict | None, negate: bool = False) -> DataFrame | None:
        """Keys of the parents that have a related row for which the tree is true (or, with ``negate``, false).  None: nothing is asked."""
        target = self.catalog.object(rel.target)
        rows = self.rows(target, self.ctx)
        inner = Filter(self.catalog, self.ctx, target, self.rows)
        if negate:
            rows, cond = inner.compile(rows, tree)
            if cond is None:
                return None
            rows = rows.where(~cond)
        elif tree:
            rows = inner.apply(rows, tree)
        if rel.junction:
            link = self.rows(self.catalog.object(rel.junction), self.ctx)
            link = link.select(*[F.col(j).alias(f"_p{k}") for k, (_, j) in enumerate(rel.junction_keys)], *[F.col(j).alias(f"_j{k}") for k, (j, _) in enumerate(rel.keys)])
            rows = rows.select(*[F.col(t).alias(f"_t{k}") for k, (_, t) in enumerate(rel.keys)])
            on = reduce(Column.__and__, [F.col(f"_j{k}") == F.col(f"_t{k}") for k in range(len(rel.keys))])
            return link.join(rows, on, "left_semi").select(*[f"_p{k}" for k in range(len(rel.junction_keys))])
        return rows.select(*[F.col(t).alias(f"_p{k}") for k, (_, t) in enumerate(rel.keys)])

    def own_keys(self, rel: Relation) -> list[str]:
        return [a for a, _ in (rel.junction_keys or rel.keys)]

    def condition(self, df: DataFrame, keys: DataFrame, rel: Relation) -> Column:
        return reduce(Column.__and__, [df[a] == keys[f"_p{k}"] for k, a in enumerate(self.own_keys(rel))])

    def steps(self, rel: Relation, value: dict) -> list[tuple[DataFrame, bool]]:
        """Key sets that a parent must (True) or must not (False) be in."""
        asked = [k for k in ("any_of", "all_of", "none_of") if k in value]
        if not asked:
            return [(self.matching(rel, value), True)] if _asks(value) else []
        out = []
        for kind in asked:
            tree = value[kind]
            if tree is None or not _asks(tree):
                continue
            if kind == "all_of":  # some related row, and none for which the condition is false
                against = self.matching(rel, tree, negate=True)
                out += [(self.matching(rel, None), True)] + ([(against, False)] if against is not None else [])
            else:
                out.append((self.matching(rel, tree), kind == "any_of"))
        return out

    def join_relation(self, df: DataFrame, rel: Relation, value: dict) -> DataFrame:
        for keys, wanted in self.steps(rel, value):
            df = df.join(keys, self.condition(df, keys, rel), "left_semi" if wanted else "left_anti")
        return df

    def flag(self, df: DataFrame, rel: Relation, value: dict) -> tuple[DataFrame, Column | None]:
        conds = []
        for keys, wanted in self.steps(rel, value):
            name = f"_flag{next(names)}"
            keys = keys.distinct().withColumn(name, F.lit(True))
            columns = df.columns
            df = df.join(keys, self.condition(df, keys, rel), "left").select(*[df[c] for c in columns], F.coalesce(keys[name], F.lit(False)).alias(name))
            conds.append(F.col(name) if wanted else ~F.col(name))
        return df, (reduce(Column.__and__, conds) if conds else None)


def _asks(tree: object) -> bool:
    """Whether anything of a filter is left once NULL values are dropped."""
    if isinstance(tree, dict):
        return any(_asks(v) for v in tree.values())
    if isinstance(tree, list) and tree and isinstance(tree[0], dict):
        return any(_asks(v) for v in tree)
    return tree is not None
