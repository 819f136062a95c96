"""The catalog over the given tables and the registered queries of the semantic layer, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.functions import json as J
from spindle.functions import ranges as R
from spindle.functions import time as X
from spindle.model import Catalog, Context, DataObject, Field, FunctionDef, Permission, Relation
from spindle.functions import geo, grid
from spindle.operators import spatial
from spindle.plans.query import Agg, Branch, Col, Query, Rel, merged
from spindle.streaming import subscription

PRIMARY_KEYS = {"region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",),
                "orders": ("o_orderkey",), "events": ("event_id",), "embeddings": ("vec_id",), "documents": ("doc_id",), "labels": ("doc_id",)}
FIELDS = {
    "lineitem": (Field("revenue", sql="[l_extendedprice] * (1 - [l_discount])"), Field("charge", sql="[revenue] * (1 + [l_tax])")),
    "customer": (Field("segment", source="c_mktsegment"), Field("phone", source="-")),
}
RELATIONS = {
    "customer": (Relation("orders", "orders", "many", (("c_custkey", "o_custkey"),)), Relation("nation", "nation", "one", (("c_nationkey", "n_nationkey"),))),
    "orders": (
        Relation("customer", "customer", "one", (("o_custkey", "c_custkey"),)),
        Relation("lines", "lineitem", "many", (("o_orderkey", "l_orderkey"),)),
    ),
    "lineitem": (
        Relation("order", "orders", "one", (("l_orderkey", "o_orderkey"),)),
        Relation("part", "part", "one", (("l_partkey", "p_partkey"),)),
        Relation("supplier", "supplier", "one", (("l_suppkey", "s_suppkey"),)),
    ),
    "nation": (Relation("region", "region", "one", (("n_regionkey", "r_regionkey"),)), Relation("customers", "customer", "many", (("n_nationkey", "c_nationkey"),)),
               Relation("cheaper_suppliers", "supplier", "many", (("n_nationkey", "s_nationkey"),), on="r.s_acctbal < l.n_nationkey * 400")),
    "region": (Relation("nations", "nation", "many", (("r_regionkey", "n_regionkey"),)),),
    "part": (Relation("suppliers", "supplier", "many", (("l_suppkey", "s_suppkey"),), junction="part_supplier", junction_keys=(("p_partkey", "l_partkey"),)),),
    "supplier": (Relation("nation", "nation", "one", (("s_nationkey", "n_nationkey"),)),),
    "documents": (Relation("label", "labels", "one", (("doc_id", "doc_id"),)),),
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels")


def build(spark: SparkSession, sf_dir: str) -> Catalog:
    """The catalog: one object for each table, and the views, cube, soft-delete object and functions over them."""
    catalog = Catalog(spark)
    read = lambda name: lambda s: s.read.parquet(f"{sf_dir}/{name}.parquet")
    for t in TABLES:
        catalog.add(DataObject(t, read(t), pk=PRIMARY_KEYS.get(t, ()), fields=FIELDS.get(t, ()), relations=RELATIONS.get(t, ())))
    pairs = lambda s: s.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_suppkey").distinct()
    catalog.add(DataObject("part_supplier", pairs))
    catalog.add(DataObject("sales", read("lineitem"), cube=True, fields=(Field("l_quantity", measurement="sum"), Field("l_extendedprice", measurement="max"))))
    catalog.add(DataObject("live_orders", read("orders"), pk=("o_orderkey",), soft_delete="o_orderstatus <> 'P'"))
    catalog.add(DataObject("sized_parts", lambda s: read("part")(s).withColumn("size_range", R.make(F.col("p_size") - 5, F.col("p_size") + 5)), pk=("p_partkey",)))
    shaped = lambda s: read("part")(s).withColumns({"words": F.split("p_type", " "), "spec": F.struct("p_size", F.struct("p_brand", "p_type").alias("kind"))})
    catalog.add(DataObject("shaped_parts", shaped, pk=("p_partkey",)))
    catalog.embedder = lambda text: [((len(text) * k) % 64 - 32) / 32.0 for k in range(64)]
    place = lambda k: (F.pmod(F.col("user_id") * k, F.lit(360)) / 2.0).cast("double")
    catalog.add(DataObject("visits", lambda s: read("events")(s).withColumns({"lon": place(37) - 90, "lat": place(11) - 90 + F.col("value") / 100}), pk=("event_id",)))
    for t in ("orders", "customer"):
        read(t)(spark).createOrReplaceTempView(f"spindle_{t}")
    catalog.add(DataObject("status_totals", sql="SELECT o_orderstatus, count(*) AS n, sum(o_totalprice) AS total FROM spindle_orders GROUP BY o_orderstatus"))
    catalog.add(DataObject("orders_above", sql="SELECT o_orderkey, o_custkey, o_totalprice FROM spindle_orders WHERE o_totalprice > :least AND (:status IS NULL OR o_orderstatus = :status)",
                           args=("status",), required_args=("least",), pk=("o_orderkey",)))
    catalog.add_function(
        FunctionDef("discounted", sql="[price] * (1 - [rate])", args=("price", "rate")),
        FunctionDef("described", sql="to_json(named_struct('size', [size], 'brand', [brand]))", args=("size", "brand")),
        FunctionDef("steps", sql="sequence(1, greatest(1, [n] % 4))", args=("n",)),
        FunctionDef("days", sql="SELECT explode(sequence(date'[first]', date'[last]', interval [step] day)) AS day", args=("first", "last", "step"), table=True),
        FunctionDef("day_span", call=lambda s, first, last: s.sql("SELECT explode(sequence(CAST(:a AS date), CAST(:b AS date))) AS day", args={"a": first, "b": last}), table=True),
    )
    catalog.grant("buyer", Permission("orders", "*", filter={"o_custkey": {"eq": "[$auth.user_id]"}}), Permission("customer", "c_acctbal", hidden=True))
    catalog.grant("stranger", Permission("orders", "*", filter={"o_custkey": {"eq": "[$auth.user_id]"}}))
    return catalog


def money(*names: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumns({n: F.round(n, 2) for n in names})


QUERIES: dict[str, Callable[[Query], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None) -> Callable:
    def note(f: Callable[[Query], DataFrame]) -> Callable[[Query], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return note


@register("SELECT o_orderkey, o_totalprice AS price, 'orders' AS kind, o_orderdate FROM orders")
def select_projection(q: Query) -> DataFrame:
    return q.select("orders", ["o_orderkey", Col("o_totalprice", "price"), Col("__typename", "kind"), "o_orderdate"])


@register(
    "SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS revenue, (l_extendedprice * (1 - l_discount)) * (1 + l_tax) AS charge FROM lineitem"
)
def select_calc_field(q: Query) -> DataFrame:
    return q.select("lineitem", ["l_orderkey", "revenue", "charge"])


@register("SELECT c_custkey, c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS phone FROM customer WHERE c_acctbal >= 0")
def select_renamed(q: Query) -> DataFrame:
    return q.select("customer", ["c_custkey", "segment", "phone"], {"c_acctbal": {"gte": 0}})


@register(
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 10 AND l_quantity <= 20 AND l_discount >= 0.05 AND l_tax < 0.04 AND l_linestatus <> 'O' AND l_shipdate >= TIMESTAMP '1996-01-01'"
)
def filter_comparisons(q: Query) -> DataFrame:
    tree = {"l_quantity": {"gt": 10, "lte": 20}, "l_discount": {"gte": 0.05}, "l_tax": {"lt": 0.04}, "l_linestatus": {"ne": "O"}, "l_shipdate": {"gte": "1996-01-01"}}
    return q.select("lineitem", ["l_orderkey", "l_linenumber", "l_quantity"], tree)


@register("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority IN (SELECT min(o_orderpriority) FROM orders)")
def filter_in(q: Query) -> DataFrame:
    least = q.aggregate("orders", [Agg("o_orderpriority", "min", "p")])
    few = q.select("orders", ["o_orderkey", "o_orderstatus", "o_orderpriority"], {"o_orderstatus": {"in": ["F", "P"]}})
    return few.join(F.broadcast(least), few["o_orderpriority"] == least["p"], "left_semi").select("o_orderkey", "o_orderstatus")  # one row


@register("SELECT o_orderkey FROM orders WHERE false")
def filter_in_empty(q: Query) -> DataFrame:
    return q.select("orders", ["o_orderkey"], {"o_orderstatus": {"in": []}})


@register("SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%E%' AND p_brand ILIKE 'brand#1%'")
def filter_like_ilike(q: Query) -> DataFrame:
    return q.select("part", ["p_partkey", "p_type"], {"p_type": {"like": "%E%"}, "p_brand": {"ilike": "brand#1%"}})


@register("SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '[0-9]*7[0-9]$')")
def filter_regex(q: Query) -> DataFrame:
    return q.select("customer", ["c_custkey", "c_name"], {"c_name": {"regex": "[0-9]*7[0-9]$"}})


@register("SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE d.lang IS NOT NULL")
def filter_is_null(q: Query) -> DataFrame:
    df = q.select("documents", ["doc_id", Rel("label", ("quality",))], {"lang": {"is_null": False}})
    return df.select("doc_id", F.col("label.quality").alias("quality"))


@register(
    "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR (o_totalprice > 100000 AND o_orderpriority LIKE '1%')) AND NOT (o_custkey <= 10 OR o_totalprice < 5000)"
)
def filter_and_or_not(q: Query) -> DataFrame:
    tree = {
        "_or": [{"o_orderstatus": {"eq": "F"}}, {"_and": [{"o_totalprice": {"gt": 100000}}, {"o_orderpriority": {"like": "1%"}}]}],
        "_not": {"_or": [{"o_custkey": {"lte": 10}}, {"o_totalprice": {"lt": 5000}}]},
    }
    return q.select("orders", ["o_orderkey"], tree)


@register("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def filter_null_drop(q: Query) -> DataFrame:
    tree = {"o_orderstatus": {"eq": "F", "in": None}, "o_custkey": None, "_or": [{"o_totalprice": {"gt": None}}], "_not": {"o_totalprice": {"lt": None}}}
    return q.select("orders", ["o_orderkey"], tree)


@register("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25 OFFSET 10")
def order_limit_offset(q: Query) -> DataFrame:
    return q.select("orders", ["o_orderkey", "o_totalprice"], order_by=(("o_totalprice", "desc"), "o_orderkey"), limit=25, offset=10)


@register("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def distinct_on(q: Query) -> DataFrame:
    return q.select("orders", ["o_custkey", "o_orderkey", "o_totalprice"], distinct_on=("o_custkey",), order_by=(("o_totalprice", "desc"), "o_orderkey"))


@register("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 7")
def select_by_pk(q: Query) -> DataFrame:
    return q.select_one("orders", ["o_orderkey", "o_custkey"], o_orderkey=7)


@register(
    "SELECT count(*) AS _rows_count, round(sum(o_totalprice), 2) AS o_totalprice_sum, round(avg(o_totalprice), 6) AS o_totalprice_avg, min(o_totalprice) AS o_totalprice_min, max(o_orderdate) AS o_orderdate_max FROM orders WHERE o_orderstatus = 'O'"
)
def agg_basic(q: Query) -> DataFrame:
    aggs = [Agg("_rows_count"), Agg("o_totalprice", "sum"), Agg("o_totalprice", "avg"), Agg("o_totalprice", "min"), Agg("o_orderdate", "max")]
    df = q.aggregate("orders", aggs, {"o_orderstatus": {"eq": "O"}})
    return df.withColumns({"o_totalprice_sum": F.round("o_totalprice_sum", 2), "o_totalprice_avg": F.round("o_totalprice_avg", 6)})


@register("SELECT count(DISTINCT l_partkey) AS l_partkey_count, count(DISTINCT l_returnflag) AS l_returnflag_count, count(*) AS _rows_count FROM lineitem")
def agg_count_distinct(q: Query) -> DataFrame:
    return q.aggregate("lineitem", [Agg("l_partkey", "count"), Agg("l_returnflag", "count"), Agg("_rows_count")])


@register("SELECT string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment) AS segments, min(c_name) AS c_name_min FROM customer")
def agg_string(q: Query) -> DataFrame:
    return q.aggregate("customer", [Agg("c_mktsegment", "string_agg", "segments", sep="|", distinct=True, order="value"), Agg("c_name", "min")])


@register("SELECT event_type, bool_and(value > 1) AS all_above, bool_or(value > 99) AS any_above FROM events GROUP BY event_type")
def agg_bool(q: Query) -> DataFrame:
    q.catalog.extend("events", (Field("above", sql="[value] > 1"), Field("high", sql="[value] > 99")))
    return q.buckets("events", ["event_type"], [Agg("above", "bool_and", "all_above"), Agg("high", "bool_or", "any_above")])


@register(
    "SELECT n_regionkey, list_aggregate(list_sort(list(n_name)), 'string_agg', ',') AS names, arg_min(n_name, n_nationkey) AS first_name, arg_max(n_name, n_nationkey) AS last_name FROM nation GROUP BY n_regionkey"
)
def agg_list(q: Query) -> DataFrame:
    aggs = [Agg("n_name", "list", "names"), Agg("n_name", "any", "first_name", order="n_nationkey"), Agg("n_name", "last", "last_name", order="n_nationkey")]
    return q.buckets("nation", ["n_regionkey"], aggs).withColumn("names", F.array_join(F.array_sort("names"), ","))


@register(
    "SELECT l_returnflag, l_linestatus, count(*) AS _rows_count, round(sum(l_quantity), 2) AS l_quantity_sum, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue_sum, round(avg(l_discount), 6) AS l_discount_avg FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus"
)
def bucket_basic(q: Query) -> DataFrame:
    aggs = [Agg("_rows_count"), Agg("l_quantity", "sum"), Agg("revenue", "sum"), Agg("l_discount", "avg")]
    df = q.buckets("lineitem", ["l_returnflag", "l_linestatus"], aggs, filter={"l_shipdate": {"lte": "1998-09-02"}})
    return df.transform(money("l_quantity_sum", "revenue_sum")).withColumn("l_discount_avg", F.round("l_discount_avg", 6))


@register("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def bucket_keys_only(q: Query) -> DataFrame:
    return q.buckets("orders", ["o_orderstatus", "o_orderpriority"])


@register(
    "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS f__rows_count, count(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'F') AS f_o_orderpriority_count, max(o_totalprice) FILTER (o_totalprice > 200000) AS big_o_totalprice_max FROM orders WHERE o_orderstatus = 'F' OR o_totalprice > 200000 GROUP BY o_custkey"
)
def bucket_filtered_branches(q: Query) -> DataFrame:
    done = Branch((Agg("_rows_count"), Agg("o_orderpriority", "count")), {"o_orderstatus": {"eq": "F"}}, "f_")
    big = Branch((Agg("o_totalprice", "max"),), {"o_totalprice": {"gt": 200000}}, "big_")
    return q.buckets("orders", ["o_custkey"], branches=[done, big])


@register("SELECT l_partkey, round(sum(l_quantity), 2) AS l_quantity_sum FROM lineitem GROUP BY l_partkey ORDER BY l_quantity_sum DESC, l_partkey LIMIT 20 OFFSET 5")
def bucket_order_limit(q: Query) -> DataFrame:
    df = q.buckets("lineitem", ["l_partkey"], [Agg("l_quantity", "sum")], order_by=(("l_quantity_sum", "desc"), "l_partkey"), limit=20, offset=5)
    return df.transform(money("l_quantity_sum"))


@register(
    "SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS o_orderdate, o_orderpriority, count(*) AS _rows_count, round(sum(o_totalprice), 2) AS o_totalprice_sum, round(avg(o_totalprice), 6) AS o_totalprice_avg FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL"
)
def bucket_time(q: Query) -> DataFrame:
    key = [Col("o_orderdate", bucket="month"), "o_orderpriority"]
    df = q.buckets("orders", key, [Agg("_rows_count"), Agg("o_totalprice", "sum"), Agg("o_totalprice", "avg")], filter={"o_orderstatus": {"eq": "F"}})
    return df.withColumns({"o_totalprice_sum": F.round("o_totalprice_sum", 2), "o_totalprice_avg": F.round("o_totalprice_avg", 6)})


@register(
    "SELECT c.c_mktsegment AS segment, n.n_name AS nation, count(*) AS _rows_count, round(sum(o.o_totalprice), 2) AS o_totalprice_sum FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY ALL"
)
def bucket_nested_key(q: Query) -> DataFrame:
    key = [Col("customer.c_mktsegment", "segment"), Col("customer.nation.n_name", "nation")]
    return q.buckets("orders", key, [Agg("_rows_count"), Agg("o_totalprice", "sum")]).transform(money("o_totalprice_sum"))


PARTS = ("minute", "hour", "day", "doy", "dow", "iso_dow", "week", "month", "year", "iso_year", "quarter", "epoch")
DUCK_PARTS = {"iso_dow": "isodow", "iso_year": "isoyear"}


@register(
    "SELECT event_id, "
    + ", ".join(f"date_part('{DUCK_PARTS.get(p, p)}', ts)::{'DOUBLE' if p == 'epoch' else 'BIGINT'} AS p_{p}" for p in PARTS)
    + ", (date_part('minute', ts)::BIGINT // 15) AS quarter_hour FROM events"
)
def time_extract(q: Query) -> DataFrame:
    return q.select("events", ["event_id", *[Col("ts", f"p_{p}", extract=p) for p in PARTS], Col("ts", "quarter_hour", extract="minute", divide=15)])


@register(
    "SELECT time_bucket(INTERVAL '6 hours', ts)::TIMESTAMP AS slot, time_bucket(INTERVAL '7 days', ts)::TIMESTAMP AS week, count(*) AS _rows_count, round(sum(value), 4) AS value_sum FROM events GROUP BY ALL"
)
def time_bucket_interval(q: Query) -> DataFrame:
    df = q.buckets("events", [Col("ts", "slot", bucket_interval="6 hours"), Col("ts", "week", bucket_interval="P7D")], [Agg("_rows_count"), Agg("value", "sum")])
    return df.withColumn("value_sum", F.round("value_sum", 4))


@register(
    "WITH b AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS ts, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY ALL), s AS (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM b) SELECT s.ts, n FROM s LEFT JOIN b ON b.ts = s.ts"
)
def time_gapfill(q: Query) -> DataFrame:
    hours = q.buckets("events", [Col("ts", bucket="hour")], [Agg("_rows_count", alias="n")], filter={"event_type": {"eq": "error"}})
    return X.gapfill(hours, "ts", "1 hour")


@register("SELECT l_returnflag, round(sum(l_quantity), 2) AS l_quantity, max(l_extendedprice) AS l_extendedprice, l_linestatus FROM lineitem GROUP BY l_returnflag, l_linestatus")
def cube_measure(q: Query) -> DataFrame:
    return q.select("sales", ["l_returnflag", "l_quantity", "l_extendedprice", "l_linestatus"]).transform(money("l_quantity"))


@register(
    "SELECT o_orderkey, c_name AS customer_name, n_name AS nation_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 LEFT JOIN nation ON n_nationkey = c_nationkey"
)
def rel_forward(q: Query) -> DataFrame:
    df = q.select("orders", ["o_orderkey", Rel("customer", ("c_name", Rel("nation", ("n_name",))), filter={"c_acctbal": {"gt": 0}})])
    return df.select("o_orderkey", F.col("customer.c_name").alias("customer_name"), F.col("customer.nation.n_name").alias("nation_name"))


@register(
    "SELECT c_custkey, count(o_orderkey) FILTER (o_totalprice > 150000) AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_totalprice DESC, o_orderkey) FILTER (o_totalprice > 150000) AS keys FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"
)
def rel_back_list(q: Query) -> DataFrame:
    df = q.select("customer", ["c_custkey", Rel("orders", ("o_orderkey", "o_totalprice"), filter={"o_totalprice": {"gt": 150000}}, order_by=(("o_totalprice", "desc"), "o_orderkey"))])
    keys = F.array_join(F.transform("orders", lambda o: o["o_orderkey"].cast("string")), ",")
    return df.select("c_custkey", F.coalesce(F.size("orders"), F.lit(0)).cast("long").alias("n"), keys.alias("keys"))


@register(
    "SELECT p_partkey, count(DISTINCT l_suppkey) AS n_suppliers, string_agg(DISTINCT s_name, ',' ORDER BY s_name) AS names FROM part LEFT JOIN lineitem ON l_partkey = p_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY p_partkey"
)
def rel_m2m(q: Query) -> DataFrame:
    df = q.select("part", ["p_partkey", Rel("suppliers", ("s_name",))])
    names = F.array_join(F.array_sort(F.transform("suppliers", lambda s: s["s_name"])), ",")
    return df.select("p_partkey", F.coalesce(F.size("suppliers"), F.lit(0)).cast("long").alias("n_suppliers"), names.alias("names"))


@register(
    "SELECT l_orderkey, l_linenumber, l_extendedprice, r_name FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey WHERE l_quantity > 45"
)
def rel_nested_deep(q: Query) -> DataFrame:
    deep = Rel("order", (Rel("customer", (Rel("nation", (Rel("region", ("r_name",)),)),)),))
    df = q.select("lineitem", ["l_orderkey", "l_linenumber", "l_extendedprice", deep], {"l_quantity": {"gt": 45}})
    return df.select("l_orderkey", "l_linenumber", "l_extendedprice", F.col("order.customer.nation.region.r_name").alias("r_name"))


@register("SELECT c_custkey, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'P' GROUP BY c_custkey")
def rel_inner(q: Query) -> DataFrame:
    df = q.select("customer", ["c_custkey", Rel("orders", ("o_orderkey",), filter={"o_orderstatus": {"eq": "P"}}, inner=True)])
    return df.select("c_custkey", F.size("orders").cast("long").alias("n"))


@register("SELECT c_custkey, o_orderkey AS orders_o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey")
def rel_unnest(q: Query) -> DataFrame:
    return q.select("customer", ["c_custkey", Rel("orders", ("o_orderkey",), filter={"o_orderstatus": {"eq": "P"}}, unnest=True)])


@register(
    "WITH t AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) SELECT c_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY k) AS top FROM customer LEFT JOIN (SELECT * FROM t WHERE k BETWEEN 2 AND 4) ON o_custkey = c_custkey GROUP BY c_custkey"
)
def rel_nested_limit(q: Query) -> DataFrame:
    top = Rel("orders", ("o_orderkey",), nested_order_by=(("o_totalprice", "desc"), "o_orderkey"), nested_limit=3, nested_offset=1)
    return q.select("customer", ["c_custkey", top]).select("c_custkey", F.array_join(F.transform("orders", lambda o: o["o_orderkey"].cast("string")), ",").alias("top"))


@register("SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_acctbal > 5000 AND r_name LIKE 'A%'")
def rel_filter_to_one(q: Query) -> DataFrame:
    return q.select("orders", ["o_orderkey"], {"customer": {"c_acctbal": {"gt": 5000}, "nation": {"region": {"r_name": {"like": "A%"}}}}})


@register("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def rel_filter_any_of(q: Query) -> DataFrame:
    return q.select("customer", ["c_custkey"], {"orders": {"any_of": {"o_totalprice": {"gt": 250000}}}})


@register(
    "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND NOT (o_totalprice > 20000))"
)
def rel_filter_all_of(q: Query) -> DataFrame:
    return q.select("customer", ["c_custkey"], {"orders": {"all_of": {"o_totalprice": {"gt": 20000}}}})


@register("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def rel_filter_none_of(q: Query) -> DataFrame:
    return q.select("customer", ["c_custkey"], {"orders": {"none_of": {"o_orderstatus": {"eq": "P"}}}})


@register(
    "SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 200000)"
)
def rel_filter_or(q: Query) -> DataFrame:
    any_open = {"orders": {"any_of": {"o_orderstatus": {"eq": "P"}, "o_totalprice": {"gt": 200000}}}}
    return q.select("customer", ["c_custkey"], {"_or": [{"c_acctbal": {"lt": 0}}, any_open]})


@register("SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_partkey = p_partkey AND s_acctbal < 0)")
def rel_filter_m2m(q: Query) -> DataFrame:
    return q.select("part", ["p_partkey"], {"suppliers": {"any_of": {"s_acctbal": {"lt": 0}}}})


@register(
    "SELECT c_custkey, n, total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey) ON o_custkey = c_custkey"
)
def relagg_per_parent(q: Query) -> DataFrame:
    per = Rel("orders", aggs=(Agg("_rows_count", alias="n"), Agg("o_totalprice", "sum", "total")), filter={"o_orderstatus": {"eq": "O"}})
    return q.select("customer", ["c_custkey", per]).select("c_custkey", F.col("orders.n").alias("n"), F.round("orders.total", 2).alias("total"))


@register(
    "WITH b AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) SELECT c_custkey, string_agg(o_orderstatus || ':' || n, ',' ORDER BY o_orderstatus) AS cells FROM customer LEFT JOIN b ON o_custkey = c_custkey GROUP BY c_custkey"
)
def relagg_bucket_per_parent(q: Query) -> DataFrame:
    df = q.select("customer", ["c_custkey", Rel("orders", key=("o_orderstatus",), aggs=(Agg("_rows_count", alias="n"),))])
    cell = lambda b: F.concat_ws(":", b["key"]["o_orderstatus"], b["aggregations"]["n"].cast("string"))
    return df.select("c_custkey", F.array_join(F.transform("orders", cell), ",").alias("cells"))


@register("SELECT count(*) AS _rows_count, round(sum(o_totalprice), 2) AS orders_o_totalprice_sum, round(sum(c_acctbal), 2) AS c_acctbal_sum FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def relagg_flat(q: Query) -> DataFrame:
    df = q.aggregate("customer", [Agg("_rows_count"), Agg("orders.o_totalprice", "sum"), Agg("c_acctbal", "sum")])
    return df.transform(money("orders_o_totalprice_sum", "c_acctbal_sum"))


@register(
    "WITH p AS (SELECT o_custkey, avg(o_totalprice) AS a, count(*) AS n FROM orders GROUP BY o_custkey) SELECT count(*) AS _rows_count, round(avg(a), 6) AS a_avg, max(n) AS n_max FROM customer LEFT JOIN p ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'"
)
def subagg(q: Query) -> DataFrame:
    inner = [Agg("o_totalprice", "avg", "a"), Agg("_rows_count", alias="n")]
    df = q.sub_aggregate("customer", "orders", inner, [("_rows_count", "count"), ("a", "avg"), ("n", "max")], {"c_mktsegment": {"eq": "BUILDING"}})
    return df.withColumn("a_avg", F.round("a_avg", 6))


@register(
    "WITH m AS (SELECT p.p_partkey, avg(s_acctbal) AS a, count(*) AS n FROM part p JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) ON l_partkey = p.p_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal > 0 GROUP BY 1) SELECT count(*) AS _rows_count, round(avg(a), 6) AS a_avg, max(n) AS n_max FROM part p LEFT JOIN m USING (p_partkey) WHERE p_size > 10"
)
def subagg_m2m(q: Query) -> DataFrame:
    inner = [Agg("s_acctbal", "avg", "a"), Agg("_rows_count", alias="n")]
    outer = [("_rows_count", "count"), ("a", "avg"), ("n", "max")]
    df = q.sub_aggregate("part", "suppliers", inner, outer, {"p_size": {"gt": 10}}, {"suppliers": {"s_acctbal": {"gt": 0}}})
    return df.withColumn("a_avg", F.round("a_avg", 6))


@register(
    "WITH per_order AS (SELECT l_orderkey, sum(l_quantity) AS quantity, count(*) AS n FROM lineitem GROUP BY 1), per_customer AS (SELECT o_custkey, max(quantity) AS quantity_max, sum(n) AS n_sum FROM orders LEFT JOIN per_order ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1) SELECT count(*) AS _rows_count, round(avg(quantity_max), 6) AS quantity_max_avg, max(n_sum)::BIGINT AS n_sum_max FROM customer LEFT JOIN per_customer ON o_custkey = c_custkey"
)
def subagg_two_levels(q: Query) -> DataFrame:
    inner = [Agg("l_quantity", "sum", "quantity"), Agg("_rows_count", alias="n")]
    outer = [("_rows_count", "count"), ("quantity_max", "avg"), ("n_sum", "max")]
    df = q.sub_aggregate("customer", "orders.lines", inner, outer, child_filter={"orders": {"o_orderstatus": {"eq": "F"}}}, middle=([("quantity", "max"), ("n", "sum")],))
    return df.withColumn("quantity_max_avg", F.round("quantity_max_avg", 6))


@register(
    "SELECT event_type, max(extract('hour' FROM ts))::BIGINT AS latest_hour, count(DISTINCT date_trunc('day', ts)) AS days, sum(extract('minute' FROM ts) // 15)::BIGINT AS quarters FROM events GROUP BY event_type"
)
def agg_extra_field(q: Query) -> DataFrame:
    hour, day, quarter = Col("ts", extract="hour"), Col("ts", bucket="day"), Col("ts", extract="minute", divide=15)
    return q.buckets("events", ["event_type"], [Agg("ts", "max", "latest_hour", of=hour), Agg("ts", "count", "days", of=day), Agg("ts", "sum", "quarters", of=quarter)])


@register(
    "SELECT extract('month' FROM day)::BIGINT AS month, count(*) AS days, min(day)::VARCHAR AS first_day FROM (SELECT unnest(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 1 DAY))::DATE AS day FROM events) GROUP BY 1"
)
def agg_table_function(q: Query) -> DataFrame:
    ends = q.aggregate("events", [Agg("ts", "min", "a"), Agg("ts", "max", "b")]).first()
    key = (Col("day", "month", extract="month"),)
    df = q.aggregate_function("day_span", [Agg("_rows_count", alias="days"), Agg("day", "min", "first_day")], key, first=str(ends["a"].date()), last=str(ends["b"].date()))
    return df.withColumn("first_day", F.col("first_day").cast("string"))


@register(
    "SELECT o_orderpriority, count(*) AS _rows_count, count(DISTINCT l_suppkey) AS suppliers, max(l_quantity) AS most FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_discount > 0.05) ON l_orderkey = o_orderkey GROUP BY 1"
)
def agg_joined(q: Query) -> DataFrame:
    lines = Rel("cut_price", target="lineitem", on=(("o_orderkey", "l_orderkey"),), filter={"l_discount": {"gt": 0.05}})
    return q.buckets("orders", ["o_orderpriority"], [Agg("_rows_count"), Agg("cut_price.l_suppkey", "count", "suppliers"), Agg("cut_price.l_quantity", "max", "most")], joins=(lines,))


@register(
    "SELECT c_custkey, count(s_suppkey) AS n, round(max(s_acctbal), 2) AS best FROM customer LEFT JOIN supplier ON s_nationkey = c_nationkey GROUP BY c_custkey"
)
def join_query_time(q: Query) -> DataFrame:
    near = Rel("suppliers", aggs=(Agg("_rows_count", alias="n"), Agg("s_acctbal", "max", "best")), target="supplier", on=(("c_nationkey", "s_nationkey"),))
    df = q.select("customer", ["c_custkey", near])
    return df.select("c_custkey", F.coalesce("suppliers.n", F.lit(0)).alias("n"), F.round("suppliers.best", 2).alias("best"))


@register(
    "SELECT n_nationkey, CASE WHEN count(s_suppkey) > 0 THEN count(s_suppkey) END AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal < n_nationkey * 400 GROUP BY n_nationkey"
)
def join_declared_theta(q: Query) -> DataFrame:
    df = q.select("nation", ["n_nationkey", Rel("cheaper_suppliers", ("s_suppkey",))])
    return df.select("n_nationkey", F.size("cheaper_suppliers").cast("long").alias("n"))


@register(
    "SELECT n_regionkey, n FROM (SELECT n_nationkey, n_regionkey, CASE WHEN count(s_suppkey) > 0 THEN count(s_suppkey) END AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal < n_nationkey * 400 GROUP BY n_nationkey, n_regionkey)"
)
def join_theta_duplicates(q: Query) -> DataFrame:
    df = q.select("nation", ["n_regionkey", Rel("cheaper_suppliers", ("s_suppkey",))])
    return df.select("n_regionkey", F.size("cheaper_suppliers").cast("long").alias("n"))


@register("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus HAVING count(*) > 100")
def view_simple(q: Query) -> DataFrame:
    return q.select("status_totals", ["o_orderstatus", "n", "total"], {"n": {"gt": 100}}).transform(money("total"))


@register("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 150000 AND o_orderstatus = 'F' AND o_custkey > 50")
def view_parameterised(q: Query) -> DataFrame:
    return q.select("orders_above", ["o_orderkey", "o_totalprice"], {"o_custkey": {"gt": 50}}, args={"least": 150000, "status": "F"})


@register("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_quantity < 5")
def fn_scalar(q: Query) -> DataFrame:
    rows = q.base(q.catalog.object("lineitem"), {"l_quantity": {"lt": 5}})
    return rows.select("l_orderkey", "l_linenumber", q.call("discounted", price="$l_extendedprice", rate="$l_discount").alias("net"))


@register(
    "WITH e AS (SELECT min(ts)::DATE AS a, max(ts)::DATE AS b FROM events), d AS (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS day FROM e) SELECT day::VARCHAR AS day, count(event_id) AS n FROM d LEFT JOIN events ON ts::DATE = day GROUP BY day"
)
def fn_table(q: Query) -> DataFrame:
    ends = q.aggregate("events", [Agg("ts", "min", "a"), Agg("ts", "max", "b")]).first()
    days = q.table_function("day_span", first=str(ends["a"].date()), last=str(ends["b"].date()))
    per = q.base(q.catalog.object("events")).groupBy(F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("c"))
    return days.join(per, F.col("day") == F.col("d"), "left").select(F.col("day").cast("string").alias("day"), F.coalesce("c", F.lit(0)).alias("n"))


@register(
    "SELECT event_type, round(sum((props->>'$.k')::DOUBLE), 4) AS k_sum, max((props->>'$.k')::DOUBLE) AS k_max, count(DISTINCT props->>'$.k') AS k_count FROM events GROUP BY event_type"
)
def json_path_agg(q: Query) -> DataFrame:
    aggs = [Agg("props", "sum", "k_sum", path="k"), Agg("props", "max", "k_max", path="k"), Agg("props", "count", "k_count", path="k")]
    return q.buckets("events", ["event_type"], aggs).withColumn("k_sum", F.round("k_sum", 4))


@register("SELECT event_id, (props->>'$.k')::DOUBLE AS k FROM events WHERE json_exists(props, '$.k') AND (props->>'$.k')::DOUBLE > 50 AND (props->>'$.k') <> '77'")
def json_filter(q: Query) -> DataFrame:
    tree = {"props": {"has": "k", "path": {"k": {"kind": "number", "gt": 50}}}, "_not": {"props": {"contains": {"k": 77}}}}
    return q.select("events", ["event_id", Col("props", "k", path="k", kind="number")], tree)


VISITS = "SELECT event_id, value, event_type, ((user_id * 37) % 360) / 2.0 - 90 AS lon, ((user_id * 11) % 360) / 2.0 - 90 + value / 100 AS lat FROM events"


def query_vector() -> list[float]:
    """A fixed direction of 64 dimensions."""
    return [((k * 37) % 64 - 32) / 32.0 for k in range(64)]


VECTOR_SQL = "[" + ", ".join(map(repr, query_vector())) + "]"
DISTANCES = {
    "L2": "sqrt(list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::DOUBLE - v[i]) * (embedding[i]::DOUBLE - v[i]))))",
    "Cosine": "1 - list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * v[i])) / (sqrt(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * embedding[i]::DOUBLE))) * sqrt(list_sum(list_transform(range(1, 65), lambda i: v[i] * v[i]))))",
    "Inner": "-list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * v[i]))",
}


def vector_sql(metric: str, where: str = "true") -> str:
    return f"SELECT vec_id, round({DISTANCES[metric]}, 6) AS distance FROM (SELECT *, {VECTOR_SQL}::DOUBLE[] AS v FROM embeddings WHERE {where}) ORDER BY {DISTANCES[metric]}, vec_id LIMIT 20"


def nearest(q: Query, metric: str, tree: dict | None = None) -> DataFrame:
    similar = {"name": "embedding", "vector": query_vector(), "distance": metric, "limit": 20}
    df = q.select("embeddings", ["vec_id", Col("_distance", "distance")], tree, similarity=similar)
    return df.withColumn("distance", F.round("distance", 6))


@register(vector_sql("L2"))
def vec_l2_topk(q: Query) -> DataFrame:
    return nearest(q, "L2")


@register(vector_sql("Cosine"))
def vec_cosine_topk(q: Query) -> DataFrame:
    return nearest(q, "Cosine")


@register(vector_sql("Inner"))
def vec_inner_topk(q: Query) -> DataFrame:
    return nearest(q, "Inner")


@register(vector_sql("L2", "label IN (1, 3)"))
def vec_filter_then_topk(q: Query) -> DataFrame:
    return nearest(q, "L2", {"label": {"in": [1, 3]}})


@register(vector_sql("L2").replace(VECTOR_SQL, "[" + ", ".join(repr(((11 * k) % 64 - 32) / 32.0) for k in range(64)) + "]"))
def vec_semantic_topk(q: Query) -> DataFrame:
    df = q.select("embeddings", ["vec_id", Col("_distance", "distance")], semantic={"name": "embedding", "query": "like events", "limit": 20})
    return df.withColumn("distance", F.round("distance", 6))


@register(f"SELECT count(*) AS _rows_count, count(DISTINCT label) AS label_count, max(vec_id) AS vec_id_max FROM ({vector_sql('L2')}) k JOIN embeddings USING (vec_id)")
def vec_aggregate(q: Query) -> DataFrame:
    similar = {"name": "embedding", "vector": query_vector(), "distance": "L2", "limit": 20}
    return q.aggregate("embeddings", [Agg("_rows_count"), Agg("label", "count"), Agg("vec_id", "max")], similarity=similar)


@register("SELECT p_partkey FROM part WHERE list_has_all(string_split(p_type, ' '), [(SELECT min(string_split(p_type, ' ')[1]) FROM part)])")
def filter_list(q: Query) -> DataFrame:
    word = q.base(q.catalog.object("shaped_parts")).agg(F.min(F.col("words")[0])).first()[0]
    return q.select("shaped_parts", ["p_partkey"], {"words": {"contains": [word], "intersects": [word, "none"]}})


@register("SELECT p_partkey, p_size AS size, p_brand AS brand FROM part WHERE p_size > 25 AND p_brand LIKE '%3'")
def filter_struct(q: Query) -> DataFrame:
    spec = Col("spec", struct=(("p_size", "size"), ("kind", "kind", (("p_brand", "brand"),))))
    df = q.select("shaped_parts", ["p_partkey", spec], {"spec": {"p_size": {"gt": 25}, "kind": {"p_brand": {"like": "%3"}}}})
    return df.select("p_partkey", F.col("spec.size").alias("size"), F.col("spec.kind.brand").alias("brand"))


@register("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events WHERE event_type = 'click'")
def json_struct(q: Query) -> DataFrame:
    df = q.select("events", ["event_id", Col("props", json_struct="k bigint")], {"event_type": {"eq": "click"}})
    return df.select("event_id", F.col("props.k").alias("k"))


@register("SELECT p_partkey, p_size::BIGINT AS size, p_brand AS brand FROM part")
def fn_json_cast(q: Query) -> DataFrame:
    df = q.base(q.catalog.object("part"))
    made = J.cast_result(df, q.call("described", size="$p_size", brand="$p_brand"), "size bigint, brand string")
    return df.select("p_partkey", made.alias("made")).select("p_partkey", "made.*")


@register("SELECT p_partkey, p_size + 1 AS p_size, p_name AS title FROM part")
def struct_merge(q: Query) -> DataFrame:
    spec = merged(F.col("spec"), p_size=F.col("p_size") + 1, title=F.col("p_name"))
    return q.base(q.catalog.object("shaped_parts")).select("p_partkey", spec.alias("spec")).select("p_partkey", "spec.p_size", "spec.title")


@register("SELECT p_partkey, unnest(range(1, greatest(1, p_size % 4) + 1))::INT AS step FROM part")
def fn_lateral(q: Query) -> DataFrame:
    return q.lateral(q.base(q.catalog.object("part")), "steps", "step", n="$p_size").select("p_partkey", "step")


@register(f"SELECT event_type, min(lon) AS x1, min(lat) AS y1, max(lon) AS x2, max(lat) AS y2 FROM ({VISITS}) GROUP BY event_type")
def geo_extent(q: Query) -> DataFrame:
    spots = q.base(q.catalog.object("visits")).select("event_type", geo.point("lon", "lat").alias("spot"))
    return spatial.extent(spots, "spot", ["event_type"])


@register("SELECT p_partkey FROM part WHERE p_size - 5 <= 20 AND 20 < p_size + 5 AND p_size - 5 < 30 AND 24 < p_size + 5 AND p_size - 5 >= 12")
def range_filters(q: Query) -> DataFrame:
    return q.select("sized_parts", ["p_partkey"], {"size_range": {"contains": 20, "intersects": "[24,30)", "lower": {"gte": 12}}})


@register("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 10")
def perm_row_filter(q: Query) -> DataFrame:
    return Query(q.catalog, Context("buyer", "10")).select("orders", ["o_orderkey", "o_totalprice"])


@register("SELECT c_mktsegment, count(*) AS n, CAST(NULL AS DOUBLE) AS most, count(DISTINCT o_orderkey) AS own FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_custkey = 10) ON o_custkey = c_custkey GROUP BY c_mktsegment")
def perm_hidden_aggregate(q: Query) -> DataFrame:
    aggs = [Agg("_rows_count", alias="n"), Agg("c_acctbal", "max", alias="most"), Agg("orders.o_orderkey", "count", alias="own")]
    return Query(q.catalog, Context("buyer", "10")).buckets("customer", ["c_mktsegment"], aggs)


@register("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_custkey = 10 AND o_totalprice > 1000) OR c_custkey < 3")
def perm_nested_filter(q: Query) -> DataFrame:
    asked = {"_or": [{"orders": {"any_of": {"o_totalprice": {"gt": 1000}}}}, {"c_custkey": {"lt": 3}}]}
    return Query(q.catalog, Context("buyer", "10")).select("customer", ["c_custkey"], asked)


@register("SELECT o_orderkey FROM orders WHERE false")
def perm_fail_closed(q: Query) -> DataFrame:
    return Query(q.catalog, Context("stranger")).select("orders", ["o_orderkey"])


@register("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice > 100000")
def soft_delete(q: Query) -> DataFrame:
    return q.select("live_orders", ["o_orderkey"], {"o_totalprice": {"gt": 100000}})


ZONES = "SELECT n_nationkey, n_nationkey * 7.0 - 90 AS x1, n_nationkey * 7.0 - 85 AS x2, n_nationkey * 3.0 - 90 AS y1, n_nationkey * 3.0 - 86 AS y2 FROM nation"


@register(f"SELECT event_id, n_nationkey FROM ({VISITS}) v JOIN ({ZONES}) z ON lon BETWEEN x1 AND x2 AND lat BETWEEN y1 AND y2")
def geo_spatial_join(q: Query) -> DataFrame:
    visits = q.base(q.catalog.object("visits")).select("event_id", geo.point("lon", "lat").alias("spot"))
    key = F.col("n_nationkey")

    @F.pandas_udf("binary")
    def box(k):  # noqa: ANN001, ANN202
        return k.map(lambda n: geo.encode(geo.POLYGON, [[(n * 7.0 - x, n * 3.0 - y) for x, y in ((90, 90), (85, 90), (85, 86), (90, 86), (90, 90))]]))

    zones = q.base(q.catalog.object("nation")).select("n_nationkey", box(key.cast("double")).alias("zone"))
    return spatial.spatial_join(visits, zones, "spot", "zone", "WITHIN", resolution=3).select("event_id", "n_nationkey")


@register(
    f"""WITH v AS (SELECT *, floor((lon + 180) / {grid.cell_degrees(2)!r})::BIGINT AS cx, floor((lat + 90) / {grid.cell_degrees(2)!r})::BIGINT AS cy FROM ({VISITS})),
    d AS (SELECT event_type, {2 << 58} + cx * {1 << 29} + cy AS cell, sum(value) AS w FROM v GROUP BY ALL),
    n AS (SELECT event_type, count(*) AS total FROM events GROUP BY ALL)
    SELECT d.event_type, cell, round(total * w / sum(w) OVER (PARTITION BY d.event_type), 6) AS spread FROM d JOIN n ON n.event_type = d.event_type"""
)
def h3_distribution(q: Query) -> DataFrame:
    visits = q.base(q.catalog.object("visits")).withColumn("cell", grid.point_cell(F.col("lon"), F.col("lat"), 2))
    weights = visits.groupBy("event_type", "cell").agg(F.sum("value").alias("w"))
    totals = visits.groupBy("event_type").agg(F.count(F.lit(1)).alias("total"))
    return spatial.distribution(totals, weights, "event_type", "total", "w").select("event_type", "cell", F.round("spread", 6).alias("spread"))


@register("SELECT event_type, count(*) AS _rows_count, t::INT AS tick FROM events, range(1, 4) r(t) GROUP BY event_type, t")
def subscription_ticks(q: Query) -> DataFrame:
    return subscription.ticked(lambda: q.buckets("events", ["event_type"], [Agg("_rows_count")]), 3)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Query(build(spark, sf_dir)))) for name, f in QUERIES.items()}
