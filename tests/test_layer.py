"""Edges of the semantic layer on small in-line frames."""

import struct

import pytest
from pyspark.sql import functions as F

from spindle.functions import geo, grid
from spindle.functions import json as J
from spindle.functions import ranges as R
from spindle.functions import time as X
from spindle.model import Catalog, Context, DataObject, Field, FunctionDef, Permission, Relation
from spindle.operators import spatial
from spindle.plans.query import Agg, Branch, Col, Query, Rel, repacked, with_deleted
from spindle.sources import readers, sinks
from spindle.sources.versioned import Store
from spindle.streaming import subscription


@pytest.fixture()
def catalog(spark):
    products = spark.createDataFrame(
        [(1, "pen", 2.0, 1, '{"k": 1, "t": ["a"]}'), (2, "ink", None, 1, None), (3, "pad", 5.0, None, '{"k": null}'), (4, "cap", 3.0, 2, "{}")],
        "id int, name string, price double, category int, tags string",
    )
    categories = spark.createDataFrame([(1, "write", None), (2, "wear", 1), (3, "none", 1)], "id int, name string, parent int")
    marks = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (None, 11)], "product int, tag int")
    tags = spark.createDataFrame([(10, "new"), (11, "old")], "id int, name string")
    c = Catalog(spark)
    c.add(
        DataObject("products", lambda s: products, pk=("id",), relations=(
            Relation("category", "categories", "one", (("category", "id"),)),
            Relation("tags", "tags", "many", (("tag", "id"),), junction="marks", junction_keys=(("id", "product"),)))),
        DataObject("categories", lambda s: categories, pk=("id",), relations=(
            Relation("products", "products", "many", (("id", "category"),)), Relation("parent_of", "categories", "one", (("parent", "id"),)))),
        DataObject("marks", lambda s: marks), DataObject("tags", lambda s: tags, pk=("id",)),
        DataObject("alive", lambda s: products, soft_delete="price is not null", fields=(Field("double", sql="[price] * 2"), Field("fourfold", sql="[double] * 2"))),
        DataObject("asked", lambda s: products, fields=(Field("name", filter_required=True),)),
    )
    return c


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_null_conditions_vanish_and_empty_lists_match_nothing(catalog):
    q = Query(catalog)
    assert ids(q.select("products", ["id"], {"price": {"gt": None}, "_or": [{"name": {"eq": None}}], "_not": {}})) == [1, 2, 3, 4]
    assert ids(q.select("products", ["id"], {"id": {"in": []}})) == []
    assert ids(q.select("products", ["id"], {"price": {"is_null": True}})) == [2]
    assert ids(q.select("products", ["id"], {"category": {"any_of": None} if False else None})) == [1, 2, 3, 4]


def test_quantifiers(catalog):
    q = Query(catalog)
    assert ids(q.select("categories", ["id"], {"products": {"any_of": {"price": {"gt": 1}}}})) == [1, 2]
    assert ids(q.select("categories", ["id"], {"products": {"none_of": {"price": {"gt": 1}}}})) == [3]
    # a NULL price is neither more nor less: it doesn't disqualify; a category without products is not "all"
    assert ids(q.select("categories", ["id"], {"products": {"all_of": {"price": {"gt": 1}}}})) == [1, 2]
    assert ids(q.select("products", ["id"], {"tags": {"any_of": {"name": {"eq": "old"}}}})) == [1]
    assert ids(q.select("products", ["id"], {"_not": {"tags": {"any_of": {"name": {"eq": "new"}}}}})) == [3, 4]
    assert ids(q.select("products", ["id"], {"category": {"name": {"eq": "wear"}}})) == [4]


def test_lists_of_no_children_are_null_and_null_keys_never_match(catalog):
    rows = {r["id"]: r for r in Query(catalog).select("categories", ["id", Rel("products", ("id",)), Rel("parent_of", ("name",))]).collect()}
    assert rows[3]["products"] is None and len(rows[1]["products"]) == 2
    assert rows[1]["parent_of"] is None and rows[2]["parent_of"]["name"] == "write"
    rows = {r["id"]: r for r in Query(catalog).select("products", ["id", Rel("tags", ("name",), order_by=("name",))]).collect()}
    assert [t["name"] for t in rows[1]["tags"]] == ["new", "old"] and rows[3]["tags"] is None


def test_limits_before_and_per_parent(catalog):
    q = Query(catalog)
    first = q.select("categories", ["id", Rel("products", ("id",), order_by=("id",), limit=1)]).collect()
    assert {r["id"]: r["products"] and len(r["products"]) for r in first} == {1: 1, 2: None, 3: None}
    each = q.select("categories", ["id", Rel("products", ("id",), nested_order_by=(("id", "desc"),), nested_limit=1)]).collect()
    assert {r["id"]: r["products"] and r["products"][0]["id"] for r in each} == {1: 2, 2: 4, 3: None}
    inner = q.select("categories", ["id", Rel("products", ("id",), inner=True)], order_by=("id",), limit=5)
    assert ids(inner) == [1, 2]


def test_aggregates_keep_nulls_and_count_distinct(catalog):
    row = Query(catalog).aggregate("products", [Agg("category", "count"), Agg("price", "list"), Agg("_rows_count"), Agg("price", "last", order="id"), Agg("price", "any", order="id")]).first()
    assert row["category_count"] == 2 and sorted(row["price_list"], key=str) == [2.0, 3.0, 5.0, None] and row["_rows_count"] == 4 and row["price_last"] == 3.0 and row["price_any"] == 2.0


def test_branch_keys_need_a_branch(catalog):
    df = Query(catalog).buckets("products", ["category"], branches=[Branch((Agg("_rows_count", alias="n"),), {"price": {"gt": 4}}, "a_"), Branch((Agg("price", "max"),), {"name": {"eq": "cap"}}, "b_")])
    assert {(r["category"], r["a_n"], r["b_price_max"]) for r in df.collect()} == {(None, 1, None), (2, 0, 3.0)}


def test_sub_aggregate_counts_parents(catalog):
    row = Query(catalog).sub_aggregate("categories", "products", [Agg("price", "avg", "a")], [("_rows_count", "count"), ("a", "avg")]).first()
    assert row["_rows_count"] == 3 and row["a_avg"] == 2.5


def test_soft_delete_and_calculated_fields(catalog):
    q = Query(catalog)
    assert ids(q.select("alive", ["id"])) == [1, 3, 4] and ids(with_deleted(q).select("alive", ["id"])) == [1, 2, 3, 4]
    assert q.select("alive", ["fourfold"], {"id": {"eq": 3}}).first()[0] == 20.0
    with pytest.raises(ValueError, match="required"):
        q.select("asked", ["id"])


def test_permissions(catalog):
    catalog.grant("clerk", Permission("products", "*", filter={"category": {"eq": "[$auth.category]"}}), Permission("products", "price", hidden=True), Permission("tags", "*", disabled=True))
    q = Query(catalog, Context("clerk", variables={"category": 1}))
    assert [(r[0], r[1]) for r in q.select("products", ["id", "price"], order_by=("id",)).collect()] == [(1, None), (2, None)]
    assert Query(catalog, Context("clerk")).select("products", ["id"]).count() == 0
    with pytest.raises(PermissionError):
        q.select("tags", ["id"])
    assert ids(q.select("categories", ["id"], {"products": {"any_of": {"id": {"gt": 0}}}})) == [1]
    assert q.aggregate("products", [Agg("price", "max")]).first()[0] is None
    assert [tuple(r) for r in q.buckets("products", ["price"], [Agg("_rows_count")]).collect()] == [(None, 2)]
    with pytest.raises(PermissionError):
        q.select("products", ["id"], order_by=("price",), limit=1)
    catalog.grant("clerk", Permission("products", "id", disabled=True))
    for asked in (lambda: q.aggregate("products", [Agg("id", "sum")]), lambda: q.buckets("products", ["id"]), lambda: q.select("products", ["price"], {"_and": [{"_not": {"id": {"gt": 0}}}]}),
                  lambda: q.select("categories", ["id"], {"products": {"any_of": {"id": {"gt": 0}}}}), lambda: q.aggregate("categories", [Agg("products.id", "sum")])):
        with pytest.raises(PermissionError):
            asked()


def test_json(catalog):
    q = Query(catalog)
    assert ids(q.select("products", ["id"], {"tags_": None, "_and": [{"_not": None}]})) == [1, 2, 3, 4]
    df = q.base(catalog.object("products"))
    pick = lambda c: ids(df.where(c).select("id"))
    assert pick(J.has(F.col("tags"), "k")) == [1, 3] and pick(J.has_all(F.col("tags"), ["k", "t"])) == [1]
    assert pick(J.contains(F.col("tags"), {"k": 1})) == [1] and pick(J.contains(F.col("tags"), {"t": ["a"]})) == [1] and pick(J.contains(F.col("tags"), {"k": None})) == [3]
    assert pick(J.equals(F.col("tags"), {})) == [4]


def test_ranges(spark):
    df = spark.range(1).select(R.literal("[1,5)").alias("r"), R.literal("(,3]").alias("s"))
    row = df.select(R.contains(F.col("r"), F.lit(5)), R.contains(F.col("r"), F.lit(1)), R.intersects(F.col("r"), F.col("s")), R.includes(F.col("s"), F.col("r")),
                    R.intersects(F.col("r"), R.literal("[5,9]")), R.includes(F.col("s"), R.literal("[2,3]"))).first()
    assert list(row) == [False, True, True, False, False, True]


@pytest.mark.parametrize(("text", "value"), [("2 hours", 7200), ("1h30m", 5400), ("P1DT2H", 93600), ("90", 90), ("1 month", 2592000), (15, 15), ("-P1D", -86400)])
def test_intervals(text, value):
    assert X.seconds(text) == value


def test_struct_repack(spark):
    df = spark.sql("SELECT named_struct('a', 1, 'b', named_struct('c', 2, 'd', 3)) AS s, array(named_struct('x', 1, 'y', 2)) AS l, CAST(NULL AS struct<a: int>) AS n")
    row = df.select(repacked(F.col("s"), (("a", "z"), ("b", "b", ("c",))), df.schema["s"].dataType).alias("s"), repacked(F.col("l"), ("y",), df.schema["l"].dataType).alias("l"),
                    repacked(F.col("n"), ("a",), df.schema["n"].dataType).alias("n")).first()
    assert row["s"].asDict(True) == {"z": 1, "b": {"c": 2}} and row["l"][0].asDict() == {"y": 2} and row["n"] is None


def test_geometry():
    square = geo.encode(geo.POLYGON, [[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]])
    line, spot = geo.encode(geo.LINE, [(-1, 2), (5, 2)]), geo.encode(geo.POINT, [3, 3])
    s, l, p = geo.Shape(square), geo.Shape(line), geo.Shape(spot)  # noqa: E741
    assert geo.area(s) == 15 and geo.length(l) == 6 and geo.length(s, closed=True) == 20
    assert geo.contains(s, p) and geo.intersects(s, l) and not geo.contains(s, l) and not geo.contains(s, geo.Shape(geo.encode(geo.POINT, [1.5, 1.5])))
    assert geo.distance(p, geo.Shape(geo.encode(geo.POINT, [6, 7]))) == 5
    assert geo.Shape(geo.transform(square, "Centroid")).points[0] == pytest.approx((30.5 / 15, 30.5 / 15))
    there = geo.transform(geo.transform(spot, "Transform", 0, 3857), "Transform", 0, 4326)
    assert geo.Shape(there).points[0] == pytest.approx((3, 3))
    assert len(geo.Shape(geo.transform(line, "Simplify", 0.5)).lines[0]) == 2
    assert geo.area(geo.Shape(geo.transform(square, "Envelope"))) == 16


def test_spatial_join_and_cells(spark):
    spots = spark.createDataFrame([(k, float(k % 10), float(k // 10)) for k in range(60)], "id int, x double, y double").select("id", geo.point("x", "y").alias("g"))
    boxes = spark.createDataFrame([(n, bytearray(geo.encode(geo.POLYGON, [[(n, n), (n + 3, n), (n + 3, n + 2), (n, n + 2), (n, n)]]))) for n in range(4)], "box int, z binary")
    want = {(k, n) for k in range(60) for n in range(4) if n <= k % 10 <= n + 3 and n <= k // 10 <= n + 2}
    for resolution in (1, 4):
        got = spatial.spatial_join(spots, boxes, "g", "z", "WITHIN", resolution=resolution)
        assert sorted((r["id"], r["box"]) for r in got.collect()) == sorted(want)
    apart = spatial.spatial_join(spots, boxes, "g", "z", "DISJOIN", resolution=2)
    assert ids(apart) == sorted(set(range(60)) - {k for k, _ in want})
    near = spatial.spatial_join(spots.where("id = 0"), spots.where("id in (0, 1)"), "g", "g", "DWITHIN", 5000.0)
    assert near.count() == 1
    cells = spatial.by_cell(spots.withColumn("c", F.array(F.lit(1), F.lit(2))), F.col("c"), {"s": F.col("id")}, divide=True)
    assert {r["_cell"]: (r["_rows_count"], r["s"]) for r in cells.collect()} == {1: (30, 885.0), 2: (30, 885.0)}
    row = spark.range(1).select(grid.cell_centre(grid.point_cell(F.lit(10.0), F.lit(20.0), 3), 3).alias("c")).first()["c"]
    assert abs(row["lon"] - 10) <= grid.cell_degrees(3) / 2 and abs(row["lat"] - 20) <= grid.cell_degrees(3) / 2


def test_spatial_join_evaluates_each_side_once(spark):
    spots = spark.createDataFrame([(0, 1.0, 1.0), (1, None, 1.0), (2, 9.0, 9.0), (3, 3.0, 2.0)], "id int, x double, y double").select("id", geo.point("x", "y").alias("g"))
    assert [r["g"] and bytes(r["g"]) for r in spots.orderBy("id").collect()] == [geo.encode(geo.POINT, [1, 1]), None, geo.encode(geo.POINT, [9, 9]), geo.encode(geo.POINT, [3, 2])]
    big = b"\x00" + bytes([0, 0, 0, 1]) + struct.pack(">dd", 1, 2)  # a big-endian point takes the general way
    box = [(1, 1), (3, 1), (3, 2), (1, 2), (1, 1)]
    shapes = [(0, bytearray(geo.encode(geo.POLYGON, [box]))), (1, None), (2, bytearray(big)), (3, bytearray(geo.encode(geo.POINT, [1, 1])))]
    shapes = spark.createDataFrame(shapes, "k int, z binary")
    assert [r["b"] and tuple(r["b"]) for r in shapes.orderBy("k").select(grid.bounds(F.col("z")).alias("b")).collect()][2:] == [(1, 2, 1, 2), (1, 1, 1, 1)]
    got = spatial.spatial_join(spots, shapes, "g", "z", "INTERSECTS", resolution=2)
    assert sorted((r["id"], r["k"]) for r in got.collect()) == [(0, 0), (0, 3), (3, 0)]
    assert got._jdf.queryExecution().sparkPlan().toString().count("ArrowEvalPython") == 3  # both boxes and the exact test; each is a process in every running task


def test_mutations_and_time_travel(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.create("t", spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"))
    with store.begin() as t:
        out = t.insert("t", spark.createDataFrame([("c",), ("d",)], "v string"), key="id", stamp={"v": "x"})
        assert (out.affected_rows, out.last_id) == (2, 4)
        assert t.update("t", {"v": "z"}, "id = 1", allowed="id < 2").affected_rows == 1
        assert t.delete("t", "id = 2").affected_rows == 1
    assert {(r["id"], r["v"]) for r in store.read("t").collect()} == {(1, "z"), (3, "x"), (4, "x")}
    assert ids(store.read("t", version=1)) == [1, 2]
    with pytest.raises(RuntimeError), store.begin() as t:
        t.delete("t", "true")
        raise RuntimeError("undo")
    assert store.read("t").count() == 3
    store.create("kids", spark.createDataFrame([], "kid long, parent long, n string"))
    with store.begin() as t:
        assert t.insert_nested("t", spark.createDataFrame([("p",)], "v string"), "id", {"kids": (spark.createDataFrame([("k",)], "n string"), "parent", "kid")}).affected_rows == 2
    assert store.read("kids").first()["parent"] == 5
    with store.begin() as t:
        t.merge("t", spark.createDataFrame([(5, "q"), (9, "r")], "id long, v string"), ["id"])
    assert {r["id"]: r["v"] for r in store.read("t").collect()}[5] == "q" and store.read("t").count() == 5


def test_sources_sinks_and_catalog_views(spark, catalog, tmp_path):
    catalog.spark.range(3).write.parquet(str(tmp_path / "p"))
    assert readers.source("parquet", path=str(tmp_path / "p"))(spark).count() == 3

    @readers.plugin("numbers")
    def numbers(s, n):
        return s.range(n)

    assert readers.source("numbers", n=4)(spark).count() == 4
    df = spark.sql("SELECT 1 AS a, named_struct('b', 2, 'c', array(1)) AS s, timestamp'2024-01-02 03:04:05' AS t, CAST(NULL AS int) AS n")
    assert sinks.to_json(df).first()[0] == '{"a":1,"s":{"b":2,"c":[1]},"t":"2024-01-02T03:04:05.000Z","n":null}'
    assert sinks.flattened(df).columns == ["a", "s.b", "s.c", "t", "n"]
    spot = spark.range(1).select(F.col("id"), geo.point(F.lit(1.0), F.lit(2.0)).alias("g"))
    assert sinks.geojson(spot, "g", "id").first()[0] == '{"type":"Feature","id":0,"geometry":{"type": "Point", "coordinates": [1.0, 2.0]},"properties":{"id":0}}'
    cache = sinks.ResultCache()
    a = cache.get(("admin", "x"), lambda: spark.range(2), tags=("t",))
    assert cache.get(("admin", "x"), lambda: spark.range(9)) is a and cache.invalidate("t") == 1
    assert {r["name"] for r in readers.objects_frame(catalog).collect()} >= {"products", "tags"}
    assert {(r["name"], r["scalar"]) for r in readers.fields_frame(catalog, "tags").collect()} == {("id", "Int"), ("name", "String")}
    assert readers.relations_frame(catalog).where("kind = 'm2m'").count() == 1 and readers.search(catalog, "tags").first()["name"] == "tags"


def test_functions_and_defaults(catalog):
    catalog.add_function(FunctionDef("mine", sql="concat([who], [x])", args=("who", "x"), defaults={"who": "user"}), FunctionDef("up", call=lambda s: F.upper(s), args=("s",)))
    q = Query(catalog, Context(user="eve"))
    df = q.base(catalog.object("tags"))
    assert [r[0] for r in df.orderBy("id").select(q.call("mine", x="$name")).collect()] == ["evenew", "eveold"]
    assert df.select(q.call("up", s=F.col("name"))).first()[0] == "NEW"
    with pytest.raises(ValueError, match="dimensions") if False else pytest.raises(KeyError):
        q.select("nothing", ["id"])


def test_streams(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, id) AS ts, id % 2 AS k, CAST(id AS double) AS v FROM range(20)").repartition(2).write.parquet(str(tmp_path / "in"))
    stream = subscription.file_stream(spark, str(tmp_path / "in"), "ts timestamp, k long, v double")
    query = subscription.windowed(stream, "ts", "10 minutes", None, "1 hour", ["k"], "v").writeStream.outputMode("complete").format("memory").queryName("spindle_w").start()
    query.processAllAvailable()
    query.stop()
    assert {(r["k"], r["n"]) for r in spark.sql("SELECT k, sum(n) AS n FROM spindle_w GROUP BY k").collect()} == {(0, 10), (1, 10)}
    seen = []
    subscription.subscribe({"a": lambda: spark.range(2), "b": lambda: spark.range(3)}, lambda p, k, df: seen.append((p, k, df.count())), count=2)
    assert sorted(seen) == [("a", 1, 2), ("a", 2, 2), ("b", 1, 3), ("b", 2, 3)]
    assert [len(b) for b in subscription.batches(spark.range(5), 2)] == [2, 2, 1]


def test_aggregates_of_transforms_keep_permissions(catalog):
    catalog.grant("guest", Permission("products", "tags", disabled=True))
    agg = Agg("tags", "max", "k", of=Col("tags", path="k", kind="number"))
    assert Query(catalog).aggregate("products", [agg]).first()["k"] == 1.0
    with pytest.raises(PermissionError):
        Query(catalog, Context(role="guest")).aggregate("products", [agg])
    with pytest.raises(ValueError):
        Query(catalog).aggregate("products", [Agg("id", "max", of=Col("tags", path="k"))])


def test_sub_aggregate_needs_pairs_for_each_level(catalog):
    with pytest.raises(ValueError):
        Query(catalog).sub_aggregate("products", "category", [Agg("id")], [("_rows_count", "count")], middle=([("a", "max")],))


def test_json_cast_of_structures(spark):
    df = spark.range(2).select("id", F.array(F.struct(F.col("id").alias("k"))).alias("v"))
    assert [r[0] for r in df.select(J.cast_result(df, F.col("v"), "array<struct<k string>>")[0]["k"]).collect()] == ["0", "1"]
