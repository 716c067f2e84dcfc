"""Registered queries of the map operators over the driver tables, and the same in DuckDB SQL.

The tables hold no map, so customers and suppliers stand in as entities: a position, kind, team and
lane are derived from their columns, over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.functions.geometry import Vec, cell, distance, half_up, in_box, look_at, path_measure, point_in_ring, region, ring_area
from cairnfield.operators import entities as E
from cairnfield.operators.entities import EntityList
from cairnfield.operators.sequence import ORD, Seq
from cairnfield.plans import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The derived positions, as SQL for both engines.
_CUSTOMER = """SELECT c_custkey AS ord, c_custkey AS id, c_mktsegment AS kind, c_acctbal AS x, CAST((c_custkey * 7919) % 10000 AS DOUBLE) AS y,
 CAST((c_custkey * 31) % 700 AS DOUBLE) AS z, 2 + c_nationkey % 2 AS team, CAST(1 + c_custkey % 3 AS INT) AS lane FROM customer"""
_SUPPLIER = """SELECT s_suppkey AS ord, s_suppkey AS id, s_acctbal AS x, CAST((s_suppkey * 6101) % 10000 AS DOUBLE) AS y, CAST((s_suppkey * 17) % 700 AS DOUBLE) AS z FROM supplier"""
_DIST = "sqrt((c.x-s.x)*(c.x-s.x)+(c.y-s.y)*(c.y-s.y)+(c.z-s.z)*(c.z-s.z))"
_C, _S = f"c AS ({_CUSTOMER})", f"s AS ({_SUPPLIER})"


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def customers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return _table(spark, d, "customer").select(
        k.alias(ORD), k.alias("id"), F.col("c_mktsegment").alias("kind"), F.col("c_acctbal").alias("x"), ((k * 7919) % 10000).cast("double").alias("y"), ((k * 31) % 700).cast("double").alias("z"), (F.col("c_nationkey") % 2 + 2).alias("team"), (k % 3 + 1).cast("int").alias("lane")
    )


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return _table(spark, d, "supplier").select(k.alias(ORD), k.alias("id"), F.col("s_acctbal").alias("x"), ((k * 6101) % 10000).cast("double").alias("y"), ((k * 17) % 700).cast("double").alias("z"))


def _query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@_query(f"""WITH {_C}, {_S}, p AS (SELECT c.id, s.id AS target, {_DIST} AS dist, row_number() OVER (PARTITION BY c.id ORDER BY {_DIST}, s.ord) AS r FROM c, s)
SELECT id, target, floor(dist * 1000 + 0.5) / 1000 AS dist FROM p WHERE r = 1""")
def closest(spark: SparkSession, d: str) -> DataFrame:
    """The nearest supplier of every customer."""
    got = E.nearest(customers(spark, d), suppliers(spark, d))
    return got.select("id", F.col("r_id").alias("target"), half_up(F.col("dist"), 3).alias("dist"))


@_query(f"""WITH {_C}, {_S}, p AS (SELECT c.id, s.id AS target, {_DIST} AS dist, row_number() OVER (PARTITION BY c.id ORDER BY {_DIST}, s.ord) AS r FROM c, s WHERE {_DIST} <= 1500)
SELECT id, CAST(r AS INT) AS rank, target, floor(dist * 1000 + 0.5) / 1000 AS dist FROM p WHERE r <= 3""")
def closest_three_in_reach(spark: SparkSession, d: str) -> DataFrame:
    got = E.nearest(customers(spark, d), suppliers(spark, d), k=3, radius=1500.0)
    return got.select("id", F.col("rank").cast("int").alias("rank"), F.col("r_id").alias("target"), half_up(F.col("dist"), 3).alias("dist"))


@_query(f"WITH {_C}, {_S} SELECT id, kind FROM c WHERE EXISTS (SELECT 1 FROM s WHERE {_DIST} <= 400)")
def within(spark: SparkSession, d: str) -> DataFrame:
    return EntityList(customers(spark, d)).within(400.0, suppliers(spark, d)).df.select("id", "kind")


@_query(f"WITH {_C} SELECT id, kind, team FROM c WHERE kind = 'BUILDING' AND team = 2 AND lane = 1 AND z - 100 >= 200")
def entity_filters(spark: SparkSession, d: str) -> DataFrame:
    got = EntityList(E.as_entities(customers(spark, d))).of_kind("BUILDING").on_team(2).in_lane("yellow").from_source("extractor").high_ground(200.0, 100.0)
    return got.df.select("id", "kind", "team")


@_query(f"WITH {_C} SELECT CAST(floor(x / 1000) AS BIGINT) AS ix, CAST(floor(y / 1000) AS BIGINT) AS iy, CAST(floor(x / 1000) AS BIGINT)::VARCHAR || ',' || CAST(floor(y / 1000) AS BIGINT)::VARCHAR AS key, count(*) AS count FROM c GROUP BY ALL")
def density(spark: SparkSession, d: str) -> DataFrame:
    return E.density(customers(spark, d), 1000.0).df.select("ix", "iy", "key", "count")


@_query(f"WITH {_C} SELECT CAST(floor(x / 2000) AS BIGINT)::VARCHAR || ',' || CAST(floor(y / 2000) AS BIGINT)::VARCHAR AS key, (floor(x / 2000) + 0.5) * 2000 AS cx, count(*)::INT AS n, min(id) AS first_id FROM c GROUP BY 1, 2")
def group_by_region(spark: SparkSession, d: str) -> DataFrame:
    got = EntityList(customers(spark, d)).group_by_region(2000.0).df
    return got.select("region.key", F.col("region.center.x").alias("cx"), F.size("items").alias("n"), F.col("items")[0]["id"].alias("first_id"))


@_query(f"WITH {_C} SELECT a.id AS a_id, b.id AS b_id FROM c a JOIN c b ON a.kind = b.kind AND a.ord < b.ord WHERE sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) < 600")
def near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return E.near_duplicates(customers(spark, d), 600.0).select("a_id", "b_id")


@_query(f"WITH {_C} SELECT kind, count(*) AS n, min(ord) AS ord FROM c GROUP BY kind")
def tally(spark: SparkSession, d: str) -> DataFrame:
    return Seq(customers(spark, d)).tally("kind", "kind").df.select("kind", "n", ORD)


@_query(f"WITH {_C} SELECT kind, team, arg_min(id, ord) AS id FROM c GROUP BY kind, team")
def distinct_by_key(spark: SparkSession, d: str) -> DataFrame:
    return Seq(customers(spark, d)).distinct("kind", "team").df.select("kind", "team", "id")


@_query("WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders), l AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer) SELECT i AS ord, o_orderkey, c_custkey FROM o JOIN l USING (i)")
def zip_positions(spark: SparkSession, d: str) -> DataFrame:
    o = Seq(_table(spark, d, "orders").select(F.col("o_orderkey").alias(ORD), "o_orderkey"))
    c = Seq(_table(spark, d, "customer").select(F.col("c_custkey").alias(ORD), "c_custkey"))
    return o.zip(c).select(ORD, "a.o_orderkey", "b.c_custkey")


@_query("WITH o AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) SELECT i // 100 AS ord, count(*)::INT AS n, min(o_orderkey) AS first_key FROM o GROUP BY 1")
def chunks(spark: SparkSession, d: str) -> DataFrame:
    got = Seq(_table(spark, d, "orders").select(F.col("o_orderkey").alias(ORD), F.col("o_orderkey").alias("k"))).chunk(100)
    return got.df.select(ORD, F.size("items").alias("n"), F.col("items")[0]["k"].alias("first_key"))


@_query("WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) SELECT o_orderkey FROM o WHERE i % 7 = 3")
def where_index(spark: SparkSession, d: str) -> DataFrame:
    return Seq(_table(spark, d, "orders").select(F.col("o_orderkey").alias(ORD), "o_orderkey")).where_index(lambda i: i % 7 == 3).df.select("o_orderkey")


@_query(f"WITH {_S} SELECT a.id AS a_id, b.id AS b_id FROM s a JOIN s b ON a.ord < b.ord")
def pairs(spark: SparkSession, d: str) -> DataFrame:
    return Seq(suppliers(spark, d)).pairs(["id"]).select("a_id", "b_id")


@_query("SELECT n_regionkey, n_nationkey, unnest(string_split(n_name, '_')) AS part FROM nation")
def select_many(spark: SparkSession, d: str) -> DataFrame:
    n = _table(spark, d, "nation").withColumn(ORD, F.col("n_nationkey").cast("long"))
    return Seq(n).select_many(F.split("n_name", "_"), "part").df.select("n_regionkey", "n_nationkey", "part")


@_query(f"WITH {_C} SELECT id, x FROM c ORDER BY team DESC, x, ord LIMIT 25")
def order_then_take(spark: SparkSession, d: str) -> DataFrame:
    return Seq(customers(spark, d)).order_by_descending("team").then_by("x").take(25).df.select("id", "x")


@_query("SELECT arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS least, arg_min(o_orderkey, (-o_totalprice, o_orderkey)) AS most FROM orders")
def min_and_max(spark: SparkSession, d: str) -> DataFrame:
    s = Seq(_table(spark, d, "orders").select(F.col("o_orderkey").alias(ORD), "o_totalprice"))
    return s.min("o_totalprice").select(F.col(ORD).alias("least")).crossJoin(s.max("o_totalprice").select(F.col(ORD).alias("most")))  # one row each


@_query(f"WITH {_C} SELECT count(*) AS n, count(*) FILTER (kind = 'BUILDING') AS buildings, sum(y) AS total, bool_or(z > 690) AS any_high, bool_or(z > 900) AS any_higher, bool_and(z >= 0) AS all_up, bool_and(z > 5) AS all_over_5 FROM c")
def scalars(spark: SparkSession, d: str) -> DataFrame:
    s = Seq(customers(spark, d))
    z = F.col("z")
    parts = [
        s.count().withColumnRenamed("count", "n"), s.count(F.col("kind") == "BUILDING").withColumnRenamed("count", "buildings"), s.sum("y").withColumnRenamed("sum", "total"),
        s.any(z > 690).withColumnRenamed("any", "any_high"), s.any(z > 900).withColumnRenamed("any", "any_higher"), s.all(z >= 0).withColumnRenamed("all", "all_up"), s.all(z > 5).withColumnRenamed("all", "all_over_5"),
    ]
    return reduce(DataFrame.crossJoin, parts)  # one row each


#: Line numbers repeat within an order, so price and quantity take part in the order.
_LINE = "(l_linenumber * 100000000000000 + CAST(round(l_extendedprice * 100) AS BIGINT) * 1000 + CAST(l_quantity AS BIGINT))"
_ITEMS = f"SELECT l_orderkey AS path_id, {_LINE} AS ord, l_quantity AS x, l_extendedprice / 100 AS y, l_discount * 100 AS z FROM lineitem"


@_query(f"""WITH p AS ({_ITEMS}), d AS (SELECT path_id, ord, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy, lead(z) OVER w - z AS dz FROM p WINDOW w AS (PARTITION BY path_id ORDER BY ord))
SELECT path_id, count(*) AS n_points, round(coalesce(sum(sqrt(dx*dx+dy*dy+dz*dz)), 0), 3) AS distance, round(coalesce(sum(sqrt(dx*dx+dy*dy)), 0), 3) AS ground, round(coalesce(sum(dz), 0), 3) + 0.0 AS rise FROM d GROUP BY path_id""")
def routes_of_points(spark: SparkSession, d: str) -> DataFrame:
    """Line items as the points of a route: 3D length, ground length and rise of each."""
    p = F.struct(ORD, "x", "y", "z")
    r = items(spark, d).groupBy("path_id").agg(F.sort_array(F.collect_list(p)).alias("pts")).select("path_id", F.size("pts").cast("long").alias("n_points"), path_measure(F.col("pts")).alias("m"))
    return r.select("path_id", "n_points", *[(F.round(f"m.{c}", 3) + 0.0).alias(c) for c in ("distance", "ground", "rise")])


def items(spark: SparkSession, d: str) -> DataFrame:
    """Line items as points along the path of their order."""
    return _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("path_id"), F.expr(_LINE).alias(ORD), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 100).alias("y"), (F.col("l_discount") * 100).alias("z"))


@_query(
    f"WITH {_C}, r AS (SELECT *, 2000.0 AS a, 8000.0 AS b FROM c) SELECT id, x >= 2000 AND x <= 6000 AND y >= 1000 AND y <= 9000 AND z >= 0 AND z <= 300 AS in_box, "
    "(y < b) = (y >= a) AND (y >= a AND y < b) AND x < 6000 AND x >= 2000 AS in_ring FROM r"
)
def containment(spark: SparkSession, d: str) -> DataFrame:
    corners = [(2000.0, 2000.0), (6000.0, 2000.0), (6000.0, 8000.0), (2000.0, 8000.0)]
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in corners])
    return customers(spark, d).select("id", in_box(Vec.of(), (2000, 1000, 0), (6000, 9000, 300)).alias("in_box"), point_in_ring(F.col("x"), F.col("y"), ring).alias("in_ring"))


@_query(f"WITH {_S} SELECT id, round(abs(x * (y + z) - (x + 20) * y + (x + 20) * (y + 10) - x * (y + z) + x * y - x * (y + 10)) / 2, 3) AS area FROM s")
def ring_areas(spark: SparkSession, d: str) -> DataFrame:
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    ring = F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in ((x, y), (x + 20, y + z), (x, y + 10))])
    return suppliers(spark, d).select("id", F.round(ring_area(ring), 3).alias("area"))


@_query(f"WITH {_S}, h AS (SELECT id, degrees(atan2(100 - y, 200 - x)) AS a, degrees(-atan2(300 - z, sqrt((200-x)*(200-x)+(100-y)*(100-y)))) AS p FROM s) SELECT id, floor(p * 1000 + 0.5) / 1000 AS pitch, CASE WHEN floor(a * 1000 + 0.5) < 0 THEN floor(a * 1000 + 0.5) / 1000 + 360 ELSE floor(a * 1000 + 0.5) / 1000 END AS yaw FROM h")
def look_at_angles(spark: SparkSession, d: str) -> DataFrame:
    return suppliers(spark, d).select("id", look_at(Vec.of(), Vec.at(200, 100, 300)).alias("a")).select("id", "a.pitch", "a.yaw")


@_query("WITH r AS (SELECT DISTINCT user_id AS route, CAST(floor(value / 10) AS BIGINT) AS ix, CAST(floor(event_id / 1000) AS BIGINT) AS iy FROM events) SELECT ix::VARCHAR || ',' || iy::VARCHAR AS key, count(*) AS routes FROM r GROUP BY 1 ORDER BY routes DESC, key LIMIT 5")
def chokepoints(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "events").select(F.col("user_id").alias("route"), (F.col("value") / 10).alias("x"), (F.col("event_id") / 1000).alias("y"))
    return E.chokepoints(e, 1.0)


@_query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '7') AND c_acctbal >= 500")
def table_filter(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d, "customer").withColumn(ORD, F.col("c_custkey"))
    return tables.view(t, {"c_name": "7", "c_acctbal": ">= 500"}).select("c_custkey", "c_name")


@_query("SELECT p_partkey, p_brand FROM part ORDER BY CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INT) DESC, p_partkey LIMIT 20 OFFSET 20")
def table_page(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d, "part").withColumn(ORD, F.col("p_partkey"))
    return tables.page(t, 2, 20, sort="p_brand", descending=True).rows.select("p_partkey", "p_brand")


@_query("""SELECT s_suppkey AS ord, s_suppkey::VARCHAR || ',' || CASE WHEN regexp_matches(s_name, '[",\\r\\n]') THEN '"' || replace(s_name, '"', '""') || '"' ELSE s_name END AS line FROM supplier""")
def csv_export(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d, "supplier").select(F.col("s_suppkey").alias(ORD), "s_suppkey", "s_name")
    return tables.csv_lines(t)


@_query("""SELECT s_suppkey AS ord, '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || (s_suppkey)::DOUBLE::VARCHAR || ',' || (s_nationkey)::DOUBLE::VARCHAR || ',0.0]},"properties":{"geometry":"at","row":{"name":"' || s_name || '"}}}' AS feature FROM supplier""")
def geojson_export(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d, "supplier").select(F.col("s_suppkey").alias(ORD), F.array(F.col("s_suppkey").cast("double"), F.col("s_nationkey").cast("double"), F.lit(0.0)).alias("at"), F.col("s_name").alias("name"))
    return tables.geojson_features(t).select(ORD, "feature")


@_query("WITH a AS (SELECT n_regionkey AS fact, count(*) AS before FROM nation GROUP BY 1), b AS (SELECT c_nationkey AS fact, count(*) AS after FROM customer GROUP BY 1) SELECT fact, before, after, before IS NOT DISTINCT FROM after AS same FROM a FULL JOIN b USING (fact)")
def compare_facts(spark: SparkSession, d: str) -> DataFrame:
    a = _table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("fact")).agg(F.count("*").alias("value"))
    b = _table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("fact")).agg(F.count("*").alias("value"))
    return tables.compare_facts(a, b)


@_query("SELECT o_orderkey, o_orderstatus || CASE WHEN row_number() OVER w = 1 THEN '' ELSE '#' || (row_number() OVER w)::VARCHAR END AS id FROM orders WINDOW w AS (PARTITION BY o_orderstatus, o_custkey ORDER BY o_orderkey)")
def unique_ids(spark: SparkSession, d: str) -> DataFrame:
    o = _table(spark, d, "orders").select(F.col("o_orderkey").alias(ORD), F.concat_ws(":", F.col("o_orderstatus"), F.col("o_custkey").cast("string")).alias("base"), "o_orderstatus")
    got = o.withColumn("u", tables.unique_ids(o, "base"))
    return got.select(F.col(ORD).alias("o_orderkey"), F.concat(F.col("o_orderstatus"), F.regexp_extract("u", "(#.*)?$", 0)).alias("id"))


@_query(f"WITH {_C} SELECT id, CAST(floor(x / 512) AS BIGINT) AS ix, CAST(floor(y / 512) AS BIGINT)::VARCHAR AS iy, floor(sqrt(x*x + y*y + z*z) * 1000 + 0.5) / 1000 AS from_origin FROM c")
def cells_and_distances(spark: SparkSession, d: str) -> DataFrame:
    r = region(Vec.of(), 512.0)
    return customers(spark, d).select("id", cell(F.col("x"), 512.0).alias("ix"), F.split(r["key"], ",")[1].alias("iy"), half_up(distance(Vec.of(), Vec.at(0, 0, 0)), 3).alias("from_origin"))


from cairnfield.plans import bundle_queries, mesh_queries, route_queries, scene_queries, shape_queries, sight_queries  # noqa: E402, F401  (register the rest)
