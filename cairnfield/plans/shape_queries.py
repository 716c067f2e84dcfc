"""Registered queries of shapes on a screen, with their SQL: a polyline or polygon for each order, clicks of customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.functions import shapes
from cairnfield.plans.queries import _query, _table
from cairnfield.plans.route_queries import _STRIPS, _sections


def _shapes(spark: SparkSession, d: str) -> DataFrame:
    """(o, n, kind, points): points 10 apart in x, as high as the quantities; every third is a polygon."""
    s = _sections(spark, d).withColumn("q", F.slice("s", F.lit(1), F.col("n")))
    points = F.transform("q", lambda v, i: F.struct((i * 10.0).alias("x"), v.alias("y"), F.lit(0.0).alias("z")))
    kind = F.when((F.col("o") % 3 == 0) & (F.col("n") > 2), "polygon").when(F.col("o") % 7 == 1, "segment").otherwise("polyline")
    return s.select("o", "n", kind.alias("kind"), points.alias("points"))


_KINDS = f"{_STRIPS}, k AS (SELECT o, q, len(q) AS n, CASE WHEN o % 3 = 0 AND len(q) > 2 THEN 'polygon' WHEN o % 7 = 1 THEN 'segment' ELSE 'polyline' END AS kind FROM q)"
_TEXT = "array_to_string(list_transform({0}, lambda v: v::BIGINT::VARCHAR), ' ')"


@_query(f"""WITH {_KINDS} SELECT o, {_TEXT.format('list_transform(q, lambda v, i: CASE WHEN i = 2 THEN -5 ELSE v END)')} AS moved,
CASE WHEN kind <> 'segment' AND n > o % 4 THEN {_TEXT.format('list_concat(list_concat(q[1:o % 4 + 1], [-7.0]), q[o % 4 + 2:])')} END AS grown,
CASE WHEN kind <> 'segment' AND n > o % 4 AND n > CASE kind WHEN 'polygon' THEN 3 ELSE 2 END THEN {_TEXT.format('list_concat(q[1:o % 4], q[o % 4 + 2:])')} END AS less FROM k""")
def edited_shapes(spark: SparkSession, d: str) -> DataFrame:
    """One vertex moved, one put in, one taken out, where the kind and the number of vertices let it."""
    at = lambda y: F.struct(F.lit(0.0).alias("x"), F.lit(y).alias("y"), F.lit(0.0).alias("z"))
    s, i = _shapes(spark, d), (F.col("o") % 4).cast("int")
    text = lambda c: F.array_join(F.transform(c, lambda p: p["y"].cast("long").cast("string")), " ")
    p, kind = F.col("points"), F.col("kind")
    return s.select("o", text(shapes.moved_vertex(p, F.lit(1), at(-5.0))).alias("moved"), text(shapes.with_vertex(p, kind, i, at(-7.0))).alias("grown"), text(shapes.without_vertex(p, kind, i)).alias("less"))


_AT = "o % 60 + 0.37::DOUBLE AS px, (o * 7 % 50)::DOUBLE AS py"


@_query(f"""WITH {_KINDS}, e AS (SELECT o, n, kind, {_AT}, i, i * 10.0::DOUBLE AS sx, q[i + 1] AS sy, (i + 1) % n * 10.0::DOUBLE AS ex, q[(i + 1) % n + 1] AS ey FROM (SELECT *, unnest(range(n)) AS i FROM k)),
t AS (SELECT *, CASE WHEN sx = ex AND sy = ey THEN 0 ELSE least(1, greatest(0, ((px - sx) * (ex - sx) + (py - sy) * (ey - sy)) / ((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy)))) END AS t FROM e WHERE n > 1 AND (kind = 'polygon' OR kind = 'polyline' AND i < n - 1)),
d AS (SELECT *, sqrt((px - sx - t * (ex - sx)) ** 2 + (py - sy - t * (ey - sy)) ** 2) AS d FROM t), b AS (SELECT o, arg_min(i, (round(d, 9), -i)) AS after, round(arg_min(sx + (ex - sx) * t, (round(d, 9), -i)), 6) AS x FROM d WHERE d <= 8 GROUP BY o),
v AS (SELECT o, i, sqrt((px - sx) ** 2 + (py - sy) ** 2) AS d FROM e), w AS (SELECT o, arg_min(i, (d, -i)) AS vertex FROM v WHERE d <= 9 GROUP BY o)
SELECT k.o, after::INT AS after, x, vertex::INT AS vertex FROM k LEFT JOIN b ON b.o = k.o LEFT JOIN w ON w.o = k.o""")
def nearest_parts(spark: SparkSession, d: str) -> DataFrame:
    """The edge and the vertex of each shape that are nearest to a pixel."""
    px, py = F.col("o") % 60 + F.lit(0.37), (F.col("o") * 7 % 50).cast("double")
    edge = shapes.nearest_edge(F.col("points"), F.col("kind"), px, py)
    got = _shapes(spark, d).select("o", edge.alias("e"), shapes.nearest_vertex(F.col("points"), px, py).alias("vertex"))
    return got.select("o", "e.after", F.round("e.point.x", 6).alias("x"), "vertex")


@_query(f"""WITH {_KINDS}, c AS (SELECT o, (o % 60)::DOUBLE AS px, (o * 7 % 50)::DOUBLE AS py, n, q FROM k), f AS (SELECT o, px, py, [i - 1 FOR i IN range(1, n + 1) IF sqrt(((i - 1) * 10 - px) ** 2 + (q[i] - py) ** 2) <= 9] AS near, q FROM c)
SELECT o, CASE WHEN o % 5 = 0 THEN 'plane' WHEN len(near) > 0 AND o % 2 = 0 THEN 'feature' ELSE 'surface' END AS kind FROM f""")
def snapped_clicks(spark: SparkSession, d: str) -> DataFrame:
    """Where a click lands: on a vertex of a shape (even orders), on the surface, or on the plane where there is none."""
    px, py = (F.col("o") % 60).cast("double"), (F.col("o") * 7 % 50).cast("double")
    none = F.array().cast("array<struct<x:double,y:double,z:double>>")
    at = F.struct(px.alias("x"), py.alias("y"), F.lit(1.0).alias("z"))
    features = F.when((F.col("o") % 2 == 0) & (F.col("o") % 5 != 0), F.col("points")).otherwise(none)
    got = shapes.snapped(px, py, features, none, F.when(F.col("o") % 5 != 0, at), at)
    return _shapes(spark, d).select("o", got["kind"].alias("kind"))


@_query(f"""WITH {_KINDS}, f AS (SELECT o, kind, n, list_transform(q, lambda v: v + o % 900) AS ys, (o * 13 % 1000)::DOUBLE AS x0 FROM k WHERE n > 1),
e AS (SELECT o, kind, i, n, x0, x0 + i * 10 AS sx, ys[i + 1] AS sy, x0 + (i + 1) % n * 10 AS ex, ys[(i + 1) % n + 1] AS ey FROM (SELECT *, unnest(range(n)) AS i FROM f)),
c AS (SELECT c_custkey AS click, (c_custkey * 37 % 1000)::DOUBLE AS px, (c_custkey * 53 % 900)::DOUBLE AS py FROM customer),
m AS (SELECT click, px, py, e.*, CASE WHEN sx = ex AND sy = ey THEN 0 ELSE least(1, greatest(0, ((px - sx) * (ex - sx) + (py - sy) * (ey - sy)) / ((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy)))) END AS t FROM c, e WHERE x0 BETWEEN px - 300 AND px + 20 AND o % 900 BETWEEN py - 80 AND py + 20),
d AS (SELECT click, o, min(CASE WHEN kind = 'polygon' OR i < n - 1 THEN sqrt((px - sx - t * (ex - sx)) ** 2 + (py - sy - t * (ey - sy)) ** 2) END) AS d,
 any_value(kind) = 'polygon' AND count(*) FILTER ((sy > py) <> (ey > py) AND px < (ex - sx) * (py - sy) / nullif(ey - sy, 0) + sx) % 2 = 1 AS inside FROM m GROUP BY click, o)
SELECT click, arg_min(o, (CASE WHEN inside THEN 0 ELSE d END, -o)) AS id FROM d WHERE inside OR d <= 8 GROUP BY click""")
def picked_shapes(spark: SparkSession, d: str) -> DataFrame:
    """The shape that each customer's click picks."""
    k, o = F.col("c_custkey"), F.col("o")
    clicks = _table(spark, d, "customer").select(k.alias("click"), (k * 37 % 1000).cast("double").alias("px"), (k * 53 % 900).cast("double").alias("py"))
    moved = F.transform("points", lambda p: F.struct((p["x"] + o * 13 % 1000).alias("x"), (p["y"] + o % 900).alias("y"), p["z"].alias("z")))
    f = _shapes(spark, d).where("n > 1").select(o.alias("ord"), o.alias("id"), "kind", moved.alias("points"), F.lit(None).cast("double").alias("size"))
    return shapes.picked(clicks, f)


@_query(f"WITH {_KINDS} SELECT o, round((n - 1) * 5.0::DOUBLE, 6) AS x, round(list_sum(q) / n, 6) AS y FROM k")
def shape_centres(spark: SparkSession, d: str) -> DataFrame:
    got = _shapes(spark, d).select("o", shapes.centre(F.col("points")).alias("c"))
    return got.select("o", F.round("c.x", 6).alias("x"), F.round("c.y", 6).alias("y"))


@_query("""SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'bundle' WHEN 1 THEN 'submission' WHEN 2 THEN 'submission' ELSE 'file' END AS kind, c_custkey % 50 = 1 AND c_custkey % 4 IN (1, 2) AS oversized FROM customer""")
def document_types(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    member = F.element_at(F.array(*map(F.lit, ('"contentHash":"x","createdAt":1', '"createdAt":"now"', '"submitter":{"contentHash":1}', '"records":[{"createdAt":1}]'))), (k % 4 + 1).cast("int"))
    text = F.concat(F.lit("{"), member, F.lit(',"pad":"'), F.when(k % 50 == 1, F.repeat(F.lit("é"), F.lit(140_000))).otherwise(""), F.lit('"}'))
    kind = shapes.document_type(F.col("text"))
    return _table(spark, d, "customer").select(k.alias("id"), text.alias("text")).select("id", kind.alias("kind"), ((kind == "submission") & shapes.oversized(F.col("text"), kind)).alias("oversized"))


