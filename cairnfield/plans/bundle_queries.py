"""Registered queries of nested values, tiles, files and flow links, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.functions import nested
from cairnfield.operators import meshes, tiles
from cairnfield.plans.queries import _query, _table
from cairnfield.plans.route_queries import _STRIPS, _sections, strips

# nested values ----------------------------------------------------------------------------------


@_query("""WITH r AS (SELECT l_orderkey AS o, list(l_partkey ORDER BY l_linenumber, l_partkey, l_quantity) AS p, list(l_quantity ORDER BY l_linenumber, l_partkey, l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY 1),
i AS (SELECT *, unnest(range(n)) AS k FROM r)
SELECT o AS id, 0 AS n, 'a_key' AS key, o::VARCHAR AS value FROM r
UNION ALL SELECT o, 1 + 2 * k, 'b_items[' || k || '].part', p[k + 1]::VARCHAR FROM i
UNION ALL SELECT o, 2 + 2 * k, 'b_items[' || k || '].size.units', q[k + 1]::BIGINT::VARCHAR FROM i
UNION ALL SELECT o, 1 + 2 * n, 'c_counts', '[' || array_to_string(list_transform(list_concat(q, q)[1:12], lambda v: v::BIGINT::VARCHAR), ', ') || CASE WHEN n > 6 THEN ', … ' || 2 * n || ' numbers' ELSE '' END || ']' FROM r
UNION ALL SELECT o, 2 + 2 * n, 'd_empty', '[]' FROM r
UNION ALL SELECT o, 3 + 2 * n, 'e_none', 'null' FROM r""")
def flattened_orders(spark: SparkSession, d: str) -> DataFrame:
    """Each order as a JSON document, flattened to its fields."""
    item = F.struct("l_linenumber", F.col("l_partkey").alias("part"), F.struct(F.col("l_quantity").cast("long").alias("units")).alias("size"))
    o = _table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("a_key")).agg(F.array_sort(F.collect_list(item)).alias("i"))  # the few lines of an order
    counts = F.transform("i", lambda x: x["size"]["units"])
    doc = F.struct(F.lit(None).cast("string").alias("e_none"), F.array().cast("array<int>").alias("d_empty"), "a_key", F.concat(counts, counts).alias("c_counts"), F.transform("i", lambda x: F.struct(x["size"].alias("size"), x["part"].alias("part"))).alias("b_items"))
    rows = o.select("a_key", F.parse_json(F.to_json(doc, {"ignoreNullFields": "false"})).alias("v"))
    return nested.flattened(rows, "a_key", F.col("v"))


_CANON = """'{"id":' || c_custkey || ',"name":"' || c_name || '","nation":{"a":[' || c_nationkey || ',{"x":1,"y":null}],"b":true}}'"""


@_query(f"SELECT c_custkey AS id, {_CANON} AS text, sha256({_CANON}) AS hash FROM customer")
def canonical_records(spark: SparkSession, d: str) -> DataFrame:
    """Records whose keys come in another order for every other customer: the canonical text doesn't show it."""
    c = _table(spark, d, "customer").withColumnsRenamed({"c_custkey": "id", "c_name": "name"})
    n = F.col("c_nationkey")
    text = lambda fields: F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}"))
    name, ident = F.concat(F.lit('"name" : "'), "name", F.lit('"')), F.concat(F.lit('"id":'), F.col("id").cast("string"))
    nation = F.concat(F.lit('"nation": {"b":true, "a":['), n.cast("string"), F.lit(', {"y":null,"x":1}]}'))
    raw = F.when(F.col("id") % 2 == 0, text([name, nation, ident])).otherwise(text([nation, ident, name]))
    return c.select("id", nested.canonical(raw).alias("text"), nested.canonical_hash(raw).alias("hash"))


@_query("""SELECT c_custkey AS id, '{"point":[' || c_custkey || '.0,' || CASE c_custkey % 4 WHEN 0 THEN '"NaN"' WHEN 1 THEN '"Infinity"' WHEN 2 THEN '"-Infinity"' ELSE 'null' END || '],"by":[["nation",' || c_nationkey || '],["odd",' || CASE WHEN c_custkey % 2 = 1 THEN '1' ELSE 'null' END || ']],"text":"' || c_name || ' \\"q\\"","bytes":[1,255],"none":null}' AS text FROM customer""")
def json_like_values(spark: SparkSession, d: str) -> DataFrame:
    """Typed values of all kinds as JSON text."""
    k = F.col("c_custkey")
    odd = F.element_at(F.array(F.lit(float("nan")), F.lit(float("inf")), F.lit(float("-inf")), F.lit(None).cast("double")), (k % 4 + 1).cast("int"))
    v = F.struct(
        F.array(k.cast("double"), odd).alias("point"), F.create_map(F.lit("nation"), F.col("c_nationkey").cast("long"), F.lit("odd"), F.when(k % 2 == 1, F.lit(1).cast("long"))).alias("by"),
        F.concat("c_name", F.lit(' "q"')).alias("text"), F.unhex(F.lit("01FF")).alias("bytes"), F.lit(None).cast("int").alias("none"),
    )
    c = _table(spark, d, "customer").select(k.alias("id"), v.alias("v"))
    return c.select("id", nested.json_like(F.col("v"), c.schema["v"].dataType).alias("text"))


# tiles and files --------------------------------------------------------------------------------


def _tiles(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of 10 units, 40 in a row, with up to three coarser levels; some bases, levels and bounds are wrong."""
    k = F.col("p_partkey")
    p = _table(spark, d, "part").select(k.alias("k"), F.explode(F.sequence(F.lit(0), (k % 4).cast("int"))).alias("l"))
    p = p.where(~((F.col("l") == 0) & (F.col("k") % 11 == 0)) & ~((F.col("l") == 1) & (F.col("k") % 9 == 0) & (F.col("k") % 4 >= 2)))
    x, y = (F.col("k") % 40 * 10).cast("double"), (F.floor(F.col("k") / 40) * 10).cast("double")
    point = lambda a, b, c: F.struct(a.alias("x"), b.alias("y"), c.alias("z"))
    ident = F.concat(F.lit("p"), F.col("k").cast("string"), F.when(F.col("l") > 0, F.concat(F.lit("#lod"), F.col("l").cast("string"))).otherwise(""))
    wide = F.when((F.col("k") % 13 == 0) & (F.col("l") == 2), 10.5).otherwise(10.0)
    return p.select(
        (F.col("k") * 8 + F.col("l")).alias("ord"), ident.alias("id"), F.lit(None).cast("int").alias("lod"), F.lit(None).cast("string").alias("lod_of"),
        point(x, y, F.lit(0.0)).alias("low"), point(x + wide, y + 10, F.lit(5.0)).alias("high"), (F.col("k") % 7 * 100 + 900 / F.pow(F.lit(2.0), F.col("l") * 2)).alias("bytes"),
    )


_TILES = """t AS (SELECT p_partkey AS k, l, 'p' || p_partkey AS base, 'p' || p_partkey || CASE WHEN l > 0 THEN '#lod' || l ELSE '' END AS id FROM part, range(4) r(l)
 WHERE l <= p_partkey % 4 AND NOT (l = 0 AND p_partkey % 11 = 0) AND NOT (l = 1 AND p_partkey % 9 = 0 AND p_partkey % 4 >= 2))"""


@_query(f"""WITH {_TILES} SELECT 'error' AS severity, 'tile.orphan' AS code, id AS subject, 'tile ' || id || ': base ' || base || ' isn''t there' AS message FROM t WHERE l > 0 AND k % 11 = 0
UNION ALL SELECT 'error', 'tile.bounds', id, 'tile ' || id || ' has other bounds than ' || base FROM t WHERE l = 2 AND k % 11 > 0 AND k % 13 = 0
UNION ALL SELECT 'warning', 'tile.level_missing', base, 'tile ' || base || ': level 1 of ' || k % 4 || ' is missing' FROM t WHERE l = 0 AND k % 9 = 0 AND k % 4 >= 2
UNION ALL SELECT 'warning', 'tile.level_counts', 'tiles', 'numbers of levels: ' || string_agg(DISTINCT n::VARCHAR, ', ' ORDER BY n::VARCHAR) FROM (SELECT count(*) - 1 AS n FROM t WHERE k % 11 > 0 GROUP BY k)""")
def tile_issues(spark: SparkSession, d: str) -> DataFrame:
    return tiles.checked_tiles(_tiles(spark, d))


def _cameras(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return _table(spark, d, "supplier").select(k.alias("camera"), (k * 37 % 400 + 0.5).alias("x"), (k * 53 % 400 + 0.25).alias("y"), F.lit(20.0).alias("z"), F.lit(15.0).alias("pitch"), (k * 29 % 360).cast("double").alias("yaw"), F.lit(0.0).alias("roll"))


@_query("""WITH c AS (SELECT s_suppkey AS camera, s_suppkey * 37 % 400 + 0.5::DOUBLE AS x, s_suppkey * 53 % 400 + 0.25::DOUBLE AS y, 20.0::DOUBLE AS z, radians(15.0::DOUBLE) AS p, radians((s_suppkey * 29 % 360)::DOUBLE) AS w FROM supplier),
b AS (SELECT 'p' || p_partkey AS base, p_partkey % 40 * 10.0::DOUBLE AS lx, p_partkey // 40 * 10.0::DOUBLE AS ly, 1 + (p_partkey % 4) - (p_partkey % 11 = 0)::INT - (p_partkey % 9 = 0 AND p_partkey % 4 >= 2)::INT AS levels,
 CASE WHEN p_partkey % 13 = 0 AND p_partkey % 4 >= 2 THEN 10.5::DOUBLE ELSE 10 END AS wide FROM part),
m AS (SELECT *, cos(p) * cos(w) AS fx, cos(p) * sin(w) AS fy, -sin(p) AS fz, sin(w) AS rx, -cos(w) AS ry FROM c, b WHERE levels > 0 AND b.lx <= c.x + 120 AND b.lx + wide >= c.x - 120 AND b.ly <= c.y + 120 AND b.ly + 10 >= c.y - 120),
u AS (SELECT *, ry * fz AS ux, -rx * fz AS uy, rx * fy - ry * fx AS uz FROM m),
n AS (SELECT camera, base, lx, ly, wide, levels, x, y, z, unnest([{'a': fx * sin(radians(40.0::DOUBLE)) + rx * cos(radians(40.0::DOUBLE)), 'b': fy * sin(radians(40.0::DOUBLE)) + ry * cos(radians(40.0::DOUBLE)), 'c': fz * sin(radians(40.0::DOUBLE)), 'o': 0.0::DOUBLE},
 {'a': fx * sin(radians(40.0::DOUBLE)) - rx * cos(radians(40.0::DOUBLE)), 'b': fy * sin(radians(40.0::DOUBLE)) - ry * cos(radians(40.0::DOUBLE)), 'c': fz * sin(radians(40.0::DOUBLE)), 'o': 0.0},
 {'a': fx * 0.5 + ux * cos(radians(30.0::DOUBLE)), 'b': fy * 0.5 + uy * cos(radians(30.0::DOUBLE)), 'c': fz * 0.5 + uz * cos(radians(30.0::DOUBLE)), 'o': 0.0},
 {'a': fx * 0.5 - ux * cos(radians(30.0::DOUBLE)), 'b': fy * 0.5 - uy * cos(radians(30.0::DOUBLE)), 'c': fz * 0.5 - uz * cos(radians(30.0::DOUBLE)), 'o': 0.0},
 {'a': fx, 'b': fy, 'c': fz, 'o': 0.0}, {'a': -fx, 'b': -fy, 'c': -fz, 'o': 80.0}]) AS n FROM u),
s AS (SELECT camera, base, any_value(levels) AS levels, any_value(wide) AS wide, any_value(greatest(lx - x, 0, x - lx - wide)) AS dx, any_value(greatest(ly - y, 0, y - ly - 10)) AS dy FROM n
 GROUP BY camera, base HAVING bool_and((lx + CASE WHEN n.a >= 0 THEN wide ELSE 0 END - x) * n.a + (ly + CASE WHEN n.b >= 0 THEN 10 ELSE 0 END - y) * n.b + (CASE WHEN n.c >= 0 THEN 5 ELSE 0 END - z) * n.c + n.o >= 0)),
g AS (SELECT *, sqrt(dx * dx + dy * dy + 225) AS distance, sqrt(dx * dx + dy * dy + 225) / (1.5 * sqrt(wide * wide + 125)) AS ratio FROM s)
SELECT camera, base, round(distance, 6) AS distance, (CASE WHEN levels <= 1 OR ratio <= 1 THEN 0 ELSE least(levels - 1, 1 + floor(log2(ratio))) END)::INT AS want FROM g""")
def visible_tiles(spark: SparkSession, d: str) -> DataFrame:
    """What each supplier's camera sees of the tiles up to 80 units ahead, and at which level."""
    got = tiles.visible_tiles(_cameras(spark, d), tiles.tile_cells(_tiles(spark, d)), 80.0, 40.0, 30.0)
    return got.select("camera", "base", F.round("distance", 6).alias("distance"), "want")


@_query(None)
def planned_tiles(spark: SparkSession, d: str) -> DataFrame:
    """What each camera holds within 12,000 bytes; tested against a plain greedy choice."""
    return tiles.planned_tiles(tiles.visible_tiles(_cameras(spark, d), tiles.tile_cells(_tiles(spark, d)), 80.0, 40.0, 30.0), 12_000.0)


@_query("""WITH m AS (SELECT page_id, strlen(html) + (page_id % 7 = 2)::INT AS bytes, strlen(html) AS size, page_id % 5 = 4 AS wrong, page_id % 11 = 3 AS gone FROM pages)
SELECT 'error' AS severity, CASE WHEN gone THEN 'file.missing' WHEN bytes <> size THEN 'file.size' ELSE 'file.digest' END AS code, page_id || '.html' AS subject,
 CASE WHEN gone THEN 'missing page file ' || page_id || '.html' WHEN bytes <> size THEN 'page ' || page_id || '.html: ' || size || ' bytes, not ' || bytes ELSE 'page ' || page_id || '.html has another digest' END AS message
FROM m WHERE gone OR bytes <> size OR wrong""")
def file_issues(spark: SparkSession, d: str) -> DataFrame:
    """A manifest of all pages against pages of which some are gone, cut or changed."""
    k, body = F.col("page_id"), F.col("html").cast("binary")
    p = _table(spark, d, "pages").where("html IS NOT NULL").withColumn("file", F.concat(k.cast("string"), F.lit(".html")))
    digest = F.when(k % 5 == 4, F.sha2(F.lit("other").cast("binary"), 256)).otherwise(F.sha2(body, 256))
    named = p.select(F.lit("page").alias("what"), "file", (F.length(body) + (k % 7 == 2).cast("int")).alias("bytes"), digest.alias("sha256"))
    return tiles.checked_files(named, p.where(k % 11 != 3).select("file", body.alias("content")))


# flow links -------------------------------------------------------------------------------------


def _flow(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s, o = _sections(spark, d), F.col("o")
    nodes = s.select(F.lit(0).alias("hull"), o.alias("node"), F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: o * 64 + k + 1).alias("nav_ids"))
    to = F.array(o * 64 + F.col("n"), (o + 1) * 64 + 1, (o + 2) * 64 + 2)
    mesh = strips(spark, d)
    faces = mesh.select(F.col("pid").alias("face"), F.when(F.col("pid") % 320 != 0, F.col("pid")).alias("pid"))
    return meshes.flow_links(nodes, s.select(F.lit(0).alias("hull"), o.alias("node"), F.explode(to).alias("nav_id")), faces, mesh, mesh.select("pid", F.floor(F.col("pid") / 64).alias("component")))


_FLOW = f"""{_STRIPS}, p AS (SELECT o, o * 64 + k AS pid, k, (k + 0.5) * 10 AS x, o * 100 + (s[k + 1] + s[k + 2]) / 2 AS y FROM (SELECT *, unnest(range(n)) AS k FROM s)),
w AS (SELECT * FROM p WHERE pid % 320 <> 0), c AS (SELECT o, n, unnest([o * 64 + n - 1, (o + 1) * 64, (o + 2) * 64 + 1]) AS dest FROM s),
t AS (SELECT c.*, w.o AS piece, w.x AS tx, w.y AS ty, w.pid AS dpid, EXISTS (SELECT 1 FROM w v WHERE v.o = c.o) AS held FROM c LEFT JOIN w ON w.pid = dest)"""


@_query(f"WITH {_FLOW} SELECT arg_min(v.pid, (sqrt((v.x - tx) ** 2 + (v.y - ty) ** 2), v.k)) AS from_pid, dpid AS to_pid FROM t JOIN w v ON v.o = t.o WHERE dpid IS NOT NULL AND piece <> t.o GROUP BY t.o, dpid")
def flow_links(spark: SparkSession, d: str) -> DataFrame:
    """Links between the strips of neighbouring orders, from the nearest quad."""
    return _flow(spark, d)[0].select("from_pid", "to_pid")


@_query(f"WITH {_FLOW} SELECT o AS node, dest + 1 AS nav_id, CASE WHEN dpid IS NULL OR NOT held THEN 'unresolved' ELSE 'same component' END AS reason FROM t WHERE dpid IS NULL OR NOT held OR piece = o")
def left_out_connections(spark: SparkSession, d: str) -> DataFrame:
    return _flow(spark, d)[1].select("node", "nav_id", "reason")
