"""Registered queries of routes, corridors and exact walks, with their SQL.

Two meshes grow with the tables: ``terrain`` has one square a part, 40 in a row, with corners at different
heights; ``strips`` has one quad a line item, those of an order in a row, whose cross-sections swing from side to side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.operators import routes
from cairnfield.plans.queries import _query, _table

# terrain ---------------------------------------------------------------------------------------


def _height(i: Column, j: Column) -> Column:
    return (i * 7919 + j * 104729) % 9973 / F.lit(997.3)


def terrain(spark: SparkSession, d: str) -> DataFrame:
    """(pid, points): squares of 10 units, heights from 0 to 10."""
    pid = F.col("p_partkey")
    i, j = pid % 40, F.floor(pid / 40)
    corner = lambda a, b: F.struct(((i + a) * 10).cast("double").alias("x"), ((j + b) * 10).cast("double").alias("y"), _height(i + a, j + b).alias("z"))
    return _table(spark, d, "part").select(pid.alias("pid"), F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)).alias("points"))


def _closed(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "part").where("p_size <= 4").select(F.col("p_partkey").alias("pid"))


_H = "((({i}) * 7919 + ({j}) * 104729) % 9973 / 997.3::DOUBLE)"
_TERRAIN = f"""m AS MATERIALIZED (SELECT p_partkey AS pid, p_partkey % 40 AS i, p_partkey // 40 AS j, p_size <= 4 AS closed, p_size, (SELECT count(*) FROM part) AS size FROM part),
h AS MATERIALIZED (SELECT *, ({_H.format(i='i', j='j')} + {_H.format(i='i+1', j='j')} + {_H.format(i='i+1', j='j+1')} + {_H.format(i='i', j='j+1')}) / 4 AS z FROM m)"""

_SPEEDS = {"zipline": 15.0, "navConnection": 2.0, "climbRope": 1.0, "gate": 0.0}


def _links(spark: SparkSession, d: str) -> DataFrame:
    """Links of five kinds between squares (one for each supplier); some have their own cost, jump pads have no speed."""
    n, k = _table(spark, d, "part").count(), F.col("s_suppkey")
    f, t = k * 53 % n, (k * 53 + 122) % n
    point = lambda p, z: F.struct((p % 40 * 10 + 5).cast("double").alias("x"), (F.floor(p / 40) * 10 + 5).cast("double").alias("y"), F.lit(z).alias("z"))
    kind = F.element_at(F.array(*map(F.lit, ("zipline", "navConnection", "climbRope", "gate", "jumpPad"))), (k % 5 + 1).cast("int"))
    return _table(spark, d, "supplier").select(f.alias("from_pid"), t.alias("to_pid"), kind.alias("kind"), point(f, 2.0).alias("from_point"), point(t, 8.0).alias("to_point"), F.when(k % 7 == 0, 9.0).when(k % 7 == 1, -1.0).alias("cost"), (k % 3 != 0).alias("bidirectional"))


def _wanted(spark: SparkSession, d: str) -> DataFrame:
    n, k = _table(spark, d, "part").count(), F.col("s_suppkey")
    f = k * 37 % n
    step = F.when(f < n / 2, F.when(f % 40 < 20, 85).otherwise(75)).otherwise(F.when(f % 40 < 20, -75).otherwise(-85))
    return _table(spark, d, "supplier").select(k.alias("route"), f.alias("from_pid"), (f + step).alias("to_pid"))


_GRAPH = f"""{_TERRAIN},
l AS (SELECT s_suppkey * 53 % size AS f, (s_suppkey * 53 + 122) % size AS t, s_suppkey % 5 AS kind, CASE s_suppkey % 5 WHEN 0 THEN 15 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 0 END AS speed,
 CASE WHEN s_suppkey % 7 = 0 THEN 9.0::DOUBLE END AS own, s_suppkey % 3 <> 0 AS two_way FROM supplier, (SELECT count(*) AS size FROM part)),
k AS (SELECT f, t, CASE WHEN own IS NOT NULL THEN CASE WHEN coalesce(speed, 1) <> 0 THEN own END WHEN speed > 0 THEN
 sqrt((f % 40 * 10 - t % 40 * 10.0::DOUBLE) * (f % 40 * 10 - t % 40 * 10.0::DOUBLE) + (f // 40 * 10 - t // 40 * 10.0::DOUBLE) * (f // 40 * 10 - t // 40 * 10.0::DOUBLE) + 36.0::DOUBLE) / speed END AS cost, two_way FROM l),
u AS (SELECT p.pid AS a, q.pid AS b, sqrt((p.i - q.i) * (p.i - q.i) * 100.0::DOUBLE + (p.j - q.j) * (p.j - q.j) * 100.0::DOUBLE + (p.z - q.z) * (p.z - q.z)) / 2 AS cost FROM h p JOIN h q ON abs(p.i - q.i) + abs(p.j - q.j) = 1
 UNION ALL SELECT f, t, cost FROM k WHERE cost IS NOT NULL UNION ALL SELECT t, f, cost FROM k WHERE cost IS NOT NULL AND two_way),
e AS MATERIALIZED (SELECT a, b, min(cost * CASE WHEN y.p_size >= 40 THEN 1 + y.p_size / 50.0::DOUBLE ELSE 1 END) AS cost FROM u JOIN h x ON x.pid = a JOIN h y ON y.pid = b WHERE NOT x.closed AND NOT y.closed GROUP BY a, b)"""


@_query(f"WITH {_GRAPH} SELECT a, b, round(cost, 9) AS cost FROM e")
def mesh_steps(spark: SparkSession, d: str) -> DataFrame:
    """Walks and links with speeds, own costs and multipliers: the quickest step between two polygons."""
    return _terrain_steps(spark, d).select("a", "b", F.round("cost", 9).alias("cost"))


def _terrain_steps(spark: SparkSession, d: str) -> DataFrame:
    slow = _table(spark, d, "part").where("p_size >= 40").select(F.col("p_partkey").alias("pid"), (F.col("p_size") / F.lit(50.0) + 1).alias("multiplier"))
    return routes.steps(terrain(spark, d), _links(spark, d), 2.0, _SPEEDS, _closed(spark, d), slow)


@_query(f"""WITH RECURSIVE {_GRAPH},
w AS (SELECT *, s + CASE WHEN s < size / 2 THEN CASE WHEN s % 40 < 20 THEN 85 ELSE 75 END ELSE CASE WHEN s % 40 < 20 THEN -75 ELSE -85 END END AS g FROM (SELECT s_suppkey AS route, s_suppkey * 37 % size AS s, size FROM supplier, (SELECT count(*) AS size FROM part))),
t AS (SELECT route, s AS pid, 0.0::DOUBLE AS cost, 0 AS n FROM w JOIN h x ON x.pid = s JOIN h y ON y.pid = g WHERE NOT x.closed AND NOT y.closed
 UNION ALL SELECT route, b, min(t.cost + e.cost), n + 1 FROM t JOIN e ON e.a = t.pid WHERE n < 24 GROUP BY route, b, n),
f AS MATERIALIZED (SELECT route, pid, min(cost) AS cost FROM t GROUP BY route, pid),
p AS MATERIALIZED (SELECT f.route, f.pid, min(o.pid) AS a FROM f JOIN e ON e.b = f.pid JOIN f o ON o.route = f.route AND o.pid = e.a WHERE o.cost + e.cost = f.cost GROUP BY f.route, f.pid),
r AS (SELECT route, g AS pid, [g] AS pids FROM w UNION ALL SELECT r.route, p.a, list_prepend(p.a, pids) FROM r JOIN w USING (route) JOIN p ON p.route = r.route AND p.pid = r.pid WHERE r.pid <> w.s)
SELECT w.route, round(f.cost, 6) AS cost, array_to_string(r.pids, ' ') AS pids FROM w LEFT JOIN f ON f.route = w.route AND f.pid = g LEFT JOIN r ON r.route = f.route AND r.pid = w.s""")
def quickest_routes(spark: SparkSession, d: str) -> DataFrame:
    """A route for each supplier over the terrain, its links and overrides; null where there is none."""
    got = routes.routes(_terrain_steps(spark, d), _wanted(spark, d), terrain(spark, d).join(_closed(spark, d), "pid", "left_anti"))
    return got.select("route", F.round("cost", 6).alias("cost"), F.array_join(F.col("pids").cast("array<string>"), " ").alias("pids"))


@_query(f"""WITH {_TERRAIN}, s AS (SELECT c_custkey AS ray, c_custkey * 7 % size AS pid, 23.1 + c_custkey % 7 AS dx, 11.7 + c_custkey % 5 AS dy, (c_custkey % 9 - 4.0::DOUBLE) / 2 AS dz FROM customer, (SELECT count(*) AS size FROM part)),
a AS (SELECT s.*, i, j, closed, size, ({_H.format(i='i', j='j')} + {_H.format(i='i+1', j='j+1')}) / 2 AS az FROM s JOIN m USING (pid)),
x AS (SELECT ray, (10 * k - 5) / dx AS t, i + k AS ni, floor((j * 10 + 5 + dy * (10 * k - 5) / dx) / 10)::BIGINT AS nj, 1 AS v, i, j, dx, dy, dz, az, size FROM a, range(1, 5) r(k) WHERE (10 * k - 5) < dx
 UNION ALL SELECT ray, (10 * k - 5) / dy, floor((i * 10 + 5 + dx * (10 * k - 5) / dy) / 10)::BIGINT, j + k, 0, i, j, dx, dy, dz, az, size FROM a, range(1, 5) r(k) WHERE (10 * k - 5) < dy),
y AS (SELECT ray, ni < 40 AND m.pid IS NOT NULL AND NOT m.closed AND abs(CASE v WHEN 1 THEN {_H.format(i='ni', j='nj')} + ({_H.format(i='ni', j='nj+1')} - {_H.format(i='ni', j='nj')}) * ((x.j * 10 + 5 + dy * t) / 10 - nj)
 ELSE {_H.format(i='ni', j='nj')} + ({_H.format(i='ni+1', j='nj')} - {_H.format(i='ni', j='nj')}) * ((x.i * 10 + 5 + dx * t) / 10 - ni) END - (az + dz * t)) <= 6 AS ok FROM x LEFT JOIN m ON m.i = ni AND m.j = nj AND ni < 40)
SELECT ray, NOT any_value(closed) AND coalesce(bool_and(ok), true) AS walkable FROM a LEFT JOIN y USING (ray) GROUP BY ray""")
def exact_walks(spark: SparkSession, d: str) -> DataFrame:
    """Lines from the middles of squares over the uneven terrain."""
    n, k = _table(spark, d, "part").count(), F.col("c_custkey")
    pid = k * 7 % n
    i, j = pid % 40, F.floor(pid / 40)
    ax, ay, az = (i * 10 + 5).cast("double"), (j * 10 + 5).cast("double"), (_height(i, j) + _height(i + 1, j + 1)) / 2
    s = _table(spark, d, "customer").select(k.alias("ray"), pid.alias("pid"), ax.alias("ax"), ay.alias("ay"), az.alias("az"), (ax + 23.1 + k % 7).alias("bx"), (ay + 11.7 + k % 5).alias("by"), (az + (k % 9 - 4.0) / 2).alias("bz"))
    return routes.walks_exactly(s, terrain(spark, d), _closed(spark, d), 6.0)


# strips ----------------------------------------------------------------------------------------


def _sections(spark: SparkSession, d: str) -> DataFrame:
    """(o, n, s): of each order the cross-sections' middles, one more than line items."""
    items = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda i: i["l_quantity"].cast("double"))
    lines = _table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(items.alias("q"))  # the few lines of an order
    return lines.select("o", F.size("q").alias("n"), F.concat("q", F.slice("q", 1, 1)).alias("s"))


def strips(spark: SparkSession, d: str) -> DataFrame:
    point = lambda k, up: F.struct((k * 10).cast("double").alias("x"), (F.col("o") * 100 + F.element_at("s", (k + 1).cast("int")) + up).alias("y"), F.lit(0.0).alias("z"))
    quad = lambda k: F.struct((F.col("o") * 64 + k).alias("pid"), F.array(point(k, -4.0), point(k + 1, -4.0), point(k + 1, 4.0), point(k, 4.0)).alias("points"))
    return _sections(spark, d).select(F.inline(F.transform(F.sequence(F.lit(0), F.col("n") - 1), quad)))


def _strip_routes(spark: SparkSession, d: str) -> DataFrame:
    y = lambda k: F.col("o") * 100 + F.element_at("s", k)
    ends = {"ax": F.lit(0.0), "ay": y(1), "az": F.lit(0.0), "bx": (F.col("n") * 10).cast("double"), "by": y(-1), "bz": F.lit(0.0)}
    return _sections(spark, d).select(F.col("o").alias("route"), (F.col("o") * 64).alias("from_pid"), (F.col("o") * 64 + F.col("n") - 1).alias("to_pid"), *[c.alias(n) for n, c in ends.items()])


def _as_text(points: str = "points") -> Column:
    return F.array_join(F.transform(points, lambda p: F.concat(p["x"].cast("long").cast("string"), F.lit(":"), p["y"].cast("long").cast("string"))), " ")


_CROSS = "(({a}).x - ax) * (({b}).y - ay) - (({a}).y - ay) * (({b}).x - ax)"
_STRIPS = """q AS (SELECT l_orderkey AS o, list(l_quantity::DOUBLE ORDER BY l_linenumber, l_quantity) AS q FROM lineitem GROUP BY 1),
s AS (SELECT o, len(q) AS n, list_append(q, q[1]) AS s FROM q)"""


@_query(f"""WITH RECURSIVE {_STRIPS},
g AS MATERIALIZED (SELECT o, n, k AS i, {{'x': k * 10.0::DOUBLE, 'y': o * 100 + s[k + 1] + CASE WHEN k < n THEN 4 ELSE 0 END}} AS l, {{'x': k * 10.0::DOUBLE, 'y': o * 100 + s[k + 1] - CASE WHEN k < n THEN 4 ELSE 0 END}} AS r
 FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM s)),
f AS (SELECT o, 1 AS i, 0.0::DOUBLE AS ax, o * 100 + s[1] AS ay, {{'x': 0.0::DOUBLE, 'y': o * 100 + s[1]}} AS wl, 0 AS li, {{'x': 0.0::DOUBLE, 'y': o * 100 + s[1]}} AS wr, 0 AS ri, [{{'x': 0.0::DOUBLE, 'y': o * 100 + s[1]}}] AS pts FROM s
 UNION ALL
 SELECT o, CASE WHEN rx THEN li WHEN lx THEN nri ELSE i END + 1, CASE WHEN rx THEN wl.x WHEN lx THEN nr.x ELSE ax END, CASE WHEN rx THEN wl.y WHEN lx THEN nr.y ELSE ay END,
  CASE WHEN rx THEN wl WHEN lx THEN nr WHEN l_in THEN l ELSE wl END, CASE WHEN rx THEN li WHEN lx THEN nri WHEN l_in THEN i ELSE li END, CASE WHEN rx THEN wl ELSE nr END, CASE WHEN rx THEN li ELSE nri END, CASE WHEN rx THEN list_append(pts, wl) WHEN lx THEN list_append(pts, nr) ELSE pts END
 FROM (SELECT *, l_in AND NOT (wl.x = ax AND wl.y = ay) AND {_CROSS.format(a='nr', b='l')} <= 0 AS lx
 FROM (SELECT *, CASE WHEN r_in THEN r ELSE wr END AS nr, CASE WHEN r_in THEN i ELSE ri END AS nri, {_CROSS.format(a='wl', b='l')} <= 0 AS l_in
 FROM (SELECT *, r_in AND NOT (wr.x = ax AND wr.y = ay) AND {_CROSS.format(a='wl', b='r')} >= 0 AS rx
 FROM (SELECT f.*, g.l, g.r, {_CROSS.format(a='f.wr', b='g.r')} >= 0 AS r_in FROM f JOIN g ON g.o = f.o AND g.i = f.i)))))
SELECT f.o AS route, n::INT AS polygons, array_to_string(list_transform(CASE WHEN list_last(pts) = g.r THEN pts ELSE list_append(pts, g.r) END, lambda p: p.x::BIGINT || ':' || p.y::BIGINT), ' ') AS points
FROM f JOIN g ON g.o = f.o AND g.i = g.n WHERE f.i = n + 1""")
def pulled_routes(spark: SparkSession, d: str) -> DataFrame:
    """The shortest line through the strip of each order."""
    mesh = strips(spark, d)
    got = routes.paths(_strip_routes(spark, d), mesh, routes.steps(mesh, walk=1.0))
    return got.select("route", F.size("pids").alias("polygons"), _as_text().alias("points"))


@_query(f"WITH {_STRIPS} SELECT o AS route, round(list_sum(list_transform(range(1, n), lambda k: sqrt(100 + ((s[k + 2] - s[k]) / 2) ** 2))), 6) AS cost, '0:' || (o * 100 + s[1])::BIGINT || array_to_string(list_transform(range(1, n), lambda k: ' ' || k * 10 || ':' || (o * 100 + s[k + 1])::BIGINT), '') || ' ' || n * 10 || ':' || (o * 100 + s[n + 1])::BIGINT AS points FROM s WHERE n > 1")
def midpoint_routes(spark: SparkSession, d: str) -> DataFrame:
    """The same routes by the middles of the portals, with their costs."""
    mesh = strips(spark, d)
    got = routes.paths(_strip_routes(spark, d), mesh, routes.steps(mesh, walk=1.0), smooth=False).where(F.size("pids") > 1)
    return got.select("route", F.round("cost", 6).alias("cost"), _as_text().alias("points"))


@_query(None)
def clear_routes(spark: SparkSession, d: str) -> DataFrame:
    """The pulled routes with a clearance of 2 units; tested against scenes and a plain version."""
    mesh = strips(spark, d)
    got = routes.paths(_strip_routes(spark, d), mesh, routes.steps(mesh, walk=1.0), radius=2.0)
    return got.select("route", F.size("points").alias("n"), F.transform("points", lambda p: F.struct(F.round(p["x"], 6).alias("x"), F.round(p["y"], 6).alias("y"))).cast("array<struct<x:double,y:double>>").alias("points"))


@_query(f"WITH {_STRIPS} SELECT o * 64 + k AS pid, CASE e WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 3 END AS k FROM (SELECT *, unnest(range(n)) AS k FROM s), range(4) r(e) WHERE e IN (0, 1) OR e = 2 AND k = n - 1 OR e = 3 AND k = 0")
def open_borders(spark: SparkSession, d: str) -> DataFrame:
    """The sides of the strips that nobody can cross."""
    return routes.walls(strips(spark, d)).select("pid", "k")


