"""Navigation over a polygon mesh: edges, distance fields, travel-time joins, routes, components.

Tables: ``polygons`` (pid, points: array of struct x, y, z) and ``links`` (from_pid, to_pid, kind,
and optionally cost). Edges are made by joins; shortest times run either as a relaxation over
DataFrames (any size, many sources at once) or, for a mesh of checked size, as one small kernel a
field with the fields dealt over the executors.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.functions.geometry import Vec, distance
from cairnfield.operators.entities import near
from cairnfield.operators.grids import fan_triangles
from cairnfield.operators.sequence import ORD
from cairnfield.operators.surfaces import closest_points
from cairnfield.plans.storage import materialize, release, shuffled

#: Speeds in units a second (fixed values): a hero walks 7 m/s, a zipline runs 15 m/s, mantling and
#: ropes go at half a hero's pace. Jump pads have none, so that default routes cannot use them.
WALK = 7 / 0.01905
LINK_SPEEDS = {"zipline": 15 / 0.01905, "navConnection": WALK, "mantle": WALK / 2, "climbRope": WALK / 2}

#: A target farther than this from the mesh cannot be reached.
MAX_SNAP = 1500.0

#: Most edges that a kernel's task is given whole.
KERNEL_EDGES = 2_000_000


def centroid() -> dict[str, Column]:
    """x, y and z of the mean of a polygon's points."""
    mean = lambda c: F.aggregate("points", F.lit(0.0), lambda s, p: s + p[c]) / F.size("points")
    return {c: mean(c) for c in "xyz"}


def centroids(polygons: DataFrame) -> DataFrame:
    return polygons.select("pid", *[c.alias(n) for n, c in centroid().items()])


def side_key(p: Column, q: Column) -> dict[str, Column]:
    """lo and hi: 128 bits that stand for the two ends of a side, whichever way it runs. The ends as text are many times longer."""
    low, high = F.least(p, q), F.greatest(p, q)
    return {n: F.xxhash64(*[e[c] for e in (low, high) for c in "xyz"], F.lit(i)) for i, n in enumerate(("lo", "hi"))}


def adjacency(polygons: DataFrame) -> DataFrame:
    """(a, b) of polygons that share an edge, both ways: each undirected edge is a key of an equi-join."""
    ring = F.concat("points", F.slice("points", 1, 1))
    ends = F.zip_with("points", F.slice(ring, 2, F.size("points")), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    sides = polygons.select("pid", F.explode(ends).alias("e")).select("pid", *[c.alias(n) for n, c in side_key(F.col("e.p"), F.col("e.q")).items()])
    a, b = sides.select(F.col("pid").alias("a"), "lo", "hi"), sides.select(F.col("pid").alias("b"), "lo", "hi")
    return a.join(shuffled(b), ["lo", "hi"]).where("a != b").select("a", "b").distinct()


def _speed(kind: Column, speeds: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(v) for kv in speeds.items() for v in kv])[kind] if speeds else F.lit(None).cast("double")


def edges(polygons: DataFrame, links: DataFrame | None = None, walk: float = WALK, speeds: dict[str, float] | None = None, blocked: DataFrame | None = None, multipliers: DataFrame | None = None) -> DataFrame:
    """(a, b, cost): centroid distance times the target's multiplier over the speed.

    A link with its own cost takes that; one whose kind has no positive speed can't be used.
    ``blocked`` (pid) and ``multipliers`` (pid, multiplier; all of one polygon multiply) are overrides."""
    speeds = LINK_SPEEDS if speeds is None else speeds
    c = centroids(polygons)
    steps = adjacency(polygons).withColumns({"speed": F.lit(float(walk)), "fixed": F.lit(None).cast("double")})
    if links is not None:
        fixed = F.col("cost").cast("double") if "cost" in links.columns else F.lit(None).cast("double")
        own = links.select(F.col("from_pid").alias("a"), F.col("to_pid").alias("b"), _speed(F.col("kind"), speeds).alias("speed"), fixed.alias("fixed"))
        steps = steps.unionByName(own.where("coalesce(speed, 0) > 0"))
    side = lambda n: c.select(F.col("pid").alias(n), *[F.col(x).alias(n + x) for x in "xyz"])
    out = steps.join(shuffled(side("a")), "a").join(shuffled(side("b")), "b").withColumn("cost", distance(Vec.of("a"), Vec.of("b")))
    if multipliers is not None:
        m = multipliers.groupBy(F.col("pid").alias("b")).agg(F.product(F.col("multiplier").cast("double")).alias("m"))
        out = out.join(shuffled(m), "b", "left").withColumn("cost", F.col("cost") * F.coalesce("m", F.lit(1.0)))
    out = out.withColumn("cost", F.coalesce("fixed", F.col("cost") / F.col("speed")))
    if blocked is not None:
        gone = blocked.select("pid").distinct()
        out = out.join(shuffled(gone.withColumnRenamed("pid", "a")), "a", "left_anti").join(shuffled(gone.withColumnRenamed("pid", "b")), "b", "left_anti")
    return out.groupBy("a", "b").agg(F.min("cost").alias("cost"))


def mesh_triangles(polygons: DataFrame) -> DataFrame:
    """The fan triangles of the polygons as a soup; tid is (pid, k)."""
    corner = [F.col(f"{n}.{c}").alias(n + c) for n in "abc" for c in "xyz"]
    return fan_triangles(polygons).select(F.struct("pid", "k").alias("tid"), *corner)


def snap(points: DataFrame, polygons: DataFrame, reach: float = MAX_SNAP) -> DataFrame:
    """The nearest point of the mesh within ``reach`` of each point: ord, pid, gap, x, y, z. Ties go to the
    smaller pid, then to the earlier triangle of its fan.

    The search widens by doubling, from the mean extent of a triangle: what is found within a width is
    the nearest, and only the points left go on."""
    tri = mesh_triangles(polygons)
    extent = F.greatest(*[F.greatest(f"a{c}", f"b{c}", f"c{c}") - F.least(f"a{c}", f"b{c}", f"c{c}") for c in "xy"])
    mean = tri.agg(F.avg(extent)).first()[0]
    if mean is None:  # no mesh
        return closest_points(points.select(ORD, "x", "y", "z"), tri, 1.0).select(ORD, "tid.pid", F.col("distance").alias("gap"), "x", "y", "z")
    width = max(mean, reach / 4096) if math.isfinite(reach) else max(mean, 1.0)
    rest, found = points.select(ORD, "x", "y", "z"), None
    while True:
        got = closest_points(rest, tri, min(width, reach)).select(ORD, "tid.pid", F.col("distance").alias("gap"), "x", "y", "z")
        got = materialize(got, "snap")
        found = got if found is None else found.unionByName(got)
        if width >= reach:
            return found
        rest = materialize(rest.join(got, ORD, "left_anti"), "snap-rest")
        if rest.isEmpty():
            return found
        width *= 2


def walkable(segments: DataFrame, polygons: DataFrame, blocked: DataFrame | None = None, step: float = 32.0, tolerance: float = 24.0) -> DataFrame:
    """(ray, walkable) of segments (ray, ax.. to bx..): whether all samples, ``step`` apart at most, lie within
    ``tolerance`` of the mesh and nearest to a polygon that is not ``blocked`` (pid)."""
    a, b = Vec.of("a"), Vec.of("b")
    s = segments.withColumn("n", F.greatest(F.lit(1), F.ceil(distance(a, b) / step).cast("int")))
    at = a.lerp(b, F.col("i") / F.col("n"))
    samples = s.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n")))).select(F.struct("ray", "i").alias(ORD), at.x.alias("x"), at.y.alias("y"), at.z.alias("z"))
    got = snap(samples, polygons, tolerance)
    if blocked is not None:
        got = got.join(blocked.select("pid").distinct(), "pid", "left_anti")
    ok = got.groupBy(F.col(f"{ORD}.ray").alias("ray")).agg(F.count("*").alias("ok"))
    return s.select("ray", "n").join(ok, "ray", "left").select("ray", (F.coalesce("ok", F.lit(0)) == F.col("n") + 1).alias("walkable"))


def island_links(polygons: DataFrame, components: DataFrame, most: int = 400, reach: float = 200.0, rise: float = 96.0) -> DataFrame:
    """(from_pid, to_pid, kind, bidirectional): one link from each piece (pid, component) of at most ``most``
    polygons to the nearest polygon of a larger piece within ``reach`` and ``rise`` of height, by centroids.
    Polygons without a component are pieces of their own."""
    piece = polygons.select("pid").join(components, "pid", "left").select("pid", F.coalesce("component", "pid").alias("component"))
    small = piece.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") <= most)
    c = centroids(polygons).join(piece, "pid").withColumn(ORD, F.col("pid"))
    pairs = near(c.join(small, "component", "left_semi"), c.join(small, "component", "left_anti"), reach).where(F.abs(F.col("z") - F.col("r_z")) <= rise)
    best = pairs.groupBy("component").agg(F.min_by(F.struct("pid", "r_pid"), F.struct("dist", "pid", "r_pid")).alias("l"))
    return best.select(F.col("l.pid").alias("from_pid"), F.col("l.r_pid").alias("to_pid"), F.lit("navConnection").alias("kind"), F.lit(True).alias("bidirectional"))


def relaxed_field(edges_: DataFrame, sources: DataFrame) -> DataFrame:
    """(field, pid, cost): least cost from any source of a field (field, pid) to each polygon.

    Sources on polygons without edges (blocked ones have none) start nothing. Rounds of relaxation: only costs that fell in the last round are sent along the edges. Each
    round is written to shared storage, so that lineage stays short and a lost executor is cheap."""
    open_ = edges_.select(F.col("a").alias("pid")).union(edges_.select(F.col("b").alias("pid"))).distinct()
    state = materialize(sources.select("field", "pid").distinct().join(open_, "pid", "left_semi").withColumns({"cost": F.lit(0.0), "fell": F.lit(True)}), "field")
    while True:
        sent = state.where("fell").join(edges_.withColumnRenamed("cost", "step"), F.col("pid") == F.col("a")).select("field", F.col("b").alias("pid"), (F.col("cost") + F.col("step")).alias("new"))
        heard = sent.groupBy("field", "pid").agg(F.min("new").alias("new"))
        both = state.drop("fell").join(heard, ["field", "pid"], "full_outer")
        better = F.coalesce(F.col("new") < F.coalesce("cost", F.lit(float("inf"))), F.lit(False))
        state = materialize(both.select("field", "pid", F.when(better, F.col("new")).otherwise(F.col("cost")).alias("cost"), better.alias("fell")), "field")
        if state.where("fell").limit(1).count() == 0:
            return state.drop("fell")


def dijkstra(start: np.ndarray, to: np.ndarray, cost: np.ndarray, sources: list[int], goal: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Least costs and predecessors over rows ``start[i]:start[i + 1]`` of (to, cost)."""
    best, came = np.full(len(start) - 1, np.inf), np.full(len(start) - 1, -1, np.int64)
    best[sources] = 0.0
    heap = [(0.0, s) for s in sorted(set(sources))]
    while heap:
        d, u = heapq.heappop(heap)
        if u == goal:
            break
        if d > best[u]:
            continue
        for k in range(start[u], start[u + 1]):
            v, w = to[k], d + cost[k]
            if w < best[v]:
                best[v], came[v] = w, u
                heapq.heappush(heap, (w, int(v)))
    return best, came


def _shared_mesh(edges_: DataFrame):
    """The edges as sorted arrays, broadcast; refused beyond KERNEL_EDGES."""
    rows = edges_.limit(KERNEL_EDGES + 1).toArrow()
    if rows.num_rows > KERNEL_EDGES:
        raise ValueError(f"over {KERNEL_EDGES} edges: use relaxed_field")
    a, b, c = (rows.column(n).to_numpy() for n in ("a", "b", "cost"))
    pids = np.unique(np.concatenate([a, b]))
    order = np.lexsort((b, a))
    a, b, c = np.searchsorted(pids, a[order]), np.searchsorted(pids, b[order]), c[order]
    return edges_.sparkSession.sparkContext.broadcast((pids, np.searchsorted(a, np.arange(len(pids) + 1)), b, c))


def kernel_fields(edges_: DataFrame, sources: DataFrame) -> DataFrame:
    """As ``relaxed_field``, one Dijkstra a field; the fields are dealt over the executors."""
    mesh = _shared_mesh(edges_)
    fields = sources.groupBy("field").agg(F.collect_set("pid").alias("pids")).repartition("field")

    def run(batches):
        pids, start, to, cost = mesh.value
        for b in batches:
            for field, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = np.array(own)
                at = np.searchsorted(pids, own)
                inside = (at < len(pids)) & (pids[np.minimum(at, len(pids) - 1)] == own) if len(pids) else np.zeros(len(own), bool)
                best, _ = dijkstra(start, to, cost, at[inside].tolist())
                ok = np.isfinite(best)
                p, c = pids[ok], best[ok]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), field, np.int64)), pa.array(p), pa.array(c)], ["field", "pid", "cost"])

    return fields.select(F.col("field").cast("long"), F.col("pids").cast("array<long>")).mapInArrow(run, "field long, pid long, cost double")


def travel_times(points: DataFrame, fields: DataFrame, polygons: DataFrame) -> DataFrame:
    """(ord, field, cost) for every point and every field that reaches its polygon."""
    return snap(points, polygons).join(fields, "pid").select(ORD, "field", "cost")


def within_time(points: DataFrame, sources: DataFrame, polygons: DataFrame, edges_: DataFrame, limit: float) -> DataFrame:
    """The points that the quickest of all sources reaches within ``limit`` seconds."""
    start = snap(sources, polygons).select(F.lit(0).cast("long").alias("field"), "pid")
    got = travel_times(points, relaxed_field(edges_, start), polygons).where(F.col("cost") <= limit)
    return points.join(got.select(ORD).distinct(), ORD, "left_semi")


def quickest(points: DataFrame, fields: DataFrame, polygons: DataFrame) -> DataFrame:
    """For each point the field of least cost, ties to the smaller field."""
    got = travel_times(points, fields, polygons)
    return got.groupBy(ORD).agg(F.min_by(F.struct("field", "cost"), F.struct("cost", "field")).alias("q")).select(ORD, "q.field", "q.cost")


def mesh_components(links: DataFrame) -> DataFrame:
    """(pid, component): smallest pid reachable over (a, b), either way."""
    both = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "piece-links")  # read in each round
    state = materialize(both.groupBy(F.col("a").alias("pid")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "pieces")
    while True:
        heard = both.join(shuffled(state), F.col("b") == F.col("pid")).groupBy(F.col("a").alias("p")).agg(F.min("component").alias("heard"))
        near_ = state.join(shuffled(heard), F.col("pid") == F.col("p")).select("pid", F.least("component", "heard").alias("to"), F.col("component").alias("was"))
        jump = state.select(F.col("pid").alias("to"), F.col("component").alias("next"))
        after = materialize(near_.join(shuffled(jump), "to", "left").select("pid", F.least("to", F.coalesce("next", "to")).alias("component"), "was"), "pieces")
        release(state)
        state = after
        if state.where("component < was").isEmpty():
            release(both)
            return state.select("pid", "component")


def straight_detours(costs: DataFrame, points: DataFrame, walk: float, factor: float) -> DataFrame:
    """Pairs (a_ord < b_ord) over ``factor`` times as far to walk as to fly; costs: (a, b, seconds)."""
    p = points.select(ORD, "x", "y", "z")
    a = p.select([F.col(c).alias(f"a_{c}") for c in p.columns])
    b = p.select([F.col(c).alias(f"b_{c}") for c in p.columns])
    got = costs.join(a, F.col("a") == F.col(f"a_{ORD}")).join(b, F.col("b") == F.col(f"b_{ORD}")).where(F.col(f"a_{ORD}") < F.col(f"b_{ORD}"))
    fly = distance(Vec.of("a_"), Vec.of("b_"))
    return got.select(f"a_{ORD}", f"b_{ORD}", (F.col("seconds") * walk).alias("walk"), fly.alias("fly")).where(F.col("walk") > F.col("fly") * factor)


def mantle_links(links: DataFrame, drop: tuple[float, float] = (48.0, 1600.0)) -> DataFrame:
    """Climbs: the reverse of one-way drops (from_z, to_z) of a height within ``drop``."""
    fall = F.col("from_z") - F.col("to_z")
    return links.where(~F.col("bidirectional") & fall.between(*drop)).select(F.col("to_pid").alias("from_pid"), F.col("from_pid").alias("to_pid"), F.lit("mantle").alias("kind"))
