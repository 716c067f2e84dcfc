"""Distances between shapes and triangle soups as equi-joins on grid cells, probes and cameras around targets.

``triangles`` are those of ``rays``. A shape meets the triangles whose cells its own box overlaps; the
distance is a column expression, and a shape's candidates are reduced by partial aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnfield.functions.geometry import Vec, bound, cell, closest_on_segment, half_up, inner_gap, with_closest_on_triangle
from cairnfield.operators.rays import hit_distance, in_cells, occluded, odd_rays
from cairnfield.operators.sequence import ORD
from cairnfield.plans.storage import materialize, shuffled

#: Triangles that a shape meets in the first round, about.
FEW = 8.0

#: Triangles up to this number are broadcast to the points, whose rows then stay evenly dealt.
FEW_TRIANGLES = 1_000

#: Rays that lean a little off the vertical, so that none runs along an edge (fixed values).
TILT = (0.0123, 0.0071)

#: Shares of the distance that a camera tries along its bearing (fixed values).
DISTANCE_STEPS = (1.0, 0.6, 0.35)


def _corners() -> list[Vec]:
    return [Vec.of(n) for n in "abc"]


def _candidates_a_shape(triangles: DataFrame) -> tuple[Callable[[float], float], dict[str, float]]:
    """How many triangles' boxes, grown by a reach, a point meets, were they even; and the mean sides of the boxes."""
    side = {c: (F.least(f"a{c}", f"b{c}", f"c{c}"), F.greatest(f"a{c}", f"b{c}", f"c{c}")) for c in "xyz"}
    aggs = [f for c, (lo, hi) in side.items() for f in (F.min(lo).alias(f"lo_{c}"), F.max(hi).alias(f"hi_{c}"), F.avg(hi - lo).alias(f"mean_{c}"))]
    r = triangles.agg(F.count("*").alias("n"), *aggs).first()
    mean = {c: float(r[f"mean_{c}"] or 0.0) for c in "xyz"}
    span = {c: float(r[f"hi_{c}"] or 0.0) - float(r[f"lo_{c}"] or 0.0) for c in "xyz"}
    return lambda reach: r["n"] * math.prod(min(1.0, (mean[c] + 2 * reach) / (span[c] + 2 * reach)) for c in "xyz"), mean


def closest_points(points: DataFrame, triangles: DataFrame, reach: float) -> DataFrame:
    """The nearest surface point within ``reach`` (inclusive) of each point that has one: ord, tid, distance,
    x, y, z and the triangle's normal nx, ny, nz. Ties go to the smaller tid.

    Points are sought in rounds: one that has a triangle within a round's width is settled, as its nearest is among those;
    for the rest the width doubles, up to ``reach``. The first width gives a point about ``FEW`` triangles, so that the
    pairs tested don't grow with the density of triangles."""
    expected, mean = _candidates_a_shape(triangles)
    width = float(reach)
    while width > 0 and expected(width) > FEW and expected(width / 2) < expected(width) and width > reach / 2**20:
        width /= 2
    rest, out = points.select(ORD, *"xyz"), None
    while True:
        got = _closest_within(rest, triangles, width, mean)
        if width >= reach:
            return got if out is None else out.unionByName(got)
        got = materialize(got, "closest")
        out = got if out is None else out.unionByName(got)
        found = got.select(F.col(ORD).alias("__found"))
        rest = materialize(rest.join(found, F.col(ORD).eqNullSafe(F.col("__found")), "left_anti"), "closest-rest")
        if rest.isEmpty():
            return out
        width = min(2 * width, float(reach))


def _closest_within(points: DataFrame, triangles: DataFrame, reach: float, mean: dict[str, float]) -> DataFrame:
    """Triangles are dealt to the cells around them (few ones to all tasks), points to their own cell only. Cells are not much smaller than a triangle."""
    pad = reach * (1 + 1e-9)
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    flat, tall = max(pad, (mean["x"] + mean["y"]) / 8) or 1.0, max(2 * pad, mean["z"] / 4) or 1.0
    t = in_cells(triangles, flat, pad)
    t = t.withColumn("iz", F.explode(F.sequence(cell(F.least("az", "bz", "cz") - pad, tall), cell(F.greatest("az", "bz", "cz") + pad, tall))))
    p = points.select(ORD, *[F.col(c).alias("p" + c) for c in "xyz"], cell(F.col("x"), flat).alias("ix"), cell(F.col("y"), flat).alias("iy"), cell(F.col("z"), tall).alias("iz"))
    keys = ["ix", "iy", "iz"]
    if triangles.count() <= FEW_TRIANGLES:  # points on few cells would come to few tasks
        got = p.repartition(n).join(F.broadcast(t), keys)
    else:
        got = p.repartition(n, *keys).join(shuffled(t.repartition(n, *keys)), keys)
    for c in "zxy":
        got = got.where((F.col("p" + c) >= F.least(f"a{c}", f"b{c}", f"c{c}") - pad) & (F.col("p" + c) <= F.greatest(f"a{c}", f"b{c}", f"c{c}") + pad))
    got = with_closest_on_triangle(got, Vec.of("p"), *_corners()).withColumn("distance", F.sqrt("q.d2"))
    best = got.groupBy(ORD).agg(F.min_by(F.struct("tid", "distance", "q.x", "q.y", "q.z", "nx", "ny", "nz"), F.struct("distance", "tid")).alias("b"))
    return best.where(F.col("b.distance") <= reach).select(ORD, "b.*")  # only here: a filter before would compute each distance twice


def _met(shapes: DataFrame, triangles: DataFrame, size: float, low: Vec, high: Vec) -> DataFrame:
    """Shapes with the triangles whose boxes share a cell with theirs and meet them; several times where they share several."""
    n = int(shapes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = shapes.withColumns({f"__{e}{c}": getattr(v, c) for e, v in (("lo", low), ("hi", high)) for c in "xyz"})
    s = s.withColumn("ix", F.explode(F.sequence(cell(low.x, size), cell(high.x, size)))).withColumn("iy", F.explode(F.sequence(cell(low.y, size), cell(high.y, size))))
    got = s.repartition(n, "ix", "iy").join(shuffled(in_cells(triangles, size).repartition(n, "ix", "iy")), ["ix", "iy"])
    for c in "zxy":
        # a hair wider against rounding of the grown box
        wide = (F.abs(f"__lo{c}") + F.abs(f"__hi{c}")) * 1e-12
        got = got.where((F.col(f"__hi{c}") + wide >= F.least(f"a{c}", f"b{c}", f"c{c}")) & (F.col(f"__lo{c}") - wide <= F.greatest(f"a{c}", f"b{c}", f"c{c}")))
    return got


def _any(shapes: DataFrame, triangles: DataFrame, size: float, low: Vec, high: Vec, gap: Callable[[DataFrame], DataFrame], test: Callable[[Column, Column], Column]) -> DataFrame:
    """The shapes (by ord, with a radius) for which the distance to a triangle, whose square ``gap`` adds as gap, passes ``test``.

    Triangles come in shares by hash, each as large as all before it, and shapes that have passed leave. A shape without
    one is tested with every triangle near it; those with many are settled by the first shares, whose number grows with the density."""
    r = shapes.agg(F.max(F.greatest(*[(getattr(high, c) - getattr(low, c)) / 2 for c in "xyz"])).alias("r")).first()["r"]
    expected = _candidates_a_shape(triangles)[0](float(r or 0.0))
    shares = max(0, math.ceil(math.log2(max(expected, 1.0) / FEW)))
    part = F.pmod(F.xxhash64("tid", F.lit(7)), F.lit(2**shares))
    out, rest = None, shapes
    for i in range(shares + 1):
        some = triangles if shares == 0 else triangles.where((part >= (2 ** (i - 1) if i else 0)) & (part < 2**i))
        # least by shape first: a filter before it would compute each gap twice
        least = gap(_met(rest, some, size, low, high)).groupBy(ORD, "radius").agg(F.min("gap").alias("gap"))
        got = least.where(test(F.sqrt("gap"), F.col("radius"))).select(ORD).distinct()
        if i == shares:
            return got if out is None else out.unionByName(got)
        got = materialize(got, "met")
        out = got if out is None else out.unionByName(got)
        found = got.select(F.col(ORD).alias("__found"))
        rest = materialize(rest.join(found, F.col(ORD).eqNullSafe(F.col("__found")), "left_anti"), "met-rest")
        if rest.isEmpty():
            return out


def overlaps_sphere(spheres: DataFrame, triangles: DataFrame, size: float) -> DataFrame:
    """The spheres (ord, x, y, z, radius) that a surface touches or enters: ord."""
    s = spheres.select(ORD, *[F.col(c).alias("p" + c) for c in "xyz"], "radius")
    p, r = Vec.of("p"), Vec(*[F.col("radius")] * 3)
    gap = lambda met: with_closest_on_triangle(met, p, *_corners()).withColumn("gap", F.col("q.d2"))
    return _any(s, triangles, size, p - r, p + r, gap, lambda d, radius: d <= radius)


def _with_capsule_gap(df: DataFrame) -> DataFrame:
    """``df`` with the squared distance of the segment p to q and the triangle a, b, c in gap; needs ox .. dz and reach of the segment."""
    p, q, corners = Vec.of("p"), Vec.of("q"), _corners()
    df = with_closest_on_triangle(with_closest_on_triangle(df, p, *corners, "end0"), q, *corners, "end1")
    df, near = bound(df, **{f"c{i}": c - closest_on_segment(c, p, q) for i, c in enumerate(corners)})
    df, inner = bound(df, hit=hit_distance(True), **{f"i{i}": inner_gap(p, q, *side) for i, side in enumerate(zip(corners, corners[1:] + corners[:1], strict=True))})
    gaps = [F.col("end0.d2"), F.col("end1.d2"), *[v.dot(v) for v in near], *inner[1:]]
    return df.withColumn("gap", F.when(inner[0].isNotNull(), 0.0).otherwise(F.least(*gaps)))


def overlaps_capsule(capsules: DataFrame, triangles: DataFrame, size: float) -> DataFrame:
    """The capsules (ord, px, py, pz, qx, qy, qz, radius) nearer than their radius to a surface: ord."""
    p, q = Vec.of("p"), Vec.of("q")
    d = q - p
    s = capsules.select(ORD, *[f"{n}{c}" for n in "pq" for c in "xyz"], "radius", *[F.col("p" + c).alias("o" + c) for c in "xyz"], d.x.alias("dx"), d.y.alias("dy"), d.z.alias("dz"), F.lit(1.0).alias("reach"))
    low = Vec(*[F.least("p" + c, "q" + c) - F.col("radius") for c in "xyz"])
    high = Vec(*[F.greatest("p" + c, "q" + c) + F.col("radius") for c in "xyz"])
    return _any(s, triangles, size, low, high, _with_capsule_gap, lambda d, radius: d < radius)


def inside_solid(points: DataFrame, triangles: DataFrame, size: float, reach: float) -> DataFrame:
    """The points (by ord) whose rays up and down, of length ``reach``, both cross an odd number of surfaces."""
    n = (TILT[0] ** 2 + TILT[1] ** 2 + 1) ** 0.5
    both = points.withColumn("way", F.explode(F.array(F.lit(1.0), F.lit(-1.0))))
    r = both.select(F.struct(ORD, "way").alias("ray"), *[F.col(c).alias("o" + c) for c in "xyz"], F.lit(TILT[0] / n).alias("dx"), F.lit(TILT[1] / n).alias("dy"), (F.col("way") / n).alias("dz"), F.lit(float(reach)).alias("reach"))
    odd = odd_rays(r, triangles, size)
    return odd.groupBy(F.col(f"ray.{ORD}").alias(ORD)).agg(F.count("*").alias("ways")).where("ways = 2").select(ORD)


def standoff_plan(targets: DataFrame, count: int = 3, distance: float = 600.0, eye: float = 64.0, offset: float = 0.0, lift: float = 32.0, bounds: tuple[float, float, float, float] | None = None, triangles: DataFrame | None = None, size: float = 1000.0) -> tuple[DataFrame, DataFrame]:
    """Cameras around each target (ord, id, x, y, z) that look at it, and the targets without one.

    Each of ``count`` bearings takes its first distance inside ``bounds`` (low x, low y, high x, high y) from
    which no triangle hides the lifted target. Shots: id, group, x, y, z, look; skipped: id, blocked, outside."""
    if not 1 <= count <= 16 or distance <= 0:
        raise ValueError("count must be 1 to 16 and distance over 0")
    safe = F.substring(F.regexp_replace(F.col("id").cast("string"), "[^A-Za-z0-9._-]", "_"), 1, 100)
    t = targets.withColumn("base", F.when(F.length(safe) > 0, safe).otherwise("target"))
    n = F.row_number().over(Window.partitionBy("base").orderBy(ORD))  # only targets of one name share a task
    t = t.withColumn("n", n).withColumn("group", F.when(F.col("n") > 1, F.concat_ws("-", "base", F.col("n").cast("string"))).otherwise(F.col("base")))
    tries = t.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).select("*", F.posexplode(F.array(*[F.lit(distance * s) for s in DISTANCE_STEPS])).alias("step", "d"))
    angle = F.radians(F.lit(float(offset)) + F.col("k") * 360.0 / count)
    to = lambda c: half_up(c, 3) + 0.0
    tries = tries.withColumns({"px": to(F.col("x") + F.col("d") * F.cos(angle)), "py": to(F.col("y") + F.col("d") * F.sin(angle)), "pz": to(F.col("z") + eye), "ray": F.struct("group", "k", "step")})
    inside = F.lit(True) if bounds is None else F.col("px").between(bounds[0], bounds[2]) & F.col("py").between(bounds[1], bounds[3])
    free = tries.where(inside)
    if triangles is not None:
        sight = free.select("ray", *[F.col("p" + c).alias("a" + c) for c in "xyz"], F.col("x").alias("bx"), F.col("y").alias("by"), (F.col("z") + lift).alias("bz"))
        free = free.join(occluded(sight, triangles, size), "ray", "left_anti")
    best = free.groupBy("group", "k").agg(F.min_by(F.struct("px", "py", "pz", "x", "y", "z"), "step").alias("s"))
    shots = best.select(F.concat(F.col("group"), F.lit("-s"), (F.col("k") + 1).cast("string")).alias("id"), "group", F.col("s.px").alias("x"), F.col("s.py").alias("y"), F.col("s.pz").alias("z"), F.struct("s.x", "s.y", "s.z").alias("look"))
    none = tries.join(best.select("group").distinct(), "group", "left_anti")
    skipped = none.groupBy("group").agg(F.first("id").alias("id"), F.count_if(inside).alias("blocked"), F.count_if(~inside).alias("outside"))
    return shots, skipped.drop("group")
