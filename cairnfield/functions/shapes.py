"""Shapes on a screen: editing of vertices, the nearest edge or vertex, snapping and picking.

``project`` maps a point column (struct x, y, z) to a struct x, y on the screen, or null behind the eye."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.plans.storage import materialize, shuffled

#: Least number of vertices of the kinds that may have any number, radii in pixels, a point's size.
LEAST = {"polyline": 2, "polygon": 3}
EDGE_RADIUS, VERTEX_RADIUS, PICK_RADIUS, POINT_SIZE = 8.0, 9.0, 8.0, 8.0

#: Boxes of features that a click meets in the first round of ``picked``, about.
FEW = 32.0

Project = Callable[[Column], Column]


def flat(p: Column) -> Column:
    """The map seen from above: x and y as they are."""
    return F.struct(p["x"].alias("x"), p["y"].alias("y"))


def _free(kind: Column) -> Column:
    return kind.isin(*LEAST)


def moved_vertex(points: Column, index: Column, to: Column) -> Column:
    """``points`` with one vertex elsewhere; unchanged for an index that there isn't."""
    return F.transform(points, lambda p, i: F.when(i == index, to).otherwise(p))


def with_vertex(points: Column, kind: Column, after: Column, at: Column) -> Column:
    """``points`` with a vertex after another one; null for kinds of fixed size and vertices that aren't there."""
    fits = _free(kind) & (after >= 0) & (after < F.size(points))
    return F.when(fits, F.concat(F.slice(points, F.lit(1), after + 1), F.array(at), F.slice(points, F.greatest(after, F.lit(0)) + 2, F.size(points))))


def without_vertex(points: Column, kind: Column, index: Column) -> Column:
    """``points`` without one vertex; null where too few would be left."""
    least = F.create_map(*[F.lit(v) for kv in LEAST.items() for v in kv])[kind]
    fits = _free(kind) & (F.size(points) > least) & (index >= 0) & (index < F.size(points))
    return F.when(fits, F.filter(points, lambda _, i: i != index))


def _along(s: Column, e: Column, px: Column, py: Column) -> tuple[Column, Column]:
    """How far along an edge the place nearest to a pixel is, 0 to 1, and its distance."""
    dx, dy = e["x"] - s["x"], e["y"] - s["y"]
    n = dx * dx + dy * dy
    t = F.when(n == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - s["x"]) * dx + (py - s["y"]) * dy) / F.nullif(n, F.lit(0.0)))))
    return t, F.hypot(px - s["x"] - t * dx, py - s["y"] - t * dy)


def nearest_edge(points: Column, kind: Column, px: Column, py: Column, project: Project = flat, radius: float = EDGE_RADIUS) -> Column:
    """(after, point): the edge nearest to a pixel within ``radius`` and the point on it; a polygon has a closing edge. Of equally near
    ones (to a billionth: two edges that meet in the nearest vertex) the last. Null if there is none, and for kinds of fixed size."""
    n = F.size(points)

    def edge(i: Column) -> Column:
        p, q = F.get(points, i), F.get(points, (i + 1) % n)
        t, d = _along(project(p), project(q), px, py)
        at = F.struct(*[(p[c] + (q[c] - p[c]) * t).alias(c) for c in "xyz"])
        return F.struct(d.alias("d"), (-i).alias("last"), i.alias("after"), at.alias("point"))

    every = F.sequence(F.lit(0), F.when(kind == "polygon", n).otherwise(n - 1) - 1)
    met = F.filter(F.transform(F.when(n >= 2, every), edge), lambda e: e["d"] <= radius)
    best = F.array_min(F.transform(met, lambda e: F.struct(F.round(e["d"], 9).alias("d"), e["last"].alias("last"), e["after"].alias("after"), e["point"].alias("point"))))
    return F.when(_free(kind) & best.isNotNull(), F.struct(best["after"].alias("after"), best["point"].alias("point")))


def nearest_vertex(points: Column, px: Column, py: Column, project: Project = flat, radius: float = VERTEX_RADIUS) -> Column:
    """Index of the vertex nearest to a pixel within ``radius``; the last of equally near ones."""
    spot = lambda p, i: F.struct(F.hypot(project(p)["x"] - px, project(p)["y"] - py).alias("d"), (-i).alias("last"))
    return -F.array_min(F.filter(F.transform(points, spot), lambda s: s["d"] <= radius))["last"]


def snapped(px: Column, py: Column, features: Column, triangle: Column, surface: Column, plane: Column, project: Project = flat, radius: float = VERTEX_RADIUS, use: tuple[str, ...] = ("feature", "vertex", "surface")) -> Column:
    """(point, kind) where a click lands: the nearest of ``features`` (points), else the nearest corner of the ``triangle`` under it, else the
    ``surface`` point, else the ``plane`` point; null without any. Kinds not in ``use`` are passed over; corners need a surface."""
    pick = lambda ps: F.get(ps, nearest_vertex(ps, px, py, project, radius))
    told = {"feature": pick(features), "vertex": F.when(surface.isNotNull(), pick(triangle)), "surface": surface}
    ways = [(told[k], k) for k in ("feature", "vertex", "surface") if k in use] + [(plane, "plane")]
    return F.coalesce(*[F.when(p.isNotNull(), F.struct(p.alias("point"), F.lit(k).alias("kind"))) for p, k in ways])


def centre(points: Column) -> Column:
    """Where to look for a shape: the mean of its points; null without any."""
    total = lambda c: F.aggregate(points, F.lit(0.0), lambda s, p: s + p[c])
    return F.when(F.size(points) > 0, F.struct(*[(total(c) / F.size(points)).alias(c) for c in "xyz"]))


def picked(clicks: DataFrame, features: DataFrame, project: Project = flat, radius: float = PICK_RADIUS, cell: float = 64.0) -> DataFrame:
    """(click, id): the feature nearest to each click (click, px, py) within ``radius``; of equally near ones the last by ord.

    features: ord, id, kind (point, segment, polyline or polygon), points and size. A point's radius is half its size if that is
    more; a polygon is at distance 0 inside. Lines with a point behind the eye aren't met. Clicks and features meet by
    cells of the screen that a feature's box, grown by its radius, covers. Features come in shares from the last ord down, each
    four times as large as the one before: a click that has one at distance 0 is settled, as nothing before it can win, and the others
    go on. The first share gives a click about ``FEW`` boxes, so that the pairs tested don't grow with the density of features."""
    spots = F.transform("points", project)
    f = features.withColumn("at", spots).where((F.size("at") > 0) & ~F.exists("at", lambda s: s.isNull()))
    f = f.withColumn("reach", F.when(F.col("kind") == "point", F.greatest(F.lit(radius), F.coalesce("size", F.lit(POINT_SIZE)) / 2)).otherwise(F.lit(radius)))
    low = lambda c: F.array_min(F.transform("at", lambda s: s[c])) - F.col("reach")
    high = lambda c: F.array_max(F.transform("at", lambda s: s[c])) + F.col("reach")
    f = f.select("ord", "id", "kind", "at", "reach", *[e(c).alias(f"__{n}{c}") for n, e in (("lo", low), ("hi", high)) for c in "xy"])
    k = clicks.withColumns({"__x": F.floor(F.col("px") / cell), "__y": F.floor(F.col("py") / cell)})
    px, py, n = F.col("px"), F.col("py"), F.size("at")

    def edge(i: Column) -> Column:
        a, b = F.get("at", i), F.get("at", (i + 1) % n)
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        return F.struct(a["x"].alias("x"), a["y"].alias("y"), b["y"].alias("ey"), dx.alias("dx"), dy.alias("dy"), (dx * dx + dy * dy).alias("n2"))

    # what depends on a feature alone is computed once, not for each pair
    edges = F.greatest(F.when(F.col("kind") == "polygon", n).otherwise(n - 1), F.lit(1))
    f = f.withColumn("edges", F.transform(F.sequence(F.lit(0), edges - 1), edge)).drop("at")

    def gap(e: Column) -> Column:
        t = F.when(e["n2"] == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - e["x"]) * e["dx"] + (py - e["y"]) * e["dy"]) / F.nullif(e["n2"], F.lit(0.0)))))
        return F.hypot(px - e["x"] - t * e["dx"], py - e["y"] - t * e["dy"])

    crosses = lambda e: ((e["y"] > py) != (e["ey"] > py)) & (px < e["dx"] * (py - e["y"]) / F.nullif(e["dy"], F.lit(0.0)) + e["x"])
    inside = (F.col("kind") == "polygon") & (F.size(F.filter("edges", crosses)) % 2 == 1)
    first = F.get("edges", F.lit(0))
    d = F.when(F.col("kind") == "point", F.hypot(first["x"] - px, first["y"] - py)).when(inside, F.lit(0.0)).otherwise(F.array_min(F.transform("edges", gap)))
    near_box = [F.col(f"p{c}").between(F.col(f"__lo{c}") - 1e-6, F.col(f"__hi{c}") + 1e-6) for c in "xy"]
    f, rest, out = materialize(f, "picked-features"), k, None
    shares = _shares_by_ord(f)
    for i, share in enumerate(shares):
        some = f.where(share)
        for c in "xy":
            some = some.withColumn(f"__{c}", F.explode(F.sequence(F.floor(F.col(f"__lo{c}") / cell), F.floor(F.col(f"__hi{c}") / cell))))
        met = rest.join(shuffled(some), ["__x", "__y"]).where(near_box[0] & near_box[1]).withColumn("d", F.explode(F.array(d))).where(F.col("d") <= F.col("reach"))
        got = met.groupBy("click").agg(F.min(F.struct("d", (-F.col("ord")).alias("last"))).alias("m"), F.min_by("id", F.struct("d", -F.col("ord"))).alias("id"))
        got = got if len(shares) == 1 else materialize(got, "picked")
        out = got if out is None else out.unionByName(got)
        if i + 1 < len(shares):
            done = got.where("m.d = 0").select(F.col("click").alias("__done"))
            rest = materialize(rest.join(done, F.col("click").eqNullSafe(F.col("__done")), "left_anti"), "picked-rest")
            if rest.isEmpty():
                break
    return out.groupBy("click").agg(F.min_by("id", "m").alias("id"))


def _shares_by_ord(f: DataFrame) -> list[Column]:
    """Conditions that part features (ord, __lox .. __hiy) by falling ord; the bounds are approximate, the parts whole."""
    sides = [g for c in "xy" for g in (F.min(f"__lo{c}").alias(f"lo{c}"), F.max(f"__hi{c}").alias(f"hi{c}"), F.avg(F.col(f"__hi{c}") - F.col(f"__lo{c}")).alias(f"mean{c}"))]
    r = f.agg(F.count("*").alias("n"), *sides).first()
    expected = float(r["n"])
    for c in "xy":
        span = (r[f"hi{c}"] or 0.0) - (r[f"lo{c}"] or 0.0)
        expected *= r[f"mean{c}"] / span if span > 0 and math.isfinite(span) else 1.0
    n = math.ceil(math.log(max(expected, 1.0) / FEW, 4)) if FEW < expected < math.inf else 0
    if n == 0:
        return [F.lit(True)]
    bounds = f.agg(F.percentile_approx("ord", [1 - 4.0**-i for i in range(n, 0, -1)], 100_000)).first()[0] or []
    o, before = F.col("ord"), [F.lit(False), *[F.col("ord").isNull() | (F.col("ord") >= b) for b in bounds]]
    return [(o.isNull() | (o >= b)) & ~w for b, w in zip(bounds, before, strict=False)] + [~before[-1]]


def document_type(json: Column) -> Column:
    """Kind of a metadata document by its fields: bundle, submission or file; null if it isn't JSON."""
    v = F.try_parse_json(json)
    has = lambda c: F.coalesce(F.array_contains(F.json_object_keys(json), c), F.lit(False))
    return F.when(v.isNotNull(), F.when(has("contentHash"), "bundle").when(has("createdAt") | has("submitter"), "submission").otherwise("file"))


#: Most bytes of a document of each kind (fixed values).
MAX_BYTES = {"submission": 256 * 1024, "file": 5 * 1024 * 1024, "bundle": 20 * 1024 * 1024}


def oversized(json: Column, kind: Column) -> Column:
    """Whether a document is larger than its kind may be."""
    return F.octet_length(json) > F.create_map(*[F.lit(v) for kv in MAX_BYTES.items() for v in kv])[kind]
