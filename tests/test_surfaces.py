"""Nearest surfaces, overlaps, probes, snapping, walks and cameras on small scenes and against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnfield.operators import nav, rays, surfaces
from tests.test_map import grid_mesh, points, soup


def spread(t, n=80):
    """Points all over a triangle."""
    a, b, c = (np.array(p, float) for p in t)
    u, v = np.meshgrid(np.linspace(0, 1, n), np.linspace(0, 1, n))
    ok = u + v <= 1 + 1e-12
    return a + u[ok][:, None] * (b - a) + v[ok][:, None] * (c - a)


@pytest.fixture(scope="module")
def scene():
    r = random.Random(5)
    at = lambda w=100: [r.uniform(-w, w) for _ in range(3)]
    base = [at() for _ in range(25)]
    return [[[x + d for x, d in zip(b, at(30), strict=True)] for _ in range(3)] for b in base], [at() for _ in range(40)], [at(40) for _ in range(40)]


def test_closest_points_equal_brute_force(spark, scene):
    tris, pts, _ = scene
    got = {r.ord: r for r in surfaces.closest_points(points(spark, [("p", *p) for p in pts]), soup(spark, tris), 90.0).collect()}
    clouds = [spread(t) for t in tris]
    for i, p in enumerate(pts):
        d = [np.linalg.norm(c - np.array(p), axis=1).min() for c in clouds]
        if min(d) <= 90.0:
            assert min(d) - 1.0 <= got[i].distance <= min(d) + 1e-9
            assert abs(np.linalg.norm(np.array([got[i].x, got[i].y, got[i].z]) - p) - got[i].distance) < 1e-9
            assert d[got[i].tid] <= min(d) + 1.0
        elif i in got:
            assert got[i].distance > min(d) - 1.0


def test_overlaps_equal_brute_force(spark, scene):
    tris, pts, ends = scene
    clouds = np.concatenate([spread(t) for t in tris])
    ball = np.array([np.linalg.norm(clouds - np.array(p), axis=1).min() for p in pts])
    got = {r.ord for r in surfaces.overlaps_sphere(points(spark, [("p", *p) for p in pts]).withColumn("radius", F.lit(30.0)), soup(spark, tris), 50.0).collect()}
    assert all((i in got) == (d <= 30.0) for i, d in enumerate(ball) if abs(d - 30.0) > 1.0)
    lines = [(i, *map(float, p), *(x + y for x, y in zip(p, e, strict=True)), 12.0) for i, (p, e) in enumerate(zip(pts, ends, strict=True))]
    caps = spark.createDataFrame(lines, "ord long, px double, py double, pz double, qx double, qy double, qz double, radius double")
    near = []
    for row in lines:
        along = np.array(row[1:4]) + np.linspace(0, 1, 60)[:, None] * (np.array(row[4:7]) - np.array(row[1:4]))
        near.append(min(np.linalg.norm(clouds - a, axis=1).min() for a in along))
    got = {r.ord for r in surfaces.overlaps_capsule(caps, soup(spark, tris), 50.0).collect()}
    assert all((i in got) == (d < 12.0) for i, d in enumerate(near) if abs(d - 12.0) > 2.0)
    through = spark.createDataFrame([(0, 2.0, 2.0, -50.0, 2.0, 2.0, 50.0, 0.5), (1, 2.0, 2.0, 1.0, 2.0, 2.0, 50.0, 1.0)], caps.schema)
    assert [r.ord for r in surfaces.overlaps_capsule(through, soup(spark, [((0, 0, 0), (10, 0, 0), (0, 10, 0))]), 20.0).collect()] == [0]


def test_nothing_near_and_empty_tables(spark):
    one, none = soup(spark, [((0, 0, 0), (1, 0, 0), (0, 1, 0))]), soup(spark, [])
    far = points(spark, [("a", 50, 0, 0)])
    assert surfaces.closest_points(far, one, 10.0).count() == 0
    assert surfaces.closest_points(far, none, 10.0).count() == 0
    assert surfaces.overlaps_sphere(far.withColumn("radius", F.lit(2.0)), none, 10.0).count() == 0


def test_inside_box(spark):
    quad = lambda a, b, c, d: [(a, b, c), (a, c, d)]
    v = [(x, y, z) for x in (0, 10) for y in (0, 10) for z in (0, 10)]
    box = [t for q in ((0, 1, 3, 2), (4, 5, 7, 6), (0, 1, 5, 4), (2, 3, 7, 6), (0, 2, 6, 4), (1, 3, 7, 5)) for t in quad(*(v[i] for i in q))]
    got = surfaces.inside_solid(points(spark, [("in", 4, 5, 5), ("over", 4, 5, 15), ("out", 40, 5, 5)]), soup(spark, box), 20.0, 100.0)
    assert [r.ord for r in got.collect()] == [0]


def test_snap_takes_the_nearest_point(spark):
    mesh = grid_mesh(spark, 3, 1000.0, 0.0)
    p = points(spark, [("on", 1999, 1, 0), ("over", 500, 500, 300), ("edge", 1000, 500, 0), ("off", -700, 1500, 0), ("far", 9000, 0, 0)])
    got = {r.ord: (r.pid, r.gap, r.x, r.y, r.z) for r in nav.snap(p, mesh).collect()}
    assert got == {0: (3, 0.0, 1999.0, 1.0, 0.0), 1: (0, 300.0, 500.0, 500.0, 0.0), 2: (0, 0.0, 1000.0, 500.0, 0.0), 3: (1, 700.0, 0.0, 1500.0, 0.0)}
    assert nav.snap(p, mesh.limit(0)).count() == 0


def test_walks_and_islands(spark):
    mesh = grid_mesh(spark, 3, 100.0, 0.0)
    s = spark.createDataFrame([(0, 10.0, 10.0, 0.0, 290.0, 290.0, 0.0), (1, 10.0, 10.0, 0.0, 400.0, 10.0, 0.0), (2, 10.0, 10.0, 0.0, 10.0, 10.0, 0.0)], "ray long, ax double, ay double, az double, bx double, by double, bz double")
    assert {r.ray: r.walkable for r in nav.walkable(s, mesh).collect()} == {0: True, 1: False, 2: True}
    assert {r.ray: r.walkable for r in nav.walkable(s, mesh, spark.createDataFrame([(4,)], "pid long")).collect()} == {0: False, 1: False, 2: True}
    isle = spark.createDataFrame([(50, [(350.0, 0.0, 0.0), (370.0, 0.0, 0.0), (370.0, 100.0, 0.0), (350.0, 100.0, 0.0)]), (60, [(350.0, 200.0, 500.0), (370.0, 200.0, 500.0), (370.0, 300.0, 500.0), (350.0, 300.0, 500.0)])], mesh.schema)
    pieces = nav.mesh_components(nav.adjacency(mesh))
    assert [tuple(r) for r in nav.island_links(mesh.union(isle), pieces, 1).collect()] == [(50, 6, "navConnection", True)]


def test_standoff_cameras(spark):
    t = points(spark, [("a b", 0, 0, 0), ("a_b", 2000, 0, 0), ("walled", 0, 5000, 0)])
    wall = [((x * 50, 4900, -100), (x * 50, 5100, -100), (x * 50, 5000, 500)) for x in (1, -1)] + [((-100, 5000 + y * 50, -100), (100, 5000 + y * 50, -100), (0, 5000 + y * 50, 500)) for y in (1, -1)]
    shots, skipped = surfaces.standoff_plan(t, 2, 100.0, triangles=soup(spark, wall))
    got = {r.id: (r.group, r.x, r.y, r.z, r.look.x) for r in shots.collect()}
    assert {k: v for k, v in got.items() if k.startswith("a")} == {"a_b-s1": ("a_b", 100.0, 0.0, 64.0, 0.0), "a_b-s2": ("a_b", -100.0, 0.0, 64.0, 0.0), "a_b-2-s1": ("a_b-2", 2100.0, 0.0, 64.0, 2000.0), "a_b-2-s2": ("a_b-2", 1900.0, 0.0, 64.0, 2000.0)}
    assert {k: v[1:3] for k, v in got.items() if k.startswith("w")} == {"walled-s1": (35.0, 5000.0), "walled-s2": (-35.0, 5000.0)}
    shots, skipped = surfaces.standoff_plan(t, 2, 100.0, bounds=(-500.0, -500.0, 500.0, 500.0))
    assert {r.id: (r.blocked, r.outside) for r in skipped.collect()} == {"a_b": (0, 6), "walled": (0, 6)}
    with pytest.raises(ValueError):
        surfaces.standoff_plan(t, 0)


def test_dense_surfaces_are_sought_in_rounds(spark, monkeypatch):
    r = random.Random(11)
    tris = [[[x + r.uniform(-4, 4), y + r.uniform(-4, 4), z + r.uniform(-1, 1)] for _ in range(3)] for x, y, z in ([r.uniform(0, 60), r.uniform(0, 60), r.uniform(0, 60)] for _ in range(1500))]
    pts = points(spark, [("p", *(r.uniform(-20, 80) for _ in range(3))) for _ in range(60)])
    within, widths, shares = surfaces._closest_within, [], []
    monkeypatch.setattr(surfaces, "_closest_within", lambda p, t, w, m: widths.append(w) or within(p, t, w, m))
    met = surfaces._met
    monkeypatch.setattr(surfaces, "_met", lambda s, t, *a: shares.append(t.count()) or met(s, t, *a))
    soup_ = soup(spark, tris)
    got = {x.ord: x for x in surfaces.closest_points(pts, soup_, 40.0).collect()}
    assert widths[0] < 10.0 and widths[-1] <= 40.0
    _, mean = surfaces._candidates_a_shape(soup_)
    assert got == {x.ord: x for x in within(pts, soup_, 40.0, mean).collect()}
    balls = pts.withColumn("radius", F.lit(12.0))
    assert {x.ord for x in surfaces.overlaps_sphere(balls, soup_, 20.0).collect()} == {i for i, x in got.items() if x.distance <= 12.0}
    assert len(shares) > 1 and shares[0] < 400 and sum(shares) <= 1500


def test_rays_of_one_cell_are_counted(spark):
    cols = ", ".join(f"{n}{c} double" for n in "abc" for c in "xyz")
    flat = lambda t, z: (t, -10.0, -10.0, z, 90.0, -10.0, z, -10.0, 90.0, z)
    t = spark.createDataFrame([flat(i, float(i)) for i in range(1, 4)], f"tid long, {cols}")
    tilt = 0.6, 0.8  # crosses cells of 5 units
    r = spark.createDataFrame([(1, 2.0, 2.0, 0.0, 0.0, 0.0, 1.0, 10.0), (2, 2.0, 2.0, 0.0, 0.0, 0.0, 1.0, 2.5), (3, 2.0, 2.0, 0.0, tilt[0], 0.0, tilt[1], 20.0), (4, 2.0, 2.0, 2.5, tilt[0], 0.0, -tilt[1], 20.0)], "ray long, ox double, oy double, oz double, dx double, dy double, dz double, reach double")
    assert sorted(x.ray for x in rays.odd_rays(r, t, 5.0).collect()) == [1, 3]


def test_points_over_few_triangles_stay_dealt(spark, monkeypatch):
    p = spark.range(200).selectExpr("id AS ord", "CAST(id % 2 AS double) AS x", "0.5D AS y", "1D AS z")
    cols = ", ".join(f"{n}{c} double" for n in "abc" for c in "xyz")
    t = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 9.0, 0.0, 0.0, 0.0, 9.0, 0.0)], f"tid long, {cols}")
    few = surfaces.closest_points(p, t, 2.0)
    assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, few.collect()))
    monkeypatch.setattr(surfaces, "FEW_TRIANGLES", 0)
    assert got == sorted(map(tuple, surfaces.closest_points(p, t, 2.0).collect())) and len(got) == 200
