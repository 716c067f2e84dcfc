"""Steps whose rows, memory or shuffles would otherwise grow faster than the input, or stay in one task."""

import random

import pytest

from cairnfield.operators import entities as E
from cairnfield.operators import meshes, metadata
from cairnfield.operators.sequence import ORD, Seq


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_dealt_over_blocks(spark):
    rng = random.Random(1)
    ords = rng.sample(range(10_000), 900)
    got = Seq(spark.createDataFrame([(o, -o) for o in ords], "ord long, v long").coalesce(1)).pairs(["v"])
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    rows = got.select("a_v", "b_v").collect()
    assert len(rows) == len(set(rows)) == 900 * 899 // 2 and all(r.a_v > r.b_v for r in rows)
    assert min(got.rdd.glom().map(len).collect()) > 0  # every task has a share


def test_few_or_no_rows_make_pairs_too(spark):
    few = lambda n: Seq(spark.createDataFrame([(i, i) for i in range(n)], "ord long, v long")).pairs(["v"]).count()
    assert [few(n) for n in (0, 1, 3)] == [0, 0, 3]


POINTS = "ord long, id string, kind string, x double, y double, z double"


def scatter(seed, n, prefix):
    rng = random.Random(seed)
    return [(i, f"{prefix}{i}", rng.choice(["creepCamp", "healingOrb"]), *(rng.uniform(0, 10) for _ in "xyz")) for i in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize("radius", [0.5, 2.0, 0.0])
def test_the_first_entity_in_reach_over_rounds(spark, radius, monkeypatch):
    monkeypatch.setattr(E, "FIRST_TRIED", 20)  # so that three rounds are needed
    records, entities = scatter(2, 200, "r"), scatter(3, 300, "e")
    records.append((99_999, "r", *entities[0][2:]))
    want = {r[0]: min((e for e in entities if e[2] == r[2] and sum((a - b) ** 2 for a, b in zip(r[3:], e[3:], strict=True)) <= radius**2), default=None) for r in records}
    got = metadata.merge_outcomes(spark.createDataFrame([(*r, "accepted") for r in records], POINTS + ", status string"), spark.createDataFrame(entities, POINTS), radius)
    assert {r[ORD]: r.duplicate_of for r in got.collect()} == {k: v and v[1] for k, v in want.items()}


def test_entities_that_all_lie_in_reach_are_not_all_paired(spark, monkeypatch):
    monkeypatch.setattr(E, "FIRST_TRIED", 10)
    tried = []
    near = E.near
    monkeypatch.setattr(E, "near", lambda left, right, *more: tried.append((left.count(), right.count())) or near(left, right, *more))
    records, entities = scatter(4, 50, "r"), scatter(5, 500, "e")
    got = metadata.merge_outcomes(spark.createDataFrame([(*r, "accepted") for r in records], POINTS + ", status string"), spark.createDataFrame(entities, POINTS), 100.0)
    assert got.where("outcome = 'duplicate'").count() == 50
    assert sum(a * b for a, b in tried) < 50 * 100


def test_cell_joins_are_dealt_to_all_tasks(spark):
    one = spark.createDataFrame(scatter(6, 400, "p"), POINTS).coalesce(1)
    got = E.near(one, one, 1.0)
    assert "Broadcast" not in plan(got) and got.rdd.getNumPartitions() == 4
    assert E.nearest(one, one.withColumn(ORD, one[ORD] + 1)).where("dist > 0").count() == 0


def test_what_a_nested_value_holds_is_taken_out_once_a_level(spark):
    from pyspark.sql import functions as F

    from cairnfield.functions import nested

    df = spark.createDataFrame([(1, '{"a": [1, "x"], "b": {"c": [2, 3]}}')], "id long, text string")
    got = nested.flattened(df, "id", F.parse_json("text"))
    assert plan(got).count("try_variant_get") <= 4 * (nested.MAX_DEPTH + 1)  # its list, its fields, its text and its numbers' text
    assert [(r.key, r.value) for r in got.orderBy("n").collect()] == [("a[0]", "1"), ("a[1]", "x"), ("b.c", "[2, 3]")]


POLYGONS = "pid long, points array<struct<x: double, y: double, z: double>>"


def quad(x0, y0, x1, y1):
    return [(x0, y0, 0.0), (x1, y0, 0.0), (x1, y1, 0.0), (x0, y1, 0.0)]


def test_vertices_weld_in_one_exchange(spark):
    pool = spark.createDataFrame([(3, 1.0, 2.0, 0.0), (1, 1.001, 2.0, 0.0), (2, 5.0, 2.0, 0.0), (4, None, 2.0, 0.0)], "vid long, x double, y double, z double")
    got = meshes.welded(pool)
    assert plan(got).count("Exchange") == 1
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, 1.001, 2.0, 0.0), (2, 2, 5.0, 2.0, 0.0), (3, 1, 1.001, 2.0, 0.0)]


def test_only_sides_on_a_border_are_counted(spark, monkeypatch):
    seen = []
    single = meshes._single
    monkeypatch.setattr(meshes, "_single", lambda s, *more: seen.append(s.count()) or single(s, *more))
    mesh = spark.createDataFrame([(0, quad(0.0, 0.0, 10.0, 10.0)), (1, quad(10.0, 0.0, 20.0, 6.0)), (2, quad(10.0, 6.0, 20.0, 10.0)), (3, quad(50.0, 50.0, 60.0, 60.0))], POLYGONS)
    lines = spark.createDataFrame([("x", 10.0), ("y", 50.0)], "axis string, line double")
    got, split = meshes.stitched_borders(mesh, lines, 1.0)
    assert seen == [4]  # of 16
    assert [(p.x, p.y) for p in got.where("pid = 0").first().points] == [(0, 0), (10, 0), (10, 6), (10, 10), (0, 10)]
    assert [tuple(r) for r in split.collect()] == [(0, 1, 1)]


def test_base_corners_that_nobody_asks_for_are_left_out(spark):
    base = spark.createDataFrame([(i, quad(10.0 * i, 0.0, 10.0 * i + 10, 10.0)) for i in range(4)], POLYGONS)
    added = spark.createDataFrame([(0, quad(0.1, -10.0, 10.1, 0.1))], POLYGONS.replace("pid", "ord"))
    got = meshes.with_polygons(base, added)
    assert "LeftSemi" in plan(got)
    assert [(p.x, p.y) for p in got.where("pid = 4").first().points] == [(0.1, -10.0), (10.1, -10.0), (10.0, 0.0), (0.0, 0.0)]


def test_a_node_meets_its_connections_once(spark):
    mesh = spark.createDataFrame([(i, quad(10.0 * i, 0.0, 10.0 * i + 10, 10.0)) for i in range(4)], POLYGONS)
    faces = spark.createDataFrame([(0, 0), (1, 1), (2, 2), (3, 3), (4, None), (5, 1)], "face long, pid long")
    pieces = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "pid long, component long")
    nodes = spark.createDataFrame([(0, 1, [1, 2, 6]), (0, 2, [5])], "hull int, node long, nav_ids array<long>")
    to = spark.createDataFrame([(0, 1, 3), (0, 1, 3), (0, 1, 1), (0, 1, 5), (0, 2, 1), (0, 3, 1)], "hull int, node long, nav_id long")
    links, out = meshes.flow_links(nodes, to, faces, mesh, pieces)
    assert plan(links).count("SortMergeJoin") <= 7 and plan(out).count("SortMergeJoin") <= 5
    assert [(r.from_pid, r.to_pid) for r in links.collect()] == [(1, 2)]
    assert sorted(tuple(r) for r in out.collect()) == [(0, 1, 1, "same component"), (0, 1, 5, "unresolved"), (0, 2, 1, "unresolved"), (0, 3, 1, "unresolved")]
