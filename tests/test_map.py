"""The map operators against literal scenes with known answers."""

import pytest
from pyspark.sql import functions as F

from cairnfield.functions.geometry import Vec, angle_between, path_measure, ring_area, segments_cross
from cairnfield.operators import entities, metadata, nav, rays, routes
from cairnfield.operators.entities import EntityList
from cairnfield.operators.sequence import Seq, dense_index
from cairnfield.plans import tables
from cairnfield.sources import readers

GUARDIANS = [("guardian-1-2", -2500, -2000, 2, 1), ("guardian-1-3", 2500, -2000, 3, 1), ("guardian-2-2", -2500, 0, 2, 2), ("guardian-2-3", 2500, 0, 3, 2), ("guardian-3-2", -2500, 2000, 2, 3), ("guardian-3-3", 2500, 2000, 3, 3)]
ORBS = [("orb-1", -800, 400, 20), ("orb-2", 800, -400, 20), ("orb-3", 1500, -1000, 620), ("orb-4", 0, 1000, 20)]
CAMPS = [("camp-1", -1000, -1000, 20), ("camp-2", 1000, 1000, 20), ("camp-3", 0, -2500, 20)]


def points(spark, rows, kind="p"):
    return spark.createDataFrame([(i, r[0], kind, float(r[1]), float(r[2]), float(r[3])) for i, r in enumerate(rows)], "ord long, id string, kind string, x double, y double, z double")


def soup(spark, triangles):
    return spark.createDataFrame([(i, *map(float, (c for p in t for c in p))) for i, t in enumerate(triangles)], "tid long, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double")


def square(x0, y0, x1, y1, z):
    return [((x0, y0, z), (x1, y0, z), (x1, y1, z)), ((x0, y0, z), (x1, y1, z), (x0, y1, z))]


def test_nearest_orb_of_each_guardian(spark):
    g = points(spark, [(n, x, y, 20) for n, x, y, _, _ in GUARDIANS])
    got = {r.id: (r.r_id, round(r.dist, 3)) for r in entities.nearest(g, points(spark, ORBS)).collect()}
    assert got == {"guardian-1-2": ("orb-1", 2941.088), "guardian-1-3": ("orb-3", 1536.229), "guardian-2-2": ("orb-1", 1746.425), "guardian-2-3": ("orb-3", 1536.229), "guardian-3-2": ("orb-1", 2334.524), "guardian-3-3": ("orb-4", 2692.582)}


def test_cells_and_closest(spark):
    camps = EntityList(points(spark, CAMPS, "creepCamp"))
    assert [r.region.key for r in camps.creep_camps.group_by_region(1000).to_rows()] == ["-1,-1", "0,-3", "1,1"]
    assert [r.id for r in camps.closest_n((0, 0, 20), 2).collect()] == ["camp-1", "camp-2"]
    heat = entities.density(points(spark, [("a", 0, 0, 0), ("b", 1, 1, 5), ("c", 2500, 0, 0)]), 2000)
    assert [r["count"] for r in heat.to_rows()] == [2, 1]
    lanes = entities.as_entities(spark.createDataFrame([(0, "g", 1), (1, "h", None)], "ord long, id string, lane int"))
    assert [r.id for r in EntityList(lanes).in_lane("yellow").to_rows()] == ["g"]
    with pytest.raises(AttributeError):
        camps.nothing_like_this  # noqa: B018


def test_near_equals_brute_force(spark):
    import random

    r = random.Random(3)
    a = [(f"a{i}", r.uniform(-500, 500), r.uniform(-500, 500), r.uniform(-100, 100)) for i in range(120)]
    b = [(f"b{i}", r.uniform(-500, 500), r.uniform(-500, 500), r.uniform(-100, 100)) for i in range(60)]
    d = lambda p, q: sum((p[k] - q[k]) ** 2 for k in (1, 2, 3)) ** 0.5
    got = {(x.id, x.r_id) for x in entities.near(points(spark, a), points(spark, b), 90.0).collect()}
    assert got == {(p[0], q[0]) for p in a for q in b if d(p, q) <= 90.0}


def test_nearest_of_many_equals_brute_force(spark):
    import numpy as np

    r = np.random.default_rng(8)
    b = r.uniform(0, 900, (10_500, 3)).round(1)
    b[:9000] = b[:9000] / 30  # most in one corner
    a = np.concatenate([r.uniform(0, 900, (60, 3)), [[-9000, 40, 0], [9e4, 9e4, 9e4]], b[:3]])
    left, right = points(spark, [(f"a{i}", *x) for i, x in enumerate(a.tolist())]), points(spark, [(f"b{i}", *x) for i, x in enumerate(b.tolist())])
    d = np.sqrt(((a[:, None] - b) ** 2).sum(2))
    want = d.argsort(1, kind="stable")
    got = {x.ord: (x.r_ord, round(x.dist, 6)) for x in entities.nearest(left, right).collect()}
    assert got == {i: (want[i, 0], round(d[i, want[i, 0]], 6)) for i in range(len(a))}
    three = {(x.ord, x["rank"]): x.r_ord for x in entities.nearest(left, right, k=3).collect()}
    assert three == {(i, k + 1): want[i, k] for i in range(len(a)) for k in range(3)}


def test_nearest_without_points(spark):
    a, one = points(spark, [("a", 1, 2, 3), ("b", 1, 2, 3)]), points(spark, [("z", 1, 2, 3)])
    assert entities.nearest(a, one.limit(0)).count() == entities.nearest(a.limit(0), one).count() == 0
    assert {(x.id, x.r_id, x.dist) for x in entities.nearest(a, one, k=2).collect()} == {("a", "z", 0.0), ("b", "z", 0.0)}
    no_x = a.withColumn("x", F.when(F.col("id") == "a", F.col("x")))
    assert {(x.id, x.r_id, x.dist) for x in entities.nearest(no_x, one).collect()} == {("a", "z", 0.0), ("b", "z", None)}


def seq(spark, values):
    return Seq(spark.createDataFrame(list(enumerate(values)), "ord long, v long"))


def test_sequences(spark):
    s = seq(spark, [5, 3, 8, 3, 1])
    values = lambda x: [r.v for r in x.to_rows()]
    assert values(s.where("v > 2")) == [5, 3, 8, 3]
    assert values(s.distinct("v")) == [5, 3, 8, 1]
    assert values(s.take(2)) == [5, 3] and values(s.take(-1)) == [] and values(s.skip(3)) == [3, 1]
    assert s.sum("v").first()[0] == 20 and s.min("v").first().v == 1 and s.max("v").first().v == 8
    assert [[i.v for i in r["items"]] for r in s.chunk(2).to_rows()] == [[5, 3], [8, 3], [1]]
    none = seq(spark, [])
    assert none.first().count() == 0 and none.any().first()[0] is False and none.all(F.col("v") > 0).first()[0] is True and none.sum("v").first()[0] == 0
    assert sorted((r.a_v, r.b_v) for r in seq(spark, [1, 2, 3]).pairs().collect()) == [(1, 2), (1, 3), (2, 3)]
    assert sorted((r.ord, r.a.v, r.b.v) for r in seq(spark, [7, 8, 9]).zip(seq(spark, [1, 2])).collect()) == [(0, 7, 1), (1, 8, 2)]
    assert [(r.key, [i.v for i in r["items"]]) for r in seq(spark, [1, 2, 3, 4]).group_by(F.col("v") % 2).to_rows()] == [(1, [1, 3]), (0, [2, 4])]
    assert values(s.order_by_descending("v").settled().skip(1)) == [5, 3, 3, 1]
    assert values(s.concat(seq(spark, [9]))) == [5, 3, 8, 3, 1, 9]
    assert [r.item for r in s.select_many(F.sequence(F.lit(1), F.lit(2))).take(3).to_rows()] == [1, 2, 1]


def test_dense_index(spark):
    df = spark.createDataFrame([(i * i,) for i in range(500)], "ord long").repartition(5)
    assert [r.idx for r in dense_index(df, buckets=7).orderBy("ord").collect()] == list(range(500))


def test_shapes(spark):
    p = lambda *v: F.array(*[F.struct(*[F.lit(float(c)).alias(n) for n, c in zip("xyz", q, strict=True)]) for q in v])
    ring, bow = p((0, 0, 0), (4, 0, 0), (4, 3, 0), (0, 3, 0)), p((0, 0, 0), (4, 4, 0), (4, 0, 0), (0, 4, 0))
    r = spark.range(1).select(
        ring_area(ring).alias("area"), path_measure(p((0, 0, 0), (3, 4, 0), (3, 4, 12)))["distance"].alias("long"), angle_between(F.lit(350.0), F.lit(10.0)).alias("turn"),
        metadata.self_intersects(ring).alias("ok"), metadata.self_intersects(bow).alias("bow"), segments_cross(Vec.at(0, 0, 0), Vec.at(2, 2, 0), Vec.at(0, 2, 0), Vec.at(2, 0, 0)).alias("cross"),
    ).first()
    assert tuple(r) == (12.0, 17.0, 20.0, False, True, True)


def test_floor_and_walls(spark):
    floor = soup(spark, square(0, 0, 2000, 2000, 100))
    got = rays.sample_grid(spark, floor, (0, 0, 0), (2000, 2000, 500), 500, 512)
    assert got.count() == 25 and {r.z for r in got.select("z").distinct().collect()} == {100.0}
    assert rays.sample_grid(spark, floor, (0, 0, 0), (500, 500, 500), 500, 512).count() == 4


def test_room(spark):
    def wall(x0, y0, x1, y1):
        return [((x0, y0, 0), (x1, y1, 0), (x1, y1, 200)), ((x0, y0, 0), (x1, y1, 200), (x0, y0, 200))]

    room = [*square(0, 0, 1000, 1000, 0), *square(200, 200, 400, 400, 200), *wall(200, 200, 400, 200), *wall(400, 200, 400, 400), *wall(400, 400, 200, 400), *wall(200, 400, 200, 200)]
    s = soup(spark, room)
    assert [r.ord for r in rays.interior(points(spark, [("in", 300, 300, 10), ("out", 800, 800, 10)]), s, 128).collect()] == [0]
    see = rays.visible(points(spark, [("a", 100, 300, 0)]), points(spark, [("behind", 500, 300, 0), ("clear", 100, 600, 0)]), s, 128, reach=450.0)
    assert [(r.ord, r.v_ord) for r in see.collect()] == [(1, 0)]
    near = rays.nearest_wall(points(spark, [("w", 250, 300, 50), ("far", 800, 800, 50)]), s, 128, 100.0).collect()
    assert [(r.ord, round(r.distance, 6)) for r in near] == [(0, 50.0)]


def grid_mesh(spark, n=9, size=1000.0, low=-4250.0):
    def cell(i, j):
        x, y = low + i * size, low + j * size
        return [(x, y, 0.0), (x + size, y, 0.0), (x + size, y + size, 0.0), (x, y + size, 0.0)]

    return spark.createDataFrame([(i * n + j, cell(i, j)) for i in range(n) for j in range(n)], "pid long, points array<struct<x: double, y: double, z: double>>")


def test_fields_and_routes(spark):
    mesh = grid_mesh(spark)
    e = nav.edges(mesh, walk=500.0).cache()
    start = spark.createDataFrame([(0, 0)], "field long, pid long")
    kernel = {r.pid: r.cost for r in nav.kernel_fields(e, start).collect()}
    assert kernel == {i * 9 + j: (i + j) * 2.0 for i in range(9) for j in range(9)}
    small = grid_mesh(spark, 3)
    es = nav.edges(small, walk=500.0)
    assert {r.pid: r.cost for r in nav.relaxed_field(es, start).collect()} == {i * 3 + j: (i + j) * 2.0 for i in range(3) for j in range(3)}
    route = routes.routes(e, spark.createDataFrame([(1, 0, 80), (2, 5, 5)], "route long, from_pid long, to_pid long")).collect()
    assert {(r.route, r.cost, len(r.pids)) for r in route} == {(1, 32.0, 17), (2, 0.0, 1)}
    orbs = points(spark, [("far", 3000, 3000, 0), ("by", -3000, -3750, 0), ("off", 0, 0, 5000)])
    got = nav.within_time(orbs, points(spark, [("s", -3750, -3750, 0)]), mesh, e, 3.0)
    assert [r.id for r in got.collect()] == ["by"]


def test_links_and_overrides(spark):
    row = spark.createDataFrame([(i, [(10.0 * i, 0.0, 0.0), (10.0 * i + 10, 0.0, 0.0), (10.0 * i + 10, 10.0, 0.0), (10.0 * i, 10.0, 0.0)]) for i in range(5)], "pid long, points array<struct<x: double, y: double, z: double>>")
    start = spark.createDataFrame([(0, 0)], "field long, pid long")
    cost = lambda **k: {r.pid: r.cost for r in nav.kernel_fields(nav.edges(row, walk=10.0, **k), start).collect()}.get(4)
    assert cost() == 4.0
    assert cost(blocked=spark.createDataFrame([(2,)], "pid long")) is None
    links = spark.createDataFrame([(0, 4, "zipline")], "from_pid long, to_pid long, kind string")
    assert cost(links=links, speeds={"zipline": 40.0}) == 1.0 and cost(links=links, speeds={}) == 4.0
    assert cost(multipliers=spark.createDataFrame([(1, 3.0)], "pid long, multiplier double")) == 6.0
    pieces = nav.mesh_components(spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a long, b long"))
    assert {(r.pid, r.component) for r in pieces.collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)}


RECORD = "ord long, id string, kind string, status string, x double, y double, z double, ring array<struct<x: double, y: double, z: double>>, floor_z double, flag string, multiplier double"


def test_metadata_merge_and_rules(spark):
    camp = lambda i, n, s, x, y: (i, n, "creepCamp", s, x, y, 20.0, None, None, None, None)
    bow = [(0.0, 0.0, 0.0), (40.0, 40.0, 0.0), (40.0, 0.0, 0.0), (0.0, 40.0, 0.0)]
    records = spark.createDataFrame([camp(0, "c-far", "accepted", 3000.0, 3000.0), camp(1, "c-dup", "accepted", 10.0, -2490.0), camp(2, "c-no", "rejected", 1.0, 1.0), (3, "r", "region", "accepted", None, None, None, bow, 0.0, "noGo", None), camp(4, "c-far", "proposed", 9e9, 0.0)], RECORD)
    world = points(spark, CAMPS, "creepCamp")
    got = {r.id: (r.outcome, r.duplicate_of) for r in metadata.merge_outcomes(records, world, 200.0).collect()}
    assert got == {"c-far": ("added", None), "c-dup": ("duplicate", "camp-3"), "r": ("applied", None)}
    assert [r.id for r in metadata.merge(records, world, 200.0).orderBy("ord").collect()] == ["camp-1", "camp-2", "camp-3", "meta:c-far"]
    issues = {(r.record_id, r.code) for r in metadata.validate(records, (-4000, -4000, -50), (4000, 4000, 600)).collect()}
    assert issues == {("c-far", "duplicate-id"), ("c-far", "out-of-bounds"), ("r", "polygon-self-intersects"), ("r", "polygon-no-area")}
    assert tuple(metadata.status_counts(records).first()) == (1, 3, 1, 0)
    blocked, _ = metadata.nav_effects(nav.centroids(grid_mesh(spark)), spark.createDataFrame([("n", [(-250.0, -4250.0, 0.0), (750.0, -4250.0, 0.0), (750.0, 3750.0, 0.0), (-250.0, 3750.0, 0.0)], 0.0, "noGo", None)], "id string, ring array<struct<x: double, y: double, z: double>>, floor_z double, flag string, multiplier double"), 50.0)
    assert blocked.count() == 8


def test_tables(spark):
    df = spark.createDataFrame([(0, "b10", 1.5, [1.0, 2.0, 3.0]), (1, 'a"2', None, None), (2, "b9", 7.0, [0.0, 0.0, 0.0]), (3, None, 2.0, None)], "ord long, name string, n double, at array<double>")
    assert tables.column_types(df) == {"ord": "number", "name": "string", "n": "number", "at": "point"}
    assert [r.ord for r in tables.view(df, sort="name").collect()] == [1, 2, 0, 3]
    assert [r.ord for r in tables.view(df, sort="n", descending=True).collect()] == [2, 3, 0, 1]
    assert [r.ord for r in tables.view(df, {"n": ">= 2", "name": "B"}).collect()] == [2]
    p = tables.page(df, 9, 3)
    assert (p.page, p.pages, p.first, p.last, p.total, p.rows.count()) == (2, 2, 4, 4, 4, 1)
    assert [r.line for r in tables.csv_lines(df.drop("at")).orderBy("ord").collect()] == ["b10,1.5", '"a""2",', "b9,7.0", ",2.0"]
    assert tables.geojson_features(df).count() == 2
    assert tables.capped(df, 3)[1] == "truncated from 4" and tables.capped(df, 4)[1] is None


def test_readers(spark, tmp_path):
    text = '====0====\nclassname npc\nuniqueid 7\norigin [1 2 3]\nnote "two\nlines"\n====1====\nclassname npc\nuniqueid 7\n====2====\nother x\n'
    (tmp_path / "a.txt").write_text(text)
    blocks = readers.read_entity_text(spark, str(tmp_path / "a.txt"))
    got = [(r.id, r.x, r.properties.get("note")) for r in readers.typed_entities(blocks).orderBy("ord").collect()]
    assert got == [("7", 1.0, "two\nlines"), ("7#2", None, None)]
    (tmp_path / "e.json").write_text('{"schemaVersion": "1.2", "entities": [{"id": "b", "class": "c", "position": [1, 2, 3], "properties": {"k": 1}}, {"id": "a", "class": "d", "position": [4, 5, 6], "properties": {}}]}')
    assert [(r.ord, r.id, r.z) for r in readers.read_entities(spark, str(tmp_path / "e.json")).collect()] == [(0, "b", 3.0), (1, "a", 6.0)]
    with pytest.raises(Exception, match="this reads 2"):
        readers.read_entities(spark, str(tmp_path / "e.json"), 2).collect()
    import struct

    data = struct.pack("<II9f", 3, 1, *range(9)) + bytes([3]) + struct.pack("<3I", 0, 1, 2)
    (tmp_path / "n.nav").write_bytes(data)
    assert [p.x for p in readers.read_nav(spark, str(tmp_path / "n.nav")).first().points] == [0.0, 3.0, 6.0]
    with pytest.raises(ValueError, match="past the end"):
        readers.parse_nav(data[:-1])


def test_centroids_on_an_edge_of_a_region(spark):
    c = spark.createDataFrame([(0, 0.0, 5.0, 0.0), (1, 5.0, 0.0, 0.0), (2, 5.0, 5.0, 0.0), (3, 10.0, 5.0, 0.0)], "pid long, x double, y double, z double")
    r = spark.createDataFrame([("r", [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], 0.0)], "id string, ring array<struct<x:double,y:double>>, floor_z double")
    assert sorted(x.pid for x in metadata.polygons_in_regions(c, r, 1.0).collect()) == [0, 1, 2]
    assert [x.pid for x in metadata.polygons_in_regions(c, r, 1.0, edges=False).collect()] == [2]


@pytest.mark.parametrize("few", [0, 100])
def test_check_decides_on_a_side(spark, monkeypatch, few):
    monkeypatch.setattr(rays, "FEW_TRIANGLES", few)
    floor = soup(spark, [((0.1, 0.2, 5), (1500.1, 0.2, 5), (0.1, 1500.2, 5))])
    p = points(spark, [("side", 900.1, 600.2, 0), ("in", 500, 500, 0), ("out", 900.1, 600.3, 0)])
    side = F.col("ox") - F.col("ax") + (F.col("oy") - F.col("ay"))
    got = lambda check: sorted(r.ray for r in rays.hits(rays.vertical(p, True, 10.0), floor, 1000.0, True, check).collect())
    assert got(side <= 1500.0001) == [0, 1]
    assert got(side < 1499.9999) == [1]


def test_edges_equally_near_but_for_rounding(spark):
    # a flat polygon whose closing edge lies on its second one: the last is taken, though its distance is a rounding larger
    from cairnfield.functions import shapes

    row = spark.createDataFrame([([(0.0, 3.0, 0.0), (10.0, 3.0, 0.0), (20.0, 3.0, 0.0)],), ([(0.0, 7.0, 0.0), (10.0, 26.0, 0.0), (20.0, 45.0, 0.0)],)], "points array<struct<x:double,y:double,z:double>>")
    got = lambda x, y: [r[0] for r in row.select(shapes.nearest_edge(F.col("points"), F.lit("polygon"), F.lit(x), F.lit(y))["after"]).collect()]
    assert got(15.37, 3.0)[0] == 2
    assert got(20.37, 41.0)[1] == 2


def test_bounded_nearest_begins_with_small_cells(spark, monkeypatch):
    near_, sizes = entities.near, []
    monkeypatch.setattr(entities, "near", lambda l, r, size, by=(): sizes.append(size) or near_(l, r, size, by))
    left = points(spark, [("p", float(i * 7 % 50), float(i * 11 % 50), 0.0) for i in range(40)] + [("far", 500.0, 0.0, 0.0)])
    right = points(spark, [("q", float(i * 13 % 50), float(i * 17 % 50), float(i % 3)) for i in range(300)])
    got = {(x.ord, x["rank"], x.r_ord) for x in entities.nearest(left, right, k=2, radius=40.0).collect()}
    assert sizes[0] < 20.0 and sizes[-1] <= 40.0
    assert got == {(x.ord, x["rank"], x.r_ord) for x in entities._top(near_(left, right, 40.0), left, 2, "ord").collect()}
    assert {x.ord for x in entities.EntityList(left).within(40.0, right).df.collect()} == set(range(40))
