"""Annotation, tag, screenshot and submission documents on small tables with nulls, repeats and nothing."""

from cairnfield.operators import documents

POINT = "array<struct<x: double, y: double, z: double>>"


def test_targets(spark):
    a = spark.createDataFrame([(0, "p", "point", "l", [(1.0, 2.0, 3.0)]), (1, "m", "measure", "l", [(0.0, 0.0, 0.0)]), (2, "q", "label", None, []), (3, "n", None, "l", None)], f"ord long, id string, kind string, layer string, points {POINT}")
    targets, skipped = documents.targets_of_annotations(a)
    assert [tuple(r) for r in targets.orderBy("ord").collect()] == [(0, "p", 1.0, 2.0, 3.0), (2, "q", None, None, None)]
    assert {(r.id, r.reason) for r in skipped.collect()} == {("m", "measure has no single point to frame"), ("n", None)}
    assert documents.targets_of_annotations(a, "none")[0].count() == 0
    r = spark.createDataFrame([(0, "a", "creepCamp", "accepted", None, 1.0, 0.0, 0.0), (1, "b", "creepCamp", "proposed", None, 1.0, 0.0, 0.0), (2, "c", "custom", "accepted", "point", 1.0, 0.0, 0.0), (3, "d", "custom", "accepted", "polygon", 1.0, 0.0, 0.0)], "ord long, id string, kind string, status string, geometry string, x double, y double, z double")
    targets, skipped = documents.targets_of_records(r)
    assert [x.id for x in targets.orderBy("ord").collect()] == ["creepCamp-a", "custom-c"] and [x.id for x in skipped.collect()] == ["custom-d"]
    assert documents.targets_of_records(r, True)[0].count() == 3


def test_tags(spark):
    e = spark.createDataFrame([("box 1", 1.0, 2.0, 3.0)], "id string, x double, y double, z double")
    t = spark.createDataFrame([("heavy-box", "box 1"), ("heavy-box", "box 1"), ("mine", "box 1"), ("heavy-box", "gone"), ("heavy-box", None)], "tag string, entity_id string")
    r = documents.tag_records(t, e)
    assert {(x.id, x.status, x.label, x.entity_id) for x in r.collect()} == {("tag.heavy-box.box_1", "proposed", "heavy-box", "box 1"), ("tag.mine.box_1", "proposed", "mine", "box 1")}
    assert [tuple(x) for x in documents.tags_of(r).collect()] == [("tag.heavy-box.box_1", "heavy-box", "box 1")]


def test_rules(spark):
    layers = spark.createDataFrame([("l",), ("l",), ("l",)], "id string")
    a = spark.createDataFrame([("a", "l"), ("a", None), ("b", "x"), (None, "l")], "id string, layer string")
    assert sorted((r.subject, r.code) for r in documents.annotation_issues(a, layers).collect()) == [("a", "duplicate-annotation"), ("b", "unknown-layer"), ("l", "duplicate-layer"), ("l", "duplicate-layer")]
    assert documents.annotation_issues(a.limit(0), layers.limit(0)).count() == 0
    pose = ["x", "y", "z", "pitch", "yaw", "roll"]
    s = spark.createDataFrame([("s", "f", *[0.0] * 5, 359.9, *[0.0] * 6), ("s", "g", *[0.0] * 6, 9.0, *[0.0] * 5), ("t", "g", *[0.0] * 6, *[None] * 6)], ", ".join(["id string", "file string", *[f"{p}{c} double" for p in ("", "got_") for c in pose]]))
    assert sorted((r.subject, r.code, r.message) for r in documents.shot_issues(s).collect()) == [("g", "shared-file", 'shots share the file "g"'), ("s", "duplicate-shot", 'duplicate shot id "s"'), ("s", "off-position", "9.0 units off")]
