"""Picking on a screen."""

import random

from cairnfield.functions import shapes


def test_picking_in_shares_equals_one_share(spark, monkeypatch):
    r = random.Random(5)
    box = lambda x, y, s: [(x, y, 0.0), (x + s, y, 0.0), (x + s, y + s, 0.0), (x, y + s, 0.0)]
    rows = [(i, 1000 + i, r.choice(["polygon", "polyline", "point"]), box(r.uniform(0, 90), r.uniform(0, 90), 12.0), r.choice([None, 30.0])) for i in range(150)]
    f = spark.createDataFrame(rows, "ord long, id long, kind string, points array<struct<x: double, y: double, z: double>>, size double")
    clicks = spark.createDataFrame([(i, r.uniform(-15, 120), r.uniform(-15, 120)) for i in range(60)], "click long, px double, py double")
    got = {}
    for few in (1.0, 1e9):
        monkeypatch.setattr(shapes, "FEW", few)
        got[few] = {x.click: x.id for x in shapes.picked(clicks, f).collect()}
    assert got[1.0] == got[1e9] and 30 < len(got[1.0]) <= 60
    assert len(shapes._shares_by_ord(f.selectExpr("ord", "0d AS __lox", "1d AS __hix", "0d AS __loy", "1d AS __hiy"))) == 1
