"""Nested values, tiles and files against plain versions."""

import hashlib
import json
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from cairnfield.functions import nested
from cairnfield.operators import tiles
from cairnfield.sources import collision, readers


def plain_rows(value, prefix="", depth=0):
    key = prefix or "(value)"
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    show = lambda x: "null" if x is None else str(x).lower() if isinstance(x, bool) else str(x)
    if not isinstance(value, (dict, list)):
        return [(key, show(value))]
    if isinstance(value, list) and value and all(map(number, value)):
        text = ", ".join(map(show, value[:12]))
        return [(key, f"[{text}, … {len(value)} numbers]" if len(value) > 12 else f"[{text}]")]
    if depth >= 6:
        return [(key, json.dumps(value, sort_keys=True, separators=(",", ":")))]
    children = [(f"{prefix}[{i}]", v) for i, v in enumerate(value)] if isinstance(value, list) else [(f"{prefix}.{k}" if prefix else k, v) for k, v in sorted(value.items())]
    if not children:
        return [(key, "[]" if isinstance(value, list) else "{}")]
    out = [r for k, v in children[:50] for r in plain_rows(v, k, depth + 1)]
    return out + [(f"{key} …", f"{len(children) - 50} more not shown")] if len(children) > 50 else out


def made(r, depth=0):
    kind = r.randrange(7 if depth < 8 else 4)
    if kind < 4:
        return [None, True, r.randrange(100), f"t{r.randrange(9)}"][kind]
    if kind == 4:
        return [r.randrange(9) for _ in range(r.randrange(0, 15))]
    return {f"k{i}": made(r, depth + 1) for i in range(r.randrange(4))} if kind == 5 else [made(r, depth + 1) for _ in range(r.randrange(4))]


def test_flattened_equals_plain_recursion(spark):
    r = random.Random(7)
    docs = [made(r) for _ in range(60)] + [{"a": {"b": {"c": {"d": {"e": {"f": {"g": [1, "x"]}}}}}}}, {f"n{i:03}": i for i in range(64)}, [list(range(13)), [1, None], []], "", {}, [[[[[[[1, 2]]]]]]], [{"odd key.": 1}] * 53]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(docs)], "id long, text string")
    got = {}
    for x in nested.flattened(df, "id", F.parse_json("text")).collect():
        got.setdefault(x.id, []).append((x.n, x.key, x.value))
    for i, v in enumerate(docs):
        assert [(k, t) for _, k, t in sorted(got[i])] == plain_rows(v)


def test_canonical_text_doesn_t_show_the_order_of_keys(spark):
    df = spark.createDataFrame([('{"b": {"y": 1, "x": [{"q":1,"p":2}]}, "a": "é"}',), ('{"a":"é","b":{"x":[{"p":2,"q":1}],"y":1}}',), ("{oops",), (None,)], "t string")
    text = '{"a":"é","b":{"x":[{"p":2,"q":1}],"y":1}}'
    got = df.select(nested.canonical(F.col("t")), nested.canonical_hash(F.col("t"))).collect()
    assert [tuple(x) for x in got] == [(text, hashlib.sha256(text.encode()).hexdigest())] * 2 + [(None, None)] * 2


def test_json_like_is_json_and_ends_at_depth(spark):
    deep, kind = "1", "long"
    for _ in range(15):
        deep, kind = f"array({deep})", f"array<{kind}>"
    df = spark.sql("SELECT named_struct('m', map('a', double('NaN'), 'b', 2.5D), 's', 'x\"y\\n', 'b', X'00FF', 'e', X'', 'l', array(float('inf'), null), 'f', true, 'o', struct(date'2020-01-02' AS d)) AS v")
    text = df.select(nested.json_like(F.col("v"), df.schema["v"].dataType)).first()[0]
    assert json.loads(text) == {"m": [["a", "NaN"], ["b", 2.5]], "s": 'x"y\n', "b": [0, 255], "e": [], "l": ["Infinity", None], "f": True, "o": {"d": "2020-01-02"}}
    far = spark.sql(f"SELECT {deep} AS v")
    assert far.select(nested.json_like(F.col("v"), far.schema["v"].dataType)).first()[0] == "[" * 13 + "null" + "]" * 13


TILE = "ord long, id string, lod int, lod_of string, low struct<x: double, y: double, z: double>, high struct<x: double, y: double, z: double>, bytes double"


def test_each_kind_of_wrong_tile_is_told(spark):
    box = ((0.0, 0.0, 0.0), (1.0, 1.0, 1.0))
    rows = [("a", None, None, *box), ("a#lod1", None, None, *box), ("a#lod3", None, None, *box), ("a-again", 1, "a", *box), ("b", None, None, *box), ("b", None, None, *box), ("c", None, "a", *box), ("d#lod2", None, None, *box), ("e#lod1", 2, "a#lod1", *box), ("f", None, None, *box), ("f#lod1", None, None, box[0], (2.0, 1.0, 1.0))]
    got = {(r.severity, r.code, r.subject) for r in tiles.checked_tiles(spark.createDataFrame([(i, *r, 1.0) for i, r in enumerate(rows)], TILE)).collect()}
    assert got == {
        ("error", "tile.duplicate", "b"), ("error", "tile.suffix", "e#lod1"), ("error", "tile.based", "c"), ("error", "tile.orphan", "d#lod2"), ("error", "tile.base_level", "e#lod1"), ("error", "tile.bounds", "f#lod1"),
        ("error", "tile.level_repeated", "a"), ("warning", "tile.level_missing", "a"), ("warning", "tile.level_missing", "a#lod1"), ("warning", "tile.level_counts", "tiles"),
    }


def test_planned_equals_plain_greedy(spark):
    r = random.Random(6)
    rows = []
    for camera in range(12):
        for k in range(r.randrange(1, 25)):
            n = r.randrange(1, 5)
            costs = sorted((float(r.randrange(1, 400)) for _ in range(n)), reverse=True)
            rows.append((camera, f"b{k}", float(r.randrange(6)), r.randrange(n), [(i, f"b{k}#{i}", c) for i, c in enumerate(costs)]))
    df = spark.createDataFrame(rows, "camera long, base string, distance double, want int, lods array<struct<lod: int, id: string, bytes: double>>")
    for budget in (0.0, 300.0, 1500.0, 9e9):
        want = set()
        for camera in range(12):
            used, held = 0.0, []
            for _, base, _, want_level, lods in sorted((x for x in rows if x[0] == camera), key=lambda x: (x[2], x[1])):
                if used + lods[-1][2] <= budget:
                    used += lods[-1][2]
                    held.append([base, want_level, len(lods) - 1, lods])
            for h in held:
                while h[2] > h[1] and used + h[3][h[2] - 1][2] - h[3][h[2]][2] <= budget:
                    used += h[3][h[2] - 1][2] - h[3][h[2]][2]
                    h[2] -= 1
            want |= {(camera, h[0], h[2], h[3][h[2]][1]) for h in held}
        assert {tuple(x) for x in tiles.planned_tiles(df, budget).collect()} == want


@pytest.mark.parametrize("ratio,levels,want", [(0.5, 4, 0), (1.0, 4, 0), (1.5, 4, 1), (2.0, 4, 2), (4.1, 4, 3), (99.0, 4, 3), (99.0, 1, 0)])
def test_wanted_level(spark, ratio, levels, want):
    got = spark.range(1).select(tiles.wanted_level(F.lit(ratio * 1.5 * 10), F.lit(10.0), F.lit(levels))).first()[0]
    assert got == want == (0 if levels <= 1 or ratio <= 1 else min(levels - 1, 1 + math.floor(math.log2(ratio))))


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, body in (("a.bin", b"one"), ("sub/b.bin", b"two"), ("c.bin", b"cut"), ("d.bin", b"new")):
        (tmp_path / name).write_bytes(body)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    named = spark.createDataFrame([("tile", "a.bin", 3, sha(b"one").upper()), ("tile", "sub/b.bin", 3, sha(b"two")), ("tile", "c.bin", 9, sha(b"other")), ("grid", "d.bin", 3, sha(b"old")), ("mesh", "e.bin", None, None), ("mesh", "a.bin", None, None)], "what string, file string, bytes long, sha256 string")
    got = {(r.code, r.subject) for r in tiles.verified_files(named, str(tmp_path)).collect()}
    assert got == {("file.size", "c.bin"), ("file.digest", "d.bin"), ("file.missing", "e.bin")}


TEXT = """junk before
====3====
classname  npc_boss
hammeruniqueid "17"
origin [ 1.5, -2, 3 ]
angles [0, 90, 0]
teamnumber 2
lanenum 1
model resource_name:"models/a.vmdl"
flag true
word bare
odd [ 1, x ]
empty ""
nodes \"\"\"
[ 1.0, 2.0, 3.0 ]
4
\"\"\"
note "two
lines"
@OnTrigger door,Open
@OnEnd door,Close
==== 4 ====
classname npc_boss
hammeruniqueid 17
origin [1, x, 3]
open "never
closed
====5====
hammeruniqueid 9
====6====
classname other
scale -1.5e2
"""


def test_typed_entity_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text(TEXT)
    rows = {r.id: r for r in readers.read_typed_entities(spark, str(tmp_path / "a.txt")).withColumn("properties", F.to_json("properties")).collect()}
    assert set(rows) == {"17", "17#4", "e6"}
    one = rows["17"]
    assert (one["class"], one.x, one.y, one.z, one.rotation, one.team, one.lane) == ("npc_boss", 1.5, -2.0, 3.0, [0, 90, 0], 2, 1)
    assert json.loads(one.properties) == {
        "hammeruniqueid": "17", "model": "models/a.vmdl", "flag": True, "word": "bare", "odd": ["1", "x"], "empty": "", "nodes": [1.0, 2.0, 3.0, 4], "note": "two lines",
        "outputs": ["@OnTrigger door,Open", "@OnEnd door,Close"],
    }
    two = rows["17#4"]
    assert (two.x, two.y, two.z, two.rotation, two.team) == (0.0, 0.0, 0.0, None, None) and json.loads(two.properties)["open"] == "never closed"
    assert json.loads(rows["e6"].properties) == {"scale": -150.0}
    assert list(readers.parse_entities("")) == [] and list(readers.parse_entities("==1==\nk")) == [(1, {}, [])]


def glb(doc, body):
    text = json.dumps(doc).encode()
    text += b" " * (-len(text) % 4)
    body += b"\0" * (-len(body) % 4)
    return struct.pack("<III", 0x46546C67, 2, 28 + len(text) + len(body)) + struct.pack("<II", len(text), 0x4E4F534A) + text + struct.pack("<II", len(body), 0x004E4942) + body


def test_collision_mesh_through_its_node_tree(spark, tmp_path):
    points = struct.pack("<12f", 0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0, 1)
    body = points + struct.pack("<6H", 0, 1, 2, 0, 2, 3)
    doc = {
        "nodes": [
            {"children": [1, 2], "translation": [10, 0, 0]}, {"mesh": 0, "scale": [2, 2, 2], "children": [3]}, {"mesh": 0, "extras": {"InteractAs": ["sky", 4]}},
            {"mesh": 0, "matrix": [-1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 5, 1]}, {"mesh": 1, "rotation": [0, 0, 0.5**0.5, 0.5**0.5], "extras": {"InteractAs": "sky"}},
        ],
        "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1}, {"attributes": {"POSITION": 0}, "mode": 1}]}, {"primitives": [{"attributes": {"POSITION": 0}}]}],
        "accessors": [{"bufferView": 0, "componentType": 5126, "count": 4, "type": "VEC3"}, {"bufferView": 1, "componentType": 5123, "count": 6, "type": "SCALAR"}],
        "bufferViews": [{"buffer": 0, "byteLength": 48}, {"buffer": 0, "byteOffset": 48, "byteLength": 12}],
    }
    (tmp_path / "a.glb").write_bytes(glb(doc, body))
    swap = [0, 0, 1, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 1]  # x, y, z to z, x, y ... by columns
    soup, left = collision.read_collision(spark, str(tmp_path / "a.glb"), [float(x) for x in swap], ("sky",))
    got = {tuple(r.tid): [tuple(round(r[n + c], 6) for c in "xyz") for n in "abc"] for r in soup.collect()}
    world = lambda p: (p[1], p[2], p[0])
    tri = [[(0, 0, 0), (1, 0, 0), (0, 1, 0)], [(0, 0, 0), (0, 1, 0), (0, 0, 1)]]
    want = {}
    for k, t in enumerate(tri):
        want[1, 0, k] = [world((2 * x + 10, 2 * y, 2 * z)) for x, y, z in t]
        a, b, c = [world((-2 * x + 10, 2 * y, 2 * (z + 5))) for x, y, z in t]
        want[3, 0, k] = [a, c, b]  # mirrored
    want[4, 0, 0] = [world((-y, x, z)) for x, y, z in tri[0]]
    assert got == want
    assert [r.node for r in left.collect()] == [2]
    with pytest.raises(ValueError, match="past the end"):
        list(collision.triangles_of(glb(doc, body[:20])))
    with pytest.raises(ValueError, match="not a binary"):
        collision.nodes_of(b"x" * 40)


def test_overlaps_come_once_without_a_last_distinct(spark):
    from cairnfield.operators import metadata

    box = lambda x, y: [(x, y, 0.0), (x + 30.0, y, 0.0), (x + 30.0, y + 30.0, 0.0), (x, y + 30.0, 0.0)]
    rows = [(i, f"r{i}", "noGo", 0.0, box(x, y)) for i, (x, y) in enumerate([(0.0, 0.0), (25.0, 25.0), (-20.0, 5.0), (31.0, -40.0)])]
    got = metadata.overlapping_regions(spark.createDataFrame(rows, "ord long, id string, flag string, floor_z double, ring array<struct<x:double,y:double,z:double>>"), 64.0, 8.0)
    assert sorted((r.a_id, r.b_id) for r in got.collect()) == [("r0", "r1"), ("r0", "r2")]
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
