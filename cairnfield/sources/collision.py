"""Collision meshes in binary glTF: triangles in world units, node trees composed by joins."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.functions.geometry import Vec, transform_point
from cairnfield.plans.storage import materialize, release

#: Fixed values of the format: magic, chunk kinds, component kinds, and the mode of triangle lists.
MAGIC, JSON_CHUNK, BINARY_CHUNK, TRIANGLES = 0x46546C67, 0x4E4F534A, 0x004E4942, 4
_KINDS = {5120: "<i1", 5121: "<u1", 5122: "<i2", 5123: "<u2", 5125: "<u4", 5126: "<f4"}


def _chunks(data: bytes) -> tuple[dict, bytes]:
    if len(data) < 12 or struct.unpack_from("<I", data)[0] != MAGIC:
        raise ValueError("not a binary glTF file")
    at, doc, body = 12, None, b""
    while at + 8 <= len(data):
        size, kind = struct.unpack_from("<II", data, at)
        part = data[at + 8 : at + 8 + size]
        if len(part) < size:
            raise ValueError("a chunk runs past the end")
        if kind == JSON_CHUNK:
            doc = json.loads(part)
        elif kind == BINARY_CHUNK:
            body = part
        at += 8 + size
    if doc is None:
        raise ValueError("the file has no JSON chunk")
    return doc, body


def _accessor(doc: dict, body: bytes, k: int, width: int) -> np.ndarray:
    a = doc["accessors"][k]
    if "bufferView" not in a:
        return np.zeros((a["count"], width))
    v, kind = doc["bufferViews"][a["bufferView"]], np.dtype(_KINDS[a["componentType"]])
    start = v.get("byteOffset", 0) + a.get("byteOffset", 0)
    stride = v.get("byteStride", kind.itemsize * width)
    if a["count"] and start + stride * (a["count"] - 1) + kind.itemsize * width > len(body):
        raise ValueError("an accessor runs past the end")
    return np.ndarray((a["count"], width), kind, body, start, (stride, kind.itemsize))


def _local(node: dict) -> list[float]:
    """A node's own matrix, by columns."""
    if "matrix" in node:
        return [float(x) for x in node["matrix"]]
    x, y, z, w = node.get("rotation", (0, 0, 0, 1))
    turn = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
    m = np.eye(4)
    m[:3, :3] = turn * np.array(node.get("scale", (1, 1, 1)), float)
    m[:3, 3] = node.get("translation", (0, 0, 0))
    return m.T.reshape(-1).tolist()


def nodes_of(data: bytes) -> list[dict]:
    """node, parent, mesh, layers and own matrix of each node."""
    doc, _ = _chunks(data)
    parent = {c: i for i, n in enumerate(doc.get("nodes", [])) for c in n.get("children", [])}
    out = []
    for i, n in enumerate(doc.get("nodes", [])):
        layers = n.get("extras", {}).get("InteractAs") if isinstance(n.get("extras"), dict) else None
        out.append({"node": i, "parent": parent.get(i), "mesh": n.get("mesh"), "layers": [x for x in layers if isinstance(x, str)] if isinstance(layers, list) else [], "matrix": _local(n)})
    return out


def triangles_of(data: bytes) -> Iterator[tuple[int, int, np.ndarray]]:
    """(mesh, primitive, corners [n, 9]) of each triangle list; without indices, points follow one another."""
    doc, body = _chunks(data)
    for m, mesh in enumerate(doc.get("meshes", [])):
        for p, prim in enumerate(mesh["primitives"]):
            if prim.get("mode", TRIANGLES) != TRIANGLES or "POSITION" not in prim["attributes"]:
                continue
            points = _accessor(doc, body, prim["attributes"]["POSITION"], 3).astype(float)
            index = _accessor(doc, body, prim["indices"], 1)[:, 0].astype(np.int64) if "indices" in prim else np.arange(len(points))
            index = index[: len(index) // 3 * 3]
            if len(index) and index.max() >= len(points):
                raise ValueError("a triangle names a point that isn't there")
            yield m, p, points[index].reshape(-1, 9)



def _times(a: Column, b: Column) -> Column:
    """The product of two matrices by columns."""
    return F.array(*[a[r] * b[4 * c] + a[4 + r] * b[4 * c + 1] + a[8 + r] * b[4 * c + 2] + a[12 + r] * b[4 * c + 3] for c in range(4) for r in range(4)])


def world_matrices(nodes: DataFrame, to_world: list[float]) -> DataFrame:
    """(file, node, world): matrices composed down the tree, all files a level at a time. Nodes that hang on a ring have none."""
    root = F.array(*[F.lit(float(x)) for x in to_world])
    level = materialize(nodes.where("parent IS NULL").select("file", "node", _times(root, F.col("matrix")).alias("world")), "level")
    levels = [level]
    while True:
        up = levels[-1].withColumnsRenamed({"node": "parent", "world": "up"})
        level = materialize(nodes.join(up, ["file", "parent"]).select("file", "node", _times(F.col("up"), F.col("matrix")).alias("world")), "level")
        if level.isEmpty():
            release(level)
            break
        levels.append(level)
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def read_collision(spark: SparkSession, path: str, to_world: list[float], excluded: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The triangles (file, tid: struct of node, primitive, k, and ax .. cz) of the binary glTF files under ``path``, and the nodes left out
    (file, node) because one of their layers is ``excluded``.

    Points go through the node's world matrix and ``to_world`` (by columns). Where these mirror, two corners are swapped, so that front faces
    stay in front. A mesh that several nodes use comes once a node. Other than triangle lists nothing is read; a broken file is an error."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    struct_ = pa.struct([("node", pa.int32()), ("parent", pa.int32()), ("mesh", pa.int32()), ("layers", pa.list_(pa.string())), ("matrix", pa.list_(pa.float64()))])

    def nodes(batches):
        for b in batches:
            found = [nodes_of(c) for c in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(struct_))], ["file", "n"])

    def soup(batches):
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for m, p, corners in triangles_of(content):
                    for at in range(0, len(corners), 50_000):
                        part = corners[at : at + 50_000]
                        n = len(part)
                        ids = [pa.array([file] * n), pa.array(np.full(n, m, np.int32)), pa.array(np.full(n, p, np.int32)), pa.array(np.arange(at, at + n, dtype=np.int32))]
                        yield pa.RecordBatch.from_arrays([*ids, *[pa.array(np.ascontiguousarray(part[:, i])) for i in range(9)]], ["file", "mesh", "primitive", "k", *_CORNERS])

    tree = files.mapInArrow(nodes, "file string, n array<struct<node:int,parent:int,mesh:int,layers:array<string>,matrix:array<double>>>").select("file", F.inline("n"))
    tree = materialize(tree, "nodes")
    skip = F.arrays_overlap("layers", F.array(*map(F.lit, excluded)).cast("array<string>")) & F.col("mesh").isNotNull()
    placed = tree.where(F.col("mesh").isNotNull() & ~skip).join(world_matrices(tree, to_world), ["file", "node"]).select("file", "node", "mesh", "world")
    raw = files.mapInArrow(soup, "file string, mesh int, primitive int, k int, " + ", ".join(f"{c} double" for c in _CORNERS)).join(placed, ["file", "mesh"])
    w = F.col("world")
    det = w[0] * (w[5] * w[10] - w[6] * w[9]) - w[4] * (w[1] * w[10] - w[2] * w[9]) + w[8] * (w[1] * w[6] - w[2] * w[5])
    moved = {n: transform_point([w[i] for i in range(16)], Vec.of(n)) for n in "abc"}
    raw = raw.select("file", F.struct("node", "primitive", "k").alias("tid"), (det < 0).alias("mirrored"), *[getattr(v, c).alias(f"{n}{c}") for n, v in moved.items() for c in "xyz"])
    turned = [F.when(F.col("mirrored"), F.col(other + c)).otherwise(F.col(own + c)).alias(own + c) for own, other in (("b", "c"), ("c", "b")) for c in "xyz"]
    return raw.select("file", "tid", "ax", "ay", "az", *turned), tree.where(skip).select("file", "node")


_CORNERS = [f"{n}{c}" for n in "abc" for c in "xyz"]
