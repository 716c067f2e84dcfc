"""Readers of map bundles: entity JSON, entity text, navigation faces and metadata folders."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnfield.operators.sequence import ORD

ENTITY_FILE = """schemaVersion string, entities array<struct<id: string, class: string, kind: string,
position: array<double>, rotation: array<double>, team: int, lane: int, properties: map<string, string>>>"""

#: Entity text: a line of '=' around a block number, key/value lines, values in quotes over lines.
_BLOCK = re.compile(r"^={2,}\d+={2,}$")
_PAIR = re.compile(r"^(\S+)\s+(.*)$", re.S)


def read_entities(spark: SparkSession, path: str, major: int = 1) -> DataFrame:
    """A bundle's entities, with ``ord`` their place in the list; another major version is an error."""
    docs = spark.read.schema(ENTITY_FILE).json(path, multiLine=True)
    got = F.split("schemaVersion", r"\.")[0].cast("int")
    told = F.concat(F.lit("entity file version "), F.coalesce("schemaVersion", F.lit("none")), F.lit(f"; this reads {major}"))
    fits = F.when(got == major, F.col("entities")).otherwise(F.raise_error(told))
    return docs.select(F.posexplode(fits).alias("pos", "e")).select(
        F.col("pos").cast("long").alias(ORD), "e.id", "e.class", "e.kind", *[F.col("e.position")[i].alias(c) for i, c in enumerate("xyz")], "e.rotation", "e.team", "e.lane", "e.properties"
    )


def parse_blocks(text: str) -> Iterator[dict[str, str]]:
    """Blocks of an entity text as key/value maps; a quoted value may run over lines."""
    block: dict[str, str] | None = None
    key, held = None, ""
    for line in text.splitlines():
        if key is not None:
            held += "\n" + line
            if line.rstrip().endswith('"'):
                block[key], key = held.strip().strip('"'), None
        elif _BLOCK.match(line.strip()):
            if block:
                yield block
            block = {}
        elif block is not None and (m := _PAIR.match(line.strip())):
            name, value = m[1], m[2].strip()
            if value.startswith('"') and (len(value) == 1 or not value.endswith('"')):
                key, held = name, value
            else:
                block[name] = value.strip('"')
    if key is not None:
        block[key] = held.strip().strip('"')
    if block:
        yield block


def read_entity_text(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, properties) of every block of the entity texts under ``path``, a file a row."""
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")

    def run(batches):
        for b in batches:
            for file, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = list(parse_blocks(text))
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(got), pa.string()), pa.array(range(len(got)), pa.int64()), pa.array([list(x.items()) for x in got], pa.map_(pa.string(), pa.string()))], ["file", "block", "properties"])

    return texts.mapInArrow(run, "file string, block long, properties map<string, string>")


def typed_entities(blocks: DataFrame) -> DataFrame:
    """Entities of parsed blocks: a class is needed; the id is the unique id, else the block's number;
    further rows with an id get #2, #3 ..."""
    p = F.col("properties")
    base = F.coalesce(p["uniqueid"], F.col("block").cast("string"))
    numbers = F.split(F.regexp_replace(F.coalesce(p["origin"], F.lit("")), r"[\[\],]", " "), r"\s+")
    numbers = F.filter(numbers, lambda s: s != "")
    rows = blocks.where(p["classname"].isNotNull()).select("file", F.col("block").alias(ORD), base.alias("base"), p["classname"].alias("class"), *[F.try_element_at(numbers, F.lit(i + 1)).try_cast("double").alias(c) for i, c in enumerate("xyz")], "properties")
    n = F.row_number().over(Window.partitionBy("file", "base").orderBy(ORD))
    return rows.withColumn("id", F.when(n == 1, F.col("base")).otherwise(F.concat("base", F.lit("#"), n.cast("string")))).drop("base")


#: Values of an entity text.
_INDEX = re.compile(r"^=+\s*(\d+)\s*=+$")
_NUMBER = re.compile(r"^-?\d+(\.\d+)?(e[+-]?\d+)?$", re.I)
_RESOURCE = re.compile(r'^resource_name:"(.*)"$')
_APART = re.compile(r"[\s,\[\]]+")


def _number(text: str) -> float | int:
    return int(text) if re.fullmatch(r"-?\d+", text) else float(text)


def typed_value(raw: str):
    """One value: a quoted text, a list in brackets (of numbers if all are), a resource's name, true or false, a number, else the bare word."""
    v = raw.strip()
    if len(v) >= 2 and v[0] == v[-1] == '"':
        return v[1:-1]
    if v.startswith("[") and v.endswith("]"):
        parts = [p for p in (x.strip() for x in v[1:-1].split(",")) if p]
        return [_number(p) for p in parts] if all(map(_NUMBER.match, parts)) else parts
    if m := _RESOURCE.match(v):
        return m[1]
    return {"true": True, "false": False}[v] if v in ("true", "false") else _number(v) if _NUMBER.match(v) else v


def parse_entities(text: str) -> Iterator[tuple[int, dict, list[str]]]:
    """(number, values, output lines) of each block of an entity text.

    A quoted value that its line doesn't close goes on to the line that ends with the quote (three quotes, if it began with three), or to
    the block's end; its lines are joined by a space, and if they hold numbers only it is a list of these. Lines that begin with @ are
    outputs; lines before the first block and without a value are left out; of a repeated key the last value stays."""
    block: tuple[int, dict, list[str]] | None = None
    key, quote, lines = None, "", []

    def close() -> None:
        parts = [p for p in _APART.split(" ".join(lines)) if p]
        block[1][key] = [_number(p) for p in parts] if all(map(_NUMBER.match, parts)) else " ".join(lines)

    for line in map(str.strip, text.split("\n")):
        mark = _INDEX.match(line)
        if key is not None and not mark:
            ends = line.endswith(quote)
            lines.append(line[: -len(quote)] if ends else line)
            if ends:
                close()
                key = None
        elif mark:
            if key is not None:
                close()
                key = None
            if block:
                yield block
            block = (int(mark[1]), {}, [])
        elif block and line.startswith("@"):
            block[2].append(line)
        elif block and (m := _PAIR.match(line)):
            value = m[2].strip()
            if value.startswith('"') and (value == '"""' or len(value) < 2 or not value.endswith('"')):
                quote = '"""' if value.startswith('"""') else '"'
                key, lines = m[1], [value[len(quote) :]]
            else:
                block[1][m[1]] = typed_value(value)
    if key is not None:
        close()
    if block:
        yield block


def read_typed_entities(spark: SparkSession, path: str) -> DataFrame:
    """Entities of the entity texts under ``path``: file, ord (the block's place), id, class, x, y, z, rotation, team, lane, properties.

    A block needs a classname. Its id is the unique id, else e and its number; from the second of an id on, #number is added. A missing
    position is the origin. ``properties`` is a variant of all other values by name, the output lines among them."""
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")

    def run(batches):
        for b in batches:
            for file, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = list(parse_entities(text))
                rows = [json.dumps(v | ({"outputs": o} if o else {})) for _, v, o in got]
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(got), pa.string()), pa.array(range(len(got)), pa.int64()), pa.array([n for n, _, _ in got], pa.int64()), pa.array(rows, pa.string())], ["file", "ord", "number", "values"])

    v = F.col("v")
    get = lambda name, kind: F.try_variant_get(v, f"$.{name}", kind)
    is_text = lambda name: F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")).rlike("^(STRING|BIGINT|DECIMAL|DOUBLE)")
    rows = texts.mapInArrow(run, f"file string, {ORD} long, number long, values string").withColumn("v", F.parse_json("values"))
    rows = rows.where(F.schema_of_variant(F.try_variant_get(v, "$.classname", "variant")) == "STRING")
    base = F.when(is_text("hammeruniqueid"), get("hammeruniqueid", "string"))
    rows = rows.withColumn("base", F.coalesce(base, F.concat(F.lit("e"), F.col("number").cast("string"))))
    nth = F.row_number().over(Window.partitionBy("file", "base").orderBy(ORD))
    ident = F.when(nth == 1, F.col("base")).otherwise(F.concat("base", F.lit("#"), F.col("number").cast("string")))
    three = lambda name: F.when((F.size(get(name, "array<double>")) >= 3) & ~F.exists(F.slice(get(name, "array<double>"), 1, 3), lambda x: x.isNull()), F.slice(get(name, "array<double>"), 1, 3))
    number = lambda name: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")).rlike("^(BIGINT|DECIMAL|DOUBLE)"), get(name, "double"))
    taken = ("classname", "origin", "angles", "teamnumber", "lanenum")
    rest = F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: ~k.isin(*taken))
    at = F.coalesce(three("origin"), F.array(*[F.lit(0.0)] * 3))
    return rows.select(
        "file", ORD, ident.alias("id"), get("classname", "string").alias("class"), *[at[i].alias(c) for i, c in enumerate("xyz")],
        three("angles").alias("rotation"), number("teamnumber").cast("int").alias("team"), number("lanenum").cast("int").alias("lane"), F.to_variant_object(rest).alias("properties"),
    )


def parse_nav(data: bytes) -> tuple[list[tuple[float, float, float]], list[list[int]]]:
    """Vertices and faces of a packed navigation table: counts, float triples, then faces of 3..16 indices."""
    if len(data) < 8:
        raise ValueError("the navigation table is cut short")
    n_vertices, n_faces = struct.unpack_from("<II", data)
    at = 8 + 12 * n_vertices
    if at > len(data):
        raise ValueError("the vertices run past the end")
    flat = struct.unpack_from(f"<{3 * n_vertices}f", data, 8)
    faces = []
    for _ in range(n_faces):
        if at >= len(data) or not 3 <= (size := data[at]) <= 16 or at + 1 + 4 * size > len(data):
            raise ValueError("a face runs past the end or has a wrong size")
        own = list(struct.unpack_from(f"<{size}I", data, at + 1))
        if max(own) >= n_vertices:
            raise ValueError("a face names a vertex that isn't there")
        faces.append(own)
        at += 1 + 4 * size
    return [flat[i : i + 3] for i in range(0, len(flat), 3)], faces


def read_nav(spark: SparkSession, path: str) -> DataFrame:
    """(file, pid, points) of every face of the packed navigation tables under ``path``."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64())]))
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                vertices, faces = parse_nav(content)
                for k in range(0, len(faces), 10_000):
                    part = faces[k : k + 10_000]
                    points = [[dict(zip("xyz", vertices[v], strict=True)) for v in f] for f in part]
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(part)), pa.array(range(k, k + len(part)), pa.int64()), pa.array(points, kind)], ["file", "pid", "points"])

    return files.mapInArrow(run, "file string, pid long, points array<struct<x: double, y: double, z: double>>")


def read_metadata(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a folder with one JSON file a kind, with the file's name."""
    return spark.read.schema(f"records array<struct<{schema}>>").json(path, multiLine=True).select(F.input_file_name().alias("file"), F.posexplode("records").alias("pos", "r")).select("file", F.col("pos").cast("long").alias(ORD), "r.*")
