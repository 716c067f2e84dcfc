"""Tiles with levels of detail: checks of a bundle's tiles and files, what a camera sees, and which levels fit a budget."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.functions.geometry import Vec, view_axes
from cairnfield.functions.text import tile_base, tile_lod

#: Distance, in diagonals of a tile, within which it shows its finest level (fixed value); each doubling is a level less.
FINEST_RANGE = 1.5


def _issue(rows: DataFrame, severity: str, code: str, subject: Column | str, message: Column) -> DataFrame:
    return rows.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), (F.col(subject) if isinstance(subject, str) else subject).alias("subject"), message.alias("message"))


def checked_tiles(tiles: DataFrame) -> DataFrame:
    """Issues (severity, code, subject, message) of tiles (ord, id, lod, lod_of, low, high: structs x, y, z).

    Ids are unique; a level's number agrees with its id's suffix; a finest tile has no base; every other one has
    a base that is there, is finest and has the same bounds; no level comes twice, and none is missing below a base's
    coarsest; all bases have the same number of levels. Repeated ids count as the last of them."""
    t = tiles.withColumns({"level": tile_lod(F.col("id"), F.col("lod")), "base": tile_base(F.col("id"), F.col("lod_of"))})
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    name = F.col("id")
    twice = t.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").withColumn("i", F.explode(F.sequence(F.lit(2), F.col("n").cast("int"))))
    suffix = F.regexp_extract("id", r"#lod(\d+)$", 1)
    at = t.groupBy("id").agg(F.max_by(F.struct("level", "low", "high"), "ord").alias("b")).select(F.col("id").alias("base"), "b")
    other = t.where("level > 0").join(at, "base", "left")
    known = other.where("b IS NOT NULL")
    finest = t.where("level = 0").select(F.col("id").alias("base")).distinct()
    held = known.groupBy("base", "level").agg(F.count("*").alias("n"))
    repeats = held.where("n > 1").withColumn("i", F.explode(F.sequence(F.lit(2), F.col("n").cast("int"))))
    levels = finest.join(held.groupBy("base").agg(F.collect_set("level").alias("levels")), "base", "full_outer").withColumn("levels", F.coalesce("levels", F.array().cast("array<int>")))
    top = F.coalesce(F.array_max("levels"), F.lit(0))
    gaps = levels.withColumn("top", top).where("top > 0").withColumn("level", F.explode(F.array_except(F.sequence(F.lit(1), F.col("top")), "levels")))
    sizes = levels.agg(F.array_sort(F.collect_set(F.size("levels"))).alias("sizes")).where("size(sizes) > 1")
    base = F.col("base")
    parts = [
        _issue(twice, "error", "tile.duplicate", "id", text("tile id ", name, " comes again")),
        _issue(t.where((suffix != "") & F.col("lod").isNotNull()).where(F.col("lod") != suffix.cast("int")), "error", "tile.suffix", "id", text("tile ", name, ": level ", F.col("lod").cast("string"), " isn't that of its id")),
        _issue(t.where("level = 0 AND lod_of IS NOT NULL"), "error", "tile.based", "id", text("tile ", name, " is finest and has a base")),
        _issue(other.where("b IS NULL"), "error", "tile.orphan", "id", text("tile ", name, ": base ", base, " isn't there")),
        _issue(known.where("b.level <> 0"), "error", "tile.base_level", "id", text("tile ", name, ": base ", base, " has level ", F.col("b.level").cast("string"))),
        _issue(known.where(~F.col("low").eqNullSafe(F.col("b.low")) | ~F.col("high").eqNullSafe(F.col("b.high"))), "error", "tile.bounds", "id", text("tile ", name, " has other bounds than ", base)),
        _issue(repeats, "error", "tile.level_repeated", "base", text("tile ", base, ": level ", F.col("level").cast("string"), " comes again")),
        _issue(gaps, "warning", "tile.level_missing", "base", text("tile ", base, ": level ", F.col("level").cast("string"), " of ", F.col("top").cast("string"), " is missing")),
        _issue(sizes, "warning", "tile.level_counts", F.lit("tiles"), text("numbers of levels: ", F.array_join(F.col("sizes").cast("array<string>"), ", "))),
    ]
    return reduce(DataFrame.unionByName, parts)


def checked_files(named: DataFrame, files: DataFrame, hashed: bool = True) -> DataFrame:
    """Issues of the files that a manifest names (what, file, bytes, sha256), given those that are there (file, content):
    missing, of another length, or, where the manifest has a digest, of another one. A length that is wrong says enough."""
    there = files.select("file", F.length("content").alias("size"), (F.sha2("content", 256) if hashed else F.lit(None).cast("string")).alias("digest"))
    met = named.join(there, "file", "left")
    gone, off = F.col("size").isNull(), F.col("bytes").isNotNull() & (F.col("size") != F.col("bytes"))
    other = F.col("sha256").isNotNull() & F.col("digest").isNotNull() & (F.col("digest") != F.lower("sha256"))
    code = F.when(gone, "file.missing").when(off, "file.size").when(other, "file.digest")
    said = F.when(gone, F.concat(F.lit("missing "), "what", F.lit(" file "), "file")).when(off, F.concat("what", F.lit(" "), "file", F.lit(": "), F.col("size").cast("string"), F.lit(" bytes, not "), F.col("bytes").cast("string"))).when(other, F.concat("what", F.lit(" "), "file", F.lit(" has another digest")))
    return met.withColumn("code", code).where("code IS NOT NULL").select(F.lit("error").alias("severity"), "code", F.col("file").alias("subject"), said.alias("message"))


def verified_files(named: DataFrame, path: str) -> DataFrame:
    """``checked_files`` on the files of a folder; names are relative to it."""
    files = named.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = F.concat(F.lit(r"^.*?"), F.lit(r"\Q"), F.lit(path.rstrip("/").split(":")[-1]), F.lit(r"\E/"))
    return checked_files(named, files.select(F.regexp_replace("path", root, F.lit("")).alias("file"), "content"))


# what a camera shows ---------------------------------------------------------------------------


def tile_cells(tiles: DataFrame) -> DataFrame:
    """(base, low, high, lods): the tiles of a place, its box and its levels (lod, id, bytes), finest first."""
    t = tiles.withColumns({"level": tile_lod(F.col("id"), F.col("lod")), "base": tile_base(F.col("id"), F.col("lod_of"))})
    edge = lambda f, c: F.struct(*[f(f"{c}.{x}").alias(x) for x in "xyz"]).alias(c)
    return t.groupBy("base").agg(edge(F.min, "low"), edge(F.max, "high"), F.array_sort(F.collect_list(F.struct(F.col("level").alias("lod"), "id", F.col("bytes").cast("double").alias("bytes")))).alias("lods"))


def wanted_level(distance: Column, diagonal: Column, levels: Column, finest_range: float = FINEST_RANGE) -> Column:
    """Which of a place's levels a camera at a distance asks for: 0 is the finest."""
    ratio = distance / F.nullif(diagonal * finest_range, F.lit(0.0))
    step = F.least(levels - 1, 1 + F.floor(F.log2(ratio)).cast("int"))
    return F.when((levels <= 1) | (diagonal <= 0) | F.coalesce(ratio <= 1, F.lit(True)), F.lit(0)).otherwise(step)


def visible_tiles(cameras: DataFrame, cells: DataFrame, far: float, half_width: float, half_height: float, near: float = 0.0, finest_range: float = FINEST_RANGE) -> DataFrame:
    """(camera, base, distance, want, lods) of the places whose box meets a camera's view (camera, x, y, z, pitch, yaw, roll).

    The view opens by ``half_width`` and ``half_height`` degrees (under 90) and ends ``far`` ahead. Cameras and boxes meet by map
    cells as wide as the way to its far corners: a box is in all cells that it covers, a camera looks into its own and those around."""
    reach = far * math.sqrt(1 + math.tan(math.radians(half_width)) ** 2 + math.tan(math.radians(half_height)) ** 2)
    place = lambda c: F.floor(c / reach)
    around = lambda c: F.explode(F.sequence(place(F.col(c)) - 1, place(F.col(c)) + 1))
    covers = lambda c: F.explode(F.sequence(place(F.col(f"low.{c}")), place(F.col(f"high.{c}"))))
    eyes = cameras.withColumn("cx", around("x")).withColumn("cy", around("y"))
    boxes = cells.withColumn("cx", covers("x")).withColumn("cy", covers("y"))
    met = eyes.join(boxes, ["cx", "cy"])
    # a box in several cells is met once, in the least of the cells that both sides have
    first = lambda c, o: F.col(f"c{o}") == F.greatest(place(F.col(c)) - 1, place(F.col(f"low.{c}")))
    met = met.where(first("x", "x") & first("y", "y"))
    eye = Vec.of()
    ahead, right, up = view_axes(F.col("pitch"), F.col("yaw"), F.col("roll"))
    turned = lambda axis, sign, degrees: ahead.scale(F.sin(F.radians(F.lit(degrees)))) + axis.scale(F.cos(F.radians(F.lit(degrees))) * sign)
    planes = [(turned(right, 1.0, half_width), 0.0), (turned(right, -1.0, half_width), 0.0), (turned(up, 1.0, half_height), 0.0), (turned(up, -1.0, half_height), 0.0), (ahead, -near), (ahead.scale(-1.0), far)]
    corner = lambda n: Vec(*[F.when(getattr(n, c) >= 0, F.col(f"high.{c}")).otherwise(F.col(f"low.{c}")) for c in "xyz"])
    seen = reduce(lambda a, b: a & b, [(corner(n) - eye).dot(n) + off >= 0 for n, off in planes])
    gap = [F.greatest(F.col(f"low.{c}") - F.col(c), F.lit(0.0), F.col(c) - F.col(f"high.{c}")) for c in "xyz"]
    size = [F.col(f"high.{c}") - F.col(f"low.{c}") for c in "xyz"]
    norm = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    out = met.where(seen).withColumns({"distance": norm(gap), "diagonal": norm(size)})
    return out.select("camera", "base", "distance", wanted_level(F.col("distance"), F.col("diagonal"), F.size("lods"), finest_range).alias("want"), "lods")


def planned_tiles(visible: DataFrame, budget: float) -> DataFrame:
    """(camera, base, level, id): what to hold within ``budget`` bytes a camera.

    Places get their coarsest level, nearest first (ties by name), left out where that doesn't fit; then each, nearest first, goes
    up level by level towards the wanted one until a step doesn't fit. Each camera's choice is a fold over its own places."""
    place = F.struct("distance", "base", "want", F.transform("lods", lambda x: x["bytes"]).alias("costs"), F.transform("lods", lambda x: x["id"]).alias("ids"))
    rows = visible.groupBy("camera").agg(F.array_sort(F.collect_list(place)).alias("places"))
    kind = visible.select(F.struct("distance", "base", "want", F.transform("lods", lambda x: x["bytes"]).alias("costs"), F.transform("lods", lambda x: x["id"]).alias("ids")).alias("p")).schema["p"].dataType.simpleString()
    none = F.struct(F.lit(0.0).alias("used"), F.array().cast(f"array<{kind}>").alias("held"))

    def hold(s: Column, p: Column) -> Column:
        used = s["used"] + F.element_at(p["costs"], -1)
        fits = used <= budget
        return F.struct(F.when(fits, used).otherwise(s["used"]).alias("used"), F.when(fits, F.concat(s["held"], F.array(p))).otherwise(s["held"]).alias("held"))

    chosen = F.struct(F.lit("").alias("base"), F.lit(0).alias("level"), F.lit("").alias("id"))
    out0 = lambda s: F.struct(s["used"].alias("used"), F.slice(F.array(chosen), 1, 0).alias("out"))

    def raise_(s: Column, p: Column) -> Column:
        last = F.size(p["costs"]) - 1

        def step(t: Column, i: Column) -> Column:
            used = t["used"] + F.get(p["costs"], i - 1) - F.get(p["costs"], i)
            go = (t["level"] == i) & (i > p["want"]) & (used <= budget)
            return F.struct(F.when(go, used).otherwise(t["used"]).alias("used"), F.when(go, i - 1).otherwise(t["level"]).alias("level"))

        down = F.filter(F.transform(p["costs"], lambda _, i: last - i), lambda i: i > 0)
        t = F.aggregate(down, F.struct(s["used"].alias("used"), last.alias("level")), step)
        # the fold is read by its fields once, so that it runs once
        one = F.transform(F.array(t), lambda t: F.struct(t["used"].alias("used"), F.concat(s["out"], F.array(F.struct(p["base"].alias("base"), t["level"].alias("level"), F.get(p["ids"], t["level"]).alias("id")))).alias("out")))
        return F.get(one, F.lit(0))

    held = rows.withColumn("s", F.aggregate("places", none, hold))
    done = held.select("camera", F.aggregate(F.col("s.held"), out0(F.col("s")), raise_).alias("r"))
    return done.select("camera", F.inline("r.out"))
