"""Sample grids with channels, walkable levels, camera plans and frames."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnfield.functions.geometry import Vec, cell, distance, half_up
from cairnfield.operators.rays import first_hits, hits, vertical
from cairnfield.operators.sequence import ORD

FLOOR = "floorHeight"
#: Most shots of a plan, and fewest points that a frame is made of (fixed values).
MAX_SHOTS = 5000
MIN_FRAME_POINTS = 20


def cells(spark: SparkSession, low: tuple[float, float], high: tuple[float, float], size: float) -> DataFrame:
    """(ix, iy, x, y) of every cell of a grid from ``low``, with its centre; made on the executors."""
    if not size > 0:
        raise ValueError("a cell size must be over 0")
    nx, ny = (max(1, math.ceil((h - l) / size)) for l, h in zip(low, high, strict=True))
    i = spark.range(nx * ny).select(F.pmod("id", F.lit(nx)).alias("ix"), F.floor(F.col("id") / nx).alias("iy"))
    return i.select("ix", "iy", (low[0] + (F.col("ix") + 0.5) * size).alias("x"), (low[1] + (F.col("iy") + 0.5) * size).alias("y"))


def build_grid(spark: SparkSession, triangles: DataFrame, low: tuple[float, float, float], high: tuple[float, float, float], size: float, channels: dict[str, Column] | None = None, mesh_cell: float = 512.0) -> DataFrame:
    """(ix, iy, x, y, floorHeight, channels by name): the height of the first surface below the bounds' top.

    A cell without a floor has null. A channel is a column expression of ix, iy, x, y and floorHeight."""
    if FLOOR in (channels or {}):
        raise ValueError(f"{FLOOR} is built in")
    at = cells(spark, low[:2], high[:2], size).withColumns({ORD: F.struct("ix", "iy"), "z": F.lit(high[2] + 1.0)})
    got = first_hits(vertical(at, False, high[2] - low[2] + 2.0), triangles, mesh_cell, True).select(F.col("ray").alias(ORD), "dist")
    grid = at.join(got, ORD, "left").select("ix", "iy", "x", "y", (F.col("z") - F.col("dist")).alias(FLOOR))
    return grid.select("*", *[c.alias(n) for n, c in sorted((channels or {}).items())])


def channel_names(grid: DataFrame) -> list[str]:
    return [c for c in grid.columns if c not in ("ix", "iy", "x", "y")]


def raw(grid: DataFrame, channel: str) -> DataFrame:
    """(ix, iy, value) of a channel."""
    if channel not in channel_names(grid):
        raise ValueError(f"unknown channel {channel}")
    return grid.select("ix", "iy", F.col(channel).alias("value"))


def get(grid: DataFrame, channel: str, points: DataFrame, low: tuple[float, float], size: float) -> DataFrame:
    """(ord, value) of the cell of each point (XY only); null outside the grid."""
    at = points.select(ORD, cell(F.col("x") - low[0], size).alias("ix"), cell(F.col("y") - low[1], size).alias("iy"))
    return at.join(raw(grid, channel), ["ix", "iy"], "left").select(ORD, "value")


def coverage(grid: DataFrame, levels: str | None = None) -> DataFrame:
    """One row: total_cells, covered_cells and, with a channel of level counts, multi_level_cells."""
    more = [] if levels is None else [F.count_if(F.col(levels) > 1).alias("multi_level_cells")]
    return grid.agg(F.count("*").alias("total_cells"), F.count(FLOOR).alias("covered_cells"), *more)


def walkable_levels(points: DataFrame, triangles: DataFrame, top: float, reach: float, gap: float, size: float = 512.0) -> DataFrame:
    """(ord, levels): heights of the surfaces under ``top`` at each point, top first.

    A surface no more than ``gap`` below the last level kept is part of it."""
    got = hits(vertical(points.withColumn("z", F.lit(float(top))), False, reach), triangles, size, True)
    heights = got.select(F.col("ray").alias(ORD), (top - F.col("dist")).alias("z")).distinct()  # in the points' own tasks, before any are listed
    zs = heights.groupBy(ORD).agg(F.sort_array(F.collect_list("z"), asc=False).alias("zs"))  # no more than heights at a point
    start = F.array().cast("array<double>")
    keep = lambda s, z: F.when((F.size(s) == 0) | (F.try_element_at(s, F.lit(-1)) - z > gap), F.concat(s, F.array(z))).otherwise(s)
    return zs.select(ORD, F.aggregate("zs", start, keep).alias("levels"))


def fan_triangles(polygons: DataFrame) -> DataFrame:
    """(pid, k, a, b, c): the fan of each convex polygon (pid, points) from its first point."""
    k = F.explode(F.when(F.size("points") >= 3, F.sequence(F.lit(1), F.size("points") - 2)).otherwise(F.array().cast("array<int>"))).alias("k")
    p = lambda i: F.element_at("points", i)
    return polygons.select("pid", "points", k).select("pid", "k", p(F.lit(1)).alias("a"), p(F.col("k") + 1).alias("b"), p(F.col("k") + 2).alias("c"))


# cameras -------------------------------------------------------------------------------------


def _yaws(n: int) -> Column:
    if not 1 <= n <= 64:
        raise ValueError("yaws must be from 1 to 64")
    return F.explode(F.array(*[F.lit(math.floor(k * 360 / n * 1000 + 0.5) / 1000) for k in range(n)])).alias("yaw")


def _shots(stands: DataFrame, yaws: int, pitch: float) -> DataFrame:
    tag = F.format_string("-y%03d", F.floor(F.col("yaw") + 0.5).cast("int"))
    rounded = [half_up(F.col(c), 3).alias(c) for c in "xyz"]
    return stands.select("group", *rounded, _yaws(yaws)).select(F.concat("group", tag).alias("id"), "group", "x", "y", "z", F.lit(float(pitch)).alias("pitch"), "yaw")


def ring_plan(points: DataFrame, yaws: int = 8, pitch: float = 0.0) -> DataFrame:
    """Shots that turn on the spot at each point (ord from 0): id, group, x, y, z, pitch, yaw."""
    if points.limit(MAX_SHOTS + 1).count() * yaws > MAX_SHOTS:
        raise ValueError(f"a plan has at most {MAX_SHOTS} shots")
    return _shots(points.withColumn("group", F.format_string("ring-%03d", F.col(ORD).cast("int") + 1)), yaws, pitch)


def grid_plan(spark: SparkSession, bounds: tuple[float, float, float, float], spacing: float, z: float, yaws: int = 4, pitch: float = 0.0, floor: DataFrame | None = None, height: float = 0.0) -> DataFrame:
    """Shots from the points of a lattice centred in the bounds, row by row.

    With ``floor`` (ix, iy, z: column, row and height) cameras stand ``height`` above it; points without one are dropped."""
    x0, y0, x1, y1 = bounds
    if not (spacing > 0 and x1 > x0 and y1 > y0):
        raise ValueError("spacing and both sides of the bounds must be over 0")
    cols, rows = math.floor((x1 - x0) / spacing), math.floor((y1 - y0) / spacing)
    if cols < 1 or rows < 1:
        raise ValueError("the spacing leaves no whole cell")
    if cols * rows * yaws > MAX_SHOTS:
        raise ValueError(f"a plan has at most {MAX_SHOTS} shots")
    left, low = x0 + (x1 - x0 - (cols - 1) * spacing) / 2, y0 + (y1 - y0 - (rows - 1) * spacing) / 2
    at = spark.range(cols * rows).select(F.pmod("id", F.lit(cols)).alias("ix"), F.floor(F.col("id") / cols).alias("iy"))
    at = at.select("ix", "iy", F.format_string("grid-r%03dc%03d", F.col("iy").cast("int"), F.col("ix").cast("int")).alias("group"), (left + F.col("ix") * spacing).alias("x"), (low + F.col("iy") * spacing).alias("y"))
    at = at.withColumn("z", F.lit(float(z))) if floor is None else at.join(floor.select("ix", "iy", (F.col("z") + height).alias("z")), ["ix", "iy"])
    return _shots(at, yaws, pitch)


def shots_near(shots: DataFrame, point: tuple[float, float, float], radius: float) -> DataFrame:
    """Shots (id, x, y, z) within ``radius`` of a point, with ``dist``, nearest first, ties by id."""
    return shots.withColumn("dist", distance(Vec.of(), Vec.at(*point))).where(F.col("dist") <= radius).orderBy("dist", "id")


def frame(points: DataFrame) -> DataFrame:
    """One row: low and high of x, y, z at the nearest ranks of 2 % and 98 %, points at the origin left out.

    No row under MIN_FRAME_POINTS points. Exact: each axis is ranked over range partitions of its values."""
    p = points.where("x <> 0 or y <> 0 or z <> 0")
    n = p.count()
    if n < MIN_FRAME_POINTS:
        return points.sparkSession.createDataFrame([], ", ".join(f"{s}_{c} double" for c in "xyz" for s in ("low", "high")))
    ranks = (math.floor(n * 0.02), min(n - 1, math.floor(n * 0.98)))
    out = None
    for c in "xyz":
        value = _at_ranks(p, c, ranks)
        row = value.agg(F.min("v").alias(f"low_{c}"), F.max("v").alias(f"high_{c}"))
        out = row if out is None else out.crossJoin(row)  # one row each
    return out


def _at_ranks(p: DataFrame, c: str, ranks: tuple[int, ...]) -> DataFrame:
    """The values at ranks of a column: counts of equal values are summed up by ranges, so that no task sorts all."""
    counts = p.groupBy(F.col(c).alias("v")).agg(F.count("*").alias("n"))
    low, high = p.agg(F.min(c), F.max(c)).first()
    width = (high - low) / 64 or 1.0
    counts = counts.withColumn("b", F.floor((F.col("v") - low) / width))
    before = counts.groupBy("b").agg(F.sum("n").alias("size")).select("b", (F.sum("size").over(Window.orderBy("b")) - F.col("size")).alias("before"))  # 65 rows at most
    up = F.col("before") + F.sum("n").over(Window.partitionBy("b").orderBy("v"))
    return counts.join(F.broadcast(before), "b").withColumn("up", up).where(" or ".join(f"(up > {r} and up - n <= {r})" for r in ranks)).select("v")
