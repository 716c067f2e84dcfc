"""Column functions for points, angles, cells and rings. All of them stay inside the JVM.

A point is three columns x, y, z or a struct of them; a ring is an array of such structs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metres in a unit for queries, and for measuring in a viewer.
METRES_PER_UNIT = 0.01905
METRES_PER_VIEW_UNIT = 0.0254


@dataclass(frozen=True)
class Vec:
    """A point or vector of columns."""

    x: Column
    y: Column
    z: Column

    @staticmethod
    def of(prefix: str = "", columns: tuple[str, str, str] = ("x", "y", "z")) -> Vec:
        return Vec(*(F.col(prefix + c) for c in columns))

    @staticmethod
    def field(c: Column | str) -> Vec:
        c = F.col(c) if isinstance(c, str) else c
        return Vec(c["x"], c["y"], c["z"])

    @staticmethod
    def at(x: float, y: float, z: float) -> Vec:
        return Vec(F.lit(float(x)), F.lit(float(y)), F.lit(float(z)))

    def __add__(self, o: Vec) -> Vec:
        return Vec(self.x + o.x, self.y + o.y, self.z + o.z)

    def __sub__(self, o: Vec) -> Vec:
        return Vec(self.x - o.x, self.y - o.y, self.z - o.z)

    def scale(self, k: Column | float) -> Vec:
        return Vec(self.x * k, self.y * k, self.z * k)

    def dot(self, o: Vec) -> Column:
        return self.x * o.x + self.y * o.y + self.z * o.z

    def cross(self, o: Vec) -> Vec:
        return Vec(self.y * o.z - self.z * o.y, self.z * o.x - self.x * o.z, self.x * o.y - self.y * o.x)

    def length(self) -> Column:
        return F.sqrt(self.dot(self))

    def normalized(self) -> Vec:
        """The unit vector; a zero vector stays zero."""
        n = self.length()
        k = F.when(n > 0, 1.0 / n).otherwise(F.lit(0.0))
        return self.scale(k)

    def lerp(self, o: Vec, t: Column | float) -> Vec:
        return self + (o - self).scale(t)

    def struct(self) -> Column:
        return F.struct(self.x.alias("x"), self.y.alias("y"), self.z.alias("z"))

    def array(self) -> Column:
        return F.array(self.x, self.y, self.z)

    def equals(self, o: Vec) -> Column:
        return (self.x == o.x) & (self.y == o.y) & (self.z == o.z)


def distance(a: Vec, b: Vec) -> Column:
    """Straight 3D distance, by products so that all engines agree to the last bit."""
    return (a - b).length()


def ground_distance(a: Vec, b: Vec) -> Column:
    d = a - b
    return F.sqrt(d.x * d.x + d.y * d.y)


def height(p: Vec, floor: float) -> Column:
    return p.z - F.lit(float(floor))


def metres(n: Column | float) -> Column | float:
    """Units in ``n`` metres."""
    return n / METRES_PER_UNIT


def half_up(c: Column, places: int = 0) -> Column:
    """Round half toward positive infinity."""
    k = 10.0**places
    return F.floor(c * k + 0.5) / k


def transform_point(m: list[float], p: Vec) -> Vec:
    """Apply a column-major 4 x 4 matrix."""
    row = lambda i: p.x * m[i] + p.y * m[4 + i] + p.z * m[8 + i] + m[12 + i]
    return Vec(row(0), row(1), row(2))


# cells ---------------------------------------------------------------------------------------


def cell(c: Column, size: float) -> Column:
    if not size > 0:
        raise ValueError("a cell size must be over 0")
    return F.floor(c / F.lit(float(size))).cast("long")


def region(p: Vec, size: float) -> Column:
    """The square XY cell of a point: ix, iy, centre and text key."""
    ix, iy = cell(p.x, size), cell(p.y, size)
    return F.struct(
        ix.alias("ix"), iy.alias("iy"), F.concat_ws(",", ix.cast("string"), iy.cast("string")).alias("key"),
        F.struct(((ix + 0.5) * size).alias("x"), ((iy + 0.5) * size).alias("y")).alias("center"),
    )


def in_box(p: Vec, low: tuple[float, float, float], high: tuple[float, float, float]) -> Column:
    return p.x.between(low[0], high[0]) & p.y.between(low[1], high[1]) & p.z.between(low[2], high[2])


def in_rect(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Inside a rectangle given by two opposite corners in any order, edges included."""
    return x.between(F.least(ax, bx), F.greatest(ax, bx)) & y.between(F.least(ay, by), F.greatest(ay, by))


# angles --------------------------------------------------------------------------------------


def angle_between(a: Column, b: Column) -> Column:
    """The smaller turn between two headings, in degrees."""
    d = F.pmod(a - b, F.lit(360.0))
    return F.least(d, 360.0 - d)


def look_at(eye: Vec, target: Vec) -> Column:
    """Pitch (down is positive) and yaw in [0, 360) from ``eye`` to ``target``, to 3 places."""
    d = target - eye
    flat = F.sqrt(d.x * d.x + d.y * d.y)
    pitch = half_up(F.degrees(-F.atan2(d.z, flat)), 3)
    yaw = F.pmod(half_up(F.degrees(F.atan2(d.y, d.x)), 3), F.lit(360.0))
    return F.struct(pitch.alias("pitch"), yaw.alias("yaw"))


def rotation(pitch: Column, yaw: Column, roll: Column) -> list[Vec]:
    """Columns of the rotation yaw, then pitch, then roll (degrees): the axes of the turned frame."""
    sp, cp, sy, cy, sr, cr = (f(F.radians(a)) for a in (pitch, yaw, roll) for f in (F.sin, F.cos))
    return [
        Vec(cp * cy, cp * sy, -sp),
        Vec(sr * sp * cy - cr * sy, sr * sp * sy + cr * cy, sr * cp),
        Vec(cr * sp * cy + sr * sy, cr * sp * sy - sr * cy, cr * cp),
    ]


def in_oriented_box(p: Vec, origin: Vec, angles: tuple[Column, Column, Column], low: Vec, high: Vec) -> Column:
    """Inside a box given in the frame of an origin and angles, faces included."""
    d = p - origin
    inside = [d.dot(axis).between(getattr(low, c), getattr(high, c)) for c, axis in zip("xyz", rotation(*angles), strict=True)]
    return inside[0] & inside[1] & inside[2]


def view_axes(pitch: Column, yaw: Column, roll: Column) -> tuple[Vec, Vec, Vec]:
    """Forward, right and up of a camera."""
    p, y, r = (F.radians(a) for a in (pitch, yaw, roll))
    forward = Vec(F.cos(p) * F.cos(y), F.cos(p) * F.sin(y), -F.sin(p))
    right = Vec(F.sin(y), -F.cos(y), F.lit(0.0))
    up = right.cross(forward)
    return forward, right.scale(F.cos(r)) - up.scale(F.sin(r)), up.scale(F.cos(r)) + right.scale(F.sin(r))


def transformed_bounds(m: list[float], low: Vec, high: Vec) -> tuple[Vec, Vec]:
    """Least and greatest coordinates of the eight corners of a box after a transform."""
    corners = [transform_point(m, Vec(x, y, z)) for x in (low.x, high.x) for y in (low.y, high.y) for z in (low.z, high.z)]
    pick = lambda f: Vec(*(f(*[getattr(c, a) for c in corners]) for a in "xyz"))
    return pick(F.least), pick(F.greatest)


def centroid(points: Column) -> Column:
    """Mean of a list of points."""
    mean = lambda c: F.aggregate(points, F.lit(0.0), lambda s, p: s + p[c]) / F.size(points)
    return F.when(F.size(points) > 0, F.struct(mean("x").alias("x"), mean("y").alias("y"), mean("z").alias("z")))


# nearest points ------------------------------------------------------------------------------


def closest_on_segment(p: Vec, a: Vec, b: Vec) -> Vec:
    """The point of the segment a to b nearest to p."""
    d = b - a
    t = F.when(d.dot(d) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (p - a).dot(d) / F.nullif(d.dot(d), F.lit(0.0))))).otherwise(F.lit(0.0))
    return a + d.scale(t)


def bound(df: DataFrame, **parts: Vec | Column) -> tuple[DataFrame, list]:
    """``df`` with columns of the parts, and the parts read from them: a long expression is computed once, however often it is used."""
    columns, out = {}, []
    for name, v in parts.items():
        if isinstance(v, Vec):
            columns |= {f"__{name}{c}": getattr(v, c) for c in "xyz"}
            out.append(Vec.of(f"__{name}"))
        else:
            columns[f"__{name}"] = v
            out.append(F.col(f"__{name}"))
    return df.withColumns(columns), out


def with_closest_on_triangle(df: DataFrame, p: Vec, a: Vec, b: Vec, c: Vec, name: str = "q") -> DataFrame:
    """``df`` with (d2, x, y, z) in ``name``: the point of a triangle nearest to p and its squared distance.

    The foot of the perpendicular where that lies inside, else the nearest point of the three sides."""
    own = df.columns
    df, (e1, e2, w) = bound(df, e1=b - a, e2=c - a, w=p - a)
    df, (n,) = bound(df, n=e1.cross(e2))
    df, (k,) = bound(df, k=F.nullif(n.dot(n), F.lit(0.0)))
    df, (u, v) = bound(df, u=w.cross(e2).dot(n) / k, v=e1.cross(w).dot(n) / k)
    df, spots = bound(df, g0=a + e1.scale(u) + e2.scale(v), **{f"g{i}": closest_on_segment(p, *s) for i, s in enumerate(((a, b), (b, c), (c, a)), 1)})
    df, d2 = bound(df, **{f"d{i}": (p - g).dot(p - g) for i, g in enumerate(spots)})
    at = [F.struct(d.alias("d2"), g.x.alias("x"), g.y.alias("y"), g.z.alias("z")) for d, g in zip(d2, spots, strict=True)]
    return df.select(*own, F.when((u >= 0) & (v >= 0) & (u + v <= 1), at[0]).otherwise(F.least(*at[1:])).alias(name))


def inner_gap(a: Vec, b: Vec, c: Vec, d: Vec) -> Column:
    """Squared distance of the segments a to b and c to d where their nearest points are inside of both, else null."""
    e, f, r = b - a, d - c, a - c
    det = F.nullif(e.dot(e) * f.dot(f) - e.dot(f) * e.dot(f), F.lit(0.0))
    s = (e.dot(f) * f.dot(r) - e.dot(r) * f.dot(f)) / det
    t = (e.dot(e) * f.dot(r) - e.dot(f) * e.dot(r)) / det
    gap = r + e.scale(s) - f.scale(t)
    return F.when(s.between(0.0, 1.0) & t.between(0.0, 1.0), gap.dot(gap))


# rings ---------------------------------------------------------------------------------------


def _edges(ring: Column) -> Column:
    """Each vertex with its successor; the last one's is the first."""
    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.arrays_zip(ring.alias("a"), after.alias("b"))


def ring_area(ring: Column) -> Column:
    """Area of a ring in XY, whatever its winding; under 3 vertices 0."""
    twice = F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
    return F.when(F.size(ring) < 3, F.lit(0.0)).otherwise(F.abs(twice) / 2)


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule in XY."""

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["y"] > y) != (b["y"] > y)
        at = a["x"] + (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) * (b["x"] - a["x"])
        return F.coalesce(spans & (x < at), F.lit(False))

    return F.size(F.filter(_edges(ring), crosses)) % 2 == 1


def on_ring(x: Column, y: Column, ring: Column) -> Column:
    """A point lies on an edge of a ring (XY)."""

    def holds(e: Column) -> Column:
        a, b = e["a"], e["b"]
        turn = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
        return (turn == 0) & in_rect(x, y, a["x"], a["y"], b["x"], b["y"])

    return F.exists(_edges(ring), holds)


def is_rectangle(ring: Column) -> Column:
    """A ring of four corners with sides along x and y that has area."""
    p = [F.get(ring, F.lit(i)) for i in range(4)]
    flat = lambda c, i: p[i][c] == p[(i + 1) % 4][c]
    turned = [flat("yx"[k], 0) & flat("xy"[k], 1) & flat("yx"[k], 2) & flat("xy"[k], 3) for k in (0, 1)]
    return (F.size(ring) == 4) & F.coalesce(turned[0] | turned[1], F.lit(False)) & (p[0]["x"] != p[2]["x"]) & (p[0]["y"] != p[2]["y"])


def path_measure(points: Column) -> Column:
    """3D length, ground length and rise of a list of points."""
    steps = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda a, b: F.struct((b["x"] - a["x"]).alias("x"), (b["y"] - a["y"]).alias("y"), (b["z"] - a["z"]).alias("z")))
    total = lambda f: F.aggregate(steps, F.lit(0.0), lambda s, d: s + f(d))
    return F.struct(
        total(lambda d: F.sqrt(d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"])).alias("distance"),
        total(lambda d: F.sqrt(d["x"] * d["x"] + d["y"] * d["y"])).alias("ground"),
        total(lambda d: d["z"]).alias("rise"),
    )


def rings_overlap(a: Column, b: Column) -> Column:
    """Two rings share area: edges cross, or one holds the other's first vertex (XY)."""
    turn = lambda p, q, r: (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])

    def cross(e: Column, f: Column) -> Column:
        one = F.signum(turn(f["a"], f["b"], e["a"])) * F.signum(turn(f["a"], f["b"], e["b"]))
        two = F.signum(turn(e["a"], e["b"], f["a"])) * F.signum(turn(e["a"], e["b"], f["b"]))
        return (one < 0) & (two < 0)

    inside = point_in_ring(a[0]["x"], a[0]["y"], b) | point_in_ring(b[0]["x"], b[0]["y"], a)
    return F.exists(_edges(a), lambda e: F.exists(_edges(b), lambda f: cross(e, f))) | inside


def segments_cross(a: Vec, b: Vec, c: Vec, d: Vec) -> Column:
    """Two XY segments cross or touch."""
    turn = lambda p, q, r: F.signum((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x))
    on = lambda p, q, r: in_rect(r.x, r.y, p.x, p.y, q.x, q.y)
    d1, d2, d3, d4 = turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)
    return ((d1 * d2 < 0) & (d3 * d4 < 0)) | ((d1 == 0) & on(a, b, c)) | ((d2 == 0) & on(a, b, d)) | ((d3 == 0) & on(c, d, a)) | ((d4 == 0) & on(c, d, b))
