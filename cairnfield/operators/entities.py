"""Map entities: filters, distance joins, nearest neighbours and cell aggregation.

An entity relation has ord, id, kind, x, y, z and usually team, lane, source and properties. Targets
are any relation with x, y, z. Distance joins are equi-joins on grid cells, never nested loops:
the rows of one side are dealt to their cell, those of the other to the 27 (3D) cells around.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.functions.geometry import Vec, cell, distance, region
from cairnfield.operators.sequence import ORD, Seq
from cairnfield.plans.storage import materialize, shuffled

#: Lane colour by lane number (fixed values).
LANES = {1: "yellow", 2: "blue", 3: "green"}

#: Named collections and the kind they hold (fixed values).
COLLECTIONS = {
    "guardians": "guardian",
    "walkers": "walker",
    "patrons": "patron",
    "healing_orbs": "healingOrb",
    "creep_camps": "creepCamp",
    "sinners_sacrifices": "sinnersSacrifice",
    "ziplines": "zipline",
}


def lane_colour(number: Column, lanes: dict[int, str] = LANES) -> Column:
    return F.create_map(*[F.lit(v) for kv in lanes.items() for v in kv])[number]


def as_entities(df: DataFrame, lanes: dict[int, str] = LANES, source: str = "extractor") -> DataFrame:
    """Add the lane colour (lane), its number (lane_number) and the source."""
    colour = lane_colour(F.col("lane"), lanes)
    return df.withColumnRenamed("lane", "lane_number").withColumn("lane", lane_colour(F.col("lane_number"), lanes)).withColumn("source", F.lit(source)) if dict(df.dtypes).get("lane") != "string" else df.withColumn("source", F.lit(source)).withColumn("lane", F.coalesce("lane", colour))


def near(left: DataFrame, right: DataFrame, radius: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs within ``radius`` (inclusive): all columns of left, and right's under ``r_``, ``dist``.

    Cells are as wide as the radius, so matches lie in the 27 cells around. The smaller side should
    be ``right``: it is the one that is copied. Columns of ``by`` are equal on both sides, as keys of the join.
    Both sides are dealt to all tasks by cell, however few files they are read from.
    """
    if radius < 0:
        raise ValueError("a radius must not be negative")
    if radius == 0:
        keys = ("x", "y", "z")
        r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
        return left.join(r, [left[c] == r[f"r_{c}"] for c in (*keys, *by)]).withColumn("dist", F.lit(0.0))
    size = float(radius)
    l = left.withColumns({n: cell(F.col(c), size) for n, c in zip(("__i", "__j", "__k"), "xyz", strict=True)})
    r = right.select([F.col(c).alias(f"r_{c}") for c in right.columns])
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]))
    r = r.withColumn("__s", steps).withColumns({n: cell(F.col(f"r_{c}"), size) + F.col(f"__s.{s}") for n, c, s in zip(("__i", "__j", "__k"), "xyz", "abc", strict=True)}).drop("__s")
    d = distance(Vec.of(), Vec.of("r_"))
    keys = ["__i", "__j", "__k"]
    l, r = (x.withColumns({f"__by{i}": F.col(p + c) for i, c in enumerate(by)}) for x, p in ((l, ""), (r, "r_")))
    keys += [f"__by{i}" for i in range(len(by))]
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return l.repartition(n, *keys).join(shuffled(r.repartition(n, *keys)), keys).drop(*keys).withColumn("dist", d).where(F.col("dist") <= size)


#: Rows of right that ``first_near`` tries first, about; each round tries four times those before.
FIRST_TRIED = 1024


def first_near(left: DataFrame, right: DataFrame, radius: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(ord, r_ord): for each row of left the least ``ord`` of right within ``radius`` (and of equal ``by``), if there is one.

    Right is tried in rounds, by ascending ``ord``: a row that has met one needs none of the later rounds, so where many
    lie in reach not all pairs are made."""
    rest, out = left.select(ORD, "x", "y", "z", *by), None
    right = materialize(right.select(ORD, "x", "y", "z", *by), "tried")
    rows, cuts, size = right.count(), [], FIRST_TRIED
    while size < rows:
        cuts.append(size / rows)
        size *= 4
    cuts = sorted(set(right.approxQuantile(ORD, cuts, 0.25 * cuts[0]))) if cuts else []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        tried = right if low is None else right.where(F.col(ORD) > low)
        tried = tried if high is None else tried.where(F.col(ORD) <= high)
        got = materialize(near(rest, tried, radius, by).groupBy(ORD).agg(F.min(f"r_{ORD}").alias(f"r_{ORD}")), "first-near")
        out = got if out is None else out.unionByName(got)
        if high is None:
            return out
        rest = materialize(rest.join(shuffled(got.select(ORD)), ORD, "left_anti"), "first-near-rest")
        if rest.isEmpty():
            return out


def nearest(left: DataFrame, right: DataFrame, k: int = 1, radius: float | None = None, id_col: str = ORD) -> DataFrame:
    """The ``k`` nearest rows of right for each row of left; ties go to the smaller r_ord.

    The cell join runs in rounds: a row with ``k`` targets within the cell size is settled, as its nearest
    are among them; for the rows left the cell size doubles, until it is the ``radius`` or, without one, spans
    all points. The first size gives a cell about one target, were they even. A row far from all targets meets
    many of them in its last round.

    Without a radius, targets without finite coordinates are no candidates; a row of left without
    them gets the ``k`` smallest r_ord.
    """
    if radius is not None and not radius > 0:
        return _top(near(left, right, radius), left, k, id_col)
    finite = F.coalesce(F.abs("x") + F.abs("y") + F.abs("z") < float("inf"), F.lit(False))
    r = right.where(finite)
    size, span = _cell_size(left.where(finite), r)
    if radius is None:
        some = right.select([F.col(c).alias(f"r_{c}") for c in right.columns]).orderBy(f"r_{ORD}").limit(k)
        blank = left.where(~finite).crossJoin(F.broadcast(some)).withColumn("dist", distance(Vec.of(), Vec.of("r_")))
        out = _top(blank, left, k, id_col)
    else:
        out = None
    rest = left.where(finite)
    while True:
        if radius is not None:
            size = min(size, float(radius))
        last = size > span or size == radius
        got = materialize(_top(near(rest, r, size), left, k, id_col), "nearest")
        full = (got if last or k == 1 else got.where(F.col("rank") == k)).select(F.col(id_col).alias("__full"))
        if last:
            return got if out is None else out.unionByName(got)
        is_full = F.col(id_col).eqNullSafe(F.col("__full"))
        settled = got.join(full, is_full, "left_semi")
        out = settled if out is None else out.unionByName(settled)
        rest = materialize(rest.join(full, is_full, "left_anti"), "nearest-rest")
        if rest.isEmpty():
            return out
        size *= 2


def _cell_size(left: DataFrame, right: DataFrame) -> tuple[float, float]:
    """The cell size that gives a cell about one row of right, and a bound of all distances."""
    ends = [f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]
    l, r = left.agg(*ends).first(), right.agg(F.count("*").alias("n"), *ends).first()
    if l["lo_x"] is None or not r["n"]:
        return 1.0, 0.0
    span = 1.000001 * math.hypot(*(max(l[f"hi_{c}"], r[f"hi_{c}"]) - min(l[f"lo_{c}"], r[f"lo_{c}"]) for c in "xyz"))
    sides = sorted(float(r[f"hi_{c}"] - r[f"lo_{c}"]) for c in "xyz")
    for i in range(3):  # flat sides don't count
        size = math.prod(x / r["n"] ** (1 / (3 - i)) for x in sides[i:]) ** (1 / (3 - i)) if sides[i] > 0 else 0.0
        if 0 < size <= sides[i]:
            return size, span
    return max(span, 1.0), span


def _top(got: DataFrame, left: DataFrame, k: int, id_col: str) -> DataFrame:
    """The ``k`` pairs of least dist and r_ord of each row of left."""
    if k == 1:  # partial aggregation: no sort, no skew
        cols = [c for c in got.columns if c != id_col]
        best = got.groupBy(id_col).agg(F.min_by(F.struct(*cols), F.struct("dist", f"r_{ORD}")).alias("__b"))
        return best.select(id_col, "__b.*")
    # a bounded heap per row would need a UDAF; the k smallest of an array are sliced from its sort
    cols = ["dist", f"r_{ORD}", *[c for c in got.columns if c.startswith("r_") and c != f"r_{ORD}"]]
    own = [c for c in left.columns if c != id_col]
    top = got.groupBy(id_col).agg(*[F.first(c).alias(c) for c in own], F.slice(F.sort_array(F.collect_list(F.struct(*cols))), 1, k).alias("__t"))
    return top.select(id_col, *own, F.posexplode("__t").alias("rank", "__e")).select(id_col, *own, (F.col("rank") + 1).alias("rank"), "__e.*")


#: Targets that are broadcast at a time where there is no range.
SMALL = 10_000


class EntityList(Seq):
    """A sequence of entities."""

    def of_kind(self, kind: str) -> EntityList:
        return self.where(F.col("kind") == kind)

    def __getattr__(self, name: str) -> EntityList:
        if name in COLLECTIONS:
            return self.of_kind(COLLECTIONS[name])
        raise AttributeError(name)

    def in_lane(self, lane: str | int) -> EntityList:
        return self.where(F.col("lane") == lane if isinstance(lane, str) else F.col("lane_number") == lane)

    def on_team(self, team: int) -> EntityList:
        return self.where(F.col("team") == team)

    def from_source(self, source: str) -> EntityList:
        return self.where(F.col("source") == source)

    def high_ground(self, at_least: float, floor: float = 0.0) -> EntityList:
        """At least so high above ``floor`` (the bounds' minimum, where there is a map)."""
        return self.where(F.col("z") - F.lit(float(floor)) >= at_least)

    def within(self, radius: float, of: DataFrame) -> EntityList:
        """Entities within ``radius`` of any target."""
        targets = of.select("x", "y", "z").distinct().withColumn(ORD, F.lit(0))  # any will do
        hits = nearest(self.df.select(ORD, "x", "y", "z"), targets, radius=radius).select(ORD).distinct()
        return self._new(self.df.join(hits, ORD, "left_semi"), self.keys)

    def closest_n(self, to: tuple[float, float, float], n: int) -> DataFrame:
        d = distance(Vec.of(), Vec.at(*to))
        return self.settled().df.withColumn("dist", d).orderBy("dist", ORD).limit(max(n, 0))

    def closest(self, to: tuple[float, float, float]) -> DataFrame:
        return self.closest_n(to, 1)

    def group_by_region(self, size: float) -> Seq:
        """Cells with their items, in order of ix, iy."""
        df = self.settled().df.withColumn("__r", region(Vec.of(), size))
        columns = [c for c in df.columns if c not in ("__r", ORD)]
        got = df.groupBy("__r.ix", "__r.iy").agg(F.first("__r").alias("region"), F.sort_array(F.collect_list(F.struct(ORD, *columns))).alias("items"))
        return Seq(got.withColumn(ORD, packed("ix", "iy")).drop("ix", "iy"))


def packed(ix: str, iy: str) -> Column:
    """One number that sorts as (ix, iy) does, for cells within +-2^31."""
    return F.shiftleft(F.col(ix).cast("long"), 32) + (F.col(iy).cast("long") + F.lit(1 << 31))


def density(points: DataFrame, size: float) -> Seq:
    """Heat cells: ix, iy, key, count of every non-empty cell, ordered; summed before the shuffle."""
    got = points.select(cell(F.col("x"), size).alias("ix"), cell(F.col("y"), size).alias("iy")).groupBy("ix", "iy").agg(F.count("*").alias("count"))
    return Seq(got.withColumn("key", F.concat_ws(",", F.col("ix").cast("string"), F.col("iy").cast("string"))).withColumn(ORD, packed("ix", "iy")))


def near_duplicates(df: DataFrame, radius: float | dict[str, float], id_col: str = "id", by: str = "kind") -> DataFrame:
    """Pairs of one kind closer than ``radius`` (strictly; or than each kind's, others have none), each once: a_id, b_id, dist."""
    side = df.select(ORD, F.col(id_col).alias("id"), F.col(by).alias("by"), "x", "y", "z")
    if isinstance(radius, dict):
        if not radius:
            return side.where("false").select(F.col("id").alias("a_id"), F.col("id").alias("b_id"), F.col("x").alias("dist"))
        least = F.create_map(*[F.lit(v) for kv in radius.items() for v in kv])[F.col("by")]
        side, most = side.where(F.col("by").isin(*radius)), max(radius.values())
    else:
        least, most = F.lit(radius), radius
    got = near(side, side, most, ("by",)).where((F.col(ORD) < F.col(f"r_{ORD}")) & (F.col("dist") < least))
    return got.select(F.col("id").alias("a_id"), F.col("r_id").alias("b_id"), "dist")


def chokepoints(routes: DataFrame, size: float, top: int = 5) -> DataFrame:
    """Cells that most routes pass (route, x, y): each cell once a route, then counted; ties by key."""
    cells = routes.select("route", cell(F.col("x"), size).alias("ix"), cell(F.col("y"), size).alias("iy")).distinct()
    return cells.groupBy(F.concat_ws(",", F.col("ix").cast("string"), F.col("iy").cast("string")).alias("key")).agg(F.count("*").alias("routes")).orderBy(F.desc("routes"), "key").limit(top)
