"""Kind, lane and team of entities from their names and tints; zipline paths and entity links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnfield.operators.sequence import ORD

#: Lane number by name; the lane called purple is the green one (fixed values).
LANE_NUMBER = {"yellow": 1, "blue": 2, "green": 3, "purple": 3}

#: Team number by a word of a name (fixed values).
TEAM_NUMBER = {"amber": 2, "combine": 2, "sapphire": 3, "rebel": 3}

#: Kinds whose names carry a lane, and a team (fixed values).
LANE_KINDS = ("guardian", "walker", "barracks", "baseSentry")
TEAM_KINDS = ("guardian", "walker", "patron", "barracks", "baseSentry")

#: Properties whose text is searched, in this order (fixed values).
LANE_KEYS = ("bossname", "subclass_name", "targetname")
TEAM_KEYS = ("bossname", "subclass_name", "targetname", "classname")

#: Kind of an entity by its class (fixed values).
KIND_OF_CLASS = {
    "npc_boss_tier2": "walker",
    "npc_boss_tier3": "patron",
    "npc_barrack_boss": "barracks",
    "npc_base_defense_sentry": "baseSentry",
    "info_neutral_trooper_camp": "creepCamp",
    "citadel_zipline_path_node": "zipline",
    "trigger_catapult": "jumpPad",
    "citadel_trigger_climb_rope": "climbRope",
    "citadel_trigger_interior": "interior",
    "trigger_item_shop": "shop",
    "info_team_spawn": "spawn",
    "info_trooper_spawn": "trooperSpawn",
    "citadel_capture_point": "capturePoint",
    "citadel_item_powerup_spawner": "powerup",
    "item_crate_spawn": "crate",
    "lane_marker_path": "laneMarker",
}


def _lookup(c: Column, table: dict) -> Column:
    return F.create_map(*[F.lit(v) for kv in table.items() for v in kv])[c]


def entity_kind(cls: Column, subclass: Column) -> Column:
    """Kind from the class; super troopers and pickups are told by their subclass. Null if none."""
    guardian = F.when(subclass.rlike(r"^boss_(rebel|combine)_t1_"), "guardian")
    orb = F.when(subclass == "citadel_pickup_floating_health", "healingOrb")
    return F.when(cls == "info_super_trooper_spawn", guardian).when(cls == "citadel_pickup_spawner", orb).otherwise(_lookup(cls, KIND_OF_CLASS))


def _named(text: Column, table: dict[str, int], plural: str = "") -> Column:
    word = F.lower(F.regexp_extract(text, rf"(?i)(?:^|[^a-z])({'|'.join(table)}){plural}(?![a-z])", 1))
    return _lookup(F.nullif(word, F.lit("")), table)


def lane_from_name(text: Column) -> Column:
    """Lane number of the first lane word that stands alone in a name; null if none."""
    return _named(text, LANE_NUMBER)


def team_from_name(text: Column) -> Column:
    return _named(text, TEAM_NUMBER, "s?")


def lane_number(kind: Column, properties: dict[str, Column]) -> Column:
    """Lane of the kinds that are named after one, from the first property that tells it."""
    return F.when(kind.isin(*LANE_KINDS), F.coalesce(*[lane_from_name(properties[k]) for k in LANE_KEYS if k in properties], F.lit(None).cast("int")))


def team_number(kind: Column, cls: Column, properties: dict[str, Column]) -> Column:
    return F.when(kind.isin(*TEAM_KINDS), F.coalesce(*[team_from_name(properties[k]) for k in TEAM_KEYS if k in properties], team_from_name(cls)))


def lane_from_tint(tint: Column) -> Column:
    """Lane number from a colour [r, g, b] of 0..255, by hue; greys have none."""
    r, g, b = (tint[i].cast("double") / 255 for i in range(3))
    top = F.greatest(r, g, b)
    d = top - F.least(r, g, b)
    part = F.nullif(d, F.lit(0.0))
    hue = F.when(top == r, (g - b) / part).when(top == g, (b - r) / part + 2).otherwise((r - g) / part + 4) * 60
    hue = F.pmod(hue + 360, F.lit(360.0))
    lane = F.when((hue >= 15) & (hue < 75), 1).when((hue >= 180) & (hue < 265), 2).when((hue >= 265) & (hue < 340), 3)
    return F.when((F.size(tint) >= 3) & (top > 0) & (d / F.nullif(top, F.lit(0.0)) >= 0.25), lane)


def zipline_lanes(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(ord, lane) of zipline nodes whose path has a lane of its own by its tint.

    nodes: ord, path_id; paths: id, tint, use_base (drawn in the base lane's colour)."""
    own = paths.where(~F.coalesce("use_base", F.lit(False))).select(F.col("id").alias("path_id"), lane_from_tint(F.col("tint")).alias("lane")).where("lane is not null")
    return nodes.select(ORD, "path_id").join(own, "path_id").select(ORD, "lane")


def zipline_paths(nodes: DataFrame) -> DataFrame:
    """(path_id, n, lane, points, ords): the paths of two nodes or more, in order of index, then of input.

    nodes: ord, path_id, idx, lane, x, y, z. The lane is that of the first node that has one."""
    row = F.struct(F.coalesce("idx", F.lit(0.0)).alias("idx"), ORD, "lane", "x", "y", "z")
    got = nodes.where("path_id is not null").groupBy("path_id").agg(F.sort_array(F.collect_list(row)).alias("p")).where(F.size("p") >= 2)
    lane = F.filter("p", lambda v: v["lane"].isNotNull())
    return got.select(
        "path_id", F.size("p").alias("n"), F.try_element_at(lane, F.lit(1))["lane"].alias("lane"),
        F.transform("p", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"), v["z"].alias("z"))).alias("points"), F.col(f"p.{ORD}").alias("ords"),
    )


def loose_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes without a path, or alone on it."""
    alone = nodes.where("path_id is not null").groupBy("path_id").agg(F.count("*").alias("n")).where("n = 1").select("path_id")
    return nodes.where("path_id is null").unionByName(nodes.join(alone, "path_id", "left_semi").select(*nodes.columns))


def zipline_links(nodes: DataFrame) -> DataFrame:
    """(from_ord, to_ord, kind, bidirectional): links of consecutive stops that can be boarded.

    nodes: ord, path_id, idx, one_way, boardable. The first node of a path tells whether it is one-way."""
    order = Window.partitionBy("path_id").orderBy(F.coalesce("idx", F.lit(0.0)), ORD)
    first = F.first("one_way").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    stops = nodes.where("path_id is not null").withColumn("one", F.coalesce(first, F.lit(False))).where(F.coalesce("boardable", F.lit(True)))
    return stops.withColumn("to_ord", F.lead(ORD).over(order)).where("to_ord is not null").select(F.col(ORD).alias("from_ord"), "to_ord", F.lit("zipline").alias("kind"), (~F.col("one")).alias("bidirectional"))


def jump_links(entities: DataFrame) -> DataFrame:
    """(from_ord, to_ord, kind, bidirectional): jump pads to the first entity of the name they aim at.

    entities: ord, kind, name, target."""
    named = entities.where("name is not null and name <> ''").groupBy("name").agg(F.min(ORD).alias("to_ord"))
    pads = entities.where("kind = 'jumpPad'").select(F.col(ORD).alias("from_ord"), F.col("target").alias("name"))
    return pads.join(named, "name").where("from_ord <> to_ord").select("from_ord", "to_ord", F.lit("jumpPad").alias("kind"), F.lit(False).alias("bidirectional"))


def legs(points: DataFrame, path: str = "path_id") -> DataFrame:
    """Consecutive pairs along each path: path, ord, to_ord, and dx, dy, dz."""
    order = Window.partitionBy(path).orderBy(ORD)
    after = lambda c: F.lead(c).over(order)
    return points.select(path, ORD, after(ORD).alias("to_ord"), *[(after(c) - F.col(c)).alias(f"d{c}") for c in "xyz"]).where("to_ord is not null")
