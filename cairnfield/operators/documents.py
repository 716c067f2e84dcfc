"""Annotation, tag, screenshot and submission documents: what to frame, tag records and cross-row rules.

Each rule is a group-by or an anti-join over the rows of a document; issues are rows (subject, code, message).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnfield.functions.geometry import Vec, angle_between, distance
from cairnfield.operators.metadata import POINT_KINDS, validate
from cairnfield.operators.sequence import ORD

#: Known tags (fixed values).
TAGS = ("labelling-box", "heavy-box", "sinners-entity")


def _issues(rows: DataFrame, subject, code: str, message) -> DataFrame:
    return rows.select(subject.cast("string").alias("subject"), F.lit(code).alias("code"), message.alias("message"))


def _repeats(rows: DataFrame, key: str, code: str, what: str) -> DataFrame:
    """An issue for each value after the first of its kind."""
    twice = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    each = twice.withColumn("i", F.explode(F.sequence(F.lit(2), F.col("n").cast("int"))))
    return _issues(each, F.col(key), code, F.concat(F.lit(what + ' "'), F.col(key).cast("string"), F.lit('"')))


def _framed(rows: DataFrame, single) -> tuple[DataFrame, DataFrame]:
    single = F.coalesce(single, F.lit(False))
    no = F.concat("kind", F.lit(" has no single point to frame"))
    return rows.where(single).select(ORD, "id", "x", "y", "z"), rows.where(~single).select(ORD, "id", no.alias("reason"))


def targets_of_annotations(annotations: DataFrame, layer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Points and labels (ord, id, kind, layer, points) become targets at their first point; the rest is skipped with a reason."""
    a = annotations if layer is None else annotations.where(F.col("layer") == layer)
    at = F.get("points", F.lit(0))
    return _framed(a.select(ORD, "id", "kind", *[at[c].alias(c) for c in "xyz"]), F.col("kind").isin("point", "label"))


def targets_of_records(records: DataFrame, all_statuses: bool = False) -> tuple[DataFrame, DataFrame]:
    """Accepted records (all with ``all_statuses``) of a point kind, or custom ones whose geometry is a point, become targets."""
    r = records if all_statuses else records.where("status = 'accepted'")
    r = r.withColumn("id", F.concat_ws("-", "kind", F.col("id").cast("string")))
    return _framed(r, F.col("kind").isin(*POINT_KINDS) | ((F.col("kind") == "custom") & (F.col("geometry") == "point")))


def tag_records(tags: DataFrame, entities: DataFrame) -> DataFrame:
    """One proposed custom point for each (tag, entity_id), however often tagged, at the entity."""
    e = entities.select(F.col("id").cast("string").alias("entity_id"), "x", "y", "z")
    t = tags.select("tag", F.col("entity_id").cast("string").alias("entity_id")).distinct()
    rid = F.substring(F.regexp_replace(F.concat_ws(".", F.lit("tag"), "tag", "entity_id"), "[^A-Za-z0-9._-]", "_"), 1, 128)
    return t.join(e, "entity_id").select(rid.alias("id"), F.lit("proposed").alias("status"), F.lit("custom").alias("kind"), F.lit("point").alias("geometry"), F.col("tag").alias("label"), F.substring("entity_id", 1, 200).alias("entity_id"), "x", "y", "z")


def tags_of(records: DataFrame, known: tuple[str, ...] = TAGS) -> DataFrame:
    """(id, tag, entity_id) of the records that carry a known tag."""
    return records.where((F.col("kind") == "custom") & (F.col("geometry") == "point") & F.col("label").isin(*known) & F.col("entity_id").isNotNull()).select("id", F.col("label").alias("tag"), "entity_id")


def annotation_issues(annotations: DataFrame, layers: DataFrame) -> DataFrame:
    """Repeated layer ids, repeated annotation ids, and annotations on layers that aren't there; no layer is fine."""
    lost = annotations.where("layer is not null").join(layers.select(F.col("id").alias("layer")), "layer", "left_anti")
    unknown = _issues(lost, F.col("id"), "unknown-layer", F.concat(F.lit('unknown layer "'), "layer", F.lit('"')))
    return _repeats(layers, "id", "duplicate-layer", "duplicate layer id").unionByName(_repeats(annotations, "id", "duplicate-annotation", "duplicate annotation id")).unionByName(unknown)


def shot_issues(shots: DataFrame, position: float = 8.0, angle: float = 1.0) -> DataFrame:
    """Repeated shot ids or files, and poses read back (got_x .. got_roll) farther off than the tolerances; none read back is fine."""
    gap = distance(Vec.of(), Vec.of("got_"))
    turn = F.greatest(*[angle_between(F.col(a), F.col("got_" + a)) for a in ("pitch", "yaw", "roll")])
    off = [
        _issues(shots.where(gap > position), F.col("id"), "off-position", F.format_string("%.1f units off", gap)),
        _issues(shots.where(turn > angle), F.col("id"), "off-angle", F.format_string("%.1f degrees off", turn)),
    ]
    return reduce(DataFrame.unionByName, [_repeats(shots, "id", "duplicate-shot", "duplicate shot id"), _repeats(shots, "file", "shared-file", "shots share the file"), *off])


def submission_issues(records: DataFrame, low: tuple[float, float, float], high: tuple[float, float, float], given: dict[str, str], expected: dict[str, str]) -> DataFrame:
    """Build or map unlike the expected ones, records that are not proposed, and the issues of ``validate``."""
    spark = records.sparkSession
    unlike = [(k, f"{k}-mismatch", f'{k} "{given.get(k)}" is not the loaded "{v}"') for k, v in expected.items() if given.get(k) != v]
    head = spark.createDataFrame(unlike, "subject string, code string, message string")
    status = _issues(records.where(~F.col("status").eqNullSafe(F.lit("proposed"))), F.col("id"), "not-proposed", F.concat(F.lit("status "), F.coalesce("status", F.lit("missing"))))
    rules = validate(records, low, high).select(F.col("record_id").cast("string").alias("subject"), "code", "message")
    return head.unionByName(status).unionByName(rules)
