"""Text of cells, labels, identifiers and a ranked search, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slug(name: Column, empty: str = "query") -> Column:
    """Lower case, runs of other characters as one dash, none at the ends; ``empty`` if nothing is left."""
    got = F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(F.coalesce(got, F.lit("")) == "", empty).otherwise(got)


def safe_id(name: Column, most: int = 100, empty: str = "target") -> Column:
    got = F.substring(F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_"), 1, most)
    return F.when(F.coalesce(got, F.lit("")) == "", empty).otherwise(got)


def entity_label(kind: Column, cls: Column, ident: Column, lane: Column) -> Column:
    """``kind #27 · blue``: the kind (else the class), the id after its last colon, the lane if any; null without both names."""
    name = F.coalesce(kind, cls)
    return F.when(name.isNotNull(), F.concat(name, F.lit(" #"), F.substring_index(ident, ":", -1), F.coalesce(F.concat(F.lit(" · "), lane), F.lit(""))))


def token_total(text: Column) -> Column:
    """Sum of the numbers in mentions such as ``1,200 tokens`` or ``12k tokens``, rounded."""
    said = F.regexp_extract_all(text, F.lit(r"(\d[\d,]*(?:\.\d+)?\s*[kK]?)\s+tokens\b"), 1)
    value = lambda m: F.regexp_replace(m, r"[^\d.]", "").cast("double") * F.when(m.rlike("[kK]$"), 1000.0).otherwise(1.0)
    return F.coalesce(F.floor(F.aggregate(said, F.lit(0.0), lambda s, m: s + value(m)) + 0.5).cast("long"), F.lit(0).cast("long"))


def tile_lod(ident: Column, lod: Column) -> Column:
    """Level of detail of a tile: its own, else the number after ``#lod`` in its id, else 0."""
    old = F.regexp_extract(ident, r"^.*#lod(\d+)$", 1)
    return F.coalesce(lod, F.when(old != "", old.cast("int")), F.lit(0))


def tile_base(ident: Column, lod_of: Column) -> Column:
    """Id of the full-resolution tile that a tile belongs to."""
    return F.coalesce(lod_of, F.regexp_replace(ident, r"#lod\d+$", ""))


def suggest(words: DataFrame, names: DataFrame) -> DataFrame:
    """(word, name): the nearest name of each word within a third of its length, 1 edit at least and 2 at most.

    Edits ignore case; of equally near names the last by ``ord`` wins. ``names`` is a catalogue: words
    are joined to it by length (two more or less), never all with all."""
    w = words.select("word", F.explode(F.sequence(F.length("word") - 2, F.length("word") + 2)).alias("n"))
    near = w.join(names.select("name", "ord", F.length("name").alias("n")), "n").withColumn("d", F.levenshtein(F.lower("word"), F.lower("name")))
    near = near.where(F.col("d") <= F.greatest(F.lit(1), F.least(F.lit(2), F.floor(F.length("word") / 3))))
    return near.groupBy("word").agg(F.min_by("name", F.struct("d", -F.col("ord"))).alias("name"))


def search_docs(docs: DataFrame, query: str) -> DataFrame:
    """Documents that match all terms, with their score, best first: a term counts most in the name.

    ``docs`` has id, name, category, summary, signature. Without terms all documents come, score 0."""
    terms = query.lower().split()
    low = {c: F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("id", "name", "category", "summary", "signature")}
    scores = []
    for t in terms:
        s = F.when(low["name"] == t, 100).when(low["id"] == t, 90).when(low["name"].startswith(t), 60).when(low["name"].contains(t), 40).when(low["id"].contains(t), 30)
        scores.append(s.when(low["category"].contains(t), 15).when(low["summary"].contains(t), 10).when(low["signature"].contains(t), 5).otherwise(0))
    scored = docs.withColumn("score", sum(scores, F.lit(0)))
    for s in scores:
        scored = scored.where(s > 0)
    return scored.orderBy(F.desc("score"), "id")
