"""Mixing sources to target weights (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textkit import WORD

#: Source weights by rank of the source name, repeating.
WEIGHTS = (1, 2, 3)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = 3.0) -> DataFrame:
    """Per source: source, source_size, target, rate.

    The table has one row per source, already summed. Sources in code-point order (null last) get
    the weights in turn. The targets share the whole size by weight; one that would exceed ``cap``
    times its source's size stops there, and the rest is shared anew. Sorted by cap/weight, the
    stopped sources are a prefix: the first source that is not stopped gives the final level.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(order) - 1) % len(weights)
    weighed = sums.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank + 1).cast("int")))
    limit = F.col("source_size") * F.lit(float(cap))
    by_limit = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    before = weighed.select(
        "*", limit.alias("limit"),
        (F.sum("source_size").over(whole) - F.coalesce(F.sum(limit).over(by_limit), F.lit(0.0))).alias("left_size"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(by_limit), F.lit(0.0))).alias("left_weight"),
    )
    stopped = F.col("limit") * F.col("left_weight") <= F.col("weight") * F.col("left_size")
    # with one more source stopped than need be the level only falls, so the first open one has the largest
    level = F.coalesce(F.max(F.when(~stopped, F.col("left_size") / F.col("left_weight"))).over(whole), F.lit(0.0))
    rows = before.withColumn("level", level)
    target = F.least(F.col("limit"), F.col("weight") * F.col("level"))
    target = F.when(F.col("level") > 0, target).otherwise(F.col("limit"))  # no words at all
    return rows.select(
        "source", F.col("source_size").cast("long").alias("source_size"), target.cast("double").alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", salts: int = 16) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, rate, copies, taken.

    A document is taken floor(rate) times, plus once more with probability frac(rate), decided by
    52 bits of md5(seed, id): reruns and any partitioning agree. A null text has size 0, a null
    source is a source of its own, a null id is hashed as ''. Repeated rows with one id share their
    decision. An empty table gives no rows. The rates reach the documents by a salted join, so a
    source that holds a third of all rows is dealt over ``salts`` keys.
    """
    sizes = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
    )
    rows = _with_copies(sizes, source_targets(sizes), "doc_id", "source", seed, salts)
    copies = F.col("__cairnfield_copies")
    return rows.select(
        "doc_id", "size", "source", F.col("__cairnfield_r.source_size").alias("source_size"), F.col("__cairnfield_r.target").alias("target"), F.col("__cairnfield_r.rate").alias("rate"),
        copies.alias("copies"), (copies * F.col("size")).alias("taken"),
    )


def _with_copies(docs: DataFrame, rates: DataFrame, id_col: str, source_col: str, seed: str, salts: int) -> DataFrame:
    """``docs`` with the row of its source (__cairnfield_r) and its number of copies (__cairnfield_copies)."""
    salted = rates.select(F.struct("*").alias("__cairnfield_r"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__cairnfield_r_salt"))
    salt = F.pmod(F.xxhash64(id_col), F.lit(salts)).cast("int")
    rows = docs.withColumn("__cairnfield_salt", salt).join(salted, F.col(source_col).eqNullSafe(F.col("__cairnfield_r.source")) & (F.col("__cairnfield_salt") == F.col("__cairnfield_r_salt")))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    u = F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
    rate = F.col("__cairnfield_r.rate")
    return rows.withColumn("__cairnfield_copies", (F.floor(rate) + (u < rate - F.floor(rate)).cast("int")).cast("long")).drop("__cairnfield_salt", "__cairnfield_r_salt")


def emit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", salts: int = 16) -> DataFrame:
    """The mixed corpus: each row once per copy, with ``copy_no`` from 1 and ``n_copies``.

    Decided row by row as in ``mix``: rows that share an id but not the source have their own rates. Where
    ``docs`` has a column of one of the two names, the new one gets ``_`` appended."""
    sizes = docs.select(F.col(source_col).alias("source"), F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    rows = _with_copies(docs, source_targets(sizes), id_col, source_col, seed, salts).where("__cairnfield_copies > 0")
    names = {c: next(n for n in (c + "_" * k for k in range(99)) if n not in docs.columns) for c in ("n_copies", "copy_no")}
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("__cairnfield_copies").alias(names["n_copies"]), F.explode(F.sequence(F.lit(1), F.col("__cairnfield_copies").cast("int"))).alias(names["copy_no"]))
