"""Exact de-duplication by a tree merge of digest runs (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import ROW, SPACES, materialize, release, with_row_keys, without_rows

_KEY = ("digest", "n_norm", "check")
#: Rows for which there is one run.
PER_RUN = 1 << 22


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, "")


def digest_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    norm = normalised(F.col(text_col))
    thin = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n_points"))
    return thin.select(
        "doc_id", "n_points", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("digest"),
        F.length("norm").alias("n_norm"), F.unhex(F.sha2(F.concat(F.lit("check:"), "norm").cast("binary"), 256)).alias("check"),
    )


def merged(level: DataFrame, depth: int, fan_in: int, pieces: int, tasks: int) -> DataFrame:
    """The runs of round ``depth``: those of the round before meet, sorted by digest, and are merged in one pass."""
    run, piece = f"run{depth}", F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long") % pieces
    met = level.withColumns({run: F.floor(F.col(f"run{depth - 1}") / fan_in), "piece": piece})
    met = met.repartition(tasks, "piece", run).sortWithinPartitions("piece", run, *_KEY)
    return met.groupBy("piece", run, *_KEY).agg(F.max("best").alias("best"), F.sum("members").alias("members")).drop("piece")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int | None = None, fan_in: int = 2) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Each document belongs to one of ``runs`` runs by a hash of its id. A run holds one row per digest: the best
    keeper (most code points, then smallest id) and a count. In round k of a binomial tree, run r with bit k set
    goes to run r - 2^k (``fan_in`` runs at a time with a larger radix): the runs of a pair meet in the same
    partitions, sorted by digest, and one pass over the sorted rows merges them. A run is cut by the first bits of its digests
    into as many pieces as keep the number of partitions the same in every round, so that the last run isn't
    one task's. Every merge retains the smallest identifier of equal digests, *verified* by the length and a second
    SHA-256 of the text after a prefix. Keepers of digests that several documents have then travel down the tree
    again, one row per digest and run, so no join key has more than a run's share of a group of copies; there is a
    run for every ``PER_RUN`` rows (16 at least).

    Nulls: a null text is empty, and all empty texts form one group. A null id sorts after all
    others. Repeated rows with one id: all count in group_size and share keep_id; of exact
    repeats, kept is true for each. Empty tables give no rows; other columns are not read.
    """
    leaf = materialize(digest_rows(docs, id_col, text_col), "digests")
    if runs is None:
        runs = 16
        while runs * PER_RUN < leaf.count():
            runs *= 2
    if runs < 1 or fan_in < 2:
        raise ValueError("runs >= 1 and fan_in >= 2 are needed")
    leaf = leaf.withColumn("run0", F.pmod(F.xxhash64("doc_id"), F.lit(runs)))
    # ~id falls as the id rises, as -id does, but has a value for the least long, too
    best = F.max(F.struct("n_points", F.col("doc_id").isNotNull().alias("has"), F.bitwise_not(F.col("doc_id").cast("long")).alias("neg")))
    first = leaf.groupBy(*_KEY, "run0").agg(best.alias("best"), F.count("*").alias("members"))
    levels, left = [materialize(first, "run0")], runs
    tasks = max(runs, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    while left > 1:
        left, depth = -(-left // fan_in), len(levels)
        levels.append(materialize(merged(levels[-1], depth, fan_in, max(1, tasks // left), tasks), f"run{depth}"))
    down = levels[-1].where("members > 1")
    for k in range(len(levels) - 2, -1, -1):
        below = levels[k].select(*_KEY, f"run{k}", F.floor(F.col(f"run{k}") / fan_in).alias(f"run{k + 1}"))
        down = below.join(down, [*_KEY, f"run{k + 1}"]).select(*_KEY, f"run{k}", "best", "members")
    down = materialize(down, "keepers")
    release(*levels)
    several = F.col("members").isNotNull()
    keep = F.when(several, F.bitwise_not(F.col("best.neg"))).otherwise(F.col("doc_id"))
    return leaf.join(down, [*_KEY, "run0"], "left").select(
        "doc_id", keep.alias("keep_id"), F.coalesce("members", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns, whatever their names: one row of each text.

    It is the one with most code points, then the smallest id (null last); of repeated rows one stays.
    """
    keyed = with_row_keys(docs, F.col(id_col).asc_nulls_last(), F.xxhash64(text_col))
    gone = exact_groups(keyed, ROW, text_col).where("not kept").select(F.col("doc_id").alias(ROW))
    return without_rows(keyed, gone)
