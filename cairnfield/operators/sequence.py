"""Ordered sequences: a DataFrame whose order is the column ``ord``.

Every operator stays lazy and distributed. Positions (zip, chunk, index-aware filters) come from
``dense_index``, which never sorts the whole relation in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnfield.plans.storage import materialize, shuffled

ORD = "ord"


#: Rows that a range of ``dense_index`` and ``running_total`` holds, about; there are MOST_RANGES at most.
RANGE_ROWS, MOST_RANGES = 1 << 20, 1 << 16
#: Rows of a block of ``pairs``, at least.
BLOCK_ROWS = 100


def _in_ranges(df: DataFrame, order: str, buckets: int | None) -> DataFrame:
    """``df`` with the number of a row's range of ``order`` (``__bucket``); the ranges' number grows with the rows.

    Approximate quantiles cut the ranges. A row finds its own in two steps, first among every so many cuts."""
    if buckets is None:
        buckets = min(max(64, df.count() // RANGE_ROWS), MOST_RANGES)
    cuts = sorted(set(df.approxQuantile(order, [i / buckets for i in range(1, buckets)], 0.25 / buckets))) if buckets > 1 else []
    if not cuts:
        return df.withColumn("__bucket", F.lit(0))
    step = max(1, int(len(cuts) ** 0.5))
    parts = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    below = lambda values: F.size(F.filter(values, lambda c: c < F.col(order)))
    coarse = F.greatest(below(F.array(*[F.lit(p[0]) for p in parts])) - 1, F.lit(0))
    fine = below(F.element_at(F.array(*[F.array(*map(F.lit, p)) for p in parts]), F.col("__part") + 1))
    return df.withColumn("__part", coarse).withColumn("__bucket", F.col("__part") * step + fine).drop("__part")


def dense_index(df: DataFrame, order: str = ORD, name: str = "idx", buckets: int | None = None) -> DataFrame:
    """Add the 0-based position in ascending ``order`` (a unique number).

    The order column is cut into ranges of about RANGE_ROWS rows by approximate quantiles. Any cuts give
    right positions, only the balance depends on them: a row's position is its rank in its range
    plus the sizes of the ranges before.
    """
    dealt = _in_ranges(df, order, buckets)
    # one row a range: one window over them, and a broadcast of a proven size
    sizes = dealt.groupBy(F.col("__bucket").alias("__b")).agg(F.count("*").alias("__n"))
    before = sizes.select("__b", (F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__bucket").orderBy(order)) - 1
    ranked = dealt.withColumn("__rank", rank).join(F.broadcast(before), F.col("__bucket") == F.col("__b"))
    return ranked.withColumn(name, (F.col("__rank") + F.col("__before")).cast("long")).drop("__bucket", "__rank", "__b", "__before")


def running_total(df: DataFrame, order: str, value: str, name: str, buckets: int | None = None) -> DataFrame:
    """Add the sum of ``value`` over the rows before in ``order``: by ranges, as in ``dense_index``."""
    dealt = _in_ranges(df, order, buckets)
    sums = dealt.groupBy(F.col("__bucket").alias("__b")).agg(F.sum(value).alias("__n"))  # one row a range
    before = sums.select("__b", (F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")).alias("__before"))
    own = F.sum(value).over(Window.partitionBy("__bucket").orderBy(order)) - F.col(value)
    out = dealt.withColumn("__own", own).join(F.broadcast(before), F.col("__bucket") == F.col("__b"))
    return out.withColumn(name, (F.col("__own") + F.col("__before")).cast("long")).drop("__bucket", "__own", "__b", "__before")


class Seq:
    """A lazy ordered sequence of rows. ``ord`` is unique and numeric; ``keys`` are pending sort keys."""

    def __init__(self, df: DataFrame, keys: tuple[Column, ...] = ()):
        if ORD not in df.columns:
            raise ValueError(f"a sequence needs the column {ORD}")
        self.df, self.keys = df, keys

    def _new(self, df: DataFrame, keys: tuple[Column, ...] = ()) -> Seq:
        return type(self)(df, keys)

    # rows ------------------------------------------------------------------------------------

    def where(self, predicate: Column | str) -> Seq:
        return self._new(self.df.where(predicate), self.keys)

    def where_index(self, predicate: Callable[[Column], Column]) -> Seq:
        """Filter by the position in the input sequence."""
        return self._new(dense_index(self.settled().df).where(predicate(F.col("idx"))).drop("idx"))

    def select(self, *columns: Column | str) -> Seq:
        return Seq(self.df.select(ORD, *columns), self.keys)

    def select_index(self, f: Callable[[Column], list[Column]]) -> Seq:
        df = dense_index(self.settled().df)
        return Seq(df.select(ORD, *f(F.col("idx"))))

    def select_many(self, items: Column, name: str = "item") -> Seq:
        """Flatten an array in order of (row, position): an item's place is its position after the items of all rows before."""
        df = self.settled().df
        sizes = df.select(F.col(ORD).alias("__row"), F.coalesce(F.array_size(items), F.lit(0)).alias("__size"))
        starts = running_total(sizes, "__row", "__size", "__start")
        got = df.join(starts.select("__row", "__start"), F.col(ORD) == F.col("__row")).select("*", F.posexplode(items).alias("__pos", name))
        return Seq(got.withColumn(ORD, F.col("__start") + F.col("__pos")).drop("__pos", "__row", "__start"))

    def concat(self, other: Seq) -> Seq:
        """This sequence, then the other one (positions after this one's largest)."""
        own, more = self.settled().df, other.settled().df
        top = own.agg((F.coalesce(F.max(ORD), F.lit(-1)) + 1).alias("__top"))
        low = more.agg(F.min(ORD).alias("__low"))
        moved = more.crossJoin(F.broadcast(top)).crossJoin(F.broadcast(low))  # one row each
        return self._new(own.unionByName(moved.withColumn(ORD, F.col(ORD) - F.col("__low") + F.col("__top")).drop("__top", "__low"), allowMissingColumns=True))

    def distinct(self, *key: Column | str) -> Seq:
        """The first row of each key, by the order. Partial aggregation first, so hot keys do no harm."""
        columns = [c for c in self.df.columns if c != ORD]
        by = [F.col(k) if isinstance(k, str) else k for k in (key or columns)]
        named = [c.alias(f"__k{i}") for i, c in enumerate(by)]
        df = self.settled().df
        first = df.select(*named, F.struct(ORD, *columns).alias("__row")).groupBy(*[f"__k{i}" for i in range(len(by))]).agg(F.min_by("__row", F.col(f"__row.{ORD}")).alias("__row"))
        return self._new(first.select("__row.*"))

    # order -----------------------------------------------------------------------------------

    def order_by(self, key: Column | str) -> Seq:
        return self._new(self.df, (_col(key).asc_nulls_last(),))

    def order_by_descending(self, key: Column | str) -> Seq:
        return self._new(self.df, (_col(key).desc_nulls_last(),))

    def then_by(self, key: Column | str) -> Seq:
        return self._new(self.df, (*self.keys, _col(key).asc_nulls_last()))

    def then_by_descending(self, key: Column | str) -> Seq:
        return self._new(self.df, (*self.keys, _col(key).desc_nulls_last()))

    def ordered(self) -> DataFrame:
        """The rows in order: pending keys, ties by ``ord`` ascending."""
        return self.df.orderBy(*self.keys, F.col(ORD).asc())

    def settled(self) -> Seq:
        """Pending sort keys made into a new ``ord``."""
        if not self.keys:
            return self
        # range partitions of the keys, each sorted by itself; a task's rows get numbers above those of all tasks before
        placed = self.df.repartitionByRange(*self.keys, F.col(ORD).asc()).sortWithinPartitions(*self.keys, F.col(ORD).asc())
        return self._new(materialize(placed.withColumn(ORD, F.monotonically_increasing_id()), "ordered"))

    def take(self, n: int) -> Seq:
        """The first ``n``; a top-k, not a full sort."""
        return self._new(self.ordered().limit(max(n, 0)), self.keys)

    def skip(self, n: int) -> Seq:
        """All but the first ``n``, by position: no task sees the whole relation."""
        if n <= 0:
            return self
        return self._new(dense_index(self.settled().df, name="__at").where(F.col("__at") >= n).drop("__at"))

    # pairs and groups ------------------------------------------------------------------------

    def zip(self, other: Seq) -> DataFrame:
        """Rows at equal positions as structs ``a`` and ``b``; stops at the shorter."""
        side = lambda s, n: dense_index(s.settled().df).select("idx", F.struct(*[c for c in s.df.columns if c != ORD]).alias(n))
        return side(self, "a").join(side(other, "b"), "idx").withColumnRenamed("idx", ORD)

    def pairs(self, columns: list[str] | None = None) -> DataFrame:
        """All pairs (a before b), as columns a_* and b_*. Quadratic by definition.

        The rows are cut into blocks by their order; each two blocks meet once, in a task of their own. The blocks' number
        follows the tasks, so a task holds two blocks at a time and all have about as many pairs to write."""
        df = self.settled().df.select(ORD, *(columns or [c for c in self.df.columns if c != ORD]))
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        blocks = max(1, min(math.isqrt(100 * n), df.count() // BLOCK_ROWS))
        dealt = _in_ranges(df, ORD, blocks).withColumn("__bucket", F.col("__bucket").cast("long"))
        own = F.col("__bucket")
        after = F.transform(F.sequence(own, F.lit(blocks - 1).cast("long")), lambda i: own * blocks + i)
        before = F.transform(F.sequence(F.lit(0).cast("long"), own), lambda i: i * blocks + own)
        side = lambda name, met: dealt.select(F.explode(met).alias("__met"), *[F.col(c).alias(f"{name}_{c}") for c in df.columns]).repartition(n, "__met")
        return side("a", after).join(shuffled(side("b", before)), "__met").where(F.col(f"a_{ORD}") < F.col(f"b_{ORD}")).drop("__met")

    def group_by(self, key: Column | str, name: str = "key") -> Seq:
        """Key and ordered items; groups in order of their first row. For a count only, use ``tally``."""
        columns = [c for c in self.df.columns if c != ORD]
        df = self.settled().df.select(_col(key).alias(name), F.struct(ORD, *[F.col(c) for c in columns]).alias("__row"))
        got = df.groupBy(name).agg(F.min(f"__row.{ORD}").alias(ORD), F.sort_array(F.collect_list("__row")).alias("items"))
        return Seq(got)

    def tally(self, key: Column | str, name: str = "key") -> Seq:
        """Key and number of rows; groups in order of their first row."""
        return Seq(self.settled().df.groupBy(_col(key).alias(name)).agg(F.min(ORD).alias(ORD), F.count("*").alias("n")))

    def chunk(self, n: int) -> Seq:
        if n < 1:
            raise ValueError("chunks hold one item at least")
        df = dense_index(self.settled().df)
        columns = [c for c in self.df.columns if c != ORD]
        got = df.groupBy(F.floor(F.col("idx") / n).alias(ORD)).agg(F.sort_array(F.collect_list(F.struct("idx", *columns))).alias("items"))
        return Seq(got)

    # scalars ---------------------------------------------------------------------------------

    def count(self, predicate: Column | None = None) -> DataFrame:
        return self.df.agg((F.count("*") if predicate is None else F.count_if(predicate)).alias("count"))

    def sum(self, c: Column | str) -> DataFrame:
        return self.df.agg(F.coalesce(F.sum(_col(c)), F.lit(0)).alias("sum"))

    def any(self, predicate: Column | None = None) -> DataFrame:
        return self.df.agg(F.coalesce(F.bool_or(F.lit(True) if predicate is None else predicate), F.lit(False)).alias("any"))

    def all(self, predicate: Column) -> DataFrame:
        return self.df.agg(F.coalesce(F.bool_and(predicate), F.lit(True)).alias("all"))

    def first(self, predicate: Column | None = None) -> DataFrame:
        return (self if predicate is None else self.where(predicate)).take(1).df

    def min(self, c: Column | str) -> DataFrame:
        """The first row with the least finite value; no row if none is finite."""
        return self._best(_col(c), 1.0)

    def max(self, c: Column | str) -> DataFrame:
        return self._best(_col(c), -1.0)

    def _best(self, c: Column, sign: float) -> DataFrame:
        v = c.cast("double")
        finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
        df = self.settled().df.where(finite)
        got = df.agg(F.min_by(F.struct(*df.columns), F.struct((v * sign).alias("v"), F.col(ORD).alias("o"))).alias("row"))
        return got.where("row is not null").select("row.*")

    def to_rows(self) -> list:
        return self.ordered().collect()


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
