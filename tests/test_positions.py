"""Positions, pages and the shared folder."""

import random

from pyspark.sql import functions as F

from cairnfield.operators.sequence import Seq, dense_index, running_total
from cairnfield.plans import storage, tables


def numbers(spark, n=500):
    order = list(range(n))
    random.Random(4).shuffle(order)
    return spark.createDataFrame([(i * 3 - 700, i) for i in order], "ord long, v long")


def test_positions_and_totals_for_any_number_of_ranges(spark):
    df = numbers(spark)
    for buckets in (None, 1, 2, 3, 50, 300):
        got = dense_index(df, buckets=buckets).collect()
        assert all(r.idx == r.v for r in got) and len(got) == 500
        sums = running_total(df, "ord", "v", "before", buckets=buckets).collect()
        assert all(r.before == r.v * (r.v - 1) // 2 for r in sums)


def test_skip_by_position_without_one_task(spark):
    s = Seq(numbers(spark)).order_by_descending("v").skip(490)
    assert [r.v for r in s.to_rows()] == list(range(9, -1, -1))
    assert [r.v for r in Seq(numbers(spark)).skip(0).take(2).to_rows()] == [0, 1] and Seq(numbers(spark)).skip(900).df.count() == 0
    plan = Seq(numbers(spark)).skip(10).df._jdf.queryExecution().executedPlan().toString()
    assert "GlobalLimit" not in plan and "CollectLimit" not in plan


def test_pages_near_and_far_are_the_same(spark, monkeypatch):
    df = numbers(spark).withColumn("name", F.concat(F.lit("n"), (F.col("v") % 7).cast("string")))
    how = dict(sort="name", descending=True, filters={"v": ">= 100"})
    near = tables.page(df, 5, 30, **how)
    monkeypatch.setattr(tables, "SHALLOW", 10)
    far = tables.page(df, 5, 30, **how)
    assert [tuple(r) for r in near.rows.collect()] == [tuple(r) for r in far.rows.collect()]
    assert (far.first, far.last, far.total, far.pages) == (121, 150, 400, 14)
    assert [r.v for r in tables.page(df, 99, 30).rows.collect()] == list(range(480, 500))


def test_a_local_session_that_names_no_folder(spark):
    kept = spark.conf.get("spark.checkpoint.dir", None)

    class Session:  # as a session without the setting, which a running one can't lose
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = spark.sparkContext  # noqa: N815

    one, two = storage.shared_dir(Session), storage.shared_dir(Session)
    assert one == two and one != kept
    df = storage.materialize(spark.range(3), "test")
    assert df.count() == 3
    storage.release(df)
