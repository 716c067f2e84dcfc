import hashlib
import re
from collections import defaultdict

from cairnfield.llm.exact import drop_copies, exact_groups, merged
from cairnfield.llm.mixing import emit, mix, source_targets

ROWS = [(7, "a b", "s"), (3, "ab", "s"), (4, " a\tb\n", None), (9, None, "z"), (2, "", "z"), (1, " ab", "s"), (5, "x " * 50_000, "é"), (6, "ab", "s"), (6, "ab", "s")]


def test_exact_groups_equal_brute_force(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, keep_id string")
    groups = defaultdict(list)
    for i, t, _ in ROWS:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    want = sorted((i, min(g)[1], len(g), i == min(g)[1], hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g)
    for runs, fan in ((64, 8), (7, 2), (1, 2)):
        got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_groups(docs, runs=runs, fan_in=fan).collect())
        assert got == want
    kept = drop_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 5]


def test_exact_empty_and_null_id(spark):
    assert exact_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = exact_groups(spark.createDataFrame([(None, "q"), (3, "q")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in got} == {(None, 3, False), (3, 3, True)}


def fill(sizes, weights, cap=3.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in stopped)
        open_w = sum(w[s] for s in names if s not in stopped)
        t = {s: cap * sizes[s] if s in stopped else left * w[s] / open_w for s in names}
        over = {s for s in names if s not in stopped and t[s] > cap * sizes[s] * (1 + 1e-12)}
        if not over:
            return t
        stopped |= over


def test_targets_and_copies(spark):
    sizes = {"a": 10, "b": 500, "c": 1, "d": 40, None: 7, "é": 3, "Z": 90}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    want = fill(sizes, (1, 2, 3))
    assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes)
    docs = spark.createDataFrame([(i, "w " * (i % 7), "ab"[i % 3 == 0]) for i in range(3000)] + [(None, None, None)], "doc_id long, text string, source string")
    rows = mix(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, mix(docs.repartition(5)).collect()))
    assert all(r.taken <= 3 * r.size for r in rows)
    for s in "ab":
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) < 0.1 * own[0].target
    assert emit(docs).count() == sum(r.copies for r in rows)
    assert mix(docs.limit(0)).count() == 0


def test_exact_extreme_ids_and_many_runs(spark):
    low, high = -(2**63), 2**63 - 1
    rows = [(low, "a"), (high, "a"), (0, "a"), (low, "b"), (None, "c"), (high, "d "), (low, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for runs in (None, 3, 64):
        got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_groups(docs, runs=runs).collect()}
        assert got == {(low, low, 3, True), (high, low, 3, False), (0, low, 3, False), (low, low, 1, True), (None, None, 1, True), (high, high, 2, True), (low, high, 2, False)}


def test_exact_rounds_exchange_sorted_runs(spark):
    """A round is one exchange by piece and run, sorted by digest, and a merge of the sorted rows, all built in."""
    level = spark.sql("SELECT unhex(md5(string(id))) AS digest, int(id % 3) AS n_norm, unhex(md5(string(-id))) AS check, id % 4 AS run0, named_struct('n_points', 1, 'has', true, 'neg', id) AS best, 1L AS members FROM range(100)")
    plan = merged(level, 1, 2, 3, 8)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange ", plan)) == 1 and re.search(r"Exchange hashpartitioning\(piece#\d+L?, run1#\d+L?, 8\), REPARTITION_BY_NUM", plan)
    assert plan.count("SortAggregate") == 2 and len(re.findall(r"\bSort \[", plan)) == 1
    assert not re.search("Python|Arrow|Pandas", plan)
