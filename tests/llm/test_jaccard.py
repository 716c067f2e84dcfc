import random
import re

import numpy as np
import pytest

from cairnfield.llm import jaccard
from cairnfield.llm.jaccard import near_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k=5):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[a + 1 :]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def corpus(seed, n=160):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["É", "ñandú", "THE", "the"]
    passage = [r.choice(vocab) for _ in range(60)]
    base = [[r.choice(vocab) for _ in range(r.choice([3, 6, 9, 14, 40, 120, 300]))] for _ in range(n // 4)]
    rows = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            w[r.randrange(len(w))] = r.choice(vocab)
        if r.random() < 0.3:
            w = passage + w
        if r.random() < 0.2:
            w = w[: -r.randrange(1, 4)] or w
        rows.append((i * 3 + 1, r.choice([" ", "\n", "\t \x0b"]).join(w)))
    return [*rows, (100_001, ""), (100_002, None), (100_003, " \n"), (100_004, "one"), (100_005, "ONE"), (100_006, "a b c d"), (100_007, "A b  c d"), (100_008, "x" * 200_000)]


@pytest.mark.parametrize("seed, boundary", [(1, None), (2, 0), (2, 11), (1, 60), (2, 10**6)])
def test_components_equal_brute_force(spark, seed, boundary):
    """By inverted lists alone (0), by subsets alone (over all sizes) and by both."""
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_components(docs, boundary=boundary).collect()}
    assert got == brute(rows)


def test_boundary_by_cost(spark):
    """Small sets with long lists are worth subsets; sets with short lists are not."""
    row = lambda n, p, df: (n, p, list(range(p + 1)), [df] * (p + 1))
    schema = "n long, p int, h array<long>, df array<long>"
    small, large = [row(6, 2, 500)] * 400, [row(200, 51, 2)] * 100
    assert 6 <= jaccard.light_boundary(spark.createDataFrame(small + large, schema)) < 200
    assert jaccard.light_boundary(spark.createDataFrame(large, schema)) == 0
    assert jaccard.light_boundary(spark.createDataFrame([], schema)) == 0


def test_null_ids_repeats_and_extra_columns(spark):
    t = "a b c d e f g h"
    docs = spark.createDataFrame([(None, t, 1), (5, t, 2), (5, t, 3), (9, t + " i", 4)], "doc_id long, text string, rep int").withColumnRenamed("rep", "label")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in near_components(docs).collect())
    assert got == [(0, 0), (5, 5), (5, 5), (9, 5)]


def test_empty_table(spark):
    assert near_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("most", [0, 1 << 22])
def test_holders_keep_every_wanted_row(spark, monkeypatch, most):
    monkeypatch.setattr(jaccard, "MAP_IDS", most)
    docs = spark.range(-500, 500).selectExpr("id AS doc_id", "string(id) AS text").union(spark.sql("SELECT CAST(NULL AS BIGINT), 'x'"))
    wanted = docs.where("doc_id % 7 = 0").select("doc_id")
    got = {r.doc_id for r in jaccard.holders(docs, wanted).collect()}
    assert {i for i in range(-500, 500) if i % 7 == 0} <= got
    assert len(got) <= 144 if most else len(got) == 143
    assert jaccard.holders(docs, wanted.limit(0)).count() == 0


def test_sketches_rule_out_no_link():
    """The least difference that sketches tell is never above the real one, whatever the signs of their words."""
    from cairnfield.llm.textkit import mix

    rng = np.random.default_rng(9)
    for _ in range(300):
        both = rng.integers(0, 2**63, rng.integers(1, 200), dtype=np.uint64)
        own = [rng.integers(0, 2**63, rng.integers(0, 60), dtype=np.uint64) for _ in range(2)]
        rows = []
        for more in own:
            bit = (mix(np.concatenate([both, more])) % np.uint64(64 * jaccard.WORDS)).astype(np.int64)
            odd = np.bincount(bit, minlength=64 * jaccard.WORDS) & 1
            rows.append(np.array([0, len(both) + len(more), 0, 0, 0, *np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)], np.int64)[:, None])
        fits, differ = jaccard._may_link(*rows, 75)
        assert differ[0] <= len(own[0]) + len(own[1])
        if len(both) * 100 >= 75 * (len(both) + len(own[0]) + len(own[1])):
            assert fits[0]
