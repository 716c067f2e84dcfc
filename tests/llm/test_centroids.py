import hashlib
import math

import numpy as np
import pytest

from cairnfield.llm.centroids import cluster

SCHEMA = "vec_id long, embedding array<float>, label int, q int"


def brute(rows, m=64, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == m and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centre = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centre))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(centre)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if mine:
                centre[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    last = [(i, *near(v)) for i, v in kept]
    return [(i, j, d, sum(e for _, e, o in last if o == j), sum(e for _, e, _ in last), centre[j]) for i, d, j in last]


def check(spark, rows, **how):
    docs = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], SCHEMA)
    got = [tuple(r) for r in cluster(docs, **how).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows, **({"m": how["components"]} if how else {})), key=repr)


def test_equal_to_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 64))
    rows = [(i, (centres[i % 5] + rng.normal(size=64) * 0.4).tolist()) for i in range(160)]
    rows += [(1000 + i, rows[3][1]) for i in range(80)] + [(7, rows[9][1]), (7, rows[9][1]), (7, rows[10][1]), (None, rows[11][1]), (None, rows[12][1])]
    bad = [None, [], [0.5] * 63, [0.5] * 65, [0.5] * 63 + [None], [float("nan")] + [0.0] * 63, [0.0] * 63 + [float("-inf")]]
    check(spark, rows + [(2000 + i, v) for i, v in enumerate(bad)])


@pytest.mark.parametrize("n", [0, 1, 5, 8])
def test_few_vectors_ties_and_copies(spark, n):
    check(spark, [(i, [float(i % 3), -0.0005]) for i in range(n)], components=2)


def test_large_components_keep_exact(spark):
    check(spark, [(i, [float((-1) ** i * (131071 - i)), i * 100.0]) for i in range(20)], components=2)
    got = cluster(spark.createDataFrame([(1, [3e38, -3e38], 1, 2)], SCHEMA), components=2).collect()
    assert got[0].centroid == [1 << 27, -(1 << 27)] and got[0].distance == 0
