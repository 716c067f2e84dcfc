"""Centroid clustering of distinct quantised vectors with integer weights."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import materialize, release

#: Components are held within this many units of 0, so that a squared distance of 64 of them fits a long.
LIMIT = 1 << 27
#: Sums are kept as high and low parts of this many bits, which no total of weights below 2^47 overflows.
_LOW = 14


def quantised(vectors: DataFrame, id_col: str, vector_col: str, components: int, scale: int) -> DataFrame:
    """(vec_id, q): vectors of exactly ``components`` finite components, each as the integer floor(scale * x)."""
    v = F.col(vector_col)
    usable = (F.size(v) == components) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    at = lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-float(LIMIT))), F.lit(float(LIMIT)))).cast("int")
    return vectors.where(v.isNotNull()).where(F.coalesce(usable, F.lit(False))).select(F.col(id_col).alias("vec_id"), F.transform(v, at).alias("q"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row (the smaller of ties) and the squared distance."""
    d = np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    best = d.argmin(axis=1)
    return best, d[np.arange(len(x)), best]


def _sums(distinct: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Weight and componentwise sum of each cluster's vectors. A task sends one row a cluster."""
    k, m = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]):
        total = np.zeros((k, 2 * m + 1), np.int64)
        for b in batches:
            if b.num_rows:
                x, w = _matrix(b.column(0)), b.column(1).to_numpy()
                best, _ = nearest(x, centroids)
                parts = np.concatenate([x >> _LOW, x & ((1 << _LOW) - 1), np.ones((len(x), 1), np.int64)], axis=1) * w[:, None]
                for c in range(k):
                    total[c] += parts[best == c].sum(axis=0)
        used = np.flatnonzero(total[:, -1])
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(list(total[used]), pa.list_(pa.int64()))], ["cluster", "sums"])

    sent = distinct.select("q", "weight").mapInArrow(add, "cluster long, sums array<long>")
    rows = sent.select("cluster", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i").agg(F.sum("s").alias("s")).collect()  # k * (2m + 1) rows at most
    got: dict[int, dict[int, int]] = {}
    for r in rows:
        got.setdefault(r.cluster, {})[r.i] = r.s
    return {c: (s[2 * m], [(s[i] << _LOW) + s[m + i] for i in range(m)]) for c, s in got.items()}


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 64, scale: int = 1024, k: int = 8, rounds: int = 10, seed: str = "3") -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid (array of int).

    Vectors with exactly ``components`` components, none null or not finite, are kept, and each component
    becomes floor(scale * x). Equal vectors are grouped once with their number; Lloyd's rounds read only the
    distinct ones, with exact integer sums weighted by these numbers, and the assignments are joined back by
    the vector. Centroids begin as the ``k`` vectors of smallest sha256("seed:vec_id") (ties, as of repeated ids, by the
    vector). Each round takes the nearest centroid (ties: the smaller number), then the floor of the mean; a
    centroid without vectors stays. Distances are squared.

    The driver holds ``k`` centroids and nothing else. The distinct vectors are written in the shared folder, so a lost
    executor costs a task of one round. A vector with very many copies is summed before the shuffle, and a join with a hot vector
    is split by adaptive execution. Nulls: vectors that are null or hold a null are left out; a null id is hashed as
    '' and kept. Repeated rows count and come back each. With fewer than ``k`` vectors each begins a cluster; empty tables give no rows. Components
    beyond 2^27 units are held at that bound. Other columns are not read.
    """
    rows = quantised(vectors, id_col, vector_col, components, scale)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = [r.q for r in rows.select(key.alias("key"), "q").orderBy("key", "q").limit(k).collect()]
    if not first:
        schema = "cluster int, distance long, cluster_inertia long, inertia long, centroid array<int>"
        return rows.select("vec_id", *[F.lit(None).cast(t).alias(n) for n, t in (f.split() for f in schema.split(", "))])
    distinct = materialize(rows.groupBy("q").agg(F.count("*").alias("weight")), "vectors")
    centre = np.array(first, np.int64)
    for _ in range(rounds):
        for c, (weight, total) in _sums(distinct, centre).items():
            centre[c] = [s // weight for s in total]

    def assign(batches):
        for b in batches:
            best, d = nearest(_matrix(b.column(0)), centre) if b.num_rows else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(best.astype(np.int32)), pa.array(d)], ["q", "weight", "cluster", "distance"])

    placed = materialize(distinct.mapInArrow(assign, "q array<int>, weight long, cluster int, distance long"), "assigned")
    release(distinct)
    sums = {r.cluster: int(r.s) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)") * F.col("weight")).alias("s")).collect()}  # k rows
    about = [(c, centre[c].tolist(), s, sum(sums.values())) for c, s in sorted(sums.items())]
    about = vectors.sparkSession.createDataFrame(about, "cluster int, centroid array<int>, cluster_inertia long, inertia long")
    back = rows.join(placed.select("q", "cluster", "distance"), "q").join(F.broadcast(about), "cluster")  # k rows
    return back.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
