"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chargrams import fit_logistic, gram_ids
from .textkit import crc_mod, pieces

ORDERS = (3, 4, 5)
BITS = 18


@dataclass(frozen=True)
class Model:
    slot: np.ndarray  #: per hashed n-gram, 1 + its place among the chosen ones, or 0
    weight: np.ndarray  #: of each chosen n-gram, log-count ratio included; [0] is unused
    bias: float

    def score(self, text: str | None) -> float:
        found = self.found(text)
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weight[found].sum(), -30, 30))))

    def found(self, text: str | None) -> np.ndarray:
        """Chosen n-grams that the whole text has, each once."""
        hits = [s[s > 0] for s in (self.slot[g] for g in gram_ids(text or "", ORDERS, BITS))]
        return np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int64)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 4, held: int = 2, most: int = 4000, chosen: int = 1024) -> Model:
    """Fit on a bounded sample of labelled rows: ``most`` of each label, the first by a hash of the id.

    N-gram presence is counted per label on the cluster (at most 2**BITS sums reach the driver);
    the ``chosen`` n-grams whose rates differ most, in standard errors, are features. A feature is
    worth its log-count ratio r = log((p+1)/(P+2) / (q+1)/(Q+2)); a logistic regression weighs them.
    Sample weights restore the labels' share among all labelled rows. Rows of the held-out fold,
    null ids and null labels are not used; of several labels for one id the largest counts; without
    rows of both labels the score is the constant share of label 1 (about 0 without any).
    """
    labelled = labels.where(crc_mod("doc_id", fold) != held).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("__toxic"))
    share = {r["__toxic"]: r["n"] for r in labelled.groupBy("__toxic").agg(F.count("*").alias("n")).collect()}
    if not share.get(0) or not share.get(1):
        rate = float(share.get(1, 0) > 0)
        return Model(np.zeros(1 << BITS, np.uint16), np.zeros(1, np.float32), float(np.log((rate + 1e-3) / (1 - rate + 1e-3))))
    by_hash = lambda v: labelled.where(F.col("__toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sample = by_hash(0).unionByName(by_hash(1)).withColumnRenamed("doc_id", "__id")
    # at most 2 * most rows: a proven bound for the broadcast
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("__id")).select("__toxic", "text")

    def presence(batches):
        acc = np.zeros((2, 1 << BITS), np.int64)
        n = np.zeros(2, np.int64)
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                acc[y, np.unique(np.concatenate(gram_ids(t or "", ORDERS, BITS) or [np.zeros(0, np.int64)]).astype(np.int64))] += 1
                n[y] += 1
        f = np.flatnonzero(acc.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(f, -1)), pa.array(np.append(acc[0, f], n[0])), pa.array(np.append(acc[1, f], n[1]))], ["f", "q", "p"])

    rows = rows.repartition(8)  # bounded rows; spreads the text work
    t = rows.mapInArrow(presence, "f long, q long, p long").groupBy("f").agg(F.sum("q").alias("q"), F.sum("p").alias("p")).toArrow()
    f, q, p = (t.column(c).to_numpy().astype(np.int64) for c in ("f", "q", "p"))
    at = np.argsort(f)
    f, q, p = f[at], q[at].astype(np.float64), p[at].astype(np.float64)
    (n0, n1), f, q, p = (q[0], p[0]), f[1:], q[1:], p[1:]
    r = np.log((p + 1) / (n1 + 2)) - np.log((q + 1) / (n0 + 2))
    rate = (p + q + 1) / (n0 + n1 + 2)
    z = np.abs(p / max(n1, 1) - q / max(n0, 1)) / np.sqrt(rate * (1 - rate) * (1 / max(n0, 1) + 1 / max(n1, 1)) + 1e-12)
    best = np.argsort(-z, kind="stable")[:chosen]
    slot = np.zeros(1 << BITS, np.uint16)
    slot[f[best]] = np.arange(1, len(best) + 1)
    model = Model(slot, np.zeros(len(best) + 1, np.float32), 0.0)

    def features(batches):
        for b in batches:
            found = [model.found(t).astype(np.int32).tolist() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32()))], ["y", "x"])

    t = rows.mapInArrow(features, "y int, x array<int>").toArrow()
    y = t.column("y").to_numpy()
    x = np.zeros((len(y), len(best)), np.float32)
    for i, v in enumerate(t.column("x").to_pylist()):
        x[i, np.array(v, np.int64) - 1] = 1.0
    order = np.lexsort((x @ np.arange(len(best), dtype=np.float32), y))  # rows come in any order; sums should not
    x, y = x[order] * r[best].astype(np.float32), y[order].astype(np.float32)
    weight = np.where(y > 0, share[1] / max(n1, 1), share[0] / max(n0, 1))
    w, b = fit_logistic(x, y[:, None], weight[:, None], l2=1e-3, steps=200, rate=0.03)
    return Model(slot, np.append(0, w[:, 0] * r[best]).astype(np.float32), float(b[0]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", fold: int = 4, held: int = 2, threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Only the text is an input.

    Whole texts are scored where they lie, without a shuffle; null texts are empty. Rows with null
    ids, repeated rows and empty tables need no care; other columns are not read.
    """
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), (crc_mod(id_col, fold) == held).alias("held_out"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS slots and the chosen weights

    def run(batches):
        m = shared.value
        for b in pieces(batches, "text"):
            s = np.array([m.score(t) for t in b.column(2).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return thin.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not rejected, with all columns; their texts are scored in place."""
    model = train(docs, labels, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def keep(batches):
        for b in pieces(batches, text_col):
            ok = [shared.value.score(t) < 0.3 for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
