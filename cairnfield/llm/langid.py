"""Language identification with error-correcting output codes."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chargrams import fit_logistic, gram_ids
from .textkit import crc_mod, pieces

ORDERS = (1, 2, 3)
BITS = 12
_LETTER = re.compile(r"[^\W\d_]")


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """A k x L matrix of +-1. Up to 7 languages: all 2^(k-1) - 1 splits. Beyond: of 200 random codes of
    ceil(10 log2 k) bits the one whose closest words are farthest apart."""
    if k < 2:
        return np.ones((k, 1), np.int8)
    if k <= 7:
        splits = np.arange(1, 2 ** (k - 1))
        rest = (splits[None] >> np.arange(k - 1)[:, None]) & 1
        return np.vstack([np.zeros((1, len(splits)), np.int64), rest]).astype(np.int8) * 2 - 1
    r, size, best, far = np.random.default_rng(seed), int(np.ceil(10 * np.log2(k))), None, -1
    for _ in range(200):
        c = r.integers(0, 2, (k, size)).astype(np.int8) * 2 - 1
        gap = ((size - c.astype(np.int64) @ c.T.astype(np.int64)) // 2 + np.eye(k, dtype=np.int64) * size).min()
        if gap > far and (np.abs(c.sum(axis=0)) < k).all():
            best, far = c, gap
    return best


def vector(text: str) -> np.ndarray:
    """Damped n-gram counts of the whole text, of unit length."""
    x = np.zeros(1 << BITS, np.float32)
    for g in gram_ids(text, ORDERS, BITS):
        x += np.bincount(g, minlength=1 << BITS)
    x = np.sqrt(x)
    return x / max(float(np.linalg.norm(x)), 1e-9)


@dataclass(frozen=True)
class Model:
    langs: list[str]
    code: np.ndarray
    w: np.ndarray
    b: np.ndarray
    bit_weight: np.ndarray  #: of each bit's loss, by how well its classifier fits

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest codeword by weighted logistic loss: (language index, score, ambiguous)."""
        f = np.clip(x @ self.w + self.b, -30, 30)
        loss = np.stack([(np.log1p(np.exp(-f * c)) * self.bit_weight).sum(axis=1) for c in self.code.astype(np.float32)], 1)
        p = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        p /= p.sum(axis=1, keepdims=True)
        top = p.argmax(axis=1)
        first = np.sort(p, axis=1)
        margin = first[:, -1] - (first[:, -2] if p.shape[1] > 1 else 0)
        return top, p.max(axis=1), margin < 0.2


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fold: int = 4, held: int = 2, most: int = 4000) -> Model:
    """Fit on a bounded sample: in all about ``most`` documents, as many of each language, by a hash of the id.

    Every bit of the codewords is learnt by one logistic regression on hashed n-gram vectors.
    Held-out rows, null ids and null languages are not used; without any there are no languages. An id
    with several languages counts for the first by code point; its repeated rows all count. Null and empty
    texts are vectors of zeros. Other columns are not read.
    """
    known = docs.where(crc_mod(id_col, fold) != held).where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(lang_col).alias("lang"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((0, 1), np.int8), np.zeros((1 << BITS, 1), np.float32), np.zeros(1, np.float32), np.ones(1))
    each = max(1, most // len(langs))
    # a threshold from the counts first leaves about 4 * each rows a language to rank
    share = docs.sparkSession.createDataFrame([(v, min(1.0, 4 * each / n)) for v, n in sizes.items()], "__lang string, __share double")
    place = F.xxhash64("i")
    likely = known.where("i is not null").join(F.broadcast(share), F.col("lang") == F.col("__lang")).where(F.shiftrightunsigned(place, 33) < F.col("__share") * float(1 << 31))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned(place, 33), "i"))
    sample = likely.withColumn("__rank", rank).where(F.col("__rank") <= each).groupBy(F.col("i").alias("__id")).agg(F.min("lang").alias("__lang"))
    # at most ``most`` rows (or one a language): a proven bound for the broadcast
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("__id"))

    def features(batches):
        for b in pieces(batches, "text"):
            x = [vector(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.astype(np.float16).tobytes() for v in x], pa.binary())], ["lang", "x"])

    t = rows.select("__lang", "text").mapInArrow(features, "lang string, x binary").toArrow()
    raw = t.column("x").to_pylist()
    x = np.stack([np.frombuffer(v, np.float16) for v in raw]).astype(np.float32) if raw else np.zeros((0, 1 << BITS), np.float32)
    y = np.array([langs.index(v) for v in t.column("lang").to_pylist()], np.int64)
    code = codewords(len(langs))
    order = np.lexsort((x[:, 7], x[:, 3], y)) if len(y) else []
    x, y = x[order], y[order]
    if len(langs) < 2 or not len(y):
        return Model(langs, code, np.zeros((1 << BITS, code.shape[1]), np.float32), np.ones(code.shape[1], np.float32), np.ones(code.shape[1]))
    bits = (code[y] > 0).astype(np.float32)
    size = np.bincount(y, minlength=len(langs))
    w, b = fit_logistic(x, bits, np.repeat(1.0 / size[y][:, None], bits.shape[1], 1), l2=1e-6, steps=120, rate=0.3)
    right = ((x @ w + b > 0) == (bits > 0)).mean(axis=0)
    return Model(langs, code, w, b, np.maximum(2 * right - 1, 0.01))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", fold: int = 4, held: int = 2) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, ambiguous. Only the text is an input.

    Texts without a letter (null and empty ones too) are ``und`` with score 0; so are all where no
    language was learnt. Null ids and repeated rows are predicted like any other; empty tables give no rows. Whole texts are read where they lie, without a shuffle.
    """
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), (crc_mod(id_col, fold) == held).alias("held_out"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in pieces(batches, "text"):
            for k in range(0, b.num_rows, 1000):
                c = b.slice(k, 1000)
                texts = c.column(2).to_pylist()
                ok = np.array([bool(m.langs) and bool(_LETTER.search(t or "")) for t in texts])
                lang, score, unsure = np.full(len(texts), "und", object), np.zeros(len(texts)), np.ones(len(texts), bool)
                if ok.any():
                    top, p, a = m.decode(np.stack([vector(t) for t, o in zip(texts, ok, strict=True) if o]))
                    lang[ok], score[ok], unsure[ok] = np.array(m.langs, object)[top], p, a
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return thin.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
