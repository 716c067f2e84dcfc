"""Benchmark decontamination by q-gram lemma filtering and banded alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import ROW, pieces, with_row_keys, without_rows

Q = 8
#: Edits allowed per character of a benchmark item.
EDITS = 0.08
#: Characters of benchmark text that one pass over the documents holds as an index.
BLOCK = 2_000_000
_FILTER_BITS = 22
_P = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> np.ndarray:
    """Code points of the text in lower case, white space runs as one space, none at the ends."""
    return np.frombuffer(" ".join((text or "").lower().split()).encode("utf-32-le", "surrogatepass"), np.uint32)


def qgrams(c: np.ndarray) -> np.ndarray:
    if len(c) < Q:
        return np.zeros(0, np.uint64)
    m = len(c) - Q + 1
    h = np.zeros(m, np.uint64)
    for k in range(Q):
        h = (h + c[k : k + m]) * _P
        h ^= h >> np.uint64(31)
    return h


def budget(m: int) -> int:
    """Edits allowed in an item of m characters: EDITS of them, as far as the q-gram lemma still filters."""
    return max(0, min(int(EDITS * m), (m - Q) // Q))


def banded_distance(item: np.ndarray, text: np.ndarray, lo: int, hi: int, most: int) -> int:
    """Least edits that turn the item into a substring of ``text``, within diagonals lo..hi; most + 1 if more.

    Row i holds, for each diagonal d, the distance of item[:i] to a substring ending at i + d."""
    d = np.arange(lo, hi + 1)
    big = most + 1
    # item[:0] matches the empty string anywhere inside the text
    row = np.where((d >= 0) & (d <= len(text)), 0, big)
    ramp = np.arange(len(d))
    for i in range(1, len(item) + 1):
        j = i + d
        inside = (j >= 1) & (j <= len(text))
        sub = row + (text[np.clip(j - 1, 0, len(text) - 1)] != item[i - 1])
        new = np.where(inside, sub, big)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)  # a character of the item is missing
        new = np.where((j >= 0) & (j <= len(text)), new, big)
        new = np.minimum.accumulate(new - ramp) + ramp  # extra characters in the text
        row = np.minimum(new, big)
        if row.min() > most:
            return big
    return int(row.min())


@dataclass(frozen=True)
class Index:
    ids: np.ndarray
    texts: list[np.ndarray]
    grams: np.ndarray  #: sorted distinct q-gram hashes
    at: np.ndarray  #: bounds of each hash's postings
    item: np.ndarray
    pos: np.ndarray
    seen: np.ndarray  #: bitmap of the low bits of the hashes
    sizes: np.ndarray  #: characters of each item
    edits: np.ndarray  #: edit budget of each item
    short: list[int]  #: items too short for a q-gram

    @classmethod
    def build(cls, items: list[tuple[int, str]]) -> Index:
        texts = [normal(t) for _, t in items]
        hs = [qgrams(t) for t in texts]
        h = np.concatenate([*hs, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(texts)), [len(x) for x in hs])
        pos = np.concatenate([*(np.arange(len(x)) for x in hs), np.zeros(0, np.int64)])
        order = np.argsort(h, kind="stable")
        grams, first = np.unique(h[order], return_index=True)
        seen = np.zeros(1 << _FILTER_BITS, bool)
        seen[grams & np.uint64((1 << _FILTER_BITS) - 1)] = True
        sizes = np.array([len(t) for t in texts], np.int64)
        edits = np.array([budget(int(m)) for m in sizes], np.int64)
        short = [k for k, m in enumerate(sizes) if 0 < m < Q]
        return cls(np.array([i for i, _ in items], np.int64), texts, grams, np.append(first, len(h)), item[order], pos[order], seen, sizes, edits, short)

    def search(self, text: str | None) -> list[tuple[int, int]]:
        """(item id, edits) of every item that the whole text holds within its edit budget."""
        c = normal(text)
        found: dict[int, int] = {}
        for k in self.short:  # exact
            t = self.texts[k]
            if len(c) >= len(t) and (np.lib.stride_tricks.sliding_window_view(c, len(t)) == t).all(axis=1).any():
                found[k] = 0
        h = qgrams(c)
        p = np.flatnonzero(self.seen[h & np.uint64((1 << _FILTER_BITS) - 1)])
        if len(p) and len(self.grams):
            g = np.minimum(np.searchsorted(self.grams, h[p]), len(self.grams) - 1)
            ok = self.grams[g] == h[p]
            p, g = p[ok], g[ok]
            n = self.at[g + 1] - self.at[g]
            post = np.repeat(self.at[g] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(p) else np.zeros(0, np.int64)
            item, diag = self.item[post], np.repeat(p, n) - self.pos[post]
            for k, lo, hi in self._regions(item, diag):
                e = int(self.edits[k])
                if found.get(k, e + 1) > 0:
                    a = max(0, lo - e)
                    part = c[a : hi + len(self.texts[k]) + e + 1]
                    d = banded_distance(self.texts[k], part, lo - e - a, hi + e - a, e)
                    if d <= e:
                        found[k] = min(d, found.get(k, d))
        return sorted((int(self.ids[k]), d) for k, d in found.items())

    def _regions(self, item: np.ndarray, diag: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Bands of diagonals with as many shared q-grams as the lemma asks: m - q + 1 - q e.

        Bands are 2 (e + 1) diagonals wide and overlap by half, so every alignment lies in one."""
        if not len(item):
            return
        need = self.sizes - Q + 1 - Q * self.edits
        band = diag // (self.edits[item] + 1)
        key = item.astype(np.int64) << 40
        key = key + band + (1 << 39)
        u, n = np.unique(key, return_counts=True)
        after = np.searchsorted(u, u + 1)
        follow = np.where((after < len(u)) & (u[np.minimum(after, len(u) - 1)] == u + 1), n[np.minimum(after, len(u) - 1)], 0)
        before = np.searchsorted(u, u - 1)
        lead = np.where((before < len(u)) & (u[np.minimum(before, len(u) - 1)] == u - 1), n[np.minimum(before, len(u) - 1)], 0)
        k = u >> 40
        b = (u & ((1 << 40) - 1)) - (1 << 39)
        for i in np.flatnonzero((n + follow >= need[k]) | (n + lead >= need[k])):
            w = self.edits[k[i]] + 1
            if n[i] + follow[i] >= need[k[i]]:
                yield int(k[i]), int(b[i] * w), int((b[i] + 2) * w - 1)
            elif lead[i] == 0:
                yield int(k[i]), int((b[i] - 1) * w), int((b[i] + 1) * w - 1)


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in blocks of at most BLOCK characters (one item at least)."""
    block, size = [], 0
    for r in benchmark.where("item_id is not null and text is not null").select("item_id", "text").toLocalIterator():
        if block and size + len(r["text"]) > BLOCK:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, edits) for each document that holds an item within its edit budget.

    The documents are never shuffled: each pass reads them in place against one block of the
    benchmark, which is an index of at most BLOCK characters (a proven bound for the broadcast).
    """
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for block in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            index = Index.build(shared.value)
            for b in pieces(batches, "text"):
                rows = [(i, k, e) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k, e in index.search(t)]
                if rows:
                    i, k, e = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(k, pa.int64()), pa.array(e, pa.int32())], ["doc_id", "item_id", "edits"])

        part = thin.mapInArrow(run, "doc_id long, item_id long, edits int")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], "doc_id long, item_id long, edits int")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, contaminated, item_ids, least_edits.

    An item leaks into a document if some substring of the document is within ``budget`` edits of
    it, both in lower case with white space collapsed. Null texts and items hold nothing; empty
    items match nothing; items shorter than Q characters match exactly. Rows with a null id are
    searched but not marked; repeated rows with one id share their items. Other columns are not read.
    """
    got = leaks(docs, benchmark, id_col, text_col).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.min("edits").alias("least_edits"))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    return ids.join(got, "doc_id", "left").select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), "least_edits")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows without leaks, with all columns; decided row by row, whatever the id (null and repeated ids too)."""
    keyed = with_row_keys(docs)
    gone = leaks(keyed, benchmark, ROW, text_col).select(F.col("doc_id").alias(ROW)).distinct()
    return without_rows(keyed, gone)
