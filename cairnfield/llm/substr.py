"""Substring de-duplication with anchors: blocks of fixed length at fixed places, probed by rolling blocks."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jaccard import _runs, _sorted_by
from .textkit import SPACES, WORD, Words, as_signed, grams, lists, materialize, mix, pieces


def _least_of_runs(h: np.ndarray, w: int) -> np.ndarray:
    """For each run of ``w`` entries the position of its least value (the last of ties)."""
    if len(h) < w:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(h[::-1], w)[::-1]
    return np.arange(len(view)) + w - 1 - view.argmin(axis=1)


def _batch(names, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], list(names))


_ROW = "h long, doc_id long, d1 long, pos int, more array<int>"


class _Rows:
    """Rows (h, doc_id, d1, pos, more) of blocks or windows: one a hash and text, whatever its number of places.

    ``more`` holds the places besides the first, null if there are none: a line repeated all over a
    text is one row."""

    def __init__(self):
        self.parts: list[tuple] = [(np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 5)]

    def add(self, h: np.ndarray, doc: int, digest: int, pos: np.ndarray) -> None:
        order = np.lexsort((pos, h))
        h, pos = h[order], pos[order]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        st = np.flatnonzero(first)
        self.parts.append((h[st], np.full(len(st), doc), np.full(len(st), digest), pos[st], np.diff(np.append(st, len(h))) - 1, pos[~first]))

    def batch(self) -> pa.RecordBatch:
        h, doc, digest, pos, more, rest = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        offsets = np.concatenate([[0], np.cumsum(more)]).astype(np.int32)
        others = pa.ListArray.from_arrays(pa.array(offsets), pa.array(rest.astype(np.int32)), mask=pa.array(more == 0))
        return _batch(("h", "doc_id", "d1", "pos", "more"), as_signed(h), doc, digest, pos.astype(np.int32), others)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, d1, d2): d1 and d2 are a 128-bit digest of the word sequence. A text is told by its id and d1, so
    that an id may stand for several texts."""
    text = F.col(text_col)
    words = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES + "+", " "))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(words).alias("d1"), F.xxhash64(F.lit(1), words).alias("d2"))


def firsts(every: DataFrame, window: int) -> DataFrame:
    """(doc_id, d1, d2): of the rows of ``keyed`` with one and the same word sequence of at least ``window`` words, the
    smallest id. All words of other ids with that sequence are repeats."""
    long = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)) >= window
    return every.where("doc_id is not null").where(long).groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id"))


def repeated_windows(every: DataFrame, first: DataFrame, window: int) -> DataFrame:
    """(doc_id, d1, starts): word positions where a window begins that a smaller doc_id also has, in the
    texts of ``first`` (see ``firsts``; the others repeat one of those as a whole).

    * Blocks have half the window's words. The reference blocks are the non-overlapping ones (those at
      multiples of the block's length): every window holds one as a whole.
    * A lossless sieve first: of the blocks at any offset in a window, the one of least hash is its
      fingerprint. Equal windows have equal fingerprints, so windows whose fingerprint is found in
      one word sequence only can't repeat and aren't probed.
    * Every rolling block of the windows left probes the reference blocks: it is a hit if another document
      has it too and one of them has it as a reference block.
    * Hits are extended: a window that holds a hit and whose first and last block are shared gives a
      window hash, of which the smallest document id keeps its copy. Runs of such windows are the
      maximal repeats.

    What several documents share is told by aggregates with partial sums and joined back; a document
    sends one row a hash, however often it holds the block.
    """
    block = window // 2
    span = window - block + 1
    thin = every.where("doc_id is not null").select("doc_id", "text", "d1")

    def fingerprints(batches):
        for b in pieces(batches, "text"):
            words = Words(b.column(1), False)
            g, digest, hs, ds = grams(words.hash, block), b.column(2).to_numpy(), [], []
            for i in range(len(words)):
                lo, hi = words.bounds[i], words.bounds[i + 1] - block + 1
                if hi - lo >= span:
                    own = g[lo:hi]
                    own = np.unique(own[np.unique(_least_of_runs(own, span))])
                    hs.append(own)
                    ds.append(np.full(len(own), digest[i]))
            if hs:
                yield _batch(("h", "d1"), as_signed(np.concatenate(hs)), np.concatenate(ds))

    def in_several(batches):
        for t, st, before, cut in _runs(batches, "h"):
            h, d = t.column("h").to_numpy(), t.column("d1").to_numpy()
            size = np.diff(np.append(st, len(h)))
            many = d[st] != d[st + size - 1]
            many[0] |= before
            many[-1] |= cut
            m = np.repeat(many, size)
            m[1:] &= (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            if m.any():
                yield _batch(("d1", "h"), d[m], h[m])

    prints = _sorted_by(thin.mapInArrow(fingerprints, "h long, d1 long"), "h", "d1")
    shared = prints.mapInArrow(in_several, "d1 long, h long").groupBy("d1").agg(F.collect_set("h").alias("hs"))
    active = first.join(shared, "d1").groupBy("doc_id", "d1").agg(F.array_distinct(F.flatten(F.collect_list("hs"))).alias("hs"))

    def blocks(batches):
        """The rolling blocks of windows of shared fingerprints: hash, document, word position."""
        for b in pieces((b.filter(b.column(3).is_valid()) for b in batches), "text"):
            words, ids, digest, hs = Words(b.column(1), False), b.column(0).to_numpy(), b.column(2).to_numpy(), b.column(3)
            g = grams(words.hash, block)
            rows = _Rows()
            for i in range(len(words)):
                lo, hi = words.bounds[i], max(words.bounds[i], words.bounds[i + 1] - block + 1)
                own = g[lo:hi]
                least = _least_of_runs(own, span)
                at = np.unique(least)
                ok = np.zeros(len(own), bool)
                ok[at] = np.isin(own[at], hs[i].values.to_numpy().view(np.uint64))
                start = np.flatnonzero(ok[least])
                inside = np.zeros(len(own) + 1, np.int64)
                np.add.at(inside, start, 1)
                np.add.at(inside, start + span, -1)
                pos = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
                rows.add(own[pos], ids[i], digest[i], pos)
            yield rows.batch()

    # a left join (texts without fingerprints go in blocks), so that the last join reuses this shuffle of texts
    rolling = every.join(active, ["doc_id", "d1"], "left").select("doc_id", "text", "d1", "hs").mapInArrow(blocks, _ROW)
    aligned = F.col("pos") % block == 0
    rolling = rolling.withColumn("anchor", F.when(F.col("more").isNull(), aligned).otherwise(aligned | F.exists("more", lambda p: p % block == 0)))
    index = rolling.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.max("anchor").alias("anchor")).where("lo < hi")
    probed = rolling.drop("anchor").join(index.select("h", "anchor"), "h").select("doc_id", "d1", F.struct("h", "pos", "more", "anchor").alias("x"))
    by_doc = probed.groupBy("doc_id", "d1").agg(F.collect_list("x").alias("x"))

    def extend(batches):
        """Windows that hold a hit and whose end blocks are shared."""
        for b in batches:
            rows = _Rows()
            for i, (d, digest) in enumerate(zip(b.column(0).to_numpy(), b.column(1).to_numpy(), strict=True)):
                x = b.column(2)[i].values
                h, pos, hit = (x.field(j).to_numpy(zero_copy_only=False) for j in (0, 1, 3))
                more = pc.fill_null(pc.list_value_length(x.field(2)), 0).to_numpy()
                if more.any():
                    pos = np.concatenate([pos, x.field(2).flatten().to_numpy()])
                    h, hit = (np.concatenate([v, np.repeat(v, more)]) for v in (h, hit))
                order = np.argsort(pos)
                pos, h, hit = pos[order], h[order], hit[order]
                hits = np.concatenate([[0], np.cumsum(hit)])
                j = np.searchsorted(pos, pos + (window - block))
                ok = (j < len(pos)) & (pos[np.minimum(j, len(pos) - 1)] == pos + (window - block))
                one = np.flatnonzero(ok)
                one = one[hits[j[one] + 1] > hits[one]]
                rows.add(mix(h[one].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + h[j[one]].view(np.uint64)), d, digest, pos[one])
            yield rows.batch()

    windows = by_doc.mapInArrow(extend, _ROW)
    first_of = windows.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("h", "first")
    return windows.join(first_of, "h").where("doc_id > first").groupBy("doc_id", "d1").agg(F.collect_list("pos").alias("one"), F.flatten(F.collect_list("more")).alias("more")).select("doc_id", "d1", F.concat("one", "more").alias("starts"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """One row per document: doc_id, n_words, spans (word spans removed, merged), n_removed, kept_text, kept_sha256.

    A word goes if a window of ``window`` consecutive words covers it that also starts in a document
    with a smaller id. Windows are judged on the input. Null and empty texts have no words; rows with
    a null id are never a reference and keep all words; of rows with one id none is the
    smaller, whether their texts are equal or not. Empty tables give no rows; other columns are not read. Windows compare by 64-bit hashes,
    whole word sequences by 128-bit digests.
    """
    if window < 2 or window % 2:
        raise ValueError("window must be even")
    every = keyed(docs, id_col, text_col).drop("d2")
    first = materialize(firsts(keyed(docs, id_col, text_col), window), "firsts")
    found = repeated_windows(every, first, window)
    found = first.select("doc_id", "d1").distinct().join(found, ["doc_id", "d1"], "left").withColumn("first", F.lit(True))

    def cut(batches):
        for b in pieces(batches, "text"):
            words = Words(b.column(1), False)
            texts = b.column(1).cast(pa.large_binary())
            n, gone, kept, sha, spans = [], [], [], [], []
            for i in range(len(words)):
                lo, hi = words.bounds[i], words.bounds[i + 1]
                cover = np.zeros(hi - lo + 1, np.int64)
                if b.column(0)[i].is_valid and hi - lo >= window and not b.column(3)[i].is_valid:
                    cover[0], cover[-1] = 1, -1  # a copy as a whole
                elif b.column(2)[i].is_valid:
                    s = b.column(2)[i].values.to_numpy()
                    s = s[s + window <= hi - lo]
                    np.add.at(cover, s, 1)
                    np.add.at(cover, s + window, -1)
                out = np.cumsum(cover[:-1]) > 0
                raw = (texts[i].as_py() or b"").split()
                left = b" ".join(raw) if not out.any() else b" ".join([w for w, o in zip(raw, out, strict=True) if not o])
                edge = np.flatnonzero(np.diff(np.concatenate([[0], out.astype(np.int8), [0]])))
                n.append(hi - lo)
                gone.append(int(out.sum()))
                kept.append(left.decode())
                sha.append(hashlib.sha256(left).hexdigest())
                spans.append(edge)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), lists(spans, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept), pa.array(sha)], ["doc_id", "n_words", "spans", "n_removed", "kept_text", "kept_sha256"])

    rows = every.join(found, ["doc_id", "d1"], "left").select("doc_id", "text", "starts", "first")
    return rows.mapInArrow(cut, "doc_id long, n_words long, spans array<long>, n_removed long, kept_text string, kept_sha256 string")
