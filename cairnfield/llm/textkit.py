"""Shared word kernels: NumPy over Arrow string buffers, and row keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.plans.storage import materialize, release, shared_dir

__all__ = ["ROW", "SPACES", "WORD", "Words", "as_signed", "crc_mod", "grams", "lists", "materialize", "mix", "pieces", "read", "release", "shared_dir", "with_row_keys", "without_rows"]

#: Regular expression of a word (maximal run of characters that are not ASCII white space).
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]"

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
_S29, _S32 = np.uint64(29), np.uint64(32)


#: Column of ``with_row_keys``. Names that begin with ``__cairnfield_`` are reserved in tables given to stages.
ROW = "__cairnfield_row"


def with_row_keys(docs: DataFrame, *order: Column) -> DataFrame:
    """``docs`` with a unique number for each row (ROW), written out so that it holds in every later read.

    With ``order`` the numbers rise in that order. Decisions made by ROW hold for one row, even where
    ids are null or occur several times.
    """
    if order:
        docs = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "keyed")


def without_rows(keyed: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``with_row_keys`` less those whose number is in ``gone`` (one column, ROW)."""
    return keyed.join(gone, ROW, "left_anti").drop(ROW)


def as_signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _S32)) * _K[2]
    x = (x ^ (x >> _S32)) * _K[2]
    return x ^ (x >> _S32)


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches into slices of about ``most`` text bytes (one row at least), to bound memory."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(col), 0), np.int64))
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to


class Words:
    """Words of a slice of texts: 64-bit hashes, byte spans and the bounds of each text's words.

    A null text has no words. ``lower`` lower-cases A-Z only.
    """

    def __init__(self, texts: pa.Array, lower: bool):
        texts = pc.fill_null(texts, "").cast(pa.large_binary())
        offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
        offs, n = offs - offs[0], len(raw)
        buf = np.zeros(n + 8, np.uint8)
        buf[:n] = _LOWER[raw] if lower else raw
        word = np.zeros(n + 2, bool)
        np.logical_not(_SPACE[raw], out=word[1 : n + 1])
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        self.start = np.flatnonzero(word[1 : n + 1] & (~word[:n] | edge[:n]))
        self.end = np.flatnonzero(word[1 : n + 1] & (~word[2 : n + 2] | edge[1 : n + 1])) + 1
        self.bytes = buf
        self.bounds = np.searchsorted(self.start, offs)
        size = self.end - self.start
        eight = np.ndarray((n + 1,), "<u8", buffer=buf, strides=(1,))
        h = size.astype(np.uint64) * _K[0]
        at, k = np.arange(len(h)), 0
        while len(at):
            chunk = eight[self.start[at] + k] & _MASK[np.minimum(size[at] - k, 8)]
            x = (h[at] ^ chunk) * _K[1]
            h[at] = (x ^ (x >> _S29)) * _K[2]
            k += 8
            at = at[size[at] > k]
        self.hash = mix(h)

    def __len__(self) -> int:
        return len(self.bounds) - 1


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive entries of ``h``; entry i covers i .. i+k-1."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out, have, step, size = None, 0, h, 1
    while True:
        if k & size:
            m = len(h) - have - size + 1
            part = step[have : have + m]
            out = part if out is None else mix(out[:m] * _K[0] + part)
            have += size
        if have == k:
            return out if k > 1 else mix(out + _K[1])
        m = len(step) - size
        step = mix(step[:m] * _K[1] + step[size : size + m])
        size *= 2


def crc_mod(column: str, m: int):
    """crc32 of the id as text, modulo ``m`` (the folds of the contracts); null ids count as ''. """
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % m


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list array of NumPy arrays."""
    offs = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offs[1:])
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(flat, kind))
