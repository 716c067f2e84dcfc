"""Language-model scoring with Elias-Fano word n-gram tries, one a shard of contexts."""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import Words, crc_mod, materialize, mix, pieces

#: Hash that stands for the end of a text, counted as a token, and for what comes before its first word.
END = np.uint64(0xA1F2E0C5883ED497)
START = np.uint64(0x3C6EF372FE94F82B)
#: Slots of the histogram that tells frequent words (a bounded broadcast).
SLOTS = 1 << 16
#: Taken off every count of an n-gram and given to shorter contexts.
DISCOUNT = 0.75
#: Replies are logarithms in steps of this many to a power of ten.
STEPS = 40
_K = np.uint64(0x9E3779B97F4A7C15)
_HALF = np.uint64(32)
_LOW = np.uint64(0xFFFFFFFF)
#: Entries between two values that a sequence keeps decoded, to start a search from.
SKIP = 16


class EliasFano:
    """A monotone sequence in about 2 + log2(u/n) bits an entry: low bits packed, high bits in unary."""

    def __init__(self, low_bits: int, n: int, low: np.ndarray, high: np.ndarray, ranks: np.ndarray, skips: np.ndarray):
        self.l, self.n, self.low, self.high, self.ranks, self.skips = low_bits, n, low, high, ranks, skips
        self.eight = np.ndarray((max(len(low) - 7, 0),), "<u8", buffer=low, strides=(1,)) if low_bits else None

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n, top = len(values), int(values[-1]) + 1 if len(values) else 1
        l = min(56, max(0, int(np.floor(np.log2(top / max(n, 1)))) if top > n else 0))
        bits = np.empty((n, l), np.uint8)
        for b in range(l):
            bits[:, b] = (values >> b) & 1
        low = np.concatenate([np.packbits(bits.ravel(), bitorder="little"), np.zeros(8, np.uint8)])
        high = np.zeros(n + (top >> l) + 64, np.uint8)
        high[(values >> l) + np.arange(n)] = 1
        high = np.packbits(high, bitorder="little")
        high = np.concatenate([high, np.zeros(-len(high) % 8, np.uint8)]).view(np.uint64)
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(high).astype(np.int64))]).astype(np.uint32)
        return cls(l, n, low, high, ranks, values[::SKIP])

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at positions ``i``: select the i-th set high bit, then read the low bits."""
        i = np.asarray(i, np.int64)
        word = np.searchsorted(self.ranks, i, "right") - 1
        left, bits, place = i - self.ranks[word], self.high[word], word * 64 - i
        for width in (32, 16, 8, 4, 2, 1):  # halve the word that holds the bit
            ones = np.bitwise_count(bits & np.uint64((1 << width) - 1))
            over = left >= ones
            left -= ones * over
            bits >>= over * np.uint64(width)
            place += over * np.int64(width)
        out = place << self.l
        if self.l:
            at = i * self.l
            out |= ((self.eight[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.l) - 1)).astype(np.int64)
        return out

    def successor(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """First positions in [lo, hi) whose value is at least ``x`` (``hi`` if none)."""
        k = np.searchsorted(self.skips, x, "left") * SKIP  # the first at least x is at most here
        lo, hi = np.minimum(np.maximum(lo, k - SKIP), hi), np.maximum(np.minimum(hi, k), lo)
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self.access(mid) < x[live]
            lo[live[less]] = mid[less] + 1
            hi[live[~less]] = mid[~less]
            live = live[lo[live] < hi[live]]
        return lo

    def find(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, found) of ``x`` in [lo, hi)."""
        at = self.successor(lo, hi, x)
        ok = at < hi
        ok[ok] = self.access(at[ok]) == x[ok]
        return at, ok

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.l, self.n, *(len(x) for x in (self.low, self.high, self.ranks, self.skips))], np.int64), self.low, self.high, self.ranks, self.skips]


class Trie:
    """The n-grams of a shard: middle words (roots), their next words, their contexts, the trigrams.

    ``next2`` holds for each root its sorted next words, ``ctx`` its sorted words before. A trigram is
    kept below its context by the *rank* of its last word among the next words of the root alone:
    ids relative to the context need few bits. Each level's ids are made monotone by adding the range's base
    and stored with Elias-Fano, as are the pointers from level to level. Probabilities (interpolated
    absolute discounting) and the weights of shorter contexts are quantised to 8 bits a level.
    """

    def __init__(self, blob: np.ndarray):
        self.at, self.blob = 0, blob
        self.width = int(self._take(np.int64, 1)[0])
        self.roots = self._take(np.uint64, int(self._take(np.int64, 1)[0]))
        self.next2, self.ptr2, self.ctx, self.ptr_c, self.ids3, self.ptr3 = (self._ef() for _ in range(6))
        sizes = (self.next2.n, len(self.roots), self.ids3.n, self.ctx.n)
        (self.p2, self.back2, self.p3, self.back3) = ((self._take(np.float32, 256), self._take(np.uint8, n)) for n in sizes)

    def _take(self, kind, n: int) -> np.ndarray:
        size = np.dtype(kind).itemsize * n
        out = self.blob[self.at : self.at + size].view(kind)
        self.at += size + (-size % 8)
        return out

    def _ef(self) -> EliasFano:
        l, n, a, b, c, d = (int(v) for v in self._take(np.int64, 6))
        return EliasFano(l, n, self._take(np.uint8, a), self._take(np.uint64, b), self._take(np.uint32, c), self._take(np.int64, d))

    @staticmethod
    def build(root: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> bytes:
        """The trie's bytes from trigrams sorted by (root, ends) with counts above 0; ``ends`` packs the 32-bit ids of the first and last words."""
        counts = counts.astype(np.float64)
        roots, of = np.unique(root, return_inverse=True)
        first, last = (ends >> _HALF).astype(np.int64), (ends & _LOW).astype(np.int64)
        n_roots = np.arange(len(roots) + 1)
        next2, i2 = np.unique((of << 32) | last, return_inverse=True)
        c2 = np.bincount(i2, counts)
        ptr2 = np.searchsorted(next2 >> 32, n_roots)
        p2, back2 = _discounted(c2, np.repeat(n_roots[:-1], np.diff(ptr2)), len(roots))
        ctx, i3 = np.unique((of << 32) | first, return_inverse=True)
        ptr_c = np.searchsorted(ctx >> 32, n_roots)
        ptr3 = np.searchsorted(i3, np.arange(len(ctx) + 1))
        rank = i2 - ptr2[of]
        width = int(rank.max()) + 1 if len(rank) else 1
        p3, back3 = _discounted(counts, i3, len(ctx))
        out = [np.array([width], np.int64), np.array([len(roots)], np.int64), roots]
        for v in (next2, ptr2, ctx, ptr_c, i3 * width + rank, ptr3):
            out += EliasFano.build(v).parts()
        for v in (p2, back2, p3, back3):
            out += _quantise(v)
        return b"".join(x.tobytes() + b"\0" * (-x.nbytes % 8) for x in out)

    def parts_of(self, root: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a, b) of trigrams: P(last | first, root) = a + b * P(last)."""
        n = len(root)
        a, b = np.zeros(n), np.ones(n)
        if not len(self.roots):
            return a, b
        r = np.minimum(np.searchsorted(self.roots, root), len(self.roots) - 1)
        q = np.flatnonzero(self.roots[r] == root)
        r, first, last = r[q], (ends[q] >> _HALF).astype(np.int64), (ends[q] & _LOW).astype(np.int64)
        lo, hi = (self.ptr2.access(np.arange(len(self.roots)) + k)[r] for k in (0, 1))
        at2, ok2 = self.next2.find(lo, hi, (r << 32) | last)
        x = np.zeros(len(q))
        x[ok2] = self.p2[0][self.p2[1][at2[ok2]]]
        y = self.back2[0][self.back2[1][r]].astype(np.float64)
        key = (r << 32) | first
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else r  # each context is looked up once
        ctx, known = (np.repeat(v, np.diff(np.append(new, len(key)))) for v in self.ctx.find(self.ptr_c.access(r[new]), self.ptr_c.access(r[new] + 1), key[new]))
        weight = self.back3[0][self.back3[1][ctx[known]]]
        x[known] *= weight
        y[known] *= weight
        live = np.flatnonzero(known & ok2)
        c = ctx[live]
        at3, ok3 = self.ids3.find(self.ptr3.access(c), self.ptr3.access(c + 1), c * self.width + (at2 - lo)[live])
        x[live[ok3]] += self.p3[0][self.p3[1][at3[ok3]]]
        a[q], b[q] = x, y
        return a, b


def _discounted(c: np.ndarray, context: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Discounted probabilities of entries, and the weight left to the shorter context of each context."""
    total = np.bincount(context, c, n)
    return (c - DISCOUNT) / total[context], DISCOUNT * np.bincount(context, minlength=n) / np.maximum(total, 1)


def _quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An 8-bit code book over equal steps of the logarithm (each the mean of its entries), and the codes."""
    if not len(v):
        return np.zeros(256, np.float32), np.zeros(0, np.uint8)
    x = np.log10(v)
    lo, hi = float(x.min()), float(x.max())
    q = np.minimum((x - lo) * (256 / max(hi - lo, 1e-9)), 255).astype(np.uint8)
    return (10 ** (np.bincount(q, x, 256) / np.maximum(np.bincount(q, minlength=256), 1))).astype(np.float32), q


def mapped(blob: bytes) -> Trie:
    """The trie's levels, memory-mapped from a task-local file that is unlinked at once."""
    f, path = tempfile.mkstemp()
    try:
        with os.fdopen(f, "wb") as out:
            out.write(blob)
        return Trie(np.asarray(np.memmap(path, np.uint8, "r")))
    finally:
        os.unlink(path)


def _tokens(texts) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an END after each text, and the bounds of each text's tokens."""
    w = Words(texts, lower=True)
    ends = w.bounds[1:]
    return np.insert(w.hash, ends, END), np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])


def _before(t: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two tokens before each token; START before the first."""
    one, two = np.empty_like(t), np.empty_like(t)
    one[1:], two[2:] = t[:-1], t[:-2]
    first = bounds[:-1]
    second = (first + 1)[first + 1 < bounds[1:]]
    one[first] = two[first] = two[second] = START
    return two, one


def _slot(word: np.ndarray) -> np.ndarray:
    return (word >> np.uint64(48)).astype(np.int64)


class Requests:
    """The distinct trigrams of a block of texts, in the order of their shards.

    The middle word is the root. Frequent middle words are split by the first word into ``splits``
    roots, so that no shard holds all of one. Shards are ranges of the root's hash.
    """

    def __init__(self, texts, splits: np.ndarray, shards: int):
        self.tokens, self.bounds = _tokens(texts)
        two, one = _before(self.tokens, self.bounds)
        parts = splits[_slot(one)].astype(np.uint64)
        root = mix(one + (mix(two) % parts) * _K)
        ends = (two & ~_LOW) | (self.tokens >> _HALF)
        order = np.lexsort((ends, root))
        r, e = root[order], ends[order]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (e[1:] != e[:-1])
        self.first = np.flatnonzero(new)
        self.inverse = np.empty(len(r), np.int64)
        self.inverse[order] = np.cumsum(new) - 1
        self.order, self.root, self.ends = order, r[new], e[new]
        self.starts = np.flatnonzero(np.concatenate([[True], self.root[1:] != self.root[:-1]])) if len(self.root) else np.zeros(0, np.int64)
        self.roots = self.root[self.starts]
        at = order[self.first[self.starts]]  # a token of each root
        self.whole = (parts[at] == 1) & (one[at] != START)
        self.shard_bounds = np.searchsorted(self._shard(self.roots, shards), np.arange(shards + 1))
        #: distinct words with several roots: their counts are asked for apart
        words = np.unique(self.tokens[(splits[_slot(self.tokens)] > 1) & (self.tokens != END)])
        self.words = words[np.argsort(mix(words), kind="stable")]
        self.word_bounds = np.searchsorted(self._shard(mix(self.words), shards), np.arange(shards + 1))

    @staticmethod
    def _shard(h: np.ndarray, shards: int) -> np.ndarray:
        return ((h >> _HALF) * np.uint64(shards)) >> _HALF

    def cells(self, learn: np.ndarray):
        """(shard, payload) of every shard asked; ``learn`` tells which tokens are of training texts."""
        counts = np.add.reduceat(learn[self.order].astype(np.int64), self.first) if len(self.first) else np.zeros(0, np.int64)
        at, many = np.searchsorted(mix(self.words), mix(self.tokens)), splits_mask(self.words, self.tokens)
        word_counts = np.bincount(at[many], learn[many], len(self.words)).astype(np.int64)
        ends = np.append(self.starts, len(self.root))
        for s in np.flatnonzero((np.diff(self.shard_bounds) > 0) | (np.diff(self.word_bounds) > 0)):
            g, w = slice(*self.shard_bounds[s : s + 2]), slice(*self.word_bounds[s : s + 2])
            e = slice(ends[g.start], ends[g.stop])
            yield int(s), pack(self.roots[g], np.diff(ends[g.start : g.stop + 1]), self.whole[g].astype(np.uint8), self.ends[e], counts[e], self.words[w], word_counts[w])


def splits_mask(words: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Which tokens are among ``words`` (sorted by their mixed hash)."""
    if not len(words):
        return np.zeros(len(tokens), bool)
    at = np.minimum(np.searchsorted(mix(words), mix(tokens)), len(words) - 1)
    return words[at] == tokens


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, non-negative int64 ones in the narrowest type that holds them."""
    out = []
    for x in arrays:
        if x.dtype == np.int64:
            x = x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))
        out.append(np.array([len(x), x.dtype.itemsize], np.uint32).tobytes() + x.tobytes())
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n, size = (int(v) for v in np.frombuffer(data, np.uint32, 2, at))
        out.append(np.frombuffer(data, f"u{size}", n, at + 8))
        at += 8 + n * size
    return out


def _code(p: np.ndarray) -> np.ndarray:
    """Quantised logarithm of probabilities: 0 is none, 255 the least."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(np.rint(-np.log10(p) * STEPS) + 1, 1, 255), 0).astype(np.uint8)


_DECODED = np.concatenate([[0.0], 10 ** (-np.arange(255) / STEPS)])


def answer(shard: pa.Table) -> pa.Table:
    """Build the shard's trie from all cells and answer each; one more row holds the shard's number of words."""
    cells = [unpack(v.as_py()) for v in shard.column("payload")]
    sizes = [len(c[3]) for c in cells]
    root = np.concatenate([np.repeat(c[0], c[1]) for c in cells])
    ends, counts = np.concatenate([c[3] for c in cells]), np.concatenate([c[4] for c in cells]).astype(np.int64)
    order = np.lexsort((ends, root))
    r, e = root[order], ends[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (e[1:] != e[:-1])
    inverse = np.empty(len(r), np.int64)
    inverse[order] = np.cumsum(new) - 1
    total = np.add.reduceat(counts[order], np.flatnonzero(new)) if len(r) else counts
    r, e = r[new], e[new]
    trie = mapped(Trie.build(r[total > 0], e[total > 0], total[total > 0]))
    a, b = (_code(x) for x in trie.parts_of(r, e))
    at = np.cumsum([0, *sizes])
    groups, of = np.unique(np.concatenate([c[0] for c in cells]), return_inverse=True)
    per_group = np.bincount(np.searchsorted(groups, r), total, len(groups)).astype(np.int64)
    whole = np.zeros(len(groups), bool)
    whole[of] = np.concatenate([c[2] for c in cells]) > 0
    words, of_word = np.unique(np.concatenate([c[5] for c in cells]), return_inverse=True)
    per_word = np.bincount(of_word, np.concatenate([c[6] for c in cells]), len(words)).astype(np.int64)
    blocks, out, g, w = shard.column("block").to_pylist(), [], 0, 0
    for i, c in enumerate(cells):
        q = inverse[at[i] : at[i + 1]]
        out.append(pack(a[q], b[q], per_group[of[g : g + len(c[0])]], per_word[of_word[w : w + len(c[5])]]))
        g, w = g + len(c[0]), w + len(c[5])
    number = shard.column("shard")[0].as_py()
    known = int((whole & (per_group > 0)).sum() + (per_word > 0).sum())
    return pa.table({
        "block": pa.array([*blocks, -1 - number], pa.int64()), "shard": pa.array([number] * (len(blocks) + 1), pa.int64()),
        "payload": pa.array([*out, None], pa.binary()), "known": pa.array([None] * len(blocks) + [known], pa.int64()),
    })


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 5, held: int = 1, block_bytes: int = 16 << 20, shard_tokens: int = 1_500_000) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns word trigrams from all documents outside the held-out fold; there is no limit to the
    vocabulary. Documents are dealt by hash to blocks of about ``block_bytes`` of text. A block sends
    its distinct trigrams with their training counts, packed, to shards of the middle words; the number of
    shards grows with the text. A shard's task sums the counts, builds an Elias-Fano trie of them, looks up
    what each block asked and returns quantised probabilities and word counts; then each block, met
    with the replies, sums up its texts. Nothing is broadcast but a histogram of SLOTS word
    counts, by which frequent middle words are split by the word before over several shards.

    P(z | x, y) = d(x, y, z) + w(x, y) (d(g(x), y, z) + w(g(x), y) P(z)), with discounted relative
    frequencies d and weights w that sum to one; g(x) is one class, or the split of x where y is frequent.
    P(z) = c / (N + s) for words of the training texts and s / (N + s) for all others together, s = sqrt(N).
    Probabilities are rounded to 8 bits twice (in the trie, and to 1/STEPS of a decade in the reply);
    words compare by 64-bit hashes as middle words and by 32 bits below those.

    Null texts are empty (one token, the end). Rows with null ids are scored; their fold is that of
    ''. Repeated rows give repeated rows. Empty tables give no rows; other columns are not read.
    """
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (crc_mod(id_col, fold) == held).alias("held_out"))

    def histogram(batches):
        acc, size, texts = np.zeros(SLOTS, np.int64), 0, 0
        for batch in pieces(batches, "text"):
            t, bounds = _tokens(batch.column(0))
            learn = ~np.asarray(batch.column(1)).astype(bool)
            size, texts = size + (pc.sum(pc.binary_length(batch.column(0))).as_py() or 0), texts + int(learn.sum())
            acc += np.bincount(_slot(t[np.repeat(learn, np.diff(bounds))]), minlength=SLOTS)
        f = np.flatnonzero(acc)
        yield pa.RecordBatch.from_arrays([pa.array([*f, -1, -2]), pa.array([*acc[f], size, texts])], ["slot", "n"])

    found = {r["slot"]: r["n"] for r in thin.select("text", "held_out").mapInArrow(histogram, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()}
    size, texts = found.pop(-1, 0), found.pop(-2, 0)
    total = sum(found.values())
    n_blocks, n_shards = max(1, -(-size // block_bytes)), max(1, -(-total // shard_tokens))
    splits = np.ones(SLOTS, np.uint16)
    for k, n in found.items():
        splits[k] = min(-(-4 * n // shard_tokens), 60_000)
    shared = docs.sparkSession.sparkContext.broadcast(splits)
    dealt = thin.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)))

    def ask(key, table):
        q = Requests(table.column("text").combine_chunks(), shared.value, n_shards)
        learn = np.repeat(~np.asarray(table.column("held_out")).astype(bool), np.diff(q.bounds))
        rows = list(q.cells(learn))
        return pa.table({"block": pa.array([key[0].as_py()] * len(rows), pa.int64()), "shard": pa.array([s for s, _ in rows], pa.int64()), "payload": pa.array([p for _, p in rows], pa.binary())})

    # the numbers of partitions grow with the text, too
    dealt = dealt.repartition(2 * n_blocks, "block")
    asked = dealt.groupBy("block").applyInArrow(ask, "block long, shard long, payload binary")
    replies = asked.repartition(2 * n_shards, "shard").groupBy("shard").applyInArrow(answer, "block long, shard long, payload binary, known long").repartition(2 * n_blocks, "block")
    unknown = max(1.0, np.sqrt(total))

    def score_block(left, right):
        if not left.num_rows:  # the row of a shard
            return pa.table({k: pa.nulls(right.num_rows, t) for k, t in (("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()))} | {"known": right.column("known")})
        q = Requests(left.column("text").combine_chunks(), shared.value, n_shards)
        cells = [unpack(v.as_py()) for v in right.sort_by("shard").column("payload")]
        a, b, per_root, per_word = (np.concatenate([c[i] for c in cells]) for i in range(4))
        t = q.tokens
        c = np.zeros(len(t), np.int64)
        at = np.minimum(np.searchsorted(q.roots, mix(t)), len(q.roots) - 1)
        c = np.where((q.roots[at] == mix(t)) & q.whole[at], per_root[at], 0).astype(np.int64)
        many = splits_mask(q.words, t)
        c[many] = per_word[np.searchsorted(mix(q.words), mix(t[many]))]
        c[t == END] = texts
        p = np.where(c > 0, c, unknown) / (total + unknown)
        one = np.log10(_DECODED[a[q.inverse]] + _DECODED[b[q.inverse]] * p)
        add = lambda x: np.add.reduceat(x, q.bounds[:-1])  # noqa: E731  every text has its end token
        n = left.num_rows
        return pa.table({
            "doc_id": left.column("doc_id"), "held_out": left.column("held_out"), "n_tokens": np.diff(q.bounds), "n_known": add((c > 0).astype(np.int64)),
            "base": add(np.log10(c + 0.5)), "score": add(one), "known": pa.nulls(n, pa.int64()),
        })

    out = dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        score_block, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, known long"
    )
    out = materialize(out, "scores")
    v = out.agg(F.sum("known").alias("v")).first()["v"] or 0
    v += texts > 0  # the end of a text is never a middle word
    per_token = float(np.log10(total + 0.5 * (v + 1)))
    return out.where("known is null").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * per_token).alias("base_score"), "score"
    )
