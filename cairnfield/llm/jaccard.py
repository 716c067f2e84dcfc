"""Size-aware heavy-light Jaccard join over word shingles, reduced to classes and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import ROW, Words, as_signed, grams, materialize, mix, pieces, release, with_row_keys, without_rows

#: Lists longer than this share one document frequency (the order stays the same for all sets).
SATURATED = 1 << 20
#: Cost of an entry scanned in a list, against a row that is shuffled. Measured on check_l: a list row costs
#: 2.2 us (written, sorted, read in Python), a pair of entries compared in ``open_pairs`` 0.08 us.
SCAN = 0.036
#: 64-bit words of a set's sketch, and neighbours looked at in a list sorted at random.
WORDS = 4
NEAR = 4
_SKETCH = [f"s{i}" for i in range(WORDS)]
#: Bits of the map of ids that the sieve lets through (2^20 rows of 64 bits at most), and the most ids it serves.
MAP_BITS = 1 << 26
MAP_IDS = 1 << 22


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; a shorter text is one shingle."""
    words = Words(texts, lower=True)
    full, h, b = grams(words.hash, k), words.hash, words.bounds
    short = {j: grams(h, j) + np.uint64(j) for j in range(1, k)}
    out = []
    for i in range(len(words)):
        n = b[i + 1] - b[i]
        if n >= k:
            out.append(np.unique(full[b[i] : b[i + 1] - k + 1]))
        else:
            out.append(short[n][b[i] : b[i] + 1] if n else np.zeros(0, np.uint64))
    return out


def set_id(s: np.ndarray) -> int:
    """A digest of a set of hashes."""
    x = mix(s + np.uint64(len(s)))
    total = np.array([x.sum(dtype=np.uint64)], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return int(mix(total ^ np.bitwise_xor.reduce(x)).view(np.int64)[0])


def least_overlap(n, pct: int):
    """ceil(n * pct / 100): what a set of n must share with any set it links to."""
    return -(-n * pct // 100)


def _extra(n, pct: int):
    """Tokens beyond the plain prefix that the sieve looks at, and so must be shared."""
    return np.minimum(np.maximum(2, n // 10), least_overlap(n, pct))


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, bool, bool]]:
    """Sorted batches regrouped so that a run of equal keys is whole, or cut when over SATURATED.

    Yields (rows, starts of runs, the first run continues a cut one, the last run is cut)."""
    kept: pa.Table | None = None
    cut_key = None
    for batch in batches:
        t = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
        t = t.combine_chunks()
        if not t.num_rows:
            continue
        ks = t.column(key).to_numpy()
        last = int(np.searchsorted(ks, ks[-1], "left"))
        if t.num_rows - last > SATURATED:
            yield t, _starts(ks), cut_key is not None and ks[0] == cut_key, True
            kept, cut_key = None, ks[-1]
        else:
            if last:
                yield t.slice(0, last), _starts(ks[:last]), cut_key is not None and ks[0] == cut_key, False
                cut_key = None
            kept = t.slice(last)
    if kept is not None and kept.num_rows:
        ks = kept.column(key).to_numpy()
        yield kept, _starts(ks), cut_key is not None and ks[0] == cut_key, False


def _starts(ks: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], ks[1:] != ks[:-1]]))


def _sorted_by(df: DataFrame, *cols: str) -> DataFrame:
    return df.repartition(cols[0]).sortWithinPartitions(*cols)


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, pct: int = 75, rounds: int = 1, boundary: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id, component_id.

    Documents with equal shingle sets form a class (class_id: smallest id). Two sets link when
    100 * |A & B| >= pct * |A | B|; component_id is the smallest id reachable by links.

    1. *Sieve.* In hash order, linked sets share at least m tokens among their first
       n - ceil(pct n / 100) + m. Only those tokens are shuffled; a set goes on if enough of them
       also occur in another set of compatible size.
    2. *Frequency order.* The sets left are read whole, picked at the scan by a bitmap of hashed ids
       of bounded size (beyond MAP_IDS sets by a join instead); tokens held by one set only are dropped
       from lists (but count as misses), the rest is ordered from rare to frequent.
    3. *Heavy and light.* Sets up to a boundary enumerate all 2-subsets of their 2-extended
       prefix; larger sets (and those that can meet one) post their prefix to inverted lists. The
       boundary is where the summed cost (subsets made against list entries scanned) is least, or
       as given by ``boundary``; it changes the work, not the result.
    4. *Links.* Sketches of WORDS * 64 parity bits bound the overlap of two sets from above; pairs
       that they rule out are not verified. Each list first pairs its members with its smallest id and each with its
       neighbour; pairs are verified exactly and joined to components. In ``rounds`` further
       rounds, lists that still hold several components are sorted at random and neighbours of
       different components verified, which joins what is densely linked in linear work. At last
       all pairs of one list whose components still differ are verified, so that no link is lost.

    Null or empty texts have no shingles and link to nothing; rows with a null id stand alone with
    null ids. Repeated rows give repeated rows. Empty tables give no rows; other columns are not
    read. Shingles and sets are compared by 64-bit hashes.
    """
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def describe(batches):
        for b in pieces(batches, "text"):
            sets = shingle_sets(b.column(1), k)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())], ["doc_id", "sid", "n"])

    table = materialize(thin.mapInArrow(describe, "doc_id long, sid long, n long"), "sets")
    classes = table.where("n > 0 and doc_id is not null").groupBy("sid", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members"))

    def prefixes(batches):
        seen: set[int] = set()
        for b in pieces(batches, "text"):
            hs, ids, ns = [], [], []
            for s in shingle_sets(b.column(1), k):
                n = len(s)
                if n < 3 or (i := set_id(s)) in seen:
                    continue
                seen.add(i)
                s = s[: n - least_overlap(n, pct) + int(_extra(n, pct))]
                hs.append(s)
                ids.append(np.full(len(s), i, np.int64))
                ns.append(np.full(len(s), n, np.int64))
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(as_signed(np.concatenate(hs))), pa.array(np.concatenate(ids)), pa.array(np.concatenate(ns))], ["h", "sid", "n"])

    def shared(batches):
        """Counts, per set, of tokens that a set of compatible size also has (partial counts)."""
        for t, st, before, cut in _runs(batches, "h"):
            h, sid, n = (t.column(c).to_numpy() for c in ("h", "sid", "n"))
            other = (h[1:] == h[:-1]) & (sid[1:] != sid[:-1])
            fit = other & (n[:-1] * 100 >= n[1:] * pct)
            hit = np.zeros(len(h), bool)
            hit[1:] |= fit
            hit[:-1] |= fit
            if before:  # a list too long to hold is cut; to count all its members is safe in a sieve
                hit[: st[1] if len(st) > 1 else len(h)] = True
            if cut:
                hit[st[-1] :] = True
            first = np.ones(len(h), bool)
            first[1:] = ~((h[1:] == h[:-1]) & (sid[1:] == sid[:-1]))
            # a repeated (h, sid) row takes part through its neighbour; spread its hit to the first
            if not first.all():
                g = np.cumsum(first) - 1
                hit = np.bincount(g, hit)[:] > 0
                sid, n = sid[first], n[first]
            u, c = np.unique(sid[hit], return_counts=True)
            where = np.searchsorted(u, sid[hit])
            size = np.zeros(len(u), np.int64)
            size[where] = n[hit]
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(size), pa.array(c.astype(np.int64))], ["sid", "n", "c"])

    tokens = _sorted_by(thin.where("doc_id is not null").mapInArrow(prefixes, "h long, sid long, n long"), "h", "n", "sid")
    need = F.greatest(F.lit(2), F.floor((F.floor((F.col("n") * pct + 99) / 100)) / 10))
    active = tokens.mapInArrow(shared, "sid long, n long, c long").groupBy("sid", "n").agg(F.sum("c").alias("c")).where(F.col("c") >= need)
    reps = materialize(classes.join(active.select("sid", "n"), ["sid", "n"]), "reps")

    def whole(batches):
        seen: set[int] = set()
        for b in pieces(batches, "text"):
            hs, ids = [], []
            for s in shingle_sets(b.column(1), k):
                if len(s) < 3 or (i := set_id(s)) in seen:
                    continue
                seen.add(i)
                hs.append(s)
                ids.append(np.full(len(s), i, np.int64))
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(as_signed(np.concatenate(hs))), pa.array(np.concatenate(ids))], ["h", "sid"])

    def frequencies(batches):
        for t, st, before, cut in _runs(batches, "h"):
            h, sid = (t.column(c).to_numpy() for c in ("h", "sid"))
            first = np.concatenate([[True], (h[1:] != h[:-1]) | (sid[1:] != sid[:-1])])
            h, sid = h[first], sid[first]
            st = _starts(h)
            df = np.diff(np.append(st, len(h)))
            if before:
                df[0] = SATURATED
            if cut:
                df[-1] = SATURATED
            df = np.repeat(df, np.diff(np.append(st, len(h))))
            m = df > 1
            if m.any():
                yield pa.RecordBatch.from_arrays([pa.array(sid[m]), pa.array(df[m].astype(np.int64)), pa.array(h[m])], ["sid", "df", "h"])

    texts = holders(thin, reps.select(F.col("rep").alias("doc_id"))).select("doc_id", "text")
    ordered = _sorted_by(texts.mapInArrow(whole, "h long, sid long"), "h", "sid").mapInArrow(frequencies, "sid long, df long, h long")
    # two lists made in one pass pair up, and take half the bytes of a list of structs in the shuffle
    sets = ordered.groupBy("sid").agg(F.collect_list("df").alias("df"), F.collect_list("h").alias("h"))
    # the exact sieve: a bitmap lets a few more sets through
    sets = sets.join(reps.select("sid", "rep", "n"), "sid").select("rep", "n", F.sort_array(F.arrays_zip("df", "h")).alias("x"))
    overlap = F.floor((F.col("n") * pct + 99) / 100)
    # tokens of one set only come first in the frequency order
    sets = sets.withColumn("p", (F.size("x") - overlap + 1).cast("int")).where("p >= 1")
    sets = materialize(sets.select("rep", "n", "p", F.col("x.h").alias("h"), F.col("x.df").alias("df")), "ordered")

    def sketch(batches):
        for b in batches:
            offs, flat = b.column(2).offsets.to_numpy(), b.column(2).values.to_numpy()
            size = np.diff(offs)
            row = np.repeat(np.arange(b.num_rows), size)
            bit = (mix(flat[offs[0] : offs[-1]].view(np.uint64)) % np.uint64(64 * WORDS)).astype(np.int64)
            odd = np.bincount(row * 64 * WORDS + bit, minlength=b.num_rows * 64 * WORDS) & 1
            words = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).reshape(-1, WORDS)
            rest = b.column(1).to_numpy() - size  # tokens that no other set has
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rest.astype(np.int64)), *[pa.array(np.ascontiguousarray(words[:, i])) for i in range(WORDS)]], ["rep", "own", *_SKETCH])

    sketches = materialize(sets.select("rep", "n", "h").mapInArrow(sketch, "rep long, own long, " + ", ".join(f"{c} long" for c in _SKETCH)), "sketches")

    if boundary is None:
        boundary = light_boundary(sets)

    def postings(batches):
        """List entries (key, rep, n, component) of each set's prefix (rep, n, p, h, component)."""
        for b in batches:
            rep, n, p, label = (b.column(i).to_numpy() for i in (0, 1, 2, 4))
            offs, flat = b.column(3).offsets.to_numpy(), b.column(3).values.to_numpy()
            keys, size = [], np.zeros(len(rep), np.int64)
            for i in range(len(rep)):
                x = flat[offs[i] : offs[i + 1]].view(np.uint64)
                parts = [np.zeros(0, np.uint64)]
                if n[i] <= boundary:
                    one, two = np.triu_indices(len(x), 1)
                    parts.append(mix(np.minimum(x[one], x[two]) * np.uint64(0x9E3779B97F4A7C15) + np.maximum(x[one], x[two])))
                if n[i] * 100 > boundary * pct:
                    parts.append(x[: p[i]])
                keys.append(np.concatenate(parts))
                size[i] = len(keys[-1])
            if keys:
                key = as_signed(np.concatenate(keys))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, np.repeat(rep, size), np.repeat(n, size), np.repeat(label, size))], ["key", "rep", "n", "label"])

    prefix = sets.select("rep", "n", "p", F.slice("h", F.lit(1), F.col("p") + 1).alias("h"))
    entry = "key long, rep long, n long, label long"
    posts = prefix.withColumn("label", F.col("rep")).mapInArrow(postings, entry).select("key", "rep", "n")

    def first_pairs(batches):
        """(smallest id of the list, member) and (neighbour, member) pairs of compatible sizes."""
        hub = None  # key, rep, n of the run that the last batch ended in, and its last member
        for b in batches:
            if not b.num_rows:
                continue
            key, rep, n = (b.column(i).to_numpy() for i in range(3))
            st = _starts(key)
            run = np.repeat(np.arange(len(st)), np.diff(np.append(st, len(key))))
            hr, hn = rep[st].copy(), n[st].copy()
            pr, pn = np.concatenate([[rep[0]], rep[:-1]]), np.concatenate([[n[0]], n[:-1]])
            pr[st], pn[st] = rep[st], n[st]
            if hub is not None and hub[0] == key[0]:
                hr[0], hn[0], pr[0], pn[0] = hub[1:]
            hub = (key[-1], hr[-1], hn[-1], rep[-1], n[-1])
            a = np.concatenate([hr[run], pr])
            an = np.concatenate([hn[run], pn])
            c, cn = np.concatenate([rep, rep]), np.concatenate([n, n])
            yield _pairs(a, an, c, cn, pct)

    pairs = _sorted_by(posts, "key", "rep").mapInArrow(first_pairs, "a long, b long").distinct()
    labels = materialize(components(verified(likeliest(plausible(pairs, sketches, sets, pct)), sets, pct)), "first-labels")
    # components are joined to the sets, not to the far more list entries
    marked = prefix.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "n", "p", "h", F.coalesce("label", "rep").alias("label"))
    marked = marked.mapInArrow(postings, entry).select("key", "n", "rep", "label")

    def open_lists(batches):
        """The rows of lists whose members are in several components."""
        for t, st, before, cut in _runs(batches, "key"):
            label = t.column("label").to_numpy()
            keep = np.minimum.reduceat(label, st) != np.maximum.reduceat(label, st)
            keep[0] |= before
            keep[-1] |= cut
            yield from t.filter(pa.array(np.repeat(keep, np.diff(np.append(st, len(label)))))).to_batches()

    def dealt_pairs(batches):
        """Plausible pairs of neighbours of different components in lists sorted at random."""
        held = np.zeros((5 + WORDS, 0), np.int64)
        for b in batches:
            rows = np.concatenate([held, np.stack([b.column(i).to_numpy() for i in range(5 + WORDS)])], axis=1)
            key, lab, new, got = rows[0], rows[3], held.shape[1], []
            for d in range(1, NEAR + 1):
                i = np.arange(max(d, new), len(key))
                i = i[(key[i] == key[i - d]) & (lab[i] != lab[i - d])]
                fits, gap = _may_link(rows[:, i], rows[:, i - d], pct)
                i = i[fits]
                got.append(np.stack([rows[2][i - d], rows[2][i], lab[i - d], lab[i], gap[fits]]))
            yield _labelled(np.concatenate(got, axis=1))
            held = rows[:, -NEAR:]

    def open_pairs(batches):
        """Plausible pairs of different components, list by list in order of size.

        Only the members within the size ratio are held, one row per set."""
        held = np.zeros((5 + WORDS, 0), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            rows = np.concatenate([held, np.stack([b.column(i).to_numpy() for i in range(5 + WORDS)])], axis=1)
            start = held.shape[1]
            st = _starts(rows[0])
            size = np.diff(np.append(st, rows.shape[1]))
            open_run = np.minimum.reduceat(rows[3], st) != np.maximum.reduceat(rows[3], st)
            open_run[-1] = True  # its list may go on in the next batch
            use = np.repeat(open_run, size)
            start = int(use[:start].sum())
            rows = rows[:, use]
            key, n, rep, lab = rows[:4]
            out, held_out = [], 0
            lo = np.searchsorted(key, key, "left")
            for i in range(start, len(key)):
                f = lo[i]
                if f == i:
                    continue
                f = f + np.searchsorted(n[f:i] * 100, n[i] * pct, "left")
                m = np.flatnonzero(lab[f:i] != lab[i]) + f
                fits, gap = _may_link(rows[:, m], rows[:, i : i + 1], pct)
                m = m[fits]
                if len(m):
                    out.append(np.stack([rep[m], np.full(len(m), rep[i]), lab[m], np.full(len(m), lab[i]), gap[fits]]))
                    held_out += len(m)
                    if held_out > 200_000:
                        yield _labelled(np.concatenate(out, axis=1))
                        out, held_out = [], 0
            if out:
                yield _labelled(np.concatenate(out, axis=1))
            f = lo[-1] + np.searchsorted(n[lo[-1] :] * 100, n[-1] * pct, "left")
            held = rows[:, f:]

    kind = "a long, b long, la long, lb long, gap long"
    row = ["key", "n", "rep", "label", "own", *_SKETCH]
    whole_row = ", ".join(f"{c} long" for c in row)
    left = materialize(_sorted_by(marked, "key").mapInArrow(open_lists, "key long, n long, rep long, label long").join(sketches, "rep").select(*row), "open")
    for turn in (*range(1, rounds + 1), None):
        if turn is None:
            found = _sorted_by(left, "key", "n", "rep").mapInArrow(open_pairs, kind)
        else:
            found = _sorted_by(left.withColumn("o", F.xxhash64("rep", F.lit(turn))), "key", "o").select(*row).mapInArrow(dealt_pairs, kind)
            found = likeliest(found)
        links = verified(found.select("a", "b", "la", "lb").distinct(), sets, pct).select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
        merged = components(links).select(F.col("node").alias("label"), F.col("label").alias("to"))
        labels = materialize(labels.union(left.select("rep", "label").distinct().withColumnsRenamed({"rep": "node"})).distinct().join(merged, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        if turn is not None:
            left = left.join(merged, "label", "left").withColumn("label", F.coalesce("to", "label")).select(*row)
            left = materialize(_sorted_by(left, "key").mapInArrow(open_lists, whole_row), "open")

    # classes that hold a thousandth of all rows are at most 1000: a proven bound for the broadcast
    heavy = F.col("members") * 1000 >= table.count()
    named = table.join(F.broadcast(classes.where(heavy).select("sid", "n", F.col("rep").alias("heavy"))), ["sid", "n"], "left")
    light = named.where("heavy is null").join(classes.where(~heavy).select("sid", "n", "rep"), ["sid", "n"], "left").select("doc_id", "n", "rep")
    known = light.unionByName(named.where("heavy is not null").select("doc_id", "n", F.col("heavy").alias("rep")))
    return known.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("class_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "rep", "doc_id")).alias("component_id"),
    )


def holders(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is in ``ids``, and a few others, without a shuffle of ``docs``.

    The ids set bits of a map of fixed size, so that the broadcast is bounded; beyond MAP_IDS ids it
    would let too much through, and a plain semi-join is used."""
    if ids.count() > MAP_IDS:
        return docs.join(ids, "doc_id", "left_semi")
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(MAP_BITS)).alias("slot")
    bits = ids.select(slot).groupBy(F.expr("slot div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("bits"))
    placed = docs.select("*", slot).withColumn("word", F.expr("slot div 64"))
    return placed.join(F.broadcast(bits), "word").where("shiftright(bits, cast(slot % 64 as int)) & 1 = 1").select(*docs.columns)


def plausible(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """The pairs (a, b) that their sketches do not rule out."""
    thin = sketches.join(sets.select("rep", "n"), "rep")
    side = lambda x: thin.select([F.col(c).alias(f"{x}{'' if c == 'rep' else c}") for c in thin.columns])
    total = F.col("an") + F.col("bn")
    most = total - 2 * -F.floor(-total * pct / (100 + pct))
    least = F.col("aown") + F.col("bown")
    for c in _SKETCH:
        least = least + F.bit_count(F.col(f"a{c}").bitwiseXOR(F.col(f"b{c}")))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(least <= most).select(*pairs.columns, least.alias("gap"))


def likeliest(pairs: DataFrame) -> DataFrame:
    """Of each set's pairs with smaller ids the one of least gap, that with the smallest id and one at
    random: enough to join what is densely linked. It may leave links out; the last pass finds those."""
    rest = [c for c in pairs.columns if c not in ("b", "gap")]
    one = F.struct(*rest)
    best = pairs.groupBy("b").agg(F.min_by(one, F.struct("gap", "a")).alias("i"), F.min_by(one, "a").alias("j"), F.min_by(one, F.struct(F.xxhash64("a", "b"), "a")).alias("k"))
    return best.select("b", F.explode(F.array_distinct(F.array("i", "j", "k"))).alias("p")).select("b", "p.*")


def _may_link(x: np.ndarray, y: np.ndarray, pct: int) -> tuple[np.ndarray, np.ndarray]:
    """(may link, least difference) of rows (key, n, rep, label, own, sketch): two sets
    differ in all tokens of their own and in at least as many others as their sketches differ in bits."""
    total = x[1] + y[1]
    fits = np.minimum(x[1], y[1]) * 100 >= np.maximum(x[1], y[1]) * pct
    # unsigned: NumPy counts the bits of a negative number's absolute value
    differ = x[4] + y[4] + np.bitwise_count((x[5:] ^ y[5:]).view(np.uint64)).sum(axis=0, dtype=np.int64)
    return fits & (differ <= total - 2 * -(-total * pct // (100 + pct))), differ


def _labelled(rows: np.ndarray) -> pa.RecordBatch:
    """Distinct pairs (a < b) with the components of both and the least difference."""
    rows = np.where(rows[0] > rows[1], rows[[1, 0, 3, 2, 4]], rows)
    rows = np.unique(rows, axis=1) if rows.shape[1] else rows
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(r)) for r in rows], ["a", "b", "la", "lb", "gap"])


def _couples(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    m = lo != hi
    got = np.unique(np.stack([lo[m], hi[m]], 1), axis=0) if m.any() else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(got[:, 0])), pa.array(np.ascontiguousarray(got[:, 1]))], ["a", "b"])


def _pairs(a, an, b, bn, pct: int) -> pa.RecordBatch:
    m = np.minimum(an, bn) * 100 >= np.maximum(an, bn) * pct
    return _couples(a[m], b[m])


def light_boundary(sets: DataFrame) -> int:
    """The set size up to which enumerating 2-subsets costs least in total (0: never).

    A row to shuffle (a subset, or an entry of an inverted list) costs 1, an entry scanned in a list
    ``SCAN``. Sets within the size ratio of the boundary do both. Both passes shuffle the rows, and the lists of the second one hold every
    subset that members of several components share, so the rows may at most double. The costs are summed per size class on the cluster; at most a
    few hundred sums are fetched."""
    step = F.when(F.col("n") < 64, F.col("n")).otherwise(F.floor(F.pow(F.lit(2.0), F.floor(F.log2(F.col("n").cast("double")) * 8) / 8)))
    p2 = F.least(F.col("p") + 1, F.size("h")).cast("double")
    scans = F.aggregate(F.slice("df", F.lit(1), F.col("p")), F.lit(0.0), lambda s, x: s + x)
    rows = sets.groupBy(step.cast("long").alias("size")).agg(F.sum(p2 * (p2 - 1) / 2).alias("subsets"), F.sum(scans).alias("scans"), F.sum("p").alias("posts")).orderBy("size").collect()
    best, at, most = sum(r["posts"] + SCAN * r["scans"] for r in rows), 0, 2 * sum(r["posts"] for r in rows)
    for i, r in enumerate(rows):
        top = rows[i + 1]["size"] - 1 if i + 1 < len(rows) else r["size"] * 2
        subsets = sum(x["subsets"] for x in rows[: i + 1])
        cost = subsets + sum(x["posts"] + SCAN * x["scans"] for x in rows if x["size"] * 4 > 3 * top)
        if cost < best and subsets <= most:
            best, at = cost, int(top)
    return at


def verified(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """The pairs that link, by exact overlap of their shared tokens."""
    left = sets.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("h").alias("ha"))
    right = sets.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("h").alias("hb"))
    both = F.size(F.array_intersect("ha", "hb"))
    rows = pairs.join(left, "a").join(right, "b").withColumn("both", both)
    return rows.where(F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * pct).select(*pairs.columns)


def components(links: DataFrame) -> DataFrame:
    """Connected components (node, label = smallest node) by label exchange and pointer jumps."""
    links = materialize(links.select("a", "b"), "links")  # read in every round
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    labels = materialize(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")).withColumnRenamed("u", "node"), "labels")
    while True:  # labels only fall, so this ends; in about log2 of the longest path with the jumps
        heard = edges.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("heard"))
        near = labels.join(heard.withColumnRenamed("u", "node"), "node").select("node", F.least("label", "heard").alias("to"), F.col("label").alias("was"))
        jump = near.join(labels.select(F.col("node").alias("to"), F.col("label").alias("next")), "to", "left")
        new = materialize(jump.select("node", F.least("to", F.coalesce("next", "to")).alias("label"), "was"), "labels")
        moved = new.where("label < was").limit(1).count()
        release(labels)
        if not moved:
            release(links)
            return new.select("node", "label")
        labels = new


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component stays (the smallest id, null last), with all columns."""
    keyed = with_row_keys(docs, F.col(id_col).asc_nulls_last(), F.xxhash64(text_col))
    gone = near_components(keyed, ROW, text_col).where("component_id < doc_id").select(F.col("doc_id").alias(ROW)).distinct()
    return without_rows(keyed, gone)
