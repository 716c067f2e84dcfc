import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cairnfield.llm.lm import DISCOUNT, STEPS, EliasFano, Trie, score

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(t):
    return [*WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), None]


def test_elias_fano_round_trip():
    r = np.random.default_rng(3)
    for n, top in ((0, 5), (1, 1), (1000, 10), (1000, 10**7), (5000, 5000), (700, 2**50)):
        v = np.sort(r.integers(0, top, n))
        ef = EliasFano.build(v)
        assert (ef.access(np.arange(n)) == v).all()
        if n:
            x = r.integers(0, top + 2, 300)
            z = np.zeros(300, np.int64)
            assert (ef.successor(z, z + n, x) == np.searchsorted(v, x)).all()


def test_trie_equals_plain_discounting():
    r = np.random.default_rng(4)
    seen = Counter((int(a), int(b), int(c)) for a, b, c in r.integers(1, 8, (300, 3)))
    keys = sorted(seen, key=lambda k: (k[1], k[0], k[2]))
    root, ends = np.array([k[1] for k in keys], np.uint64), np.array([(k[0] << 32) | k[2] for k in keys], np.uint64)
    trie = Trie(np.frombuffer(Trie.build(root, ends, np.array([seen[k] for k in keys])), np.uint8))
    ask = [(a, b, c) for a in range(10) for b in range(10) for c in range(10)]
    got = np.stack(trie.parts_of(np.array([k[1] for k in ask], np.uint64), np.array([(k[0] << 32) | k[2] for k in ask], np.uint64)), 1)
    known = index(seen)
    for (x, y, z), (a, b) in zip(ask, got, strict=True):
        want = parts(*known, x, y, z)
        assert abs(a - want[0]) <= 0.04 * want[0] and abs(b - want[1]) <= 0.04 * want[1]


def index(seen):
    """Counts of last words by middle word, and by (first, middle) words."""
    two, three = defaultdict(Counter), defaultdict(Counter)
    for (i, j, k), c in seen.items():
        two[j][k] += c
        three[i, j][k] += c
    return two, three


def parts(two, three, x, y, z):
    """P(z | x, y) = a + b P(z), straight from the counts."""
    a, b = 0.0, 1.0
    for ctx in (two.get(y), three.get((x, y))):
        if ctx:
            n = sum(ctx.values())
            w = DISCOUNT * len(ctx) / n
            a, b = max(ctx[z] - DISCOUNT, 0) / n + w * a, w * b
    return a, b


@pytest.mark.parametrize("shard_tokens", [1_500_000, 1000])
def test_equals_brute_force(spark, shard_tokens):
    r = random.Random(1)
    vocab = [f"w{i}" for i in range(300)]

    def text(k):  # a word is followed by one of four
        w = [r.randrange(300)]
        while len(w) < k:
            w.append((w[-1] * 7 + r.randrange(4)) % 300)
        return " ".join(vocab[x] for x in w[:k]).title()

    rows = [(i, text(r.randrange(0, 80))) for i in range(400)] + [(900, None), (901, ""), (None, "w1 zzz"), (902, "q" * 5000), (903, "W1 w1 " * 900), (904, "w1 w9 " * 90), (5, text(9)), (5, text(9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as c", "'x' as word", "3 as block")
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    train = [tokens(t) for i, t in rows if not held(i)]
    c = Counter(x for w in train for x in w)
    n, v = sum(c.values()), len(c)
    got = sorted(((x.doc_id or -1, x.n_tokens, x.base_score), x) for x in score(docs, block_bytes=4000, shard_tokens=shard_tokens).collect())
    assert len(got) == len(rows)
    seen, cache = Counter(), {}
    for w in train:
        seen.update(zip(["<", "<", *w], ["<", *w], w))
    pairs = index(seen)
    want = []
    for i, t in rows:
        w = tokens(t)
        base, total = sum(math.log10((c[k] + 0.5) / (n + 0.5 * (v + 1))) for k in w), 0.0
        if shard_tokens > n:  # no word is split
            for k in zip(["<", "<", *w], ["<", *w], w):
                if k not in cache:
                    a, b = parts(*pairs, *k)
                    s = max(1.0, math.sqrt(n))
                    cache[k] = math.log10(a + b * (c[k[2]] or s) / (n + s))
                total += cache[k]
        want.append(((i or -1, len(w), base), (held(i), len(w), sum(c[k] > 0 for k in w), total)))
    for ((i, m, base), x), ((j, _, base_), (h, m_, known, total)) in zip(got, sorted(want), strict=True):
        assert (i, m, x.held_out, x.n_known, x.train_tokens) == (j, m_, h, known, n)
        assert math.isclose(base, base_, rel_tol=1e-9)
        assert x.score <= 0.01 * m
        if shard_tokens > n:
            assert abs(x.score - total) <= 2 * m / STEPS
    out = [x for _, x in got if x.held_out]
    assert sum(x.score for x in out) > sum(x.base_score for x in out)


def test_empty_and_held_out_only(spark):
    docs = spark.createDataFrame([(i, f"a b {i}") for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1], "doc_id long, text string")
    got = score(docs).collect()
    assert len(got) == docs.count() and all((x.n_known, x.train_tokens, x.base_score) == (0, 0, 0.0) for x in got)
    assert score(docs.limit(0)).count() == 0
