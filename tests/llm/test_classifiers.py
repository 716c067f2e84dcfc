import math
import random
import zlib
from collections import Counter

import numpy as np

from cairnfield.llm import langid, toxicity

CLEAN = "the and of house river stone light walking under green morning table".split()
BAD = ["idiotic", "trashy", "vile"]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2


def test_toxicity_held_out(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        w = r.choices(CLEAN, k=r.choice([5, 50, 400]))
        y = int(i % 5 == 0)
        if y:
            w[r.randrange(len(w))] = r.choice(BAD)
        rows.append((i, " ".join(w), "x"))
        labels.append((i, 1, y))
    rows += [(1000, None, "x"), (1001, "", "x"), (None, "vile", "x"), (0, rows[0][1], "x"), (1002, "word " * 60_000 + "vile", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    lab = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, lab)).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) and x.held_out == held(x.doc_id) for x in got)
    by = {x.doc_id: x for x in got}
    assert all(by[i].predicted == y for i, _, y in labels if held(i))
    assert by[1002].predicted == 1 and by[1000].predicted == by[1001].predicted == 0
    kept = toxicity.drop_toxic(docs, lab)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {x.doc_id for x in got if not x.predicted}
    none = toxicity.score(docs, toxicity.train(docs, lab.limit(0)))
    assert none.count() == len(rows) and toxicity.score(docs.limit(0), toxicity.train(docs, lab)).count() == 0


def plain_grams(text, orders, bits):
    """Hashed n-grams one by one, in plain integers."""
    c = [ord(x) for x in f" {text.lower()} "]
    out = []
    for k in orders:
        for i in range(len(c) - k + 1):
            h = 0
            for x in c[i : i + k]:
                h = ((h ^ x) * 0x9E3779B1) & 0xFFFFFFFF
                h ^= h >> 15
            out.append((((h + k) * 0x85EBCA6B) & 0xFFFFFFFF) >> (32 - bits))
    return out


def test_scores_equal_plain_python(spark):
    """Scores of fitted models, feature by feature."""
    r = random.Random(6)
    texts = [" ".join(r.choices(CLEAN + BAD * (i % 2), k=r.randrange(1, 40))) for i in range(200)] + ["", "É vile ÑANDÚ", None]
    docs = spark.createDataFrame([(i, t, "xy"[i % 2]) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, int(any(b in (t or "") for b in BAD))) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int")
    m = toxicity.train(docs, labels)
    for x in toxicity.score(docs, m).collect():
        found = {int(m.slot[g]) for g in plain_grams(texts[x.doc_id] or "", toxicity.ORDERS, toxicity.BITS)} - {0}
        want = 1 / (1 + math.exp(-(m.bias + sum(float(m.weight[f]) for f in sorted(found)))))
        assert math.isclose(x.score, want, rel_tol=1e-4)
    m = langid.train(docs)
    for x in langid.identify(docs, m).collect():
        if x.lang_pred == "und":
            continue
        c = Counter(plain_grams(texts[x.doc_id], langid.ORDERS, langid.BITS))
        size = math.sqrt(sum(c.values()))
        bits = [sum(math.sqrt(n) / size * float(m.w[g, j]) for g, n in c.items()) + float(m.b[j]) for j in range(m.code.shape[1])]
        loss = [sum(float(w) * math.log1p(math.exp(-f * int(s))) for f, s, w in zip(bits, row, m.bit_weight, strict=True)) for row in m.code]
        p = [math.exp(min(loss) - v) for v in loss]
        assert x.lang_pred == m.langs[p.index(max(p))] and math.isclose(x.score, max(p) / sum(p), rel_tol=1e-3)


def test_languages_of_a_large_one_and_of_repeated_ids(spark):
    rows = [(i, "der die das und", "de") for i in range(3000)] + [(i, "the and of to", "en") for i in range(9000, 9020)] + [(4000, "der die", "zz"), (4000, "der die", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = langid.train(docs, most=40)
    got = {x.doc_id: x.lang_pred for x in langid.identify(docs, m).collect()}
    assert m.langs == ["aa", "de", "en", "zz"] and got[2999] == "de" and got[9001] == "en"
    assert (langid.train(docs, most=40).w == langid.train(docs.repartition(9), most=40).w).all()


def test_codewords_are_apart():
    for k in (2, 3, 4, 7, 8, 30):
        c = langid.codewords(k).astype(int)
        gap = (c.shape[1] - c @ c.T) // 2 + np.eye(k, dtype=int) * 99
        assert c.shape[0] == k and gap.min() >= (1 if k == 2 else 2)


def test_languages_held_out(spark):
    r = random.Random(3)
    vocab = {v: ["".join(r.choices(a, k=r.randrange(2, 7))) for _ in range(80)] for v, a in (("aa", "abcdeé"), ("bb", "fghijü"), ("cc", "klmnoñ"))}
    rows = [(i, " ".join(r.choices(vocab[v], k=r.choice([3, 30, 300]))), v) for i, v in enumerate(r.choices(list(vocab), k=400))]
    rows += [(900, None, "aa"), (901, "", None), (902, "12 %% 3", "bb"), (None, vocab["cc"][0] * 4, None), (903, "zzz", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'q' as score")
    model = langid.train(docs)
    got = {x.doc_id: x for x in langid.identify(docs, model).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    out = [(i, v) for i, _, v in rows[:400] if held(i)]
    assert np.mean([got[i].lang_pred == v for i, v in out]) > 0.97
    assert got[903].lang_pred in vocab and 0 < got[903].score <= 1
    assert {x.lang_pred for x in langid.identify(docs, langid.train(docs.limit(0))).collect()} == {"und"}
    one = docs.where("lang = 'aa'")
    assert {x.lang_pred for x in langid.identify(one, langid.train(one)).collect()} == {"aa", "und"}
