import hashlib
import random
import re

from cairnfield.llm.substr import remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, w):
    first = {}
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, x in words:
        for s in range(len(x) - w + 1):
            k = tuple(x[s : s + w])
            first[k] = min(first.get(k, i), i)
    out = {}
    for i, x in words:
        gone = set()
        for s in range(len(x) - w + 1):
            if first[tuple(x[s : s + w])] < i:
                gone |= set(range(s, s + w))
        out[i] = (len(x), len(gone), hashlib.sha256(" ".join(v for j, v in enumerate(x) if j not in gone).encode()).hexdigest())
    return out


def test_equals_brute_force(spark):
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(500)] + ["Ä", "the", "The"]
    passages = [[r.choice(vocab) for _ in range(n)] for n in (49, 50, 51, 75, 130, 400)]
    rows = []
    for i in range(120):
        x = []
        for _ in range(r.randrange(1, 5)):
            x += [r.choice(vocab) for _ in range(r.randrange(0, 90))]
            if r.random() < 0.6:
                p = r.choice(passages)
                a = r.randrange(0, len(p) // 2)
                x += p[a:] if r.random() < 0.5 else p
        rows.append((r.randrange(10**9) if i % 2 else i, r.choice([" ", "\n", " \x0b "]).join(x)))
    rows += [(10**10, "z " * 3000), (10**10 + 1, "z " * 60), (10**10 + 2, None), (10**10 + 3, ""), (10**10 + 4, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "text")
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in remove_repeats(docs).collect()}
    assert got == brute(rows, 50)


def test_null_id_repeats_and_empty(spark):
    t = " ".join(str(i) for i in range(80))
    docs = spark.createDataFrame([(None, t), (4, t), (4, t), (9, t)], "doc_id long, text string")
    got = sorted((x.doc_id or 0, x.n_removed) for x in remove_repeats(docs).collect())
    assert got == [(0, 0), (4, 0), (4, 0), (9, 80)]
    assert remove_repeats(docs.limit(0)).count() == 0


def test_short_repeats_of_two_documents(spark):
    """Each passage is in two documents only, at offsets that no block length divides."""
    r = random.Random(11)
    words = lambda n: [f"v{r.randrange(10**6)}" for _ in range(n)]
    rows = []
    for k in range(240):
        p = words(50 + k % 24)
        for i in (2 * k, 2 * k + 1):
            rows.append((i, " ".join(words(25 * r.randrange(4) + r.randrange(1, 25)) + p + words(r.randrange(60)))))
    want = brute(rows, 50)
    assert sum(x[1] > 0 for x in want.values()) == 240
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_an_id_with_several_texts(spark):
    words = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    shared = words("s", 60)
    rows = [(1, shared), (2, "x y z " + shared), (2, words("o", 80)), (2, shared.replace(" ", "\n")), (3, words("o", 80) + " q"), (3, words("p", 55)), (4, words("p", 55))]
    got = sorted((x.doc_id, x.n_words, x.n_removed) for x in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 60, 0), (2, 60, 60), (2, 63, 60), (2, 80, 0), (3, 55, 0), (3, 81, 80), (4, 55, 55)]
