"""The stages of the pipeline and its run against plain Python, on null and repeated ids too."""

import hashlib
import math
import random
import re
from collections import Counter

import corpus_pipeline
from cairnfield.llm import decontam, toxicity

from .test_decontam_tokens_warc import edits_in_substring, plain
from .test_exact_mixing import fill
from .test_jaccard import shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fixture():
    r = random.Random(12)
    vocab = ["".join(r.choices("abcdefghij", k=r.randrange(3, 9))) for _ in range(900)]
    text = lambda n: " ".join(r.choices(vocab, k=n))
    items = [(1, text(25)), (2, text(40)), (3, None), (None, text(30))]
    rows, toxic = [], {}
    for i in range(160):
        t, y = text(r.choice([3, 20, 60, 120])), int(i % 8 == 0)
        if y:
            t = "vile trashy " + t
        rows.append((i, t, r.choice(["web", "book", "news", None])))
        toxic[i] = y
    clean = [x for x in rows if not toxic[x[0]]]
    rows += [(1000 + k, clean[k][1].replace(" ", "\n", 2), "web") for k in range(12)]  # exact copies
    rows += [(2000 + k, t + " end", "book") for k, t in enumerate(t for _, t, _ in clean if len(t.split()) == 120)]  # near copies
    rows += [(3000 + k, text(20) + " " + items[k % 2][1] + " " + text(9), "news") for k in range(9)]
    rows += [(None, clean[3][1] + " ", "web"), (None, text(50), "web"), (None, text(9) + " " + items[0][1], "web"), (7, text(40), "web"), (9, clean[5][1], "web"), (9, clean[5][1], "web")]
    rows += [(4000, None, "web"), (4001, "", None), (4002, " \n", "book"), (4003, "long " * 9000 + text(30), "web")]
    return rows, [(i, 1, y) for i, y in toxic.items()], items


def last_null(i):
    return (i is None, i or 0)


def exact(rows):
    best = {}
    for x in rows:
        k = re.sub(r"[\x20\x09-\x0D]", "", x[1] or "")
        best[k] = min(best.get(k, x), x, key=lambda y: (-len(y[1] or ""), last_null(y[0])))
    return list(best.values())


def near(rows):
    rows = sorted(rows, key=lambda x: last_null(x[0]))
    sets, root = [shingles(x[1]) for x in rows], list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, s in enumerate(sets):
        for b in range(a):
            if s and sets[b] and 100 * len(s & sets[b]) >= 75 * len(s | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [x for i, x in enumerate(rows) if find(i) == i]


def leaks(t, items):
    return any(i is not None and plain(s) and edits_in_substring(plain(s), plain(t)) <= decontam.budget(len(plain(s))) for i, s in items)


def mixed(rows):
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    targets, out = fill(sizes, (1, 2, 3)), Counter()
    for x in rows:
        rate = targets[x[2]] / sizes[x[2]] if sizes[x[2]] else 0.0
        u = int(hashlib.md5(f"mix:{'' if x[0] is None else x[0]}".encode()).hexdigest()[:13], 16) / 2**52
        n = math.floor(rate) + (u < rate - math.floor(rate))
        if n:
            out[x] += n
    return out


def test_run_and_stages_equal_plain_python(spark, tmp_path):
    rows, labels, items = fixture()
    schema = "doc_id long, text string, source string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = toxicity.train(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    steps = [lambda x: [y for y in x if model.score(y[1]) < 0.3], exact, near, lambda x: [y for y in x if not leaks(y[1], items)], mixed]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "decontamination", "mixing"]
    want, left = rows, docs
    for (_, stage), step in zip(corpus_pipeline.STAGES, steps, strict=True):
        before, want = len(want), step(want)
        left = stage(spark, left, str(tmp_path))
        got = Counter((r.doc_id, r.text, r.source) for r in left.collect())
        assert got == Counter(want) and len(want) < before
        left = spark.createDataFrame(left.select("doc_id", "text", "source").collect(), schema)
    assert Counter((r.doc_id, r.text, r.source) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    schema = "doc_id long, text string, source string, n_copies int, copy_no int, rep int, __gone string, __r int, __salt int"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.createDataFrame([(1, "a b c", "s", 5, 6, 7, "g", 8, 9), (2, "a b d", "s", 5, 6, 7, "g", 8, 9)], schema)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "mixing":
            assert docs.columns == ["doc_id", "text", "source", "n_copies", "copy_no", "rep", "__gone", "__r", "__salt"]
    assert docs.columns[-2:] == ["n_copies_", "copy_no_"] and docs.where("n_copies = 5 and copy_no = 6 and copy_no_ = 1").count() == 2
