import math
import re

from cairnfield.llm import licenses

GAP = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text, templates=licenses.TEMPLATES, threshold=0.9, block=64):
    words = GAP.findall((text or "").translate(UPPER))
    places, base = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        own = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += own
        base |= {label} if own else set()
    labels, best = set(base), 0.0
    for s in range(0, max(len(words) - block // 2, 1), block // 2):
        held = set(words[s : s + block])
        for label, t in templates:
            share = len(held & set(t.split())) / len(set(t.split()))
            if len(held & set(t.split())) >= math.ceil(threshold * len(set(t.split())) - 1e-9):
                labels.add(label)
                best = max(best, share)
    join = lambda x: ",".join(sorted(x))
    return len(words), len(places), min(places, default=None), max(places, default=None), join(base), join(labels), 1.0 if places else best


def texts():
    mit, bsd = licenses.TEMPLATES[7][1], licenses.TEMPLATES[1][1]
    filler = " ".join(f"w{i}" for i in range(50))
    return [
        None, "", " \t\n", "...", "CC BY", "cc by cc by-nc 4.0, cc-by", "ACC BY", "ccé by", "all rights reserved. All   rights\nRESERVED", "all rights", "gnu General Public License general public license",
        f"{filler} {mit} {filler}", f"{filler} {mit.replace('granted', 'given')} {filler}", f"{filler} {' '.join(reversed(bsd.split()))}", f"{bsd[: len(bsd) // 2]} {filler} {filler} {bsd[len(bsd) // 2 :]}",
        "Released under the MIT license.", "released under the apache license", "kK cc by \U0001f600 cc by", "x " * 40_000 + "released under the mit license " + "y " * 31,
    ]


def test_scan_equals_brute_force(spark):
    rows = [(i if i % 5 else None, t) for i, t in enumerate(texts())] + [(7, "cc by"), (7, "cc by"), (None, None)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, labels string, words int")
    got = sorted(map(tuple, licenses.scan(docs).collect()), key=repr)
    assert got == sorted([(i, *brute(t)) for i, t in rows], key=repr)
    assert licenses.scan(docs.limit(0)).count() == 0


def test_other_thresholds_and_small_blocks(spark):
    templates = (("a", "one two three four"), ("b", "two four six eight"), ("c", "one"))
    words = ["one", "two", "three", "four", "six", "eight", "nine"]
    rows = [(i, " ".join(words[(i * k + k * k) % 7] for k in range(i % 23))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for threshold in (0.25, 0.5, 0.75, 1.0):
        got = {r.doc_id: r.labels for r in licenses.scan(docs, templates=templates, threshold=threshold, block=8).collect()}
        assert got == {i: brute(t, templates, threshold, 8)[5] for i, t in rows}


def test_pairs_come_once_and_no_python_runs(spark):
    docs = spark.createDataFrame([(1, "released under the mit license " * 3)], "doc_id long, text string")
    got = licenses.similar_blocks(docs).collect()
    assert [(r.start, r.label, r.overlap, r.containment) for r in got] == [(0, "mit", 5, 1.0)]
    plan = licenses.scan(spark.range(1).selectExpr("id AS doc_id", "'cc by' AS text"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|ExistingRDD|Cartesian|NestedLoop", plan)
