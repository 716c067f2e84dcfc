import hashlib
import re

import pytest
from pyspark.sql import functions as F

from cairnfield.llm import fim

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)
TEXTS = ["", None, "a", " ", "ab cd, ef", "étude No. 7\n\n", "你好 world \U0001f600\U0001f600x", "x<P>y", "<S>", "a<M", "<<P", "<P <S <M >", "Z" * 300, "<" * 50, "\x00a\x00", "tail <", "PSM<>PSM", "mid <S dle S> M>", "word " * 30_000]


def brute(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = UNIT.findall(text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in fim.SENTINELS) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(p), len(p) + len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(p) + len(m), f"<P>{p}<S>{s}<M>{m}"


def test_transform_equals_brute_force_and_restores(spark):
    rows = [(i * 31 + j, t) for i, t in enumerate(TEXTS[:-1]) for j in range(20)] + [(None, "a b"), (None, None), (4, TEXTS[-1]), (5, "q w"), (5, "q w"), (-(2**63), "e r t")]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, form string, h3 int")
    out = fim.transform(docs)
    assert set(out.columns) == {"doc_id", "text", "h3", "n", "form", "prefix_end", "middle_end", "output"}
    got = out.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_end, r.middle_end, r.output) for r in got), key=repr) == sorted((brute(*r) for r in rows), key=repr)
    assert all(r.back == (r.text or "") for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.transform(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", [t for t in TEXTS if t])
def test_every_rank_of_the_event_scan(text):
    text = text[:2000]
    e, units = fim.Events(text, fim.automaton()), UNIT.findall(text)
    assert e.units == len(units) and e.sentinel == any(s in text for s in fim.SENTINELS)
    at = 0
    for k, u in enumerate(units):
        assert e.offset(k) == at
        at += len(u)
    assert e.offset(len(units)) == len(text)
