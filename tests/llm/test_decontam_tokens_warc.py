import hashlib
import random

import pytest

from cairnfield.llm import decontam, tokens, warc


def edits_in_substring(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def plain(t):
    return " ".join((t or "").lower().split())


def test_decontamination_equals_brute_force(spark):
    r = random.Random(8)
    words = ["".join(r.choices("abcdefgh", k=r.randrange(2, 8))) for _ in range(200)]
    items = [(i, " ".join(r.choices(words, k=n)).capitalize() + ".") for i, n in enumerate([3, 5, 12, 20, 40, 60])] + [(90, ""), (91, None), (92, "Zq!"), (None, "lost")]
    rows = []
    for i in range(90):
        t = " ".join(r.choices(words, k=r.randrange(0, 120)))
        if r.random() < 0.7:
            x = list(r.choice(items[:6])[1])
            for _ in range(int(r.choice([0, 0.02, 0.05, 0.078, 0.09, 0.15]) * len(x))):
                k = r.randrange(len(x))
                x[k : k + 1] = r.choice([[], ["z"], [x[k], "y"]])
            t = t[:50] + "\n" + "".join(x) + " " + t[50:]
        rows.append((i, t))
    rows += [(500, None), (501, ""), (502, "see zQ! here"), (None, items[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as item_id")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: x for x in decontam.contamination(docs, bench).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want = []
        for k, s in items:
            p = plain(s)
            if k is not None and p and edits_in_substring(p, plain(t)) <= decontam.budget(len(p)):
                want.append(k)
        if i is not None:
            assert (got[i].item_ids, got[i].contaminated) == (want, bool(want)), i
    kept = decontam.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == sorted(i for i, _ in rows if i is not None and not got[i].contaminated)  # the null id leaks
    assert decontam.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.contamination(docs.limit(0), bench).count() == 0


def test_trie_is_shared_over_batches():
    c = tokens.Counter({"▁t": -1.0, "he": -1.5, "▁the": -2.0, "s": -3.0, "is": -3.5})
    c.insert({"▁the"})
    made, n = [], len(c.best)
    forward = c.forward
    c.forward = lambda w, i, path: made.append(w[:i]) or forward(w, i, path)
    c.insert({"▁thesis", "▁the", "▁them"})
    assert sorted(made) == ["▁them", "▁thes", "▁thesi", "▁thesis"] and len(c.best) == n + 4
    assert c.terminal["▁the"] == 1 and c.terminal["▁thesis"] == viterbi(c, "▁thesis") and c.terminal["▁them"] == viterbi(c, "▁them")


def viterbi(c, w):
    best = [(0.0, 0)]
    for i in range(1, len(w) + 1):
        nb = len(w[i - 1].encode())
        s, n = best[i - 1][0] + nb * c.byte, best[i - 1][1] + nb
        for j in range(i - 1, -1, -1):
            p = c.scores.get(w[j:i])
            if p is not None and best[j][0] + p >= s:
                s, n = best[j][0] + p, best[j][1] + 1
        best.append((s, n))
    return best[-1][1]


def test_token_counts_equal_plain_dp(spark):
    scores = tokens.unigram_pieces("/opt/tokenizers/piece_bpe_32k.model")
    r = random.Random(9)
    words = ["the", "thesis", "theses", "Ärger", "日本語", "naïve", "a" * 300, "🙂x"] + ["".join(r.choices("etaoinshr", k=r.randrange(1, 14))) for _ in range(300)]
    rows = [(i, " ".join(r.choices(words, k=r.randrange(0, 60)))) for i in range(60)] + [(None, "the"), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as n_tokens")
    c = tokens.Counter(scores)
    want = sorted((i or 0, len((t or "").split()), sum(viterbi(c, tokens.MARK + w) for w in (t or "").split())) for i, t in rows)
    assert sorted((x.doc_id or 0, x.n_words, x.n_tokens) for x in tokens.count_tokens(docs, scores).collect()) == want
    assert tokens.count_tokens(docs.limit(0), scores).count() == 0


URLS = {
    "https://blog.Example.com:8080/a?b=1#top": "com,example,blog)/a?b=1", "http://www.x.org": "org,x)/", "x.org/y": "org,x)/y", None: ")/", "http://u:p@h.de/": "de,h)/",
    " http://a/x y\n": "a)/x%20y", "http://a/x\tq": "a)/x%09q", "http://www2.a.b?q": "b,a)?q", "": ")/",
}


def test_surt(spark):
    docs = spark.createDataFrame([(u, k) for u, k in URLS.items()], "u string, k string")
    assert [r for r in docs.select("u", "k", warc.surt(docs.u).alias("got")).collect() if r.got != r.k] == []


def test_warc_round_trip_and_lookup(spark, tmp_path):
    r = random.Random(4)
    bodies = ["".join(r.choices("ab<>é \r\n", k=n)) for n in (0, 20, 300, 5000)] + ["x" * 3_000_000, None]
    rows = [(i, f"http://h{i % 9}.example.org/p{i % 50}", r.choice(bodies) if i % 3 else f"page {i} " * 20) for i in range(700)]
    rows += [(None, "http://n.org/", bodies[3]), (701, None, bodies[3]), (5, rows[5][1], rows[5][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' as digest")
    path = warc.write_archive(pages, str(tmp_path / "a"))
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    want = []
    for i, u, h in rows:
        raw = (h or "").encode()
        f = first.get(h) if i is not None and len(raw) >= 100 else None
        f = None if f == i else f
        want.append((str(i), len(raw), hashlib.sha256(raw).hexdigest(), "response" if f is None else "revisit", f))
    got = warc.read_archive(spark, path).collect()
    key = lambda t: tuple(map(str, t))
    assert sorted(map(key, ((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in got))) == sorted(map(key, want))
    asked = [rows[0][1], rows[123][1], rows[0][1], "http://h3.example.org/none", "http://a.org/", None, "http://zz.zz/"]
    hits = warc.lookup(spark, path, spark.createDataFrame([(u,) for u in asked], "url string")).collect()
    assert sorted(str(h.page_id) for h in hits) == sorted(str(i) for i, u, _ in rows if u in asked)
    everything = warc.lookup(spark, path, pages).collect()
    assert sorted(map(key, everything)) == sorted(map(key, got))
    none = warc.write_archive(pages.limit(0), str(tmp_path / "b"))
    assert warc.read_archive(spark, none).count() == 0 and warc.lookup(spark, none, pages).count() == 0


def test_lookup_of_urls_with_blanks(spark, tmp_path, monkeypatch):
    """Blanks are escaped before the keys are sorted; many blocks and rows, one key over several blocks."""
    monkeypatch.setattr(warc, "LINES", 4)
    monkeypatch.setattr(warc, "CHUNK", 900)
    urls = [f"http://a/x{c}{q}" for c in (" ", "!", '"', "#", "\t", "$", "%20", "") for q in "yzq1"] * 3 + ["http://b/"] * 30
    pages = spark.createDataFrame([(i, u, f"body {i} " * 30) for i, u in enumerate(urls)], "page_id long, url string, html string").repartition(7)
    path = warc.write_archive(pages, str(tmp_path / "c"))
    keys = {r.url: r.k for r in pages.select("url", warc.surt(pages.url).alias("k")).distinct().collect()}
    for u in ("http://a/x!z", 'http://a/x"q', "http://a/x$1", "http://a/x y", "http://b/", "http://a/x#y"):
        got = warc.lookup(spark, path, spark.createDataFrame([(u,)], "url string")).collect()
        assert sorted(r.page_id for r in got) == [i for i, x in enumerate(urls) if keys[x] == keys[u]]
