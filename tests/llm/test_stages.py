"""The stages of the pipeline on null and repeated ids whose rows have different texts."""

from collections import Counter

from cairnfield.llm.decontam import drop_leaks
from cairnfield.llm.exact import drop_copies
from cairnfield.llm.jaccard import drop_near
from cairnfield.llm.mixing import emit, mix

SCHEMA = "doc_id long, text string, source string"


def words(n, k):
    return " ".join(f"w{n}x{i}" for i in range(k))


def kept(df):
    return sorted((r.doc_id or 0, r.text) for r in df.collect())


def test_exact(spark):
    rows = [(None, "a b", "s"), (3, "ab", "s"), (None, "own", "s"), (None, "twin", "s"), (None, "twin", "s"), (5, "ab ", "s"), (5, "five", "s"), (8, "same", "s"), (8, "same", "s"), (9, "z", "s"), (2, "z", "s")]
    got = kept(drop_copies(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    # 'ab ' is as long as 'a b', which has no id
    assert got == [(0, "own"), (0, "twin"), (2, "z"), (5, "ab "), (5, "five"), (8, "same")]
    assert drop_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_near(spark):
    one, two = words(1, 60), words(2, 60)
    rows = [(None, one, "s"), (None, one + " end", "s"), (None, words(3, 60), "s"), (7, two, "s"), (7, words(4, 60), "s"), (4, two + " end", "s"), (None, None, "s"), (6, words(5, 60), "s"), (6, words(5, 60), "s")]
    got = kept(drop_near(spark.createDataFrame(rows, SCHEMA)).where("text is not null"))
    ones = [x for x in got if x[1].startswith(one)]
    assert len(ones) == 1 and ones[0][0] == 0
    assert [x for x in got if x not in ones] == sorted([(0, words(3, 60)), (4, two + " end"), (6, words(5, 60)), (7, words(4, 60))])


def test_leaks(spark):
    item = words(9, 30)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, "x " + item, "s"), (None, "clean null", "s"), (3, item + " y", "s"), (3, "clean three", "s"), (4, None, "s")]
    got = drop_leaks(spark.createDataFrame(rows, SCHEMA), bench).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, "clean null"), (3, "clean three"), (4, "")]


def test_mixing(spark):
    rows = [(i, "w " * 9, "ab"[i % 10 == 0]) for i in range(200)] + [(i, "v", "b") for i in range(50)] + [(None, "n", "a"), (None, "m", "b")]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = Counter()
    for r in mix(docs).collect():
        want[r.doc_id, r.source] += r.copies
    got = Counter((r.doc_id, r.source) for r in emit(docs).collect())
    assert got == +want
