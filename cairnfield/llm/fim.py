"""Fill-in-middle transformation by an event scan with one Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructType

SENTINELS = ("<P>", "<S>", "<M>")

_CUT = "__cairnfield_cut"
_RISE, _FALL, _SENTINEL = 0, 1, 2


def _classes() -> np.ndarray:
    """Character classes by code point: letters are 'a' and others 'n', but for those of the sentinels, which stand for themselves."""
    out = np.full(129, ord("n"), np.uint8)  # 128: all that is not ASCII
    out[65:91] = out[97:123] = ord("a")
    for c in "".join(SENTINELS):
        out[ord(c)] = ord(c)
    return out


_CLASS = _classes()


def automaton() -> ahocorasick.Automaton:
    """Finds where a run of letters begins (a non-letter, then a letter), where it ends, and sentinels."""
    letters = "a" + "".join(c for s in SENTINELS for c in s if c.isalpha())
    others = "n<>"
    found = ahocorasick.Automaton()
    for a in letters:
        for n in others:
            found.add_word(n + a, _RISE)
            found.add_word(a + n, _FALL)
    for s in SENTINELS:
        found.add_word(s, _SENTINEL)
    found.make_automaton()
    return found


class Events:
    """The runs of letters of a text and whether a sentinel stands in it.

    Units are runs of ASCII letters and single other characters. Between two events units are counted
    by arithmetic: a run is one unit, a gap has as many as characters."""

    def __init__(self, text: str, found: ahocorasick.Automaton):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        classes = "n" + _CLASS[np.minimum(points, 128)].tobytes().decode("ascii") + "n"
        events = np.fromiter((4 * at + kind for at, kind in found.iter(classes)), np.int64)
        kind, at = events & 3, (events >> 2) - 1  # one character stands before the text
        self.size = len(points)
        self.sentinel = bool((kind == _SENTINEL).any())
        self.start, self.end = at[kind == _RISE], at[kind == _FALL]
        letters = np.concatenate([[0], np.cumsum(self.end - self.start)])
        #: Units before each run.
        self.rank = self.start - letters[:-1] + np.arange(len(self.start))
        self.units = int(self.size - letters[-1] + len(self.start))

    def offset(self, k: int) -> int:
        """Code points before unit ``k`` (0 to ``units``)."""
        r = int(np.searchsorted(self.rank, k))
        return k if r == 0 else int(self.end[r - 1] + k - self.rank[r - 1] - 1)


@F.pandas_udf(StructType().add("n", LongType()).add("sentinel", BooleanType()).add("prefix_end", IntegerType()).add("middle_end", IntegerType()))
def _cuts(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    found = automaton()
    for texts, one, two in parts:
        rows = []
        for text, h1, h2 in zip(texts, one, two, strict=True):
            e = Events(text, found)
            a, b = sorted((int(h1) % (e.units + 1), int(h2) % (e.units + 1)))
            rows.append((e.units, e.sentinel, e.offset(a), e.offset(b)))
        yield pd.DataFrame(rows, columns=["n", "sentinel", "prefix_end", "middle_end"])


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", plain: int = 10, spm: int = 20) -> DataFrame:
    """``docs`` with n (units), form (plain, psm or spm), prefix_end, middle_end (code points) and output.

    Units are runs of ASCII letters and single other characters. h1 to h4 are the first four 8-digit groups of
    sha256("seed:id"); the prefix ends after the smaller of h1 and h2 modulo n + 1 units, the middle after the
    larger. ``plain`` in 100 texts stay as they are (by h3), and so do empty ones and those that hold a
    sentinel; of the others ``spm`` in 100 (by h4) put the suffix first. Spans are null for plain texts. Nulls: a null text is
    empty, a null id is hashed as ''. Repeated rows have equal results; empty tables give no rows. All columns of ``docs`` stay,
    but for ones named as the new columns are, which are replaced.
    """
    sha = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring(sha, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = docs.withColumn(_CUT, F.struct(_cuts(text, h[0], h[1]).alias("c"), h[2].alias("h3"), h[3].alias("h4"), text.alias("text")))
    c, text = F.col(f"{_CUT}.c"), F.col(f"{_CUT}.text")
    form = F.when((text == "") | c.sentinel | (F.col(f"{_CUT}.h3") % 100 >= 100 - plain), F.lit("plain")).when(F.col(f"{_CUT}.h4") % 100 < spm, F.lit("spm")).otherwise(F.lit("psm"))
    kept = F.col("form") != "plain"
    out = cut.withColumns({"n": c.n, "form": form})
    out = out.withColumns({"prefix_end": F.when(kept, c.prefix_end), "middle_end": F.when(kept, c.middle_end)})
    prefix = F.substring(text, F.lit(1), F.col("prefix_end"))
    middle = F.substring(text, F.col("prefix_end") + 1, F.col("middle_end") - F.col("prefix_end"))
    suffix = F.substring(text, F.col("middle_end") + 1, F.length(text))
    p, s, m = map(F.lit, SENTINELS)
    psm, spm_ = F.concat(p, prefix, s, suffix, m, middle), F.concat(s, suffix, p, prefix, m, middle)
    return out.withColumn("output", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm_).otherwise(text)).drop(_CUT)


def restore(output: Column, form: Column) -> Column:
    """The text that ``transform`` was given. Sentinels in an output that isn't plain stand only where it put them."""
    part = F.split(output, "|".join(SENTINELS), -1)
    psm, spm = F.concat(part[1], part[3], part[2]), F.concat(part[2], part[3], part[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
