"""License scans by an exact set-similarity join with templates (built-in functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases whose words must stand consecutively, and their labels (fixed by the contract).
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Opening words of common notices: (label, words in lower case). A parameter of ``scan``.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)

#: What stands between words once A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def joined_words(text: Column) -> Column:
    """The words of a text, lower-cased in A-Z, with one space before, between and after them; '' without words."""
    words = F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower()), GAP, " "))
    return F.when(words == "", F.lit("")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _phrase_columns(words: Column, n_words: Column, phrases) -> list[Column]:
    """n_base, first_word, last_word and base_labels (an array, sorted)."""
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases:
        needle = f" {phrase} "
        has = words.contains(needle)
        back = F.reverse(words)
        after = _spaces(F.substring(back, F.lit(1), F.instr(back, needle[::-1]))) - 1
        counts.append(F.when(has, F.regexp_count(words, F.lit(f"(?={needle})"))).otherwise(F.lit(0)))  # a look-ahead: places may overlap
        firsts.append(F.when(has, _spaces(F.substring(words, F.lit(1), F.instr(words, needle))) - 1))
        lasts.append(F.when(has, n_words - after - len(phrase.split())))
        labels.append(F.when(has, F.lit(label)))
    return [
        sum(counts[1:], counts[0]).cast("long").alias("n_base"), F.array_min(F.array(*firsts)).cast("long").alias("first_word"),
        F.array_max(F.array(*lasts)).cast("long").alias("last_word"), F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("base"),
    ]


def token_order(words: DataFrame, templates) -> list[str]:
    """The distinct tokens of the templates, rarest first: by the number of texts (column ``words``) that hold
    them, ties by the token. Only as many rows as the templates have tokens reach the driver."""
    known = sorted({t for _, text in templates for t in text.split()})
    held = words.select(F.explode(F.array_intersect(F.array(*map(F.lit, known)), F.split("words", " "))).alias("token"))
    count = {r.token: r.n for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}
    return sorted(known, key=lambda t: (count.get(t, 0), t))


def similar_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold: float = 0.9, block: int = 64) -> DataFrame:
    """Every block that holds at least ``threshold`` of a template's distinct tokens: doc_id, text_key (md5 of the
    text's words), start (its first word), label, template (its place in ``templates``), overlap, containment.

    Blocks are ``block`` words long and begin at multiples of half of that, so that any run of ``block`` / 2
    words lies in one of them. The join is exact:

    * tokens have one global order, rarest first; both sides are sorted by it;
    * a template of t tokens that needs an overlap of o shares one of its first t - o + 1 tokens with any
      block it matches, so only those *prefix* tokens are join keys (a table as large as the templates,
      broadcast); only tokens of templates can add to an overlap, so blocks keep only these;
    * *length*: the block keeps at least o such tokens;
    * *position*: the first shared token, at place i of the template and j of the block, leaves at most
      1 + min(t - i - 1, b - j - 1) shared ones. A pair is taken at its first shared token only, so
      pairs come once and need no de-duplication; overlaps are then counted in full.

    A text without a prefix token or with fewer template tokens than any template needs gives no blocks.
    """
    if block < 2 or block % 2 or not 0 < threshold <= 1:
        raise ValueError("block must be even and threshold above 0 and at most 1")
    if any(len(text.split()) > block // 2 for _, text in templates):
        raise ValueError("a template may have half a block's words at most")
    words = docs.select(F.col(id_col).alias("doc_id"), joined_words(F.col(text_col)).alias("words"))
    order = token_order(words, templates)
    place = {t: i for i, t in enumerate(order)}
    rows, least = [], len(order)
    for k, (label, text) in enumerate(templates):
        tokens = sorted(set(text.split()), key=place.get)
        need = math.ceil(threshold * len(tokens) - 1e-9)
        least = min(least, need)
        rows += [(tokens[i], i, label, k, tokens, need) for i in range(len(tokens) - need + 1)]
    names = ("token", "i", "label", "template", "tokens", "need")
    lit = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
    index = docs.sparkSession.range(1).select(F.inline(F.array(*[F.struct(*[lit(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rows])))
    ranked, prefix = (F.array(*map(F.lit, x)) for x in (order, sorted({r[0] for r in rows})))

    own = words.withColumn("words", F.split(F.trim("words"), " ")).withColumn("held", F.array_intersect(ranked, F.col("words")))
    maybe = own.where((F.size("held") >= least) & F.arrays_overlap("held", prefix))
    half = block // 2
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - half - 1, F.lit(0)), F.lit(half))
    blocks = F.transform(starts, lambda s: F.struct(s.alias("start"), F.array_intersect(ranked, F.slice("words", s + 1, F.lit(block))).alias("held")))
    cut = maybe.select("doc_id", F.md5(F.array_join("words", " ").cast("binary")).alias("text_key"), F.explode(blocks).alias("b")).where(F.size("b.held") >= least)
    probes = cut.select("doc_id", "text_key", "b.start", "b.held", F.posexplode("b.held").alias("j", "token"))
    met = probes.join(F.broadcast(index), "token").where(F.size("held") >= F.col("need"))
    bound = 1 + F.least(F.size("tokens") - F.col("i") - 1, F.size("held") - F.col("j") - 1)
    met = met.where((bound >= F.col("need")) & ~F.arrays_overlap(F.slice("tokens", F.lit(1), F.col("i")), "held"))
    overlap = F.size(F.array_intersect("tokens", "held"))
    met = met.withColumn("overlap", overlap).where(F.col("overlap") >= F.col("need"))
    return met.select("doc_id", "text_key", "start", "label", "template", "overlap", (F.col("overlap") / F.size("tokens")).alias("containment"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES, threshold: float = 0.9, block: int = 64) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base labels come from phrases whose words stand consecutively; n_base counts all their places. ``labels`` adds
    those of the templates that a block of the text holds (``similar_blocks``). score is the largest share of a
    template that a block holds, 1 where a phrase stands, 0 without labels. Null and empty texts have no words and
    no labels (''). Rows are met by id (null-safe) and text, so null and repeated ids have their own
    results and repeated rows give one row each. Empty tables give no rows; other columns are not read.
    """
    words = docs.select(F.col(id_col).alias("doc_id"), joined_words(F.col(text_col)).alias("words"))
    n_words = F.greatest(_spaces(F.col("words")) - 1, F.lit(0))
    thin = words.select("doc_id", F.md5(F.trim("words").cast("binary")).alias("text_key"), n_words.cast("long").alias("n_words"), *_phrase_columns(F.col("words"), n_words, phrases))
    found = similar_blocks(docs, id_col, text_col, templates, threshold, block).groupBy("doc_id", "text_key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))  # as many labels as templates at most
    found = found.select(F.col("doc_id").alias("f_id"), F.col("text_key").alias("f_key"), "more", "best")
    rows = thin.join(found, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("text_key") == F.col("f_key")), "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
