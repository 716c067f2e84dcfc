"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, decontam, exact, fim, jaccard, langid, licenses, lm, mixing, substr, tokens, toxicity, warc
from .textkit import read


#: Default vocabulary of op6; a parameter of the query function.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_components(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(read(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return warc.lookup(spark, warc.write_archive(pages), pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_token_counts(spark: SparkSession, sf_dir: str, model_file: str = TOKENIZER) -> DataFrame:
    return tokens.count_tokens(read(spark, sf_dir, "documents"), tokens.unigram_pieces(model_file))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substr.remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op11_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim.transform(read(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select(
        "doc_id", "n", "form", F.col("prefix_end").cast("long").alias("prefix_chars"), (F.col("middle_end") - F.col("prefix_end")).cast("long").alias("middle_chars"),
        digest(F.col("output")).alias("output_sha256"), digest(fim.restore(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = centroids.cluster(read(spark, sf_dir, "embeddings"))
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256).alias("centroid_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_toxicity": op2_toxicity,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_warc": op4_warc,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_decontamination": op7_decontamination,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_language_id": op9_language_id,
    "op10_mixing": op10_mixing,
    "op11_license_scans": op11_license_scans,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_centroid_clustering": op13_centroid_clustering,
}

OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, k AS keep_id, group_size, doc_id IS NOT DISTINCT FROM k AS kept, text_sha256
FROM (SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
             first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id) AS k
      FROM d)
"""

OP10_SQL = r"""
WITH s AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
t AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS w, 3.0::DOUBLE * source_size AS cap
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source)),
c AS (
  SELECT *, sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER before, 0) AS left_size,
         sum(w) OVER ()::DOUBLE - coalesce(sum(w) OVER before, 0) AS left_weight
  FROM t WINDOW before AS (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (
  SELECT source, source_size,
         least(cap, w * max(CASE WHEN cap * left_weight > w * left_size THEN left_size / left_weight END) OVER ()) AS target FROM c),
r AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies
FROM (SELECT *, floor(rate)::BIGINT + (CASE WHEN ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE
                                                 < rate - floor(rate) THEN 1 ELSE 0 END) AS copies FROM r)
"""

OP4_SQL = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM f
"""



def _op11_sql(threshold: float = 0.9, block: int = 64) -> str:
    """All templates against all blocks, by counting."""
    templates = ", ".join(f"('{label}', {sorted(set(text.split()))!r})" for label, text in licenses.TEMPLATES)
    phrases = ", ".join(f"('{label}', {phrase.split()!r})" for phrase, label in licenses.PHRASES)
    return rf"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
phrase(label, p) AS (VALUES {phrases}),
template(label, t) AS (VALUES {templates}),
places AS (
  SELECT r, label, i - 1 AS place FROM (SELECT r, words, unnest(range(1, len(words) + 1)) AS i FROM w), phrase WHERE words[i] = p[1] AND words[i:i + len(p) - 1] = p),
base AS (
  SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list(DISTINCT label)) AS base FROM places GROUP BY r),
blocks AS (
  SELECT r, words[s + 1:s + {block}] AS b FROM (SELECT r, words, unnest(range(0, greatest(len(words) - {block // 2}, 1), {block // 2})) AS s FROM w)),
met AS (
  SELECT r, label, len(list_intersect(t, b)) / len(t)::DOUBLE AS share FROM blocks, template WHERE len(list_intersect(t, b)) >= ceil({threshold} * len(t) - 1e-9)),
more AS (SELECT r, list(DISTINCT label) AS labels, max(share) AS best FROM met GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(base, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(base, labels))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN more USING (r)
"""


OP12_SQL = r"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (
  SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS k1, ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS k2,
         ('0x' || h[17:24])::BIGINT % 100 AS k3, ('0x' || h[25:32])::BIGINT % 100 AS k4 FROM u),
f AS (
  SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR k3 >= 90 THEN 'plain' WHEN k4 < 20 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(units[1:least(k1, k2)], '') AS p, array_to_string(units[least(k1, k2) + 1:greatest(k1, k2)], '') AS m, array_to_string(units[greatest(k1, k2) + 1:], '') AS s FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM f
"""


def _op13_sql(rounds: int = 10, k: int = 8) -> str:
    """Lloyd's rounds on all vectors, one after the other."""
    near = lambda n: f"""a{n} AS MATERIALIZED (
  SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d
  FROM (SELECT r, c, list_sum(list_transform(list_zip(q, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{n}) GROUP BY r)"""  # noqa: E731
    step = lambda n: f"""c{n + 1} AS MATERIALIZED (
  SELECT c{n}.c, coalesce(m{n}.m, c{n}.m) AS m
  FROM c{n} LEFT JOIN (SELECT c, list(mean ORDER BY i) AS m FROM (
    SELECT c, i, ((sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*))::BIGINT AS mean
    FROM (SELECT c, unnest(q) AS x, unnest(range(64)) AS i FROM v JOIN a{n} USING (r)) GROUP BY c, i) GROUP BY c) m{n} ON m{n}.c = c{n}.c)"""  # noqa: E731
    chain = ",\n".join(x for n in range(rounds) for x in (near(n), step(n)))
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q AS m FROM (SELECT sha256('3:' || coalesce(vec_id::VARCHAR, '')) AS h, q FROM v ORDER BY h, q LIMIT {k})),
{chain},
{near(rounds)}
SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM v JOIN a{rounds} USING (r) JOIN c{rounds} USING (c)
"""


SQL: dict[str, str] = {
    "op4_warc": OP4_SQL, "op5_exact_dedup": OP5_SQL, "op10_mixing": OP10_SQL,
    "op11_license_scans": _op11_sql(), "op12_fill_in_middle": OP12_SQL, "op13_centroid_clustering": _op13_sql(),
}
