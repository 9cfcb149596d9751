"""The thin queries over the operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chunk_dedup, langid, lm, media, mixing, near_dup, packing, quality, suffix_dedup, toxicity
from .sources import table, tokenizer_path


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.repeats(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_minhash_near_dedup, op2_toxicity, op3_suffix_array_dedup, op4_packing, op5_language_id, op6_mixing, op7_media_columns, op8_lm_scoring, op9_substring_dedup, op10_quality_rules)}

ORACLES = {
    "op1_minhash_near_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ') || ' ' || len(w)] ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, l.c AS component_id, d.doc_id = l.c AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN least l ON l.a = d.doc_id""",
    "op6_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (('0x' || substr(md5('20240229:' || coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, '')))), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM documents),
graded AS (SELECT *, length(bin(size)) AS grade FROM sized),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, 1.0::DOUBLE + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 AS weight, 3.0::DOUBLE * source_size AS cap FROM sources),
ahead AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS unit
  FROM weighed WINDOW w AS (ORDER BY cap / weight, weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (
  SELECT source, source_size, CASE WHEN unit * weight >= cap THEN cap ELSE (SELECT arg_min(unit, cap / weight) FROM ahead WHERE unit * weight < cap) * weight END AS target FROM ahead),
grades AS (
  SELECT g.source, g.grade, o.source_size, o.target, g.words,
    (o.target - 3 * coalesce(sum(g.words) OVER (PARTITION BY g.source ORDER BY g.grade DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
      / nullif((sum(g.words * g.grade) OVER (PARTITION BY g.source ORDER BY g.grade DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT, 0) AS factor
  FROM (SELECT source, grade, sum(size)::BIGINT AS words FROM graded GROUP BY source, grade) g JOIN goal o ON g.source IS NOT DISTINCT FROM o.source),
going AS (SELECT source, max(grade) AS top, arg_max(factor, grade) AS factor FROM grades WHERE NOT coalesce(factor * grade >= 3, false) AND factor IS NOT NULL GROUP BY source),
due AS (
  SELECT r.source, r.grade, r.source_size, r.target, r.words,
    least(greatest(CASE WHEN r.grade > coalesce(g.top, 0) THEN 3.0::DOUBLE ELSE g.factor * r.grade END, 0), 3.0::DOUBLE) AS due
  FROM grades r LEFT JOIN going g ON r.source IS NOT DISTINCT FROM g.source),
certain AS (SELECT *, floor(due + 1e-6)::BIGINT AS whole, CASE WHEN due - floor(due + 1e-6) > 1e-6 THEN due - floor(due + 1e-6) ELSE 0 END AS p FROM due),
lacks AS (SELECT source, greatest(any_value(target) - sum(whole * words)::BIGINT, 0) AS lack FROM certain GROUP BY source),
ranked AS (
  SELECT d.doc_id, d.size, c.source, c.source_size, c.target, c.whole, c.p, l.lack,
    CASE WHEN c.p > 0 THEN (d.u / (1 - d.u)) / (c.p / (1 - c.p)) END AS odds
  FROM graded d JOIN certain c ON d.source IS NOT DISTINCT FROM c.source AND d.grade = c.grade JOIN lacks l ON d.source IS NOT DISTINCT FROM l.source),
placed AS (
  SELECT *, sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY odds NULLS LAST, doc_id NULLS FIRST, size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(size) OVER (PARTITION BY source, odds, doc_id, size) AS tied FROM ranked)
SELECT doc_id, size, source_size, target,
  (CASE WHEN size = 0 THEN 0 ELSE least(whole + (p > 0 AND upto - tied / 2 <= lack)::INT, 3) * size END)::BIGINT AS taken FROM placed""",
}
