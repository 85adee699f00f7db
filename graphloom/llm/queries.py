"""The registered query of every operator here, by its contract, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import alignment, decontaminate, filter_audit, html_extract, license_scan, line_dedup, ngram_join, packing, quality_classifier, quality_rules, simhash_join, suffix_dedup, token_binary
from graphloom.llm.common import table
from graphloom.llm.word_ids import vocabulary
from graphloom.storage import own_dir


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_extract.extract(table(spark, sf_dir, "pages"))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "page.title", "page.text", F.length("page.text").cast("long").alias("n_chars"))


def op2_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{own_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_binary.write_tokens(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), 2)
    return token_binary.read_tokens(spark, path).drop("ids")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each match in a document."""
    docs = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.inline("licenses"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "repeats.n_bytes", "repeats.n_removed", "repeats.n_spans", F.sha2("repeats.kept", 256).alias("kept_sha256"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lines.n_lines", "lines.n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = quality_rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost_lines", "lost_chars")))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(table(spark, sf_dir, "documents"), words=3, threshold=90)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def op8_rff_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    figured, model = quality_classifier.learned(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    return quality_classifier.scored(figured, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_kk_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 0).drop("ids")


def op10_lsa_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each leak: the document, the benchmark item, and the evidence."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_join.near_copies(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))[0]


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each source, order of the five filters, and step."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents
), keyed AS (
  SELECT doc_id, line, i, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), hot AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
)
SELECT a.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE h.k IS NOT NULL AND h.last <> a.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(a.line, chr(10) ORDER BY a.i) FILTER (WHERE h.k IS NULL OR h.last = a.doc_id), '')) AS kept_sha256
FROM keyed a LEFT JOIN hot h ON a.k = h.k GROUP BY a.doc_id
"""

OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), w AS (
  SELECT doc_id, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i FROM d
), t3 AS (
  SELECT doc_id, i, w1, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), rep AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w1, w2, w3) AS n FROM t3 WHERE w3 IS NOT NULL
), covered AS (
  SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM rep, (VALUES (0), (1), (2)) s(o) WHERE n > 1 GROUP BY doc_id
), l AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d
), lw AS (
  SELECT doc_id, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM l
), lj AS (
  SELECT doc_id, line, len(ws) AS n, length(array_to_string(ws, '')) AS chars, length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS sym,
         len(list_filter(ws, lambda x: x IN ('|', '>', '<', '/', '*', '-'))) AS bars,
         translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         regexp_matches(ws[-1], '[.!?:;,"'')\]…”’»]$') AS closed
  FROM lw WHERE len(ws) > 0
), lf AS (
  SELECT *, (n <= 3 AND NOT closed) OR 100 * sym > 12 * chars OR (bars >= 3 AND 5 * bars >= n)
         OR regexp_matches(low, 'all rights reserved|enable javascript|cookie policy|privacy policy|terms of use|terms of service|subscribe to our newsletter|click here to|lorem ipsum') AS fails
  FROM lj
), ls AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (WHERE fails) AS n_lost_lines, coalesce(sum(chars) FILTER (WHERE fails), 0)::BIGINT AS lost_chars
  FROM lf GROUP BY doc_id
), base AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(ls.n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(c.n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(ls.n_lost_lines, 0)::BIGINT AS n_lost_lines, coalesce(ls.lost_chars, 0)::BIGINT AS lost_chars
  FROM d LEFT JOIN ls ON d.doc_id = ls.doc_id LEFT JOIN covered c ON d.doc_id = c.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_chars <= 30 * word_chars AS kept, n_lost_lines, lost_chars
FROM base
"""

OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) < doc_id AS again FROM d
), marks AS (
  SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         concat(CASE WHEN len(ws) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' END,
                CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' END,
                CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN again THEN 'E' END) AS fs
  FROM w LEFT JOIN marks ON w.doc_id = marks.doc_id
), l(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')), o AS (
  SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), r AS (
  SELECT part, filter_order, s::INT AS step, good, toxic, fs, substr(filter_order, s::INT, 1) AS letter,
         length(translate(substr(filter_order, 1, s::INT - 1), fs, '')) = s - 1 AS reached
  FROM f, o, (VALUES (1), (2), (3), (4), (5)) t(s)
), c AS (
  SELECT part, filter_order, step, any_value(letter) AS letter,
         count(*) FILTER (WHERE reached AND NOT contains(fs, letter)) AS kept, count(*) FILTER (WHERE reached AND contains(fs, letter)) AS removed,
         count(*) FILTER (WHERE NOT reached AND contains(fs, letter)) AS redundant, count(*) FILTER (WHERE fs = letter) AS unique_fails,
         count(*) FILTER (WHERE reached AND contains(fs, letter) AND good) AS good_lost, count(*) FILTER (WHERE reached AND contains(fs, letter) AND toxic) AS toxic_lost
  FROM r GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley
FROM c
"""

QUERIES = {f.__name__: f for f in (op1_html_extract, op2_simple8b, op3_license_scan, op4_suffix_dedup, op5_line_dedup, op6_quality_rules, op7_ngram_join, op8_rff_quality, op9_kk_packing, op10_lsa_decontamination, op11_simhash_trie, op12_token_alignment, op13_filter_audit)}
ORACLES = {"op5_line_dedup": OP5_SQL, "op6_quality_rules": OP6_SQL, "op13_filter_audit": OP13_SQL}
