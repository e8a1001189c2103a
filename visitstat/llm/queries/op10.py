"""op10_host_rules: host-level quality rules over all documents."""

from pyspark.sql import DataFrame, SparkSession

from visitstat.functions import round_half_up
from visitstat.llm.host_rules import host_rules


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = host_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumn("host_rate", round_half_up("host_rate", 6))


# Words are cut by a regular expression; 8-word windows are compared as text.
ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
  GROUP BY rid
), windows AS (
  SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
), twice AS (
  SELECT rid, i FROM windows
  QUALIFY count(*) OVER (PARTITION BY rid, g) > 1
), covered AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words
  FROM (SELECT rid, i, unnest(range(0, 8)) AS k FROM twice)
  GROUP BY rid
), judged AS (
  SELECT d.rid, d.doc_id, d.source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(w) < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * len(w) AS base_failed
  FROM d LEFT JOIN lines USING (rid) LEFT JOIN covered USING (rid)
), hosts AS (
  SELECT source, count(*)::DOUBLE AS n,
         count(*) FILTER (base_failed OR 100 * n_symbols > 50 * n_words
                          OR 100 * n_dup_lines > 50 * n_lines)::DOUBLE AS f
  FROM judged GROUP BY source
), sums AS (
  SELECT sum(n) AS n, sum(f) / sum(n) AS p, count(*) AS h, sum(n * n) AS nn, sum(f * f / n) AS ffn FROM hosts
), spread AS (
  SELECT p, CASE WHEN p * (1 - p) > 0 AND n - nn / n - (h - 1) > 0
                 THEN (ffn - n * p * p - p * (1 - p) * (h - 1)) / (p * (1 - p) * (n - nn / n - (h - 1)))
                 ELSE 0 END AS rho
  FROM sums
), prior AS (
  SELECT p, 1 / least(greatest(rho, 1e-6), 0.999) - 1 AS k FROM spread
), verdicts AS (
  SELECT source, (f + p * k) / (n + k) AS rate FROM hosts, prior
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       sign(rate) * floor(abs(rate) * 1e6 + 0.5) / 1e6 AS host_rate, rate <= 0.5 AS host_ok,
       NOT base_failed AND rate <= 0.5 AS kept
FROM judged JOIN verdicts ON judged.source IS NOT DISTINCT FROM verdicts.source
"""
