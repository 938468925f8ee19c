"""Query of the host-level quality rules."""

from batchwatch.llm import host_rules
from batchwatch.llm.common import table
from pyspark.sql import functions as F


def op1_host_quality(spark, sf_dir):
    return host_rules.apply(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "host_docs", "host_failures", F.round("host_rate", 6).alias("host_rate"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g')) > 0) AS lines
  FROM documents
),
w AS (
  SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d)
),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM w) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
c AS (
  SELECT d.doc_id, d.source, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN covered USING (doc_id)
),
f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines AS soft_failed
  FROM c
),
h AS (
  SELECT source, count(*) AS n, sum((base_failed OR soft_failed)::INT)::BIGINT AS k FROM f WHERE source IS NOT NULL GROUP BY source
),
m AS (SELECT avg(k / n) AS m, coalesce(var_samp(k / n), 0) AS v, avg(1.0 / n) AS inv FROM h),
b AS (SELECT m, m * (1 - m) AS spread, greatest(v - m * (1 - m) * inv, 0) AS between_hosts FROM m),
s AS (SELECT m, CASE WHEN between_hosts * 1e6 <= spread THEN 1e6 ELSE greatest(spread / between_hosts - 1, 1e-3) END AS strength FROM b),
p AS (SELECT CASE WHEN m > 0 AND m < 1 THEN m * strength ELSE 1 END AS alpha, CASE WHEN m > 0 AND m < 1 THEN (1 - m) * strength ELSE 1 END AS beta FROM s),
r AS (SELECT source, n, k, (k + alpha) / (n + alpha + beta) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(rate > 0.5, FALSE) AS kept, n AS host_docs, k AS host_failures, round(rate, 6) AS host_rate
FROM f LEFT JOIN r USING (source)
"""
QUERIES = {"op1_host_quality": op1_host_quality}
ORACLES = {"op1_host_quality": ORACLE}
