"""Query of the repeated word windows, with the SQL that checks it: every window is compared with every other by its words."""

from batchwatch.llm import seed_extend
from batchwatch.llm.common import table
from pyspark.sql import functions as F


def op11_seed_extend(spark, sf_dir):
    found = seed_extend.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
),
w AS (
  SELECT rid, i, md5(array_to_string(words[i:i + 34], ' ')) AS h
  FROM (SELECT rid, words, unnest(range(1, len(words) - 33)) AS i FROM d)
),
twice AS (SELECT rid, i FROM w JOIN (SELECT h FROM w GROUP BY h HAVING count(*) > 1) USING (h)),
gone AS (SELECT DISTINCT rid, i + k AS i FROM twice, (SELECT unnest(range(0, 35)) AS k)),
kept AS (
  SELECT rid, string_agg(word, ' ' ORDER BY i) AS kept
  FROM (SELECT rid, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d) ANTI JOIN gone USING (rid, i)
  GROUP BY rid
),
removed AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid) LEFT JOIN removed USING (rid)
"""
QUERIES = {"op11_seed_extend": op11_seed_extend}
ORACLES = {"op11_seed_extend": ORACLE}
