"""op12_prefix_trie: the trie of all conversations with shared heads."""

from pyspark.sql import DataFrame, SparkSession

from visitstat.llm.prefix_trie import conversations, trie, with_shared_heads


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return trie(with_shared_heads(conversations(turns)))


ORACLE_SQL = r"""
WITH ids AS (
  SELECT DISTINCT conv_id AS c, conv_id - conv_id % 100 AS base FROM conversations WHERE conv_id IS NOT NULL
), crc AS (
  SELECT c, base, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
      lambda r, b: list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0],
                            lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 6 AS h
  FROM ids
), t AS (
  SELECT conv_id AS c, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
         length(coalesce(text, '')) AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), r AS (
  SELECT crc.c, pos, digest, chars, 0 AS own FROM crc JOIN t ON t.c = crc.base AND pos <= h
  UNION ALL SELECT crc.c, pos, digest, chars, 1 FROM crc JOIN t ON t.c = crc.c AND pos > h
), p AS (
  SELECT c, row_number() OVER w AS depth, chars, string_agg(digest, '') OVER w AS k
  FROM r WINDOW w AS (PARTITION BY c ORDER BY own, pos ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT c, 0, 0, '' FROM ids
), node AS (
  SELECT depth, k, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM p GROUP BY depth, k
), q AS (
  SELECT p.c, depth, conv_id FROM p JOIN node USING (depth, k)
), parent AS (
  SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id FROM node AS n JOIN q AS u ON u.c = n.conv_id AND u.depth = n.depth - 1
), kids AS (
  SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM parent GROUP BY ALL
), below AS (
  SELECT a.conv_id, a.depth, count(*) FILTER (kids.n_children IS NULL) AS n_leaves, sum((v.n_convs - 1) * v.chars) AS saved_tokens
  FROM node AS v LEFT JOIN kids ON kids.conv_id = v.conv_id AND kids.depth = v.depth
       JOIN q AS a ON a.c = v.conv_id AND a.depth <= v.depth
  GROUP BY ALL
), ends AS (
  SELECT conv_id, depth, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS sha
  FROM (SELECT * FROM q QUALIFY depth = max(depth) OVER (PARTITION BY c)) GROUP BY ALL
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, parent_conv_id, n.n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(sha, sha256('')) AS ends_sha256
FROM node AS n LEFT JOIN parent USING (conv_id, depth) LEFT JOIN kids USING (conv_id, depth) JOIN below USING (conv_id, depth)
     LEFT JOIN ends USING (conv_id, depth)
"""
