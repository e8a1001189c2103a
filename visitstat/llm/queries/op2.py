"""op2_search: BM25 top 10 of all documents for every document whose id is divisible by 20."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitstat.llm.search import search


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return search(docs, F.pmod("doc_id", F.lit(20)) == 0)


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w
  FROM documents
), tf AS (
  SELECT rid, term, count(*)::DOUBLE AS tf FROM (SELECT rid, unnest(w) AS term FROM d) GROUP BY rid, term
), stats AS (
  SELECT count(*)::DOUBLE AS n, avg(len(w)) AS mean FROM d
), idf AS (
  SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, stats GROUP BY term, n
), hits AS (
  SELECT q.rid AS qid, t.rid AS did,
         round(sum(idf * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * len(dd.w) / mean))), 6) AS score
  FROM d AS qd JOIN tf AS q ON q.rid = qd.rid JOIN tf AS t ON t.term = q.term
       JOIN idf ON idf.term = q.term JOIN d AS dd ON dd.rid = t.rid, stats
  WHERE qd.doc_id % 20 = 0
  GROUP BY q.rid, t.rid
), ranked AS (
  SELECT qd.doc_id AS query_id, dd.doc_id, score,
         row_number() OVER (PARTITION BY qid ORDER BY score DESC, dd.doc_id NULLS FIRST) AS rank
  FROM hits JOIN d AS qd ON qd.rid = qid JOIN d AS dd ON dd.rid = did
)
SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, score FROM ranked WHERE rank <= 10
"""
