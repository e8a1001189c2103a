"""op11_nearest: the 20 nearest vectors of every embedding whose id is divisible by 20."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitstat.llm.vptree import search

# Factor one: the triangle inequality itself, so the neighbours are exact (recall 1).
FACTOR = 1.0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, F.col("vec_id") % 20 == 0, factor=FACTOR)


ORACLE_SQL = r"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
)
SELECT q.vec_id AS query_id, CAST(row_number() OVER w AS INTEGER) AS rank, c.vec_id, list_inner_product(q.e, c.e) AS score
FROM v AS q JOIN v AS c ON c.rid <> q.rid AND len(c.e) = len(q.e)
WHERE q.vec_id % 20 = 0
WINDOW w AS (PARTITION BY q.rid ORDER BY list_inner_product(q.e, c.e) DESC, c.vec_id NULLS LAST, c.rid)
QUALIFY row_number() OVER w <= 20
"""
