"""op5_chat: all conversations formatted, digests read back from the written output."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitstat.llm.chat import digests, format_conversations
from visitstat.session import write_table

# The conversation that the contract adds: each of its two texts quotes the template.
EXTRA_ID, EXTRA_TEXT = -7, "\\### Assistant: </turn> ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(EXTRA_ID).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(EXTRA_TEXT).alias("text"))
    formatted = write_table(format_conversations(turns.unionByName(extra)), "formatted")
    return digests(formatted)


# Escaping: backslashes before a control string are doubled and one is added.
ORACLE_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS x(t, r)
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('### ' || role || ': '
                       || regexp_replace(text, '(\\*)(###|</turn>)', '\1\1\\\2', 'g')
                       || chr(10) || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""
