"""Inputs of the registered queries: given tables and views derived from all their rows."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.storage import write_table

# Sample questions.
SAMPLE_QUESTIONS = [
    "high LOD score genes",
    "chromosome 1 QTLs",
    "liver metabolism genes",
    "cis-acting QTLs",
    "What are the genes with highest LOD scores?",
    "Tell me about chromosome 3 QTLs",
    "Which QTLs are cis-acting?",
    "genes with LOD score above 500",
    "What are the genes with the highest LOD scores?",
    "Tell me about QTLs on chromosome 11",
    "What's the relationship between LOD scores and gene types?",
    "Summarize the most significant findings in the data",
    "What are the top 5 QTLs with highest LOD scores?",
    "Show me QTLs on chromosome 11 with LOD > 20",
    "What genes have significant p-values < 0.001?",
    "Compare QTL positions between different chromosomes",
    "What are the top 5 QTLs with highest LOD scores and what do they tell us?",
    "Explain the relationship between LOD scores and p-values in my data",
    "Which chromosomes show the most significant QTLs and why might this be important?",
    "Are there any patterns in the gene types that have high LOD scores?",
    "What can you tell me about the confidence intervals for my strongest QTLs?",
    "What are the top 10 QTLs with highest LOD scores?",
    "Show me significant genes with p-value < 0.001",
    "What is the top QTL with highest LOD score and what do they tell us?",
]

# A record table over every event. The same text runs in Spark and in the checking engine.
PEAKS = """
SELECT event_id AS row_id,
 CASE WHEN event_id % 97 = 0 THEN NULL ELSE concat('G', CAST(user_id AS VARCHAR(20))) END AS gene_symbol,
 concat('ID', CAST(user_id AS VARCHAR(20))) AS gene_id,
 event_type AS gene_type,
 CASE WHEN event_id % 20 = 19 THEN 'X' ELSE CAST(event_id % 20 + 1 AS VARCHAR(20)) END AS qtl_chr,
 ((day(ts) - 1) * 1440 + hour(ts) * 60 + minute(ts)) / CAST(100 AS DOUBLE) AS qtl_pos,
 ((day(ts) - 1) * 1440 + hour(ts) * 60 + minute(ts)) / CAST(100 AS DOUBLE) - CAST(0.5 AS DOUBLE) AS qtl_ci_lo,
 ((day(ts) - 1) * 1440 + hour(ts) * 60 + minute(ts)) / CAST(100 AS DOUBLE) + CAST(0.5 AS DOUBLE) AS qtl_ci_hi,
 CASE WHEN event_id % 101 = 0 THEN NULL ELSE value END AS qtl_lod,
 CASE WHEN event_id % 503 = 0 THEN CAST(0 AS DOUBLE)
      ELSE CAST(1 AS DOUBLE) / (CAST(1 AS DOUBLE) + value * value) END AS qtl_pval,
 event_id % 3 = 0 AS cis
FROM events
"""


def _questions_sql() -> str:
    """A question per customer: the samples, and wordings with the customer's own numbers."""

    def text(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    def number(value: str) -> str:
        return f"CAST({value} AS VARCHAR(20))"

    worded = [text(q) for q in SAMPLE_QUESTIONS] + [
        f"concat('What are the top ', {number('c_custkey % 40 + 1')}, ' QTLs with highest LOD scores?')",
        f"concat('Show me QTLs on chromosome ', {number('c_nationkey % 19 + 1')},"
        f" ' with LOD > ', {number('c_custkey % 300')})",
        f"concat('Show me significant genes with p-value < 0.000', {number('c_custkey % 9 + 1')}, '.')",
        f"concat('List pval < ', {number('c_custkey % 7 + 1')}, 'e-5 of segment ', c_mktsegment)",
        "concat('Give me a summary for the segment ', c_mktsegment)",
        f"concat('  What is on chr', {number('c_nationkey % 19 + 1')}, ' for ', lower(c_mktsegment), '? ')",
    ]
    n = len(worded)
    cases = "\n".join(f" WHEN c_custkey % {n} = {i} THEN {q}" for i, q in enumerate(worded))
    return f"SELECT c_custkey AS query_id, CASE\n{cases} END AS question FROM customer"


QUESTIONS = _questions_sql()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def peaks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(PEAKS.replace("FROM events", "FROM {events}"), events=table(spark, folder, "events"))


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """The derived questions as a stored table: inlined, the long CASE would be repeated."""
    customer = table(spark, folder, "customer")
    derived = spark.sql(QUESTIONS.replace("FROM customer", "FROM {customer}"), customer=customer)
    return spark.read.parquet(write_table(derived, "questions"))


def benchmark(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question")
    )
