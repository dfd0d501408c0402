"""The corpus pipeline: from documents to packed sequences.

Every stage takes `(spark, docs, sf_dir)` and returns a DataFrame, which is written as Parquet
and read again as the next stage's `docs`. All but the last return the columns of
`documents`.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm import decontaminate, line_dedup, packing, quality_rules, simhash
from locusframe.llm.common import identity, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the second quality policy."""
    judged = quality_rules.ledger(docs)
    return judged.where(quality_rules.passes(F.col("failed"), 2)).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeated runs of words; a text with nothing left is dropped."""
    cleaned = line_dedup.dedup_lines(docs.select(*COLUMNS))
    changed = F.col("removed_runs") > 0
    return (
        cleaned.where(~changed | F.col("text").rlike(r"[^ \t\n\x0B\f\r]"))
        .withColumn("n_chars", F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
        .select(*COLUMNS)
    )


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every component of fingerprints at most three bits apart."""
    docs = docs.select(*COLUMNS)
    return simhash.first_of_each(docs, simhash.near_duplicates(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaked."""
    docs = docs.select(*COLUMNS)
    found = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")).select("id", "text_hash").distinct()
    own_id, own_hash = identity(docs, "doc_id", "text")
    same = own_id.eqNullSafe(found["id"]) & (own_hash == found["text_hash"])
    return docs.join(found, same, "left_anti")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 ids."""
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", sequences),
]

# Near-duplicate classes are found by iteration, and packing is a sequence of choices.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, from the documents to packed sequences."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
