"""The append-only log of chat turns."""

from pyspark.sql import DataFrame, SparkSession

from locusframe.schema import CHAT_LOG


def append_chat_log(turns: DataFrame, path: str) -> None:
    """Append `user, assistant, context` rows and whatever key columns they carry."""
    missing = set(CHAT_LOG.names) - set(turns.columns)
    if missing:
        raise ValueError(f"chat turns lack {sorted(missing)}")
    turns.write.mode("append").parquet(path)


def read_chat_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
