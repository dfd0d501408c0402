"""Where intermediate tables are written, and reading them back in file order."""

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@lru_cache(maxsize=None)
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"locusframe-{application}-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as named by `spark.checkpoint.dir`."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if context.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    return _local_folder(context.applicationId)


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no earlier table uses."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, label: str) -> str:
    """Write `df` once to the shared folder and return its path."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` written once and read back: used several times, it is computed once."""
    return df.sparkSession.read.parquet(write_table(df, label))


# Bytes of an Arrow batch that goes to Python.
BATCH_BYTES = 4 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """Let Arrow batches be bounded by bytes as well as by rows.

    Texts may be very long, so a batch of 10,000 rows has no bounded size.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


# Rows of a few hundred bytes that may be broadcast.
BROADCAST_ROWS = 100_000


def broadcast_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a join side for broadcast if it is counted to have few rows.

    Without the mark an adaptive plan shuffles the big side before it learns how small
    the other one is. A side with more rows is left to the optimizer.
    """
    return F.broadcast(df) if df.count() <= rows else df


def _rows_before(splits: DataFrame, order: list, out: str) -> DataFrame:
    """Running row count ahead of each split.

    The window has no partition key: its input is one row per file or file split,
    about a million rows for 100 TB.
    """
    earlier = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return splits.withColumn(out, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))


def number_written_rows(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Read a table written by `write_table` with a dense 0-based row number.

    Files count in the order of their part number and rows in the order they have
    inside the file, so the numbers do not depend on how a later scan is split.
    """
    table = spark.read.parquet(path)
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("bigint")
    files = table.groupBy(
        part.alias("_part"), F.col("_metadata.file_name").alias("_file")
    ).agg(F.count("*").alias("_rows"))
    offsets = _rows_before(files, ["_part", "_file"], "_before").drop("_part", "_rows")
    rows = table.select(
        "*",
        F.col("_metadata.file_name").alias("_file"),
        F.col("_metadata.row_index").alias("_at"),
    )
    return (
        rows.join(broadcast_small(offsets), "_file")
        .withColumn(name, F.col("_before") + F.col("_at"))
        .drop("_file", "_at", "_before")
    )


def number_scanned_rows(scan: DataFrame, name: str) -> DataFrame:
    """Attach a dense 0-based position in file order to a text-format scan.

    Text formats expose no row index, so the scan is written once with its split
    and in-task position; every later step reads those stored values, and cannot
    disagree with them when a scan is split or retried differently.
    """
    located = scan.select(
        *(name for name in scan.columns if name != "_metadata"),
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"),
    )
    table = scan.sparkSession.read.parquet(write_table(located, "scan"))
    splits = table.groupBy("_path", "_start").agg(
        F.count("*").alias("_rows"), F.min("_at").alias("_first")
    )
    part = F.regexp_extract("_path", r"part-(\d+)[^/]*$", 1).try_cast("bigint")
    offsets = _rows_before(splits, [part, "_path", "_start"], "_before").drop("_rows")
    return (
        table.join(broadcast_small(offsets), ["_path", "_start"])
        .withColumn(name, F.col("_before") + F.col("_at") - F.col("_first"))
        .drop("_path", "_start", "_at", "_first", "_before")
    )
