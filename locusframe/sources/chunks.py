"""Chunk tables as JSON."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusframe.schema import chunk_schema
from locusframe.sources.splits import ArrayElements, read_split_records


def write_chunks_json(chunks: DataFrame, path: str) -> None:
    """JSON lines in one folder per chunk type; missing values are left out."""
    chunks.write.partitionBy("type").json(path)


def _without_nan(value: Column, kind: T.DataType) -> Column:
    """A value with every NaN inside it replaced by NULL."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value), value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _without_nan(x, kind.elementType))
    if isinstance(kind, T.StructType):
        fields = [_without_nan(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def read_chunks_json(
    spark: SparkSession, path: str, record: T.StructType, array_file: bool = False
) -> DataFrame:
    """Chunks from JSON lines, or from files that each hold one JSON array.

    An array file is read twice, by many tasks; its elements are objects. `raw_data` may be one
    record or an array of them, and a bare NaN is a missing number.
    """
    schema = chunk_schema(record)
    text = T.StructType(
        [T.StructField(f.name, T.StringType() if f.name == "raw_data" else f.dataType) for f in schema]
    )
    if array_file:
        elements = read_split_records(spark, path, ArrayElements)
        rows = elements.select(F.from_json("text", text).alias("chunk")).select("chunk.*")
    else:
        rows = spark.read.schema(text).json(path)
    raw, kind = F.col("raw_data"), T.ArrayType(record)
    # An object becomes an array of one record.
    several = F.when(raw.startswith("["), raw).otherwise(F.concat(F.lit("["), raw, F.lit("]")))
    rows = rows.withColumn("raw_data", F.from_json(several, kind))
    return rows.select(*(_without_nan(F.col(f.name), f.dataType).alias(f.name) for f in schema))


def read_chunk_contents(
    spark: SparkSession, path: str, record: T.StructType, array_file: bool = False
) -> DataFrame:
    """Only the text of the chunks."""
    return read_chunks_json(spark, path, record, array_file).select("content")


def chunk_metadata(chunks: DataFrame) -> DataFrame:
    return chunks.select("id", "type", "metadata")
