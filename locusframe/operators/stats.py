"""Summaries of record and chunk tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.operators.filters import has_entity
from locusframe.operators.ranking import head
from locusframe.schema import DEFAULT_SPEC, RecordSpec


def _distinct_with_null(name: str) -> Column:
    """Number of distinct values, a missing value counting as one of them."""
    missing = F.max(F.when(F.col(name).isNull(), 1).otherwise(0))
    return F.count_distinct(name) + F.coalesce(missing, F.lit(0))


def group_counts(df: DataFrame, n: int = 10, spec: RecordSpec = DEFAULT_SPEC) -> DataFrame:
    """The n groups with most records; ties by number, then by first appearance."""
    named = df.filter(F.col(spec.group).isNotNull() & ~F.col(spec.group).isin("", "0"))
    return (
        named.groupBy(spec.group)
        .agg(F.count("*").alias("rows"), F.min(spec.row_id).alias("first_row"))
        .orderBy(
            F.desc("rows"),
            F.asc_nulls_last(F.col(spec.group).try_cast("bigint")),
            F.asc("first_row"),
        )
        .limit(n)
        .drop("first_row")
    )


def dataset_summary(df: DataFrame, spec: RecordSpec = DEFAULT_SPEC) -> DataFrame:
    """Rows, mean and maximum score with missing as 0, distinct groups and entities."""
    score = F.coalesce(F.col(spec.score), F.lit(0.0))
    entity = F.nullif(F.col(spec.entity), F.lit(""))
    return df.agg(
        F.count("*").alias("records"),
        F.avg(score).alias("mean_score"),
        F.max(score).alias("max_score"),
        _distinct_with_null(spec.group).alias("groups"),
        F.count_distinct(entity).alias("entities"),
    )


def score_overview(df: DataFrame, spec: RecordSpec = DEFAULT_SPEC) -> DataFrame:
    """Rows, mean and maximum of the scores present, distinct groups."""
    return df.agg(
        F.count("*").alias("records"),
        F.avg(spec.score).alias("mean_score"),
        F.max(spec.score).alias("max_score"),
        _distinct_with_null(spec.group).alias("groups"),
    )


def unique_entities(df: DataFrame, n: int = 15, spec: RecordSpec = DEFAULT_SPEC) -> DataFrame:
    """The first n entities in order of appearance, with the number of all in `total`."""
    seen = (
        has_entity(df, spec).groupBy(spec.entity).agg(F.min(spec.row_id).alias(spec.row_id))
    )
    total = seen.agg(F.count("*")).scalar()
    return head(seen, n, spec).withColumn("total", total)


def match_count_and_more(
    matches: DataFrame, n: int = 10, spec: RecordSpec = DEFAULT_SPEC
) -> DataFrame:
    """The first n matches, with the number of all in `total` and of the rest in `more`."""
    total = matches.agg(F.count("*")).scalar()
    return (
        head(matches, n, spec)
        .withColumn("total", total)
        .withColumn("more", F.greatest(F.col("total") - n, F.lit(0)))
    )


def distinct_values(df: DataFrame, name: str) -> DataFrame:
    return df.select(name).distinct()


def row_chunk_stats(chunks: DataFrame) -> DataFrame:
    score = F.col("metadata.qtl_lod")
    return chunks.agg(
        F.count("*").alias("chunks"), F.min(score).alias("min_lod"), F.max(score).alias("max_lod")
    )


def block_chunk_stats(chunks: DataFrame) -> DataFrame:
    bounds = F.col("metadata.lod_range")
    return chunks.agg(
        F.count("*").alias("chunks"),
        F.sum("metadata.qtl_count").alias("records"),
        F.min(F.get(bounds, F.lit(0))).alias("min_lod"),
        F.max(F.get(bounds, F.lit(1))).alias("max_lod"),
    )


def embedding_stats(vectors: DataFrame) -> DataFrame:
    size = F.size("embedding")
    present = F.when(F.col("embedding").isNotNull(), size)
    return vectors.agg(
        F.count("embedding").alias("vectors"),
        F.min(present).alias("min_dimension"),
        F.max(present).alias("max_dimension"),
    )


def column_preview(df: DataFrame, n: int = 10, spec: RecordSpec = DEFAULT_SPEC) -> DataFrame:
    """The first n columns of the first record, one row per column."""
    names = [c for c in df.columns if c != spec.row_id][:n]
    pairs = F.array(
        *(F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in names)
    )
    first = df.orderBy(spec.row_id).limit(1)
    return first.select(F.posexplode(pairs).alias("ordinal", "pair")).select(
        "ordinal", "pair.key", "pair.value"
    )
