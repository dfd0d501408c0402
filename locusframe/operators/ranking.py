"""Positions, ranks, blocks, top-k selections and samples."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from locusframe.functions.text import block_number
from locusframe.schema import DEFAULT_SPEC, RecordSpec
from locusframe.storage import broadcast_small, number_written_rows, write_table

# A window sorts each of its groups in one task; up to this many rows that is cheap.
ROWS_PER_TASK = 1_000_000

# A group of more rows than this and of more than a quarter of the table would leave most tasks
# waiting for its own.
HOT_ROWS, HOT_SHARE = 100_000, 1 / 4

# The largest n that orderBy().limit() keeps in the memory of every task.
TOP_ROWS_IN_MEMORY = 100_000


def largest_group(df: DataFrame, by: Sequence[str] = ()) -> int:
    """Row count of the biggest `by` group (of the table without `by`)."""
    return _group_rows(df, by)[0]


def _group_rows(df: DataFrame, by: Sequence[str]) -> tuple[int, int]:
    """Rows of the biggest group and of the table."""
    if not by:
        rows = df.count()
        return rows, rows
    most, rows = df.groupBy(*by).count().agg(F.max("count"), F.sum("count")).first()
    return most or 0, rows or 0


def _fits_a_window(df: DataFrame, by: Sequence[str], rows_per_task: int, hot_rows: int) -> bool:
    """Whether no group is too big for one task, or so big that the others would wait for it."""
    most, rows = _group_rows(df, by)
    return most <= rows_per_task and (not by or most <= hot_rows or most <= rows * HOT_SHARE)


def position_in_order(
    df: DataFrame,
    order: Sequence[Column],
    by: Sequence[str] = (),
    name: str = "position",
    rows_per_task: int = ROWS_PER_TASK,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the 0-based position of each row in `order`, counted within `by` groups.

    `order` must be total (end it in the row id). While every group fits one task, and none of
    more than `hot_rows` rows is a quarter of the table, this is a window. Otherwise the table is sorted over the whole cluster, where the range
    boundaries cut through a hot group or a frequent value, written once, and numbered
    from the row counts of the written files.
    """
    if _fits_a_window(df, by, rows_per_task, hot_rows):
        return _placed_by_window(df, order, by, name)
    return _placed_by_sort(df, order, by, name)


def _placed_by_window(df: DataFrame, order, by, name: str) -> DataFrame:
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, (F.row_number().over(window) - 1).cast("bigint"))


def _placed_by_sort(df: DataFrame, order, by, name: str) -> DataFrame:
    path = write_table(df.sort(*by, *order), "ordered")
    numbered = number_written_rows(df.sparkSession, path, name)
    if not by:
        return numbered
    starts = numbered.groupBy(*by).agg(F.min(name).alias("_group_start"))
    return (
        numbered.join(broadcast_small(starts), list(by))
        .withColumn(name, F.col(name) - F.col("_group_start"))
        .select(*df.columns, name)
    )


def blocks_in_order(
    df: DataFrame,
    order: Sequence[Column],
    size: int | Column,
    by: Sequence[str] = (),
    rows_per_task: int = ROWS_PER_TASK,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add `position` and the 1-based `block` of `size` rows, within `by` groups.

    The rows of a block are in one partition afterwards, so texts made from them need no
    further shuffle when they are collected per group and block.
    """
    block = block_number(F.col("position"), size)
    if _fits_a_window(df, by, rows_per_task, hot_rows):
        return _placed_by_window(df, order, by, "position").withColumn("block", block)
    placed = _placed_by_sort(df, order, by, "position").withColumn("block", block)
    return placed.repartition(*by, "block")


def first_seen_index(
    df: DataFrame, spec: RecordSpec = DEFAULT_SPEC, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Each entity with the row it first appears in and its 0-based ordinal."""
    seen = (
        df.filter(F.col(spec.entity).isNotNull())
        .groupBy(spec.entity)
        .agg(F.min(spec.row_id).alias("first_row"))
    )
    return position_in_order(seen, [F.col("first_row")], (), "ordinal", rows_per_task)


def rank_bounds(block: Column, size: int, top_n: int) -> tuple[Column, Column]:
    """First and last rank of a block; the last is limited by `top_n`, not by the rows."""
    start = (block - 1) * size + 1
    return start, F.least(block * size, F.lit(top_n).cast("bigint"))


def top_n_by_score(
    df: DataFrame, n: int, drop_missing: bool = False, spec: RecordSpec = DEFAULT_SPEC
) -> DataFrame:
    """The n highest scores with their 1-based `rank`; missing scores last or dropped."""
    if drop_missing:
        df = df.filter(F.col(spec.score).isNotNull())
    return _first_rows(df, [F.desc_nulls_last(spec.score), F.asc(spec.row_id)], n)


def lowest_pvalues(df: DataFrame, n: int = 20, spec: RecordSpec = DEFAULT_SPEC) -> DataFrame:
    """The n lowest p-values with their 1-based `rank`."""
    present = df.filter(F.col(spec.pvalue).isNotNull())
    return _first_rows(present, [F.asc(spec.pvalue), F.asc(spec.row_id)], n)


def head(df: DataFrame, n: int, spec: RecordSpec = DEFAULT_SPEC) -> DataFrame:
    """The first n records in row order with their 1-based `rank`."""
    return _first_rows(df, [F.asc(spec.row_id)], n)


def _first_rows(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    if n > TOP_ROWS_IN_MEMORY:
        placed = position_in_order(df, order, (), "rank")
        return placed.filter(F.col("rank") < n).withColumn("rank", F.col("rank") + 1)
    # At most n rows are left when the window numbers them.
    window = Window.orderBy(*order)
    return (
        df.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(window).cast("bigint"))
    )


def head_per_group(
    df: DataFrame, n: int, by: Sequence[str], order: Sequence[Column]
) -> DataFrame:
    """The first n rows of every group with their 1-based `rank`.

    Each task keeps n rows per group before the shuffle, so a hot group sends no more
    than n rows per task.
    """
    window = Window.partitionBy(*by).orderBy(*order)
    ranked = df.withColumn("rank", F.row_number().over(window).cast("bigint"))
    return ranked.filter(F.col("rank") <= n)


def stride_sample(
    df: DataFrame, n: int = 10, literal: bool = False, spec: RecordSpec = DEFAULT_SPEC
) -> DataFrame:
    """n rows spread evenly over a table in the order of its row ids, which may have gaps.

    Only the row ids are put in order. `literal=True` keeps the original loop bound, which
    stops at row n.
    """
    ids = df.select(spec.row_id)
    stride = max(ids.count() // n, 1)
    end = n if literal else n * stride
    place = F.col("_place")
    placed = position_in_order(ids, [F.col(spec.row_id)], name="_place")
    chosen = placed.filter((place < end) & (place % stride == 0)).select(spec.row_id)
    # At most n of them.
    return df.join(F.broadcast(chosen), spec.row_id, "left_semi")


def top_plus_sample(df: DataFrame, n: int = 10, spec: RecordSpec = DEFAULT_SPEC) -> DataFrame:
    """The n top scores followed by the stride sample; a row may occur in both."""
    top = top_n_by_score(df, n, drop_missing=True, spec=spec).withColumn("source_order", F.lit(0))
    sample = stride_sample(df, n, spec=spec)
    sample = head(sample, n, spec).withColumn("source_order", F.lit(1))
    return top.unionByName(sample)
