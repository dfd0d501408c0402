"""Strategies that turn a record table into a chunk table.

Every strategy returns `id, type, content, metadata[, raw_data]`. Texts, names and raw
records are collected separately, so Catalyst drops what a query does not select.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.functions.numbers import fixed
from locusframe.functions.text import MISSING_NUMBER, block_number, format_record, truncate_list
from locusframe.operators.filters import score_tier
from locusframe.operators.ranking import (
    ROWS_PER_TASK,
    blocks_in_order,
    first_seen_index,
    largest_group,
    rank_bounds,
    top_n_by_score,
)
from locusframe.schema import DEFAULT_SPEC, RecordSpec, metadata
from locusframe.storage import broadcast_small, stored

# A chunk is one row, so a group with more records is continued in further chunks. Every part
# carries the figures of the whole group.
MAX_RECORDS_PER_CHUNK = 10_000


def _optional(columns: Sequence[str], name: str, default) -> Column:
    """A column, or the default used when the table does not have it."""
    return F.col(name) if name in columns else F.lit(default)


def _in_order(order: str, value: Column) -> Column:
    """Values of a group as an array in the order of a unique column."""
    pairs = F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))
    return F.sort_array(pairs)["v"]


def _names(order: str, name: str) -> Column:
    """As `_in_order`, without missing values."""
    pair = F.struct(F.col(order).alias("o"), F.col(name).alias("v"))
    return F.sort_array(F.collect_list(F.when(F.col(name).isNotNull(), pair)))["v"]


def _by_score(score: str, order: str, value: str) -> Column:
    """Values of a group as structs with field `v`, best score first, missing scores last."""
    return F.sort_array(
        F.collect_list(
            F.struct(
                F.col(score).isNull().alias("missing"),
                (-F.col(score)).alias("s"),
                F.col(order).alias("o"),
                F.col(value).alias("v"),
            )
        )
    )


def _raw(columns: Sequence[str], order: str, include: bool) -> list[Column]:
    if not include:
        return []
    return [_in_order(order, F.struct(*columns)).alias("raw_data")]


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(MISSING_NUMBER))


def _chunk(id: Column, type: Column | str, content: Column, meta: Column, raw: bool) -> list[Column]:
    type = F.lit(type) if isinstance(type, str) else type
    columns = [id.alias("id"), type.alias("type"), content.alias("content"), meta.alias("metadata")]
    return columns + [F.col("raw_data")] if raw else columns


def _continued(id: Column) -> Column:
    """Chunk id with a part suffix from the second part of a long group on.

    Where a group is split, a name that ends like such a suffix has one from its first part on, so
    it cannot meet the part of another group.
    """
    suffix = F.concat(F.lit("_part_"), F.col("block").cast("string"))
    alike = F.col("split") & id.rlike(r"_part_\d+$")
    return F.concat(id, F.when((F.col("block") > 1) | alike, suffix).otherwise(""))


def _figures(records: DataFrame, by: str, spec: RecordSpec) -> dict[str, Column]:
    """Aggregates that describe a group of records."""
    has_category = spec.category in records.columns
    return {
        "rows": F.count("*"),
        "max_score": F.max(spec.score),
        "mean_score": F.avg(spec.score),
        "category": F.min_by(spec.category, spec.row_id) if has_category else F.lit("Unknown"),
    }


def _with_figures(
    df: DataFrame, texts: list[Column], by: str, order: list[Column], max_records: int,
    spec: RecordSpec, rows_per_task: int,
) -> DataFrame:
    """Texts per part of a group, each part with the figures of its whole group.

    `df` has the line of every record. The figures come with the texts while every group is
    one part; otherwise they are aggregated on their own and joined to the parts.
    """
    figures = [value.alias(name) for name, value in _figures(df, by, spec).items()]
    groups = F.array_distinct(_names(spec.row_id, spec.group)).alias("groups")
    if largest_group(df, [by]) <= max_records:
        rows = df.repartition(by).groupBy(by).agg(*texts, *figures, groups)
        return rows.select("*", F.lit(1).alias("block"), F.lit(1).alias("parts"), F.lit(False).alias("split"))
    parts = blocks_in_order(df, order, max_records, [by], rows_per_task).groupBy(by, "block").agg(*texts)
    # The groups of a record set are few; their first places give their order.
    first = df.filter(F.col(spec.group).isNotNull()).groupBy(by, spec.group).agg(
        F.min(spec.row_id).alias("_first")
    )
    seen = first.groupBy(by).agg(_in_order("_first", F.col(spec.group)).alias("groups"))
    whole = df.groupBy(by).agg(*figures).join(seen, by, "left")
    whole = whole.withColumn("groups", F.coalesce("groups", F.array().cast("array<string>")))
    count = F.ceil(F.col("rows") / max_records)
    return parts.join(whole, by).withColumns({"parts": count, "split": F.lit(True)})


def chunk_by_row(
    records: DataFrame, include_raw: bool = True, spec: RecordSpec = DEFAULT_SPEC
) -> DataFrame:
    """One chunk per record; map-only."""
    columns = records.columns
    rows = records
    if include_raw:
        rows = records.withColumn("raw_data", F.array(F.struct(*columns)))
    meta = metadata(
        gene_symbol=_optional(columns, spec.entity, "Unknown"),
        qtl_lod=_optional(columns, spec.score, 0),
        qtl_chr=_optional(columns, spec.group, "Unknown"),
        qtl_pos=_optional(columns, spec.position, 0),
        qtl_pval=_optional(columns, spec.pvalue, 1),
        cis=_optional(columns, spec.flag, False),
        gene_type=_optional(columns, spec.category, "Unknown"),
    )
    id = F.concat(F.lit("qtl_"), F.col(spec.row_id).cast("string"))
    return rows.select(*_chunk(id, "single_qtl", format_record(columns, spec), meta, include_raw))


def chunk_by_gene(
    records: DataFrame,
    include_raw: bool = True,
    max_records: int = MAX_RECORDS_PER_CHUNK,
    spec: RecordSpec = DEFAULT_SPEC,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """One chunk per entity with its records in row order.

    An entity with more than `max_records` records continues in chunks whose ids end in
    `_part_2`, `_part_3`, ...; `metadata` has `part` and `parts`, and in every part the figures
    of the whole entity.
    """
    columns = records.columns
    named = records.filter(F.col(spec.entity).isNotNull())
    texts = [
        _in_order(spec.row_id, format_record(columns, spec)).alias("lines"),
        *_raw(columns, spec.row_id, include_raw),
    ]
    chunks = _with_figures(
        named, texts, spec.entity, [F.col(spec.row_id)], max_records, spec, rows_per_task
    )
    entity = F.col(spec.entity)
    content = F.concat(
        F.lit("QTL findings for gene "), entity, F.lit(":\n\n"), F.array_join("lines", "\n\n")
    )
    meta = metadata(
        gene_symbol=entity,
        qtl_count=F.col("rows"),
        max_lod=F.col("max_score"),
        chromosomes=F.col("groups"),
        gene_type=F.col("category"),
        part=F.col("block"),
        parts=F.col("parts"),
    )
    id = _continued(F.concat(F.lit("gene_"), entity))
    return chunks.select(*_chunk(id, "gene_group", content, meta, include_raw))


def _position_blocks(
    records: DataFrame, size: int, spec: RecordSpec, rows_per_task: int
) -> DataFrame:
    """Records of each group by position, in numbered blocks."""
    located = records.filter(F.col(spec.group).isNotNull())
    order = [F.asc_nulls_last(spec.position), F.asc(spec.row_id)]
    return blocks_in_order(located, order, size, [spec.group], rows_per_task)


def chunk_by_chromosome(
    records: DataFrame,
    max_qtls_per_chunk: int = 50,
    include_raw: bool = True,
    spec: RecordSpec = DEFAULT_SPEC,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Blocks of neighbouring records of each group, listing their entities."""
    columns = records.columns
    score = F.max(spec.score) if spec.score in columns else F.lit(0.0)
    chunks = (
        _position_blocks(records, max_qtls_per_chunk, spec, rows_per_task)
        .withColumn("_line", format_record(columns, spec))
        .groupBy(spec.group, "block")
        .agg(
            _in_order("position", F.col("_line")).alias("lines"),
            F.count("*").alias("rows"),
            F.min(spec.position).alias("low"),
            F.max(spec.position).alias("high"),
            score.alias("max_score"),
            F.array_distinct(_names("position", spec.entity)).alias("names"),
            *_raw(columns, "position", include_raw),
        )
    )
    group, low, high = F.col(spec.group), F.col("low"), F.col("high")
    content = F.concat(
        F.lit("QTL findings on chromosome "),
        group,
        F.lit(" (positions "),
        _text(fixed(low, 2)),
        F.lit("-"),
        _text(fixed(high, 2)),
        F.lit(" Mb):\n\n"),
        F.array_join("lines", "\n\n"),
    )
    meta = metadata(
        chromosome=group,
        qtl_count=F.col("rows"),
        position_range=F.array(low, high),
        max_lod=F.col("max_score"),
        genes=F.col("names"),
    )
    id = F.concat(F.lit("chr_"), group, F.lit("_part_"), F.col("block").cast("string"))
    return chunks.select(*_chunk(id, "chromosome_group", content, meta, include_raw))


def chunk_by_significance(
    records: DataFrame,
    high_lod_threshold: float = 10.0,
    chunk_size: int = 25,
    include_raw: bool = True,
    spec: RecordSpec = DEFAULT_SPEC,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Records at or above the threshold, then those below in blocks twice as long."""
    columns = records.columns
    tiered = records.withColumn("tier", score_tier(high_lod_threshold, spec))
    tiered = tiered.filter(F.col("tier").isNotNull())
    high = F.col("tier") == "high"
    size = F.when(high, chunk_size).otherwise(2 * chunk_size)
    order = [F.desc(spec.score), F.asc(spec.row_id)]
    chunks = (
        blocks_in_order(tiered, order, size, ["tier"], rows_per_task)
        .withColumn("_line", format_record(columns, spec))
        .groupBy("tier", "block")
        .agg(
            _in_order("position", F.col("_line")).alias("lines"),
            F.count("*").alias("rows"),
            F.array(F.min(spec.score), F.max(spec.score)).alias("range"),
            *_raw(columns, "position", include_raw),
        )
    )
    content = F.concat(
        F.when(high, f"Highly significant QTLs (LOD ≥ {high_lod_threshold})").otherwise(
            f"Moderate significance QTLs (LOD < {high_lod_threshold})"
        ),
        F.lit(":\n\n"),
        F.array_join("lines", "\n\n"),
    )
    meta = metadata(
        significance_level=F.col("tier"),
        lod_threshold=F.lit(high_lod_threshold),
        qtl_count=F.col("rows"),
        lod_range=F.col("range"),
    )
    id = F.concat(
        F.when(high, "high").otherwise("mod"), F.lit("_sig_qtls_part_"), F.col("block").cast("string")
    )
    type = F.when(high, "high_significance").otherwise("moderate_significance")
    return chunks.select(*_chunk(id, type, content, meta, include_raw))


def top_k_in_block(k: int, score: str, order: str, name: str) -> Column:
    """Aggregate: names of the k best scores of a block, ties in block order."""
    best = F.slice(_by_score(score, order, name), 1, k)
    return F.array_compact(best["v"])


def chunk_by_genomic_regions(
    records: DataFrame,
    qtls_per_chunk: int = 30,
    include_raw: bool = True,
    spec: RecordSpec = DEFAULT_SPEC,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Blocks of neighbouring records of each group, headed by their best entities."""
    columns = records.columns
    chunks = (
        _position_blocks(records, qtls_per_chunk, spec, rows_per_task)
        .withColumn("_line", format_record(columns, spec))
        .groupBy(spec.group, "block")
        .agg(
            _in_order("position", F.col("_line")).alias("lines"),
            F.count("*").alias("rows"),
            F.min(spec.position).alias("low"),
            F.max(spec.position).alias("high"),
            F.max(spec.score).alias("max_score"),
            top_k_in_block(5, spec.score, "position", spec.entity).alias("best"),
            *_raw(columns, "position", include_raw),
        )
    )
    group, low, high = F.col(spec.group), F.col("low"), F.col("high")
    content = F.concat(
        F.lit("Genomic region: Chromosome "),
        group,
        F.lit(", "),
        _text(fixed(low, 2)),
        F.lit(" - "),
        _text(fixed(high, 2)),
        F.lit(" Mb\nContains "),
        F.col("rows").cast("string"),
        F.lit(" QTLs\nTop genes by LOD score: "),
        truncate_list(F.col("best"), 3),
        F.lit("\n\nQTL Details:\n"),
        F.array_join("lines", "\n"),
    )
    meta = metadata(
        chromosome=group,
        position_start=low,
        position_end=high,
        qtl_count=F.col("rows"),
        max_lod=F.col("max_score"),
        top_genes=F.col("best"),
        region_span_mb=high - low,
    )
    id = F.concat(F.lit("region_chr"), group, F.lit("_"), F.col("block").cast("string"))
    return chunks.select(*_chunk(id, "genomic_region", content, meta, include_raw))


def entity_sets(
    records: DataFrame,
    genes_per_chunk: int = 20,
    spec: RecordSpec = DEFAULT_SPEC,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Each entity with its `ordinal` of first appearance and the `set_no` it falls in."""
    seen = first_seen_index(records, spec, rows_per_task)
    return seen.withColumn("set_no", block_number(F.col("ordinal"), genes_per_chunk))


def chunk_by_gene_pathways(
    records: DataFrame,
    genes_per_chunk: int = 20,
    include_raw: bool = True,
    max_records: int = MAX_RECORDS_PER_CHUNK,
    spec: RecordSpec = DEFAULT_SPEC,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Sets of entities in order of first appearance, with their records by score.

    A set with more than `max_records` records continues in further chunks, as in
    `chunk_by_gene`; the text and the figures of every part are about the whole set.
    """
    columns = records.columns
    members = stored(entity_sets(records, genes_per_chunk, spec, rows_per_task), "sets")
    sets = members.groupBy("set_no").agg(
        _in_order("ordinal", F.col(spec.entity)).alias("names"), F.count("*").alias("members")
    )
    of_set = records.join(broadcast_small(members.select(spec.entity, "set_no")), spec.entity)
    score_order = [F.desc_nulls_last(spec.score), F.asc(spec.row_id)]
    lined = of_set.withColumn("_line", format_record(columns, spec))
    texts = [
        _by_score(spec.score, spec.row_id, "_line")["v"].alias("lines"),
        *_raw(columns, spec.row_id, include_raw),
    ]
    chunks = _with_figures(lined, texts, "set_no", score_order, max_records, spec, rows_per_task)
    chunks = chunks.join(sets, "set_no")
    number = F.col("set_no").cast("string")
    content = F.concat(
        F.lit("Gene set "),
        number,
        F.lit(": "),
        F.col("members").cast("string"),
        F.lit(" genes with "),
        F.col("rows").cast("string"),
        F.lit(" QTLs\nGenes: "),
        truncate_list(F.col("names"), 10, mark_cut=True),
        F.lit("\n\nQTL Details:\n"),
        F.array_join("lines", "\n"),
    )
    meta = metadata(
        gene_count=F.col("members"),
        genes=F.col("names"),
        qtl_count=F.col("rows"),
        max_lod=F.col("max_score"),
        chromosomes=F.col("groups"),
        avg_lod=F.col("mean_score"),
        part=F.col("block"),
        parts=F.col("parts"),
    )
    id = _continued(F.concat(F.lit("gene_set_"), number))
    return chunks.select(*_chunk(id, "gene_set", content, meta, include_raw))


def chunk_top_records(
    records: DataFrame,
    top_n: int = 200,
    chunk_size: int = 25,
    include_raw: bool = True,
    spec: RecordSpec = DEFAULT_SPEC,
) -> DataFrame:
    """The records with the highest scores, in blocks of consecutive ranks."""
    columns = records.columns
    chunks = (
        top_n_by_score(records, top_n, spec=spec)
        .withColumn("block", block_number(F.col("rank") - 1, chunk_size))
        .withColumn("_line", format_record(columns, spec))
        .groupBy("block")
        .agg(
            _in_order("rank", F.col("_line")).alias("lines"),
            F.count("*").alias("rows"),
            F.min(spec.score).alias("low"),
            F.max(spec.score).alias("high"),
            _names("rank", spec.entity).alias("names"),
            F.array_distinct(_names("rank", spec.group)).alias("groups"),
            *_raw(columns, "rank", include_raw),
        )
    )
    start, end = rank_bounds(F.col("block"), chunk_size, top_n)
    low, high = F.col("low"), F.col("high")
    content = F.concat(
        F.lit("Top QTLs ranked "),
        start.cast("string"),
        F.lit("-"),
        end.cast("string"),
        F.lit(" by LOD score\nLOD score range: "),
        _text(fixed(low, 2)),
        F.lit(" - "),
        _text(fixed(high, 2)),
        F.lit("\n\nQTL Details:\n"),
        F.array_join("lines", "\n"),
    )
    meta = metadata(
        rank_start=start,
        rank_end=end,
        qtl_count=F.col("rows"),
        lod_range=F.array(low, high),
        genes=F.col("names"),
        chromosomes=F.col("groups"),
    )
    id = F.concat(F.lit("top_qtls_"), start.cast("string"), F.lit("_"), end.cast("string"))
    return chunks.select(*_chunk(id, "top_qtls", content, meta, include_raw))
