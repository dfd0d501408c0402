"""Registered queries over the record table: sources, projections, filters, ranks, sums."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.catalog import sql as S
from locusframe.catalog.inputs import peaks
from locusframe.catalog.registry import query
from locusframe.functions import numbers, text
from locusframe.operators import chunkers, filters, ranking, stats
from locusframe.schema import clean_records
from locusframe.sources.records import read_records_csv, split_records_csv
from locusframe.storage import new_path

_COLUMNS = [
    "row_id", "gene_symbol", "gene_id", "gene_type", "qtl_chr", "qtl_pos",
    "qtl_ci_lo", "qtl_ci_hi", "qtl_lod", "qtl_pval", "cis",
]


def _csv(records: DataFrame, label: str) -> str:
    """Write records in row order as CSV without their row ids."""
    path = new_path(records.sparkSession, label)
    records.sort("row_id").drop("row_id").write.csv(path, header=True)
    return path


@query("read_records_csv", S.over_peaks(f"SELECT {', '.join(_COLUMNS)} FROM peaks"))
def _(spark, folder):
    return read_records_csv(spark, _csv(peaks(spark, folder), "csv")).select(*_COLUMNS)


@query(
    "read_records_strict",
    S.over_peaks(
        "SELECT row_id, gene_id, 'qtl_pval: oops' AS parse_error FROM peaks WHERE qtl_pval = 0"
    ),
)
def _(spark, folder):
    pvalue = F.col("qtl_pval")
    spoiled = peaks(spark, folder).withColumn(
        "qtl_pval", F.when(pvalue == 0, "oops").otherwise(pvalue.cast("string"))
    )
    _, rejected = split_records_csv(spark, _csv(spoiled, "spoiled"))
    return rejected.select("row_id", "gene_id", "parse_error")


@query(
    "read_records_quoted",
    S.over_peaks(
        """SELECT row_id, concat('a "', gene_symbol, '", ', qtl_chr) AS gene_symbol, gene_id,
 concat('"', gene_type, '"') AS gene_type, qtl_lod FROM peaks WHERE gene_symbol IS NOT NULL
 UNION ALL SELECT row_id, NULL, gene_id, concat('"', gene_type, '"'), qtl_lod FROM peaks WHERE gene_symbol IS NULL"""
    ),
)
def _(spark, folder):
    symbol = F.concat(F.lit('a "'), F.col("gene_symbol"), F.lit('", '), F.col("qtl_chr"))
    quoted = peaks(spark, folder).withColumns(
        {"gene_symbol": symbol, "gene_type": F.concat(F.lit('"'), F.col("gene_type"), F.lit('"'))}
    )
    path = new_path(spark, "quoted")
    quoted.sort("row_id").drop("row_id").write.csv(path, header=True, escape='"')
    rows = read_records_csv(spark, path)
    return rows.select("row_id", "gene_symbol", "gene_id", "gene_type", "qtl_lod")


@query(
    "read_records_multi_line",
    S.over_peaks(
        """SELECT row_id, concat('a "', gene_symbol, E'",\n', qtl_chr) AS gene_symbol, gene_id, qtl_lod FROM peaks
 WHERE gene_symbol IS NOT NULL UNION ALL SELECT row_id, NULL, gene_id, qtl_lod FROM peaks WHERE gene_symbol IS NULL"""
    ),
)
def _(spark, folder):
    """Cells with line breaks, in files that are cut anywhere."""
    symbol = F.concat(F.lit('a "'), F.col("gene_symbol"), F.lit('",\n'), F.col("qtl_chr"))
    broken = peaks(spark, folder).withColumn("gene_symbol", symbol)
    path = new_path(spark, "multi-line")
    broken.sort("row_id").drop("row_id").write.csv(path, header=True, escape='"')
    return read_records_csv(spark, path, multi_line=True).select("row_id", "gene_symbol", "gene_id", "qtl_lod")


@query("row_ids", S.over_peaks("SELECT row_id, gene_id, qtl_pos FROM peaks"))
def _(spark, folder):
    rows = read_records_csv(spark, _csv(peaks(spark, folder), "csv"))
    return rows.select("row_id", "gene_id", "qtl_pos")


@query("format_record", S.over_peaks(f"SELECT row_id, {S.RECORD} AS content FROM peaks"))
def _(spark, folder):
    df = peaks(spark, folder)
    return df.select("row_id", text.format_record(df.columns).alias("content"))


@query(
    "content_preview",
    S.over_peaks(
        """SELECT row_id, CASE WHEN length(line) > 160 THEN substr(line, 1, 160) || '...' ELSE line END AS cut,
 substr(line, 1, 100) || '...' AS always FROM lines""",
        S.LINES_CTE,
    ),
)
def _(spark, folder):
    df = peaks(spark, folder)
    line = text.format_record(df.columns)
    return df.select(
        "row_id",
        text.preview(line, 160).alias("cut"),
        text.preview(line, 100, always=True).alias("always"),
    )


@query(
    "column_preview",
    S.over_peaks(
        "SELECT CAST(ordinal AS INTEGER) AS ordinal, key, value FROM (SELECT unnest([0,1,2,3,4,5,6,7,8,9]) AS ordinal,"
        " unnest(["
        + ", ".join(f"'{c}'" for c in _COLUMNS[1:])
        + "]) AS key, unnest(["
        + ", ".join(f"CAST({c} AS VARCHAR)" for c in _COLUMNS[1:])
        + "]) AS value FROM (SELECT * FROM peaks ORDER BY row_id LIMIT 1))"
    ),
)
def _(spark, folder):
    return stats.column_preview(peaks(spark, folder))


@query(
    "display_name",
    S.over_peaks(
        f"SELECT row_id, {S.NAME} AS name, coalesce(nullif(gene_symbol, ''), 'N/A') AS symbol,"
        " coalesce(nullif(gene_type, ''), 'N/A') AS category FROM peaks"
    ),
)
def _(spark, folder):
    symbol = F.col("gene_symbol")
    return peaks(spark, folder).select(
        "row_id",
        text.display_name(symbol, F.col("gene_id")).alias("name"),
        text.display_name(symbol, "N/A").alias("symbol"),
        text.display_name(F.col("gene_type"), "N/A").alias("category"),
    )


@query(
    "record_lines",
    S.over_peaks(
        f"""SELECT row_id, concat(row_id + 1, {S.RANKED_LINE}) AS ranked, {S.GROUP_LINE} AS in_group,
 {S.PVALUE_LINE} AS by_pvalue, {S.CONTEXT_LINE} AS context FROM peaks"""
    ),
)
def _(spark, folder):
    return peaks(spark, folder).select(
        "row_id",
        text.ranked_line(F.col("row_id") + 1).alias("ranked"),
        text.group_line().alias("in_group"),
        text.pvalue_line().alias("by_pvalue"),
        text.context_line().alias("context"),
    )


@query(
    "fixed",
    S.over_peaks(
        f"SELECT row_id, {S.fixed('qtl_lod', 2)} AS two, {S.fixed('qtl_ci_lo', 3)} AS three,"
        f" {S.fixed('qtl_pval', 3)} AS small FROM peaks"
    ),
)
def _(spark, folder):
    return peaks(spark, folder).select(
        "row_id",
        numbers.fixed(F.col("qtl_lod"), 2).alias("two"),
        numbers.fixed(F.col("qtl_ci_lo"), 3).alias("three"),
        numbers.fixed(F.col("qtl_pval"), 3).alias("small"),
    )


@query("exponential", S.over_peaks(f"SELECT row_id, {S.exponential('qtl_pval')} AS p FROM peaks"))
def _(spark, folder):
    return peaks(spark, folder).select("row_id", numbers.exponential(F.col("qtl_pval")).alias("p"))


@query(
    "number_text",
    S.over_peaks(
        f"SELECT row_id, {S.text_of('qtl_lod')} AS lod, {S.text_of('qtl_pval')} AS p,"
        f" {S.js_text_of('qtl_lod')} AS js_lod, {S.js_text_of('qtl_pval')} AS js_p FROM peaks"
    ),
)
def _(spark, folder):
    lod, p = F.col("qtl_lod"), F.col("qtl_pval")
    return peaks(spark, folder).select(
        "row_id",
        numbers.number_text(lod).alias("lod"),
        numbers.number_text(p).alias("p"),
        numbers.js_number_text(lod).alias("js_lod"),
        numbers.js_number_text(p).alias("js_p"),
    )


@query(
    "join_text",
    S.over_peaks(
        "SELECT row_id, concat_ws(' | ', gene_symbol, gene_id, gene_type) AS bars,"
        " concat_ws(', ', gene_symbol, gene_id) AS commas FROM peaks"
    ),
)
def _(spark, folder):
    return peaks(spark, folder).select(
        "row_id",
        text.join_text(F.array("gene_symbol", "gene_id", "gene_type"), " | ").alias("bars"),
        text.join_text(F.array("gene_symbol", "gene_id"), ", ").alias("commas"),
    )


@query(
    "flag_text",
    S.over_peaks("SELECT row_id, CASE WHEN cis THEN 'cis-acting' ELSE 'trans-acting' END AS t FROM peaks"),
)
def _(spark, folder):
    return peaks(spark, folder).select("row_id", text.flag_text(F.col("cis")).alias("t"))


@query(
    "bounded_min",
    S.over_peaks("SELECT row_id, least((row_id // 25 + 1) * 25, 200) AS bounded FROM peaks"),
)
def _(spark, folder):
    _, end = ranking.rank_bounds(text.block_number(F.col("row_id"), 25), 25, 200)
    return peaks(spark, folder).select("row_id", end.alias("bounded"))


@query("block_number", S.over_peaks("SELECT row_id, row_id // 25 + 1 AS block FROM peaks"))
def _(spark, folder):
    return peaks(spark, folder).select(
        "row_id", text.block_number(F.col("row_id"), 25).alias("block")
    )


@query(
    "span",
    S.over_peaks(
        """SELECT concat('region_chr', qtl_chr, '_', block) AS id, round(max(qtl_pos) - min(qtl_pos), 6) AS span
 FROM placed GROUP BY qtl_chr, block""",
        S.LINES_CTE,
        S.placed("qtl_pos NULLS LAST, row_id", "30", "qtl_chr"),
    ),
)
def _(spark, folder):
    chunks = chunkers.chunk_by_genomic_regions(peaks(spark, folder), include_raw=False)
    return chunks.select("id", F.round("metadata.region_span_mb", 6).alias("span"))


@query(
    "truncate_list",
    S.over_peaks(
        """SELECT gene_id, list_aggregate(t[1:3], 'string_agg', ', ') AS three,
 list_aggregate(t[1:2], 'string_agg', ', ') || CASE WHEN len(t) > 2 THEN '...' ELSE '' END AS marked
 FROM (SELECT gene_id, list_sort(list(DISTINCT gene_type)) AS t FROM peaks GROUP BY gene_id)"""
    ),
)
def _(spark, folder):
    types = peaks(spark, folder).groupBy("gene_id").agg(
        F.sort_array(F.collect_set("gene_type")).alias("t")
    )
    return types.select(
        "gene_id",
        text.truncate_list(F.col("t"), 3).alias("three"),
        text.truncate_list(F.col("t"), 2, mark_cut=True).alias("marked"),
    )


@query(
    "is_missing",
    S.over_peaks("SELECT row_id, gene_symbol IS NULL AS no_name, qtl_lod IS NULL AS no_score FROM peaks"),
)
def _(spark, folder):
    score = F.coalesce("qtl_lod", F.lit(float("nan")))
    return clean_records(peaks(spark, folder).withColumn("qtl_lod", score)).select(
        "row_id",
        F.col("gene_symbol").isNull().alias("no_name"),
        F.col("qtl_lod").isNull().alias("no_score"),
    )


@query(
    "score_tier",
    S.over_peaks(
        "SELECT row_id, CASE WHEN qtl_lod >= 10 THEN 'high' WHEN qtl_lod < 10 THEN 'moderate' END AS tier FROM peaks"
    ),
)
def _(spark, folder):
    return peaks(spark, folder).select("row_id", filters.score_tier(10.0).alias("tier"))


@query("in_group", S.over_peaks("SELECT row_id, qtl_lod FROM peaks WHERE qtl_chr = '11'"))
def _(spark, folder):
    return filters.in_group(peaks(spark, folder), 11).select("row_id", "qtl_lod")


@query(
    "score_above",
    S.over_peaks("SELECT row_id, qtl_lod FROM peaks WHERE qtl_chr = '11' AND qtl_lod > 20"),
)
def _(spark, folder):
    group = filters.in_group(peaks(spark, folder), 11)
    return filters.score_above(group, 20.0).select("row_id", "qtl_lod")


@query(
    "pvalue_below",
    S.over_peaks("SELECT row_id, qtl_pval FROM peaks WHERE qtl_pval <> 0 AND qtl_pval < 0.001"),
)
def _(spark, folder):
    return filters.pvalue_below(peaks(spark, folder), 0.001).select("row_id", "qtl_pval")


@query("has_score", S.over_peaks("SELECT row_id FROM peaks WHERE qtl_lod IS NOT NULL AND qtl_lod <> 0"))
def _(spark, folder):
    return filters.has_score(peaks(spark, folder), keep_zero=False).select("row_id")


@query("has_pvalue", S.over_peaks("SELECT row_id FROM peaks WHERE qtl_pval IS NOT NULL AND qtl_pval <> 0"))
def _(spark, folder):
    return filters.has_pvalue(peaks(spark, folder), keep_zero=False).select("row_id")


@query(
    "has_entity",
    S.over_peaks("SELECT row_id, gene_symbol FROM peaks WHERE gene_symbol IS NOT NULL AND gene_symbol <> ''"),
)
def _(spark, folder):
    return filters.has_entity(peaks(spark, folder)).select("row_id", "gene_symbol")


@query(
    "entity_in_set",
    S.over_peaks(
        """SELECT row_id, gene_symbol FROM peaks WHERE gene_symbol IN
 (SELECT gene_symbol FROM peaks WHERE qtl_lod >= 300)"""
    ),
)
def _(spark, folder):
    df = peaks(spark, folder)
    strong = df.filter(F.col("qtl_lod") >= 300).select("gene_symbol").distinct()
    return filters.records_for_entity_set(df, strong).select("row_id", "gene_symbol")


@query(
    "non_empty_group",
    S.over_peaks("SELECT CASE WHEN qtl_lod >= 1e6 THEN 'high' ELSE 'moderate' END AS tier, count(*) AS n"
                 " FROM peaks WHERE qtl_lod IS NOT NULL GROUP BY 1"),
)
def _(spark, folder):
    tiers = peaks(spark, folder).withColumn("tier", filters.score_tier(1e6))
    return tiers.filter(F.col("tier").isNotNull()).groupBy("tier").agg(F.count("*").alias("n"))


@query(
    "group_counts",
    S.over_peaks(
        """SELECT qtl_chr, count(*) AS "rows" FROM peaks GROUP BY qtl_chr
 ORDER BY count(*) DESC, TRY_CAST(qtl_chr AS BIGINT) NULLS LAST, min(row_id) LIMIT 10"""
    ),
)
def _(spark, folder):
    return stats.group_counts(peaks(spark, folder))


@query(
    "order_by_count",
    S.over_peaks(
        """SELECT gene_type AS qtl_chr, count(*) AS "rows" FROM peaks GROUP BY gene_type
 ORDER BY count(*) DESC, min(row_id) LIMIT 10"""
    ),
)
def _(spark, folder):
    df = peaks(spark, folder).withColumn("qtl_chr", F.col("gene_type"))
    return stats.group_counts(df)


_SUMMARY = """count(*) AS records, round({mean}, 6) AS mean_score, {max} AS max_score,
 count(DISTINCT qtl_chr) + CAST(max(CASE WHEN qtl_chr IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS groups"""


@query(
    "dataset_summary",
    S.over_peaks(
        "SELECT " + _SUMMARY.format(mean="avg(coalesce(qtl_lod, 0))", max="max(coalesce(qtl_lod, 0))")
        + ", count(DISTINCT nullif(gene_symbol, '')) AS entities FROM peaks"
    ),
)
def _(spark, folder):
    summary = stats.dataset_summary(peaks(spark, folder))
    return summary.withColumn("mean_score", F.round("mean_score", 6))


@query(
    "score_overview",
    S.over_peaks("SELECT " + _SUMMARY.format(mean="avg(qtl_lod)", max="max(qtl_lod)") + " FROM peaks"),
)
def _(spark, folder):
    overview = stats.score_overview(peaks(spark, folder))
    return overview.withColumn("mean_score", F.round("mean_score", 6))


@query(
    "unique_entities",
    S.over_peaks(
        """SELECT gene_symbol, row_id, row_number() OVER (ORDER BY row_id) AS rank, total FROM
 (SELECT gene_symbol, min(row_id) AS row_id, count(*) OVER () AS total FROM peaks
  WHERE gene_symbol IS NOT NULL AND gene_symbol <> '' GROUP BY gene_symbol ORDER BY 2 LIMIT 15)"""
    ),
)
def _(spark, folder):
    return stats.unique_entities(peaks(spark, folder))


@query(
    "match_count_and_more",
    S.over_peaks(
        """SELECT row_id, qtl_pval, row_number() OVER (ORDER BY row_id) AS rank, total, greatest(total - 10, 0) AS more
 FROM (SELECT *, count(*) OVER () AS total FROM peaks WHERE qtl_pval <> 0 AND qtl_pval < 0.001 ORDER BY row_id LIMIT 10)"""
    ),
)
def _(spark, folder):
    matches = filters.pvalue_below(peaks(spark, folder), 0.001)
    return stats.match_count_and_more(matches).select("row_id", "qtl_pval", "rank", "total", "more")


@query(
    "blocks_in_group",
    S.over_peaks(
        "SELECT row_id, qtl_chr, position, block FROM placed",
        S.LINES_CTE,
        S.placed("qtl_pos NULLS LAST, row_id", "50", "qtl_chr"),
    ),
)
def _(spark, folder):
    order = [F.asc_nulls_last("qtl_pos"), F.asc("row_id")]
    blocks = ranking.blocks_in_order(peaks(spark, folder), order, 50, ["qtl_chr"])
    return blocks.select("row_id", "qtl_chr", "position", "block")


@query(
    "sort_position",
    S.over_peaks(
        "SELECT row_id, qtl_chr, row_number() OVER (PARTITION BY qtl_chr ORDER BY qtl_pos NULLS LAST, row_id) - 1"
        " AS position FROM peaks"
    ),
)
def _(spark, folder):
    order = [F.asc_nulls_last("qtl_pos"), F.asc("row_id")]
    placed = ranking.position_in_order(peaks(spark, folder), order, ["qtl_chr"])
    return placed.select("row_id", "qtl_chr", "position")


_GLOBAL = "row_number() OVER (ORDER BY qtl_lod DESC NULLS LAST, row_id) - 1"


@query("sort_score", S.over_peaks(f"SELECT row_id, {_GLOBAL} AS position FROM peaks"))
def _(spark, folder):
    order = [F.desc_nulls_last("qtl_lod"), F.asc("row_id")]
    # A low limit makes this the cluster-wide sort at every scale.
    placed = ranking.position_in_order(peaks(spark, folder), order, rows_per_task=500)
    return placed.select("row_id", "position")


@query("global_blocks", S.over_peaks(f"SELECT row_id, ({_GLOBAL}) // 25 + 1 AS block FROM peaks"))
def _(spark, folder):
    order = [F.desc_nulls_last("qtl_lod"), F.asc("row_id")]
    return ranking.blocks_in_order(peaks(spark, folder), order, 25).select("row_id", "block")


_SEEN = """seen AS (SELECT gene_symbol, first_row, row_number() OVER (ORDER BY first_row) - 1 AS ordinal FROM
 (SELECT gene_symbol, min(row_id) AS first_row FROM peaks WHERE gene_symbol IS NOT NULL GROUP BY 1))"""


@query("first_seen_index", S.over_peaks("SELECT gene_symbol, first_row, ordinal FROM seen", _SEEN))
def _(spark, folder):
    return ranking.first_seen_index(peaks(spark, folder)).select(
        "gene_symbol", "first_row", "ordinal"
    )


@query(
    "records_for_gene_set",
    S.over_peaks(
        "SELECT row_id, gene_symbol, ordinal // 20 + 1 AS set_no FROM peaks JOIN seen USING (gene_symbol)",
        _SEEN,
    ),
)
def _(spark, folder):
    from locusframe.operators.chunkers import entity_sets

    df = peaks(spark, folder)
    members = entity_sets(df).select("gene_symbol", "set_no")
    return df.select("row_id", "gene_symbol").join(members, "gene_symbol")


@query(
    "rank_bounds",
    S.over_peaks(
        """SELECT block, (block - 1) * 25 + 1 AS rank_start, least(block * 25, 200) AS rank_end, count(*) AS n
 FROM (SELECT (row_number() OVER (ORDER BY qtl_lod DESC NULLS LAST, row_id) - 1) // 25 + 1 AS block
  FROM peaks ORDER BY qtl_lod DESC NULLS LAST, row_id LIMIT 200) GROUP BY ALL"""
    ),
)
def _(spark, folder):
    top = ranking.top_n_by_score(peaks(spark, folder), 200)
    start, end = ranking.rank_bounds(F.col("block"), 25, 200)
    return (
        top.groupBy(text.block_number(F.col("rank") - 1, 25).alias("block"))
        .agg(F.count("*").alias("n"))
        .select("block", start.alias("rank_start"), end.alias("rank_end"), "n")
    )


@query(
    "stride_sample",
    S.over_peaks(
        """SELECT row_id, gene_id FROM peaks, (SELECT greatest(count(*) // 10, 1) AS stride FROM peaks)
 WHERE row_id % stride = 0 AND row_id < 10 * stride"""
    ),
)
def _(spark, folder):
    return ranking.stride_sample(peaks(spark, folder)).select("row_id", "gene_id")


_TOP = "SELECT row_id, qtl_lod, row_number() OVER (ORDER BY qtl_lod DESC NULLS LAST, row_id) AS rank FROM peaks"


@query("top_n_by_score", S.over_peaks(_TOP + " ORDER BY rank LIMIT 200"))
def _(spark, folder):
    return ranking.top_n_by_score(peaks(spark, folder), 200).select("row_id", "qtl_lod", "rank")


@query(
    "top_k_in_block",
    S.over_peaks(
        """SELECT qtl_chr, block, string_agg(gene_symbol, ', ' ORDER BY r) AS best FROM
 (SELECT *, row_number() OVER (PARTITION BY qtl_chr, block ORDER BY qtl_lod DESC NULLS LAST, position) AS r FROM placed)
 WHERE r <= 5 GROUP BY ALL""",
        S.LINES_CTE,
        S.placed("qtl_pos NULLS LAST, row_id", "30", "qtl_chr"),
    ),
)
def _(spark, folder):
    from locusframe.operators.chunkers import top_k_in_block

    order = [F.asc_nulls_last("qtl_pos"), F.asc("row_id")]
    blocks = ranking.blocks_in_order(peaks(spark, folder), order, 30, ["qtl_chr"])
    best = top_k_in_block(5, "qtl_lod", "position", "gene_symbol")
    return blocks.groupBy("qtl_chr", "block").agg(F.array_join(best, ", ").alias("best"))


@query(
    "lowest_pvalues",
    S.over_peaks(
        "SELECT row_id, qtl_pval, row_number() OVER (ORDER BY qtl_pval, row_id) AS rank FROM peaks"
        " WHERE qtl_pval IS NOT NULL ORDER BY rank LIMIT 20"
    ),
)
def _(spark, folder):
    return ranking.lowest_pvalues(peaks(spark, folder)).select("row_id", "qtl_pval", "rank")


@query(
    "head",
    S.over_peaks(
        "SELECT row_id, qtl_chr, row_number() OVER (ORDER BY row_id) AS rank FROM peaks ORDER BY row_id LIMIT 50"
    ),
)
def _(spark, folder):
    return ranking.head(peaks(spark, folder), 50).select("row_id", "qtl_chr", "rank")


@query(
    "top_plus_sample",
    S.over_peaks(
        """SELECT row_id, CAST(0 AS INTEGER) AS source_order, rank FROM
 (SELECT row_id, row_number() OVER (ORDER BY qtl_lod DESC, row_id) AS rank FROM peaks WHERE qtl_lod IS NOT NULL)
 WHERE rank <= 10
 UNION ALL SELECT row_id, CAST(1 AS INTEGER), row_number() OVER (ORDER BY row_id) FROM peaks,
 (SELECT greatest(count(*) // 10, 1) AS stride FROM peaks) WHERE row_id % stride = 0 AND row_id < 10 * stride"""
    ),
)
def _(spark, folder):
    return ranking.top_plus_sample(peaks(spark, folder)).select("row_id", "source_order", "rank")


@query(
    "distinct_values",
    S.over_peaks(
        "SELECT DISTINCT 'gene' AS kind, gene_symbol AS value FROM peaks UNION ALL"
        " SELECT DISTINCT 'chromosome', qtl_chr FROM peaks"
    ),
)
def _(spark, folder):
    df = peaks(spark, folder)
    genes = stats.distinct_values(df, "gene_symbol")
    chromosomes = stats.distinct_values(df, "qtl_chr")
    return genes.select(F.lit("gene").alias("kind"), F.col("gene_symbol").alias("value")).union(
        chromosomes.select(F.lit("chromosome"), "qtl_chr")
    )
