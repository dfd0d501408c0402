"""Registered queries that build, store and read chunk tables."""

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusframe.catalog import sql as S
from locusframe.catalog.inputs import peaks
from locusframe.catalog.registry import query
from locusframe.operators import chunkers, stats
from locusframe.sources import chunks as json_chunks
from locusframe.storage import bounded_batches, new_path


def flat(chunks: DataFrame, *fields: str, raw: bool = True) -> DataFrame:
    """Chunk columns as scalars: name lists joined, ranges as two columns."""
    types = {f.name: f.dataType for f in chunks.schema["metadata"].dataType.fields}
    columns = [F.col("id"), F.col("content")]
    for name in fields:
        value = F.col(f"metadata.{name}")
        if types[name] == T.ArrayType(T.StringType()):
            columns.append(F.array_join(value, ", ").alias(name))
        elif types[name] == T.ArrayType(T.DoubleType()):
            columns += [
                F.get(value, F.lit(0)).alias(f"{name}_lo"),
                F.get(value, F.lit(1)).alias(f"{name}_hi"),
            ]
        else:
            columns.append(value.alias(name))
    if raw:
        ids = F.transform("raw_data", lambda row: row["row_id"].cast("string"))
        columns.append(F.array_join(ids, " ").alias("raw_ids"))
    return chunks.select(*columns)


_ROW_SQL = """SELECT concat('qtl_', row_id) AS id, line AS content, gene_symbol, qtl_lod, qtl_chr, qtl_pos, qtl_pval,
 cis, gene_type, CAST(row_id AS VARCHAR) AS raw_ids FROM lines"""
_ROW_FIELDS = ["gene_symbol", "qtl_lod", "qtl_chr", "qtl_pos", "qtl_pval", "cis", "gene_type"]


@query("chunk_by_row", S.over_peaks(_ROW_SQL, S.LINES_CTE))
def _(spark, folder):
    return flat(chunkers.chunk_by_row(peaks(spark, folder)), *_ROW_FIELDS)


@query(
    "chunk_by_gene",
    S.over_peaks(
        f"""SELECT concat('gene_', gene_symbol) AS id, concat('QTL findings for gene ', gene_symbol, E':\\n\\n', txt) AS content,
 gene_symbol, n AS qtl_count, max_lod, coalesce(chromosomes, '') AS chromosomes, gene_type, raw_ids
 FROM (SELECT gene_symbol, string_agg(line, E'\\n\\n' ORDER BY row_id) AS txt, count(*) AS n, max(qtl_lod) AS max_lod,
  arg_min(gene_type, row_id) AS gene_type, {S.raw_ids('row_id')} FROM lines WHERE gene_symbol IS NOT NULL GROUP BY 1)
 LEFT JOIN chromosomes USING (gene_symbol)""",
        S.LINES_CTE,
        S.names("gene_symbol", "qtl_chr", "row_id", "lines", "chromosomes"),
    ),
)
def _(spark, folder):
    chunks = chunkers.chunk_by_gene(peaks(spark, folder))
    return flat(chunks, "gene_symbol", "qtl_count", "max_lod", "chromosomes", "gene_type")


@query(
    "chunk_by_gene_parts",
    S.over_peaks(
        f"""SELECT concat('gene_', gene_symbol, CASE WHEN part > 1 THEN concat('_part_', part) ELSE '' END) AS id,
 concat('QTL findings for gene ', gene_symbol, E':\\n\\n', txt) AS content, gene_symbol, n AS qtl_count, max_lod,
 coalesce(chromosomes, '') AS chromosomes, gene_type, part, CAST((n + 4) // 5 AS BIGINT) AS parts, raw_ids
 FROM (SELECT gene_symbol, part, string_agg(line, E'\\n\\n' ORDER BY row_id) AS txt, {S.raw_ids('row_id')}
  FROM (SELECT *, CAST((row_number() OVER (PARTITION BY gene_symbol ORDER BY row_id) - 1) // 5 + 1 AS BIGINT) AS part
   FROM lines WHERE gene_symbol IS NOT NULL) GROUP BY 1, 2)
 JOIN (SELECT gene_symbol, count(*) AS n, max(qtl_lod) AS max_lod, arg_min(gene_type, row_id) AS gene_type
  FROM lines WHERE gene_symbol IS NOT NULL GROUP BY 1) USING (gene_symbol)
 LEFT JOIN chromosomes USING (gene_symbol)""",
        S.LINES_CTE,
        S.names("gene_symbol", "qtl_chr", "row_id", "lines", "chromosomes"),
    ),
)
def _(spark, folder):
    chunks = chunkers.chunk_by_gene(peaks(spark, folder), max_records=5)
    return flat(
        chunks, "gene_symbol", "qtl_count", "max_lod", "chromosomes", "gene_type", "part", "parts"
    )


_CHR_SQL = S.over_peaks("SELECT * FROM chunks", *S.CHROMOSOME_CHUNKS)
_CHR_FIELDS = ["chromosome", "qtl_count", "position_range", "max_lod", "genes"]


@query("chunk_by_chromosome", _CHR_SQL)
def _(spark, folder):
    return flat(chunkers.chunk_by_chromosome(peaks(spark, folder)), *_CHR_FIELDS)


def significance(raw: bool = True) -> tuple[str, ...]:
    """CTEs `tiered` over peaks: chunks of both significance tiers."""
    return (
        S.LINES_CTE,
        "tiers AS (SELECT *, CASE WHEN qtl_lod >= 10 THEN 'high' ELSE 'mod' END AS tier,"
        " CASE WHEN qtl_lod >= 10 THEN 25 ELSE 50 END AS size FROM lines WHERE qtl_lod IS NOT NULL)",
        "tiered0 AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY qtl_lod DESC, row_id) - 1 AS position FROM tiers)",
        f"""tiered AS (SELECT concat(tier, '_sig_qtls_part_', position // size + 1) AS id,
 concat(CASE WHEN tier = 'high' THEN 'Highly significant QTLs (LOD ≥ 10.0)' ELSE 'Moderate significance QTLs (LOD < 10.0)' END,
  E':\\n\\n', string_agg(line, E'\\n\\n' ORDER BY position)) AS content,
 CASE WHEN tier = 'high' THEN 'high' ELSE 'moderate' END AS significance_level, CAST(10 AS DOUBLE) AS lod_threshold,
 count(*) AS qtl_count, min(qtl_lod) AS lod_range_lo, max(qtl_lod) AS lod_range_hi, {S.raw_ids('position')}
 FROM tiered0 GROUP BY tier, position // size)""",
    )


_SIG_FIELDS = ["significance_level", "lod_threshold", "qtl_count", "lod_range"]


@query("chunk_by_significance", S.over_peaks("SELECT * FROM tiered", *significance()))
def _(spark, folder):
    return flat(chunkers.chunk_by_significance(peaks(spark, folder)), *_SIG_FIELDS)


@query(
    "union_tiers",
    S.over_peaks(
        "SELECT id, CASE WHEN significance_level = 'high' THEN 'high_significance' ELSE 'moderate_significance' END AS type,"
        " qtl_count FROM tiered",
        *significance(),
    ),
)
def _(spark, folder):
    chunks = chunkers.chunk_by_significance(peaks(spark, folder))
    return chunks.select("id", "type", "metadata.qtl_count")


@query(
    "chunk_by_genomic_regions",
    S.over_peaks(
        f"""SELECT concat('region_chr', qtl_chr, '_', block) AS id,
 concat('Genomic region: Chromosome ', qtl_chr, ', ', {S.fixed('lo', 2)}, ' - ', {S.fixed('hi', 2)}, E' Mb\\nContains ', n,
  E' QTLs\\nTop genes by LOD score: ', coalesce(three, ''), E'\\n\\nQTL Details:\\n', txt) AS content,
 qtl_chr AS chromosome, lo AS position_start, hi AS position_end, n AS qtl_count, max_lod,
 coalesce(five, '') AS top_genes, hi - lo AS region_span_mb, raw_ids
 FROM (SELECT qtl_chr, block, string_agg(line, E'\\n' ORDER BY position) AS txt, count(*) AS n, min(qtl_pos) AS lo,
  max(qtl_pos) AS hi, max(qtl_lod) AS max_lod, {S.raw_ids('position')} FROM placed GROUP BY ALL)
 LEFT JOIN (SELECT qtl_chr, block, string_agg(gene_symbol, ', ' ORDER BY r) AS five,
  string_agg(gene_symbol, ', ' ORDER BY r) FILTER (s <= 3) AS three FROM
  (SELECT *, row_number() OVER (PARTITION BY qtl_chr, block ORDER BY r) AS s FROM
   (SELECT *, row_number() OVER (PARTITION BY qtl_chr, block ORDER BY qtl_lod DESC NULLS LAST, position) AS r FROM placed)
   WHERE r <= 5 AND gene_symbol IS NOT NULL)
  GROUP BY ALL) USING (qtl_chr, block)""",
        S.LINES_CTE,
        S.placed("qtl_pos NULLS LAST, row_id", "30", "qtl_chr"),
    ),
)
def _(spark, folder):
    chunks = chunkers.chunk_by_genomic_regions(peaks(spark, folder))
    return flat(
        chunks, "chromosome", "position_start", "position_end", "qtl_count", "max_lod", "top_genes",
        "region_span_mb",
    )


@query(
    "chunk_by_gene_pathways",
    S.over_peaks(
        f"""SELECT concat('gene_set_', set_no) AS id,
 concat('Gene set ', set_no, ': ', gene_count, ' genes with ', n, E' QTLs\\nGenes: ', shown, E'\\n\\nQTL Details:\\n', txt) AS content,
 gene_count, genes, n AS qtl_count, max_lod, coalesce(chromosomes, '') AS chromosomes, round(mean, 6) AS avg_lod, raw_ids
 FROM (SELECT set_no, string_agg(line, E'\\n' ORDER BY qtl_lod DESC NULLS LAST, row_id) AS txt, count(*) AS n,
  max(qtl_lod) AS max_lod, avg(qtl_lod) AS mean, {S.raw_ids('row_id')} FROM members GROUP BY 1)
 JOIN (SELECT set_no, count(*) AS gene_count, string_agg(gene_symbol, ', ' ORDER BY ordinal) AS genes,
  string_agg(gene_symbol, ', ' ORDER BY ordinal) FILTER (ordinal % 20 < 10) || CASE WHEN count(*) > 10 THEN '...' ELSE '' END AS shown
  FROM sets GROUP BY 1) USING (set_no) LEFT JOIN chromosomes USING (set_no)""",
        S.LINES_CTE,
        """sets AS (SELECT gene_symbol, ordinal, ordinal // 20 + 1 AS set_no FROM
 (SELECT gene_symbol, row_number() OVER (ORDER BY min(row_id)) - 1 AS ordinal FROM peaks
  WHERE gene_symbol IS NOT NULL GROUP BY 1))""",
        "members AS (SELECT * FROM lines JOIN sets USING (gene_symbol))",
        S.names("set_no", "qtl_chr", "row_id", "members", "chromosomes"),
    ),
)
def _(spark, folder):
    chunks = chunkers.chunk_by_gene_pathways(peaks(spark, folder))
    fields = ["gene_count", "genes", "qtl_count", "max_lod", "chromosomes", "avg_lod"]
    return flat(chunks, *fields).withColumn("avg_lod", F.round("avg_lod", 6))


@query(
    "chunk_by_gene_pathways_parts",
    S.over_peaks(
        f"""SELECT concat('gene_set_', set_no, CASE WHEN part > 1 THEN concat('_part_', part) ELSE '' END) AS id,
 concat('Gene set ', set_no, ': ', gene_count, ' genes with ', n, E' QTLs\\nGenes: ', shown, E'\\n\\nQTL Details:\\n', txt) AS content,
 n AS qtl_count, max_lod, coalesce(chromosomes, '') AS chromosomes, round(mean, 6) AS avg_lod, part,
 CAST((n + 49) // 50 AS BIGINT) AS parts, raw_ids
 FROM (SELECT set_no, part, string_agg(line, E'\\n' ORDER BY qtl_lod DESC NULLS LAST, row_id) AS txt, {S.raw_ids('row_id')}
  FROM (SELECT *, CAST((row_number() OVER (PARTITION BY set_no ORDER BY qtl_lod DESC NULLS LAST, row_id) - 1) // 50 + 1 AS BIGINT)
   AS part FROM members) GROUP BY 1, 2)
 JOIN (SELECT set_no, count(*) AS n, max(qtl_lod) AS max_lod, avg(qtl_lod) AS mean FROM members GROUP BY 1) USING (set_no)
 JOIN (SELECT set_no, count(*) AS gene_count,
  string_agg(gene_symbol, ', ' ORDER BY ordinal) FILTER (ordinal % 20 < 10) || CASE WHEN count(*) > 10 THEN '...' ELSE '' END AS shown
  FROM sets GROUP BY 1) USING (set_no) LEFT JOIN chromosomes USING (set_no)""",
        S.LINES_CTE,
        """sets AS (SELECT gene_symbol, ordinal, ordinal // 20 + 1 AS set_no FROM
 (SELECT gene_symbol, row_number() OVER (ORDER BY min(row_id)) - 1 AS ordinal FROM peaks
  WHERE gene_symbol IS NOT NULL GROUP BY 1))""",
        "members AS (SELECT * FROM lines JOIN sets USING (gene_symbol))",
        S.names("set_no", "qtl_chr", "row_id", "members", "chromosomes"),
    ),
)
def _(spark, folder):
    chunks = chunkers.chunk_by_gene_pathways(peaks(spark, folder), max_records=50)
    fields = ["qtl_count", "max_lod", "chromosomes", "avg_lod", "part", "parts"]
    return flat(chunks, *fields).withColumn("avg_lod", F.round("avg_lod", 6))


def top_chunks() -> tuple[str, ...]:
    """CTEs `top_body` over peaks: the chunks of the top 200 records."""
    return (
        S.LINES_CTE,
        """ranked AS (SELECT *, row_number() OVER (ORDER BY qtl_lod DESC NULLS LAST, row_id) AS rank FROM lines
 ORDER BY rank LIMIT 200)""",
        "placed AS (SELECT *, (rank - 1) // 25 + 1 AS block FROM ranked)",
        S.names("block", "qtl_chr", "rank", out="chromosomes"),
        f"""top_body AS (SELECT concat('top_qtls_', s, '_', e) AS id,
 concat('Top QTLs ranked ', s, '-', e, E' by LOD score\\nLOD score range: ', {S.fixed('lo', 2)}, ' - ', {S.fixed('hi', 2)},
  E'\\n\\nQTL Details:\\n', txt) AS content,
 s AS rank_start, e AS rank_end, n AS qtl_count, lo AS lod_range_lo, hi AS lod_range_hi, coalesce(genes, '') AS genes,
 chromosomes, raw_ids
 FROM (SELECT block, (block - 1) * 25 + 1 AS s, least(block * 25, 200) AS e, count(*) AS n, min(qtl_lod) AS lo,
  max(qtl_lod) AS hi, string_agg(line, E'\\n' ORDER BY rank) AS txt,
  string_agg(gene_symbol, ', ' ORDER BY rank) AS genes, {S.raw_ids('rank')} FROM placed GROUP BY block)
 JOIN chromosomes USING (block))""",
    )


_TOP_FIELDS = ["rank_start", "rank_end", "qtl_count", "lod_range", "genes", "chromosomes"]


@query("chunk_top_records", S.over_peaks("SELECT * FROM top_body", *top_chunks()))
def _(spark, folder):
    return flat(chunkers.chunk_top_records(peaks(spark, folder)), *_TOP_FIELDS)


@query(
    "chunk_metadata",
    S.over_peaks("SELECT id, 'single_qtl' AS type, qtl_lod, qtl_chr FROM (" + _ROW_SQL + ")", S.LINES_CTE),
)
def _(spark, folder):
    chunks = chunkers.chunk_by_row(peaks(spark, folder))
    return json_chunks.chunk_metadata(chunks).select(
        "id", "type", "metadata.qtl_lod", "metadata.qtl_chr"
    )


@query(
    "row_chunk_stats",
    S.over_peaks("SELECT count(*) AS chunks, min(qtl_lod) AS min_lod, max(qtl_lod) AS max_lod FROM peaks"),
)
def _(spark, folder):
    return stats.row_chunk_stats(chunkers.chunk_by_row(peaks(spark, folder)))


@query(
    "block_chunk_stats",
    S.over_peaks(
        "SELECT count(*) AS chunks, CAST(sum(qtl_count) AS BIGINT) AS records, min(lod_range_lo) AS min_lod,"
        " max(lod_range_hi) AS max_lod FROM tiered",
        *significance(),
    ),
)
def _(spark, folder):
    return stats.block_chunk_stats(chunkers.chunk_by_significance(peaks(spark, folder)))


def _stored(spark, folder, chunks: DataFrame) -> str:
    path = new_path(spark, "chunks")
    json_chunks.write_chunks_json(chunks, path)
    return path


@query(
    "write_chunks_json",
    S.over_peaks(
        "SELECT significance_level, count(*) AS chunks, CAST(sum(qtl_count) AS BIGINT) AS records,"
        " CAST(sum(length(content)) AS BIGINT) AS characters FROM tiered GROUP BY 1",
        *significance(),
    ),
)
def _(spark, folder):
    df = peaks(spark, folder)
    path = _stored(spark, folder, chunkers.chunk_by_significance(df))
    return (
        json_chunks.read_chunks_json(spark, path, df.schema)
        .groupBy("metadata.significance_level")
        .agg(
            F.count("*").alias("chunks"),
            F.sum("metadata.qtl_count").alias("records"),
            F.sum(F.char_length("content")).alias("characters"),
        )
    )


@query("read_chunks_json", _CHR_SQL)
def _(spark, folder):
    df = peaks(spark, folder)
    path = _stored(spark, folder, chunkers.chunk_by_chromosome(df))
    return flat(json_chunks.read_chunks_json(spark, path, df.schema), *_CHR_FIELDS)


def _array_file(spark, folder) -> DataFrame:
    """Row and gene chunks of array files, one of every task, the first kind with an object as raw data."""
    df = peaks(spark, folder)
    single = chunkers.chunk_by_row(df).select("id", "type", "content", "metadata", F.get("raw_data", F.lit(0)).alias("raw"))
    groups = chunkers.chunk_by_gene(df).select("id", "type", "content", "metadata", F.col("raw_data").alias("raw"))

    def line(chunks: DataFrame) -> DataFrame:
        given = F.struct("id", "type", "content", "metadata", F.col("raw").alias("raw_data"))
        text = F.to_json(given, {"ignoreNullFields": "false"})
        return chunks.select(F.regexp_replace(text, '"qtl_lod":null', '"qtl_lod":NaN').alias("value"))

    def arrays(batches):
        """Every task's lines as one array: a comma ahead of each but the first, brackets around all."""
        mark = "["
        for batch in batches:
            values = batch.column(0)
            if len(values):
                marks = pa.array([mark] + [","] * (len(values) - 1), values.type)
                joined = pc.binary_join_element_wise(marks, values, pa.scalar("", values.type))
                yield pa.RecordBatch.from_arrays([joined], names=["value"])
                mark = ","
        if mark == ",":
            yield pa.RecordBatch.from_arrays([pa.array(["]"])], names=["value"])

    path = new_path(spark, "array")
    lines = line(single).union(line(groups))
    bounded_batches(lines).mapInArrow(arrays, "value string").write.text(path)
    return json_chunks.read_chunks_json(spark, path, df.schema, array_file=True)


@query(
    "read_chunk_array_file",
    S.over_peaks(
        """SELECT concat('qtl_', row_id) AS id, qtl_lod, CAST(NULL AS BIGINT) AS qtl_count, CAST(row_id AS VARCHAR) AS raw_ids FROM peaks
 UNION ALL SELECT concat('gene_', gene_symbol), NULL, count(*), string_agg(CAST(row_id AS VARCHAR), ' ' ORDER BY row_id)
 FROM peaks WHERE gene_symbol IS NOT NULL GROUP BY gene_symbol"""
    ),
)
def _(spark, folder):
    return flat(_array_file(spark, folder), "qtl_lod", "qtl_count").drop("content")


@query(
    "row_chunk_stats_array_file",
    S.over_peaks("SELECT count(*) AS chunks, min(qtl_lod) AS min_lod, max(qtl_lod) AS max_lod FROM peaks"),
)
def _(spark, folder):
    return stats.row_chunk_stats(_array_file(spark, folder).where("type = 'single_qtl'"))


@query("read_chunk_contents", S.over_peaks("SELECT content FROM chunks", *S.CHROMOSOME_CHUNKS))
def _(spark, folder):
    df = peaks(spark, folder)
    path = _stored(spark, folder, chunkers.chunk_by_chromosome(df))
    return json_chunks.read_chunk_contents(spark, path, df.schema)
