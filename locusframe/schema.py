"""Column roles of a record table and the schemas of the tables built from it."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class RecordSpec:
    """Names of the record columns that play each role."""

    row_id: str = "row_id"
    entity: str = "gene_symbol"
    alt_entity: str = "gene_id"
    category: str = "gene_type"
    score: str = "qtl_lod"
    pvalue: str = "qtl_pval"
    qvalue: str = "qtl_qval"
    group: str = "qtl_chr"
    position: str = "qtl_pos"
    ci_lo: str = "qtl_ci_lo"
    ci_hi: str = "qtl_ci_hi"
    flag: str = "cis"

    def types(self) -> dict[str, T.DataType]:
        """Spark type of every role column except the row id."""
        text, number = T.StringType(), T.DoubleType()
        return {
            self.entity: text,
            self.alt_entity: text,
            self.category: text,
            self.group: text,
            self.position: number,
            self.ci_lo: number,
            self.ci_hi: number,
            self.score: number,
            self.pvalue: number,
            self.qvalue: number,
            self.flag: T.BooleanType(),
        }


DEFAULT_SPEC = RecordSpec()

_NUMBERS = T.ArrayType(T.DoubleType())
_NAMES = T.ArrayType(T.StringType())

METADATA = T.StructType(
    [
        T.StructField("gene_symbol", T.StringType()),
        T.StructField("gene_type", T.StringType()),
        T.StructField("qtl_lod", T.DoubleType()),
        T.StructField("qtl_chr", T.StringType()),
        T.StructField("qtl_pos", T.DoubleType()),
        T.StructField("qtl_pval", T.DoubleType()),
        T.StructField("cis", T.BooleanType()),
        T.StructField("qtl_count", T.LongType()),
        T.StructField("max_lod", T.DoubleType()),
        T.StructField("avg_lod", T.DoubleType()),
        T.StructField("chromosome", T.StringType()),
        T.StructField("chromosomes", _NAMES),
        T.StructField("position_range", _NUMBERS),
        T.StructField("position_start", T.DoubleType()),
        T.StructField("position_end", T.DoubleType()),
        T.StructField("region_span_mb", T.DoubleType()),
        T.StructField("genes", _NAMES),
        T.StructField("top_genes", _NAMES),
        T.StructField("gene_count", T.LongType()),
        T.StructField("significance_level", T.StringType()),
        T.StructField("lod_threshold", T.DoubleType()),
        T.StructField("lod_range", _NUMBERS),
        T.StructField("rank_start", T.LongType()),
        T.StructField("rank_end", T.LongType()),
        T.StructField("part", T.LongType()),
        T.StructField("parts", T.LongType()),
    ]
)

VECTOR = T.ArrayType(T.FloatType())

COLLECTION = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("chunk_id", T.StringType()),
        T.StructField("document", T.StringType()),
        T.StructField("embedding", VECTOR),
        T.StructField("embed_error", T.StringType()),
        T.StructField("embedding_method", T.StringType()),
        T.StructField("embedding_dimension", T.LongType()),
        T.StructField("metric", T.StringType()),
    ]
)

CHAT_LOG = T.StructType(
    [
        T.StructField("user", T.StringType()),
        T.StructField("assistant", T.StringType()),
        T.StructField("context", T.StringType()),
    ]
)


def chunk_schema(record: T.StructType) -> T.StructType:
    """Schema of a chunk table whose raw records have the given schema."""
    return T.StructType(
        [
            T.StructField("id", T.StringType()),
            T.StructField("type", T.StringType()),
            T.StructField("content", T.StringType()),
            T.StructField("metadata", METADATA),
            T.StructField("raw_data", T.ArrayType(record)),
        ]
    )


def metadata(**fields: Column) -> Column:
    """The metadata struct with the named fields filled and the rest NULL."""
    unknown = fields.keys() - set(METADATA.names)
    if unknown:
        raise ValueError(f"not metadata fields: {sorted(unknown)}")
    return F.struct(
        *(
            fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in METADATA.fields
        )
    )


def clean_records(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating-point column."""
    floating = (T.DoubleType, T.FloatType)
    return df.select(
        *(
            F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, floating)
            else F.col(f.name)
            for f in df.schema.fields
        )
    )
