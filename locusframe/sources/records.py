"""Reading record tables from CSV files."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusframe.schema import DEFAULT_SPEC, RecordSpec, clean_records
from locusframe.sources.splits import QuotedLines, read_split_records
from locusframe.storage import number_scanned_rows

# The cell texts that count as missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

_CORRUPT = "_corrupt_record"
_ERROR = "parse_error"


def _schema(names: list[str]) -> T.StructType:
    """All cells as text, and the raw line of rows that have the wrong number of cells."""
    return T.StructType([T.StructField(name, T.StringType()) for name in [*names, _CORRUPT]])


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` string" for f in schema)


_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT, "escape": '"'}


def _scan(spark: SparkSession, path: str) -> DataFrame:
    """The rows of files whose records are lines; their place is in `_metadata`.

    A file whose header has other names or another order than the first one is an error.
    """
    names = spark.read.option("header", True).csv(path).columns
    reader = spark.read.schema(_schema(names)).options(header=True, enforceSchema=False, **_OPTIONS)
    return reader.csv(path).select("*", "_metadata")


def _scan_quoted(spark: SparkSession, path: str, row_id: str) -> DataFrame:
    """The rows of files whose cells may have line breaks, numbered.

    Every file is read by many tasks. The first record of each is its header.
    """
    names = spark.read.options(header=True, multiLine=True, escape='"').csv(path).columns
    schema = _schema(names)
    records = read_split_records(spark, path, QuotedLines)
    rows = records.select(
        F.from_csv("text", _ddl(schema), _OPTIONS).alias("row"),
        (F.col("place") == F.col("first")).alias("header"),
        # The headers of this file and of those before it are no rows.
        (F.col("place") - F.col("file")).alias("_row"),
        "path",
    )
    given = F.array(*(F.col("row")[name] for name in names))
    message = F.concat(F.lit("CSV header does not conform to the first one: "), F.col("path"))
    wrong = F.col("header") & ~given.eqNullSafe(F.array(*map(F.lit, names)))
    kept = F.when(wrong, F.raise_error(message).cast("boolean")).otherwise(~F.col("header"))
    extra = [] if row_id in names else [F.col("_row").alias(row_id)]
    return rows.where(kept).select("row.*", *extra)


def _typed(spark: SparkSession, path: str, spec: RecordSpec, multi_line: bool) -> DataFrame:
    """Typed columns, the row id, and what is wrong with the row in `parse_error`.

    Without a row id column the typed rows of line files are written once, to be numbered.
    """
    scan = _scan_quoted(spark, path, spec.row_id) if multi_line else _scan(spark, path)
    types = {**spec.types(), spec.row_id: T.LongType()}
    columns, errors = [], []
    errors.append(F.when(F.col(_CORRUPT).isNotNull(), F.concat(F.lit("row: "), F.col(_CORRUPT))))
    for field in scan.schema.fields:
        name = field.name
        if name in (_CORRUPT, "_metadata"):
            continue
        if field.dataType != T.StringType():
            # The number that a row was given here.
            columns.append(F.col(name))
            continue
        cell = F.when(~F.col(name).isin(NA_TOKENS), F.col(name))
        type = types.get(name, T.StringType())
        value = cell if type == T.StringType() else cell.try_cast(type)
        columns.append(value.alias(name))
        if type != T.StringType():
            errors.append(
                F.when(cell.isNotNull() & value.isNull(), F.concat(F.lit(f"{name}: "), cell))
            )
    place = [] if multi_line else ["_metadata"]
    rows = scan.select(*columns, F.coalesce(*errors).alias(_ERROR), *place)
    if spec.row_id not in scan.columns:
        rows = number_scanned_rows(rows, spec.row_id)
    return clean_records(rows.drop("_metadata"))


def read_records_csv(
    spark: SparkSession,
    path: str,
    spec: RecordSpec = DEFAULT_SPEC,
    strict: bool = False,
    multi_line: bool = False,
) -> DataFrame:
    """A typed record table with a dense row id in file order.

    Cells that do not parse become NULL; with `strict` the first one ends the job.
    Columns without a role stay text. A column named like the row id is taken as is. A quote
    inside a quoted cell is doubled. `multi_line` reads cells with line breaks; every file is
    then read twice, by many tasks, and a quote may stand in quoted cells only.
    """
    rows = _typed(spark, path, spec, multi_line)
    if strict:
        rows = rows.filter(_no_error(spec))
    return rows.drop(_ERROR)


def _no_error(spec: RecordSpec) -> Column:
    message = F.concat(
        F.lit("cannot read row "), F.col(spec.row_id).cast("string"), F.lit(", "), F.col(_ERROR)
    )
    failed = F.raise_error(message).cast("boolean")
    return F.when(F.col(_ERROR).isNotNull(), failed).otherwise(F.lit(True))


def split_records_csv(
    spark: SparkSession, path: str, spec: RecordSpec = DEFAULT_SPEC, multi_line: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Rows that parse, and rejected rows with `parse_error`."""
    rows = _typed(spark, path, spec, multi_line)
    good = rows.filter(F.col(_ERROR).isNull()).drop(_ERROR)
    return good, rows.filter(F.col(_ERROR).isNotNull())
