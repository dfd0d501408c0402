import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from locusframe.functions.text import format_record
from locusframe.schema import clean_records
from locusframe.sources.records import read_records_csv, split_records_csv


def test_format_record_with_every_part(make_records):
    df = make_records(
        [
            dict(gene_symbol="Abc", gene_type="lnc", qtl_chr="X", qtl_pos=12.0, qtl_ci_lo=11.5,
                 qtl_ci_hi=12.5, qtl_lod=7.25, qtl_pval=1e-5, cis=True),
        ]
    ).withColumn("qtl_qval", F.lit(0.0001))
    assert df.select(format_record(df.columns)).first()[0] == (
        "Gene: Abc | LOD Score: 7.25 | P-value: 1e-05 | Location: Chromosome X, Position 12.0 Mb"
        " | Confidence Interval: 11.500 - 12.500 Mb | Type: cis-acting | Gene Type: lnc"
        " | Q-value (FDR): 0.0001"
    )


def test_format_record_leaves_out_missing_optional_parts(make_records):
    df = make_records([dict(gene_type="", qtl_ci_lo=1.0)])
    assert df.select(format_record(df.columns)).first()[0] == (
        "Gene: nan | LOD Score: nan | P-value: nan | Location: Chromosome nan, Position nan Mb"
    )


def test_format_record_names_missing_columns_unknown(make_records):
    df = make_records([dict(gene_symbol="A")]).select("row_id", "gene_symbol")
    assert df.select(format_record(df.columns)).first()[0] == (
        "Gene: A | LOD Score: Unknown | P-value: Unknown"
        " | Location: Chromosome Unknown, Position Unknown Mb"
    )
    rest = df.select("row_id")
    assert rest.select(format_record(rest.columns)).first()[0].startswith("Gene: Unknown gene |")


def test_nan_becomes_null(spark):
    df = clean_records(spark.createDataFrame([(1, float("nan")), (2, 3.0)], "i int, x double"))
    assert [tuple(r) for r in df.orderBy("i").collect()] == [(1, None), (2, 3.0)]


CSV = """gene_symbol,qtl_chr,qtl_lod,qtl_pval,cis,note
A,1,5.5,1e-5,TRUE,x
NA,2,NaN,null,,N/A

"B, b",X,oops,0.5,false,y
C,3
D,4,1.5,0.25,TRUE,z,extra
"""


def test_read_records_csv(spark, tmp_path):
    (tmp_path / "r.csv").write_text(CSV)
    rows = read_records_csv(spark, str(tmp_path)).orderBy("row_id").collect()
    assert [r.row_id for r in rows] == [0, 1, 2, 3, 4]
    assert [r.gene_symbol for r in rows] == ["A", None, "B, b", "C", "D"]
    assert [r.qtl_lod for r in rows] == [5.5, None, None, None, 1.5]
    assert [r.cis for r in rows] == [True, None, False, None, True]
    assert [r.note for r in rows][:3] == ["x", None, "y"]


def test_strict_reading_reports_the_bad_cell(spark, tmp_path):
    (tmp_path / "r.csv").write_text("\n".join(CSV.split("\n")[:5]) + "\n")
    with pytest.raises(PySparkException, match="qtl_lod: oops"):
        read_records_csv(spark, str(tmp_path), strict=True).collect()


def test_rejected_rows_are_kept_apart(spark, tmp_path):
    (tmp_path / "r.csv").write_text(CSV)
    good, rejected = split_records_csv(spark, str(tmp_path))
    assert sorted(r.row_id for r in good.collect()) == [0, 1]
    assert [r.parse_error for r in rejected.orderBy("row_id").collect()] == [
        "qtl_lod: oops", "row: C,3", "row: D,4,1.5,0.25,TRUE,z,extra",
    ]


def test_row_ids_follow_file_order_over_splits(spark, tmp_path):
    for part in range(3):
        lines = [f"{part},{i}" for i in range(4000)]
        (tmp_path / f"part-0000{part}.csv").write_text("gene_symbol,qtl_lod\n" + "\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 5000)
    try:
        rows = read_records_csv(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 12000
    assert all(r.row_id == int(r.gene_symbol) * 4000 + r.qtl_lod for r in rows)


HEADER = "gene_symbol,gene_id,qtl_chr,qtl_lod\n"


def test_quotes_commas_and_line_breaks_in_cells(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(HEADER + '"a ""b"", c",i0,1,2.5\n"two\nlines",i1,X,3\n')
    rows = read_records_csv(spark, f"file://{path}", multi_line=True).orderBy("row_id").collect()
    assert [(r.row_id, r.gene_symbol, r.gene_id, r.qtl_lod) for r in rows] == [
        (0, 'a "b", c', "i0", 2.5), (1, "two\nlines", "i1", 3.0)
    ]
    path.write_text(HEADER + '"a ""b"", c",i0,1,2.5\n')
    assert read_records_csv(spark, f"file://{path}").first().gene_symbol == 'a "b", c'


def test_files_with_another_column_order_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + "a,i0,1,2.5\n")
    (tmp_path / "b.csv").write_text("gene_id,gene_symbol,qtl_chr,qtl_lod\ni1,b,2,3.5\n")
    with pytest.raises(Exception, match="CSV header does not conform|header"):
        read_records_csv(spark, f"file://{tmp_path}").collect()
