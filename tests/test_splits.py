"""Quoted CSV and JSON array files that are cut anywhere."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusframe.sources.chunks import read_chunks_json
from locusframe.sources.records import read_records_csv
from locusframe.sources.splits import ArrayElements, QuotedLines, read_split_records


@pytest.fixture
def splits_of(spark):
    """Lets files be cut every few bytes."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = [spark.conf.get(name) for name in names]

    def use(size):
        spark.conf.set(names[0], size)
        spark.conf.set(names[1], 0)

    yield use
    for name, value in zip(names, before):
        spark.conf.set(name, value)


CELLS = ["a", "", "two\nlines", 'q "x" q', "c,d", "\n", '"', "\r\nwin", "é\n\n中", " ", "x" * 70, '""\n"']


def csv_text(rng, rows, end="\n"):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end, quoting=csv.QUOTE_ALL)
    writer.writerow(["gene_symbol", "note", "qtl_lod"])
    cells = [[rng.choice(CELLS) + rng.choice(CELLS), rng.choice(CELLS), str(i)] for i in range(rows)]
    writer.writerows(cells)
    return out.getvalue(), cells


@pytest.mark.parametrize("size", [7, 40, 1000, 1 << 20])
def test_quoted_records_of_any_cut(spark, tmp_path, splits_of, size):
    rng = random.Random(size)
    expected = []
    for part, end in enumerate(["\n", "\r\n", "\n"]):
        text, cells = csv_text(rng, 0 if part == 1 else 40, end)
        (tmp_path / f"part-{part}.csv").write_bytes(text.encode())
        expected += cells
    (tmp_path / "part-3.csv").write_text("")
    splits_of(size)
    rows = read_records_csv(spark, str(tmp_path), multi_line=True).orderBy("row_id").collect()
    assert [r.row_id for r in rows] == list(range(len(expected)))
    na = lambda x: None if x in ("",) else x
    assert [(r.gene_symbol, r.note, r.qtl_lod) for r in rows] == [(na(a), na(b), float(c)) for a, b, c in expected]


def test_one_quoted_file_is_read_by_several_tasks(spark, tmp_path, splits_of):
    rows = 20_000
    (tmp_path / "r.csv").write_text("gene_symbol,qtl_lod\n" + "".join(f'"line one {i}\nline ""two""",{i}\n' for i in range(rows)))
    splits_of(50_000)
    records = read_split_records(spark, str(tmp_path), QuotedLines)
    tasks = records.select(F.spark_partition_id().alias("task"), "place").groupBy("task").count().collect()
    assert len(tasks) > 8 and max(t["count"] for t in tasks) < rows / 5
    found = read_records_csv(spark, str(tmp_path), multi_line=True)
    wrong = found.where((F.col("row_id") != F.col("qtl_lod")) | (F.col("gene_symbol") != F.concat(
        F.lit("line one "), F.col("row_id").cast("string"), F.lit('\nline "two"'))))
    assert found.count() == rows and wrong.count() == 0


def test_blank_lines_and_open_quotes(spark, tmp_path, splits_of):
    (tmp_path / "r.csv").write_text('gene_symbol,qtl_lod\n\n  \na,1\n\n"b\n\nc",2\n"never closed,3\nrest')
    for size in (5, 1 << 20):
        splits_of(size)
        texts = [r.text for r in read_split_records(spark, str(tmp_path), QuotedLines).orderBy("place").collect()]
        assert texts == ["gene_symbol,qtl_lod", "a,1", '"b\n\nc",2', '"never closed,3\nrest']
        rows = read_records_csv(spark, str(tmp_path), multi_line=True).orderBy("row_id").collect()
        assert [(r.row_id, r.gene_symbol) for r in rows][:2] == [(0, "a"), (1, "b\n\nc")]


def test_headers_of_other_files_are_compared(spark, tmp_path):
    (tmp_path / "a.csv").write_text("gene_symbol,qtl_lod\na,1\n")
    (tmp_path / "b.csv").write_text("qtl_lod,gene_symbol\n2,b\n")
    with pytest.raises(Exception, match="CSV header does not conform"):
        read_records_csv(spark, str(tmp_path), multi_line=True).collect()


def test_large_carries_are_joined_by_a_shuffle(spark, tmp_path, splits_of, monkeypatch):
    from locusframe.sources import splits

    monkeypatch.setattr(splits, "BROADCAST_ROWS", 0)
    text, cells = csv_text(random.Random(3), 60)
    (tmp_path / "r.csv").write_bytes(text.encode())
    splits_of(100)
    rows = read_records_csv(spark, str(tmp_path), multi_line=True).orderBy("row_id").collect()
    assert [r.qtl_lod for r in rows] == [float(c[2]) for c in cells]


# --- JSON -----------------------------------------------------------------------------


def value(rng, depth=0):
    kind = rng.randrange(8 if depth < 4 else 4)
    if kind == 0:
        return rng.randrange(1000)
    if kind in (1, 2):
        return rng.choice(["", "}", "{", "]}", "[", '"', "\\", 'a"}', "é}\n", "\\\\", "x" * 50, "}}}}"]) + rng.choice(["", "}", '\\"'])
    if kind == 3:
        return rng.choice([None, True, 1.5])
    if kind < 6:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["k", "}", '"', "long key"]) + str(i): value(rng, depth + 1) for i in range(rng.randrange(4))}


@pytest.mark.parametrize("size", [5, 31, 300, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_array_elements_of_any_cut(spark, tmp_path, splits_of, size, indent):
    rng = random.Random(size)
    expected = []
    for part in range(3):
        items = [{"id": f"{part}/{i}", "v": value(rng), "w": value(rng)} for i in range(min(25, 3 + size) if part != 1 else 0)]
        text = json.dumps(items, indent=indent, ensure_ascii=part == 0)
        (tmp_path / f"part-{part}.json").write_text(text + rng.choice(["", "\n"]))
        expected += items
    splits_of(size)
    found = read_split_records(spark, str(tmp_path), ArrayElements).collect()
    assert sorted((json.loads(r.text) for r in found), key=lambda x: x["id"]) == sorted(expected, key=lambda x: x["id"])


def test_one_array_file_is_read_by_several_tasks(spark, tmp_path, splits_of):
    record = T.StructType([T.StructField("gene_symbol", T.StringType()), T.StructField("qtl_lod", T.DoubleType())])
    items = [
        {"id": f"c{i}", "type": "gene", "content": 'text "}" ' * 5, "metadata": {"qtl_count": i},
         "raw_data": [{"gene_symbol": "{", "qtl_lod": float(i)}] if i % 2 else {"gene_symbol": "}", "qtl_lod": float("nan")}}
        for i in range(5000)
    ]
    (tmp_path / "chunks.json").write_text(json.dumps(items))
    splits_of(60_000)
    records = read_split_records(spark, str(tmp_path), ArrayElements)
    tasks = records.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) > 8 and max(t["count"] for t in tasks) < 1500
    rows = read_chunks_json(spark, str(tmp_path), record, array_file=True).collect()
    by_id = {r.id: r for r in rows}
    assert len(rows) == len(by_id) == 5000
    assert by_id["c7"].raw_data[0].qtl_lod == 7.0 and by_id["c8"].raw_data[0].qtl_lod is None
    assert by_id["c9"].metadata.qtl_count == 9 and by_id["c9"].content == 'text "}" ' * 5


def test_elements_that_are_no_objects_are_refused(spark, tmp_path):
    for text in ('[1, {"id": "a"}]', '[{"id": "a"}, 5]', '{"id": "a"} {"id": "b"} x', '["a"]'):
        (tmp_path / "a.json").write_text(text)
        with pytest.raises(Exception, match="no object"):
            read_split_records(spark, str(tmp_path), ArrayElements).collect()
    for text in ("[]", "", " [ ]\n", "[\n]"):
        (tmp_path / "a.json").write_text(text)
        assert read_split_records(spark, str(tmp_path), ArrayElements).count() == 0
