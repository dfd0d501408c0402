import os
import re
import subprocess
import sys

import pytest

import __spark_entry__
import corpus_pipeline
from check import compare, connect
from locusframe.llm.queries import CHECKS, QUERIES

FOLDER = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.abspath(__spark_entry__.__file__))


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, connect(FOLDER), FOLDER, name) is None


def test_one_query_per_operator():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["op1_simhash_near_dedup", "op4_license_scan", "op5_secret_scan", "op8_decontamination"])
def test_every_query_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


BENCHMARK = "the quick river runs under seven old bridges while nobody counts the lamps on the other side"


def words(seed, n):
    return " ".join(f"w{seed}x{i}" for i in range(n))


@pytest.fixture
def folder(spark, tmp_path):
    passage = words("p", 70)
    near = words("n", 300).split()
    edited = list(near)
    # Case tells nothing to the fingerprint, so this is a near copy without long runs in common.
    for i in range(20, 300, 40):
        edited[i] = edited[i].upper()
    texts = {
        1: words(1, 60),
        2: f"{words(2, 40)}\n{passage}",
        3: f"{words(3, 40)}\n{passage}\n{words(33, 30)}",
        4: " ".join(near),
        5: " ".join(edited),
        6: f"{words(6, 40)} {BENCHMARK} {words(66, 20)}",
        7: "few words only",
        8: words(8, 10) + " " + "again and again and here we go once more " * 20,
        9: None,
        10: "",
        11: words(1, 60),
        12: words(12, 2000),
        None: words("none", 50),
    }
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in texts.items()]
    rows.append(rows[0])
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, BENCHMARK)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_keep_what_is_clean(spark, folder):
    from locusframe.llm.common import stored, table

    docs, after = table(spark, folder, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, folder), "stage")
        after.append(docs)
    for df in after[:-1]:
        assert df.columns == corpus_pipeline.COLUMNS
    kept = [{str(r.doc_id) for r in df.collect()} for df in after]
    assert kept[0] == {"1", "2", "3", "4", "5", "6", "11", "12", "None"}
    assert kept[1] == kept[0] - {"11"}  # a copy that has nothing left
    assert kept[2] == kept[1] - {"5"}
    assert kept[3] == kept[2] - {"6"} == kept[4]
    by_id = {str(r.doc_id): r for r in after[1].collect()}
    assert "wpx0" in by_id["2"].text and "wpx0" not in by_id["3"].text
    assert by_id["3"].n_chars == len(by_id["3"].text)
    assert after[2].where("doc_id = 1").count() == 1
    pieces = after[4].collect()
    assert {r.sequence_id for r in pieces} and all(r.length * 4 == len(r.ids) for r in pieces)
    assert corpus_pipeline.run(spark, folder).count() == len(pieces)


def test_empty_documents(spark, tmp_path, folder):
    empty = f"{tmp_path}/empty"
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").limit(0).write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_the_rest_imports_without_this_package():
    """As if the package and the pipeline were deleted."""
    code = (
        "import importlib.util as u; real = u.find_spec\n"
        "u.find_spec = lambda n, *a: None if n in ('locusframe.llm', 'corpus_pipeline') else real(n, *a)\n"
        "import __spark_entry__ as e, sys\n"
        "assert 'pipeline' not in e.queries() and 'chunk_by_row' in e.queries()\n"
        "assert not [m for m in sys.modules if m.startswith('locusframe.llm')]\n"
    )
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0
