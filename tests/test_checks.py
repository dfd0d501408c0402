"""Every registered query against its SQL, and the shape of its plan."""

import re

import pytest

from __spark_entry__ import entry, queries
from check import compare, connect
from locusframe.catalog import CHECKS, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, engine, name):
    assert compare(spark, engine, FOLDER, name) is None


def test_every_query_has_a_check():
    assert set(QUERIES) == set(CHECKS)


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["query_id", "question", "context", "messages", "temperature", "max_tokens"]
    assert df.count() == 150


PLANNED = ["chunk_by_chromosome", "chunk_by_gene_pathways", "sort_score", "answer_by_rules",
           "data_context", "chunk_top_records", "unique_entities"]


@pytest.mark.parametrize("name", PLANNED)
def test_plans_have_no_pair_joins_and_no_python(spark, name):
    plan = queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|EvalPython|MapInArrow", plan)


def test_only_the_asked_columns_are_read(spark):
    plan = queries()["in_group"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ReadSchema: struct<event_id:bigint,value:double>", plan)


@pytest.mark.parametrize("name", ["chunk_by_gene", "chunk_by_chromosome"])
def test_rows_are_shuffled_once_and_before_their_text(spark, name):
    plan = queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
    assert plan.index("concat_ws") < plan.index("Exchange ")
