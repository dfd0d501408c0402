import bisect
import math
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from locusframe.catalog.inputs import SAMPLE_QUESTIONS
from locusframe.functions import parsing
from locusframe.plans import answers
from locusframe.plans.answers import answer_by_rules, answer_texts, count_below
from locusframe.plans.data_context import data_context

# Intent in the original order of the rules, and the selection of records.
GOLDEN = [
    ("help", "mixed"), ("group", "group"), ("help", "mixed"), ("help", "mixed"),
    ("entities", "top"), ("group", "group"), ("help", "mixed"), ("help", "mixed"),
    ("entities", "top"), ("group", "group"), ("entities", "mixed"), ("help", "pvalue"),
    ("top", "top"), ("group", "group"), ("pvalue", "pvalue"), ("group", "group"),
    ("top", "top"), ("pvalue", "pvalue"), ("group", "group"), ("help", "mixed"),
    ("help", "mixed"), ("top", "top"), ("pvalue", "pvalue"), ("top", "top"),
]


def ask(spark, *questions):
    return spark.createDataFrame(list(enumerate(questions)), "query_id long, question string")


def test_routing_of_the_sample_questions(spark):
    q = F.col("question")
    rows = (
        ask(spark, *SAMPLE_QUESTIONS)
        .select("query_id", parsing.route_rules(q, literal=True), parsing.route_context(q))
        .orderBy("query_id")
        .collect()
    )
    assert [tuple(r)[1:] for r in rows] == GOLDEN


def test_compare_comes_first_unless_literal(spark):
    df = ask(spark, "Compare QTL positions between different chromosomes")
    q = F.col("question")
    row = df.select(parsing.route_rules(q), parsing.route_rules(q, literal=True)).first()
    assert tuple(row) == ("compare", "group")


@pytest.mark.parametrize(
    "question, integer, score, pvalue, group",
    [
        ("QTLs on chromosome 11 with LOD > 20", 11, 20.0, None, "11"),
        ("lod>7.5 on chr3", 7, 7.5, None, "3"),
        ("p-values < 0.001", 0, None, None, None),
        ("P-VALUE < 0.001.", 0, None, 0.001, None),
        ("pval < 1e-5", 1, None, 1e-5, None),
        ("pvalue <.5e", 5, None, 0.5, None),
        ("p-value < -", None, None, None, None),
        ("Chromosomes", None, None, None, None),
        ("chromosome 99999999999999999999", None, None, None, "99999999999999999999"),
    ],
)
def test_parameters(spark, question, integer, score, pvalue, group):
    q = F.col("question")
    row = ask(spark, question).select(
        parsing.first_integer(q),
        parsing.score_threshold(q),
        parsing.pvalue_threshold(q),
        parsing.group_token(q),
    )
    assert tuple(row.first()) == (integer, score, pvalue, group)


def test_answers(spark, make_records):
    records = make_records(
        [
            dict(gene_symbol="a", gene_id="i0", qtl_chr="1", qtl_pos=1.5, qtl_lod=3.0, qtl_pval=0.0004),
            dict(gene_symbol="", gene_id="i1", qtl_chr="1", qtl_pos=2.0, qtl_lod=9.125, qtl_pval=0.0),
            dict(gene_symbol="b", gene_id="i2", qtl_chr="X", qtl_pos=2.0, qtl_lod=0.0, qtl_pval=0.04),
            dict(gene_id="i3", qtl_pval=0.5),
        ]
    )
    questions = ask(
        spark,
        "top 3 lod",
        "chr 1 lod > 3",
        "chr 0",
        "chr 7",
        "p-value < 0.05",
        "p-value",
        "what genes",
        "compare chromosomes",
        "overview",
        "top 0 lod",
    )
    lines = answer_by_rules(records, questions)
    texts = {r.query_id: r.answer for r in answer_texts(lines).collect()}
    # A score of 0, a p-value of 0 and a number 0 in a question count as missing.
    top = "1. Gene: i1 - LOD Score: 9.13 (Chr 1, Position: 2)\n2. Gene: a - LOD Score: 3.00 (Chr 1, Position: 1.5)\n"
    assert texts == {
        0: "Here are the top 3 QTLs with highest LOD scores:\n\n" + top,
        1: "Found 1 QTLs on chromosome 1 with LOD > 3:\n\n• i1: LOD=9.13, Position=2, P-value=0.00e+0\n",
        2: "",
        3: "Found 0 QTLs on chromosome 7:\n\n",
        4: "Found 2 genes with p-values < 0.05:\n\n• a: P-value=4.00e-4, LOD=3.00 (Chr 1)\n"
        "• b: P-value=4.00e-2, LOD=0.00 (Chr X)\n",
        5: "Found 1 genes with p-values < 0.001:\n\n• a: P-value=4.00e-4, LOD=3.00 (Chr 1)\n",
        6: "Your dataset contains 2 unique genes. Here are some examples:\n\n• a\n• b\n",
        7: "QTL distribution across chromosomes:\n\n• Chromosome 1: 2 QTLs\n• Chromosome X: 1 QTLs\n",
        8: "📊 Dataset Summary:\n\n• Total QTL records: 4\n• Average LOD score: 3.03\n"
        "• Maximum LOD score: 9.13\n• Chromosomes covered: 3\n• Unique genes: 2\n",
        9: "Here are the top 5 QTLs with highest LOD scores:\n\n" + top,
    }


def test_long_lists_continue_in_parts(spark, make_records):
    records = make_records([dict(gene_symbol="a", qtl_lod=float(i + 1)) for i in range(25)])
    lines = answer_by_rules(records, ask(spark, "top 22 lod"))
    parts = answer_texts(lines, lines_per_part=10).orderBy("part").collect()
    assert [p.answer.count(". Gene") for p in parts] == [9, 10, 3]


def test_remainder_line(spark, make_records):
    records = make_records([dict(gene_symbol="a", qtl_chr="1", qtl_lod=1.0, qtl_pval=0.5)] * 12)
    text = answer_texts(answer_by_rules(records, ask(spark, "chr 1"))).first().answer
    assert text.endswith("\n\n... and 2 more results.")
    assert text.count("•") == 10


def test_data_context_without_number_has_no_records(spark, make_records):
    records = make_records([dict(gene_symbol="a", qtl_chr="1", qtl_lod=1.5, qtl_pval=1e-7, cis=True)])
    rows = data_context(records, ask(spark, "chromosomes?", "chr 1", "anything")).orderBy("query_id")
    empty, one, mixed = [r.context for r in rows.collect()]
    assert empty.endswith("- Total chromosomes: 1\n\nSample of relevant records:\n")
    line = "Gene: a | LOD: 1.5 | P-val: 1e-7 | Chr: 1 | Pos: null | Cis: true | Type: N/A\n"
    assert one == empty + "1. " + line
    assert mixed == empty + "1. " + line + "2. " + line


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-20, 20), max_size=40, unique=True), st.integers(-25, 25))
def test_count_below_is_a_binary_search(spark, values, value):
    row = spark.range(1).select(
        count_below(F.lit(sorted(values)).cast("array<int>"), F.lit(value), max(len(values), 1)).alias("n"),
        count_below(F.lit(sorted(values)).cast("array<int>"), F.lit(None).cast("int"), 40).alias("none"),
    )
    assert tuple(row.first()) == (bisect.bisect_left(sorted(values), value), None)


def _places(spark, limits, values, by, page):
    """The interval of every value, as the answers find it."""
    table = spark.createDataFrame([("k", float(x)) for x in limits], "key string, limit double").select(*by, "limit")
    numbered = answers.position_in_order(table, [F.col("limit")], by, "n")
    rows = spark.createDataFrame([("k", float(v)) for v in values], "key string, value double").select(*by, "value")
    placed = answers._placed(rows, numbered, by, len(limits), len(limits) - 1, page)
    return placed, {r.value: r.n for r in placed.select("value", "n").collect()}


@pytest.mark.parametrize("by", [[], ["key"]])
@pytest.mark.parametrize("page", [1, 3, 64, 1 << 17])
def test_values_find_their_interval(spark, by, page):
    rng = random.Random(page)
    limits = rng.sample(range(200), 64)
    values = [rng.randrange(-5, 210) + rng.choice([0, 0.5]) for _ in range(100)]
    _, found = _places(spark, limits, values, by, page)
    expected = {v: bisect.bisect_left(sorted(limits), v) - 1 for v in values}
    assert found == {v: n for v, n in expected.items() if n >= 0}


def test_a_hundred_thousand_limits_cost_their_logarithm(spark):
    limits, values = range(0, 200_000, 2), [x * 7.3 for x in range(20_000)]
    start = time.time()
    placed, found = _places(spark, limits, values, [], 1 << 17)
    assert found == {v: math.ceil(v / 2) - 1 for v in values if v > 0 and v <= 200_000} | {
        v: 99_999 for v in values if v > 200_000
    }
    # A linear search makes two billion comparisons.
    assert time.time() - start < 60
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" in plan and not re.search(r"NestedLoop|Cartesian|Join", plan)


def test_thousands_of_thresholds(spark, make_records):
    """Each threshold has the totals and first rows that a filter over all records gives."""
    scores = [((i * 7919) % 3001) / 10 for i in range(3001)]
    pvalues = [1 / (1 + (i * 31) % 2999) for i in range(3001)]
    records = make_records(
        [dict(gene_symbol=f"g{i}", qtl_chr="1", qtl_pos=1.0, qtl_lod=s, qtl_pval=p) for i, (s, p) in enumerate(zip(scores, pvalues))]
    )
    asked = [f"chr 1 lod > {i / 10}" for i in range(2, 3100, 2)] + [f"p-value < 0.{i:05d}" for i in range(1, 1500)]
    asked += ["top 1 lod", "top 37 lod", "top 64 lod", "top 4000 lod"]
    lines = answer_by_rules(records, ask(spark, *asked)).collect()
    found = {}
    for line in lines:
        found.setdefault(line.query_id, {})[line.line_no] = line.line
    assert len(found) == len(asked)
    for i, question in enumerate(asked):
        if question.startswith("top"):
            assert len(found[i]) == 1 + min(int(question.split()[1]), sum(s > 0 for s in scores))
            continue
        limit = float(question.split()[-1])
        if question.startswith("chr"):
            matches = [n for n, s in enumerate(scores) if s > limit]
        else:
            matches = [n for n, p in enumerate(pvalues) if p < limit]
        assert found[i][0].startswith(f"Found {len(matches)} ")
        names = [found[i][k].split(":")[0].removeprefix("• ") for k in range(1, 1 + min(10, len(matches)))]
        assert names == [f"g{n}" for n in matches[:10]]
