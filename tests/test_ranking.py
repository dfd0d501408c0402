import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from locusframe.operators import ranking


def scored(spark, values, parts=3):
    rows = [(i, *value) for i, value in enumerate(values)]
    return spark.createDataFrame(rows, "row_id long, g string, qtl_lod double").repartition(parts)


def order():
    return [F.desc_nulls_last("qtl_lod"), F.asc("row_id")]


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_sorted_positions_equal_the_window(spark, parts):
    random.seed(parts)
    # Group "a" and the score 1.0 hold most rows.
    values = [
        (random.choice("aaaabc"), random.choice([1.0, 1.0, 1.0, 2.0, 3.5, None])) for _ in range(3000)
    ]
    df = scored(spark, values, parts)
    for by in ([], ["g"]):
        plain = ranking.position_in_order(df, order(), by)
        sorted_ = ranking.position_in_order(df, order(), by, rows_per_task=100)
        assert {tuple(r) for r in plain.collect()} == {tuple(r) for r in sorted_.collect()}


def test_a_hot_group_spreads_over_tasks(spark):
    """Nine tenths of the rows are in one group, which fits a task but would keep all others waiting."""
    random.seed(9)
    values = [("a" if i % 10 else random.choice("bcde"), random.choice([1.0, 2.0, None])) for i in range(4000)]
    df = scored(spark, values, 4)
    # As many tasks as there would be for more bytes.
    small = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.openCostInBytes": "64m"}
    before = {name: spark.conf.get(name) for name in small}
    try:
        for name, value in small.items():
            spark.conf.set(name, value)
        spread = ranking.position_in_order(df, order(), ["g"], hot_rows=1000)
        tasks = spread.where("g = 'a'").groupBy(F.spark_partition_id().alias("t")).count().collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert len(tasks) > 3 and max(t["count"] for t in tasks) < 3600 / 2
    plain = ranking.position_in_order(df, order(), ["g"])
    assert {tuple(r) for r in plain.collect()} == {tuple(r) for r in spread.collect()}
    blocks = [ranking.blocks_in_order(df, order(), 50, ["g"], hot_rows=n) for n in (1000, 10_000)]
    assert {tuple(r) for r in blocks[0].collect()} == {tuple(r) for r in blocks[1].collect()}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(st.sampled_from("ab"), st.one_of(st.none(), st.floats(0, 5))), min_size=1, max_size=40
    ),
    st.integers(1, 7),
)
def test_blocks_are_full_and_dense(spark, values, size):
    df = scored(spark, values)
    rows = ranking.blocks_in_order(df, order(), size, ["g"]).collect()
    assert len(rows) == len(values)
    for g in "ab":
        mine = sorted(r.position for r in rows if r.g == g)
        assert mine == list(range(len(mine)))
    assert all(r.block == r.position // size + 1 for r in rows)


def test_top_n_drops_or_keeps_missing(spark):
    df = scored(spark, [("a", None), ("a", 2.0), ("a", 2.0), ("a", 5.0)])
    kept = ranking.top_n_by_score(df, 10).orderBy("rank").collect()
    assert [r.row_id for r in kept] == [3, 1, 2, 0]
    dropped = ranking.top_n_by_score(df, 10, drop_missing=True).orderBy("rank").collect()
    assert [r.row_id for r in dropped] == [3, 1, 2]


def test_top_n_beyond_memory_limit(spark, monkeypatch):
    monkeypatch.setattr(ranking, "TOP_ROWS_IN_MEMORY", 2)
    df = scored(spark, [("a", float(i % 4)) for i in range(20)])
    rows = ranking.top_n_by_score(df, 6).orderBy("rank").collect()
    assert [(r.rank, r.row_id) for r in rows] == [(1, 3), (2, 7), (3, 11), (4, 15), (5, 19), (6, 2)]


def test_first_seen_ignores_missing_names(make_records):
    df = make_records([dict(gene_symbol=g) for g in (None, "b", "a", "b", "c")])
    rows = ranking.first_seen_index(df).orderBy("ordinal").collect()
    assert [(r.gene_symbol, r.first_row) for r in rows] == [("b", 1), ("a", 2), ("c", 4)]


def test_stride_sample(make_records):
    big = make_records([dict(gene_symbol="g") for _ in range(57)])
    picked = [r.row_id for r in ranking.stride_sample(big).orderBy("row_id").collect()]
    assert picked == list(range(0, 50, 5))
    literal = [r.row_id for r in ranking.stride_sample(big, literal=True).collect()]
    assert sorted(literal) == [0, 5]
    small = make_records([dict(gene_symbol="g") for _ in range(4)])
    assert ranking.stride_sample(small).count() == 4


def test_head_per_group(spark):
    df = scored(spark, [("a", float(i)) for i in range(9)] + [("b", 1.0)])
    rows = ranking.head_per_group(df, 3, ["g"], [F.col("row_id")]).collect()
    assert sorted((r.g, r.row_id) for r in rows) == [("a", 0), ("a", 1), ("a", 2), ("b", 9)]


def test_stride_sample_of_ids_with_gaps(spark, make_records):
    records = make_records([dict(row_id=i * 7 + 3, gene_symbol="a") for i in range(40)])
    rows = [r.row_id for r in ranking.stride_sample(records, 10).orderBy("row_id").collect()]
    assert rows == [i * 7 + 3 for i in range(0, 40, 4)]
