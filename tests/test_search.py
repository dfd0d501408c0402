import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.operators import embed, pruned_search, search
from locusframe.sources import collections
from locusframe.sources import vectors as vector_files


def vectors(spark, matrix, name):
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{name} long, embedding array<float>").repartition(5)


def brute(corpus, queries, k, metric):
    corpus, queries = (m.astype("float32").astype("float64") for m in (corpus, queries))
    found = set()
    for q, query in enumerate(queries):
        if metric == "cosine":
            with np.errstate(invalid="ignore"):
                score = corpus @ query / (np.linalg.norm(corpus, axis=1) * np.linalg.norm(query))
            score = np.where(np.isnan(score), -np.inf, score)
        else:
            score = -((corpus - query) ** 2).sum(axis=1)
        order = sorted(range(len(corpus)), key=lambda i: (-round(score[i], 9), i))[:k]
        found |= {(q, r + 1, i) for r, i in enumerate(order)}
    return found


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("limits", [{}, {"query_bytes": 600, "tasks": 9}, {"tasks": 200}])
@pytest.mark.parametrize("k", [1, 4, 300])
def test_nearest_equals_brute_force(spark, metric, limits, k):
    random = np.random.default_rng(3)
    # A third of the corpus are copies of one vector, and one vector has no length.
    corpus = np.vstack([random.normal(size=(120, 6)), np.tile(random.normal(size=6), (60, 1)), np.zeros((1, 6))])
    queries = np.vstack([random.normal(size=(25, 6)), corpus[150:151]])
    found = search.nearest(
        vectors(spark, corpus, "chunk_id"), vectors(spark, queries, "query_id"), k, metric, **limits
    )
    assert {(r.query_id, r.rank, r.chunk_id) for r in found.collect()} == brute(corpus, queries, k, metric)


def test_small_score_blocks_give_the_same(spark, monkeypatch):
    random = np.random.default_rng(4)
    corpus, queries = random.normal(size=(200, 4)), random.normal(size=(9, 4))
    corpus[50:120] = corpus[3]
    best = search._Running(queries, 7, "cosine")
    monkeypatch.setattr(search, "SCORES_AT_ONCE", 60)
    best.add(np.arange(200), corpus)
    found = {(q, i) for q, i in zip(best.row, best.id)}
    expected = {(q, i) for q, _, i in brute(corpus, queries, 7, "cosine")}
    # The brute force rounds the vectors to single precision, which keeps this order.
    assert found == expected


def test_zero_vectors_rank_last_without_a_score(spark):
    corpus = vectors(spark, np.array([[0.0, 0.0], [1.0, 0.0], [-1.0, 0.0]]), "chunk_id")
    asked = vectors(spark, np.array([[1.0, 0.0]]), "query_id")
    rows = search.nearest(corpus, asked, 3).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in rows] == [(1, 1.0), (2, -1.0), (0, None)]


def test_vectors_without_value_take_no_part(spark):
    corpus = spark.createDataFrame(
        [("a", [1.0, 0.0]), ("b", None)], "chunk_id string, embedding array<float>"
    )
    asked = spark.createDataFrame(
        [("q", [1.0, 0.0]), ("r", None)], "query_id string, embedding array<float>"
    )
    rows = search.nearest(corpus, asked, 5).collect()
    assert [(r.query_id, r.chunk_id) for r in rows] == [("q", "a")]


def test_empty_sides(spark):
    schema = "chunk_id long, embedding array<float>"
    empty = spark.createDataFrame([], schema)
    asked = vectors(spark, np.ones((2, 2)), "query_id")
    assert search.nearest(empty, asked).count() == 0
    none = spark.createDataFrame([], "query_id long, embedding array<float>")
    assert search.nearest(vectors(spark, np.ones((2, 2)), "chunk_id"), none).count() == 0
    with pytest.raises(ValueError, match="no vectors"):
        search.cosine_search(empty, asked)
    with pytest.raises(ValueError, match="metric"):
        search.nearest(empty, asked, metric="dot")


def test_failing_texts_are_reported_and_embedded_once(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def fussy(**_):
        def run(texts):
            import os
            import uuid

            if any("bad" in text for text in texts) and len(texts) > 1:
                raise RuntimeError("batch refused")
            for text in texts:
                if "bad" in text:
                    raise RuntimeError("no " + text)
                open(os.path.join(str(log), text + uuid.uuid4().hex), "w").close()
            return [[float(len(text))] for text in texts]

        return run

    embed.register_embedder("fussy", fussy)
    df = spark.createDataFrame([(0, "one"), (1, "bad"), (2, "three"), (3, None)], "i int, text string")
    embedded = embed.embed_text(df.coalesce(1), "text", "fussy")
    rows = embedded.filter(F.col("embedding").isNotNull() | F.col("embed_error").isNotNull()).collect()
    assert {r.i: (r.embedding, r.embed_error) for r in rows} == {
        0: ([3.0], None),
        1: (None, "RuntimeError: no bad"),
        2: ([5.0], None),
        3: (None, "text is missing"),
    }
    assert len(list(log.iterdir())) == 2


def test_unknown_method_and_empty_chunks(spark):
    with pytest.raises(ValueError, match="must be one of"):
        embed.embedder_factory("other")
    empty = spark.createDataFrame([], "id string, content string")
    with pytest.raises(ValueError, match="no chunks"):
        embed.embed_chunks(empty)


def test_hashing_splits_on_ascii_blanks_only():
    run = embed.hashing_embedder()
    first, second, blank = run(["a  b\tc\n", "c b a", " \n"])
    assert (first == second).all()
    assert abs((first**2).sum() - 1) < 1e-6
    assert not blank.any()
    assert not (run(["a\u00a0b"])[0] == run(["a b"])[0]).all()


def test_collections(spark, tmp_path):
    docs = spark.createDataFrame([(7, "x y"), (5, "z")], "id long, content string")
    root = str(tmp_path)
    made = collections.create_collection(docs, [F.col("id")], root, "c", metric="l2")
    assert {(r.id, r.chunk_id, r.metric) for r in made.collect()} == {("0", "5", "l2"), ("1", "7", "l2")}
    collections.create_collection(docs.limit(1), [F.col("id")], root, "c")
    assert collections.open_collection(spark, root, "c").count() == 1
    assert collections.collection_peek(collections.open_collection(spark, root, "c")).count() == 1
    assert collections.open_collection(spark, root, "none").count() == 0
    assert collections.open_collection(spark, root, "none", create=False) is None


def test_vectors_of_two_methods_are_refused(spark, tmp_path):
    docs = spark.createDataFrame([(7, "x y")], "id long, content string")
    embedded = embed.embed_text(docs, "content")
    vector_files.write_vectors(embedded, f"{tmp_path}/v/p=1", "hashing")
    vector_files.write_vectors(embedded, f"{tmp_path}/v/p=2", "other")
    with pytest.raises(ValueError, match="different kinds"):
        vector_files.read_vectors(spark, f"{tmp_path}/v")


def test_questions_without_results(spark):
    questions = spark.createDataFrame([(1, "q")], "query_id long, question string")
    results = spark.createDataFrame(
        [], "query_id long, rank long, document string, distance double"
    )
    assert search.query_result_lines(questions, results).first().line == "No results found."
    from locusframe.plans.context import context_from_documents

    context = context_from_documents(questions, results).first().context
    assert context == "No relevant QTL data found for this query."


def _vectors(spark, rows, name):
    return spark.createDataFrame(rows, f"{name} long, embedding array<float>")


def test_vectors_of_other_lengths_are_refused(spark):
    asked = _vectors(spark, [(0, [1.0, 2.0, 3.0])], "query_id")
    for limits in ({}, {"query_bytes": 1, "tasks": 3}):
        for cells in ([1.0, 2.0], [1.0, 2.0, 3.0, 4.0]):
            with pytest.raises(Exception, match="cells"):
                search.nearest(_vectors(spark, [(1, cells)], "chunk_id"), asked, 1, **limits).collect()
    mixed = _vectors(spark, [(0, [1.0]), (1, [1.0, 2.0])], "query_id")
    with pytest.raises(ValueError, match="1 to 2 cells"):
        search.nearest(_vectors(spark, [(1, [1.0])], "chunk_id"), mixed, 1)


def test_vectors_with_holes_take_no_part(spark):
    corpus = _vectors(spark, [(1, [1.0, None]), (2, [float("nan"), 1.0]), (3, [1.0, 1.0])], "chunk_id")
    asked = _vectors(spark, [(0, [1.0, 1.0]), (1, [None, 1.0])], "query_id")
    assert [(r.query_id, r.chunk_id) for r in search.nearest(corpus, asked, 5).collect()] == [(0, 3)]


@pytest.mark.parametrize("tasks", [1, 3, 40, 200])
def test_grid_of_several_stripes_and_blocks(spark, tasks):
    """The same rows whatever the number of stripes, and k candidates per query and task."""
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(300, 4)).round(2), rng.normal(size=(40, 4)).round(2)
    corpus = _vectors(spark, [(i, v.tolist()) for i, v in enumerate(a)], "chunk_id").repartition(50)
    asked = _vectors(spark, [(i, v.tolist()) for i, v in enumerate(b)], "query_id")
    whole = sorted(search.nearest(corpus, asked, 3).collect())
    assert whole == sorted(search.nearest(corpus, asked, 3, tasks=tasks).collect())
    assert whole == sorted(search.nearest(corpus, asked, 3, query_bytes=500, tasks=tasks).collect())
    shape = search._Shape(corpus, asked)
    found = search._nearest_broadcast(corpus, asked, 3, "cosine", shape, 4, tasks)
    assert found.count() <= 3 * 40 * min(tasks, 50) and found.select("part").distinct().count() == min(tasks, 50)
    found = search._nearest_grid(corpus, asked, 3, "cosine", shape, tasks, 4, 4)
    per_query = found.groupBy("query_id").count().collect()
    assert len(per_query) == 40 and max(r["count"] for r in per_query) <= 3 * tasks


def test_stored_norms_are_used(spark):
    corpus = spark.createDataFrame([(1, [3.0, 4.0], 50.0), (2, [3.0, 4.0], 5.0)], "chunk_id long, embedding array<float>, norm double")
    asked = _vectors(spark, [(0, [3.0, 4.0])], "query_id")
    assert [(r.chunk_id, r.score) for r in search.nearest(corpus, asked, 2).orderBy("rank").collect()] == [(2, 1.0), (1, 0.1)]


def _clustered(spark, tmp_path, metric, matrix, pivots=16):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<float>").repartition(4)
    vector_files.write_clustered_vectors(df, f"{tmp_path}/{metric}", "given", metric, pivots)
    return df, vector_files.read_clustered_vectors(spark, f"{tmp_path}/{metric}")


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_pruned_search_equals_the_full_scan(spark, tmp_path, metric):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8)) * 5
    corpus = (centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 8)) * 0.1).round(3)
    corpus[100:160] = corpus[7]  # ties
    corpus[3] = 0
    queries = np.vstack([centres[:4] + 0.05, corpus[7:8], rng.normal(size=(3, 8)), np.zeros((1, 8))])
    df, clustered = _clustered(spark, tmp_path, metric, corpus)
    for rows in (queries[:4], queries):
        asked = vectors(spark, rows, "query_id")
        for k in (1, 5, 80):
            whole = sorted(search.nearest(df, asked, k, metric).collect())
            assert sorted(pruned_search.nearest_pruned(clustered, asked, k).collect()) == whole
    read = pruned_search.searched_vectors(clustered, vectors(spark, queries[:4], "query_id"), 5).first()
    assert read.vectors == 900 and read["read"] < 900 / 2
    # The rings reach the scan as filters.
    asked = vectors(spark, queries[:4], "query_id")
    plan = pruned_search.nearest_pruned(clustered, asked, 5)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: .*Or\(.*pivot_d", plan)
    none = clustered._replace(vectors=clustered.vectors.limit(0))
    assert pruned_search.nearest_pruned(none, asked, 3).count() == 0
    assert pruned_search.nearest_pruned(clustered, asked.limit(0), 3).count() == 0


def test_lookup_reads_few_row_groups(spark, tmp_path):
    rows = spark.range(40_000).select(
        F.format_string("chunk_%06d", "id").alias("id"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("content"),
        F.array(F.lit(1.0), F.col("id").cast("double")).cast("array<float>").alias("embedding"),
    )
    before = spark.conf.get("parquet.block.size", None)
    spark.conf.set("parquet.block.size", 200_000)
    try:
        vector_files.write_vectors(rows.orderBy(F.xxhash64("id")), f"{tmp_path}/v", "given")
    finally:
        spark.conf.unset("parquet.block.size") if before is None else spark.conf.set("parquet.block.size", before)
    corpus = vector_files.read_vectors(spark, f"{tmp_path}/v")
    found = spark.createDataFrame([(0, 1, "chunk_000007"), (0, 2, "chunk_031000")], "query_id long, rank long, chunk_id string")
    looked = search.lookup_chunks(found, corpus, "id")
    assert {r.chunk_id for r in looked.collect()} == {"chunk_000007", "chunk_031000"}

    def scanned(df):
        """Rows that come out of the scans of texts."""
        plan, total = df._jdf.queryExecution().executedPlan(), 0
        nodes = [plan.finalPhysicalPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan]
        while nodes:
            node = nodes.pop()
            if "content" in node.toString() and node.getClass().getSimpleName() == "FileSourceScanExec":
                total += node.metrics().apply("numOutputRows").value()
            kids = node.children()
            nodes += [kids.apply(i) for i in range(kids.size())]
            if hasattr(node, "plan") and node.getClass().getSimpleName().endswith("QueryStageExec"):
                nodes.append(node.plan())
        return total

    looked = search.lookup_chunks(found, corpus, "id")
    looked.collect()
    assert 0 < scanned(looked) < 8_000


def test_the_metric_belongs_to_the_collection(spark, tmp_path):
    texts = spark.createDataFrame([(0, "a"), (1, "a a a b"), (2, "c")], "id long, content string")
    made = collections.create_collection(texts, [F.col("id")], str(tmp_path), "x", metric="l2")
    asked = embed.embed_queries(spark.createDataFrame([(0, "a b")], "query_id long, question string"))
    plain = search.collection_query(made, asked).orderBy("rank").collect()
    assert plain == search.collection_query(made, asked, metric="l2").orderBy("rank").collect()
    with pytest.raises(ValueError, match="created with l2"):
        search.collection_query(made, asked, metric="cosine")
    found = search.collection_query(made, asked, with_embedding=True)
    listing = search.query_result_listing(found).orderBy("rank").first()
    assert len(listing.first_dimensions) == 10 and listing.preview.endswith("...")


def test_collection_ids_follow_the_order(spark, tmp_path):
    rows = [(i, f"text {i}") for i in (5, 3, 9, 3, 1)]
    texts = spark.createDataFrame(rows, "id long, content string").repartition(3)
    made = collections.create_collection(texts, [F.desc("id")], str(tmp_path), "x")
    got = [(int(r.id), r.chunk_id, r.document) for r in made.orderBy(F.col("id").cast("int")).collect()]
    assert [g[0] for g in got] == [0, 1, 2, 3, 4]
    assert [g[1] for g in got] == ["9", "5", "3", "3", "1"]
    assert all(g[2] == f"text {g[1]}" for g in got)


def test_collections_are_replaced_beside_their_readers(spark, tmp_path):
    texts = lambda *rows: spark.createDataFrame(list(enumerate(rows)), "id long, content string")
    root, order = str(tmp_path), [F.col("id")]
    first = collections.create_collection(texts("a", "b"), order, root, "x")
    second = collections.create_collection(texts("c"), order, root, "x")
    # The version before is readable as it was.
    assert sorted(r.document for r in first.collect()) == ["a", "b"]
    assert [r.document for r in second.collect()] == ["c"]
    own = second.select(F.col("id").cast("long").alias("id"), F.concat("document", F.lit(" again")).alias("content"))
    third = collections.create_collection(own.union(own.withColumn("id", F.col("id") + 1)), order, root, "x")
    assert [r.document for r in third.collect()] == ["c again"] * 2
    assert collections.open_collection(spark, root, "x").count() == 2
    assert len(collections.drop_old_versions(spark, root, "x")) == 2
    assert collections.open_collection(spark, root, "x").count() == 2
    assert collections.drop_old_versions(spark, root, "none") == []
    # A replacement that fails leaves the collection as it is.
    with pytest.raises(Exception):
        collections.create_collection(texts("d"), order, root, "x", method="unknown")
    assert [r.document for r in collections.open_collection(spark, root, "x").collect()] == ["c again"] * 2


def test_texts_are_embedded_once(spark, tmp_path):
    """Equal texts of one run, and texts of an earlier run, do not reach the embedder."""
    log = tmp_path / "log"
    log.mkdir()

    def counting(**_):
        import uuid

        inner = embed.hashing_embedder(8)

        def run(texts):
            if "bad" in texts:
                raise ValueError("bad")
            (log / uuid.uuid4().hex).write_text("\n".join(texts))
            return inner(texts)

        return run

    embed.register_embedder("counting", counting)
    calls = lambda: sorted(t for f in log.iterdir() for t in f.read_text().split("\n"))
    make = lambda *rows: spark.createDataFrame(list(enumerate(rows)), "id long, content string").repartition(3)
    store = f"{tmp_path}/store"
    one = embed.embed_once(make("a", "b", "a", "a", None, "bad"), "content", store, "counting").orderBy("id").collect()
    assert calls() == ["a", "b"]
    assert [r.embedding is not None for r in one] == [True, True, True, True, False, False]
    assert [r.embed_error for r in one[:5]] == [None] * 4 + ["text is missing"] and "bad" in one[5].embed_error
    two = embed.embed_once(make("b", "c", "a"), "content", store, "counting").orderBy("id").collect()
    assert calls() == ["a", "b", "c"]
    assert two[2].embedding == one[0].embedding and two[0].embedding == one[1].embedding
    direct = embed.embed_text(make("b", "c", "a"), "content", "hashing", dimension=8).orderBy("id").collect()
    assert [r.embedding for r in two] == [r.embedding for r in direct]


def test_texts_are_embedded_where_they_lie(spark, tmp_path):
    spark.range(400).select("id", F.lit("some text").alias("content")).repartition(20).write.parquet(f"{tmp_path}/t")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", 128 << 20)
    try:
        read = spark.read.parquet(f"{tmp_path}/t")
        assert "Exchange" not in embed.embed_text(read, "content")._jdf.queryExecution().executedPlan().toString()
        few = read.coalesce(2)
        assert embed.embed_text(few, "content").rdd.getNumPartitions() >= 8
        assert embed.embed_text(read, "content", tasks=3).rdd.getNumPartitions() == 3
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)


@pytest.mark.parametrize("scale", [1.0, 1e-9])
def test_single_precision_rules_out_no_neighbour(monkeypatch, scale):
    """Neighbours that differ by less than single precision tells, copies, zero vectors and wrong norms."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 24))
    vectors = np.concatenate([np.repeat(base, 60, axis=0) + scale * rng.normal(size=(360, 24)), base, base, np.zeros((3, 24))])
    vectors = vectors.astype("float32").astype("float64")[rng.permutation(len(base) * 62 + 3)]
    queries = np.concatenate([base + 1e-3, rng.normal(size=(200, 24)), np.zeros((1, 24))])
    norms = np.linalg.norm(vectors, axis=1) * rng.choice([1.0, 0.01], len(vectors))
    ids = rng.permutation(len(vectors))
    full = search._scores
    compared = []
    monkeypatch.setattr(search, "_scores", lambda q, v, *a: compared.append(len(q) * len(v)) or full(q, v, *a))
    for given in (None, norms):
        squares = (vectors * vectors).sum(axis=1) if given is None else given * given
        scores = full(queries, vectors, "cosine", (queries * queries).sum(axis=1), squares)
        expected = [ids[np.lexsort((ids, -row))][:4].tolist() for row in scores]
        best = search._Running(queries, 4, "cosine")
        compared.clear()
        for start in range(0, len(vectors), 40):
            part = slice(start, start + 40)
            best.add(ids[part], vectors[part], None if given is None else given[part])
        assert [row.tolist() for row in best.ids] == expected
        assert np.array_equal(best.scores, -np.sort(-scores, axis=1)[:, :4])
        if scale == 1.0 and given is None:
            # Before, every block was compared in double precision.
            assert sum(compared) < len(queries) * len(vectors) / 2


def test_embedders_get_bounded_portions(spark):
    """What an embedder is given, and so what a task holds, does not grow with the table."""
    given = spark.range(0, 3000, 1, 1).selectExpr("id", "IF(id % 7 = 0, NULL, repeat('ab cd ', 50 + 1000 * int(id % 5 = 0))) AS text")
    limit = embed.EMBED_BYTES

    def factory(**_):
        def run(texts):
            size = float(sum(map(len, texts)))
            assert (size <= limit or len(texts) == 1) and len(texts) <= 1024
            return [[size, float(len(text))] for text in texts]

        return run

    embed.register_embedder("measuring", factory)
    rows = embed.embed_text(given, "text", "measuring", tasks=1).collect()
    assert len(rows) == 3000
    for row in rows:
        if row["text"] is None:
            assert row["embedding"] is None and row["embed_error"] == "text is missing"
        else:
            assert row["embed_error"] is None and row["embedding"][1] == len(row["text"])
    # Several texts come at once.
    assert max(r["embedding"][0] / r["embedding"][1] for r in rows if r["embedding"]) > 50


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("count", [1000, 5000])
def test_scores_of_a_batch_are_held_in_small_blocks(metric, count):
    random = np.random.default_rng(8)
    corpus, queries = random.normal(size=(4000, 16)), random.normal(size=(count, 16))
    best = search._Running(queries, 3, metric)
    tracemalloc.start()
    best.add(np.arange(4000), corpus)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < 64 << 20
    # Scores of all pairs at once put the same candidates in the same order.
    squares = (queries * queries).sum(axis=1), (corpus * corpus).sum(axis=1)
    asked = np.array([0, 1, count // 2, count - 1])
    scores = search._scores(queries[asked], corpus, metric, squares[0][asked], squares[1])
    expected = np.argsort(-scores, axis=1, kind="stable")[:, :3]
    assert (best.id.reshape(-1, 3)[asked] == expected).all()


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("kind", ["float32", "float64"])
def test_short_queries_are_held_and_multiplied_in_their_cells_alone(monkeypatch, metric, kind):
    random = np.random.default_rng(11)
    queries = np.zeros((6000, 256), kind)
    words = np.minimum(random.zipf(1.3, (6000, 6)), 255)
    np.put_along_axis(queries, words, random.choice([-0.5, 0.5, 1.0], words.shape).astype(kind), axis=1)
    queries[7] = 0
    corpus = random.normal(size=(700, 256)).round(1)
    corpus[300:420] = corpus[5]  # ties
    corpus[9] = 0
    # Ids are texts, in no order, and some repeat.
    ids = np.array([f"c{i % 650}" for i in random.permutation(700)], dtype=object)
    full, cells = search._scores, []
    monkeypatch.setattr(search, "_scores", lambda q, v, *a: cells.append(q.shape[1]) or full(q, v, *a))
    tracemalloc.start()
    best = search._Running(queries, 3, metric)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    # Before, all cells of a query were held, in single precision beside the caller's, and all in every product.
    assert held < queries.nbytes * 0.75
    for start in range(0, 700, 90):
        best.add(ids[start : start + 90], corpus[start : start + 90])
    assert np.mean(cells) < 180
    wide = queries.astype("float64")
    scores = full(wide, corpus, metric, (wide * wide).sum(axis=1), (corpus * corpus).sum(axis=1))
    by_id = np.argsort(np.argsort(ids, kind="stable"))
    order = np.lexsort((np.broadcast_to(by_id, scores.shape), -scores))[:, :3]
    assert (best.ids == ids[order]).all()
    assert np.array_equal(best.scores, np.take_along_axis(scores, order, axis=1))


def test_a_cell_of_the_grid_holds_more_queries_than_are_sent(spark):
    """Every block of queries copies the corpus, so blocks are as few as before at twice the queries."""
    rng = np.random.default_rng(5)
    corpus = _vectors(spark, [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 4)))], "chunk_id")
    asked = _vectors(spark, [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 4)))], "query_id")
    # 40 queries of 48 bytes.
    found = search.nearest(corpus, asked, 2, query_bytes=960, tasks=1)
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "sequence(0, 0" in plan and "sequence(0, 1" not in plan
    assert sorted(found.collect()) == sorted(search.nearest(corpus, asked, 2).collect())


@pytest.mark.parametrize("sent", [0, 100_000])
def test_results_stream_past_the_texts(spark, monkeypatch, sent):
    """A join that streams texts keeps a copy of a text for each of its results, all at once."""
    monkeypatch.setattr(search, "BROADCAST_ROWS", sent)
    rows = [("a", "text a", 1), ("b", "text b", 2), ("b", "text b again", 3), ("c", "text c", 4), (None, "text of none", 5)]
    corpus = spark.createDataFrame(rows, "id string, content string, size int")
    found = [(i, rank, id) for i in range(300) for rank, id in ((1, "b"), (2, "a"))] + [(None, 1, "a"), (7, 3, None), (8, 3, "x")]
    results = spark.createDataFrame(found, "query_id long, rank long, chunk_id string")
    looked = search.lookup_chunks(results, corpus, "id")
    assert looked.columns == ["chunk_id", "content", "size", "query_id", "rank"]
    expected = [(id, text, size, q, rank) for q, rank, id in found for key, text, size in rows if id is not None and id == key]
    by_text = lambda row: tuple(map(str, row))
    assert sorted(map(tuple, looked.collect()), key=by_text) == sorted(expected, key=by_text)

    plan = looked._jdf.queryExecution().sparkPlan()
    nodes, joins = [plan], []
    while nodes:
        node = nodes.pop()
        kids = [node.children().apply(i) for i in range(node.children().size())]
        nodes += kids
        if node.getClass().getSimpleName().endswith("JoinExec"):
            joins.append((node.nodeName(), *("content" in kid.output().toString() for kid in kids)))
    # The streamed side of a merge join is the left one.
    assert joins[0] == ("SortMergeJoin", False, True)
    assert joins[1:] == ([("BroadcastHashJoin", True, False)] if sent else [])
    assert ("LeftSemi" in plan.toString()) == bool(sent)
