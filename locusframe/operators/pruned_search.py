"""Exact nearest neighbours in clustered vectors, without those that cannot be among them.

Every vector v is stored with its distance to a pivot p. A query q that has k vectors within t
needs no v with |d(q, p) - d(v, p)| > t, because then d(q, v) > t. The first pass searches the
clusters around the queries and gives each query its t. The second reads the vectors in the rings
that are left, which the scan chooses by row groups, as vectors lie in order of pivot and distance;
and in a ring it compares only the queries that reach it.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.operators import search
from locusframe.sources.vectors import ClusteredVectors, directions, distances
from locusframe.storage import stored

# What rounding may add to a distance; a ring is wider by so much.
SLACK = 1e-6
# Vectors of one ring that are compared at once.
RING_ROWS = 1024


class Reach:
    """How far each query looks: from `low` to `high` around each pivot."""

    def __init__(self, queries: np.ndarray, pivots: np.ndarray, limits: np.ndarray):
        away = distances(queries, pivots) if len(pivots) else np.zeros((len(queries), 0))
        self.low, self.high = away - limits[:, None], away + limits[:, None]
        # Queries with fewer than k neighbours so far look everywhere.
        self.open = bool(np.isinf(limits).any())

    def rings(self) -> Column:
        """The vectors that some query reaches, as a filter that row groups can be compared with."""
        pivot, distance = F.col("pivot"), F.col("pivot_distance")
        kept = F.lit(True) if self.open else F.lit(False)
        for i in range(self.low.shape[1] if not self.open else 0):
            low, high = float(self.low[:, i].min()), float(self.high[:, i].max())
            kept = kept | ((pivot == i) & (distance >= low) & (distance <= high))
        return kept

    def reached(self, pivot: int, low: float, high: float) -> np.ndarray:
        """The queries that look at a part of a ring."""
        if pivot < 0:
            return np.arange(len(self.low))
        return np.flatnonzero((self.low[:, pivot] <= high) & (self.high[:, pivot] >= low))


def _limits(scores: np.ndarray, metric: str) -> np.ndarray:
    """The distance of the k-th neighbour from its rounded score."""
    worst = scores - 2 * 10.0**-search.SCORE_DECIMALS
    return np.sqrt(np.maximum(2 - 2 * worst if metric == "cosine" else -worst, 0)) + SLACK


def _candidates(vectors: DataFrame, shape, query_ids, matrix, k: int, metric: str, width: int, choose, tasks: int):
    """The k best vectors per query and task, of the queries that `choose` names for a part of a ring."""
    shared = vectors.sparkSession.sparkContext.broadcast((query_ids, matrix, choose))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, matrix, choose = shared.value
        best = search._Running(matrix, k, metric)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, rows, norms = search._columns(batch, 0, width)
            pivots, away = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(pivots)) + 1).tolist(), len(pivots)]
            for begin, end in zip(edges, edges[1:]):
                for at in range(begin, end, RING_ROWS):
                    part = slice(at, min(at + RING_ROWS, end))
                    asked = choose(int(pivots[at]), float(away[part].min()), float(away[part].max()))
                    if len(asked):
                        best.add(ids[part], rows[part], norms[part], asked)
        yield from best.table(query_ids, shape.schema, TaskContext.get().partitionId()).to_batches()

    columns = vectors.select("chunk_id", "embedding", "norm", "pivot", "pivot_distance")
    return columns.coalesce(tasks).mapInArrow(run, shape.result)


class _Home:
    """The queries whose nearest pivot it is."""

    def __init__(self, homes: np.ndarray):
        self.homes = homes

    def __call__(self, pivot: int, low: float, high: float) -> np.ndarray:
        return np.flatnonzero(self.homes == pivot)


def nearest_pruned(
    clustered: ClusteredVectors,
    queries: DataFrame,
    k: int = 5,
    corpus_id: str = "chunk_id",
    query_id: str = "query_id",
    tasks: int | None = None,
) -> DataFrame:
    """The rows of `search.nearest` over the same vectors: `query_id, rank, chunk_id, score`.

    Queries beyond `search.QUERY_BYTES` are searched in the grid, without pruning.
    """
    vectors, pivots, metric = clustered
    plain = vectors.withColumnRenamed(corpus_id, "chunk_id")
    asked = stored(search._known(queries, query_id, "query_id").drop("norm"), "queries")
    size, width = search._measured(asked)
    if size > search.QUERY_BYTES or not len(pivots):
        return search.nearest(plain, asked, k, metric, tasks=tasks)
    rings, reach, parts = _reach(clustered, plain, asked, k, width, tasks)
    if reach is None:
        return search.nearest(plain, asked, k, metric, tasks=tasks)
    return search.rank_results(
        _candidates(_whole(plain).where(rings), *parts, reach.reached, _tasks(plain, tasks)), k, _tasks(plain, tasks)
    )


def _whole(vectors: DataFrame) -> DataFrame:
    holes = F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    vector = F.col("embedding").cast("array<float>").alias("embedding")
    return vectors.where(~holes).select("chunk_id", vector, "norm", "pivot", "pivot_distance")


def _tasks(vectors: DataFrame, tasks: int | None) -> int:
    return tasks or search.TASKS_PER_CORE * vectors.sparkSession.sparkContext.defaultParallelism


def _reach(clustered, plain, asked, k, width, tasks):
    """The first pass: how far each query has to look."""
    _, pivots, metric = clustered
    shape = search._Shape(plain, asked)
    block = asked.toArrow()
    query_ids = search._ids(block["query_id"])
    matrix = search._matrix(block["embedding"], width)
    parts = (shape, query_ids, matrix, k, metric, width)
    if not len(query_ids) or width != pivots.shape[1]:
        return None, None, parts
    looks = directions(matrix, metric)
    homes = distances(looks, pivots).argmin(axis=1)
    near = _whole(plain).where(F.col("pivot").isin([int(p) for p in np.unique(homes)]))
    first = search.rank_results(_candidates(near, *parts, _Home(homes), _tasks(plain, tasks)), k, _tasks(plain, tasks))
    # One number per query, and the queries are few.
    found = first.where(F.col("rank") == k).select("query_id", "score").toArrow()
    limits = np.full(len(query_ids), np.inf)
    place = {q: i for i, q in enumerate(query_ids.tolist())}
    for q, score in zip(found["query_id"].to_pylist(), found["score"].to_pylist()):
        if score is not None:
            limits[place[q]] = _limits(np.array(score), metric)
    # A query of length zero has no direction, and its scores are all NULL.
    reach = Reach(looks, pivots, limits)
    return reach.rings(), reach, parts


def searched_vectors(clustered: ClusteredVectors, queries: DataFrame, k: int = 5, query_id: str = "query_id") -> DataFrame:
    """How many vectors there are, and how many a search of these queries reads in its second pass."""
    vectors = clustered.vectors
    plain = vectors.withColumnRenamed("id", "chunk_id") if "chunk_id" not in vectors.columns else vectors
    asked = stored(search._known(queries, query_id, "query_id").drop("norm"), "queries")
    rings, _, _ = _reach(clustered, plain, asked, k, search._measured(asked)[1], None)
    return vectors.agg(F.count("*").alias("vectors"), F.count_if(rings).alias("read"))
