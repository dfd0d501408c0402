"""Exact nearest neighbours of a whole table of queries, and result projections.

Vectors meet in blocks: a task holds a block of query vectors, reads corpus vectors batch by batch
and keeps k candidates per query, so pairs are never rows and no task holds a stripe. Query
vectors travel to the corpus while they fit `QUERY_BYTES`; otherwise both sides are cut into
stripes that meet in the cells of a grid. Candidates of many tasks are merged in two levels.
"""

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from locusframe.functions.numbers import fixed
from locusframe.functions.text import preview
from locusframe.storage import BROADCAST_ROWS, stored

# Query vectors that are sent to every task, in double precision there, and how many times as many a cell of the
# grid holds, which keeps them in single precision.
QUERY_BYTES = 32 << 20
GRID_TIMES = 2

# Tasks of a search per core. More would only send more candidates, as a task reads any number
# of vectors.
TASKS_PER_CORE = 4

# Candidates of more tasks than this are merged in groups of tasks first.
MERGED_TASKS = 64

# Similarities computed at once inside a task and the most queries among them, and cells of the pairs that
# are computed again. About five arrays of the similarities are held at a time, and the cache should hold one.
SCORES_AT_ONCE = 250_000
QUERIES_AT_ONCE = 1024
CELLS_AT_ONCE = 2_000_000

# Scores are compared after rounding, so that copies of a vector tie whatever the block
# they are multiplied in.
SCORE_DECIMALS = 9

METRICS = ("cosine", "l2")


def _matrix(column: pa.ChunkedArray | pa.Array, width: int, kind: str = "float64") -> np.ndarray:
    """Vectors of an Arrow list column as a matrix; all must be `width` cells long."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, width), kind)
    lengths = pc.list_value_length(column)
    if pc.min(lengths).as_py() != width or pc.max(lengths).as_py() != width:
        raise ValueError(f"vectors of {pc.min(lengths)} to {pc.max(lengths)} cells meet vectors of {width}")
    values = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return values.reshape(len(column), -1)


def _ids(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(False)


def _scores(
    queries: np.ndarray, vectors: np.ndarray, metric: str, query_squares: np.ndarray, vector_squares: np.ndarray
) -> np.ndarray:
    """Score of every (query, vector), higher is better; -inf where undefined.

    A rounded score of zero has no sign, which would tell the order of its sums.
    """
    product = queries @ vectors.T
    if metric == "l2":
        distances = query_squares[:, None] + vector_squares[None, :] - 2 * product
        return np.round(-np.maximum(distances, 0), SCORE_DECIMALS) + 0.0
    norms = np.sqrt(query_squares)[:, None] * np.sqrt(vector_squares)[None, :]
    cosine = np.full(product.shape, -np.inf)
    np.divide(product, norms, out=cosine, where=norms > 0)
    return np.round(cosine, SCORE_DECIMALS) + 0.0


def _best_of_block(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k best scores per row; ties prefer the lower column."""
    if scores.shape[1] <= k:
        return np.nonzero(np.ones(scores.shape, dtype=bool))
    limit = np.partition(scores, -k, axis=1)[:, -k][:, None]
    better = scores > limit
    equal = scores == limit
    room = k - better.sum(axis=1, keepdims=True)
    return np.nonzero(better | (equal & (np.cumsum(equal, axis=1) <= room)))


def _pair_scores(
    queries: np.ndarray, vectors: np.ndarray, rows: np.ndarray, columns: np.ndarray, cells: np.ndarray,
    query_squares: np.ndarray, vector_squares: np.ndarray,
) -> np.ndarray:
    """`_scores` of some pairs, for the cosine; the queries have these cells of the vectors alone."""
    product = np.empty(len(rows))
    step = max(CELLS_AT_ONCE // max(len(cells), 1), 1)
    for start in range(0, len(rows), step):
        part = slice(start, start + step)
        met = vectors[columns[part, None], cells]
        np.einsum("ij,ij->i", queries[rows[part]], met, out=product[part])
    norms = np.sqrt(query_squares[rows]) * np.sqrt(vector_squares[columns])
    cosine = np.full(len(rows), -np.inf)
    np.divide(product, norms, out=cosine, where=norms > 0)
    return np.round(cosine, SCORE_DECIMALS) + 0.0


def _units(matrix: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Vectors of length one in single precision; those without a length stay zero."""
    norms = np.sqrt(squares)[:, None]
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0).astype("float32")


class _Tile:
    """Queries with like cells, in these cells alone: outside them all are zero, and add nothing to a product."""

    def __init__(self, queries: np.ndarray, rows: np.ndarray, cells: np.ndarray):
        self.rows, self.cells = rows, cells
        self.queries = queries[rows][:, cells]
        self.seen = 0


def _tiles(queries: np.ndarray) -> list[_Tile]:
    """Queries in tiles of at most `QUERIES_AT_ONCE`, those that share their rarest cells together.

    A short text fills few of the cells of a vector, so that most products of a tile are short. Queries without
    zeros keep all their cells.
    """
    used = ~(queries == 0)
    rare = np.argsort(used.sum(axis=0), kind="stable")
    order = np.lexsort(np.packbits(used[:, rare], axis=1).T[::-1]) if queries.size else np.arange(len(queries))
    parts = [np.sort(order[i : i + QUERIES_AT_ONCE]) for i in range(0, len(order), QUERIES_AT_ONCE)]
    return [_Tile(queries, rows, np.flatnonzero(used[rows].any(axis=0))) for rows in parts]


class _Running:
    """The k best candidates per query over the blocks a task has seen.

    For the cosine, a query that has k candidates is compared in single precision, whose error has a bound; only
    pairs that reach the k-th score within this bound are computed again in double precision. So the
    scores and the order are those of double precision throughout.
    """

    def __init__(self, queries: np.ndarray, k: int, metric: str):
        self.k, self.metric = k, metric
        self.tiles = _tiles(queries)
        self.squares = np.zeros(len(queries))
        for tile in self.tiles:
            self.squares[tile.rows] = np.square(tile.queries, dtype="float64").sum(axis=1)
        # Rounding of both vectors and of the sum of their products, twice what theory allows.
        self.error = (queries.shape[1] + 8) * 2.0**-23 + 10.0**-SCORE_DECIMALS
        # Candidates of a query in their order, in as many columns as some query has needed.
        self.ids = None
        self.scores = np.full((len(queries), 0), -np.inf)
        self.count = np.zeros(len(queries), dtype="int64")
        self.limit = np.full(len(queries), -np.inf)

    def add(
        self, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray | None = None, rows: np.ndarray | None = None
    ) -> None:
        """Vectors with their norms, if these are known, for all queries or for those in `rows`."""
        squares = (vectors * vectors).sum(axis=1) if norms is None else norms * norms
        order = np.argsort(ids, kind="stable")
        ids, vectors, squares = ids[order], vectors[order], squares[order]
        units, error = None, 0.0
        if self.metric == "cosine":
            units = np.ascontiguousarray(_units(vectors, squares).T)
            # A stored norm may be another one than that of the vector, and the error grows with it.
            lengths = np.sqrt((vectors * vectors).sum(axis=1))
            ratio = np.divide(lengths, np.sqrt(squares), out=np.ones(len(lengths)), where=squares > 0)
            error = self.error * max(1.0, float(ratio.max(initial=1.0)))
        wanted = np.ones(len(self.squares), dtype=bool)
        if rows is not None:
            wanted[:] = False
            wanted[rows] = True
        for tile in self.tiles:
            chosen = np.flatnonzero(wanted[tile.rows])
            if len(chosen) == 0:
                continue
            rows, queries = tile.rows[chosen], tile.queries[chosen].astype("float64")
            near = None if units is None else (_units(queries, self.squares[rows]), units[tile.cells])
            start = 0
            while start < len(ids):
                # The first k candidates come from few vectors, and a step takes three times as many as all before
                # it, so that it finds about as many better candidates as the step before.
                step = min(max(SCORES_AT_ONCE // len(rows), 1), max(3 * tile.seen, 8 * self.k))
                part = slice(start, start + step)
                meet = (queries, near[0], near[1][:, part], error) if near else (queries, None, None, error)
                self._add(ids[part], vectors[part], squares[part], rows, tile.cells, *meet)
                start += step
                tile.seen += step

    def _add(
        self, ids: np.ndarray, vectors: np.ndarray, squares: np.ndarray, asked: np.ndarray, cells: np.ndarray,
        queries: np.ndarray, units: np.ndarray | None, others: np.ndarray | None, error: float,
    ) -> None:
        """Some vectors for the queries `asked` of a tile, whose rows are `queries` and `units`."""
        left = np.arange(len(asked))
        if units is not None:
            bounded = np.isfinite(self.limit[asked])
            some = np.flatnonzero(bounded)
            many = self._add_near(ids, vectors, squares, asked, cells, queries, units, others, error, some)
            left = np.concatenate([left[~bounded], many])
        if len(left) == 0:
            return
        asked = asked[left]
        scores = _scores(queries[left], vectors[:, cells], self.metric, self.squares[asked], squares)
        full = self.count[asked] >= self.k
        open_rows = np.nonzero(~full | (scores >= self.limit[asked, None]).any(axis=1))[0]
        if len(open_rows):
            row, column = _best_of_block(scores[open_rows], self.k)
            self._merge(asked[open_rows[row]], ids[column], scores[open_rows[row], column])

    def _add_near(
        self, ids: np.ndarray, vectors: np.ndarray, squares: np.ndarray, asked: np.ndarray, cells: np.ndarray,
        queries: np.ndarray, units: np.ndarray, others: np.ndarray, error: float, some: np.ndarray,
    ) -> np.ndarray:
        """For the queries in `some`, which have k candidates: the vectors that single precision does not rule out.

        Queries that it rules too few out for are returned, to be compared as a block.
        """
        if len(some) == 0:
            return some
        units = units if len(some) == len(units) else units[some]
        lowest = (self.limit[asked[some]] - error).astype("float32")
        lowest = np.nextafter(lowest, np.float32(-np.inf))
        far = units @ others < lowest[:, None]
        if np.count_nonzero(far) == far.size:
            return some[:0]
        count = len(ids) - np.count_nonzero(far, axis=1)
        many = 16 * count > len(ids)
        met = np.flatnonzero((count > 0) & ~many)
        row, column = np.nonzero(~far[met])
        row = some[met[row]]
        found = _pair_scores(queries, vectors, row, column, cells, self.squares[asked], squares)
        kept = found >= self.limit[asked[row]]
        self._merge(asked[row[kept]], ids[column[kept]], found[kept])
        return some[many]

    def _merge(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Put new candidates among those of their queries."""
        if len(rows) == 0:
            return
        if self.ids is None:
            self.ids = np.zeros(self.scores.shape, dtype=ids.dtype)
        met = np.unique(rows)
        held = np.arange(self.scores.shape[1]) < self.count[met, None]
        rows = np.concatenate([met[np.nonzero(held)[0]], rows])
        ids = np.concatenate([self.ids[met][held], ids])
        scores = np.concatenate([self.scores[met][held], scores])
        # Texts are slow to sort, so ids are compared only for queries with equal scores.
        order = np.lexsort((-scores, rows))
        after, before = order[1:], order[:-1]
        tied = np.unique(rows[after[(rows[after] == rows[before]) & (scores[after] == scores[before])]])
        if len(tied):
            at = np.flatnonzero(np.isin(rows, tied))
            by_id = np.zeros(len(rows), dtype="int64")
            by_id[at[np.argsort(ids[at], kind="stable")]] = np.arange(len(at))
            order = np.lexsort((by_id, -scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
        kept = place < self.k
        if not kept.any():
            return
        rows, ids, scores, place = rows[kept], ids[kept], scores[kept], place[kept]
        more = int(place.max()) + 1 - self.scores.shape[1]
        if more > 0:
            self.scores = np.pad(self.scores, ((0, 0), (0, more)), constant_values=-np.inf)
            self.ids = np.concatenate([self.ids, np.zeros((len(self.ids), more), dtype=self.ids.dtype)], axis=1)
        self.ids = self.ids.astype(np.result_type(self.ids, ids), copy=False)
        self.scores[rows, place], self.ids[rows, place] = scores, ids
        self.count[met] = np.bincount(np.searchsorted(met, rows), minlength=len(met))
        full = met[self.count[met] >= self.k]
        self.limit[full] = self.scores[full, min(self.k, self.scores.shape[1]) - 1]

    def _held(self) -> np.ndarray:
        return np.arange(self.scores.shape[1]) < self.count[:, None]

    @property
    def row(self) -> np.ndarray:
        """The number of the query of every candidate, in order of queries and ranks."""
        return np.nonzero(self._held())[0]

    @property
    def id(self) -> np.ndarray:
        return np.zeros(0) if self.ids is None else self.ids[self._held()]

    @property
    def score(self) -> np.ndarray:
        return self.scores[self._held()]

    def table(self, query_ids: np.ndarray, schema: pa.Schema, part: int) -> pa.Table:
        score = pa.array(self.score, mask=np.isneginf(self.score))
        parts = np.full(len(score), part, "int32")
        columns = [pa.array(query_ids[self.row]), pa.array(self.id), score, pa.array(parts)]
        return pa.table([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def _id_field(df: DataFrame, name: str) -> tuple[str, pa.DataType]:
    kind = df.schema[name].dataType.simpleString()
    types = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    if kind not in types:
        raise TypeError(f"ids must be string, bigint or int, not {kind}")
    return kind, types[kind]


def _known(df: DataFrame, id_column: str, name: str) -> DataFrame:
    """Id, vector and stored norm, if there is one, of the rows with a whole vector."""
    vector = F.col("embedding").cast("array<float>").alias("embedding")
    holes = F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    norm = [F.col("norm").cast("double").alias("norm")] if "norm" in df.columns and id_column != "norm" else []
    known = df.filter(F.col("embedding").isNotNull() & ~holes)
    return known.select(F.col(id_column).alias(name), vector, *norm)


class _Shape:
    """Types of the ids and of the candidate rows."""

    def __init__(self, corpus: DataFrame, queries: DataFrame):
        self.query_kind, query_type = _id_field(queries, "query_id")
        self.corpus_kind, corpus_type = _id_field(corpus, "chunk_id")
        fields = [("query_id", query_type), ("chunk_id", corpus_type), ("score", pa.float64()), ("part", pa.int32())]
        self.schema = pa.schema(fields)
        self.result = f"query_id {self.query_kind}, chunk_id {self.corpus_kind}, score double, part int"


def _measured(df: DataFrame) -> tuple[int, int]:
    """Bytes of the vectors of a table and their cells; different lengths are an error."""
    cells = F.size("embedding")
    size, least, width = df.agg(F.coalesce(F.sum(cells * 4 + 32), F.lit(0)), F.min(cells), F.max(cells)).first()
    if least != width:
        raise ValueError(f"the queries have vectors of {least} to {width} cells")
    return size, width or 0


def nearest(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = 5,
    metric: str = "cosine",
    corpus_id: str = "chunk_id",
    query_id: str = "query_id",
    query_bytes: int = QUERY_BYTES,
    tasks: int | None = None,
) -> DataFrame:
    """The k best corpus vectors of every query: `query_id, rank, chunk_id, score`.

    Both sides carry an `embedding` column; rows without one, or with a NULL or NaN cell, take
    no part. A `norm` column of the corpus is taken as it is. Vectors of different lengths are an error. `score` is the
    cosine similarity, or minus the squared distance for "l2"; it is NULL, and last, for
    a vector of length zero. Equal scores rank by corpus id. `tasks` bounds the tasks that read vectors.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    corpus, queries = _known(corpus, corpus_id, "chunk_id"), _known(queries, query_id, "query_id").drop("norm")
    shape = _Shape(corpus, queries)
    tasks = tasks or TASKS_PER_CORE * corpus.sparkSession.sparkContext.defaultParallelism
    # Embedding a query may be costly, so it happens once, before the queries are measured.
    queries = stored(queries, "queries")
    size, width = _measured(queries)
    if size <= query_bytes:
        candidates = _nearest_broadcast(corpus, queries, k, metric, shape, width, tasks)
    else:
        # Every block of queries meets every stripe: each further block copies the corpus once
        # more, each further stripe the queries. So blocks are as few as tasks can hold, and stripes
        # as many as keep the tasks busy.
        blocks = -(-size // (GRID_TIMES * query_bytes))
        stripes = max(1, -(-tasks // blocks))
        candidates = _nearest_grid(corpus, queries, k, metric, shape, int(stripes), int(blocks), width)
        tasks = stripes
    return rank_results(candidates, k, tasks)


def _best(candidates: DataFrame, k: int, by: list[str]) -> DataFrame:
    best_first = Window.partitionBy(*by).orderBy(F.desc_nulls_last("score"), "chunk_id")
    ranked = candidates.withColumn("rank", F.row_number().over(best_first).cast("bigint"))
    return ranked.filter(F.col("rank") <= k)


def rank_results(candidates: DataFrame, k: int, tasks: int = 1) -> DataFrame:
    """Number the candidates of each query by score and keep the best k.

    With many tasks, whose number is in `part`, the square root of them is merged at a time.
    """
    if tasks > MERGED_TASKS:
        groups = math.isqrt(tasks - 1) + 1
        candidates = _best(candidates.withColumn("part", F.col("part") % groups), k, ["query_id", "part"]).drop("rank")
    return _best(candidates, k, ["query_id"]).select("query_id", "rank", "chunk_id", "score")


def _columns(batch: pa.RecordBatch, at: int, width: int) -> tuple:
    """Ids, vectors and norms from column `at` on."""
    norms = batch.column(at + 2).to_numpy(zero_copy_only=False) if batch.num_columns > at + 2 else None
    return _ids(batch.column(at)), _matrix(batch.column(at + 1), width), norms


def _nearest_broadcast(corpus, queries, k, metric, shape, width, tasks) -> DataFrame:
    """Map-only over the corpus; the query block has been measured to be small."""
    block = queries.toArrow()
    shared = corpus.sparkSession.sparkContext.broadcast(
        (_ids(block["query_id"]), _matrix(block["embedding"], width))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, matrix = shared.value
        if len(query_ids) == 0:
            return
        best = _Running(matrix, k, metric)
        for batch in batches:
            if batch.num_rows:
                best.add(*_columns(batch, 0, width))
        yield from best.table(query_ids, shape.schema, TaskContext.get().partitionId()).to_batches()

    # A task reads several splits one after the other.
    return corpus.coalesce(tasks).mapInArrow(run, shape.result)


def _nearest_grid(corpus, queries, k, metric, shape, stripes, blocks, width) -> DataFrame:
    """Every stripe of the corpus meets every block of the queries in one grid cell.

    The queries of a cell come first and are held; corpus vectors stream past them.
    """

    def cut(df: DataFrame, id: str, parts: int) -> Column:
        return F.pmod(F.xxhash64(id), F.lit(parts)).cast("int")

    norm = ["norm"] if "norm" in corpus.columns else []
    stripe, block = cut(corpus, "chunk_id", stripes), cut(queries, "query_id", blocks)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = corpus.withColumn("stripe", stripe).withColumn("block", every(blocks)).withColumn("side", F.lit(1))
    right = queries.withColumn("block", block).withColumn("stripe", every(stripes)).withColumn("side", F.lit(0))
    both = right.unionByName(left, allowMissingColumns=True).withColumn("cell", F.col("block") * stripes + F.col("stripe"))
    rows = both.repartition(stripes * blocks, "cell").sortWithinPartitions("cell", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, parts, best = None, [], [], None

        def results():
            if best is not None:
                # Candidates of one query come from every stripe.
                yield from best.table(np.concatenate(ids), shape.schema, now % stripes).to_batches()

        for batch in batches:
            cells = batch.column(0).to_numpy()
            sides = batch.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(cells) != 0) | (np.diff(sides) != 0)) + 1
            for begin, end in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                if begin == end:
                    continue
                if cells[begin] != now:
                    yield from results()
                    now, ids, parts, best = cells[begin], [], [], None
                piece = batch.slice(begin, end - begin)
                if sides[begin] == 0:
                    ids.append(_ids(piece.column(2)))
                    parts.append(_matrix(piece.column(4), width, "float32"))
                elif ids:
                    if best is None:
                        # The pieces go before the tiles are made, which are a copy of their own.
                        block, parts = np.concatenate(parts), []
                        best = _Running(block, k, metric)
                        del block
                    best.add(*_columns(piece, 3, width))
        yield from results()

    return rows.select("cell", "side", "query_id", "chunk_id", "embedding", *norm).mapInArrow(run, shape.result)


# Results whose ids are turned into ranges for the scan, and the ranges they make at most.
LOOKUP_IDS, LOOKUP_RANGES = 10_000, 64


def _id_ranges(results: DataFrame, ids: Column) -> Column | None:
    """A filter that holds for all ids of few results, which a scan can compare with row groups."""
    wanted = results.select("chunk_id").distinct().limit(LOOKUP_IDS + 1).toArrow()["chunk_id"].to_pylist()
    if len(wanted) > LOOKUP_IDS or None in wanted:
        return None
    # Java and Python order texts alike by their UTF-8 bytes.
    wanted.sort(key=lambda x: x.encode() if isinstance(x, str) else x)
    step = max(1, -(-len(wanted) // LOOKUP_RANGES))
    parts = [wanted[i : i + step] for i in range(0, len(wanted), step)]
    ranges = [(ids >= part[0]) & (ids <= part[-1]) for part in parts]
    return functools.reduce(lambda a, b: a | b, ranges) if ranges else F.lit(False)


def lookup_chunks(results: DataFrame, corpus: DataFrame, corpus_id: str = "chunk_id") -> DataFrame:
    """Attach the corpus columns to search results; vectors stay behind.

    The results of a search over the whole corpus are kept, so that they can be counted:
    the ids of few of them go to the corpus, so that only texts that were found are shuffled, and, as ranges,
    to its scan, which leaves out the row groups of a corpus in order of its ids.

    Results stream past the texts, by a merge join whatever their size: a join that streams texts instead
    holds all results of a text, with a copy of it in each of them, before it passes on the first.
    """
    texts = corpus.drop("embedding", "embed_error").withColumnRenamed(corpus_id, "chunk_id")
    results = stored(results, "results")
    ranges = _id_ranges(results, F.col("chunk_id"))
    if ranges is not None:
        texts = texts.where(ranges)
    if results.count() <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(results.select("chunk_id").distinct()), "chunk_id", "left_semi")
    described = [texts[name] for name in texts.columns if name != "chunk_id"]
    ranked = [results[name] for name in results.columns if name != "chunk_id"]
    return results.hint("merge").join(texts, "chunk_id").select("chunk_id", *described, *ranked)


def cosine_search(corpus: DataFrame, queries: DataFrame, top_k: int = 5, **options) -> DataFrame:
    """`query_id, rank, chunk_id, similarity` plus the corpus columns."""
    corpus_id = options.get("corpus_id", "chunk_id")
    if corpus.select(corpus_id).isEmpty():
        raise ValueError("there are no vectors to search")
    found = nearest(corpus, queries, top_k, "cosine", **options)
    return lookup_chunks(found.withColumnRenamed("score", "similarity"), corpus, corpus_id)


def collection_query(
    collection: DataFrame,
    queries: DataFrame,
    n_results: int = 3,
    metric: str | None = None,
    with_embedding: bool = False,
    **options,
) -> DataFrame:
    """`query_id, rank, chunk_id, document, distance[, embedding]` from a collection.

    The metric is the one that the collection was created with; another one is an error. The
    distance is 1 - cosine, or the squared Euclidean distance for "l2".
    """
    metric = _metric_of(collection, metric)
    found = nearest(collection, queries, n_results, metric, corpus_id="id", **options)
    score = F.col("score")
    distance = 1 - score if metric == "cosine" else -score
    results = found.select("query_id", "rank", "chunk_id", distance.alias("distance"))
    vector = [F.col("embedding").alias("vector")] if with_embedding else []
    documents = collection.select("id", F.col("chunk_id").alias("key"), "document", *vector)
    return lookup_chunks(results, documents, "id").select(
        "query_id", "rank", F.col("chunk_id").alias("id"), F.col("key").alias("chunk_id"),
        "document", "distance", *([F.col("vector").alias("embedding")] if with_embedding else []),
    )


def _metric_of(collection: DataFrame, metric: str | None) -> str:
    """The metric of a collection, which `metric` must not contradict."""
    known = ["metric"] if "metric" in collection.columns else []
    stated = [r[0] for r in collection.select(*known).distinct().limit(2).collect()] if known else []
    if len(stated) > 1:
        raise ValueError(f"the collection mixes the metrics {sorted(stated)}")
    if stated and metric not in (None, stated[0]):
        raise ValueError(f"the collection was created with {stated[0]}, not {metric}")
    return stated[0] if stated else metric or METRICS[0]


def distance_to_similarity(distance: Column) -> Column:
    return 1 - distance


def score_query(corpus: DataFrame, query: list[float], metric: str = "cosine") -> DataFrame:
    """Score of every corpus vector against one query vector; map-only and JVM-side."""
    from locusframe.functions.vectors import cosine, squared_l2

    vector = F.lit([float(x) for x in query])
    score = cosine if metric == "cosine" else squared_l2
    return corpus.withColumn("score", score(F.col("embedding"), vector))


def search_result_card(results: DataFrame) -> DataFrame:
    """The text block shown for a result: rank, similarity, key metadata, preview."""
    meta = F.col("metadata")
    bounds, genes = meta["lod_range"], meta["genes"]
    parts = [
        F.concat(F.col("rank").cast("string"), F.lit(". Similarity: "), fixed(F.col("similarity"), 3)),
        F.concat(F.lit("   Chunk ID: "), F.col("chunk_id")),
        F.concat(F.lit("   Type: "), F.col("type")),
        lod_range_text("   LOD range: ", bounds),
        F.concat(F.lit("   QTL count: "), meta["qtl_count"].cast("string")),
        F.when(
            genes.isNotNull() & (F.size(genes) <= 5),
            F.concat(F.lit("   Genes: "), F.array_join(genes, ", ")),
        ),
        F.concat(F.lit("   Content: "), preview(F.col("content"), 300)),
        F.repeat(F.lit("-"), 40),
    ]
    return results.withColumn("card", F.concat_ws("\n", *parts))


def lod_range_text(label: str, bounds: Column) -> Column:
    """Label and both bounds with two decimals; NULL without a range."""
    low, high = F.get(bounds, F.lit(0)), F.get(bounds, F.lit(1))
    text = [F.coalesce(fixed(b, 2), F.lit("nan")) for b in (low, high)]
    return F.when(bounds.isNotNull(), F.concat(F.lit(label), text[0], F.lit(" - "), text[1]))


def query_result_lines(
    questions: DataFrame, results: DataFrame, document: str = "document"
) -> DataFrame:
    """One text block per result, or "No results found." for a question without any."""
    similarity = distance_to_similarity(F.col("distance"))
    line = F.concat(
        F.col("rank").cast("string"),
        F.lit(". Similarity Score: "),
        fixed(similarity, 3),
        F.lit("\n   Content Preview: "),
        preview(F.col(document), 200, always=True),
        F.lit("\n"),
        F.repeat(F.lit("-"), 40),
    )
    blocks = results.select("query_id", "rank", line.alias("line"))
    return (
        questions.select("query_id", "question")
        .join(blocks, "query_id", "left")
        .withColumn("line", F.coalesce("line", F.lit("No results found.")))
    )


def embedding_head(vector: Column, n: int) -> Column:
    return F.slice(vector, 1, n)


def query_result_listing(
    results: DataFrame, preview_length: int = 200, dimensions: int = 10
) -> DataFrame:
    """Rank, distance, preview and first vector cells of query results with embeddings."""
    return results.select(
        "query_id",
        "rank",
        "id",
        "distance",
        preview(F.col("document"), preview_length, always=True).alias("preview"),
        embedding_head(F.col("embedding"), dimensions).alias("first_dimensions"),
    )


def embedding_listing(
    collection: DataFrame, limit: int | None = 5, preview_length: int = 100, dimensions: int = 5
) -> DataFrame:
    """Preview and first vector cells of the first documents, or of all with limit=None."""
    listed = collection.withColumn("_at", F.col("id").cast("bigint"))
    if limit is not None:
        listed = listed.orderBy("_at").limit(limit)
    return listed.select(
        (F.col("_at") + 1).alias("number"),
        preview(F.col("document"), preview_length, always=True).alias("preview"),
        embedding_head(F.col("embedding"), dimensions).alias("first_dimensions"),
    )
