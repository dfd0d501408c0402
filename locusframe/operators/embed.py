"""Text embedding through pluggable batch embedders.

An embedder is a callable `list[str] -> list of vectors`. It is the only place where
Python workers run, because a model is user code; only the text column is sent to
them, in Arrow batches, and the model is built once per task.
"""

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.schema import VECTOR
from locusframe.storage import bounded_batches, stored

# Bytes of text and rows that an embedder is given at once; a longer text comes alone.
EMBED_BYTES, EMBED_ROWS = 1 << 20, 1024

# Tokens whose codes the hashing embedder remembers.
KNOWN_TOKENS = 1 << 17


class Embedder(Protocol):
    def __call__(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


def hashing_embedder(dimension: int = 256, **_) -> Embedder:
    """Signed feature hashing of whitespace-separated tokens, scaled to unit length.

    The first 8 hex digits of md5(token) choose the cell and the ninth the sign (`8` and
    up is negative). A text without tokens gives a zero vector.
    """
    import hashlib

    known: dict[str, int] = {}

    def code(token: str) -> int:
        """2 * cell + sign bit of a token."""
        found = known.get(token)
        if found is None:
            digest = hashlib.md5(token.encode()).hexdigest()
            found = 2 * (int(digest[:8], 16) % dimension) + (digest[8] >= "8")
            if len(known) >= KNOWN_TOKENS:
                known.clear()
            known[token] = found
        return found

    def embed(texts):
        rows = pa.array(texts, pa.large_string())
        tokens = pc.split_pattern_regex(rows, "[ \t\n\r\f]+")
        owners = pc.list_parent_indices(tokens).to_numpy()
        coded = pc.dictionary_encode(pc.list_flatten(tokens))
        # Leading and trailing blanks give empty tokens, which count in no cell.
        words = coded.dictionary.to_pylist()
        codes = np.fromiter((code(w) if w else -1 for w in words), "int64", len(words))
        codes = codes[coded.indices.to_numpy()] if len(words) else np.zeros(0, "int64")
        real = codes >= 0
        places = owners[real] * (2 * dimension) + codes[real]
        counts = np.bincount(places, minlength=len(texts) * 2 * dimension)
        counts = counts.reshape(len(texts), dimension, 2)
        vectors = (counts[:, :, 0] - counts[:, :, 1]).astype("float64")
        norms = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
        return np.divide(vectors, norms, out=vectors, where=norms > 0).astype("float32")

    return embed


def sentence_transformers_embedder(model: str = "all-MiniLM-L6-v2", **_) -> Embedder:
    """A local sentence-transformers model, where that library is installed."""
    from sentence_transformers import SentenceTransformer

    loaded = SentenceTransformer(model)
    return lambda texts: loaded.encode(list(texts), convert_to_numpy=True)


_FACTORIES: dict[str, Callable[..., Embedder]] = {
    "hashing": hashing_embedder,
    "sentence_transformers": sentence_transformers_embedder,
}


def register_embedder(method: str, factory: Callable[..., Embedder]) -> None:
    """Make `factory(task_type=..., title=..., **options)` available as `method`."""
    _FACTORIES[method] = factory


def embedder_factory(method: str) -> Callable[..., Embedder]:
    if method not in _FACTORIES:
        raise ValueError(f"embedding method must be one of {sorted(_FACTORIES)}, not {method!r}")
    return _FACTORIES[method]


def _spread(df: DataFrame, tasks: int | None) -> DataFrame:
    """`df` over `tasks` tasks, or over all cores if its files have fewer splits."""
    if tasks is not None:
        return df.repartition(tasks)
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        # Shuffled rows are spread already, and counting their partitions would run the shuffle.
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _portions(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of a batch that an embedder is given at once."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype="int64")
    start, before = 0, 0
    while start < len(texts):
        stop = max(int(np.searchsorted(sizes, before + EMBED_BYTES, side="right")), start + 1)
        stop = min(stop, start + EMBED_ROWS)
        yield texts.slice(start, stop - start)
        start, before = stop, int(sizes[stop - 1])


def embed_text(
    df: DataFrame,
    text: str,
    method: str = "hashing",
    task_type: str = "retrieval_document",
    title: str | None = None,
    tasks: int | None = None,
    **options,
) -> DataFrame:
    """Add `embedding` and `embed_error`.

    Texts are embedded where they lie. Files in fewer splits than there are cores are spread over
    all cores first, because a model costs more than a shuffle; `tasks` spreads them over so many.

    A text the embedder fails on, and a NULL text, has a NULL embedding and the reason in
    `embed_error`; the other texts of its portion are embedded one by one. A portion has at most `EMBED_BYTES` bytes
    of text, so that what a task holds does not grow with the table.
    """
    factory = embedder_factory(method)
    df = bounded_batches(_spread(df, tasks))
    settings = {"task_type": task_type, "title": title, **options}

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        embed = factory(**settings)

        def one(text):
            try:
                return embed([text])[0], None
            except Exception as error:
                return None, f"{type(error).__name__}: {error}"

        def embedded(portion):
            texts = portion.to_pylist()
            given = [i for i, text in enumerate(texts) if text is not None]
            vectors = [None] * len(texts)
            errors = ["text is missing"] * len(texts)
            try:
                results = [(v, None) for v in embed([texts[i] for i in given])] if given else []
            except Exception:
                results = [one(texts[i]) for i in given]
            for i, (vector, error) in zip(given, results, strict=True):
                vectors[i], errors[i] = vector, error
            lengths = [0 if v is None else len(v) for v in vectors]
            flat = [np.asarray(v, dtype="float32") for v in vectors if v is not None]
            cells = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()),
                pa.array(np.concatenate(flat) if flat else [], pa.float32()),
                mask=pa.array([v is None for v in vectors], pa.bool_()),
            )
            return pa.StructArray.from_arrays(
                [cells, pa.array(errors, pa.string())], names=["embedding", "embed_error"]
            )

        for batch in batches:
            parts = [embedded(portion) for portion in _portions(batch)]
            yield pa.concat_arrays(parts) if parts else embedded(batch)

    # The annotations tell Spark that this is an iterator of Arrow arrays.
    result = f"embedding {VECTOR.simpleString()}, embed_error string"
    # As a nondeterministic column it is not copied into later filters: every text is
    # embedded once.
    embedded = F.arrow_udf(run, result).asNondeterministic()(F.col(text))
    return (
        df.withColumn("_embedded", embedded)
        .withColumns(
            {
                "embedding": F.col("_embedded.embedding"),
                "embed_error": F.col("_embedded.embed_error"),
            }
        )
        .drop("_embedded")
    )


def embed_chunks(chunks: DataFrame, method: str = "hashing", **options) -> DataFrame:
    """Embed the `content` of a chunk table; an empty table is an error."""
    if chunks.select(F.lit(1)).isEmpty():
        raise ValueError("there are no chunks to embed")
    return embed_text(chunks, "content", method, **options)


def embed_queries(
    questions: DataFrame, text: str = "question", method: str = "hashing", **options
) -> DataFrame:
    return embed_text(questions, text, method, task_type="retrieval_query", **options)


def embed_failures(embedded: DataFrame) -> DataFrame:
    """Rows without an embedding, for reporting or a later retry."""
    return embedded.filter(F.col("embed_error").isNotNull())


def embed_once(
    df: DataFrame,
    text: str,
    store: str,
    method: str = "hashing",
    **options,
) -> DataFrame:
    """Add `embedding` and `embed_error`; texts that are equal, now or in an earlier run, are embedded once.

    The folder `store` keeps a vector for every different text, by the SHA-256 of the text and the
    method, and grows by those of new texts. Texts that failed are tried again. A NULL text has no
    vector. `options` should be the same in every run of a store.
    """
    session = df.sparkSession
    key = F.sha2(F.concat(F.lit(method + ":"), F.col(text)), 256)
    rows = df.withColumn("_key", key)
    texts = rows.where(F.col("_key").isNotNull()).select("_key", F.col(text).alias("_text"))
    texts = texts.groupBy("_key").agg(F.first("_text").alias("_text"))
    schema = f"_key string, embedding {VECTOR.simpleString()}"

    def known() -> DataFrame:
        try:
            # Two runs at once may have stored a text twice.
            return session.read.schema(schema).parquet(store).dropDuplicates(["_key"])
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return session.createDataFrame([], schema)

    fresh = stored(embed_text(texts.join(known(), "_key", "left_anti"), "_text", method, **options), "embedded")
    fresh.where(F.col("embedding").isNotNull()).select("_key", "embedding").write.mode("append").parquet(store)
    failed = fresh.where(F.col("embedding").isNull()).select("_key", F.col("embed_error").alias("_error"))
    joined = rows.join(known(), "_key", "left").join(failed, "_key", "left")
    error = F.when(F.col(text).isNull(), F.lit("text is missing")).otherwise(F.col("_error"))
    return joined.withColumn("embed_error", error).drop("_key", "_error")
