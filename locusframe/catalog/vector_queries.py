"""Registered queries that embed, store and search texts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.catalog import sql as S
from locusframe.catalog.chunk_queries import top_chunks
from locusframe.catalog.inputs import SAMPLE_QUESTIONS, benchmark, peaks, table
from locusframe.catalog.registry import CHECKS, query
from locusframe.functions import vectors as V
from locusframe.functions.text import rule_line
from locusframe.operators import chunkers, embed, pruned_search, search, stats
from locusframe.sources import chatlog, collections
from locusframe.sources import vectors as vector_files
from locusframe.storage import new_path


def documents(spark, folder) -> DataFrame:
    """Documents as the embedding operators name their columns."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("content"), "lang", "n_chars"
    )


def embedded_documents(spark, folder, **options) -> DataFrame:
    return embed.embed_text(documents(spark, folder), "content", **options)


def checksum(vector: Column) -> Column:
    """Position-weighted sum of a vector, to compare it in one number."""
    weighted = F.transform(vector.cast("array<double>"), lambda x, i: x * (i + 1))
    total = F.aggregate(weighted, F.lit(0.0), lambda s, x: s + x)
    # Adding 0 turns -0 into 0.
    return F.round(total, 6) + F.lit(0.0)


def _checksums(source: str, key: str, text: str, body: str, *before: str) -> str:
    sums = f"sums AS (SELECT key, {S.CHECKSUM} + 0.0 AS checksum FROM vec GROUP BY key)"
    return S.with_(*before, S.vectors(source, key, text), sums, body=body)


_DOCUMENT_SUMS = "SELECT doc_id AS id, coalesce(checksum, 0) AS checksum FROM documents LEFT JOIN sums ON key = doc_id"


@query("embed_documents", _checksums("documents", "doc_id", "text", _DOCUMENT_SUMS))
def _(spark, folder):
    embedded = embedded_documents(spark, folder, title="documents")
    return embedded.select("id", checksum(F.col("embedding")).alias("checksum"))


@query("embed_documents_once", CHECKS["embed_documents"])
def _(spark, folder):
    """Every different text is embedded once: half of them in a first run, the rest in a second."""
    store, docs = new_path(spark, "vectors-by-text"), documents(spark, folder)
    embed.embed_once(docs.where(F.col("id") % 2 == 0), "content", store).count()
    embedded = embed.embed_once(docs, "content", store)
    return embedded.select("id", checksum(F.col("embedding")).alias("checksum"))


@query(
    "embed_by_method",
    _checksums("documents", "doc_id", "text", _DOCUMENT_SUMS.replace("SELECT", "SELECT 'short_hashing' AS method,", 1))
    .replace("% 256", "% 64"),
)
def _(spark, folder):
    """A method of the caller's own, chosen by its name."""
    embed.register_embedder("short_hashing", lambda **_: embed.hashing_embedder(64))
    embedded = embedded_documents(spark, folder, method="short_hashing")
    return embedded.select(
        F.lit("short_hashing").alias("method"), "id", checksum(F.col("embedding")).alias("checksum")
    )


@query(
    "embed_queries",
    _checksums(
        "benchmark", "item_id", "text",
        "SELECT item_id AS query_id, coalesce(checksum, 0) AS checksum FROM benchmark LEFT JOIN sums ON key = item_id",
    ),
)
def _(spark, folder):
    embedded = embed.embed_queries(benchmark(spark, folder))
    return embedded.select("query_id", checksum(F.col("embedding")).alias("checksum"))


@query(
    "embed_chunks",
    _checksums("chunks", "id", "content", "SELECT key AS id, checksum FROM sums",
               S.PEAKS_CTE, *S.CHROMOSOME_CHUNKS),
)
def _(spark, folder):
    chunks = chunkers.chunk_by_chromosome(peaks(spark, folder), include_raw=False)
    embedded = embed.embed_chunks(chunks)
    return embedded.select("id", checksum(F.col("embedding")).alias("checksum"))


def short_texts_only(limit: int = 5000, **_):
    """An embedder that refuses long texts."""

    def run(texts):
        for text in texts:
            if len(text) > limit:
                raise ValueError(f"longer than {limit}")
        return [[float(len(text)), float(text.count(" "))] for text in texts]

    return run


@query(
    "embed_failures",
    "SELECT doc_id AS id, 'ValueError: longer than 5000' AS embed_error FROM documents WHERE length(text) > 5000",
)
def _(spark, folder):
    embed.register_embedder("short_texts_only", short_texts_only)
    embedded = embed.embed_text(documents(spark, folder), "content", "short_texts_only")
    return embed.embed_failures(embedded).select("id", "embed_error")


@query(
    "embedder_protocol",
    "SELECT doc_id AS id, CAST(length(text) AS DOUBLE) AS characters,"
    " CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS blanks FROM documents",
)
def _(spark, folder):
    embed.register_embedder("short_texts_only", short_texts_only)
    embedded = embed.embed_text(
        documents(spark, folder), "content", "short_texts_only", limit=10_000_000
    )
    vector = F.col("embedding").cast("array<double>")
    return embedded.select("id", vector[0].alias("characters"), vector[1].alias("blanks"))


@query(
    "embedding_stats",
    "SELECT count(*) AS vectors, min(len(embedding)) AS min_dimension, max(len(embedding)) AS max_dimension FROM embeddings",
)
def _(spark, folder):
    sizes = stats.embedding_stats(table(spark, folder, "embeddings"))
    return sizes.select(
        "vectors",
        F.col("min_dimension").cast("bigint"),
        F.col("max_dimension").cast("bigint"),
    )


@query(
    "vector_functions",
    """SELECT vec_id, round(list_dot_product(v, r), 6) AS dot, round(sqrt(list_dot_product(v, v)), 6) AS norm,
 round(list_cosine_similarity(v, r), 6) AS cosine, round(list_distance(v, r) * list_distance(v, r), 6) AS squared_l2
 FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, list_reverse(CAST(embedding AS DOUBLE[])) AS r FROM embeddings)""",
)
def _(spark, folder):
    vector = F.col("embedding")
    mirrored = F.reverse(vector)
    return table(spark, folder, "embeddings").select(
        "vec_id",
        F.round(V.dot(vector, mirrored), 6).alias("dot"),
        F.round(V.l2_norm(vector), 6).alias("norm"),
        F.round(V.cosine(vector, mirrored), 6).alias("cosine"),
        F.round(V.squared_l2(vector, mirrored), 6).alias("squared_l2"),
    )


@query(
    "embedding_head",
    "SELECT vec_id, array_to_string(list_transform(embedding[1:5], lambda x: printf('%.4f', x)), ' ') AS head FROM embeddings",
)
def _(spark, folder):
    head = search.embedding_head(F.col("embedding"), 5)
    return table(spark, folder, "embeddings").select(
        "vec_id", F.array_join(F.transform(head, lambda x: F.format_string("%.4f", x)), " ").alias("head")
    )


_QUESTION = SAMPLE_QUESTIONS[12].replace("'", "''")


@query(
    "score_pairs",
    S.with_(
        S.vectors("documents", "doc_id", "text", "d"),
        f"ask AS (SELECT 0 AS key, '{_QUESTION}' AS text)",
        S.vectors("ask", "key", "text", "q"),
        body="""SELECT doc_id AS id, round(CASE WHEN dnorm.n IS NULL THEN NULL ELSE coalesce(dot, 0) /
 (dnorm.n * (SELECT n FROM qnorm)) END, 6) + 0.0 AS score FROM documents LEFT JOIN dnorm ON key = doc_id
 LEFT JOIN (SELECT d.key AS k, sum(d.x * q.x) AS dot FROM dvec d JOIN qvec q USING (b) GROUP BY 1) ON k = doc_id""",
    ),
)
def _(spark, folder):
    embedded = embedded_documents(spark, folder)
    asked = embed.hashing_embedder()([SAMPLE_QUESTIONS[12]])[0].tolist()
    scored = search.score_query(embedded, asked)
    return scored.select("id", (F.round("score", 6) + F.lit(0.0)).alias("score"))


_BENCHMARK_HITS = (
    S.vectors("documents", "doc_id", "text", "d"),
    S.vectors("benchmark", "item_id", "text", "q"),
)


def _hits(k: int) -> tuple[str, ...]:
    return (*_BENCHMARK_HITS, S.hits("documents", "doc_id", "benchmark", "item_id", k))


def _search(spark, folder, k: int) -> DataFrame:
    corpus = embedded_documents(spark, folder)
    asked = embed.embed_queries(benchmark(spark, folder))
    return search.nearest(corpus, asked, k, corpus_id="id")


@query(
    "top_k_neighbours",
    S.with_(*_hits(5), body="SELECT query_id, chunk_id, round(sim, 6) AS score FROM hits"),
)
def _(spark, folder):
    found = _search(spark, folder, 5)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query("result_rank", S.with_(*_hits(3), body="SELECT query_id, rank, chunk_id FROM hits"))
def _(spark, folder):
    return _search(spark, folder, 3).select("query_id", "rank", "chunk_id")


@query(
    "lookup_chunks",
    S.with_(
        *_hits(5),
        body="SELECT query_id, rank, chunk_id, lang, n_chars FROM hits JOIN documents ON doc_id = chunk_id",
    ),
)
def _(spark, folder):
    texts = documents(spark, folder).drop("content")
    found = search.lookup_chunks(_search(spark, folder, 5), texts, "id")
    return found.select("query_id", "rank", "chunk_id", "lang", "n_chars")


@query(
    "cosine_search",
    S.with_(
        *_hits(5),
        body="""SELECT query_id, rank, chunk_id, round(sim, 6) AS similarity, text AS content
 FROM hits JOIN documents ON doc_id = chunk_id""",
    ),
)
def _(spark, folder):
    corpus = embedded_documents(spark, folder)
    asked = embed.embed_queries(benchmark(spark, folder))
    found = search.cosine_search(corpus, asked, corpus_id="id")
    return found.select(
        "query_id", "rank", "chunk_id", F.round("similarity", 6).alias("similarity"), "content"
    )


@query(
    "cosine_search_vectors",
    """SELECT query_id, rank, chunk_id, round(sim, 6) AS score FROM
 (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS rank FROM
  (SELECT q.vec_id AS query_id, d.vec_id AS chunk_id,
    round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 9) AS sim
   FROM embeddings q, embeddings d)) WHERE rank <= 5""",
)
def _(spark, folder):
    vectors = table(spark, folder, "embeddings")
    found = search.nearest(vectors, vectors, 5, corpus_id="vec_id", query_id="vec_id")
    return found.withColumn("score", F.round("score", 6))


@query("cosine_search_pruned", CHECKS["cosine_search_vectors"])
def _(spark, folder):
    """The same rows from clustered vectors, without those that are too far away."""
    vectors = table(spark, folder, "embeddings")
    path = new_path(spark, "clustered")
    vector_files.write_clustered_vectors(vectors, path, "given")
    clustered = vector_files.read_clustered_vectors(spark, path)
    found = pruned_search.nearest_pruned(clustered, vectors, 5, corpus_id="vec_id", query_id="vec_id")
    return found.withColumn("score", F.round("score", 6))


@query(
    "search_result_card",
    S.with_(
        S.PEAKS_CTE,
        *S.CHROMOSOME_CHUNKS,
        S.vectors("chunks", "id", "content", "d"),
        S.vectors("benchmark", "item_id", "text", "q"),
        S.hits("chunks", "id", "benchmark", "item_id", 3),
        body=f"""SELECT query_id, rank, concat_ws(E'\\n', concat(rank, '. Similarity: ', {S.fixed('sim', 3)}),
 concat('   Chunk ID: ', chunk_id), '   Type: chromosome_group', concat('   QTL count: ', qtl_count),
 CASE WHEN len(string_split(genes, ', ')) <= 5 THEN concat('   Genes: ', genes) END,
 concat('   Content: ', CASE WHEN length(content) > 300 THEN substr(content, 1, 300) || '...' ELSE content END),
 repeat('-', 40)) AS card FROM hits JOIN chunks ON id = chunk_id""",
    ),
)
def _(spark, folder):
    chunks = chunkers.chunk_by_chromosome(peaks(spark, folder), include_raw=False)
    corpus = embed.embed_chunks(chunks)
    asked = embed.embed_queries(benchmark(spark, folder))
    found = search.cosine_search(corpus, asked, 3, corpus_id="id")
    return search.search_result_card(found).select("query_id", "rank", "card")


@query(
    "search_result_card_top",
    S.with_(
        S.PEAKS_CTE,
        *top_chunks(),
        S.vectors("top_body", "id", "content", "d"),
        S.vectors("benchmark", "item_id", "text", "q"),
        S.hits("top_body", "id", "benchmark", "item_id", 3),
        body=f"""SELECT query_id, rank, concat_ws(E'\\n', concat(rank, '. Similarity: ', {S.fixed('sim', 3)}),
 concat('   Chunk ID: ', chunk_id), '   Type: top_qtls',
 concat('   LOD range: ', {S.fixed('lod_range_lo', 2)}, ' - ', {S.fixed('lod_range_hi', 2)}), concat('   QTL count: ', qtl_count),
 CASE WHEN len(string_split(genes, ', ')) <= 5 THEN concat('   Genes: ', genes) END,
 concat('   Content: ', CASE WHEN length(content) > 300 THEN substr(content, 1, 300) || '...' ELSE content END),
 repeat('-', 40)) AS card FROM hits JOIN top_body ON id = chunk_id""",
    ),
)
def _(spark, folder):
    chunks = chunkers.chunk_top_records(peaks(spark, folder), include_raw=False)
    asked = embed.embed_queries(benchmark(spark, folder))
    found = search.cosine_search(embed.embed_chunks(chunks), asked, 3, corpus_id="id")
    return search.search_result_card(found).select("query_id", "rank", "card")


_L2 = S.with_(
    *_BENCHMARK_HITS,
    """pairs AS (SELECT item_id AS query_id, doc_id AS chunk_id, round(greatest(coalesce(power(qn.n, 2), 0) + coalesce(power(dn.n, 2), 0)
  - 2 * coalesce(dot, 0), 0), 9) AS distance FROM benchmark CROSS JOIN documents
 LEFT JOIN (SELECT q.key AS k, d.key AS j, sum(q.x * d.x) AS dot FROM qvec q JOIN dvec d ON q.b = d.b GROUP BY ALL)
  ON k = item_id AND j = doc_id
 LEFT JOIN qnorm qn ON qn.key = item_id LEFT JOIN dnorm dn ON dn.key = doc_id)""",
    body="""SELECT query_id, rank, CAST(chunk_id AS VARCHAR) AS id, round(distance, 6) AS distance FROM
 (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, CAST(chunk_id AS VARCHAR)) AS rank FROM pairs)
 WHERE rank <= 3""",
)

# Collection ids are text, so equal scores rank in text order.
_TEXT_HITS = S.hits(
    "documents", "CAST(doc_id AS VARCHAR)", "benchmark", "item_id", 3
).replace("d.key AS chunk_id", "CAST(d.key AS VARCHAR) AS chunk_id").replace(
    "dn.key = chunk_id", "CAST(dn.key AS VARCHAR) = chunk_id"
)


@query(
    "collection_query",
    S.with_(
        *_BENCHMARK_HITS,
        _TEXT_HITS,
        body="""SELECT query_id, rank, chunk_id AS id, round(1 - sim, 6) AS distance, text AS document
 FROM hits JOIN documents ON CAST(doc_id AS VARCHAR) = chunk_id""",
    ),
)
def _(spark, folder):
    asked = embed.embed_queries(benchmark(spark, folder))
    found = search.collection_query(_created(spark, folder), asked)
    return found.select("query_id", "rank", "id", F.round("distance", 6).alias("distance"), "document")


@query("collection_query_l2", _L2)
def _(spark, folder):
    asked = embed.embed_queries(benchmark(spark, folder))
    found = search.collection_query(_created(spark, folder, metric="l2"), asked)
    return found.select("query_id", "rank", "id", F.round("distance", 6).alias("distance"))


@query(
    "distance_to_similarity",
    S.with_(
        *_BENCHMARK_HITS,
        _TEXT_HITS,
        body="SELECT query_id, rank, round(sim, 6) AS similarity FROM hits WHERE rank <= 2",
    ),
)
def _(spark, folder):
    asked = embed.embed_queries(benchmark(spark, folder))
    found = search.collection_query(_created(spark, folder), asked, n_results=2)
    similarity = search.distance_to_similarity(F.col("distance"))
    return found.select("query_id", "rank", F.round(similarity, 6).alias("similarity"))


@query(
    "query_result_lines",
    S.with_(
        *_BENCHMARK_HITS,
        _TEXT_HITS,
        body=f"""SELECT query_id, rank, concat(rank, '. Similarity Score: ', {S.fixed('1 - (1 - sim)', 3)},
 E'\\n   Content Preview: ', substr(text, 1, 200), E'...\\n', repeat('-', 40)) AS line
 FROM hits JOIN documents ON CAST(doc_id AS VARCHAR) = chunk_id""",
    ),
)
def _(spark, folder):
    questions = benchmark(spark, folder)
    found = search.collection_query(_created(spark, folder), embed.embed_queries(questions))
    return search.query_result_lines(questions, found).select("query_id", "rank", "line")


@query(
    "embedding_listing",
    S.with_(
        S.vectors("documents", "doc_id", "text"),
        body="""SELECT doc_id + 1 AS number, substr(text, 1, 100) || '...' AS preview, printf('%.5f %.5f',
 coalesce(a.x, 0), coalesce(b.x, 0)) AS dimensions FROM documents LEFT JOIN vec a ON a.key = doc_id AND a.b = 0
 LEFT JOIN vec b ON b.key = doc_id AND b.b = 1""",
    ),
)
def _(spark, folder):
    listing = search.embedding_listing(_created(spark, folder), limit=None)
    cells = [F.col("first_dimensions")[i].cast("double") for i in range(2)]
    return listing.select(
        "number", "preview", F.format_string("%.5f %.5f", *cells).alias("dimensions")
    )


@query(
    "query_result_listing",
    S.with_(
        *_BENCHMARK_HITS,
        _TEXT_HITS,
        body="""SELECT query_id, rank, substr(text, 1, 200) || '...' AS preview, CAST(10 AS INT) AS cells,
 printf('%.5f %.5f', coalesce(a.x, 0), coalesce(b.x, 0)) AS dimensions
 FROM hits JOIN documents ON CAST(doc_id AS VARCHAR) = chunk_id LEFT JOIN dvec a ON a.key = doc_id AND a.b = 0
 LEFT JOIN dvec b ON b.key = doc_id AND b.b = 9""",
    ),
)
def _(spark, folder):
    asked = embed.embed_queries(benchmark(spark, folder))
    found = search.collection_query(_created(spark, folder), asked, with_embedding=True)
    cells = [F.col("first_dimensions")[i].cast("double") for i in (0, 9)]
    return search.query_result_listing(found).select(
        "query_id", "rank", "preview", F.size("first_dimensions").alias("cells"),
        F.format_string("%.5f %.5f", *cells).alias("dimensions"),
    )


@query(
    "write_vectors",
    "SELECT count(*) AS vectors, CAST(256 AS BIGINT) AS dimension FROM documents",
)
def _(spark, folder):
    path = new_path(spark, "vectors")
    vector_files.write_vectors(embedded_documents(spark, folder), path, "hashing")
    return vector_files.vector_report(spark, path).select("vectors", "dimension")


@query(
    "read_vectors",
    _checksums(
        "documents", "doc_id", "text",
        "SELECT doc_id AS id, 'hashing' AS embedding_method, CAST(256 AS BIGINT) AS embedding_dimension,"
        " coalesce(checksum, 0) AS checksum FROM documents LEFT JOIN sums ON key = doc_id",
    ),
)
def _(spark, folder):
    path = new_path(spark, "vectors")
    vector_files.write_vectors(embedded_documents(spark, folder), path, "hashing")
    return vector_files.read_vectors(spark, path).select(
        "id", "embedding_method", "embedding_dimension",
        checksum(F.col("embedding")).alias("checksum"),
    )


def _created(spark, folder, **options) -> DataFrame:
    return collections.create_collection(
        documents(spark, folder),
        [F.col("id")],
        new_path(spark, "collections"),
        "documents",
        **options,
    )


@query(
    "create_collection",
    _checksums(
        "documents", "doc_id", "text",
        """SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS VARCHAR) AS id, CAST(doc_id AS VARCHAR) AS chunk_id,
 text AS document, 'cosine' AS metric, coalesce(checksum, 0) AS checksum FROM documents LEFT JOIN sums ON key = doc_id""",
    ),
)
def _(spark, folder):
    return _created(spark, folder).select(
        "id", "chunk_id", "document", "metric", checksum(F.col("embedding")).alias("checksum")
    )


@query(
    "open_collection",
    "SELECT 'documents' AS name, count(*) AS documents FROM documents UNION ALL SELECT 'absent', 0",
)
def _(spark, folder):
    root = new_path(spark, "collections")
    collections.create_collection(
        documents(spark, folder), [F.col("id")], root, "documents"
    )

    def count(name: str) -> DataFrame:
        opened = collections.open_collection(spark, root, name)
        return collections.collection_count(opened).select(F.lit(name).alias("name"), "documents")

    return count("documents").union(count("absent"))


@query(
    "collection_get",
    _checksums(
        "documents", "doc_id", "text",
        "SELECT CAST(doc_id AS VARCHAR) AS id, text AS document, coalesce(checksum, 0) AS checksum"
        " FROM documents LEFT JOIN sums ON key = doc_id",
    ),
)
def _(spark, folder):
    got = collections.collection_get(_created(spark, folder))
    return got.select("id", "document", checksum(F.col("embedding")).alias("checksum"))


@query("collection_count", "SELECT count(*) AS documents FROM documents")
def _(spark, folder):
    return collections.collection_count(_created(spark, folder))


@query(
    "append_chat_log",
    """SELECT u.conv_id, u.turn, u.text AS "user", a.text AS assistant, concat('turn ', u.turn) AS context
 FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
 WHERE u.role = 'user' AND a.role = 'assistant'""",
)
def _(spark, folder):
    said = table(spark, folder, "conversations")
    replies = said.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("assistant")
    )
    turns = (
        said.filter(F.col("role") == "user")
        .withColumnRenamed("text", "user")
        .join(replies, ["conv_id", "turn"])
        .withColumn("context", F.concat(F.lit("turn "), F.col("turn").cast("string")))
        .drop("role")
    )
    path = new_path(spark, "chat")
    opening = F.col("turn") == 0
    chatlog.append_chat_log(turns.filter(opening), path)
    chatlog.append_chat_log(turns.filter(~opening), path)
    return chatlog.read_chat_log(spark, path)


@query(
    "rule_line",
    "SELECT doc_id, lang || repeat('=', 40) AS heavy, lang || repeat('-', 40) AS light FROM documents",
)
def _(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id",
        F.concat("lang", rule_line("=")).alias("heavy"),
        F.concat("lang", rule_line()).alias("light"),
    )
