"""Registered queries over the table of questions: parsing, contexts, prompts, answers."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.catalog import sql as S
from locusframe.catalog.chunk_queries import top_chunks
from locusframe.catalog.inputs import peaks, questions
from locusframe.catalog.registry import query
from locusframe.functions import parsing
from locusframe.operators import chunkers, embed, search
from locusframe.plans import prompts
from locusframe.plans.answers import answer_by_rules, answer_texts
from locusframe.plans.context import context_from_chunks, context_from_documents
from locusframe.plans.data_context import data_context
from locusframe.plans.retrieve import asked, query_and_prompt, retrieve_and_prompt
from locusframe.sources.collections import create_collection
from locusframe.sources.vectors import read_vectors, write_vectors
from locusframe.storage import new_path

_FIRST_INTEGER = "TRY_CAST(nullif(regexp_extract(question, '([0-9]+)', 1), '') AS BIGINT)"
_SCORE_LIMIT = (
    "TRY_CAST(nullif(regexp_extract(question, 'lod\\s*>\\s*([0-9]+(?:\\.[0-9]+)?)', 1, 'i'), '') AS DOUBLE)"
)
_PVALUE_LIMIT = (
    "TRY_CAST(nullif(regexp_extract(regexp_extract(question, '(?:p-?value|pval)\\s*<\\s*([0-9.e-]+)', 1, 'i'),"
    " '^(-?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:e[+-]?[0-9]+)?)', 1, 'i'), '') AS DOUBLE)"
)
_GROUP_TOKEN = "nullif(regexp_extract(question, 'chr(?:omosome)?\\s*([0-9]+)', 1, 'i'), '')"


def _has(word: str) -> str:
    return f"contains(lower(question), '{word}')"


_INTENT = f"""CASE WHEN {_has('top')} AND {_has('lod')} THEN 'top'
 WHEN {_has('compare')} AND {_has('chromosome')} THEN 'compare'
 WHEN {_has('chromosome')} OR {_has('chr')} THEN 'group'
 WHEN {_has('p-value')} OR {_has('pval')} THEN 'pvalue'
 WHEN {_has('gene')} AND ({_has('what')} OR {_has('which')}) THEN 'entities'
 WHEN {_has('summary')} OR {_has('overview')} THEN 'summary' ELSE 'help' END"""

_SELECTION = f"""CASE WHEN {_has('top')} OR {_has('highest')} OR {_has('best')} THEN 'top'
 WHEN {_has('chromosome')} OR {_has('chr')} THEN 'group'
 WHEN {_has('p-value')} OR {_has('significant')} THEN 'pvalue' ELSE 'mixed' END"""


def _parsed(name: str, sql: str, value) -> None:
    """Register a query that reads one value out of every question."""

    @query(name, S.over_questions(f"SELECT query_id, {sql} AS value FROM questions"))
    def _(spark, folder):
        return questions(spark, folder).select("query_id", value(F.col("question")).alias("value"))


_parsed("first_integer", _FIRST_INTEGER, parsing.first_integer)
_parsed("score_threshold", _SCORE_LIMIT, parsing.score_threshold)
_parsed("pvalue_threshold", _PVALUE_LIMIT, parsing.pvalue_threshold)
_parsed("group_token", _GROUP_TOKEN, parsing.group_token)
_parsed("route_rules", _INTENT, parsing.route_rules)
_parsed("route_context", _SELECTION, parsing.route_context)
_parsed("lower_trim", "lower(trim(question))", parsing.normalised)


def _corpus(spark, folder) -> DataFrame:
    """Embedded chunks, stored once as in a real build."""
    chunks = chunkers.chunk_by_chromosome(peaks(spark, folder), include_raw=False)
    path = new_path(spark, "vectors")
    write_vectors(embed.embed_chunks(chunks), path, "hashing")
    return read_vectors(spark, path)


# Questions, chunks and the k nearest chunks of every question.
_ASKED = "asked AS (SELECT query_id, trim(question) AS question FROM questions WHERE trim(question) <> '')"


def _retrieved(k: int) -> tuple[str, ...]:
    return (
        S.PEAKS_CTE,
        S.QUESTIONS_CTE,
        _ASKED,
        *S.CHROMOSOME_CHUNKS,
        S.vectors("chunks", "id", "content", "d"),
        S.vectors("asked", "query_id", "question", "q"),
        S.hits("chunks", "id", "asked", "query_id", k),
    )


_CHUNK_CONTEXT = f"""contexts AS (SELECT query_id, question, coalesce(string_agg(entry, E'\\n' ORDER BY rank), '') AS context
 FROM asked LEFT JOIN (SELECT query_id, rank, concat_ws(E'\\n', concat('[Chunk ', rank, ' - Similarity: ',
   coalesce({S.fixed('sim', 3)}, 'nan'), ']'), concat('Number of QTLs: ', qtl_count),
   CASE WHEN genes <> '' THEN concat('Genes: ', array_to_string(string_split(genes, ', ')[1:5], ', ')) END,
   content, repeat('-', 40)) AS entry FROM hits JOIN chunks ON id = chunk_id) USING (query_id) GROUP BY ALL)"""


@query(
    "context_from_chunks",
    S.with_(*_retrieved(3), _CHUNK_CONTEXT, body="SELECT query_id, question, context FROM contexts"),
)
def _(spark, folder):
    ask = asked(questions(spark, folder))
    found = search.cosine_search(_corpus(spark, folder), embed.embed_queries(ask), 3, corpus_id="id")
    return context_from_chunks(ask, found)


# The default corpus: chunks of the top records, which have a range of scores.
_TOP_CONTEXT = f"""contexts AS (SELECT query_id, question, coalesce(string_agg(entry, E'\\n' ORDER BY rank), '') AS context
 FROM asked LEFT JOIN (SELECT query_id, rank, concat_ws(E'\\n', concat('[Chunk ', rank, ' - Similarity: ',
   coalesce({S.fixed('sim', 3)}, 'nan'), ']'), concat('LOD range: ', {S.fixed('lod_range_lo', 2)}, ' - ', {S.fixed('lod_range_hi', 2)}),
   concat('Number of QTLs: ', qtl_count),
   CASE WHEN genes <> '' THEN concat('Genes: ', array_to_string(string_split(genes, ', ')[1:5], ', ')) END,
   content, repeat('-', 40)) AS entry FROM hits JOIN top_body ON id = chunk_id) USING (query_id) GROUP BY ALL)"""


@query(
    "context_from_top_chunks",
    S.with_(
        S.PEAKS_CTE,
        S.QUESTIONS_CTE,
        _ASKED,
        *top_chunks(),
        S.vectors("top_body", "id", "content", "d"),
        S.vectors("asked", "query_id", "question", "q"),
        S.hits("top_body", "id", "asked", "query_id", 3),
        _TOP_CONTEXT,
        body="SELECT query_id, question, context FROM contexts",
    ),
)
def _(spark, folder):
    ask = asked(questions(spark, folder))
    chunks = chunkers.chunk_top_records(peaks(spark, folder), include_raw=False)
    path = new_path(spark, "vectors")
    write_vectors(embed.embed_chunks(chunks), path, "hashing")
    found = search.cosine_search(
        read_vectors(spark, path), embed.embed_queries(ask), 3, corpus_id="id"
    )
    return context_from_chunks(ask, found)


# In a collection equal scores rank by the position of the chunk, as text.
def _collection_context(k: int) -> tuple[str, ...]:
    return (
        S.PEAKS_CTE,
        S.QUESTIONS_CTE,
        _ASKED,
        *S.CHROMOSOME_CHUNKS,
        "docs AS (SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS VARCHAR) AS id, content FROM chunks)",
        S.vectors("docs", "id", "content", "d"),
        S.vectors("asked", "query_id", "question", "q"),
        S.hits("docs", "id", "asked", "query_id", k),
        f"""contexts AS (SELECT query_id, question, coalesce(concat(E'\\nRetrieved QTL Information:\\n', repeat('=', 40),
  E'\\n', string_agg(entry, E'\\n' ORDER BY rank)), 'No relevant QTL data found for this query.') AS context
 FROM asked LEFT JOIN (SELECT query_id, rank, concat(E'\\nQTL Entry #', rank, ' (Relevance Score: ',
   coalesce({S.fixed('1 - (1 - sim)', 3)}, 'nan'), E')\\n', repeat('-', 40), E'\\n', content, E'\\n\\n', repeat('-', 40)) AS entry
  FROM hits JOIN docs ON id = chunk_id) USING (query_id) GROUP BY ALL)""",
    )


def _chunk_collection(spark, folder) -> DataFrame:
    chunks = chunkers.chunk_by_chromosome(peaks(spark, folder), include_raw=False)
    root = new_path(spark, "collections")
    return create_collection(chunks, [F.col("id")], root, "chunks")


@query(
    "context_from_documents",
    S.with_(*_collection_context(2), body="SELECT query_id, question, context FROM contexts"),
)
def _(spark, folder):
    ask = asked(questions(spark, folder))
    found = search.collection_query(_chunk_collection(spark, folder), embed.embed_queries(ask), 2)
    return context_from_documents(ask, found)


def filled(template: str) -> str:
    """SQL text of a prompt template."""
    quoted = "'" + template.replace("'", "''") + "'"
    return (
        "concat("
        + quoted.replace("{question}", "', question, '").replace("{context}", "', context, '")
        + ")"
    )


@query(
    "prompt_short",
    S.with_(
        *_collection_context(2),
        body=f"SELECT query_id, {filled(prompts.SHORT_TEMPLATE)} AS prompt FROM contexts",
    ),
)
def _(spark, folder):
    prompted = query_and_prompt(_chunk_collection(spark, folder), questions(spark, folder))
    return prompted.select("query_id", "prompt")


@query(
    "prompt_long",
    S.with_(
        *_collection_context(3),
        body=f"SELECT query_id, {filled(prompts.LONG_TEMPLATE)} AS prompt FROM contexts",
    ),
)
def _(spark, folder):
    prompted = query_and_prompt(
        _chunk_collection(spark, folder), questions(spark, folder), n_results=3, long=True
    )
    return prompted.select("query_id", "prompt")


def _request(system: str, user: str, temperature: float) -> str:
    quoted = "'" + system.replace("'", "''") + "'"
    return f"""CAST(to_json([{{'role': 'system', 'content': {quoted}}},
 {{'role': 'user', 'content': {filled(user)}}}]) AS VARCHAR) AS messages,
 CAST({temperature} AS DOUBLE) AS temperature, CAST(1000 AS BIGINT) AS max_tokens"""


_RETRIEVAL_REQUEST = _request(prompts.RETRIEVAL_SYSTEM, prompts.RETRIEVAL_USER, 0.3)


@query(
    "retrieve_and_prompt",
    S.with_(
        *_retrieved(3),
        _CHUNK_CONTEXT,
        body=f"SELECT query_id, question, context, {_RETRIEVAL_REQUEST} FROM contexts",
    ),
)
def _(spark, folder):
    return retrieve_and_prompt(_corpus(spark, folder), questions(spark, folder))


_DATA_CONTEXT = (
    f"chosen AS (SELECT *, {S.CONTEXT_LINE} AS text FROM peaks)",
    """picks AS (
 SELECT 'top' AS selection, '' AS selected_group, 0 AS source, row_id, text, rank FROM
  (SELECT *, row_number() OVER (ORDER BY qtl_lod DESC, row_id) AS rank FROM chosen WHERE qtl_lod IS NOT NULL) WHERE rank <= 20
 UNION ALL SELECT 'group', qtl_chr, 0, row_id, text, row_number() OVER (PARTITION BY qtl_chr ORDER BY row_id) FROM chosen
  QUALIFY row_number() OVER (PARTITION BY qtl_chr ORDER BY row_id) <= 50
 UNION ALL SELECT 'pvalue', '', 0, row_id, text, row_number() OVER (ORDER BY qtl_pval, row_id) FROM chosen
  QUALIFY row_number() OVER (ORDER BY qtl_pval, row_id) <= 20
 UNION ALL SELECT 'mixed', '', 0, row_id, text, rank FROM
  (SELECT *, row_number() OVER (ORDER BY qtl_lod DESC, row_id) AS rank FROM chosen WHERE qtl_lod IS NOT NULL) WHERE rank <= 10
 UNION ALL SELECT 'mixed', '', 1, row_id, text, row_number() OVER (ORDER BY row_id) FROM chosen,
  (SELECT greatest(count(*) // 10, 1) AS stride FROM peaks) WHERE row_id % stride = 0 AND row_id < 10 * stride)""",
    """shown AS (SELECT selection, selected_group, string_agg(concat(n, '. ', text, E'\\n'), '' ORDER BY n) AS body FROM
 (SELECT *, row_number() OVER (PARTITION BY selection, selected_group ORDER BY source, rank) AS n FROM picks)
 WHERE n <= 15 GROUP BY ALL)""",
    f"""overview AS (SELECT concat('Dataset summary: ', count(*), E' total records\\n\\nStatistical overview:\\n- Average LOD score: ',
 {S.fixed('avg(qtl_lod)', 2)}, E'\\n- Maximum LOD score: ', {S.fixed('max(qtl_lod)', 2)}, E'\\n- Total chromosomes: ',
 count(DISTINCT qtl_chr), E'\\n\\nSample of relevant records:\\n') AS header FROM peaks)""",
    f"""routed AS (SELECT query_id, question, {_SELECTION} AS selection,
 CASE WHEN {_SELECTION} = 'group' THEN coalesce({_GROUP_TOKEN}, '') ELSE '' END AS selected_group FROM questions)""",
    """contexts AS (SELECT query_id, question, selection, selected_group, concat((SELECT header FROM overview),
 coalesce(body, '')) AS context FROM routed LEFT JOIN shown USING (selection, selected_group))""",
)


@query(
    "data_context",
    S.with_(S.PEAKS_CTE, S.QUESTIONS_CTE, *_DATA_CONTEXT, body="SELECT * FROM contexts"),
)
def _(spark, folder):
    return data_context(peaks(spark, folder), questions(spark, folder))


@query(
    "chat_messages",
    S.with_(
        S.PEAKS_CTE,
        S.QUESTIONS_CTE,
        *_DATA_CONTEXT,
        body=f"SELECT query_id, {_request(prompts.DATA_SYSTEM, prompts.DATA_USER, 0.7)} FROM contexts",
    ),
)
def _(spark, folder):
    contexts = data_context(peaks(spark, folder), questions(spark, folder))
    return prompts.data_messages(contexts).select(
        "query_id", "messages", "temperature", "max_tokens"
    )


def _shown(limit: str) -> str:
    return f"regexp_replace({S.text_of(limit)}, '\\.0$', '')"


_ANSWERS = (
    S.PEAKS_CTE,
    S.QUESTIONS_CTE,
    f"""routed AS (SELECT query_id, {_INTENT} AS intent, nullif({_FIRST_INTEGER}, 0) AS number,
 nullif({_SCORE_LIMIT}, 0) AS score_limit, nullif({_PVALUE_LIMIT}, 0) AS pvalue_limit FROM questions)""",
    "wanted AS (SELECT query_id, coalesce(number, 5) AS n FROM routed WHERE intent = 'top')",
    f"""top AS (SELECT row_number() OVER (ORDER BY qtl_lod DESC, row_id) AS rank, {S.RANKED_LINE} AS line
 FROM peaks WHERE qtl_lod <> 0)""",
    """asked AS (SELECT query_id, CAST(number AS VARCHAR) AS chr, score_limit AS lim FROM routed
 WHERE intent = 'group' AND number IS NOT NULL)""",
    "params AS (SELECT DISTINCT chr, lim FROM asked)",
    f"""matched AS (SELECT chr, lim, row_number() OVER (PARTITION BY chr, lim ORDER BY row_id) AS n,
 count(*) OVER (PARTITION BY chr, lim) AS total, {S.GROUP_LINE} AS line
 FROM params JOIN peaks ON qtl_chr = chr AND (lim IS NULL OR qtl_lod > lim))""",
    """grouped AS (SELECT query_id, chr, a.lim, coalesce(total, 0) AS total FROM asked a
 LEFT JOIN matched m ON m.chr = a.chr AND m.lim IS NOT DISTINCT FROM a.lim AND n = 1)""".replace("query_id, chr", "query_id, a.chr"),
    "pasked AS (SELECT query_id, coalesce(pvalue_limit, 0.001) AS lim FROM routed WHERE intent = 'pvalue')",
    f"""pmatched AS (SELECT lim, row_number() OVER (PARTITION BY lim ORDER BY row_id) AS n,
 count(*) OVER (PARTITION BY lim) AS total, {S.PVALUE_LINE} AS line
 FROM (SELECT DISTINCT lim FROM pasked) JOIN peaks ON qtl_pval <> 0 AND qtl_pval < lim)""",
    """pgrouped AS (SELECT query_id, p.lim, coalesce(total, 0) AS total FROM pasked p
 LEFT JOIN pmatched m ON m.lim = p.lim AND n = 1)""",
    f"""shared AS (
 SELECT 'entities' AS intent, n AS line_no, line FROM (SELECT row_number() OVER (ORDER BY min(row_id)) AS n,
  concat('• ', gene_symbol) AS line FROM peaks WHERE gene_symbol <> '' GROUP BY gene_symbol) WHERE n <= 15
 UNION ALL SELECT 'entities', 0, concat('Your dataset contains ', count(DISTINCT nullif(gene_symbol, '')),
  E' unique genes. Here are some examples:\\n') FROM peaks
 UNION ALL SELECT 'compare', 0, E'QTL distribution across chromosomes:\\n'
 UNION ALL SELECT 'compare', n, line FROM (SELECT row_number() OVER (ORDER BY count(*) DESC,
  TRY_CAST(qtl_chr AS BIGINT) NULLS LAST) AS n, concat('• Chromosome ', qtl_chr, ': ', count(*), ' QTLs') AS line
  FROM peaks GROUP BY qtl_chr) WHERE n <= 10
 UNION ALL SELECT 'summary', unnest([0, 1, 2, 3, 4, 5]), unnest([E'📊 Dataset Summary:\\n',
  concat('• Total QTL records: ', count(*)),
  concat('• Average LOD score: ', {S.fixed('avg(coalesce(qtl_lod, 0))', 2)}),
  concat('• Maximum LOD score: ', {S.fixed('max(coalesce(qtl_lod, 0))', 2)}),
  concat('• Chromosomes covered: ', count(DISTINCT qtl_chr)),
  concat('• Unique genes: ', count(DISTINCT nullif(gene_symbol, '')))]) FROM peaks
 UNION ALL SELECT 'help', 0, concat(E'I can help you analyze your genetic scan data! Try asking about:\\n\\n',
  E'• Top QTLs with highest LOD scores\\n• QTLs on specific chromosomes\\n• Genes with significant p-values\\n',
  E'• Summary statistics of your data\\n• Comparisons between chromosomes\\n\\n',
  'For example: ''What are the top 10 QTLs with highest LOD scores?'' or ''Show me significant genes with p-value < 0.001'''))""",
    f"""answers AS (
 SELECT query_id, 'top' AS intent, 0 AS line_no, concat('Here are the top ', n, E' QTLs with highest LOD scores:\\n') AS line FROM wanted
 UNION ALL SELECT query_id, 'top', rank, concat(rank, line) FROM wanted JOIN top ON rank <= n
 UNION ALL SELECT query_id, 'group', 0, concat('Found ', total, ' QTLs on chromosome ', chr,
  CASE WHEN lim IS NULL THEN '' ELSE concat(' with LOD > ', {_shown('lim')}) END, E':\\n') FROM grouped
 UNION ALL SELECT query_id, 'group', n, line FROM asked a JOIN matched m ON m.chr = a.chr AND m.lim IS NOT DISTINCT FROM a.lim AND n <= 10
 UNION ALL SELECT query_id, 'group', 11, concat(E'\\n... and ', total - 10, ' more results.') FROM grouped WHERE total > 10
 UNION ALL SELECT query_id, 'group', 0, '' FROM routed WHERE intent = 'group' AND number IS NULL
 UNION ALL SELECT query_id, 'pvalue', 0, concat('Found ', total, ' genes with p-values < ', {S.js_text_of('lim')}, E':\\n') FROM pgrouped
 UNION ALL SELECT query_id, 'pvalue', n, line FROM pasked JOIN pmatched USING (lim) WHERE n <= 10
 UNION ALL SELECT query_id, 'pvalue', 11, concat(E'\\n... and ', total - 10, ' more results.') FROM pgrouped WHERE total > 10
 UNION ALL SELECT query_id, intent, line_no, line FROM routed JOIN shared USING (intent))""",
)


@query("answer_by_rules", S.with_(*_ANSWERS, body="SELECT * FROM answers"))
def _(spark, folder):
    return answer_by_rules(peaks(spark, folder), questions(spark, folder))


@query(
    "answer_texts",
    S.with_(
        *_ANSWERS,
        body="""SELECT query_id, intent, CAST(1 AS BIGINT) AS part, concat(txt,
 CASE WHEN txt = '' OR intent = 'help' OR (intent IN ('group', 'pvalue') AND last = 11) THEN '' ELSE E'\\n' END) AS answer
 FROM (SELECT query_id, intent, string_agg(line, E'\\n' ORDER BY line_no) AS txt, max(line_no) AS last
  FROM answers GROUP BY 1, 2)""",
    ),
)
def _(spark, folder):
    return answer_texts(answer_by_rules(peaks(spark, folder), questions(spark, folder)))


@query(
    "answer_texts_parts",
    S.with_(
        *_ANSWERS,
        body="""SELECT query_id, intent, CAST(line_no // 4 + 1 AS BIGINT) AS part, concat(string_agg(line, E'\\n' ORDER BY line_no),
 CASE WHEN max(line) = '' OR intent = 'help' OR (intent IN ('group', 'pvalue') AND max(line_no) = 11) THEN '' ELSE E'\\n' END) AS answer
 FROM answers GROUP BY 1, 2, 3""",
    ),
)
def _(spark, folder):
    return answer_texts(answer_by_rules(peaks(spark, folder), questions(spark, folder)), 4)
