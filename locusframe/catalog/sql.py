"""Building blocks of the checking SQL (DuckDB dialect)."""

from locusframe.catalog.inputs import PEAKS, QUESTIONS


def with_(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


PEAKS_CTE = f"peaks AS ({PEAKS})"
QUESTIONS_CTE = f"questions AS ({QUESTIONS})"


def over_peaks(body: str, *ctes: str) -> str:
    return with_(PEAKS_CTE, *ctes, body=body)


def over_questions(body: str, *ctes: str) -> str:
    return with_(QUESTIONS_CTE, *ctes, body=body)


def text_of(number: str) -> str:
    """Python-style number text."""
    return f"CAST({number} AS VARCHAR)"


def js_text_of(x: str) -> str:
    """JavaScript-style number text for 1e-7 < |x| < 1e16, or in e-notation below that."""
    t = f"CAST({x} AS VARCHAR)"
    mantissa = f"replace(split_part({t}, 'e', 1), '.', '')"
    exponent = f"CAST(split_part({t}, 'e', 2) AS INT)"
    return (
        f"CASE WHEN {x} = 0 THEN '0'"
        f" WHEN abs({x}) >= 1e-4 THEN regexp_replace({t}, '\\.0$', '')"
        f" WHEN abs({x}) >= 1e-6 THEN '0.' || repeat('0', -{exponent} - 1) || {mantissa}"
        f" ELSE regexp_replace({t}, 'e-0', 'e-') END"
    )


def fixed(x: str, digits: int) -> str:
    return f"format('{{:.{digits}f}}', {x})"


def exponential(x: str) -> str:
    return f"regexp_replace(format('{{:.2e}}', {x}), 'e([+-])0([0-9])$', 'e\\1\\2')"


RECORD = f"""concat('Gene: ', coalesce(gene_symbol, 'nan'),
 ' | LOD Score: ', coalesce({text_of('qtl_lod')}, 'nan'),
 ' | P-value: ', coalesce({text_of('qtl_pval')}, 'nan'),
 ' | Location: Chromosome ', coalesce(qtl_chr, 'nan'),
 ', Position ', coalesce({text_of('qtl_pos')}, 'nan'), ' Mb',
 ' | Confidence Interval: ' || {fixed('qtl_ci_lo', 3)} || ' - ' || {fixed('qtl_ci_hi', 3)} || ' Mb',
 ' | Type: ' || CASE WHEN cis THEN 'cis-acting' ELSE 'trans-acting' END,
 ' | Gene Type: ' || gene_type)"""

NAME = "coalesce(nullif(gene_symbol, ''), gene_id)"

RANKED_LINE = f"""concat('. Gene: ', {NAME}, ' - LOD Score: ', coalesce({fixed('qtl_lod', 2)}, 'N/A'),
 ' (Chr ', qtl_chr, ', Position: ', {js_text_of('qtl_pos')}, ')')"""

GROUP_LINE = f"""concat('• ', {NAME}, ': LOD=', coalesce({fixed('qtl_lod', 2)}, 'N/A'), ', Position=',
 {js_text_of('qtl_pos')}, ', P-value=', {exponential('qtl_pval')})"""

PVALUE_LINE = f"""concat('• ', {NAME}, ': P-value=', {exponential('qtl_pval')}, ', LOD=',
 coalesce({fixed('qtl_lod', 2)}, 'N/A'), ' (Chr ', qtl_chr, ')')"""

CONTEXT_LINE = f"""concat('Gene: ', coalesce(nullif(gene_symbol, ''), 'N/A'),
 ' | LOD: ', coalesce({js_text_of('qtl_lod')}, 'null'), ' | P-val: ', {js_text_of('qtl_pval')},
 ' | Chr: ', qtl_chr, ' | Pos: ', {js_text_of('qtl_pos')}, ' | Cis: ', CAST(cis AS VARCHAR),
 ' | Type: ', coalesce(nullif(gene_type, ''), 'N/A'))"""

LINES_CTE = f"lines AS (SELECT *, {RECORD} AS line FROM peaks)"


def placed(order: str, size: str, by: str = "", where: str = "TRUE") -> str:
    """CTE `placed`: lines with position and block."""
    over = f"OVER ({'PARTITION BY ' + by if by else ''} ORDER BY {order})"
    return f"""placed0 AS (SELECT *, row_number() {over} - 1 AS position FROM lines WHERE {where}),
placed AS (SELECT *, CAST(position // ({size}) + 1 AS BIGINT) AS block FROM placed0)"""


def names(key: str, value: str, order: str, source: str = "placed", out: str = "names") -> str:
    """CTE with the distinct values of a group, in order of first appearance."""
    return f"""{out} AS (SELECT {key}, string_agg(v, ', ' ORDER BY o) AS {out} FROM
 (SELECT {key}, {value} AS v, min({order}) AS o FROM {source} WHERE {value} IS NOT NULL GROUP BY ALL)
 GROUP BY ALL)"""


def raw_ids(order: str) -> str:
    return f"string_agg(CAST(row_id AS VARCHAR), ' ' ORDER BY {order}) AS raw_ids"


CHROMOSOME_CHUNKS = (
    LINES_CTE,
    placed("qtl_pos NULLS LAST, row_id", "50", "qtl_chr"),
    names("qtl_chr, block", "gene_symbol", "position", out="genes"),
    f"""body AS (SELECT qtl_chr, block, string_agg(line, E'\\n\\n' ORDER BY position) AS txt,
 count(*) AS n, min(qtl_pos) AS lo, max(qtl_pos) AS hi, max(qtl_lod) AS max_lod, {raw_ids('position')}
 FROM placed GROUP BY ALL)""",
    f"""chunks AS (SELECT concat('chr_', qtl_chr, '_part_', block) AS id,
 concat('QTL findings on chromosome ', qtl_chr, ' (positions ', {fixed('lo', 2)}, '-', {fixed('hi', 2)},
  E' Mb):\\n\\n', txt) AS content, qtl_chr AS chromosome, n AS qtl_count, lo AS position_range_lo,
 hi AS position_range_hi, max_lod, coalesce(genes, '') AS genes, raw_ids
 FROM body LEFT JOIN genes USING (qtl_chr, block))""",
)


def vectors(source: str, key: str, text: str, prefix: str = "") -> str:
    """CTEs `{prefix}vec` (key, b, x) and `{prefix}norm` (key, n): hashed token vectors."""
    p = prefix
    return f"""{p}tok AS (SELECT {key} AS key, unnest(string_split_regex({text}, '[ \\t\\n\\r\\f]+')) AS t FROM {source}),
{p}hash AS (SELECT key, md5(t) AS h, count(*) AS c FROM {p}tok WHERE t <> '' GROUP BY ALL),
{p}cell AS (SELECT key, ('0x' || substr(h, 1, 8))::BIGINT % 256 AS b,
 CAST(sum(CASE WHEN substr(h, 9, 1) >= '8' THEN -c ELSE c END) AS BIGINT) AS v FROM {p}hash GROUP BY ALL),
{p}size AS (SELECT key, sqrt(CAST(sum(v * v) AS DOUBLE)) AS s FROM {p}cell GROUP BY ALL),
{p}vec AS (SELECT key, b, CAST(CAST(CAST(v AS DOUBLE) / s AS FLOAT) AS DOUBLE) AS x
 FROM {p}cell JOIN {p}size USING (key) WHERE s > 0 AND v <> 0),
{p}norm AS (SELECT key, sqrt(sum(x * x)) AS n FROM {p}vec GROUP BY ALL)"""


CHECKSUM = "round(coalesce(sum(x * (b + 1)), 0), 6)"


def hits(corpus: str, corpus_key: str, queries: str, query_key: str, k: int) -> str:
    """CTE `hits` (query_id, chunk_id, sim, rank) from the CTEs d* of the corpus and q* of the queries."""
    return f"""dots AS (SELECT q.key AS query_id, d.key AS chunk_id, sum(q.x * d.x) AS dot
 FROM qvec q JOIN dvec d ON q.b = d.b GROUP BY ALL),
scored AS (SELECT query_id, chunk_id, round(CASE WHEN qn.n IS NULL OR dn.n IS NULL THEN NULL
  ELSE coalesce(dot, 0) / (qn.n * dn.n) END, 9) + 0.0 AS sim
 FROM (SELECT {query_key} AS query_id FROM {queries}) CROSS JOIN (SELECT {corpus_key} AS chunk_id FROM {corpus})
 LEFT JOIN dots USING (query_id, chunk_id)
 LEFT JOIN qnorm qn ON qn.key = query_id LEFT JOIN dnorm dn ON dn.key = chunk_id),
hits AS (SELECT * FROM (SELECT *, row_number() OVER
  (PARTITION BY query_id ORDER BY sim DESC NULLS LAST, chunk_id) AS rank FROM scored) WHERE rank <= {k})"""
