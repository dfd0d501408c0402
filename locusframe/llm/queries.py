"""Registered queries of the operators, each over its whole table."""

from pyspark.sql import functions as F

from locusframe.llm import (
    decontaminate,
    html_text,
    license_scan,
    line_dedup,
    packing,
    prefix_trie,
    quality_rules,
    resample,
    secret_scan,
    simhash,
    token_codes,
    url_filter,
    warc,
)
from locusframe.llm.common import table
from locusframe.llm.registry import CHECKS, QUERIES, query

__all__ = ["CHECKS", "QUERIES"]


@query("op1_simhash_near_dedup")
def op1(spark, folder):
    rows = simhash.near_duplicates(table(spark, folder, "documents"))
    return rows.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


@query("op6_quality_rules", sql="""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
again AS (SELECT doc_id, g FROM g GROUP BY ALL HAVING count(*) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 8)) AS p FROM g SEMI JOIN again USING (doc_id, g)) GROUP BY doc_id),
m AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words, len(regexp_extract_all(text, '\\p{Lu}{2,}')) AS n_capitals,
         len(list_filter(w[2:], lambda x, i: x = w[i])) AS n_stutter
  FROM d LEFT JOIN covered USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 10 * n_words
            OR 100 * n_capitals > 30 * n_words OR 100 * n_stutter > 20 * n_words
            OR word_chars < 2 * n_words OR word_chars > 12 * n_words) AS kept
FROM m
""")  # fmt: skip
def op6(spark, folder):
    judged = quality_rules.ledger(table(spark, folder, "documents"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select(
        "doc_id",
        *(F.col("measures")[c].alias(c) for c in names),
        (~quality_rules.passes(F.col("failed"), 1)).alias("base_failed"),
        quality_rules.passes(F.col("failed"), 2).alias("kept"),
    )


@query("op7_line_dedup")
def op7(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


@query("op9_packing")
def op9(spark, folder):
    pieces = packing.pack(table(spark, folder, "documents"))
    return pieces.select(
        F.col("id").alias("doc_id"),
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


@query("op10_warc", sql="""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS digest FROM p),
g AS (SELECT digest, n, max(page_id) AS last FROM d WHERE n >= 1000 GROUP BY ALL HAVING count(*) > 1)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM d LEFT JOIN g USING (digest, n)
""")  # fmt: skip
def op10(spark, folder):
    rows = warc.round_trip(spark, table(spark, folder, "pages"))
    return rows.select(
        F.col("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("type").alias("record_type"),
        "refers_to",
    )


@query("op5_secret_scan")
def op5(spark, folder):
    found = secret_scan.scan(table(spark, folder, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    text = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return found.select(
        F.col("id").alias("doc_id"),
        *(count(kind).alias(f"n_{kind}") for kind in secret_scan.BASE),
        F.sha2("base_text", 256).alias("base_sha256"),
        F.array_join(text, ",").alias("spans"),
    )


@query("op8_decontamination")
def op8(spark, folder):
    found = decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.withColumnRenamed("id", "doc_id").drop("text_hash")


@query("op2_html_text")
def op2(spark, folder):
    pages = table(spark, folder, "pages")
    found = html_text.extract(pages, html_text.fit(pages))
    return found.select(
        F.col("id").alias("page_id"), "url", "text", F.length("text").cast("bigint").alias("n_chars")
    )


URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


@query("op3_url_filter")
def op3(spark, folder):
    judged = url_filter.judge(table(spark, folder, "pages"), URL_RULES)
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "score")


@query("op4_license_scan")
def op4(spark, folder):
    found = license_scan.scan(table(spark, folder, "documents"))
    return found.withColumnRenamed("id", "doc_id")


@query("op11_token_codes")
def op11(spark, folder):
    rows = token_codes.round_trip(spark, table(spark, folder, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32", "middle_id")


@query("op12_prefix_trie", sql="""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(
           strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS family, xor(list_reduce(
           list_prepend(4294967295, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
                                                           lambda x: [CAST(ord(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
           lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = family AND pos < h
  UNION ALL
  SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos >= h),
p AS (
  SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS bytes,
         string_agg(md5(strlen(role) || ':' || role || text), '') OVER w AS path
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM c),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM p GROUP BY ALL),
k AS (SELECT left(path, 32 * (depth - 1)) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
s AS (
  SELECT left(path, 32 * up) AS path, sum(CAST(leaf AS BIGINT)) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT path, unnest(range(0, depth + 1)) AS up, n_children IS NULL AS leaf, (n_convs - 1) * bytes AS saved
        FROM n LEFT JOIN k USING (path)) GROUP BY 1),
e AS (
  SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256
  FROM (SELECT conv_id, arg_max(path, depth) AS path FROM p GROUP BY 1) GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, n.n_convs,
       coalesce(n_children, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM n JOIN s USING (path) LEFT JOIN k USING (path) LEFT JOIN e USING (path)
LEFT JOIN n AS q ON n.depth > 0 AND q.path = left(n.path, 32 * (n.depth - 1))
""")  # fmt: skip
def op12(spark, folder):
    turns = prefix_trie.conversation_turns(table(spark, folder, "conversations"))
    return prefix_trie.prefix_trie(prefix_trie.paths(prefix_trie.rebuilt(turns)))


@query("op13_resample", sql="""
WITH crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
                                                     lambda c, x: xor(c >> 1, 3988292384 * (c & 1)))) AS crc),
w AS (
  SELECT src, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT 's' AS src, doc_id AS id, coalesce(text, '') AS text FROM documents
        UNION ALL SELECT 't', item_id, coalesce(text, '') FROM benchmark)),
f AS (
  SELECT src, id, f, count(*) AS n FROM (
    SELECT src, id, unnest(list_concat(w,
      list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
      list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM w) GROUP BY ALL),
b AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(f) + 1),
                  lambda i: (position(substr(x, 2 * i - 1, 1) IN '0123456789ABCDEF') - 1) * 16
                       + position(substr(x, 2 * i, 1) IN '0123456789ABCDEF') - 1)),
                lambda c, y: xor(c >> 8, crc[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM f)), crc),
n AS (
  SELECT bucket, CAST(coalesce(sum(n) FILTER (src = 's'), 0) AS DOUBLE) AS s,
         CAST(coalesce(sum(n) FILTER (src = 't'), 0) AS DOUBLE) AS t FROM f JOIN b USING (f) GROUP BY bucket),
g AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM n) + 10000)
                                      / ((s + 1) * ((SELECT sum(t) FROM n) + 10000)))) AS BIGINT) AS gain FROM n),
d AS (
  SELECT id, sum(n) AS n_features, sum(n * gain) AS weight
  FROM f JOIN b USING (f) JOIN g USING (bucket) WHERE src = 's' GROUP BY id),
h AS (
  SELECT doc_id, len(w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features,
         CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         (SELECT sum((position(substr(x, i, 1) IN '0123456789abcdef') - 1) * 16 ** (8 - i))
          FROM range(1, 9) AS q(i)) AS h
  FROM (SELECT doc_id, sha256('42:' || doc_id) AS x FROM documents)
  JOIN w ON src = 's' AND w.id = doc_id LEFT JOIN d ON d.id = doc_id),
z AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM h)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_words >= 20 AND place <= (SELECT 5 * count(*) // 100 FROM z WHERE n_words >= 20) THEN place END AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place FROM z)
""")  # fmt: skip
def op13(spark, folder):
    drawn = resample.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return drawn.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")
