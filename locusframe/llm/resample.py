"""Importance resampling towards a target distribution of hashed word runs.

The features of a text are its runs of one to three words, and a feature's bucket is the CRC-32
of its bytes. The gain of a bucket compares how often the target and the corpus fall into it; the
weight of a document is the sum of the gains of its features, and adding a Gumbel number that
depends on the document id alone turns "the highest scores" into a draw without replacement.

Hashes are taken for a batch of texts at once: words become numbers, runs become numbers of
numbers, and only different runs are hashed. Their bytes are grouped by length into matrices of
one byte a cell, a CRC column goes over the columns of a matrix, and the buckets are scattered
back to the occurrences.

The corpus is read twice, once for the counts of the buckets (a few rows per task are
shuffled) and once for the weights; texts and features are never shuffled.
"""

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import bounded_batches, stored, write_table
from locusframe.storage import number_written_rows

RUN_WORDS = 3
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 5
SEED = 42
# Bytes hashed together, and the matrix cells made at once.
PIECE_BYTES, MATRIX_BYTES = 2 << 20, 4 << 20
# Longer runs are few and have no columns in common worth going over.
LONG = 512
# The reflected polynomial of CRC-32.
_POLYNOMIAL = 0xEDB88320


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype="u4")
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1)
    return table


def _byte_classes() -> tuple[np.ndarray, np.ndarray]:
    """Every byte with A-Z in lower case, and whether it belongs to a word."""
    lower = np.arange(256, dtype="u1")
    lower[0x41:0x5B] += 0x20
    word = np.zeros(256, bool)
    word[0x30:0x3A] = word[0x61:0x7B] = word[0x80:] = True
    return lower, word


_CRC = _crc_table()
_LOWER, _WORD = _byte_classes()
_WORD_BYTES = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_BREAK = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


# --- features -------------------------------------------------------------------------


def crc_of_slices(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRC-32 of every slice of `data`, slices of one length in one matrix."""
    out = np.zeros(len(starts), "u4")
    order = np.argsort(lengths, kind="stable")
    sizes, firsts = np.unique(lengths[order], return_index=True)
    for size, group in zip(sizes.tolist(), np.split(order, firsts[1:])):
        if size > LONG:
            for i in group.tolist():
                out[i] = zlib.crc32(data[starts[i] : starts[i] + size])
            continue
        step = max(1, MATRIX_BYTES // max(size, 1))
        for at in range(0, len(group), step):
            rows = group[at : at + step]
            # Transposed, so that a column of the texts is one run of memory.
            matrix = data[starts[rows][None, :] + np.arange(size)[:, None]]
            crc = np.full(len(rows), 0xFFFFFFFF, "u4")
            for column in matrix:
                crc = _CRC[(crc ^ column) & 0xFF] ^ (crc >> 8)
            out[rows] = ~crc
    return out


def _numbers(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense numbers of equal codes, and where each number occurs first."""
    numbers, different = pd.factorize(codes)
    first = np.empty(len(different), np.int64)
    first[numbers[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return numbers, first


def _pieces(data: bytes) -> Iterator[tuple[bytes, int]]:
    """A text in parts, each with the bytes in which its own runs begin.

    A part goes on for the words that its last runs need; a word is never cut.
    """
    start = 0
    while len(data) - start > PIECE_BYTES:
        found = _BREAK.search(data, start + PIECE_BYTES)
        if not found:
            break
        stop = end = found.start()
        for _ in range(RUN_WORDS - 1):
            word = _WORD_BYTES.search(data, end)
            end = word.end() if word else len(data)
        yield data[start:end], stop - start
        start = stop
    yield (data[start:] if start else data), len(data) - start


def features(texts: list[tuple[int, bytes, int]], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pieces `(document, bytes, own bytes)`: `(documents, buckets)` of all features, `documents` of all words.

    A word belongs to the piece in whose own bytes it begins, and so do the runs that it begins.
    """
    joined = np.frombuffer(b"\n".join([t for _, t, _ in texts]) + b"\n", "u1")
    sizes = np.array([len(t) + 1 for _, t, _ in texts], np.int64)
    offsets = np.cumsum(sizes) - sizes
    data = _LOWER[joined]
    inside = _WORD[data]
    edges = np.flatnonzero(np.diff(inside.astype("i1"), prepend=0))
    begins, ends = edges[::2], edges[1::2]
    if not len(begins):
        none = np.zeros(0, np.int64)
        return none, none, none
    # One space after each word, and nothing else between words.
    data[ends] = 0x20
    keep = inside.copy()
    keep[ends] = True
    compact = data[keep]
    lengths = ends - begins
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    piece = np.searchsorted(offsets, begins, side="right") - 1
    own = begins - offsets[piece] < np.array([n for _, _, n in texts], np.int64)[piece]
    document = np.array([d for d, _, _ in texts], np.int64)[piece]

    stops = starts + lengths
    words = pa.Array.from_buffers(
        pa.binary(), len(starts),
        [None, pa.py_buffer(np.append(starts, len(compact)).astype("i4")), pa.py_buffer(compact)],
    )
    numbers = words.dictionary_encode().indices.to_numpy()
    first = np.empty(numbers.max() + 1, np.int64)
    first[numbers[::-1]] = np.arange(len(numbers) - 1, -1, -1)
    width = len(first)
    documents, found = [], []
    run, at, codes = 1, np.arange(len(starts)), numbers.astype(np.int64)
    single = codes
    while True:
        crc = crc_of_slices(compact, starts[at[first]], stops[at[first] + run - 1] - starts[at[first]])
        mine = own[at]
        found.append((crc % np.uint32(buckets)).astype(np.int64)[codes[mine]])
        documents.append(document[at[mine]])
        if run == RUN_WORDS:
            break
        # Runs of one word more: the number of the run and the number of the next word.
        more = np.flatnonzero(at + run < len(starts))
        more = more[piece[np.minimum(at[more] + run, len(piece) - 1)] == piece[at[more]]]
        at, codes = at[more], codes[more]
        codes, first = _numbers(codes * width + single[at + run])
        codes = codes.astype(np.int64)
        run += 1
    return np.concatenate(documents), np.concatenate(found), document[own]


def _batches(texts: Iterator[str | None]) -> Iterator[list[tuple[int, bytes, int]]]:
    """Texts, numbered, in lists of pieces of bounded size."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for data, own in _pieces((text or "").encode("utf-8", "replace")):
            held.append((i, data, own))
            size += len(data)
            if size >= PIECE_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


# --- the operator ---------------------------------------------------------------------


def bucket_counts(texts: DataFrame, text_column: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """`(bucket, n)` for every bucket that features of the texts fall into."""

    def run(batches):
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for pieces in _batches(t.as_py() for t in batch.column(0)):
                _, found, _ = features(pieces, buckets)
                counts += np.bincount(found, minlength=buckets)
        filled = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array(counts[filled])], names=["bucket", "n"])

    rows = bounded_batches(texts).select(F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, text_column: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """`(bucket, gain)`: a thousandth of the log ratio of target and corpus, with one added to each count."""
    s = stored(bucket_counts(corpus, text_column, buckets), "corpus-counts").withColumnRenamed("n", "s")
    t = stored(bucket_counts(target, text_column, buckets), "target-counts").withColumnRenamed("n", "t")
    totals = s.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s")).first()[0], t.agg(
        F.coalesce(F.sum("t"), F.lit(0))
    ).first()[0]
    all_s, all_t = (F.lit(float(total + buckets)) for total in totals)
    of = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("double") + 1
    ratio = (of("t") * all_s) / (of("s") * all_t)
    rows = corpus.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    rows = rows.join(s, "bucket", "left").join(t, "bucket", "left")
    return rows.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def weighted(
    docs: DataFrame,
    gain_table: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    buckets: int = BUCKETS,
) -> DataFrame:
    """`(id, n_words, n_features, weight)` per row; the weight is the sum of the gains of its features."""
    kind = dict(docs.dtypes)[id_column]
    # One number per bucket: its size is fixed by `buckets`.
    table = np.zeros(buckets, np.int64)
    for row in gain_table.collect():
        table[row["bucket"]] = row["gain"]
    names = ["id", "n_words", "n_features", "weight"]

    def run(batches):
        for batch in batches:
            sums = np.zeros((3, batch.num_rows), np.int64)
            for pieces in _batches(t.as_py() for t in batch.column(1)):
                low = pieces[0][0]
                rows = pieces[-1][0] + 1 - low
                documents, found, words = features(pieces, buckets)
                added = np.zeros(rows, np.int64)
                np.add.at(added, documents - low, table[found])
                sums[0, low : low + rows] += np.bincount(words - low, minlength=rows)
                sums[1, low : low + rows] += np.bincount(documents - low, minlength=rows)
                sums[2, low : low + rows] += added
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sums)], names=names)

    rows = bounded_batches(docs).select(
        F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")
    )
    return rows.mapInArrow(run, f"id {kind}, n_words bigint, n_features bigint, weight bigint")


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    target_text: str = "text",
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Draw `percent` of the documents with at least `min_words` words, by importance.

    `(id, n_words, n_features, weight, score, rank)` for every row of `docs`. Ranks count from 1
    in descending order of the score, ties to the smaller id (NULL is the smallest), and are NULL
    for documents that are not drawn. NULL and empty texts have no features and the weight 0.
    Rows that repeat an id or a text are documents of their own. With an empty target every gain
    is that of a target of no features. Other columns are not read.
    """
    target = target.select(F.col(target_text).alias("text"))
    corpus = docs.select(F.col(text_column).alias("text"))
    gain_table = gains(corpus, target, "text", buckets)
    rows = weighted(docs, gain_table, id_column, text_column, buckets)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = stored(rows.withColumn("score", F.col("weight") + noise), "scores")
    eligible = F.col("n_words") >= min_words
    drawn = percent * scored.where(eligible).count() // 100
    # Narrow rows are sorted over the cluster and numbered by the row counts of their files.
    order = [F.desc(eligible), F.desc("score"), F.asc_nulls_first("id"), "weight", "n_features"]
    path = write_table(scored.orderBy(*order), "ranked")
    numbered = number_written_rows(docs.sparkSession, path, "rank")
    rank = F.when(F.col("rank") < drawn, F.col("rank") + 1).cast("bigint")
    return numbered.select("id", "n_words", "n_features", "weight", "score", rank.alias("rank"))
