"""What several operators share: words, bounded Arrow batches, stored tables."""

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.storage import bounded_batches, stored, write_table

__all__ = [
    "MOST_BITS", "SPACE", "HashFilter", "bounded_batches", "count_words", "hash_filter", "identity", "line_array",
    "pieces_of", "stored", "table", "word_array", "write_table",
]

# The characters that separate words, as a Java character class.
SPACE = r"[ \t\n\x0B\f\r]"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def word_array(text: Column) -> Column:
    """The words of a text; none for a NULL or blank one."""
    parts = F.split(F.coalesce(text, F.lit("")), f"{SPACE}+")
    return F.filter(parts, lambda word: word != "")


def count_words(text: Column) -> Column:
    return F.size(word_array(text))


def line_array(text: Column) -> Column:
    """The lines of a text, split at line feeds alone."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def identity(docs: DataFrame, id_column: str, text_column: str) -> list[Column]:
    """A document is its id and text: rows that repeat both are one document."""
    return [
        F.col(id_column).alias("id"),
        F.xxhash64(F.col(text_column).cast("string")).alias("text_hash"),
    ]


def pieces_of(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of `data` in lists of bounded size, so that a long text needs no list of all."""
    start = 0
    while start < len(data):
        stop = start + size
        if stop < len(data):
            while stop < len(data) and data[stop] not in b" \t\n\r\x0b\x0c":
                stop += 1
        words = data[start:stop].split()
        if words:
            yield words
        start = stop


# Bits of a filter per hash that it holds, and of the whole filter (32 MB) at most.
BITS_PER_HASH, LEAST_BITS, MOST_BITS = 256, 16, 28


class HashFilter:
    """A Bloom filter of 64-bit hashes with two bits each; its size is bounded, whatever it holds."""

    def __init__(self, bits: int):
        self.bits = bits
        self.words = np.zeros(1 << max(bits - 6, 0), np.uint64)

    def places(self, name: str) -> list[Column]:
        """The two bits of a hash, as Spark columns."""
        return [
            F.shiftrightunsigned(name, 64 - self.bits),
            F.shiftrightunsigned(F.shiftleft(name, self.bits), 64 - self.bits),
        ]

    def __contains__(self, value: int) -> bool:
        return bool(self.may_hold(np.array([value], np.uint64))[0])

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        high, low = np.uint64(64 - self.bits), np.uint64(self.bits)
        first = hashes >> high
        found = self.words[first >> np.uint64(6)] >> (first & np.uint64(63)) & np.uint64(1) != 0
        at = np.flatnonzero(found)
        second = (hashes[at] << low) >> high
        found[at] = self.words[second >> np.uint64(6)] >> (second & np.uint64(63)) & np.uint64(1) != 0
        return found


def hash_filter(hashes: DataFrame, most_bits: int = MOST_BITS) -> HashFilter:
    """The filter of all values of the one column of `hashes`, put together by Spark.

    It has 256 bits for each while they fit `most_bits`; beyond, it passes more of the others.
    """
    count, name = hashes.count(), hashes.columns[0]
    made = HashFilter(min(most_bits, max(LEAST_BITS, (count * BITS_PER_HASH).bit_length())))
    first, second = made.places(name)
    marks = hashes.select(first.alias("bit")).union(hashes.select(second.alias("bit")))
    words = marks.groupBy(F.shiftrightunsigned("bit", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("marks")
    )
    # At most one row per 64 bits.
    rows = words.toArrow()
    made.words[rows["word"].to_numpy()] = rows["marks"].to_numpy().view(np.uint64)
    return made
