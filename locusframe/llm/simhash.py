"""SimHash near-duplicates found with keys from the binary Golay code.

Two 64-bit fingerprints that differ in at most three bits have a 32-bit half with at most
one differing bit, and what differs in the other half are the rest. A half is cut into 23 bits and
9 bits, the other half into three blocks:

- no bit of the half differs: the half is a key of its own;
- the bit differs among the 9: the 23 agree, at most two bits of the other half differ, and one of
  its three blocks agrees;
- the bit differs among the 23: the 9 agree, a block of the other half agrees, and so does a Golay
  key. The perfect Golay code has exactly one codeword within distance 3 of any 23-bit word; a
  neighbour of that word is within distance 4 of the same codeword. Every word therefore gives the
  indices of all codewords within distance 4 (one or six of them), and neighbours share one.

No link is lost. Every key has 31 bits or more, so a table of billions of fingerprints has few
chance meetings to a key; a fingerprint gives 14 to 44 keys. Rows that share a key are compared
exactly. A key shared by many fingerprints is cut into blocks whose pairs are compared in
separate tasks. A task reports the links of a cell as a star around the smallest member of
each connected part, never as all pairs.
"""

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusframe.llm.common import bounded_batches, identity, pieces_of, stored
from locusframe.llm.components import connected_components

SEED = 42
RADIUS = 3
# Fingerprints of one key that are compared in one task.
BLOCK = 4096
# Keys above BLOCK that may be broadcast: 100,000 rows of 16 bytes.
HOT_KEYS = 100_000

# Generator polynomial of the (23, 12) Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


# --- fingerprints ---------------------------------------------------------------------


def _hashes(text: str, words: int) -> Iterator[np.ndarray]:
    """Shingle hashes of a text in arrays of bounded size."""
    digest, seed = xxhash.xxh64_intdigest, SEED
    kept: list[bytes] = []
    found = False
    for part in pieces_of(text.encode().lower()):
        run = kept + part
        if len(run) >= words:
            found = True
            shingles = map(b" ".join, zip(*(run[i:] for i in range(words)))) if words > 1 else run
            yield np.fromiter((digest(s, seed) for s in shingles), np.uint64, len(run) - words + 1)
        kept = run[-(words - 1) :] if words > 1 else []
    if not found and kept:
        yield np.array([digest(b" ".join(kept), seed)], np.uint64)


def _majority(parts: Iterator[np.ndarray]) -> int:
    """The bits that over half of the hashes have set."""
    total, ones = 0, np.zeros(64, np.int64)
    for hashes in parts:
        for start in range(0, len(hashes), 1 << 15):
            part = hashes[start : start + (1 << 15)]
            rows = part[:, None].view(np.uint8)
            ones += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
            total += len(part)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, words: int = 3) -> int:
    """The SimHash of a text's shingles; zero without words."""
    return _majority(_hashes(text or "", words))


def fingerprints(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 3
) -> DataFrame:
    """One row `(id, text_hash, v0)` per document; `v0` is its fingerprint as a signed number."""
    kind = dict(docs.dtypes)[id_column]

    def run(batches):
        for batch in batches:
            values = np.array([fingerprint(text.as_py(), words) for text in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(values.view(np.int64))], names=["id", "text_hash", "v0"]
            )

    rows = bounded_batches(docs).select(
        *identity(docs, id_column, text_column), F.col(text_column).cast("string").alias("text")
    )
    return rows.mapInArrow(run, f"id {kind}, text_hash bigint, v0 bigint")


# --- Golay keys -----------------------------------------------------------------------


def _remainder(word: int) -> int:
    for shift in range(11, -1, -1):
        if word >> (shift + 11) & 1:
            word ^= GENERATOR << shift
    return word


@lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the bits, and for each syndrome the error patterns of weight 4 at most.

    The patterns fill a (2048, 6) array, with the number of valid ones beside it.
    """
    bits = np.array([_remainder(1 << i) for i in range(23)], np.int64)
    patterns = np.zeros((2048, 6), np.int64)
    sizes = np.zeros(2048, np.int64)
    for places in chain.from_iterable(combinations(range(23), n) for n in range(5)):
        syndrome = int(np.bitwise_xor.reduce(bits[list(places)])) if places else 0
        patterns[syndrome, sizes[syndrome]] = sum(1 << p for p in places)
        sizes[syndrome] += 1
    return bits, patterns, sizes


def _syndromes(words: np.ndarray) -> np.ndarray:
    bits, _, _ = golay_tables()
    out = np.zeros(len(words), np.int64)
    for i in range(23):
        out ^= np.where(words >> i & 1, bits[i], 0)
    return out


# The blocks of a half: where they begin and how many bits they have.
_BLOCKS = [(0, 11), (11, 11), (22, 10)]


def keys_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of 64-bit fingerprints, and for each key the index of its fingerprint."""
    _, patterns, sizes = golay_tables()
    index = np.arange(len(values))
    halves = [(values.view(np.uint64) >> np.uint64(32 * half)).astype(np.int64) & 0xFFFFFFFF for half in range(2)]
    keys, owners = [], []
    for half, (part, other) in enumerate([halves, halves[::-1]]):
        long, short = part & 0x7FFFFF, part >> 23
        syndromes = _syndromes(long)
        codewords = [(index, long, 1)]
        for k in range(6):
            own = np.flatnonzero(sizes[syndromes] > k)
            # The high 12 bits of a codeword tell it from all others.
            index_bits = (long[own] ^ patterns[syndromes[own], k]) >> 11
            codewords.append((own, index_bits << 9 | short[own], 2))
        keys.append(half << 44 | part)
        owners.append(index)
        for block, (begin, bits) in enumerate(_BLOCKS):
            agreed = other >> begin & (1 << bits) - 1
            for own, known, kind in codewords:
                # Marks keep the kinds of keys apart, those of 23 and of 21 bits too.
                keys.append((half << 4 | block << 2 | kind) << 40 | known << 11 | agreed[own])
                owners.append(own)
    return np.concatenate(keys), np.concatenate(owners)


def _keyed(unique: DataFrame) -> DataFrame:
    """Rows `(key, node, v0)` for every key of the fingerprints `v0`."""

    def run(batches):
        for batch in batches:
            nodes, values = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for at in range(0, len(values), 2000):
                keys, owners = keys_of(values[at : at + 2000])
                columns = (keys, nodes[at : at + 2000][owners], values[at : at + 2000][owners])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "node", "v0"])

    return unique.select("node", "v0").mapInArrow(run, "key bigint, node bigint, v0 bigint")


# --- links ----------------------------------------------------------------------------


def _join_labels(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Give every connected part its smallest index, given links between indices."""
    while len(left):
        least = np.minimum(labels[left], labels[right])
        before = labels.copy()
        np.minimum.at(labels, labels[left], least)
        np.minimum.at(labels, labels[right], least)
        labels = labels[labels]
        if (labels == before).all():
            break
    return labels


def _near(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Whether rows of fingerprint words differ in at most `radius` bits."""
    # The bits of a negative number would be counted without its sign.
    left, right = left.view(np.uint64), right.view(np.uint64)
    bits = np.bitwise_count(left[..., 0] ^ right[..., 0]).astype(np.uint16)
    for k in range(1, left.shape[-1]):
        bits += np.bitwise_count(left[..., k] ^ right[..., k])
    return bits <= radius


def _stars(cells: np.ndarray, nodes: np.ndarray, values: np.ndarray, radius: int):
    """Links inside each cell (equal neighbours in `cells`), as stars of nodes."""
    n = len(nodes)
    labels = np.arange(n)
    starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]) if n else np.zeros(0, int)
    sizes = np.diff(np.r_[starts, n])
    small = np.repeat(sizes, sizes) <= 64
    lefts, rights = [], []
    for shift in range(1, int(min(sizes.max(initial=1), 64))):
        left = np.flatnonzero(small[:-shift] & (cells[:-shift] == cells[shift:]))
        near = _near(values[left], values[left + shift], radius)
        lefts.append(left[near])
        rights.append(left[near] + shift)
    if lefts:
        labels = _join_labels(labels, np.concatenate(lefts), np.concatenate(rights))
    for start, size in zip(starts[sizes > 64], sizes[sizes > 64]):
        part = values[start : start + size]
        own = np.arange(size)
        for row in range(0, size, 256):
            left, right = np.nonzero(_near(part[row : row + 256, None], part[None], radius))
            own = _join_labels(own, left + row, right)
        labels[start : start + size] = own + start
    linked = np.flatnonzero(labels != np.arange(n))
    return nodes[linked], nodes[labels[linked]]


def _linked_rows(cells: DataFrame, radius: int) -> DataFrame:
    """Star links of cells `(key, i, j, node, words...)` that lie together in a partition."""

    def run(batches):
        kept = None
        for batch in chain(batches, [None]):
            if batch is not None:
                now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                rows = now if kept is None else [np.concatenate(p) for p in zip(kept, now)]
                if not len(rows[0]):
                    continue
                last = np.logical_and.reduce([c == c[-1] for c in rows[:3]])
                kept = [c[last] for c in rows]
                done = [c[~last] for c in rows]
            elif kept is None:
                return
            else:
                done = kept
            if not len(done[0]):
                continue
            keys = np.stack(done[:3], axis=1)
            ids = np.cumsum(np.r_[0, (keys[1:] != keys[:-1]).any(axis=1)])
            a, b = _stars(ids, done[3], np.stack(done[4:], axis=1), radius)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return cells.mapInArrow(run, "a bigint, b bigint")


def links(
    unique: DataFrame,
    radius: int,
    block: int = BLOCK,
) -> DataFrame:
    """Links `(a, b)` of nodes whose fingerprints `v0` share a key and differ in at most `radius` bits.

    They connect exactly what all such pairs connect. `unique` has one row per `node`.
    """
    keyed = _keyed(unique)
    hot = stored(
        keyed.groupBy("key")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > block)
        .select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")),
        "hot-keys",
    )
    many = hot.count()
    if many:
        side = F.broadcast(hot) if many <= HOT_KEYS else hot
        keyed = keyed.join(side, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        keyed = keyed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        keyed = keyed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        i, j = F.least("own", "other"), F.greatest("own", "other")
    else:
        i = j = F.lit(0)
    cells = keyed.select("key", i.alias("i"), j.alias("j"), "node", "v0")
    together = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    return _linked_rows(together, radius).distinct()


def _classes(rows: DataFrame, unique: DataFrame, found: DataFrame) -> DataFrame:
    """`rows` with the `component` of their fingerprint `v0`: its smallest document."""
    parts = connected_components(found).withColumnRenamed("node", "part")
    named = unique.join(parts, unique["node"] == parts["part"], "left").select(
        "node", "v0", "least", F.coalesce("root", "node").alias("root")
    )
    named = stored(named, "named-fingerprints")
    smallest = named.groupBy("root").agg(F.min("least").alias("component"))
    classes = named.join(smallest, "root").select("v0", "component")
    return rows.join(classes, "v0")


def _grouped(rows: DataFrame) -> DataFrame:
    """One row per different fingerprint, with its smallest document."""
    place = F.struct(F.col("id").isNull().alias("unknown"), "id", "text_hash")
    return rows.groupBy("v0").agg(F.min(place).alias("least")).withColumn("node", F.col("v0"))


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    words: int = 3,
    radius: int = RADIUS,
    block: int = BLOCK,
) -> DataFrame:
    """One row `(id, text_hash, fp, component_id, component)` per document.

    `component_id` is the smallest id that is reachable over fingerprints at most `radius`
    bits apart, and `component` the document of this id. Texts without words, NULL ones included, have fingerprint
    zero and are linked like any other; fewer words than a shingle has count as one shingle. A NULL id is kept,
    and names no component unless all its ids are NULL. Repeated rows stay. Integer ids are compared as
    numbers, others as texts.
    """
    if radius > RADIUS:
        raise ValueError("the keys find all pairs that differ in three bits at most")
    rows = stored(fingerprints(docs, id_column, text_column, words), "fingerprints")
    unique = stored(_grouped(rows), "unique-fingerprints")
    found = links(unique, radius, block)
    return _classes(rows, unique, found).select(
        "id", "text_hash", F.col("v0").alias("fp"), F.col("component")["id"].alias("component_id"), "component"
    )


def first_of_each(docs: DataFrame, classes: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of `docs` that are the first document of their component, once each."""
    first = classes.select(F.col("component")["id"].alias("_id"), F.col("component")["text_hash"].alias("_hash")).distinct()
    names = docs.columns
    own_id, own_hash = identity(docs, id_column, text_column)
    row = F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row")
    keyed = docs.select(row, own_id.alias("_own"), own_hash.alias("_own_hash"))
    same = F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_own_hash") == F.col("_hash"))
    kept = keyed.join(first, same, "left_semi")
    alike = Window.partitionBy("_own", "_own_hash").orderBy(F.lit(1))
    once = kept.withColumn("_n", F.row_number().over(alike))
    return once.where("_n = 1").select(*(F.col("_row").getField(c).alias(c) for c in names))
