"""Packing of tokenized documents into windows by multiway Karmarkar-Karp differencing.

A document is its token ids and one end id. Whole windows are cut from its front; what is
left, in pieces of a quarter window, waits with the rests of other documents until they fill a block of
windows. A block is then split into near-equal windows: every piece starts as a partition with one used window,
and the two partitions with the largest imbalance are merged, the fullest window of one with
the emptiest of the other, until one partition is left. While a window exceeds its capacity,
the block is split again into more windows. The smallest pieces are merged beforehand, so a block
of many of them needs no more memory than any other.

Blocks are formed inside the partitions of the input, so texts are not shuffled and a lost
task is repeated alone. A partition leaves at most one block that is not full.
"""

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import bounded_batches

WINDOW = 1024
# Windows of a block; about one in so many windows is lost to padding.
BLOCK_WINDOWS = 256
END = 0
VOCABULARY = "byte_bpe_50k"

# Texts of these characters are encoded from the rank file of the vocabulary, which is
# several times faster; for them both libraries are tested to split words alike.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-ɏ‐-‧€]*")
_CUT = re.compile(r"(?<=[^\W_]) (?=[^\W_])")
PART_CHARS = 1 << 20


# --- tokens ---------------------------------------------------------------------------


@lru_cache(maxsize=2)
def _encoders(vocabulary: str, folder: str | None):
    """The two encoders of a vocabulary, loaded once per Python worker."""
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    place = (lambda name: f"{folder}/{name}") if folder else public_tokenizers.path
    slow = Tokenizer.from_file(str(place(f"{vocabulary}.json")))
    with open(place(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding(
        vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    return slow, fast


@lru_cache(maxsize=2)
def _added(vocabulary: str, folder: str | None) -> re.Pattern | None:
    """The literals of the added tokens, which only the tokenizer itself turns into one id."""
    slow, _ = _encoders(vocabulary, folder)
    literals = sorted((t.content for t in slow.get_added_tokens_decoder().values()), key=len, reverse=True)
    return re.compile("|".join(map(re.escape, literals))) if literals else None


def _parts(text: str, added: re.Pattern | None = None) -> Iterator[str]:
    """A long text in parts; no token spans a single space between two letters or digits.

    Nor is a text cut inside or beside a literal of `added`.
    """
    taken = [m.span() for m in added.finditer(text)] if added and len(text) > PART_CHARS else []
    start = at = 0
    while len(text) - start > PART_CHARS:
        found = _CUT.search(text, start + PART_CHARS)
        while found:
            while at < len(taken) and taken[at][1] < found.start():
                at += 1
            if at == len(taken) or found.end() < taken[at][0]:
                break
            found = _CUT.search(text, max(found.end(), taken[at][1] + 1))
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:] if start else text


def token_ids(text: str, vocabulary: str = VOCABULARY, folder: str | None = None) -> np.ndarray:
    """Ids of a text and the end id."""
    slow, fast = _encoders(vocabulary, folder)
    added = _added(vocabulary, folder)
    ids = []
    for part in _parts(text, added):
        if _PLAIN.fullmatch(part) and not (added and added.search(part)):
            found = fast.encode_ordinary(part)
        else:
            found = slow.encode(part, add_special_tokens=False).ids
        ids.append(np.array(found, "<u4"))
    return np.concatenate([*ids, np.array([END], "<u4")])


# --- differencing ---------------------------------------------------------------------


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Indices of `sizes` in `windows` groups of near-equal total."""
    if windows == 1:
        return [list(range(len(sizes)))]
    pairs: list[tuple[int, int]] = []  # group n + i holds the groups pairs[i]
    heap = []
    for i, size in enumerate(sizes):
        totals, groups = np.zeros(windows, np.int64), np.full(windows, -1, np.int64)
        totals[0], groups[0] = size, i
        heap.append((-size, i, totals, groups))
    heapq.heapify(heap)
    count = len(sizes)
    order = count
    while len(heap) > 1:
        _, _, totals, groups = heapq.heappop(heap)
        _, _, others, more = heapq.heappop(heap)
        # Both are sorted from full to empty; the second is turned round.
        totals, others, more = totals + others[::-1], others[::-1], more[::-1]
        both = np.flatnonzero((groups >= 0) & (more >= 0))
        merged = np.where(groups >= 0, groups, more)
        merged[both] = np.arange(len(both)) + count + len(pairs)
        pairs += zip(groups[both].tolist(), more[both].tolist())
        ranks = np.argsort(-totals, kind="stable")
        totals, merged = totals[ranks], merged[ranks]
        heapq.heappush(heap, (int(totals[-1] - totals[0]), order, totals, merged))
        order += 1
    out = []
    for group in heap[0][3].tolist() if heap else [-1] * windows:
        members, waiting = [], [group] if group >= 0 else []
        while waiting:
            now = waiting.pop()
            if now < count:
                members.append(now)
            else:
                waiting += pairs[now - count]
        out.append(sorted(members))
    return out


# A rest is cut into pieces of this part of a window, as two long ones might share no window.
PIECE = 1 / 4
# A bundle of small pieces has this part of a window at most.
BUNDLE = 32


def bundled(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices of `sizes` in bundles: the small ones together, so that bundles are few.

    Differencing holds two numbers per window for each part, and there may be as many pieces as tokens.
    """
    most = max(capacity // BUNDLE, 1)
    out, held, total = [], [], 0
    for i in sorted(range(len(sizes)), key=lambda i: (sizes[i], i)):
        if sizes[i] > most:
            out.append([i])
            continue
        if total + sizes[i] > most:
            out.append(held)
            held, total = [], 0
        held.append(i)
        total += sizes[i]
    return out + [held] if held else out


def fill(sizes: list[int], capacity: int = WINDOW) -> list[list[int]]:
    """Windows of pieces, given as indices of `sizes`, that hold `capacity` at most.

    The pieces are split into as few windows as could hold them; while one exceeds its capacity, into
    more: as many as what sticks out would fill, one at least.
    """
    if max(sizes, default=0) > capacity:
        raise ValueError("a piece is longer than a window")
    bundles = bundled(sizes, capacity)
    totals = [sum(sizes[i] for i in bundle) for bundle in bundles]
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        groups = difference(totals, windows)
        over = sum(max(0, sum(totals[i] for i in group) - capacity) for group in groups)
        if not over:
            break
        windows += -(-over // capacity)
    return [[i for bundle in group for i in bundles[bundle]] for group in groups if group]


# --- the operator ---------------------------------------------------------------------

SCHEMA = "id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    capacity: int = WINDOW,
    block_windows: int = BLOCK_WINDOWS,
    vocabulary: str = VOCABULARY,
    folder: str | None = None,
) -> DataFrame:
    """One row per piece of a document, with its place in a sequence.

    `ids` has the piece's ids as little-endian unsigned 32-bit numbers, `start` the ids of
    the document before it, `doc_tokens` all its ids with the end id. The pieces of a
    sequence lie at gapless `offset`s from 0 and have at most `capacity` ids in all. A NULL
    or empty text is the end id alone. Rows are packed one by one: NULL and repeated ids
    stay. `folder` names the vocabulary files; None takes the installed ones.
    """
    kind = dict(docs.dtypes)[id_column]
    piece = max(1, int(capacity * PIECE))

    def run(batches):
        sequence = TaskContext.get().partitionId() << 40
        waiting: list[tuple] = []
        held = 0
        names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

        def rows(out, id_type):
            columns = list(zip(*out))
            types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=names
            )

        def block():
            nonlocal sequence, waiting, held
            out = []
            for pieces in fill([len(ids) for _, _, ids, _ in waiting], capacity):
                offset = 0
                for i in pieces:
                    key, start, ids, total = waiting[i]
                    out.append((key, start, len(ids), ids.tobytes(), total, sequence, offset))
                    offset += len(ids)
                sequence += 1
            waiting, held = [], 0
            return out

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = token_ids(text.as_py() or "", vocabulary, folder)
                whole = len(ids) - len(ids) % capacity
                for start in range(0, whole, capacity):
                    part = ids[start : start + capacity].tobytes()
                    out.append((key, start, capacity, part, len(ids), sequence, 0))
                    sequence += 1
                for start in range(whole, len(ids), piece):
                    waiting.append((key, start, ids[start : start + piece], len(ids)))
                held += len(ids) - whole
                if held >= capacity * block_windows:
                    out += block()
                if len(out) > 2000:
                    yield rows(out, id_type)
                    out = []
            if out:
                yield rows(out, id_type)
        if waiting:
            yield rows(block(), id_type)

    rows = bounded_batches(docs).select(
        F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")
    )
    return rows.mapInArrow(run, SCHEMA.format(kind=kind))
