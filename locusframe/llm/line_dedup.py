"""Line dedup by anchored windows: later repeated runs of words are deleted.

Line ends differ between copies, and a passage may begin and end inside a line, so windows of `min_words`
words are taken from every word on, wherever the text breaks. A word is an anchor if the hash of it and the
next word is small. The eight words from its first anchor on are the fingerprint of a window; they must lie
in it. Windows without such an anchor look for one of a more frequent kind, and are their own fingerprint in the end.
Equal windows choose the same anchor, so every run of `min_words` words that two places share is
guaranteed to share a fingerprint. Neighbouring windows of one anchor form a group.

Groups whose fingerprint occurs once are left behind. Of the others, groups of equal windows are
joined with their first place, in the order of document and position; all other places are
repeated as a whole. Where a fingerprint has groups that differ, a match ends inside them:
there the first places are extended word by word, one window for each word, and windows are
compared with their first place. The words of all repeated windows are deleted, so a match
reaches as far both ways as the words agree, into the lines around it.

Every step is an expression, aggregation, join or window function of Spark. Texts are split twice: for all groups, and
for the windows at the ends of matches. What is shuffled are groups, about one for ten words, and
single windows; never pairs, and texts only if the places asked for are too many to broadcast. A passage in a
third of all documents costs one row per place, and is extended at its first place only. The words of a
document are held at once by its task.
"""

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.llm.common import SPACE, stored

MIN_WORDS = 50
# Words under one hash.
GRAM = 8
# One word in so many is an anchor of the first and of the second kind.
ANCHORS = (20, 8)
# Anchors of a window that are looked at one by one.
NEAR = 6
# Bytes of the hash of one word in an array of bytes.
CODE = 16
# Bytes of text that `winnowed` hashes at once; a longer text is taken in parts.
PIECE_BYTES = 1 << 20
# Runs or places that are sent to the documents: up to so many bytes are broadcast.
BROADCAST_BYTES = 64 << 20
BLANKS = " \t\n\x0b\f\r"
DOC = ["rank", "id", "text_hash"]

_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS.encode())] = True


def _identity(docs: DataFrame, id_column: str, text_column: str) -> list[Column]:
    """A document is its id and text, in the order of the ids: by number for integer ids, NULL last.

    Integer ids are their own rank, and have no text.
    """
    name = F.col(id_column)
    if dict(docs.dtypes)[id_column] in ("tinyint", "smallint", "int", "bigint"):
        rank, text = name.cast("bigint"), F.lit(None).cast("string")
    else:
        rank, text = F.when(name.isNotNull(), F.lit(0)), name.cast("string")
    return [
        F.coalesce(rank, F.lit((1 << 63) - 1)).cast("bigint").alias("rank"),
        text.alias("id"),
        F.xxhash64(F.col(text_column)).alias("text_hash"),
    ]


# --- hashes by array arithmetic: the second implementation that tests compare with ---------


@lru_cache(maxsize=4)
def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        powers = np.full(count, base, np.uint64)
        powers[0] = 1
        out.append(np.cumprod(powers, dtype=np.uint64))
    return out[0], out[1]


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ values >> np.uint64(31)) * _MIX
    return values ^ values >> np.uint64(29)


class Sums:
    """Hashes of any slices of a sequence, as differences of running sums."""

    def __init__(self, values: np.ndarray):
        size = 1 << max(10, (len(values) + 1).bit_length())
        powers, self.inverse = _powers(size)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers[: len(values)], dtype=np.uint64, out=self.sums[1:])

    def of(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[ends] - self.sums[begins]) * self.inverse[begins])


def _parts(data: bytes, min_words: int) -> Iterator[tuple[bytes, int]]:
    """A text in parts with the bytes in which their own words begin; the last windows are whole."""
    start = 0
    while len(data) - start > PIECE_BYTES:
        stop = start + PIECE_BYTES
        while stop < len(data) and not _BLANK[data[stop]]:
            stop += 1
        end = stop
        for _ in range(min_words - 1):
            while end < len(data) and _BLANK[data[end]]:
                end += 1
            while end < len(data) and not _BLANK[data[end]]:
                end += 1
        yield data[start:end], stop - start
        start = stop
    yield (data[start:] if start else data), len(data) - start


class Winnowed:
    """The windows of pieces `(document, bytes, own bytes, words before)` and their fingerprints.

    `document`, `start` (its first word), `hash` and `least` tell of each window that begins in the
    own bytes of its piece, in order; `words` are the own words of each piece.
    """

    def __init__(self, pieces: list[tuple[int, bytes, int, int]], min_words: int):
        joined = b"\n".join([data for _, data, _, _ in pieces]) + b"\n"
        data = np.frombuffer(joined, np.uint8)
        sizes = np.array([len(d) + 1 for _, d, _, _ in pieces], np.int64)
        offsets = np.cumsum(sizes) - sizes
        blank = _BLANK[data]
        edges = np.flatnonzero(np.diff(blank.view(np.int8), prepend=1))
        begins, ends = edges[::2], edges[1::2]
        piece = np.searchsorted(offsets, begins, side="right") - 1
        own = begins - offsets[piece] < np.array([n for _, _, n, _ in pieces], np.int64)[piece]
        self.words = np.bincount(piece[own], minlength=len(pieces))
        first = np.searchsorted(piece, np.arange(len(pieces)))

        words = Sums(Sums(data.astype(np.uint64) + np.uint64(1)).of(begins, ends) if len(begins) else np.zeros(0, np.uint64))
        count = max(len(begins) - min_words + 1, 0)
        gram = min(GRAM, min_words)
        at = np.arange(count + min_words - gram) if count else np.zeros(0, np.int64)
        least = words.of(at, at + gram)
        have, want = 1, min_words - gram + 1
        while have < want and count:
            shift = min(have, want - have)
            least = np.minimum(least[:-shift], least[shift:])
            have += shift
        at = np.arange(count)
        inside = own[:count] & (piece[:count] == piece[count and min_words - 1 :][:count])
        at = at[inside]
        self.hash = words.of(at, at + min_words)
        self.least = least[: count][inside]
        of = piece[at]
        self.document = np.array([d for d, _, _, _ in pieces], np.int64)[of]
        self.start = at - first[of] + np.array([b for _, _, _, b in pieces], np.int64)[of]
        # A group is a run of windows of one fingerprint in one piece.
        cut = np.ones(len(at), bool)
        cut[1:] = (np.diff(self.least) != 0) | (np.diff(at) != 1) | (np.diff(of) != 0)
        self.begins = np.flatnonzero(cut)
        self.ends = np.append(self.begins[1:], len(at)) if len(at) else self.begins

    def wholes(self) -> np.ndarray:
        """The hash of all windows of each group."""
        return Sums(self.hash).of(self.begins, self.ends)

    def loops(self) -> np.ndarray:
        """Whether windows of a group are equal: a text that repeats itself."""
        group = np.repeat(np.arange(len(self.begins)), self.ends - self.begins)
        # Equal windows come in order of their place, so those of one group are neighbours.
        order = np.argsort(self.hash, kind="stable")
        again = (np.diff(group[order]) == 0) & (np.diff(self.hash[order]) == 0)
        out = np.zeros(len(self.begins), bool)
        out[group[order[1:][again]]] = True
        return out


def winnowed(texts: pa.Array, min_words: int) -> Iterator[Winnowed]:
    """The windows of numbered texts, of about `PIECE_BYTES` bytes at a time."""
    held, size = [], 0
    for i, text in enumerate(texts):
        data, before = text.as_buffer().to_pybytes(), 0
        for part, own in _parts(data, min_words):
            held.append((i, part, own, before))
            size += len(part)
            if size >= PIECE_BYTES or own < len(part):
                made = Winnowed(held, min_words)
                before += int(made.words[-1])
                yield made
                held, size = [], 0
    if held:
        yield Winnowed(held, min_words)


# --- native hashes --------------------------------------------------------------------


def _bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """`of` a value that is computed once. `transform` would do too, but copies what it returns."""
    return F.aggregate(F.array(F.lit(0)), value, lambda bound, _: bound, of)


def _words(text: str) -> Column:
    """The words of a text."""
    # Only white space at the ends makes empty words.
    padded = lambda w: (F.get(w, F.lit(0)) == "") | (F.element_at(w, -1) == "")
    return _bound(
        F.split(text, f"{SPACE}++"),
        lambda words: F.when(padded(words), F.filter(words, lambda word: word != "")).otherwise(words),
    )


def _hash_of(values: Column, start: Column, count: int) -> Column:
    """The hash of `count` values of an array."""
    return F.xxhash64(*(F.get(values, start + k) for k in range(count)))


def _codes(words: Column, start: Column, count: Column) -> Column:
    """The hashes of `count` words, of `CODE` bytes each: any run of them is a slice of bytes."""
    # The first digit is never 0, so there are always sixteen.
    code = lambda word: F.hex(F.xxhash64(word).bitwiseOR(F.lit(-1 << 63)))
    return F.array_join(F.transform(F.slice(words, start + 1, count), code), "").cast("binary")


def _window(codes: Column, at: Column, min_words: int) -> Column:
    """The hash of the window that begins `at` words behind the first of `codes`."""
    return F.xxhash64(F.substring(codes, CODE * at + 1, F.lit(CODE * min_words)))


def _level(low: Column, high: Column, edges: Column, parts: Column, grams: Column) -> Column:
    return F.struct(
        low.alias("low"), high.alias("high"), edges.alias("edges"), parts.alias("parts"), grams.alias("grams")
    )


def _lone_windows(words: Column, low: Column, high: Column, min_words: int) -> Column:
    """A level of groups of one window each, which is its own fingerprint."""
    none = F.array()

    def lone(codes):
        windows = F.transform(F.sequence(F.lit(0), high - low), lambda i: _window(codes, i, min_words))
        return F.array(_level(low, high, none.cast("array<int>"), none.cast("array<bigint>"), windows))

    return _bound(_codes(words, low, high - low + min_words), lone)


def _levels(words: Column, low: Column, high: Column, min_words: int, every: tuple[int, ...]) -> Column:
    """The windows that begin at the words `low` to `high`, by the first anchor of each.

    One level has the `grams` of the anchors of the first kind in `every`, its `edges` are the word before `low`, the
    anchors and the last word, and `parts` are the hashes of the words between them, later edge included.
    Windows without such an anchor make levels of the next kind, and of themselves in the end.
    """
    if not every:
        return _lone_windows(words, low, high, min_words)
    gram = min(GRAM, min_words)
    reach = _reach(min_words)

    def made(anchors, edges):
        parts = F.transform(
            F.slice(edges, F.lit(2), F.size(edges) - 1), lambda x, j: part(F.get(edges, j) + 1, x)
        )
        grams = F.transform(anchors, lambda x: _hash_of(words, x, gram))
        bare = F.transform(
            F.concat(anchors, F.array(high + reach + 1)),
            lambda x, j: F.struct((F.get(edges, j) + 1).alias("low"), (x - reach - 1).alias("high")),
        )
        others = F.transform(
            F.filter(bare, lambda g: g["low"] <= g["high"]),
            lambda g: _levels(words, g["low"], g["high"], min_words, every[1:]),
        )
        return F.concat(F.array(_level(low, high, edges, parts, grams)), F.flatten(others))

    def part(first, last):
        run = F.when(first <= last, F.sequence(first, last))
        return F.aggregate(run, F.lit(0).cast("bigint"), lambda h, i: F.xxhash64(h, F.get(words, i)))

    def chosen(i):
        # Two words tell more evenly than one, as some words are frequent.
        first = [F.get(words, i + k) for k in range(min(2, gram))]
        return F.xxhash64(*first) < -(1 << 63) + (1 << 64) // every[0]

    def edged(anchors):
        edges = F.concat(F.array(low - 1), anchors, F.array(high + min_words - 1))
        return _bound(edges, lambda e: made(anchors, e))

    return _bound(F.filter(F.sequence(low, high + reach), chosen), edged)


def _reach(min_words: int) -> int:
    """Words before an anchor in a window that still holds the gram of the anchor."""
    return min_words - min(GRAM, min_words)


def window_groups(texts: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The groups of windows of `(rank, id, text_hash, text)`; every window lies in one of them.

    `start` is the first word and `windows` the number of windows. Groups of one `whole` have the same windows.
    """

    def levels(words):
        high = F.size(words) - min_words
        return F.when(high >= 0, _levels(words, F.lit(0), high, min_words, ANCHORS))

    rows = texts.select(*DOC, F.explode(_bound(_words("text"), levels)).alias("level")).select(*DOC, "level.*")
    rows = rows.select(*DOC, "low", "high", "edges", "parts", F.posexplode("grams").alias("j", "fingerprint"))
    edge, part = (lambda k: F.get("edges", F.col("j") + k)), (lambda k: F.get("parts", F.col("j") + k))
    lone, at = F.size("parts") == 0, edge(1)
    start = F.when(lone, F.col("low") + F.col("j")).otherwise(F.greatest(edge(0) + 1, at - _reach(min_words)))
    last = F.when(lone, F.col("low") + F.col("j")).otherwise(F.least(at, F.col("high")))
    # The parts up to the anchor and after it, and those that begin inside the last window.
    inside = lambda k: edge(k) < at + (min_words - 1)
    further = [F.when(inside(k), part(k)) for k in range(2, NEAR)]
    others = F.when(inside(NEAR), F.xxhash64(F.slice("parts", F.col("j") + NEAR + 1, F.lit(min_words))))
    whole = F.xxhash64(F.col("windows"), at - F.col("start"), part(0), part(1), *further, others)
    rows = rows.withColumn("start", start).withColumn("windows", last - F.col("start") + 1).where("windows > 0")
    return rows.select(*DOC, "start", "windows", "fingerprint", F.when(lone, F.col("fingerprint")).otherwise(whole).alias("whole"))


def single_windows(texts: DataFrame, asked: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The hash `window` of every window of the groups `(rank, id, text_hash, start, windows)`."""
    groups = asked.groupBy(*DOC).agg(F.collect_list(F.struct("start", "windows")).alias("groups"))
    joined = _with_found(texts, stored(groups, "asked-groups"), "groups")

    def cut(words):
        codes = lambda g: _codes(words, g["start"], g["windows"] + min_words - 1)
        return lambda g: F.struct(g["start"].alias("start"), g["windows"].alias("windows"), codes(g).alias("codes"))

    made = _bound(F.struct(_words("text").alias("words"), "groups"), lambda d: F.transform(d["groups"], cut(d["words"])))
    spans = joined.select(*DOC, F.explode(made).alias("g")).select(*DOC, "g.*")
    rows = spans.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("windows") - 1)))
    return rows.select(
        *DOC, (F.col("start") + F.col("at")).alias("start"), _window(F.col("codes"), F.col("at"), min_words).alias("window")
    )


def _with_found(rows: DataFrame, found: DataFrame, name: str, how: str = "inner") -> DataFrame:
    """`rows` with the array column `name` of the stored table `found` of documents."""
    size = found.agg(F.sum(F.size(name) * 32 + 64)).first()[0] or 0
    found = found.select(*(F.col(c).alias(f"found_{c}") for c in DOC), name)
    found = F.broadcast(found) if size <= BROADCAST_BYTES else found
    same = (F.col("rank") == F.col("found_rank")) & (F.col("text_hash") == F.col("found_text_hash"))
    joined = rows.join(found, same & F.col("id").eqNullSafe(F.col("found_id")), how)
    return joined.drop(*(f"found_{c}" for c in DOC))


# --- runs -----------------------------------------------------------------------------


def _later(places: DataFrame, min_words: int) -> DataFrame:
    """The words `begin` to `end` of places, with their `first` one, that come after it.

    A run that repeats itself overlaps its first place, whose words stay.
    """
    later = places.where(F.struct(*DOC, "start") > F.col("first"))
    same = F.lit(True)
    for name in DOC:
        same = same & F.col(name).eqNullSafe(F.col("first")[name])
    begin = F.when(same, F.greatest("start", F.col("first")["start"] + min_words)).otherwise(F.col("start"))
    end = F.col("start") + F.col("windows") + min_words - 1
    return later.select(*DOC, begin.alias("begin"), end.alias("end")).where("begin < end")


def repeated_runs(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """Words that belong to a later repeated run: `(rank, id, text_hash, runs)` per document, stored.

    `runs` has the 0-based words `begin` to `end` (not included), sorted and disjoint.
    """
    texts = docs.select(*_identity(docs, id_column, text_column), F.col(text_column).cast("string").alias("text"))
    texts = texts.where("text IS NOT NULL")
    groups = stored(window_groups(texts, min_words), "all-groups")
    again = groups.groupBy("fingerprint").agg(F.count("*").alias("places")).where("places > 1")
    groups = stored(groups.join(again.select("fingerprint"), "fingerprint", "left_semi"), "window-groups")
    place = F.struct(*DOC, "start")
    wholes = groups.groupBy("fingerprint", "whole").agg(
        F.min(place).alias("first"),
        F.first("windows").alias("windows"),
        F.count("*").alias("places"),
    )
    wholes = stored(wholes, "equal-groups")
    firsts = wholes.where("places > 1").select("fingerprint", "whole", "first")
    later = _later(groups.join(firsts, ["fingerprint", "whole"]), min_words)

    # Groups of one fingerprint that differ may still share some of their windows.
    mixed = wholes.groupBy("fingerprint").agg(F.count("*").alias("kinds")).where("kinds > 1").select("fingerprint")
    ends = wholes.join(mixed, "fingerprint", "left_semi").select("first.*", "windows")
    # A window is met at the first places of groups only, however many copies these have.
    alike = Window.partitionBy("window")
    single = single_windows(texts, ends, min_words)
    single = single.withColumn("first", F.min(place).over(alike)).withColumn("windows", F.lit(1))
    extended = _later(single, min_words)

    # Overlapping repeats become one run.
    along = Window.partitionBy(*DOC).orderBy("begin", "end")
    reached = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    runs = later.union(extended).withColumn("new", F.coalesce(F.col("begin") > reached, F.lit(True)))
    runs = runs.withColumn("run", F.sum(F.col("new").cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(*DOC, "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    runs = runs.groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("runs"))
    return stored(runs, "runs")


def _without(text: Column, runs: Column) -> Column:
    """A text without some words and the white space before them."""
    space, word = SPACE[1:-1], f"[^{SPACE[1:-1]}]"
    words = F.regexp_extract_all(text, F.lit(f"[{space}]*{word}+"), F.lit(0))
    begins = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["end"].cast("int")))
    ends = F.concat(F.transform(runs, lambda r: r["begin"].cast("int")), F.array(F.lit((1 << 31) - 1)))
    gaps = F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("begin"), (b - a).alias("words")))
    # The words are bound once by the outer transform.
    bound = F.array(F.struct(words.alias("words"), gaps.alias("gaps")))
    kept = F.transform(
        bound, lambda b: F.flatten(F.transform(b["gaps"], lambda g: F.slice(b["words"], g["begin"] + 1, g["words"])))
    )
    tail = F.substring(text, F.length(F.rtrim(text, F.lit(BLANKS))) + 1, F.length(text))
    return F.concat(F.array_join(F.element_at(kept, 1), ""), tail)


def dedup_lines(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """`docs` with later repeated runs of `min_words` words or more deleted from their texts.

    A word goes if some `min_words` words in a row around it, with any white space between them,
    occur at an earlier place: in a document of smaller id, or earlier in its own document. There, words
    of the first place stay. With the word goes the white space before it, so lines that go
    as a whole leave nothing behind.

    All columns and rows stay; `removed_runs` and `removed_words` are added, in place of columns
    of this name. NULL texts and those of fewer words stay as they are. Rows that repeat an id and a text
    count as one document and get the same result. Words are equal if all their characters are.
    Documents without an id come after all others, in the order of their hash; ids that are no
    integers come in the order of their text.
    """
    base = docs.drop(*{"removed_runs", "removed_words"} & set(docs.columns))
    names = base.columns
    found = repeated_runs(base, id_column, text_column, min_words)
    keyed = base.select(
        F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"),
        *_identity(base, id_column, text_column),
    )
    joined = _with_found(keyed, found, "runs", "left")
    text = F.col("row").getField(text_column)
    rows = joined.select("row", "runs", F.when(F.col("runs").isNotNull(), _without(text, F.col("runs"))).alias("left"))
    gone = F.aggregate("runs", F.lit(0).cast("bigint"), lambda n, r: n + r["end"] - r["begin"])
    return rows.select(
        *(
            (F.coalesce("left", text) if c == text_column else F.col("row").getField(c)).alias(c)
            for c in names
        ),
        F.coalesce(F.size("runs"), F.lit(0)).alias("removed_runs"),
        F.coalesce(gone, F.lit(0)).alias("removed_words"),
    )
