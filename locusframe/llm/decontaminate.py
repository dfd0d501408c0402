"""Benchmark decontamination by template windows.

Words become template tokens: numbers, names (capitalised words) and units after a number are
typed placeholders, other words are folded to lower case without the punctuation around them. A
window of eight tokens is hashed three times: with all placeholders, with names as folded
words (for copies that changed their case), and literally. The first two count only with enough
literal words in them, so a window of placeholders alone tells nothing; a table of numbers or
names is found by its literal windows, and never by its layout.

Windows of the benchmark and of the documents meet in one hash join. What carries an item into
the join are its rare windows, and so many of the others, from the rarest on, that what is left
is too little for a leak: no leak is without a window that carries. The rest only confirms. A filter of
bounded size goes to the documents first, so that the windows of other texts are never rows, and
documents are read once, whatever the benchmark.

Where a document and an item have met, the offsets of all windows that they share are looked up
in the two texts, frequent ones too. At an offset all tokens are compared, and windows
count if their slots are consistent: the same value in the item always meets the same value in
the document. Where it meets others, only the windows that need them are dropped; literally equal
ones always stay. So a question is found again when its numbers, names or units were exchanged.
"""

import bisect
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from locusframe.llm.common import MOST_BITS, HashFilter, bounded_batches, hash_filter, pieces_of, stored

WINDOW = 8
# A shorter item is one window; with fewer tokens than this it is reported as unsearched.
SHORTEST = 4
# Of the tokens of a window with placeholders, literal words must be three eighths.
LITERAL_SHARE = 3 / 8
# A window of more items than this carries one of them only where the item could leak without it.
FREQUENT = 64
# An item leaks if so much of it is found, or a run of so many tokens.
MIN_COVERAGE = 0.5
MIN_RUN = 20
# Different words that a task remembers before it starts anew.
MOST_WORDS = 500_000
# Tokens whose windows are hashed at once.
_AT_ONCE = 1 << 20

WORD, NUMBER, NAME, UNIT = range(4)
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen "
    "fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy "
    "eighty ninety hundred thousand million billion".split()
)
UNITS = frozenset(
    "mm cm m km in ft yd mi g kg mg t lb lbs oz l ml s sec secs min mins h hr hrs d percent "
    "meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches "
    "foot feet yard yards gram grams kilogram kilograms pound pounds ounce ounces ton tons liter "
    "liters litre litres second seconds minute minutes hour hours day days week weeks month months "
    "year years dollar dollars euro euros cent cents degree degrees celsius fahrenheit mph kmh "
    "kb mb gb tb".split()
)
_EDGES = re.compile(r"^[^\w$€£%]+|[^\w%]+$|_+$")
_DIGIT = re.compile(r"\d")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = {kind: np.uint64(xxhash.xxh64_intdigest(f"slot {kind}")) for kind in (NUMBER, NAME, UNIT)}


# --- templates ------------------------------------------------------------------------


class _Words(dict):
    """Numbers words in the order of their first use, with their kind and hash by number."""

    def __init__(self):
        super().__init__()
        self.kinds, self.units = np.zeros(0, np.int8), np.zeros(0, bool)
        self.hashes = np.zeros(0, np.uint64)
        self.fresh: list[tuple[int, bool, int]] = []

    def __missing__(self, word: bytes) -> int:
        # Most words are plain letters, whose edges need no pattern.
        body = word.rstrip(b".,;:!?")
        plain = body.isalpha()
        text = body.decode() if plain else _EDGES.sub("", word.decode())
        folded = text.casefold()
        if folded in NUMBER_WORDS or not plain and _DIGIT.search(text):
            kind = NUMBER
        elif len(text) > 1 and text[0].isupper() and text[1:].islower():
            kind = NAME
        else:
            kind = WORD
        self.fresh.append((kind if folded else -1, folded in UNITS, xxhash.xxh64_intdigest(folded)))
        at = self[word] = len(self)
        return at

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The numbers of words, which the three arrays know from now on."""
        ids = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        if self.fresh:
            kinds, units, hashes = zip(*self.fresh)
            self._grow("kinds", np.array(kinds, np.int8))
            self._grow("units", np.array(units, bool))
            self._grow("hashes", np.array(hashes, np.uint64))
            self.fresh = []
        return ids

    def _grow(self, name: str, values: np.ndarray) -> None:
        """Append to an array that has room for twice its values, so growing costs little."""
        old, have = getattr(self, name), len(self) - len(values)
        if len(self) > len(old):
            larger = np.zeros(max(1024, 2 * len(self)), old.dtype)
            larger[:have] = old[:have]
            setattr(self, name, old := larger)
        old[have : len(self)] = values


def _rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for every run of `size` columns, by doubling while the size is even."""
    if size == 1:
        return hashes
    if size % 2:
        rest = _rolled(hashes[:, 1:], size - 1)
        return hashes[:, : rest.shape[1]] * np.uint64(pow(int(_MULTIPLIER), size - 1, 1 << 64)) + rest
    half = _rolled(hashes, size // 2)
    count = half.shape[1] - size // 2
    return half[:, :count] * np.uint64(pow(int(_MULTIPLIER), size // 2, 1 << 64)) + half[:, size // 2 :]


class Template:
    """The tokens of a text: a kind and the hash of the folded word each."""

    def __init__(self, values: np.ndarray, kinds: np.ndarray):
        self.values, self.kinds = values, kinds

    @classmethod
    def of(cls, text: str, words: _Words) -> "Template":
        parts = [words.numbers(part) for part in pieces_of(text.encode())]
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        kinds = words.kinds[ids]
        ids, kinds = ids[kinds >= 0], kinds[kinds >= 0]
        if len(ids) > 1:
            unit = words.units[ids]
            unit[1:] &= kinds[:-1] == NUMBER
            unit[0] = False
            kinds = np.where(unit, np.int8(UNIT), kinds)
        return cls(words.hashes[ids], kinds)

    def __len__(self) -> int:
        return len(self.kinds)

    def hashes(self) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """The three readings of the tokens, each with its literal words if they must be many."""
        plain = self.values
        for kind in (NUMBER, UNIT):
            plain = np.where(self.kinds == kind, _SLOTS[kind], plain)
        names = self.kinds == NAME
        word = self.kinds == WORD
        return [(np.where(names, _SLOTS[NAME], plain), word), (plain, word | names), (self.values, None)]

    def windows(self, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """`(places, hashes)` of the windows of `size` tokens that may count, for each reading."""
        readings = self.hashes()
        if len(self) < size:
            return [(np.zeros(0, np.int64), np.zeros(0, np.uint64)) for _ in readings]
        rolled = _rolled(np.stack([hashes for hashes, _ in readings]), size)
        out = []
        for reading, (windows, (_, literal)) in enumerate(zip(rolled, readings)):
            places = np.arange(len(windows))
            if literal is not None:
                before = np.concatenate([[0], np.cumsum(literal)])
                places = np.flatnonzero(before[size:] - before[:-size] >= size * LITERAL_SHARE)
                windows = windows[places]
            # Readings and sizes are kept apart.
            windows = (windows ^ np.uint64(reading + 3 * size)) * _MULTIPLIER
            out.append((places, windows ^ windows >> np.uint64(29)))
        return out

    def slot_pattern(self) -> bytes:
        """The placeholders with the number of their value: equal for exchanged values."""
        seen: dict[tuple[int, int], int] = {}
        slots = [
            seen.setdefault((kind, value), len(seen)) if kind != WORD else -1
            for kind, value in zip(self.kinds.tolist(), self.values.tolist())
        ]
        return np.array(slots, "<i4").tobytes()


def _counted(item: Template, text: Template, offset: int, size: int) -> np.ndarray:
    """The places of the item whose windows equal those of the text in some reading."""
    low, high = max(0, -offset), min(len(item), len(text) - offset)
    if high - low < size:
        return np.zeros(0, np.int64)
    mine, other = Template(item.values[low:high], item.kinds[low:high]), slice(offset + low, offset + high)
    theirs = Template(text.values[other], text.kinds[other])
    counts = np.zeros(high - low - size + 1, bool)
    for (a, literal), (b, _) in zip(mine.hashes(), theirs.hashes()):
        same = np.concatenate([[0], np.cumsum(a == b)])
        equal = same[size:] - same[:-size] == size
        if literal is not None:
            before = np.concatenate([[0], np.cumsum(literal)])
            equal &= before[size:] - before[:-size] >= size * LITERAL_SHARE
        counts |= equal
    return low + np.flatnonzero(counts)


def aligned(item: Template, text: Template, offset: int) -> tuple[set[int], int]:
    """The tokens of the item that are found at an offset of the text, and how many have another value.

    A value of the item should meet one value in the text. If it meets several, a window
    stays only if it has the item's own value or the one exchanged for it most often (and
    more than once), the same at all places of the window.
    """
    size = min(WINDOW, len(item))
    windows = _counted(item, text, offset, size).tolist()
    tokens = {place for start in windows for place in range(start, start + size)}
    slots: dict[int, tuple[tuple[int, int], int]] = {}
    met: dict[tuple[int, int], Counter] = defaultdict(Counter)
    for place in tokens:
        kind = int(item.kinds[place])
        if kind != WORD:
            mine, other = int(item.values[place]), int(text.values[offset + place])
            slots[place] = (kind, mine), other
            met[kind, mine][other] += 1
    allowed = {}
    for key, values in met.items():
        if len(values) > 1:
            changed = sorted(((n, v) for v, n in values.items() if v != key[1]), reverse=True)
            clear = changed[0][0] > 1 and (len(changed) == 1 or changed[0][0] > changed[1][0])
            allowed[key] = {key[1], changed[0][1]} if clear else {key[1]}
    if allowed:
        tokens = set()
        for start in windows:
            seen: dict[tuple[int, int], int] = {}
            own = [slots[place] for place in range(start, start + size) if place in slots]
            if all(
                key not in allowed or (other in allowed[key] and seen.setdefault(key, other) == other)
                for key, other in own
            ):
                tokens.update(range(start, start + size))
    return tokens, sum(place in tokens and other != key[1] for place, (key, other) in slots.items())


def longest_run(tokens: set[int]) -> int:
    best = run = 0
    before = None
    for place in sorted(tokens):
        run = run + 1 if before is not None and place == before + 1 else 1
        best, before = max(best, run), place
    return best


# --- the benchmark --------------------------------------------------------------------


def _templates(rows: DataFrame, schema: str, of) -> DataFrame:
    """Rows that `of(key columns, template)` yields for each `(key columns..., text)`."""

    def run(batches):
        words = _Words()
        names = None
        for batch in batches:
            out, types = [], None
            keys = zip(*(c.to_pylist() for c in batch.columns[:-1]))
            for key, text in zip(keys, batch.columns[-1]):
                if len(words) > MOST_WORDS:
                    words = _Words()
                out += of(key, Template.of(text.as_py() or "", words))
            if out:
                names = names or [field.split()[0] for field in schema.split(", ")]
                types = [batch.schema.field(0).type] + [_ARROW[field.split()[1]] for field in schema.split(", ")[1:]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return bounded_batches(rows).mapInArrow(run, schema)


_HIT = pa.struct([("window", pa.int64()), ("at", pa.int64())])
_ARROW = {
    "bigint": pa.int64(), "binary": pa.binary(), "array<struct<window:bigint,at:bigint>>": pa.list_(_HIT),
}


def _items(benchmark: DataFrame, item_column: str, text_column: str) -> DataFrame:
    kind = dict(benchmark.dtypes)[item_column]

    def of(key, template):
        values, kinds = template.values.tobytes(), template.kinds.tobytes()
        shape = template.hashes()[0][0].tobytes() + template.slot_pattern()
        yield *key, len(template), values, kinds, xxhash.xxh128_digest(values + kinds), xxhash.xxh128_digest(shape)

    rows = benchmark.select(F.col(item_column).alias("item"), F.col(text_column).cast("string").alias("text"))
    return _templates(rows, f"item {kind}, tokens bigint, values binary, kinds binary, literal binary, shape binary", of)


def unsearched_items(benchmark: DataFrame, item_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """`(item, tokens)` of the items that are too short to be searched for: fewer than four tokens."""
    return _items(benchmark, item_column, text_column).where(F.col("tokens") < SHORTEST).select("item", "tokens")


def carrying_limit(length: int, places: np.ndarray, entries: np.ndarray) -> int:
    """How many entries a window may have and still carry this item, of `length` tokens.

    It is the least number, from `FREQUENT` on, at which the places with a window of more entries hold too
    little for a leak: less than the coverage, and no run.
    """
    size = min(WINDOW, length)
    most = np.zeros(length - size + 1, np.int64)
    np.maximum.at(most, places, entries)

    def too_little(level: int) -> bool:
        edges = np.zeros(length + 1, np.int64)
        starts = np.flatnonzero(most > level)
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + size, -1)
        held = np.flatnonzero(np.cumsum(edges))
        return len(held) < MIN_COVERAGE * length and longest_run(set(held.tolist())) < MIN_RUN

    levels = [FREQUENT, *np.unique(most[most > FREQUENT]).tolist()]
    return levels[bisect.bisect_left(levels, True, key=too_little)]


def _limits(counted: DataFrame) -> DataFrame:
    """`(entry, limit)` of the entries with a window of more than `FREQUENT` entries."""

    def run(batches):
        for batch in batches:
            names, lengths, found = (batch.column(i) for i in range(3))
            limits = [
                carrying_limit(length, np.array([f["place"] for f in some]), np.array([f["entries"] for f in some]))
                for length, some in zip(lengths.to_pylist(), found.to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([names, pa.array(limits, pa.int64())], names=["entry", "limit"])

    # An entry is an item, so a group holds the windows of one text.
    of = counted.groupBy("entry").agg(
        F.max("tokens").alias("tokens"), F.collect_list(F.struct("place", "entries")).alias("found"), F.max("entries").alias("most")
    )
    many = of.where(F.col("most") > FREQUENT).select("entry", "tokens", "found")
    return bounded_batches(many).mapInArrow(run, "entry binary, limit bigint")


def _carriers(entries: DataFrame, frequent: int | None) -> DataFrame:
    """`(window, entry, place)` of the windows that carry an entry into the join.

    Entries of one shape differ in values alone; the first of them stands for all in windows with
    placeholders and in literal ones that it shares, so a family of questions does not make its own
    windows frequent. A first entry has no place here: all its offsets are looked up in the texts.
    """

    def run(batches):
        for batch in batches:
            out = []
            for entry, values, kinds, lead in zip(*(c.to_pylist() for c in batch.columns)):
                template = Template(np.frombuffer(values, np.uint64), np.frombuffer(kinds, np.int8))
                first, size = values == lead, min(WINDOW, len(template))
                readings = template.windows(size)
                # A literal window is an entry's own if the first entry has another one there.
                theirs = Template(np.frombuffer(lead, np.uint64), template.kinds).windows(size)[2][1]
                own = [[True] * len(places) for places, _ in readings[:2]] + [(readings[2][1] != theirs).tolist()]
                for (places, windows), mine in zip(readings if first else readings[2:], own if first else own[2:]):
                    count = len(places)
                    out += zip(
                        windows.view(np.int64).tolist(), [entry] * count, places.tolist(), [len(template)] * count,
                        [first] * count, mine,
                    )
            if out:
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                    names=["window", "entry", "place", "tokens", "first", "own"],
                )

    schema = "window bigint, entry binary, place bigint, tokens bigint, first boolean, own boolean"
    windows = stored(entries.select("literal", "values", "kinds", "lead").mapInArrow(run, schema), "item-windows")
    counts = windows.groupBy("window", "entry").agg(F.lit(1).alias("one")).groupBy("window").agg(F.count("*").alias("entries"))
    counted = windows.join(counts, "window")
    most = FREQUENT if frequent is None else frequent
    rarest = Window.partitionBy("entry")
    rare = F.min("entries").over(rarest)
    # An entry is an item, so this window holds the windows of one text.
    counted = counted.withColumn("rarest", (rare > most) & (F.col("entries") == rare))
    carried = (F.col("entries") <= most) | F.col("rarest")
    if frequent is not None:
        return counted.where(carried).select("window", "entry", "place")
    counted = stored(counted, "item-windows")
    firsts, others = counted.where("first"), counted.where("not first").where(carried | F.col("own"))
    limits = _limits(firsts)
    enough = F.col("entries") <= F.coalesce("limit", F.lit(FREQUENT))
    leading = firsts.join(limits, "entry", "left").where(enough)
    nowhere = F.lit(None).cast("bigint").alias("place")
    return leading.select("window", "entry", nowhere).distinct().union(others.select("window", "entry", "place"))


# --- the operator ---------------------------------------------------------------------


def _pieces(template: Template, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places and hashes of the windows of a text, in pieces of bounded size."""
    for start in range(0, max(len(template) - size + 1, 0), _AT_ONCE):
        part = slice(start, start + _AT_ONCE + size - 1)
        for places, windows in Template(template.values[part], template.kinds[part]).windows(size):
            yield start + places, windows


class _Places:
    """Where the windows of a text are; those of a long one are made anew for every item."""

    def __init__(self, text: Template):
        self.text = text
        self.known: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def _sorted(self, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for places, windows in _pieces(self.text, size):
            order = np.argsort(windows)
            yield windows[order], places[order]

    def offsets(self, item: Template) -> list[int]:
        """The offsets of all windows that an item shares with the text."""
        size = min(WINDOW, len(item))
        pieces = self.known.get(size) or self._sorted(size)
        if len(self.text) <= _AT_ONCE and size not in self.known:
            pieces = self.known[size] = list(pieces)
        mine, found = item.windows(size), set()
        for windows, at in pieces:
            # Readings have hashes of their own, so each meets its own kind only.
            for places, wanted in mine:
                low, high = np.searchsorted(windows, wanted, "left"), np.searchsorted(windows, wanted, "right")
                for i in np.flatnonzero(high > low):
                    found.update((at[low[i] : high[i]] - places[i]).tolist())
        return sorted(found)


def _scanned(docs: DataFrame, kind: str, chosen: HashFilter, sizes: list[int]) -> DataFrame:
    """Documents with a window that the filter knows: their tokens and these windows."""
    shared = docs.sparkSession.sparkContext.broadcast(chosen)

    def of(key, template):
        held = shared.value
        hits = []
        for size in sizes:
            for places, windows in _pieces(template, size):
                maybe = np.flatnonzero(held.may_hold(windows))
                found = zip(windows[maybe].view(np.int64).tolist(), places[maybe].tolist())
                hits += [{"window": window, "at": at} for window, at in found]
        if hits:
            yield *key, template.values.tobytes(), template.kinds.tobytes(), hits

    schema = f"id {kind}, text_hash bigint, values binary, kinds binary, hits array<struct<window:bigint,at:bigint>>"
    return _templates(docs, schema, of)


def _found(kind: str, item_kind: str):
    schema = (
        f"id {kind}, text_hash bigint, item_id {item_kind}, coverage double, run int, first_token bigint, "
        "end_token bigint, changed_slots int"
    )
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches):
        text = places = entry = now = None

        def leak():
            """The row of the entry that was read, if it leaks."""
            key, item, template, tokens, best, first, end, changed = now
            coverage = len(tokens) / len(template)
            if coverage >= MIN_COVERAGE or best >= MIN_RUN:
                yield *key, item, coverage, best, first, end, changed

        for batch in batches:
            out = []
            types = [batch.schema.field(0).type, pa.int64(), batch.schema.field(3).type, pa.float64(),
                     pa.int32(), pa.int64(), pa.int64(), pa.int32()]
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                key, (of, item, offset) = row[:2], row[2:5]
                if of is None or (key, of) != entry:
                    if now:
                        out += leak()
                    now, entry = None, (key, of)
                tokens = Template(np.frombuffer(row[5], np.uint64), np.frombuffer(row[6], np.int8))
                if of is None:
                    # A document comes before its entries.
                    text, places = tokens, _Places(tokens)
                    continue
                for at in places.offsets(tokens) if offset is None else [offset]:
                    kept, changed = aligned(tokens, text, at)
                    if kept:
                        now = now or [key, item, tokens, set(), 0, at + min(kept), 0, 0]
                        now[3] |= kept
                        now[4] = max(now[4], longest_run(kept))
                        now[5] = min(now[5], at + min(kept))
                        now[6] = max(now[6], at + max(kept) + 1)
                        now[7] += changed
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
        if now:
            out = list(leak())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return run, schema


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    frequent: int | None = None,
    most_bits: int = MOST_BITS,
) -> DataFrame:
    """One row per document and benchmark item that leaked into it.

    `text_hash` tells documents of one id apart; rows that repeat both are one document. `coverage` is the part of
    the item's tokens that was found, `run` the longest run of them at one offset, `first_token`
    and `end_token` bound the place, and `changed_slots` counts numbers, names and units with
    another value than the item has. Items of equal tokens are reported as the smallest of
    their ids; of items that differ in their values alone, the smallest is reported where it is found with
    other values, and any that a literal window leads to which is rare or has values that the smallest has not. However
    frequent its windows are, no leak is left out. Only a caller that names `frequent` leaves some out: a window that
    more than so many families have then carries none of them, unless a family has no rarer one.

    NULL and empty texts leak nothing, NULL and empty items are in nothing, and items with fewer
    than four tokens are those of `unsearched_items`. Ids may be of any type; other columns are not read.
    """
    kind, item_kind = dict(docs.dtypes)[id_column], dict(benchmark.dtypes)[item_column]
    items = _items(benchmark, item_column, item_text_column).where(F.col("tokens") >= SHORTEST)
    entries = items.groupBy("literal").agg(
        F.min("item").alias("item"), *(F.first(c).alias(c) for c in ("tokens", "values", "kinds", "shape"))
    )
    entries = stored(entries, "items")
    families = entries.groupBy("shape").agg(F.min(F.struct("item", "literal", "values")).alias("least"))
    leads = families.select("shape", F.col("least.values").alias("lead"))
    entries = stored(entries.join(leads, "shape"), "items")
    carriers = stored(_carriers(entries, frequent), "carriers")
    sizes = [r[0] for r in entries.select(F.least("tokens", F.lit(WINDOW))).distinct().collect()]

    rows = docs.select(
        F.col(id_column).alias("id"),
        F.xxhash64(F.col(text_column).cast("string")).alias("text_hash"),
        F.col(text_column).cast("string").alias("text"),
    ).where("text IS NOT NULL")
    scanned = stored(_scanned(rows, kind, hash_filter(carriers.select("window"), most_bits), sorted(sizes)), "scanned")
    hits = scanned.select("id", "text_hash", F.explode("hits").alias("hit")).select("id", "text_hash", "hit.*")
    places = hits.join(carriers, "window").select("id", "text_hash", "entry", (F.col("at") - F.col("place")).alias("offset"))
    known = entries.select(F.col("literal").alias("entry"), "item", "values", "kinds")
    columns = ["id", "text_hash", "entry", "item", "offset", "values", "kinds"]
    alignments = places.distinct().join(known, "entry").select(*columns)
    # Documents without an alignment are left behind; the others come before their alignments.
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("entry", "binary"), ("item", item_kind), ("offset", "bigint"))]
    both = scanned.select("id", "text_hash", *nothing, "values", "kinds").union(alignments)
    ordered = bounded_batches(both.repartition("id", "text_hash")).sortWithinPartitions("id", "text_hash", "entry", "offset")
    run, schema = _found(kind, item_kind)
    found = ordered.select("id", "text_hash", "entry", "item", "offset", "values", "kinds").mapInArrow(run, schema)
    return found
