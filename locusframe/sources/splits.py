"""Records that do not end with a line, read from one file by many tasks.

A text file is read in pieces, cut at a separator that is cheap to find, and Spark gives
runs of them, the splits of the file, to different tasks. What a piece means depends on all
pieces before it: it may begin inside a quoted cell or a JSON string. So the file is read
twice. The first pass notes for every split what it makes of each state in which it may begin, a
fold over the splits of a file gives them their true states, and with these the second pass
tells records from parts of records. The parts at the ends of splits are put together by
the split in which their record begins.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from locusframe.storage import BROADCAST_ROWS, stored

# What a pass sends on at once.
_ROWS = 5_000


def _scan(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """The pieces of the files with the place of their split; in a split they come in order."""
    return (
        spark.read.option("lineSep", separator)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("split"),
            "value",
        )
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Batches cut where another split begins, with the split."""
    for batch in batches:
        paths, splits = batch.column(0), batch.column(1).to_numpy()
        names = paths.dictionary_encode().indices.to_numpy()
        edges = np.flatnonzero((np.diff(splits) != 0) | (np.diff(names) != 0)) + 1
        for begin, end in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
            if begin < end:
                yield (paths[begin].as_py(), int(splits[begin])), batch.slice(begin, end - begin)


# --- machines -------------------------------------------------------------------------
#
# A machine reads the pieces of a split from one of its states on. `put` yields the texts that
# end: the rest of the record before (only the first one may be it), or whole records. `rest` is
# the text of the record that is still open. `begun` counts the records that begin here, and `low`
# is the lowest depth that a piece ended at; a record has ended if it is 1 or less.


class QuotedLines:
    """Lines of CSV: a record ends with a line that is not inside quotes.

    A quote inside a quoted cell is doubled, so the number of quotes before a line tells its state.
    """

    separator = "\n"
    states = (0, 1)
    counts = True

    def __init__(self, state: int = 0):
        self.state = state
        self.open: list[str] = []
        self.begun, self.low = 0, 2
        self.head = state != 0

    def after(self) -> tuple[int, int]:
        return self.state, 0

    def put(self, pieces: pa.Array) -> Iterator[tuple[bool, pa.Array]]:
        """`(whether it is the rest of the record before, texts)`."""
        quotes = pc.count_substring(pieces, '"').to_numpy(zero_copy_only=False)
        after = (self.state + np.cumsum(quotes)) & 1
        before = np.concatenate([[self.state], after[:-1]])
        lines = pc.replace_substring_regex(pieces, r"\r$", "")
        at, count = 0, len(pieces)
        if not after.all():
            self.low = 0
        while at < count:
            if before[at] == 0 and not self.open:
                # A run of records of one line each, up to one that goes on.
                stop = at + int(np.argmax(after[at:])) if after[at:].any() else count
                if stop > at:
                    texts = lines.slice(at, stop - at)
                    full = texts.filter(pc.not_equal(pc.utf8_trim_whitespace(texts), ""))
                    self.begun += len(full)
                    if len(full):
                        yield False, full
                at = stop
                if at < count:
                    self.begun += 1
                    self.open.append(pieces[at].as_py())
                    at += 1
                continue
            ends = np.flatnonzero(after[at:] == 0)
            stop = at + int(ends[0]) if len(ends) else count
            self.open += pieces.slice(at, stop - at).to_pylist()
            if stop < count:
                text = "\n".join([*self.open, lines[stop].as_py()])
                self.open, head, self.head = [], self.head, False
                yield head, pa.array([text])
                stop += 1
            at = stop
        self.state = int(after[-1]) if count else self.state

    def rest(self) -> str | None:
        return "\n".join(self.open) if self.open else None

    @staticmethod
    def glue(parts: list[str]) -> str:
        return "\n".join(parts)


_STRING = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"', re.S)
_STRING_END = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.S)


class ArrayElements:
    """Objects of one JSON array per file, in pieces that end before a closing brace.

    The state is whether a piece begins inside a string, and how many brackets are open.
    """

    separator = "}"
    states = (0, 1)
    # Without a known depth the first pass cannot tell where elements begin.
    counts = False

    def __init__(self, state: int = 0, depth: int | None = None):
        self.inside, self.depth = bool(state), depth or 0
        # Without a known depth only the change of the state is followed.
        self.known = depth is not None
        self.open: list[str] = []
        self.begun, self.low = 0, 1 << 30
        self.head = self.known and (self.inside or self.depth > 1)

    def after(self) -> tuple[int, int]:
        return int(self.inside), self.depth

    def _read(self, piece: str) -> None:
        rest = piece
        if self.inside:
            end = _STRING_END.match(rest)
            if not end:
                return
            rest, self.inside = rest[end.end() :], False
        rest = _STRING.sub("", rest)
        quote = rest.find('"')
        if quote >= 0:
            self.inside, rest = True, rest[:quote]
        count = rest.count
        self.depth += count("{") + count("[") - count("]")
        if not self.inside:
            self.depth -= 1
            self.low = min(self.low, self.depth)

    def put(self, pieces: pa.Array) -> Iterator[tuple[bool, pa.Array]]:
        whole: list[str] = []
        for piece in pieces.to_pylist():
            outside, first = not self.inside and self.depth <= 1, self.depth == 0
            self._read(piece)
            if not self.known:
                continue
            if outside and not self.open and not self.head:
                begin = piece.find("{")
                if first and piece.strip("\ufeff \t\r\n")[:1] not in ("", "["):
                    raise ValueError(f"no object of an array: {piece[:60]!r}")
                if piece[: begin if begin >= 0 else None].strip("[], \t\r\n﻿"):
                    raise ValueError(f"an element of an array that is no object: {piece[:60]!r}")
                if begin < 0:
                    continue
                piece = piece[begin:]
                self.begun += 1
            self.open.append(piece)
            if not self.inside and self.depth == 1:
                text, self.open = "}".join([*self.open, ""]), []
                if self.head:
                    self.head = False
                    yield True, pa.array([text])
                else:
                    whole.append(text)
                    if len(whole) >= _ROWS:
                        yield False, pa.array(whole)
                        whole = []
        if whole:
            yield False, pa.array(whole)

    def rest(self) -> str | None:
        return "}".join([*self.open, ""]) if self.open else None

    @staticmethod
    def glue(parts: list[str]) -> str:
        return "".join(parts)


# --- passes ---------------------------------------------------------------------------

_SUMMARY = "path string, split bigint, state int, state_after int, depth int, low int, begun bigint"
_CARRY = "path string, split bigint, state int, depth int, owner bigint, begun bigint"
_PART = "path string, owner bigint, split bigint, n bigint, whole boolean, text string"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [field.split() for field in schema.split(", ")]
    columns = zip(zip(*rows), fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in columns], names=[n for n, _ in fields])


def _summaries(machine: type):
    """A row per split and state that it may begin in."""

    def run(batches):
        now, running = None, {}

        def rows():
            for state, m in running.items():
                yield *now, state, *m.after(), m.low, m.begun

        for split, batch in _runs(batches):
            if split != now:
                if now:
                    yield _batch(list(rows()), _SUMMARY)
                now, running = split, {state: machine(state) for state in machine.states}
            for m in running.values():
                for _ in m.put(batch.column(2)):
                    pass
        if now:
            yield _batch(list(rows()), _SUMMARY)

    return run


def _carried(batches):
    """The true state of every split, from the summaries of its file in order."""
    before = path = None
    state, depth, owner = 0, 0, None
    for batch in batches:
        out = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != path:
                path, state, depth, owner = row[0], 0, 0, None
            split = row[:2]
            if split == before or row[2] != state:
                # What the split would make of the other state.
                continue
            before = split
            _, start, _, after, change, low, begun = row
            out.append((path, start, state, depth, owner, begun))
            ended = depth + low <= 1
            state, depth = after, depth + change
            if not state and depth <= 1:
                owner = None
            elif ended or owner is None:
                # The open record began in this split; one that is only passed on keeps its own.
                owner = start
        if out:
            yield _batch(out, _CARRY)


def _parts(machine: type):
    """Records, and the parts of records at the ends of splits, with the split that they begin in."""

    def run(batches):
        now = m = None
        n = 0

        def rest():
            text = m.rest()
            if text is not None:
                # A split that no record begins in passes the one before on.
                whose = owner if m.head else now[1]
                yield _batch([(now[0], whose, now[1], None if m.head else n, False, text)], _PART)

        for split, batch in _runs(batches):
            if split != now:
                if now:
                    yield from rest()
                state, depth, owner = (batch.column(i)[0].as_py() for i in (3, 4, 5))
                if state is None:
                    raise ValueError(f"the split {split} was not there in the first pass")
                now, n = split, 0
                m = machine(state) if machine is QuotedLines else machine(state, depth)
            for head, texts in m.put(batch.column(2)):
                rows = len(texts)
                if head:
                    yield _batch([(now[0], owner, now[1], None, False, texts[0].as_py())], _PART)
                    continue
                for at in range(0, rows, _ROWS):
                    part = texts.slice(at, _ROWS)
                    size = len(part)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([now[0]] * size, pa.string()),
                            pa.array([now[1]] * size, pa.int64()),
                            pa.array([now[1]] * size, pa.int64()),
                            pa.array(range(n, n + size), pa.int64()),
                            pa.array([True] * size, pa.bool_()),
                            part.cast(pa.string()),
                        ],
                        names=["path", "owner", "split", "n", "whole", "text"],
                    )
                    n += size
        if now:
            yield from rest()

    return run


def read_split_records(spark: SparkSession, path: str, machine: type) -> DataFrame:
    """The records of all files below `path`: `(path, file, first, place, text)`.

    `place` is the 0-based number of the record in all files, which count in the order of their
    part numbers and names; `file` is the number of the file, from 1 on, among those with records, and
    `first` the place of its first record. A machine that does not count gives `(path, text)` alone. The files
    must not change between the passes.
    """
    scan = _scan(spark, path, machine.separator)
    summaries = scan.mapInArrow(_summaries(machine), _SUMMARY)
    # A row per split: a hundred bytes for 128 MB.
    ordered = summaries.repartition("path").sortWithinPartitions("path", "split", "state")
    carry = stored(ordered.mapInArrow(_carried, _CARRY), "splits")
    states = carry.select("path", "split", "state", "depth", "owner")
    few = carry.count() <= BROADCAST_ROWS
    if few:
        placed = scan.join(F.broadcast(states), ["path", "split"], "left")
    else:
        # A shuffle loses the order of pieces, so they are put in order again.
        placed = scan.withColumn("at", F.monotonically_increasing_id()).join(states, ["path", "split"], "left")
        placed = placed.repartition("path", "split").sortWithinPartitions("path", "split", "at")
    parts = placed.select("path", "split", "value", "state", "depth", "owner").mapInArrow(_parts(machine), _PART)
    whole = parts.where("whole").select("path", "split", "n", "text")
    glue = F.array_join(F.sort_array(F.collect_list(F.struct("split", "text")))["text"], machine.glue(["", ""]))
    glued = (
        parts.where("not whole")
        .groupBy("path", "owner")
        .agg(F.max("n").alias("n"), glue.alias("text"))
        .select("path", F.col("owner").alias("split"), "n", "text")
    )
    if not machine.counts:
        return whole.union(glued).select("path", "text")
    part = F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).try_cast("bigint")
    earlier = Window.orderBy(part, "path", "split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = carry.withColumn("before", F.coalesce(F.sum("begun").over(earlier), F.lit(0))).where("begun > 0")
    offsets = offsets.select(
        "path",
        "split",
        "before",
        F.dense_rank().over(Window.orderBy(part, "path")).cast("bigint").alias("file"),
        F.min("before").over(Window.partitionBy("path")).alias("first"),
    )
    placed = whole.union(glued).join(F.broadcast(offsets) if few else offsets, ["path", "split"])
    return placed.select("path", "file", "first", (F.col("before") + F.col("n")).alias("place"), "text")
