"""Token ids in files of directly addressable codes.

An id is cut into chunks of eight bits, lowest first. The first level of a segment has the
first chunk of all its ids, and a bitmap that marks the ids that go on; the next level has the
second chunk of those alone, and so on. A directory beside each bitmap has the number of marks
before every 512th position, so the place of an id in the next level is one directory entry
and the marks of one block: any id is read with a few bytes of each level, and nothing is
decoded around it.

A file is a run of segments of bounded size and a footer that tells where they begin. A
document may cross segments, never files, and the files follow each other in the order of the
document ids, so the position of a document in the whole corpus is the ids of all files before
its own and its start there.

Texts are sorted over the cluster and encoded once, in the tasks that write the files. Files are
written into the shared folder under a name of their attempt, and the manifest of the writing job
names the ones that count, so files of lost or repeated tasks are never read.
"""

import bisect
import json
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from locusframe.llm.common import bounded_batches, pieces_of, stored
from locusframe.storage import new_path

VOCABULARY = "word_bpe_49k"
END = 2

CHUNK_BITS = 8
BLOCK = 512  # positions between two entries of a rank directory
SEGMENT_IDS = 1 << 20
# Bytes of the texts that a file should have, and below which no further task pays.
FILE_BYTES, LEAST_FILE_BYTES = 64 << 20, 4 << 20
MOST_TASKS = 50_000
MAGIC = b"ADDRCODE"


# --- tokens ---------------------------------------------------------------------------

# Words of these characters are cut by the tokenizer's own pattern and looked up piece by piece;
# for each of the characters the tests compare that with the tokenizer.
_PLAIN = r"[\x21-\x7e\xa1-ɏ‐-‧€]+"
# Words whose ids a Python worker remembers, beyond which it begins anew; long ones rarely come again.
_REMEMBERED, _LONG = 400_000, 100


def _visible_bytes() -> list[str]:
    """The sign that a byte-level vocabulary writes for each byte: its own if that is visible."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [byte for byte in range(256) if byte not in own]
    signs = dict(zip(own, own)) | {byte: 256 + n for n, byte in enumerate(others)}
    return [chr(signs[byte]) for byte in range(256)]


_VISIBLE = _visible_bytes()


class WordEncoder:
    """Ids of texts, through the ids of their words.

    The tokenizer drops white space and no token spans it, so the ids of a text are those of
    its words one after the other. Each different word is encoded once per worker.
    """

    def __init__(self, vocabulary: str = VOCABULARY, folder: str | None = None):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        name = f"{vocabulary}.json"
        path = f"{folder}/{name}" if folder else str(public_tokenizers.path(name))
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            setup = json.load(file)
        splits = (setup.get("pre_tokenizer") or {}).get("pretokenizers") or []
        pattern = next((s["pattern"]["Regex"] for s in splits if s["type"] == "Split"), None)
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are little-endian numbers of four bytes")
        if pattern is None or setup["model"].get("end_of_word_suffix") != "</w>":
            raise ValueError(f"{vocabulary} is not a vocabulary of separate words")
        self.pieces = regex.compile(pattern).findall
        self.plain = regex.compile(_PLAIN).fullmatch
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = {literal[:2].encode() for literal in self.added}
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        """The ids of a run of letters or signs, or of a digit, in lower case."""
        found = self.parts.get(part)
        if found is None:
            visible = part if part.isascii() else "".join(map(_VISIBLE.__getitem__, part.encode()))
            found = array("I", [token.id for token in self.tokenizer.model.tokenize(visible)]).tobytes()
            if len(part) <= _LONG:
                if len(self.parts) >= _REMEMBERED:
                    self.parts.clear()
                self.parts[part] = found
        return found

    def _word(self, word: bytes) -> bytes:
        body = word[:-1] if word[-1] in b".,;:!?" else word
        if body.isalpha():
            found = self._part(body.lower().decode())
            if body is not word:
                found += self._part(chr(word[-1]))
        else:
            text = word.decode()
            if self.plain(text) and not any(literal in text for literal in self.added):
                found = b"".join(map(self._part, self.pieces(text.lower())))
            else:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                found = array("I", ids).tobytes()
        if len(word) <= _LONG:
            if len(self.words) >= _REMEMBERED:
                self.words.clear()
            self.words[word] = found
        return found

    def encode(self, text: str) -> Iterator[bytes]:
        """The ids of a text as little-endian unsigned 32-bit numbers, in parts of bounded size."""
        data = text.encode("utf-8", "replace")
        # Case tells nothing but whether an added token is meant.
        if not any(mark in data for mark in self.marks):
            data = data.lower()
        known = self.words.get
        for words in pieces_of(data):
            yield b"".join([known(word) or self._word(word) for word in words])


@lru_cache(maxsize=2)
def _encoder(vocabulary: str, folder: str | None) -> WordEncoder:
    return WordEncoder(vocabulary, folder)


# --- codes ----------------------------------------------------------------------------


def levels_of(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]]:
    """`(chunks, bitmap, directory)` per level; the last level has neither bitmap nor directory."""
    out, rest = [], np.asarray(ids, "<u4")
    while True:
        chunks = (rest & 0xFF).astype("u1")
        more = rest > 0xFF
        if not more.any():
            out.append((chunks, None, None))
            return out
        padded = np.zeros(-(-len(more) // BLOCK) * BLOCK, "u1")
        padded[: len(more)] = more
        marks = padded.reshape(-1, BLOCK).sum(axis=1, dtype="u4")
        directory = (np.cumsum(marks, dtype="u4") - marks).astype("<u4")
        out.append((chunks, np.packbits(padded, bitorder="little"), directory))
        rest = rest[more] >> CHUNK_BITS


def ids_of(levels: list[tuple[np.ndarray, np.ndarray | None]]) -> np.ndarray:
    """All ids of a segment, from the chunks and bitmaps of its levels."""
    ids = levels[0][0].astype("<u4")
    where = None
    for depth, ((chunks, bitmap), (after, _)) in enumerate(zip(levels, levels[1:]), 1):
        marked = np.flatnonzero(np.unpackbits(bitmap, count=len(chunks), bitorder="little"))
        where = marked if where is None else where[marked]
        ids[where] |= after.astype("<u4") << np.uint32(CHUNK_BITS * depth)
    return ids


# --- files ----------------------------------------------------------------------------


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class TokenFileWriter:
    """Appends documents part by part; holds one segment in memory."""

    def __init__(self, stream, segment_ids: int = SEGMENT_IDS):
        self.stream, self.segment_ids = stream, segment_ids
        self.at = 0
        self.segments: list[tuple[int, int, int]] = []  # place, ids before, documents before
        self.tokens = self.documents = 0
        self.waiting: list[np.ndarray] = []
        self.held = 0
        self.starts: list[int] = []
        self.keys: list[bytes | None] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def begin(self, key: str | None) -> None:
        """The next document; its ids follow by `append`."""
        self.starts.append(self.held)
        self.keys.append(None if key is None else key.encode())
        # Documents of no ids must not let a segment grow either.
        if len(self.keys) > self.segment_ids:
            self._segment(self.held)

    def append(self, ids: np.ndarray) -> None:
        while len(ids):
            taken = ids[: self.segment_ids - self.held]
            self.waiting.append(taken)
            self.held += len(taken)
            ids = ids[len(taken) :]
            if self.held == self.segment_ids:
                self._segment(self.held)

    def _segment(self, count: int) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, "<u4")
        self.segments.append((self.at, self.tokens, self.documents))
        lengths = np.array([-1 if k is None else len(k) for k in self.keys], "<i4")
        levels = levels_of(ids)
        self._put(struct.pack("<II", len(self.keys), len(levels)))
        self._put(struct.pack(f"<{len(levels)}I", *(len(chunks) for chunks, _, _ in levels)))
        for chunks, bitmap, directory in levels:
            self._put(chunks.tobytes())
            if bitmap is not None:
                self._put(bitmap.tobytes())
                self._put(directory.tobytes())
        self._put(np.array(self.starts, "<u4").tobytes() + lengths.tobytes())
        self._put(b"".join(k for k in self.keys if k))
        self.tokens += count
        self.documents += len(self.keys)
        self.waiting, self.held, self.starts, self.keys = [], 0, [], []

    def close(self) -> tuple[int, int]:
        """Documents and ids of the file, which is complete now."""
        if self.held or self.keys or not self.segments:
            self._segment(self.held)
        footer = {"segments": self.segments, "tokens": self.tokens, "documents": self.documents}
        data = json.dumps(footer).encode()
        self._put(data + struct.pack("<Q", len(data)) + MAGIC)
        return self.documents, self.tokens


class TokenFile:
    """A written file: any id at once, or all documents in order."""

    def __init__(self, source):
        """`source` has `size()` and `read_at(bytes, place)`, as the files of `pyarrow.fs` have."""
        self.source = source
        size = source.size()
        tail = source.read_at(8 + len(MAGIC), size - 8 - len(MAGIC))
        if tail[8:] != MAGIC or source.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError("not a file of token codes")
        (length,) = struct.unpack("<Q", tail[:8])
        self.end = size - 8 - len(MAGIC) - length
        footer = json.loads(source.read_at(length, self.end))
        self.segments, self.tokens = footer["segments"], footer["tokens"]
        self.documents = footer["documents"]
        self._before = [before for _, before, _ in self.segments]
        self._layouts: dict[int, tuple] = {}

    def __len__(self) -> int:
        return self.tokens

    def _layout(self, segment: int) -> tuple[int, list[tuple[int, int, int, int]], int]:
        """Documents, `(count, chunks, bitmap, directory)` places per level, place of the documents."""
        if segment not in self._layouts:
            at = self.segments[segment][0]
            documents, levels = struct.unpack("<II", self.source.read_at(8, at))
            at += 8
            counts = struct.unpack(f"<{levels}I", self.source.read_at(4 * levels, at))
            at += 4 * levels
            places = []
            for depth, count in enumerate(counts, 1):
                blocks = -(-count // BLOCK) if depth < levels else 0
                places.append((count, at, at + count, at + count + blocks * BLOCK // 8))
                at += count + blocks * (BLOCK // 8 + 4)
            self._layouts[segment] = documents, places, at
        return self._layouts[segment]

    def token(self, position: int) -> int:
        """The id at a position of the file, from a few bytes of each of its levels."""
        if not 0 <= position < self.tokens:
            raise IndexError(position)
        segment = bisect.bisect_right(self._before, position) - 1
        at, value = position - self._before[segment], 0
        _, levels, _ = self._layout(segment)
        for depth, (_, chunks, bitmap, directory) in enumerate(levels):
            value |= self.source.read_at(1, chunks + at)[0] << (CHUNK_BITS * depth)
            if depth + 1 == len(levels):
                break
            block, inside = divmod(at, BLOCK)
            marks = int.from_bytes(self.source.read_at(BLOCK // 8, bitmap + block * BLOCK // 8), "little")
            if not marks >> inside & 1:
                break
            (before,) = struct.unpack("<I", self.source.read_at(4, directory + 4 * block))
            at = before + (marks & ((1 << inside) - 1)).bit_count()
        return value

    def segment(self, number: int) -> tuple[np.ndarray, np.ndarray, list[str | None]]:
        """Ids, starts and keys of a segment's documents, which is read in one go."""
        documents, levels, keys_at = self._layout(number)
        first = levels[0][1]
        last = self.segments[number + 1][0] if number + 1 < len(self.segments) else self.end
        data = self.source.read_at(last - first, first)
        parts = []
        for count, chunks, bitmap, directory in levels:
            marks = np.frombuffer(data, "u1", directory - bitmap, bitmap - first)
            parts.append((np.frombuffer(data, "u1", count, chunks - first), marks))
        at = keys_at - first
        starts = np.frombuffer(data, "<u4", documents, at)
        lengths = np.frombuffer(data, "<i4", documents, at + 4 * documents)
        at += 8 * documents
        keys = []
        for length in lengths.tolist():
            keys.append(None if length < 0 else bytes(data[at : at + length]).decode())
            at += max(length, 0)
        return ids_of(parts), starts, keys

    def pieces(self) -> Iterator[tuple[str | None, int, np.ndarray, bool]]:
        """`(key, start in the file, ids, whether they end the document)`, segment by segment."""
        key, start, waiting = None, 0, None
        for number, (_, before, _) in enumerate(self.segments):
            ids, starts, keys = self.segment(number)
            cuts = [*starts.tolist(), len(ids)]
            if waiting is not None:
                yield key, start, waiting, bool(keys) and cuts[0] == 0
                if not keys or cuts[0]:
                    waiting = ids[: cuts[0]]
                    if keys:
                        yield key, start, waiting, True
                        waiting = None
            for i, key in enumerate(keys):
                start = before + cuts[i]
                if i + 1 < len(keys):
                    yield key, start, ids[cuts[i] : cuts[i + 1]], True
                else:
                    waiting = ids[cuts[i] :]
        if waiting is not None:
            yield key, start, waiting, True


# --- the operator ---------------------------------------------------------------------


def _written(folder: str, vocabulary: str, end: int, vocabulary_folder: str | None, segment_ids: int):
    def run(batches):
        system, base = _file_system(folder)
        system.create_dir(base, recursive=True)
        encoder, last = _encoder(vocabulary, vocabulary_folder), np.array([end], "<u4")
        number = TaskContext.get().partitionId()
        name = f"part-{number:06d}-{uuid.uuid4().hex}.ids"
        stream = writer = None
        for batch in batches:
            for key, text in zip(*batch.columns):
                if writer is None:
                    stream = system.open_output_stream(f"{base}/{name}", compression=None)
                    writer = TokenFileWriter(stream, segment_ids)
                writer.begin(key.as_py())
                for ids in encoder.encode(text.as_py() or ""):
                    writer.append(np.frombuffer(ids, "<u4"))
                writer.append(last)
        if writer:
            documents, tokens = writer.close()
            stream.close()
            columns = [[f"{folder}/{name}"], [number], [documents], [tokens]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in columns], names=["path", "number", "documents", "tokens"]
            )

    return run


def write_token_files(
    docs: DataFrame,
    folder: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    vocabulary: str = VOCABULARY,
    end: int = END,
    vocabulary_folder: str | None = None,
    file_bytes: int = FILE_BYTES,
    segment_ids: int = SEGMENT_IDS,
) -> DataFrame:
    """Write the ids of all documents below `folder`, which all executors must share.

    The manifest that comes back is stored: `(path, number, documents, tokens, before)`, where
    `before` are the ids of all files of smaller number. Documents lie in ascending order of
    their id, NULL first; rows that share an id are documents of their own, in the order in which they
    are read. A NULL or blank text is the end id alone. Other columns are not read.

    A file has the texts of about `file_bytes` bytes. Texts are shuffled once, to the task that
    encodes and writes them.
    """
    text = F.col(text_column).cast("string")
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    cores = docs.sparkSession.sparkContext.defaultParallelism
    files = max(1, -(-size // file_bytes), min(cores, size // LEAST_FILE_BYTES))
    # Rows of one id are told apart by `at`, so that no id, however frequent, makes a file grow.
    rows = (
        bounded_batches(docs)
        .select(F.col(id_column).alias("id"), F.monotonically_increasing_id().alias("at"), text.alias("text"))
        .repartitionByRange(int(files), "id", "at")
        .sortWithinPartitions("id", "at")
        .select(F.col("id").cast("string").alias("key"), "text")
    )
    schema = "path string, number bigint, documents bigint, tokens bigint"
    write = _written(folder, vocabulary, end, vocabulary_folder, segment_ids)
    manifest = stored(rows.mapInArrow(write, schema), "manifest")
    # One row per file: a few hundred thousand for 100 TB.
    earlier = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("before", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)))


READ = (
    "key string, start bigint, offset bigint, last boolean, ids binary, n_tokens bigint, "
    "ids_crc32 bigint, middle_id bigint"
)


def read_token_files(manifest: DataFrame, kind: str = "bigint", with_ids: bool = True) -> DataFrame:
    """The documents of the files of a manifest, in parts of bounded size.

    `id` (cast to `kind`), `start` (ids of all documents before it), `offset` of the part in its
    document, `last`, `ids` (little-endian unsigned 32-bit numbers; NULL if not `with_ids`),
    `n_tokens` and `ids_crc32` of the document up to the end of the part, and `middle_id`, the
    id at half the length of the document up to there, read through the directories alone.
    """
    types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = [field.split()[0] for field in READ.split(", ")]

    def run(batches):
        def batch_of(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names
            )

        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, place = _file_system(path)
                with system.open_input_file(place) as source:
                    file = TokenFile(source)
                    out, size, count, crc = [], 0, 0, 0
                    for key, start, ids, last in file.pieces():
                        data = ids.tobytes()
                        crc = zlib.crc32(data, crc)
                        offset, count = count, count + len(ids)
                        middle = file.token(start + count // 2) if count else None
                        out.append((key, before + start, offset, last, data if with_ids else None, count, crc, middle))
                        size += len(data) + 100
                        if last:
                            count = crc = 0
                        if size >= 4 << 20:
                            yield batch_of(out)
                            out, size = [], 0
                    if out:
                        yield batch_of(out)

    paths = manifest.select("path", "before")
    # A number of partitions that is asked for is not merged: a file is a task of its own.
    rows = paths.repartition(max(1, min(paths.count(), MOST_TASKS))).mapInArrow(run, READ)
    return rows.withColumn("key", F.col("key").cast(kind)).withColumnRenamed("key", "id")


def round_trip(spark: SparkSession, docs: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write the documents as files, read them back, and give one row per document."""
    kind = dict(docs.dtypes)[options.get("id_column", "doc_id")]
    manifest = write_token_files(docs, folder or new_path(spark, "token-files"), **options)
    return read_token_files(manifest, kind, with_ids=False).where("last")
