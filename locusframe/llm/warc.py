"""WARC archives written from and read into a chunked record table.

The chunk table has one row per record identifier and chunk number, so a payload is never
held whole while archives are written or read: the writer appends chunk after chunk to a
gzip member per record, the reader yields the payload in chunks, each with the SHA-1 of all
bytes up to its end, and the digest of the last chunk is the payload's own.

Archives are written into the shared folder by the tasks, under a name of their attempt.
The manifest that the writing job returns names the files of the attempts that succeeded, so
files of lost or repeated tasks are never read.
"""

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm.common import bounded_batches, stored
from locusframe.storage import new_path

CHUNK_BYTES = 1 << 20
MIN_REVISIT = 1000
# Bytes of an archive after which the writer begins the next one.
ARCHIVE_BYTES = 1 << 30
# Tasks that read archives, if there are as many archives.
MOST_TASKS = 50_000
EMPTY_SHA1 = hashlib.sha1().hexdigest()


CHUNKS = (
    "record_id {kind}, url string, row bigint, chunk bigint, last boolean, data binary, digest string, bytes bigint, "
    "payload_digest string, payload_bytes bigint"
)


def chunks(
    pages: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
    with_data: bool = True,
) -> DataFrame:
    """The chunk table of the payloads, a row per record and chunk number.

    A payload is cut where it lies; `digest` and `bytes` are those of all its bytes up to the end of
    the chunk, `payload_digest` and `payload_bytes` those of the last one, by which the chunks of a record
    find its header. `row` tells repeated rows apart inside one job. `with_data=False` gives the last
    chunks alone, without data. A NULL payload is empty.
    """
    kind = dict(pages.dtypes)[id_column]
    schema = CHUNKS.format(kind=kind)
    names = [field.split()[0] for field in schema.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def digests(data: memoryview) -> Iterator[tuple[memoryview, str]]:
        state = hashlib.sha1()
        for at in range(0, max(len(data), 1), CHUNK_BYTES):
            part = data[at : at + CHUNK_BYTES]
            state.update(part)
            yield part, state.hexdigest()

    def run(batches):
        for batch in batches:
            out, held = [], 0

            def rows():
                kinds = [batch.schema.field(0).type, *types]
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

            for key, url, row, html in zip(*batch.columns):
                # The bytes of the cell are cut where they are; only chunks are copied.
                data = memoryview(html.as_buffer()) if html.is_valid else memoryview(b"")
                size, whole = len(data), None
                for _, whole in digests(data):
                    pass
                record = key.as_py(), url.as_py(), row.as_py()
                parts = digests(data) if with_data and size > CHUNK_BYTES else [(data, whole)]
                done = 0
                for chunk, (part, digest) in enumerate(parts):
                    done += len(part)
                    own = bytes(part) if with_data else None
                    out.append((*record, chunk, done == size, own, digest, done, whole, size))
                    held += len(part) if with_data else 100
                    if held >= 4 * CHUNK_BYTES:
                        yield rows()
                        out, held = [], 0
            if out:
                yield rows()

    columns = [
        F.col(id_column).alias("record_id"),
        F.col(url_column).cast("string").alias("url"),
        F.monotonically_increasing_id().alias("row"),
        F.col(html_column).cast("string").alias("html"),
    ]
    return bounded_batches(pages).select(*columns).mapInArrow(run, schema)


def records(
    pages: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
    min_revisit: int = MIN_REVISIT,
) -> DataFrame:
    """Record headers: `(record_id, url, bytes, digest, type, refers_to)` per page.

    Of equal payloads of `min_revisit` bytes or more, the one with the largest id is the
    response that the others revisit. Rows that repeat this id are all responses. A NULL id
    is the smallest; a NULL payload is empty. Ids of any type keep it.
    """
    last = chunks(pages, id_column, url_column, html_column, with_data=False)
    rows = stored(last.select("record_id", "url", "bytes", "digest"), "payloads")
    groups = (
        rows.where(F.col("bytes") >= min_revisit)
        .groupBy("digest", "bytes")
        .agg(F.max("record_id").alias("last"), F.count("*").alias("n"))
        .where((F.col("n") > 1) & F.col("last").isNotNull())
        .drop("n")
    )
    found = rows.join(groups, ["digest", "bytes"], "left")
    revisit = F.col("last").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("last"))
    return found.select(
        "record_id",
        "url",
        "bytes",
        "digest",
        F.when(revisit, "revisit").otherwise("response").alias("type"),
        F.when(revisit, F.col("last")).alias("refers_to"),
    )


# --- writing --------------------------------------------------------------------------


def _head(record, url: str | None, digest: str, size: int, kind: str, refers_to) -> bytes:
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, str(record))}>",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {0 if kind == 'revisit' else size}",
    ]
    if url is not None:
        target = "".join(c if c.isprintable() else "%{:02X}".format(ord(c)) for c in url)
        lines.insert(3, f"WARC-Target-URI: {target}")
    if record is not None:
        lines.append(f"X-Record-Key: {quote(str(record))}")
    if refers_to is not None:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"X-Refers-To-Key: {quote(str(refers_to))}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


class _Archive:
    """An archive that is being written: a gzip member per record."""

    def __init__(self, folder: str, name: str):
        self.system, base = _file_system(folder)
        self.system.create_dir(base, recursive=True)
        self.path, self.records, self.size = f"{folder}/{name}", 0, 0
        self.stream = self.system.open_output_stream(f"{base}/{name}", compression=None)
        self.member = None

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def begin(self, head: bytes) -> None:
        self.member = zlib.compressobj(6, zlib.DEFLATED, 31)
        self._put(self.member.compress(head))
        self.records += 1

    def append(self, data: bytes) -> None:
        self._put(self.member.compress(data))

    def end(self) -> None:
        self._put(self.member.compress(b"\r\n\r\n") + self.member.flush())

    def close(self) -> tuple[str, int, int]:
        self.stream.close()
        return self.path, self.records, self.size


# What the writer reads, in this order.
_WRITTEN = ["record_id", "url", "chunk", "last", "data", "payload_digest", "payload_bytes", "type", "refers_to"]


def _written(folder: str):
    """Write sorted rows, a decision before the chunks of its records; a row per archive comes back."""

    def run(batches):
        attempt = uuid.uuid4().hex
        part = TaskContext.get().partitionId()
        archive, number, done, kind, refers_to = None, 0, [], None, None
        for batch in batches:
            for record, url, chunk, last, data, digest, size, *decision in zip(*(c.to_pylist() for c in batch.columns)):
                if chunk < 0:
                    kind, refers_to = decision
                    continue
                if chunk == 0:
                    if archive and archive.size >= ARCHIVE_BYTES:
                        done.append(archive.close())
                        archive = None
                    if archive is None:
                        archive = _Archive(folder, f"part-{part:06d}-{attempt}-{number:04d}.warc.gz")
                        number += 1
                    archive.begin(_head(record, url, digest, size, kind, refers_to))
                if kind == "response":
                    archive.append(data)
                if last:
                    archive.end()
        if archive:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in zip(*done)], names=["path", "records", "size"]
            )

    return run


def write_archives(
    pages: DataFrame,
    folder: str,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
    min_revisit: int = MIN_REVISIT,
) -> DataFrame:
    """Write the pages as archives below `folder` and return the manifest, which is stored.

    The manifest has `(path, records, size)` per archive. `folder` must be a place that all
    executors share. Payloads are shuffled once, with the decision on each record.
    """
    headers = records(pages, id_column, url_column, html_column, min_revisit)
    decisions = headers.select("record_id", F.col("digest").alias("payload_digest"), "type", "refers_to").distinct()
    rows = chunks(pages, id_column, url_column, html_column).unionByName(
        decisions.withColumn("chunk", F.lit(-1).cast("bigint")), allowMissingColumns=True
    )
    # NULL comes before all row numbers, so a decision is read before its chunks.
    order = ["record_id", "payload_digest", "row", "chunk"]
    rows = bounded_batches(rows.repartition("record_id", "payload_digest").sortWithinPartitions(*order))
    return stored(rows.select(*_WRITTEN).mapInArrow(_written(folder), "path string, records bigint, size bigint"), "manifest")


# --- reading --------------------------------------------------------------------------


class _Members:
    """The bytes of an archive, inflated as they are asked for."""

    def __init__(self, stream):
        self.stream, self.buffer, self.inflater, self.raw = stream, bytearray(), None, b""

    def _more(self) -> bool:
        if not self.raw:
            self.raw = self.stream.read(CHUNK_BYTES)
            if not self.raw:
                return False
        if self.inflater is None:
            self.inflater = zlib.decompressobj(31)
        self.buffer += self.inflater.decompress(self.raw, CHUNK_BYTES)
        self.raw = self.inflater.unconsumed_tail
        if self.inflater.eof:
            self.raw, self.inflater = self.inflater.unused_data, None
        return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.buffer.find(mark)) < 0:
            if not self._more():
                return None
        found = bytes(self.buffer[:at])
        del self.buffer[: at + len(mark)]
        return found

    def take(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.buffer and not self._more():
                raise EOFError("the archive ends inside a record")
            part = bytes(self.buffer[: min(size, CHUNK_BYTES)])
            del self.buffer[: len(part)]
            size -= len(part)
            if part:
                yield part


def archive_records(stream) -> Iterator[tuple[dict, Iterator[bytes]]]:
    """Headers and payload parts of an archive's records, in order."""
    members = _Members(stream)
    while (head := members.until(b"\r\n\r\n")) is not None:
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        yield fields, members.take(int(fields["Content-Length"]))
        if b"".join(members.take(4)) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")


READ = (
    "record_id string, chunk bigint, last boolean, data binary, digest string, bytes bigint, "
    "type string, refers_to string, payload_digest string, payload_bytes bigint, url string"
)


def read_archives(manifest: DataFrame, with_data: bool = True, kind: str = "bigint") -> DataFrame:
    """The chunk table of the archives of a manifest; ids are of the type `kind`.

    `digest` and `bytes` cover the payload up to the end of the chunk; `payload_digest` and
    `payload_bytes` are those that the record states for its whole payload. A record without
    payload has one chunk of no bytes. `with_data=False` leaves `data` NULL.
    """
    names = [field.split()[0] for field in READ.split(", ")]
    kinds = {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[field.split()[1]] for field in READ.split(", ")]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names
        )

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = _file_system(path)
                out, held = [], 0
                with system.open_input_stream(place, compression=None) as stream:
                    for fields, parts in archive_records(stream):
                        key, refers = (
                            None if name not in fields else unquote(fields[name])
                            for name in ("X-Record-Key", "X-Refers-To-Key")
                        )
                        state, total, chunk = hashlib.sha1(), 0, 0
                        stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        rest = [
                            fields["WARC-Type"],
                            refers,
                            stated,
                            int(fields["X-Payload-Length"]),
                            fields.get("WARC-Target-URI"),
                        ]
                        length = int(fields["Content-Length"])
                        for part in parts:
                            state.update(part)
                            total += len(part)
                            out.append((key, chunk, total == length,
                                        part if with_data else None, state.hexdigest(), total, *rest))
                            chunk, held = chunk + 1, held + len(part)
                            if held >= 4 * CHUNK_BYTES:
                                yield batch_of(out)
                                out, held = [], 0
                        if not length:
                            out.append((key, 0, True, b"" if with_data else None,
                                        EMPTY_SHA1, 0, *rest))
                        elif state.hexdigest() != stated:
                            raise ValueError(f"record {key} does not have its stated digest")
                        if len(out) >= 5000:
                            yield batch_of(out)
                            out, held = [], 0
                if out:
                    yield batch_of(out)

    # A number of partitions that is asked for is not merged: an archive is a task of its own.
    paths = manifest.select("path")
    rows = paths.repartition(max(1, min(paths.count(), MOST_TASKS))).mapInArrow(run, READ)
    return rows.withColumns({name: F.col(name).cast(kind) for name in ("record_id", "refers_to")})


def round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write the pages as archives, read them back, and give one row per record."""
    kind = dict(pages.dtypes)[options.get("id_column", "page_id")]
    manifest = write_archives(pages, folder or new_path(spark, "archives"), **options)
    return read_archives(manifest, with_data=False, kind=kind).where("last")
