"""WARC archives in Zstandard form: one frame per record, the dictionary in a leading skippable frame.

`plan_records` decides which pages are responses and which revisit an equal payload, `write_archives` writes one or
more files per task into a folder that all executors share, `read_archives` reads them back and validates each record.

A record's id holds the page's id and the payload's digest, so that a revisit can name the response to an equal payload without
looking it up; the ids of all records but one of each payload end with a number of their own, so no two records share one. A url
is read back as it was: where the target header can't hold it as it is, a header of our own does, with all but letters and digits
escaped.

Nulls: null html is an empty payload, a null url has no target header, a page without an id is written with the id
"null" and read back as null; it is a response only where no equal payload has an id. Repeated rows that share the
smallest id are each a response. Extra columns, whatever their names, are left behind. An empty table gives no files and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_in_arrow, slices

DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
LEVEL = 3
DICTIONARY_BYTES = 16 << 10
#: Records of a file that its dictionary is trained on, and bytes that each gives.
DICTIONARY_RECORDS, DICTIONARY_RECORD_BYTES = 64, 8 << 10
#: Compressed bytes after which a task starts another file.
FILE_BYTES = 64 << 20
READ_BYTES = 16 << 10
#: Tasks that read archives, at most.
MOST_TASKS = 10_000
DATE = "2020-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


class BadRecord(ValueError):
    """An archive that breaks the format."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, first_id, serial): first_id is the smallest id among equal payloads, or null for a response; serial is null for one record of each payload.

    Payloads meet by digest. The smallest ids are aggregated before the shuffle; in the join that follows only the
    pages' side can be skewed, and adaptive execution splits it.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "utf-8"))).withColumn("serial", F.monotonically_increasing_id())
    first = rows.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.min_by("serial", F.struct(F.col("page_id").isNull(), "page_id", "serial")).alias("first_serial"))
    again = (F.octet_length("html") >= min_bytes) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    own = F.when(F.col("serial") != F.col("first_serial"), F.col("serial"))
    return rows.join(first, "digest").select("page_id", "url", "html", F.when(again, F.col("first_id")).alias("first_id"), own.alias("serial"))


def record_id(page_id: int | None, digest: str, serial: int | None = None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}:{digest}{'' if serial is None else f':{serial}'}>"


def record(page_id: int | None, url: str | None, payload: bytes, first_id: int | None, serial: int | None = None) -> bytes:
    revisit, digest = first_id is not None, sha1_base32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest, serial)}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        target = quote(url, safe=":/?#[]@!$&()*+,;=%~" + chr(39), errors="surrogatepass")
        head += [f"WARC-Target-URI: {target}"] + [f"X-Page-URL: {quote(url, safe='', errors='surrogatepass')}"] * (target != url)
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(first_id, digest)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(data: bytes, what: str) -> tuple[str, dict[str, str], bytes]:
    """First line, headers by lower-case name, rest."""
    head, end, rest = data.partition(b"\r\n\r\n")
    if not end:
        raise BadRecord(f"{what}: its headers don't end")
    first, *lines = head.decode().split("\r\n")
    found = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon:
            raise BadRecord(f"{what}: a header has no colon")
        found[name.strip().lower()] = value.strip()
    return first, found, rest


def page_of(uri: str, what: str) -> int | None:
    if not (uri.startswith("<urn:x-page:") and uri.endswith(">")):
        raise BadRecord(f"{what}: {uri} isn't the id of a page")
    found = uri[12:-1].split(":")[0]
    return None if found == "null" else int(found)


def url_of(head: dict[str, str]) -> str | None:
    return unquote(head["x-page-url"], errors="surrogatepass") if "x-page-url" in head else head.get("warc-target-uri")


def parse(data: bytes) -> dict:
    """A validated record: its page, kind, payload length and digest. A revisit tells the length in its HTTP header."""
    version, head, rest = headers(data, "record")
    if version != "WARC/1.1":
        raise BadRecord(f"{version[:40]} isn't the version line")
    for name in ("warc-type", "warc-record-id", "warc-date", "warc-payload-digest", "content-length"):
        if name not in head:
            raise BadRecord(f"{name} is missing")
    kind, length = head["warc-type"], int(head["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise BadRecord(f"the block has {len(rest) - 4} bytes, {length} were announced")
    _, http, payload = headers(rest[:length], "HTTP block")
    size, digest = int(http["content-length"]), head["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        if len(payload) != size or sha1_base32(payload) != digest:
            raise BadRecord("the payload's length or digest is wrong")
    elif kind != "revisit" or payload or "warc-refers-to" not in head:
        raise BadRecord(f"a {kind} record that isn't understood")
    return {
        "page_id": page_of(head["warc-record-id"], "record"), "url": url_of(head), "payload_bytes": size, "payload_digest": digest,
        "record_type": kind, "refers_to": page_of(head["warc-refers-to"], "revisit") if kind == "revisit" else None, "payload": payload,
    }


class ArchiveWriter:
    """One file: the dictionary is trained on its first records, which wait until then."""

    def __init__(self, stream, level: int = LEVEL) -> None:
        self.stream, self.level, self.waiting, self.compressor, self.records, self.size = stream, level, [], None, 0, 0

    def put(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def start(self) -> None:
        samples = [x[:DICTIONARY_RECORD_BYTES] for x in self.waiting]
        trained = None
        if len(samples) >= 8 and sum(map(len, samples)) >= 4 * DICTIONARY_BYTES:
            try:
                trained = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8)
            except zstandard.ZstdError:  # too little that repeats; the file then has no dictionary
                trained = None
        if trained:
            packed = zstandard.ZstdCompressor(level=self.level).compress(trained.as_bytes())
            self.put(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=trained, write_checksum=True)
        for x in self.waiting:
            self.put(self.compressor.compress(x))
        self.waiting = []

    def add(self, data: bytes) -> None:
        self.records += 1
        if self.compressor is None:
            self.waiting.append(data)
            if len(self.waiting) == DICTIONARY_RECORDS:
                self.start()
        else:
            self.put(self.compressor.compress(data))

    def close(self) -> None:
        if self.compressor is None:
            self.start()
        self.stream.close()


def frames(stream, read_bytes: int = READ_BYTES) -> Iterator[bytes]:
    """The records of an archive, one frame each, through the dictionary of its leading skippable frame if there is one."""
    data, dictionary, first = stream.read(read_bytes), None, True

    def have(n: int) -> bool:
        nonlocal data
        while len(data) < n and (more := stream.read(max(read_bytes, n - len(data)))):
            data += more
        return len(data) >= n

    while have(1):
        if not have(4):
            raise BadRecord("the archive ends within a frame")
        (magic,) = struct.unpack_from("<I", data)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if not have(8) or not have(8 + (size := struct.unpack_from("<I", data, 4)[0])):
                raise BadRecord("the archive ends within a skippable frame")
            body, data = data[8 : 8 + size], data[8 + size :]
            if first and magic == DICTIONARY_MAGIC:
                plain = zstandard.ZstdDecompressor().decompress(body) if body[:4] == struct.pack("<I", FRAME_MAGIC) else body
                dictionary = zstandard.ZstdCompressionDict(plain)
            first = False
            continue
        if magic != FRAME_MAGIC:
            raise BadRecord(f"{magic:#x} starts no frame")
        if first or "context" not in locals():
            context = zstandard.ZstdDecompressor(dict_data=dictionary)
            first = False
        frame, out = context.decompressobj(), []
        while True:
            out.append(frame.decompress(data))
            if frame.eof:
                data = frame.unused_data
                break
            if not (data := stream.read(read_bytes)):
                raise BadRecord("the archive ends within a frame")
        yield b"".join(out)


def write_archives(planned: DataFrame, folder: str) -> DataFrame:
    """Write planned records below `folder`; (file, records, bytes) of each file of the attempts that succeeded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        task, name, writer = TaskContext.get(), "", None

        def done() -> pa.RecordBatch:
            writer.close()
            return pa.record_batch([[name], [writer.records], [writer.size]], ["file", "records", "bytes"])

        for batch in slices(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer is None:
                    name = f"{task.partitionId():06}-{uuid.uuid4().hex}.warc.zst"
                    writer = ArchiveWriter(fs.open_output_stream(f"{path}/{name}"))
                page_id, url, html, first_id, serial = row
                writer.add(record(page_id, url, html.encode(), first_id, serial))
                if writer.size >= FILE_BYTES:
                    yield done()
                    writer = None
        if writer is not None:
            yield done()

    return cut(map_in_arrow(planned, run, "file string, records long, bytes long"), "archive-files")


def read_archives(files: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records of the named files, validated; with `payloads`, a column `payload` holds what a response stores."""
    schema = RECORDS + ", payload binary" * payloads
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
        fs, path = pa.fs.FileSystem.from_uri(folder)

        def batch_of(found: list[dict]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([x[n] for x in found], types.get(n, pa.string())) for n in names], names)

        for batch in batches:
            for name, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, count = [], 0
                with fs.open_input_stream(f"{path}/{name}") as stream:
                    for data in frames(stream):
                        found.append(parse(data))
                        count += 1
                        if len(found) == 256:
                            yield batch_of(found)
                            found = []
                if count != records:
                    raise BadRecord(f"{name} has {count} records, {records} were written")
                if found:
                    yield batch_of(found)

    # as many tasks as files: adaptive execution would join so few rows in one task
    return map_in_arrow(files.select("file", "records").repartition(max(1, min(files.count(), MOST_TASKS)), "file"), run, schema)
