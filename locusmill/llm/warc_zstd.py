"""WARC archives in Zstandard frames, written and read by Spark tasks.

An archive starts with a skippable frame that holds the dictionary, followed by one frame for
each record. The reader loads the dictionary, decodes frame by frame from a stream, and checks
version, headers, lengths, the record's end and the digests. Writers train the dictionary of each
archive on its own first records (at most ``SAMPLE_BYTES``) and roll over at ``ARCHIVE_BYTES``.

Every attempt of a task writes archives under names of its own; the manifest, written by Spark's
committer, names only those of attempts that count. Files go to a folder that all executors see.

Of records with equal payloads of at least ``LEAST_REVISIT`` bytes the one with the smallest id
is a response and the others revisit it. The join on the digest is one whose large partitions
Spark splits.

Defined cases: a null payload is empty; equal rows (same id) are both responses; a record with a
null id never wins over one with an id; a null URL is written as an empty header; an empty table
gives empty results; other columns are never read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusmill.llm.scratch import in_arrow, saved

#: Fixed values of the format.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

LEAST_REVISIT = 100
SAMPLE_BYTES = 1 << 20
DICTIONARY_BYTES = 32 << 10
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 18
LEVEL = 6

_URN = "urn:page:"
_RESULT = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
           ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("payload", pa.binary())]


class WarcError(ValueError):
    """An archive that breaks the format."""


def _urn(key: int | None) -> str:
    return f"<{_URN}{'' if key is None else key}>"


def _key(urn: str) -> int | None:
    if not (urn.startswith(f"<{_URN}") and urn.endswith(">")):
        raise WarcError(f"not a record id: {urn!r}")
    return int(urn[len(_URN) + 1 : -1]) if urn[len(_URN) + 1 : -1] else None


def _one_line(value: str) -> str:
    return "".join(c if c > "\x1f" and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record_bytes(key: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    """A whole record. A revisit keeps the HTTP header, and with it the payload's length, alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    headers = {
        "WARC-Type": "revisit" if is_revisit else "response",
        "WARC-Record-ID": _urn(key),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": _one_line(url or ""),
        "Content-Type": "application/http;msgtype=response",
        "WARC-Payload-Digest": f"sha256:{hashlib.sha256(payload).hexdigest()}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Length": str(len(block)),
    }
    if is_revisit:
        headers |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": _urn(refers_to)}
    head = "".join(f"{name}: {value}\r\n" for name, value in headers.items())
    return f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def _headers(lines: list[bytes]) -> dict[str, str]:
    found: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"not a header: {line[:80]!r}")
        if name.lower() in found:
            raise WarcError(f"header {name} comes twice")
        found[name.lower()] = value.strip()
    return found


def parse_record(data: bytes) -> dict:
    """The fields of a whole record; raises WarcError where the record breaks the format."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not gap or first.decode("latin-1") != VERSION:
        raise WarcError(f"not a record: {data[:40]!r}")
    headers = _headers(lines)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest", "warc-block-digest"):
        if name not in headers:
            raise WarcError(f"no header {name}")
    if not headers["content-length"].isdigit():
        raise WarcError(f"not a length: {headers['content-length']!r}")
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"block of {len(rest) - 4} bytes, length says {length}")
    block = rest[:length]
    if headers["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise WarcError("block doesn't match its digest")
    http, gap, payload = block.partition(b"\r\n\r\n")
    status, *lines = http.split(b"\r\n")
    said = _headers(lines).get("content-length", "")
    if not gap or not status.startswith(b"HTTP/1.1 ") or not said.isdigit():
        raise WarcError("block isn't an HTTP response with a length")
    kind, digest = headers["warc-type"], headers["warc-payload-digest"]
    if kind == "response":
        if len(payload) != int(said) or digest != f"sha256:{hashlib.sha256(payload).hexdigest()}":
            raise WarcError("payload doesn't match its length or digest")
    elif kind != "revisit" or payload or headers.get("warc-profile") != REVISIT_PROFILE or "warc-refers-to" not in headers:
        raise WarcError(f"not a record type that is written here: {kind}")
    return {
        "page_id": _key(headers["warc-record-id"]), "payload_bytes": int(said), "payload_digest": digest.removeprefix("sha256:"),
        "record_type": kind, "refers_to": _key(headers["warc-refers-to"]) if kind == "revisit" else None,
        "target_uri": headers.get("warc-target-uri", ""), "payload": payload if kind == "response" else None,
    }


def trained(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary, or None where there are too few samples for one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:
        return None


def dictionary_frame(dictionary: zstandard.ZstdCompressionDict | None) -> bytes:
    """The leading skippable frame; its content is itself compressed."""
    content = zstandard.ZstdCompressor().compress(dictionary.as_bytes()) if dictionary else b""
    return struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content


def archive_frames(stream) -> Iterator[bytes]:
    """Decoded records of an archive read from ``stream``, one frame at a time."""
    head = stream.read(8)
    if len(head) != 8:
        raise WarcError("no leading frame")
    magic, length = struct.unpack("<II", head)
    if magic != DICTIONARY_MAGIC:
        raise WarcError(f"leading frame has magic {magic:#x}")
    content = stream.read(length)
    if len(content) != length:
        raise WarcError("the dictionary is cut off")
    if content.startswith(FRAME_MAGIC):
        content = zstandard.ZstdDecompressor().decompress(content)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content) if content else None)
    left = b""
    while True:
        left = left or stream.read(CHUNK)
        if not left:
            return
        frame, parts = reader.decompressobj(), []
        while True:
            try:
                parts.append(frame.decompress(left))
            except zstandard.ZstdError as e:
                raise WarcError(f"not a frame: {e}") from e
            if frame.eof:
                left = frame.unused_data
                break
            if not (left := stream.read(CHUNK)):
                raise WarcError("the last frame is cut off")
        yield b"".join(parts)


class _Archives:
    """Archives of one task attempt."""

    def __init__(self, folder: str) -> None:
        self._fs, self._folder = fs.FileSystem.from_uri(folder)
        self._uri = folder
        self._fs.create_dir(self._folder, recursive=True)
        self._waiting: list[bytes] = []
        self._waiting_bytes = 0
        self._out = None
        self.done: list[tuple[str, int, int]] = []

    def add(self, record: bytes) -> None:
        if self._out is None:
            self._waiting.append(record)
            self._waiting_bytes += len(record)
            if self._waiting_bytes >= SAMPLE_BYTES:
                self._open()
        else:
            self._write(record)

    def _open(self) -> None:
        dictionary = trained([r[:CHUNK] for r in self._waiting])
        self._frames = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True, write_content_size=True)
        self._name, self._count = f"{uuid.uuid4().hex}.warc.zst", 0
        self._out = self._fs.open_output_stream(f"{self._folder}/{self._name}")
        self._bytes = self._out.write(head := dictionary_frame(dictionary)) or len(head)
        waiting, self._waiting, self._waiting_bytes = self._waiting, [], 0
        for record in waiting:
            self._write(record)

    def _write(self, record: bytes) -> None:
        frame = self._frames.compress(record)
        self._out.write(frame)
        self._bytes += len(frame)
        self._count += 1
        if self._bytes >= ARCHIVE_BYTES:
            self._close()

    def _close(self) -> None:
        self._out.close()
        self._out = None
        self.done.append((f"{self._uri}/{self._name}", self._count, self._bytes))

    def finish(self) -> list[tuple[str, int, int]]:
        if self._waiting:
            self._open()
        if self._out is not None:
            self._close()
        return self.done


def records_of(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """page_id, url, payload binary, refers_to, is_revisit."""
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    rows = pages.select(F.col(key).cast("bigint").alias("page_id"), F.col(url).alias("url"), body.alias("payload"))
    digest = F.when(F.octet_length("payload") >= LEAST_REVISIT, F.unhex(F.sha2("payload", 256)))
    rows = rows.withColumn("digest", digest)
    groups = rows.where("digest is not null").groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = groups.where("n > 1 and first is not null").drop("n")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(groups, "digest", "left").select(
        "page_id", "url", "payload", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("is_revisit")
    )


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes archives below ``folder``; the manifest has path, records and bytes of each."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives = _Archives(folder)
        for batch in batches:
            columns = [batch.column(n) for n in ("page_id", "url", "payload", "refers_to", "is_revisit")]
            for row in zip(*columns, strict=True):
                archives.add(record_bytes(*(value.as_py() for value in row)))
        done = archives.finish()
        kinds = (pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], ["path", "records", "bytes"])

    return saved(in_arrow(records, write, "path string, records bigint, bytes bigint"), "warc-manifest")


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """One row per record of the archives that the manifest lists, checked while they are read."""
    fields = _RESULT if payloads else _RESULT[:-1]
    schema = pa.schema(fields)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, name = fs.FileSystem.from_uri(path)
                rows, size, count = [], 0, 0
                with system.open_input_stream(name) as stream:
                    for data in archive_frames(stream):
                        rows.append(row := parse_record(data))
                        count += 1
                        size += len(row["payload"] or b"") if payloads else 100
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if count != expected:
                    raise WarcError(f"{path} has {count} records; the manifest says {expected}")
                yield pa.RecordBatch.from_pylist(rows, schema)

    ddl = ", ".join(f"{n} {({pa.int64(): 'bigint', pa.string(): 'string', pa.binary(): 'binary'})[k]}" for n, k in fields)
    archives = max(1, manifest.count())
    return in_arrow(manifest.select("path", "records").repartition(min(archives, 10_000)), read, ddl)
