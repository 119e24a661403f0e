"""Dictionary-compressed WARC archives: writer, reader and revisit records.

Each task writes archives of its own: the first records are held back up to a fixed
size, a Zstandard dictionary is built from them and embedded in a leading skippable
frame, and every record is a frame of its own compressed with it, so a reader can
start at any record. A file is written under an attempt's name and then renamed; a
repeated task replaces it as a whole.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.links import hot_join
from folio.llm.scratch import Scratch
from folio.llm.text import binary_column

DICT_MAGIC = 0x184D2A5D  # the skippable frame of the .warc.zst format
DICT_BYTES = 32 << 10
SAMPLE_BYTES = 2 << 20
ROTATE_BYTES = 512 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "about:blank")


def _page(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, sha: str | None = None) -> bytes:
    """A response, or a revisit without its payload when refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    extra = f"WARC-Profile: {_PROFILE}\r\nWARC-Refers-To: {_page(refers_to)}\r\n" if refers_to is not None else ""
    head = (
        f"WARC/1.1\r\nWARC-Type: {'response' if refers_to is None else 'revisit'}\r\nWARC-Record-ID: {_page(page)}\r\n"
        f"WARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: {_uri(url)}\r\nWARC-Payload-Digest: sha1:{sha or digest(payload)}\r\n"
        f"{extra}Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    )
    return head.encode() + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> bytes:
    """A dictionary from the records; too few or too alike ones become its content as they are."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICT_BYTES:]


class Archive:
    """One file: the dictionary frame, then a frame for each record."""

    def __init__(self, path: str):
        self.uri = path
        self.files, self.path = fs.FileSystem.from_uri(path)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.held: list[bytes] = []
        self.held_bytes, self.size, self.records, self.out, self.zip = 0, 0, 0, None, None

    def add(self, rec: bytes) -> None:
        self.records += 1
        if self.out is not None:
            return self._write(self.zip.compress(rec))
        self.held.append(rec)
        self.held_bytes += len(rec)
        if self.held_bytes >= SAMPLE_BYTES:
            self._begin()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def _begin(self) -> None:
        raw = train(self.held)
        self.out = self.files.open_output_stream(self.part, compression=None)
        self._write(struct.pack("<II", DICT_MAGIC, len(raw)) + raw)
        self.zip = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw))
        for rec in self.held:
            self._write(self.zip.compress(rec))
        self.held = []

    def abandon(self) -> None:
        """Removes what a failed attempt has written."""
        if self.out is not None:
            self.out.close()
            self.files.delete_file(self.part)

    def close(self) -> None:
        if self.out is None:
            self._begin()
        self.out.close()
        self.files.move(self.part, self.path)


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Archives of (page_id, url, html, refers_to, sha) rows; a row (path, records) for each file. Lazy: an action writes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, done, now = f"{folder}/pages-{TaskContext.get().partitionId():06d}", [], None
        try:
            for batch in batches:
                cols = [batch.column(i) for i in range(5)]
                for page, url, html, ref, sha in zip(cols[0].to_pylist(), cols[1].to_pylist(), binary_column(batch, "html"), cols[3].to_pylist(), cols[4].to_pylist()):
                    now = now or Archive(f"{base}-{len(done):04d}.warc.zst")
                    now.add(record(page, url, html, ref, sha))
                    if now.size >= ROTATE_BYTES:
                        now.close()
                        done.append((now.uri, now.records))
                        now = None
            if now is not None:
                now.close()
                done.append((now.uri, now.records))
                now = None
        finally:
            if now is not None:
                now.abandon()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "records"])

    return pages.select("page_id", "url", "html", "refers_to", "sha").mapInArrow(run, "path string, records long")


def _parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def records(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record, one frame at a time."""
    files, path = fs.FileSystem.from_uri(path)
    with files.open_input_stream(path, compression=None) as f:
        magic, size = struct.unpack("<II", f.read(8))
        if magic != DICT_MAGIC:
            raise ValueError(f"{path} has no dictionary frame")
        box = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(f.read(size)))
        left, end = b"", False
        while True:
            one, parts, begun = box.decompressobj(), [], False
            while not one.eof:
                if not left and not end:
                    left = f.read(1 << 20)
                    end = not left
                if not left:
                    break
                begun = True
                parts.append(one.decompress(left))
                left = one.unused_data if one.eof else b""
            if not one.eof:
                if begun:
                    raise ValueError(f"{path} ends inside a record")
                return
            yield _parse(b"".join(parts))


def _id(field: str | None) -> int | None:
    x = (field or "")[10:-1]
    return int(x) if x else None


def read(files: DataFrame) -> DataFrame:
    """One row per record of the archives listed in column path."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def rows(paths: list[str]) -> Iterator[tuple]:
        for path in paths:
            for h, block in records(path):
                http, _, payload = block.partition(b"\r\n\r\n")
                kind, sha = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha1:")
                size = int(http.rpartition(b"Content-Length: ")[2])
                if kind == "response" and (len(payload) != size or digest(payload) != sha):
                    raise ValueError(f"{path}: record {h['WARC-Record-ID']} is damaged")
                yield _id(h["WARC-Record-ID"]), size, sha, kind, _id(h.get("WARC-Refers-To")), h["WARC-Target-URI"], payload if kind == "response" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(out):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[x.split()[0] for x in schema.split(", ")])

        for batch in batches:
            out, size = [], 0
            for row in rows(batch.column(0).to_pylist()):
                out.append(row)
                size += len(row[6] or b"") + 200
                if size > 8 << 20:
                    yield pack(out)
                    out, size = [], 0
            if out:
                yield pack(out)

    return files.select("path").mapInArrow(run, schema)


def with_revisits(pages: DataFrame, scratch: Scratch, at_least: int = 0) -> DataFrame:
    """Adds sha and refers_to: of equal payloads of at_least bytes or more, all but the largest page_id revisit that one.

    Only ids and digests are grouped, with partial aggregation, and a payload that many
    pages share is dealt over parts when its pages are told; the pages themselves are
    joined by page_id.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    keys = scratch.save(pages.select("page_id", F.sha1(F.col("html").cast("binary")).alias("hex"), F.octet_length("html").alias("size")).where(F.col("size") >= at_least).drop("size"), "digests")
    groups = scratch.save(keys.groupBy("hex").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1"), "payloads")
    refers = hot_join(keys, groups, ["hex"]).where(F.col("page_id") != F.col("top")).select("page_id", F.col("top").alias("refers_to")).distinct()
    return pages.join(refers, "page_id", "left").withColumn("sha", F.lit(None).cast("string"))


def archive(pages: DataFrame, folder: str, scratch: Scratch, at_least: int = 0) -> DataFrame:
    """Writes pages as WARC archives into folder and returns the list of files (path, records).

    A null html is an empty payload, a null url about:blank, a null page_id is kept and
    never refers; repeated page_ids with one payload are records of their own; an empty
    table writes no file; other columns are ignored.
    """
    rows = with_revisits(pages, scratch, at_least).repartition("page_id").sortWithinPartitions("page_id", "url")
    fs.FileSystem.from_uri(folder)[0].create_dir(fs.FileSystem.from_uri(folder)[1], recursive=True)
    return scratch.save(write(rows, folder), "archives")
