"""WARC archives as seekable Zstandard bundles.

Each task writes bundles of its own: records are grouped into independent Zstandard frames, and a seek table, itself a
skippable frame, closes the file. An index maps each record to its bundle, frame, and place in the frame.
"""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import filled, new_folder, staged

#: Bytes of records in a frame, and of frames in a bundle, at which the next one begins.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 1 << 28
#: Shorter payloads are never revisits.
LEAST_REVISIT = 100
# Fixed values of the seekable format: magic numbers of the skippable frame and of its footer; the revisit profile.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX_SCHEMA = "page_id long, bundle string, frame int, frame_offset long, record_offset long, record_bytes long"
RECORD_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record whose block is an HTTP response; a revisit's block has only the HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "%" and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes, at: int) -> tuple[dict[str, str], int]:
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")[1:]
    return dict(x.split(": ", 1) for x in lines), end + 4


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at an offset of a frame, and where the next one begins."""
    from urllib.parse import unquote

    head, start = _headers(data, at)
    length = int(head["Content-Length"])
    http, body = _headers(data, start)
    number = lambda s: int(s) if (s := s[len("<urn:page:") : -1]) else None
    out = {"page_id": number(head["WARC-Record-ID"]), "url": unquote(head["WARC-Target-URI"]) if "WARC-Target-URI" in head else None, "record_type": head["WARC-Type"]}
    out |= {"refers_to": number(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None, "payload_bytes": int(http["Content-Length"])}
    if out["record_type"] == "revisit":
        out |= {"payload": None, "payload_digest": head["WARC-Payload-Digest"].removeprefix("sha256:")}
    else:
        payload = data[body : start + length]
        out |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}
    return out, start + length + 4


class BundleWriter:
    """Writes frames and, at the end, the seek table."""

    def __init__(self, stream):
        self.stream, self.table, self.written = stream, [], 0
        self.packer = zstandard.ZstdCompressor(level=3, write_content_size=True)

    def frame(self, data: bytes) -> int:
        """The offset of the new frame."""
        packed, at = self.packer.compress(data), self.written
        self.stream.write(packed)
        self.table.append((len(packed), len(data)))
        self.written += len(packed)
        return at

    def close(self) -> None:
        entries = b"".join(struct.pack("<II", *x) for x in self.table)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + 9) + entries + struct.pack("<IBI", len(self.table), 0, SEEKABLE_MAGIC))
        self.stream.close()


def seek_table(stream) -> list[tuple[int, int, int]]:
    """(offset, packed bytes, bytes) of each frame of a bundle."""
    size = stream.size()
    stream.seek(size - 9)
    count, _, magic = struct.unpack("<IBI", stream.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("the bundle has no seek table")
    stream.seek(size - 9 - 8 * count)
    table, at = [], 0
    for packed, plain in struct.iter_unpack("<II", stream.read(8 * count)):
        table.append((at, packed, plain))
        at += packed
    return table


def read_frame(stream, table: list[tuple[int, int, int]], frame: int) -> bytes:
    at, packed, plain = table[frame]
    stream.seek(at)
    return zstandard.ZstdDecompressor().decompress(stream.read(packed), max_output_size=plain)


def read_record(bundle: str, frame: int, record_offset: int) -> dict:
    """One record, by its place in the index: reads the seek table and one frame."""
    fs, path = pyarrow.fs.FileSystem.from_uri(bundle)
    with fs.open_input_file(path) as stream:
        return parse(read_frame(stream, seek_table(stream), frame), record_offset)[0]


def _write(folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES):
    def run(batches):
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        # an attempt that is repeated writes other files; only those that the index names count
        stem = f"bundle-{task.partitionId():06d}-{task.taskAttemptId()}"
        number, writer, name, buffer, size, waiting, index = 0, None, "", [], 0, [], []

        def flush():
            nonlocal writer, name, buffer, size, waiting, number
            if buffer:
                if writer is None:
                    name = f"{stem}-{number}.warc.zst"
                    writer = BundleWriter(fs.open_output_stream(f"{root}/{name}", compression=None))
                frame = len(writer.table)
                at = writer.frame(b"".join(buffer))
                index.extend((i, f"{folder}/{name}", frame, at, o, n) for i, o, n in waiting)
                buffer, size, waiting = [], 0, []

        def finish():
            nonlocal writer, number, index
            flush()
            if writer is not None:
                writer.close()
                writer, number = None, number + 1
            rows, index = index, []
            for start in range(0, len(rows), 10_000):
                cols = list(zip(*rows[start : start + 10_000], strict=True))
                types = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in INDEX_SCHEMA.split(", ")])

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to", "revisit")), strict=True):
                page_id, url, html, digest, refers_to, revisit = (x.as_py() for x in row)
                data = record(page_id, url, html.encode(), digest, refers_to, revisit)
                waiting.append((page_id, size, len(data)))
                buffer.append(data)
                size += len(data)
                if size >= frame_bytes:
                    flush()
                    if writer.written >= bundle_bytes:
                        yield from finish()
        yield from finish()

    return run


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, digest, refers_to: the pages whose payload of LEAST_REVISIT bytes or more has a smaller page_id too.

    Only ids and digests are shuffled. Rows without an id count as after all others.
    """
    slim = staged(pages.where(F.octet_length("html") >= LEAST_REVISIT).select("page_id", F.sha2("html", 256).alias("digest")), "payloads")
    first = staged(slim.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n"), "first")
    return slim.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes a record for each row of ``pages`` (page_id, url, html) and returns the index, a table of INDEX_SCHEMA.

    Null html is an empty payload, of any length that fits a row: a longer text than FRAME_BYTES is a frame of its own.
    Further columns, whatever their names, are not looked at. Of equal payloads of LEAST_REVISIT bytes or more, the row of the smallest page_id is a
    response and the others refer to it; rows that repeat that page_id are responses too. No pages give an empty index.
    Pages are written where they are read: they are joined to the revisits, which are a fraction of them, and Spark
    broadcasts these only if they are small. The folder is one that all executors share.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "archives")
    rows = pages.select("page_id", "url", filled("html").alias("html"))
    again = staged(revisits(rows), "revisits").select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to")
    keyed = rows.withColumn("digest", F.sha2("html", 256))
    joined = keyed.join(again, keyed["page_id"].eqNullSafe(again["_id"]) & (keyed["digest"] == again["_digest"]), "left")
    ready = joined.select("page_id", "url", "html", "digest", "refers_to", F.col("_digest").isNotNull().alias("revisit"))
    return staged(ready.mapInArrow(_write(folder), INDEX_SCHEMA), "index")


def _read(payloads: bool):
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def run(batches):
        for batch in batches:
            for bundle in batch.column("bundle").to_pylist():
                fs, path = pyarrow.fs.FileSystem.from_uri(bundle)
                with fs.open_input_file(path) as stream:
                    table = seek_table(stream)
                    for k in range(len(table)):
                        data, at, found = read_frame(stream, table, k), 0, []
                        while at < len(data):
                            one, at = parse(data, at)
                            found.append(one if payloads else one | {"payload": None})
                        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], t) for c, t in zip(names, types, strict=True)], names=names)

    return run


def read_archives(index: DataFrame, payloads: bool = True) -> DataFrame:
    """All records, of RECORD_SCHEMA, of the bundles that an index names: in as many tasks as there are bundles, each read
    frame by frame. The payload of a revisit, and without ``payloads`` of any record, is null; lengths and digests are
    always given. An empty index gives no records."""
    bundles = index.select("bundle").distinct()
    # a given number keeps these few short rows from being merged into one task: each is a whole archive
    bundles = bundles.repartition(max(bundles.count(), 1), F.xxhash64("bundle"))
    return bundles.mapInArrow(_read(payloads), RECORD_SCHEMA)
