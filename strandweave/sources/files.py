"""Streams of files, plain or compressed, in any store that pyarrow reaches."""

from __future__ import annotations

import bz2
import gzip
import lzma
from collections.abc import Iterator

import pyarrow.fs

# The first bytes of compressed files.
MAGIC = {b"\x1f\x8b": "gz", b"BZh": "bz2", b"\xfd7zXZ\x00": "xz", b"\x28\xb5\x2f\xfd": "zst"}
EXTENSIONS = {"gz": "gz", "bgz": "gz", "bz2": "bz2", "xz": "xz", "zst": "zst"}


def locate(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return pyarrow.fs.LocalFileSystem(), path


def expand(path: str) -> list[str]:
    """The files of a folder in order of name, or the file itself; commas part several."""
    out = []
    for one in path.split(","):
        fs, at = locate(one)
        info = fs.get_file_info(at)
        if info.type == pyarrow.fs.FileType.NotFound:
            raise FileNotFoundError(one)
        if info.type == pyarrow.fs.FileType.Directory:
            found = sorted(f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(at)) if f.is_file and not f.base_name.startswith(("_", ".")))
            scheme = one.split("://")[0] + "://" if "://" in one else ""
            out += [scheme + f for f in found]
        else:
            out.append(one)
    return out


def compression_of(path: str, head: bytes = b"") -> str | None:
    """By extension, else by the first bytes."""
    return EXTENSIONS.get(path.rsplit(".", 1)[-1].lower()) or next((k for m, k in MAGIC.items() if head.startswith(m)), None)


def open_binary(path: str):
    """A readable stream of a file's plain bytes."""
    fs, at = locate(path)
    with fs.open_input_stream(at, compression=None) as probe:
        head = probe.read(6)
    kind, raw = compression_of(path, head), fs.open_input_stream(at, compression=None)
    if kind == "gz":
        return gzip.GzipFile(fileobj=raw)
    if kind == "bz2":
        return bz2.BZ2File(raw)
    if kind == "xz":
        return lzma.LZMAFile(raw)
    if kind == "zst":
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
    return raw


def open_writer(path: str, level: int | None = None):
    """A writable stream; compressed as the extension says. gzip and bz2 take levels 1 to 9, zstd 1 to 22."""
    fs, at = locate(path)
    kind = compression_of(path)
    if level is not None and not 1 <= level <= (22 if kind == "zst" else 9):
        raise ValueError(f"compression level {level} is out of range")
    raw = fs.open_output_stream(at, compression=None)
    if kind == "gz":
        return gzip.GzipFile(fileobj=raw, mode="wb", compresslevel=level or 6)
    if kind == "bz2":
        return bz2.BZ2File(raw, "wb", compresslevel=level or 9)
    if kind == "xz":
        return lzma.LZMAFile(raw, "wb", preset=level)
    if kind == "zst":
        import zstandard

        return zstandard.ZstdCompressor(level=level or 3).stream_writer(raw)
    return raw


def lines(stream) -> Iterator[bytes]:
    """Lines without their ends, of either kind; the last one may lack its end."""
    rest = b""
    while block := stream.read(1 << 20):
        parts = (rest + block).split(b"\n")
        rest = parts.pop()
        for x in parts:
            yield x[:-1] if x.endswith(b"\r") else x
    if rest:
        yield rest[:-1] if rest.endswith(b"\r") else rest


def fastq_records(stream) -> Iterator[tuple[str, str, str]]:
    """name, sequence, quality."""
    source = lines(stream)
    for head in source:
        if not head:
            continue
        if not head.startswith(b"@"):
            raise ValueError("a FASTQ record begins with @")
        seq, _, qual = next(source, b""), next(source, b""), next(source, b"")
        yield head[1:].decode(), seq.decode(), qual.decode()


def fasta_records(stream) -> Iterator[tuple[str, str]]:
    """header, sequence, the lines of which are joined."""
    header, parts = None, []
    for line in lines(stream):
        if line.startswith(b">"):
            if header is not None:
                yield header, "".join(parts)
            header, parts = line[1:].decode(), []
        elif header is not None:
            parts.append(line.strip().decode())
    if header is not None:
        yield header, "".join(parts)


def sequence_records(stream) -> Iterator[tuple[str, str]]:
    """header, sequence of a FASTA or a FASTQ stream, by its first character."""
    first = stream.read(1)

    class Whole:
        def __init__(self):
            self.head = first

        def read(self, n):
            head, self.head = self.head, b""
            return head + stream.read(n)

    if first == b"@":
        yield from ((name, seq) for name, seq, _ in fastq_records(Whole()))
    elif first:
        yield from fasta_records(Whole())
