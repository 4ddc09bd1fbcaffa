"""Records of BAM files, after the public specification: BGZF is gzip in many members, of which records are a stream."""

from __future__ import annotations

import struct
from collections.abc import Iterator

# Fixed values of the format: the letters of four-bit codes, and the sizes of numeric tag values.
LETTERS = "=ACMGRSVTWYHKDBN"
SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_PAIRS = [LETTERS[b >> 4] + LETTERS[b & 15] for b in range(256)]
_HEAD = struct.Struct("<iiBBHHHiiii")


def _exactly(stream, n: int) -> bytes:
    out = b""
    while len(out) < n:
        part = stream.read(n - len(out))
        if not part:
            break
        out += part
    return out


def _text_tags(data: bytes, at: int) -> dict[str, str]:
    """The tags of a record that hold text."""
    out = {}
    while at < len(data):
        tag, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(0, at)
            if kind == "Z":
                out[tag] = data[at:end].decode()
            at = end + 1
        elif kind == "B":
            at += 5 + SIZES[chr(data[at])] * struct.unpack_from("<i", data, at + 1)[0]
        else:
            at += SIZES[kind]
    return out


def records(stream) -> Iterator[tuple[str | None, dict[str, str]]]:
    """Sequence, null if it isn't stored, and text tags of each record of the plain bytes of a BAM file."""
    if _exactly(stream, 4) != b"BAM\1":
        raise ValueError("not a BAM file")
    number = lambda: struct.unpack("<i", _exactly(stream, 4))[0]
    _exactly(stream, number())
    for _ in range(number()):
        _exactly(stream, number() + 4)
    while size := _exactly(stream, 4):
        data = _exactly(stream, struct.unpack("<i", size)[0])
        _, _, name, _, _, cigar, _, length, _, _, _ = _HEAD.unpack_from(data)
        at = _HEAD.size + name + 4 * cigar
        packed = (length + 1) // 2
        seq = "".join([_PAIRS[b] for b in data[at : at + packed]])[:length]
        yield seq or None, _text_tags(data, at + packed + length)
