"""Results that leave Spark as single files: joined text, images, report archives. What is collected for them is bounded
by an image's pixels or by the sequences of one request."""

from __future__ import annotations

import html
import io
import json
import struct
import zipfile
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files


def join_text(folders: list[str], path: str, block: int = 1 << 20) -> None:
    """One file, compressed as its name says, of all parts of folders of text, in order, a block at a time."""
    with files.open_writer(path) as out:
        for part in (p for f in folders for p in files.expand(f)):
            with files.open_binary(part) as stream:
                while data := stream.read(block):
                    out.write(data)


def write_matrix_file(folder: str, path: str) -> None:
    """The MatrixMarket file of what ``quant.write_matrix`` wrote to a folder."""
    join_text([f"{folder}/matrix.mtx.head", f"{folder}/matrix.mtx.entries"], path)


def pixel_array(pixels: DataFrame, nx: int, ny: int) -> np.ndarray:
    """Rows py by columns px of pixels (px, py, value); 0 where there is none."""
    out, got = np.zeros((ny, nx)), pixels.select("px", "py", "value").toPandas()
    out[got["py"].to_numpy(int), got["px"].to_numpy(int)] = got["value"].to_numpy(float)
    return out


def to_bytes(image: np.ndarray, low: float | None = None, high: float | None = None) -> np.ndarray:
    """Values between the 1st and 99th percentile, or given ends, as 0 to 255; all 0 where these are equal."""
    if image.size == 0:
        return image.astype(np.uint8)
    low = np.percentile(image, 1) if low is None else low
    high = np.percentile(image, 99) if high is None else high
    if high <= low:
        return np.zeros(image.shape, np.uint8)
    return np.round((np.clip(image, low, high) - low) * 255 / (high - low)).astype(np.uint8)


def png(image: np.ndarray) -> bytes:
    """A grey image of bytes, or one of rows by columns by 3 or 4 channels."""
    kind = {2: 0, 3: 2, 4: 6}[2 if image.ndim == 2 else image.shape[2]]
    rows = image.reshape(image.shape[0], -1)
    lines = np.hstack([np.zeros((len(rows), 1), np.uint8), rows]).tobytes()

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def tiff(layers: list[np.ndarray]) -> bytes:
    """Grey images of bytes, a page each, each a strip compressed by deflate."""
    if not layers:
        raise ValueError("a TIFF file needs a layer")
    out = bytearray(struct.pack("<2sHI", b"II", 42, 0))
    link = 4
    for image in layers:
        data, at = zlib.compress(np.ascontiguousarray(image, np.uint8).tobytes()), len(out)
        out += data + b"\0" * (len(data) % 2)
        struct.pack_into("<I", out, link, len(out))
        # Tags of width, height, bits, compression, photometric, strip offset, samples, rows a strip, strip bytes.
        tags = [(256, 4, image.shape[1]), (257, 4, image.shape[0]), (258, 3, 8), (259, 3, 8), (262, 3, 1), (273, 4, at), (277, 3, 1), (278, 4, image.shape[0]), (279, 4, len(data))]
        out += struct.pack("<H", len(tags))
        for tag, kind, value in tags:
            out += struct.pack("<HHII", tag, kind, 1, value)
        link = len(out)
        out += struct.pack("<I", 0)
    return bytes(out)


def save(data: bytes, path: str) -> None:
    fs, at = files.locate(path)
    with fs.open_output_stream(at, compression=None) as f:
        f.write(data)


def fasta_text(records: list[tuple[str, str]], width: int = 60) -> str:
    return "".join(f">{name}\n" + "".join(f"{seq[i : i + width]}\n" for i in range(0, len(seq), width)) for name, seq in records)


def summarise(scores: DataFrame) -> DataFrame:
    """group_id, n_cells, total, highest."""
    return scores.groupBy("group_id").agg(F.count("*").alias("n_cells"), F.sum("score").alias("total"), F.max("score").alias("highest"))


def report(queries: list[tuple[int, str, str]], scores: DataFrame, options: dict, log: list[str] = ()) -> bytes:
    """A ZIP archive of report.html, sequences.fasta, summary.json and log.txt. ``queries``: group_id, name, sequence; a
    group that matches no cell has zeros."""
    found = {r["group_id"]: r.asDict() for r in summarise(scores).collect()}  # a row a group of the request
    groups = {}
    for group, name, seq in queries:
        groups.setdefault(group, []).append((name, seq))
    rows = []
    for group, members in sorted(groups.items()):
        figures = found.get(group, {"n_cells": 0, "total": 0, "highest": 0})
        rows.append({"group_id": group, "names": [n for n, _ in members], "length": sum(len(s) for _, s in members), **{k: figures[k] for k in ("n_cells", "total", "highest")}})
    heads = ("group", "sequences", "length", "cells", "total", "highest")
    cell = lambda r: "".join(f"<td>{html.escape(str(x))}</td>" for x in (r["group_id"], ", ".join(r["names"]), r["length"], r["n_cells"], r["total"], r["highest"]))
    table = "<table><tr>" + "".join(f"<th>{h}</th>" for h in heads) + "</tr>" + "".join(f"<tr>{cell(r)}</tr>" for r in rows) + "</table>"
    used = "".join(f"<li>{html.escape(f'{k}: {v}')}</li>" for k, v in sorted(options.items()))
    page = f"<!doctype html><meta charset='utf-8'><title>Search report</title><h1>Search report</h1>{table}<h2>Options</h2><ul>{used}</ul>"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("report.html", page)
        z.writestr("sequences.fasta", fasta_text([(n, s) for _, n, s in queries]))
        z.writestr("summary.json", json.dumps({"options": options, "groups": rows}, indent=1, default=str))
        z.writestr("log.txt", "".join(f"{line}\n" for line in log))
    return buffer.getvalue()
