"""Exact deduplication over counting quotient filters.

A 64-bit fingerprint of each normalised text is split into slice, quotient and remainder. Each partition builds counting
quotient filters of its own fingerprints, one a slice: per quotient a sorted run of remainders with counts, encoded as
occupied bits, run-end bits, remainders and counters. The quotient has as many bits as the filter's number of entries
asks for. The filters of a slice are merged by their sorted remainders, which loses nothing: counts add up. Only the texts
of fingerprints whose count is above one are read again and compared byte by byte; all other rows are known to be alone.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, filled, join_by_size, row_key, staged

#: Fingerprints that one merged slice should hold.
SLICE_ROWS = 1 << 22
#: The seed that F.xxhash64 uses.
SEED = 42
#: Entries that a filter has at most for each quotient.
LOAD = 0.95
_HEAD = struct.Struct("<QIBB")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def encode_filter(prints: np.ndarray, counts: np.ndarray, top: int = 0) -> bytes:
    """Sorted distinct fingerprints that share their ``top`` high bits, and their counts, as a counting quotient filter.

    Layout: the shared bits, entries, ``top``, quotient bits; occupied bits (one a quotient), run-end bits (one an
    entry), remainders in whole bytes, counters. A counter is one byte; 255 says that the full one is in the list at
    the end.
    """
    n = len(prints)
    width = max(int(n / LOAD).bit_length(), 1)  # load above 0.47
    low = 64 - top - width
    quotients = (prints >> np.uint64(low)) & np.uint64((1 << width) - 1)
    remainders = prints & np.uint64((1 << low) - 1)
    occupied = np.zeros(1 << width, np.uint8)
    occupied[quotients.astype(np.int64)] = 1
    ends = np.append(quotients[1:] != quotients[:-1], True)
    small = np.minimum(counts, 255).astype(np.uint8)
    parts = [
        _HEAD.pack(int(prints[0]) >> (64 - top), n, top, width),
        np.packbits(occupied).tobytes(),
        np.packbits(ends).tobytes(),
        np.ascontiguousarray(remainders.astype("<u8").view(np.uint8).reshape(n, 8)[:, : (low + 7) // 8]).tobytes(),
        small.tobytes(),
        counts[small == 255].astype("<i8").tobytes(),
    ]
    return b"".join(parts)


def decode_filter(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted fingerprints and counts."""
    shared, n, top, width = _HEAD.unpack_from(data)
    low, at = 64 - top - width, _HEAD.size

    def take(size: int, of=np.uint8) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, of, size, at)
        at += out.nbytes
        return out

    places = np.flatnonzero(np.unpackbits(take(((1 << width) + 7) // 8), count=1 << width)).astype(np.uint64)
    ends = np.unpackbits(take((n + 7) // 8), count=n)
    quotients = places[np.cumsum(ends, dtype=np.int64) - ends]
    size = (low + 7) // 8
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :size] = take(n * size).reshape(n, size)
    remainders = wide.view("<u8").ravel()
    counts = take(n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<i8", -1, at)
    return np.uint64(shared << (64 - top) if top else 0) | quotients << np.uint64(low) | remainders, counts


def merge_filters(filters: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted run of fingerprints with added counts; a stable sort merges the sorted runs."""
    pairs = [decode_filter(x) for x in filters]
    prints, counts = np.concatenate([p for p, _ in pairs]), np.concatenate([c for _, c in pairs])
    order = np.argsort(prints, kind="stable")
    prints, counts = prints[order], counts[order]
    starts = np.flatnonzero(np.append(True, prints[1:] != prints[:-1]))
    return prints[starts], np.add.reduceat(counts, starts)


def _digests(batches):
    """doc_id, key and text to the fingerprint and the SHA-256 of the normalised text."""
    for batch in batches:
        prints, hashes = [], []
        for value in batch.column("text").cast(pa.binary()).to_pylist():
            norm = value.lower()  # of bytes: A-Z only
            prints.append(xxhash.xxh64_intdigest(norm, SEED))
            hashes.append(hashlib.sha256(norm).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("key"), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(hashes, pa.string())], names=["doc_id", "key", "print", "text_sha256"]
        )


def _slices(bits: int):
    def build(batches):
        found = [b.column("print").to_numpy().view(np.uint64) for b in batches]
        if not found:
            return
        prints, counts = np.unique(np.concatenate(found), return_counts=True)
        owner = prints >> np.uint64(64 - bits)
        cuts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(prints) else []
        for a, b in zip(cuts, [*cuts[1:], len(prints)], strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([int(owner[a])], pa.int64()), pa.array([encode_filter(prints[a:b], counts[a:b], bits)], pa.binary())], names=["slice", "filter"])

    return build


def _repeated(batches):
    for batch in batches:
        for filters in batch.column("filters").to_pylist():
            prints, counts = merge_filters(filters)
            many = counts > 1
            yield pa.RecordBatch.from_arrays([pa.array(prints[many].view(np.int64)), pa.array(counts[many])], names=["print", "n"])


def repeated_fingerprints(prints: DataFrame, rows: int) -> DataFrame:
    """print, n: the fingerprints in column ``print`` (long) that occur more than once.

    Slices follow the fingerprints' high bits, which are uniform, and hold a fingerprint once for each partition however
    often it occurs there: a hot text doesn't make a hot slice. Their number grows with ``rows``, so a slice's size
    does not.
    """
    bits = max(6, (max(rows, 1) // SLICE_ROWS).bit_length())
    slices = prints.select("print").mapInArrow(_slices(bits), "slice long, filter binary")
    merged = slices.groupBy("slice").agg(F.collect_list("filter").alias("filters"))
    return merged.select("filters").mapInArrow(_repeated, "print long, n long")


def normalised(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def equal_texts(docs: DataFrame, many: DataFrame) -> DataFrame:
    """print, text_sha256, keep_id, group_size: the groups of two or more texts, equal byte by byte, among those whose
    fingerprint is in ``many`` (print).

    Texts are read again and grouped by their bytes, with partial sums, so that a hot text is a row a partition. Two
    groups of one digest would be a collision of SHA-256; that is an error.
    """
    norm = normalised(filled())
    again = docs.select("doc_id", F.xxhash64(norm).alias("print"), norm.alias("norm")).join(many, "print", "left_semi")
    groups = again.groupBy("print", "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    named = groups.select("print", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    one = F.when(F.count("*") > 1, F.raise_error(F.lit("two texts have one digest")).cast("long")).otherwise(F.max("keep_id"))
    return named.groupBy("print", "text_sha256").agg(one.alias("keep_id"), F.max("group_size").alias("group_size"))


def dedup_exact(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, key: one row for each row of ``docs`` (doc_id, text).

    Texts, of any length, are equal if their bytes are, after A-Z are lower-cased; a null text counts as empty. Of equal
    texts the row with the largest doc_id stays. Rows without an id stay only where their group has no id at all
    (keep_id is null there). Rows that repeat both id and text are one document, and are kept or not together. Other
    columns of the input are not looked at, whatever their names. An empty input gives an empty result. ``key`` tells
    rows apart that have one id but different texts.
    """
    rows = docs.select("doc_id", row_key().alias("key"), filled().alias("text"))
    table = staged(rows.mapInArrow(_digests, "doc_id long, key long, print long, text_sha256 string"), "digests")
    total = table.count()
    many = staged(repeated_fingerprints(table, total), "repeated")
    groups = staged(equal_texts(docs, many.select("print")), "groups")
    discard(many)
    out = join_by_size(table, groups, ["print", "text_sha256"], "group_size", total)
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
        "key",
    )


def without(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``marks`` (doc_id, key) names. Row by row, whatever their number; both may be empty."""
    gone = marks.select(F.col("doc_id").alias("_gone_id"), F.col("key").alias("_gone_key"))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone_id"]) & (row_key(docs["text"]) == gone["_gone_key"]), "left_anti")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with one row for each group of equal texts, as ``dedup_exact`` says; rows that repeat id and
    text become one."""
    found = staged(dedup_exact(docs), "kept")
    again = staged(found.where("kept and group_size > 1").groupBy("doc_id", "key").count().where("count > 1").select("doc_id", "key"), "again")
    out = without(docs, found.where("not kept").select("doc_id", "key").union(again))
    twice = again.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
    once = docs.join(twice, docs["doc_id"].eqNullSafe(twice["_id"]) & (row_key(docs["text"]) == twice["_key"]), "left_semi")
    named = once.withColumn("_one", row_key()).dropDuplicates(["doc_id", "_one"]).select(*[once[c] for c in docs.columns])
    return out.union(named)
