"""Barcodes of reads: lookup, counts, extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codec


def barcode_table(barcodes: DataFrame) -> DataFrame:
    """barcode, barcode_code, cell_id and whatever else there is; of a barcode that is listed twice the last id wins."""
    coded = barcodes.withColumn("barcode_code", codec.encode(F.col("barcode"))).where("barcode_code is not null")
    last = coded.groupBy("barcode_code").agg(F.max("cell_id").alias("cell_id"))
    return coded.join(last, ["barcode_code", "cell_id"], "left_semi")


def cut_barcode(reads: DataFrame, start: int, end: int, seq: str = "seq") -> DataFrame:
    """``reads`` with barcode_code of seq[start:end]; null where the read is too short or has another letter."""
    part = F.substring(F.col(seq), start + 1, end - start)
    return reads.withColumn("barcode_code", F.when(F.length(seq) >= end, codec.encode(part)))


def assign_cells(r1: DataFrame, r2: DataFrame, barcodes: DataFrame, start: int, end: int, k: int, barcode_in_r2: bool = False) -> DataFrame:
    """read_no, cell_id, seq: paired reads (read_no, seq), matched by position, whose barcode is known and whose
    sequence has at least k bases."""
    with_code, with_seq = (r2, r1) if barcode_in_r2 else (r1, r2)
    codes = cut_barcode(with_code.select("read_no", "seq"), start, end).select("read_no", "barcode_code").where("barcode_code is not null")
    known = codes.join(barcode_table(barcodes).select("barcode_code", "cell_id"), "barcode_code").select("read_no", "cell_id")
    return known.join(with_seq.select("read_no", "seq").where(F.length("seq") >= k), "read_no")


def tagged_cells(reads: DataFrame, barcodes: DataFrame, k: int, strip_suffix: bool = True) -> DataFrame:
    """cell_id, seq of reads that carry their barcode as a tag (barcode, seq), as those of BAM and SRA files do: null
    tags, all-A barcodes, unknown barcodes and short sequences go; ``-1`` at a tag's end is cut off."""
    tag = F.regexp_replace("barcode", r"-\d+$", "") if strip_suffix else F.col("barcode")
    coded = reads.select(codec.encode(tag).alias("barcode_code"), "seq").where((F.col("barcode_code") != 0) & (F.length("seq") >= k))
    return coded.join(barcode_table(barcodes).select("barcode_code", "cell_id"), "barcode_code").select("cell_id", "seq")


def bulk_cells(reads: DataFrame, cell_id: int) -> DataFrame:
    """Every read of one sample is of one cell."""
    return reads.select(F.lit(cell_id).cast("long").alias("cell_id"), "seq")


def unique_barcodes(reads: DataFrame, start: int, end: int) -> DataFrame:
    """barcode: the distinct seq[start:end] that aren't empty."""
    return reads.select(F.substring(F.col("seq"), start + 1, end - start).alias("barcode")).where("barcode != ''").distinct()


def read_counts(reads: DataFrame, assigned: DataFrame) -> DataFrame:
    """total_reads, total_nt, indexed_reads, indexed_nt, cells_seen: one row."""
    seen = reads.agg(F.count("*").alias("total_reads"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("total_nt"))
    kept = assigned.agg(F.count("*").alias("indexed_reads"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("indexed_nt"), F.count_distinct("cell_id").alias("cells_seen"))
    return seen.join(F.broadcast(kept), F.lit(True))  # one row each
