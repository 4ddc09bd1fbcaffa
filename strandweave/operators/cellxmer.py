"""Cell by k-mer, and cell by bucket of k-mers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codec
from ..functions.hashing import bucket_of


def cell_by_kmer(postings: DataFrame, k: int) -> DataFrame:
    """cell_id, feature, value: a binary matrix with the k-mers' letters as names."""
    return postings.select("cell_id", codec.decode(F.col("kmer"), k).alias("feature"), F.lit(1).cast("long").alias("value"))


def cell_by_bucket(postings: DataFrame, k: int, w: int = 16, buckets: int = 100_000) -> DataFrame:
    """cell_id, bucket, value: how many of a cell's k-mers fall into each bucket. K-mers are hashed once each, not once
    a posting."""
    named = postings.select("kmer").distinct().select("kmer", bucket_of(k, w, buckets)("kmer").alias("bucket"))
    return postings.join(named, "kmer").groupBy("cell_id", "bucket").agg(F.count("*").alias("value"))


def zero_based(cells: DataFrame, n_cells: int, has_coordinates: bool) -> DataFrame:
    """Whitelist ids from 1 to n become 0 to n - 1; ids of cells with coordinates, or beyond n, stay."""
    if has_coordinates:
        return cells
    low, high = cells.agg(F.min("cell_id"), F.max("cell_id")).first()
    return cells.withColumn("cell_id", F.col("cell_id") - 1) if low is not None and low >= 1 and high <= n_cells else cells
