"""Figures of an indexing run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def percentiles(value: Column | str) -> Column:
    """p5, p50 and p95, interpolated; zeros of nothing."""
    return F.coalesce(F.percentile(value, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)))


def rate(part: Column, whole: Column, places: int = 2) -> Column:
    return F.when(whole > 0, F.round(part / whole, places)).otherwise(F.lit(0.0))


def run_metrics(counts: DataFrame) -> DataFrame:
    """Derived figures of rows of total_reads, indexed_reads, total_nt, indexed_nt, seconds."""
    unindexed = F.greatest(F.col("total_reads") - F.col("indexed_reads"), F.lit(0)).cast("long")
    return counts.select(
        "*",
        unindexed.alias("unindexed_reads"),
        rate(100.0 * F.col("indexed_reads"), F.col("total_reads")).alias("indexed_pct"),
        rate(100.0 * F.col("indexed_nt"), F.col("total_nt")).alias("indexed_nt_pct"),
        rate(F.col("total_reads") * 1.0, F.col("seconds")).alias("reads_per_s"),
        rate(F.col("total_nt") * 1.0, F.col("seconds")).alias("nt_per_s"),
    )


def summary_lines(row: DataFrame, prefix: str = "METRIC") -> DataFrame:
    """line: ``PREFIX key=value`` for each column of a table of one row."""
    pairs = F.array(*[F.concat(F.lit(f"{prefix} {c}="), F.col(c).cast("string")) for c in row.columns])
    return row.select(F.explode(pairs).alias("line"))
