"""Incremental ingest of reads into an index.

K-mers are cut without state and each micro-batch appends its distinct postings to a folder of its own, so that a batch
that is run again replaces itself. Reading makes them distinct across batches; ``compact`` does so once and for all. The
state of the stream is nothing but its checkpoint; a stateful distinct would hold the whole index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import postings as P


def start_ingest(reads: DataFrame, path: str, k: int, checkpoint: str, overlapping: bool = False, once: bool = True) -> StreamingQuery:
    """``reads``: a streaming DataFrame of cell_id, seq."""

    def append(batch: DataFrame, number: int) -> None:
        P.build_postings(batch, k, overlapping).write.mode("overwrite").parquet(f"{path}/landed/batch={number}")

    writer = reads.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def landed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/landed").select("kmer", "cell_id").distinct()


def compact(spark: SparkSession, path: str, out: str, meta: dict | None = None) -> None:
    """Makes an index of all that has landed."""
    P.write_index(landed(spark, path), out, meta)
