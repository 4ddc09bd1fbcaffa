"""Pseudo-quantification of reference sequences, and the background model of their k-mers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import postings as P
from . import search


#: Record numbers of one block have these low bits.
BLOCK_BITS = 16


def gene_runs(records: DataFrame) -> DataFrame:
    """``records`` (record_no, header, seq) with gene and run: consecutive records of one gene are one run.

    A gene is what the header has before its first colon. Runs are counted within blocks of record numbers, on top of how
    many begin in the blocks before; only a row a block, with its first and last gene, meets in one window.
    """
    named = records.select("record_no", F.substring_index("header", ":", 1).alias("gene")).withColumn("block", F.shiftright("record_no", BLOCK_BITS))
    order = Window.partitionBy("block").orderBy("record_no")
    changes = F.when((F.row_number().over(order) == 1) | F.lag("gene").over(order).eqNullSafe(F.col("gene")), 0).otherwise(1)
    marked = named.withColumn("new", changes)
    blocks = marked.groupBy("block").agg(F.min_by("gene", "record_no").alias("first"), F.max_by("gene", "record_no").alias("last"), F.sum("new").alias("n"))
    along = Window.orderBy("block")
    begins = F.when((F.row_number().over(along) > 1) & F.lag("last").over(along).eqNullSafe(F.col("first")), 0).otherwise(1)
    begun = blocks.select("block", "n", begins.alias("begins"))
    starts = begun.select("block", (F.sum(F.col("n") + F.col("begins")).over(along) - F.col("n")).alias("at"))
    runs = marked.withColumn("own", F.sum("new").over(order)).join(starts, "block").select("record_no", "gene", (F.col("at") + F.col("own")).alias("run"))
    return records.drop("gene", "run").join(runs, "record_no")


def background_model(records: DataFrame, k: int) -> DataFrame:
    """kmer, n_genes: in how many gene runs each k-mer, at any place, occurs."""
    runs = gene_runs(records).select("run", "seq")
    return P.kmers_of(runs, k, overlapping=True).distinct().groupBy("kmer").agg(F.count("*").alias("n_genes"))


def quantify(records: DataFrame, postings: DataFrame, stats: DataFrame, k: int, sliding_size: int, **options) -> tuple[DataFrame, DataFrame]:
    """matrix (cell_id, feature, value) and features (feature, gene): a column for each gene run that has a record of at
    least sliding_size + k bases, numbered from 1 in order."""
    runs = gene_runs(records).where(F.length("seq") >= sliding_size + k)
    kept = runs.groupBy("run").agg(F.first("gene").alias("gene"))
    features = kept.select("run", "gene", F.row_number().over(Window.orderBy("run")).cast("long").alias("feature"))
    queries = runs.join(features.select("run", "feature"), "run").select(F.col("feature").alias("group_id"), "seq")
    scores = search.where(queries, postings, stats, k, sliding_size, **options)
    return scores.select("cell_id", F.col("group_id").alias("feature"), F.col("score").alias("value")), features.select("feature", "gene")


def matrix_shape(matrix: DataFrame, features: DataFrame, n_cells: int) -> DataFrame:
    """n_cells, n_features, nnz."""
    nnz, columns = matrix.agg(F.count("*").alias("nnz")), features.agg(F.count("*").alias("n_features"))
    return columns.join(F.broadcast(nnz), F.lit(True)).select(F.lit(n_cells).cast("long").alias("n_cells"), "n_features", "nnz")  # one row each


def mtx_lines(matrix: DataFrame, id_base: int = 0) -> DataFrame:
    """line: ``row column value``, rows counted from 1."""
    return matrix.select(F.concat_ws(" ", (F.col("cell_id") - id_base + 1).cast("string"), F.col("feature").cast("string"), F.col("value").cast("string")).alias("line"))


def write_matrix(matrix: DataFrame, features: DataFrame, path: str, n_cells: int, id_base: int = 0) -> None:
    """Folders of text: header and entries of the MatrixMarket file, and features.tsv.gz. The parts of entries, put
    behind the header, are the file."""
    shape = matrix_shape(matrix, features, n_cells)
    head = shape.select(F.concat(F.lit("%%MatrixMarket matrix coordinate integer general\n"), F.concat_ws(" ", *[F.col(c).cast("string") for c in shape.columns])))
    head.write.mode("overwrite").text(f"{path}/matrix.mtx.head")
    mtx_lines(matrix, id_base).write.mode("overwrite").text(f"{path}/matrix.mtx.entries")
    features.orderBy("feature").select("gene").coalesce(1).write.mode("overwrite").text(f"{path}/features.tsv", compression="gzip")
