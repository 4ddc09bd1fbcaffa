"""Named queries over the driver's tables, and DuckDB SQL for each.

The tables hold no DNA: a text's A, C, G and T (and U, as T) stand for a cell's read, ``benchmark`` for the queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: k-mer and window lengths that suit these short texts.
K, W = 8, 24


class Tables:
    """The tables of a folder, by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}.parquet")


def query(name: str, sql: str | None = None):
    """Registers a function of a table reader: ``t("documents")`` is that table."""

    def add(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Tables(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return build

    return add


def cells_of(t) -> DataFrame:
    """cell_id, seq of documents."""
    return dna.with_bases(t("documents").select(F.col("doc_id").alias("cell_id"), "text"))


def texts_of(t) -> DataFrame:
    """cell_id, seq of documents, as they are: for steps that leave out other letters themselves (``bases``)."""
    return t("documents").select(F.col("doc_id").alias("cell_id"), F.col("text").alias("seq"))


def groups_of(t) -> DataFrame:
    """group_id, seq of benchmark passages."""
    return t("benchmark").select(F.col("item_id").alias("group_id"), dna.bases_only(F.col("text")).alias("seq"))


def matrix_of(t) -> DataFrame:
    """cell_id, feature, value of lineitem: suppliers as cells, parts as features, summed quantities."""
    return t("lineitem").groupBy(F.col("l_suppkey").alias("cell_id"), F.col("l_partkey").alias("feature")).agg(F.sum("l_quantity").alias("value"))


def points_of(t) -> DataFrame:
    """cell_id, x, y, cluster, value of embeddings."""
    e = F.col("embedding")
    return t("embeddings").select(F.col("vec_id").alias("cell_id"), e[0].cast("double").alias("x"), e[1].cast("double").alias("y"), F.col("label").alias("cluster"), F.abs(e[2].cast("double")).alias("value"))


DNA = "regexp_replace(replace(upper({0}), 'U', 'T'), '[^ACGT]', '', 'g')"
CODE = "list_reduce(list_transform(string_split({0}, ''), lambda c: CAST(instr('ACTG', c) - 1 AS BIGINT)), lambda a, b: a * 4 + b)"
CELLS = f"cells AS (SELECT doc_id AS cell_id, {DNA.format('text')} AS seq FROM documents)"
GROUPS = f"groups AS (SELECT item_id AS group_id, {DNA.format('text')} AS seq FROM benchmark)"
#: All k-mers, as strings; and as codes where the result has them.
WORDS = f"words AS (SELECT DISTINCT cell_id, substr(seq, i, {K}) AS kmer FROM cells, LATERAL (SELECT unnest(range(1, length(seq) - {K - 2})) AS i) WHERE length(seq) >= {K})"
MATRIX = "matrix AS (SELECT l_suppkey AS cell_id, l_partkey AS feature, sum(l_quantity) AS value FROM lineitem GROUP BY ALL)"
POINTS = "points AS (SELECT vec_id AS cell_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, label AS cluster, abs(CAST(embedding[3] AS DOUBLE)) AS value FROM embeddings)"

from . import cell_plans, index_plans, query_plans, space_plans, string_plans  # noqa: E402, F401
