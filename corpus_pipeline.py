"""A cleaning pipeline over documents: each stage is written as a Parquet table, which the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandweave.llm import bpe, exact_dedup, mixing, simhash, toxicity
from strandweave.llm.queries import MIX_WEIGHTS, tokenizer_path
from strandweave.llm.shared import new_folder

#: The columns that all stages but the last return.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bits in which the fingerprints of near copies differ at most: of the probed one, and of both together.
NEAR_BITS, NEAR_TOTAL = 10, 20


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores as toxic go. The lexicon is learnt from those labelled rows that aren't held out; without
    any, all rows stay. A null or empty text isn't toxic; rows that repeat an id or text are judged alike."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, labels).select(COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays; null and empty texts are equal. A row without an id stays
    only if no equal text has one; of rows that repeat id and text, one stays."""
    return exact_dedup.keep_one(docs).select(COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts, the row with the smallest doc_id stays; as in ``exact`` for rows without an id.

    Texts link over five-word shingles if their fingerprints differ in at most NEAR_BITS of 64 bits and, with a second
    fingerprint, in at most NEAR_TOTAL of 128, which is what texts differ in on average that share 0.8 of their shingles.
    Texts without words link to each other.
    """
    return simhash.keep_one(docs, NEAR_BITS, 5, NEAR_TOTAL).select(COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are repeated or left out so that the sources' shares come to their weights. A null source is of those that
    have no weight of their own; rows of one id and source, if any are left, are repeated alike."""
    return mixing.mix(docs, MIX_WEIGHTS).select(COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digests of each row's token ids and of what they decode to; a null text is empty. Repeated rows stay."""
    return bpe.round_trip(docs, tokenizer_path())


STAGES = [("toxicity", clean), ("exact dedup", exact), ("simhash near-dedup", near), ("mixing", mixed), ("bpe", encoded)]
#: Toxicity scores can't be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents. Texts are whole, however long; an empty table goes through as one; columns beyond
    COLUMNS, whatever their names, end with the first stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
