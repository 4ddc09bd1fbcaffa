"""What a text typed as a query stands for: letters, FASTA records, or a gene whose sequence is looked up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dna


def _named(text: Column) -> Column:
    """The gene that a query names: after ``gene:`` or ``ensembl:``, or the whole of it."""
    after = F.coalesce(dna.query_part(text, "gene"), dna.query_part(text, "ensembl"))
    return F.coalesce(after, F.trim(F.substring_index(text, ";", 1)))


def route(queries: DataFrame, database: DataFrame) -> DataFrame:
    """query_id, kind, seq: the sequences that each of ``queries`` (query_id, text) stands for.

    Letters and FASTA records are cleaned. Other queries name a gene, by its name or its id in any case, of ``database``
    (gene_name, ensembl_id, sequence; if it has species or type, those of the query, or its defaults, must agree), and
    give a row for each of its sequences, cut to what ``split:a,b`` says, backwards if a is larger. A query that can't be
    read, or names nothing known, is of kind error and has no sequence. Names meet the database by two equality joins.
    """
    text = F.trim("text")
    asked = queries.select("query_id", text.alias("text"), dna.classify_query(text).alias("kind"))
    letters = asked.where("kind = 'dna'").select("query_id", "kind", F.explode(dna.parse_multifasta(F.col("text"))).alias("seq"))
    split = dna.query_part(F.col("text"), "split")
    part = lambda i: F.get(F.split(split, ","), F.lit(i)).try_cast("int")
    clear = (split.isNull() | split.rlike(r"^\s*[0-9]+\s*,\s*[0-9]+\s*$")) & (F.size(F.regexp_extract_all("text", F.lit("(?:^|;)(?:gene|ensembl):"), F.lit(0))) <= 1)
    named = asked.where(F.col("kind").isin("gene", "ensembl") & F.coalesce(clear, F.lit(True))).select(
        "query_id", "kind", F.lower(_named(F.col("text"))).alias("name"), F.coalesce(part(0), F.lit(0)).alias("start"), part(1).alias("end"),
        dna.query_part(F.col("text"), "species", "homo_sapiens").alias("species"), dna.query_part(F.col("text"), "type", "genomic").alias("type"),
    )
    more = [c for c in ("species", "type") if c in database.columns]
    by = lambda c: named.join(database.select(F.lower(c).alias("name"), "gene_name", "ensembl_id", "sequence", *more), ["name", *more])
    keys = ["query_id", "kind", "start", "end", "gene_name", "ensembl_id", "sequence"]
    found = by("gene_name").select(*keys).union(by("ensembl_id").select(*keys)).distinct()
    cut = found.select("query_id", "kind", dna.sanitize(dna.split_range(F.col("sequence"), F.col("start"), F.col("end"))).alias("seq"))
    out = letters.union(cut)
    lost = asked.join(out.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.lit("error").alias("kind"), F.lit(None).cast("string").alias("seq"))
    return out.union(lost)
