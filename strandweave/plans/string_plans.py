"""Strings and k-mers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codec, dna, metrics
from .catalog import CODE, DNA, K, cells_of, groups_of, query


@query("dna_sanitize", f"SELECT doc_id, {DNA.format('text')} AS seq FROM documents")
def _(t):
    return cells_of(t).withColumnRenamed("cell_id", "doc_id")


@query("revcomp", f"SELECT item_id, reverse(translate({DNA.format('text')}, 'ACGTU', 'TGCAA')) AS rc FROM benchmark")
def _(t):
    return groups_of(t).select(F.col("group_id").alias("item_id"), dna.reverse_complement(F.col("seq")).alias("rc"))


@query(
    "split_range",
    f"WITH g AS (SELECT item_id, {DNA.format('text')} AS s FROM benchmark) SELECT item_id, substr(s, 4, 9) AS forward, substr(reverse(translate(s, 'ACGT', 'TGCA')), 4, 9) AS backward FROM g",
)
def _(t):
    s = F.col("seq")
    return groups_of(t).select(F.col("group_id").alias("item_id"), dna.split_range(s, F.lit(3), F.lit(12)).alias("forward"), dna.split_range(s, F.lit(12), F.lit(3)).alias("backward"))


_WORDS = f"WITH g AS (SELECT item_id, {DNA.format('text')} AS s FROM benchmark), w AS (SELECT item_id, CAST(i - 1 AS INTEGER) AS pos, substr(s, i, {K}) AS kmer FROM g, LATERAL (SELECT unnest(range(1, length(s) - {K - 2})) AS i) WHERE length(s) >= {K})"


def words_of(t):
    """item_id, pos, kmer: all k-mers of the benchmark passages."""
    return groups_of(t).select(F.col("group_id").alias("item_id"), F.posexplode(codec.sliding(F.col("seq"), K)).alias("pos", "kmer"))


@query("encode_kmers", f"{_WORDS} SELECT item_id, pos, {CODE.format('kmer')} AS code FROM w")
def _(t):
    return words_of(t).select("item_id", "pos", codec.encode(F.col("kmer")).alias("code"))


@query("decode_kmers", f"{_WORDS} SELECT item_id, pos, kmer FROM w")
def _(t):
    return words_of(t).select("item_id", "pos", codec.decode(codec.encode(F.col("kmer")), K).alias("kmer"))


@query(
    "kmers_nonoverlap_tail",
    f"WITH c AS (SELECT doc_id, {DNA.format('text')} AS s FROM documents) SELECT doc_id, j AS pos, substr(s, least(j * {K}, length(s) - {K}) + 1, {K}) AS kmer"
    f" FROM c, LATERAL (SELECT unnest(range(0, CAST(ceil(length(s) / {K}) AS BIGINT))) AS j) WHERE length(s) >= {K}",
)
def _(t):
    return cells_of(t).select(F.col("cell_id").alias("doc_id"), F.posexplode(codec.tiled(F.col("seq"), K)).alias("pos", "kmer")).withColumn("pos", F.col("pos").cast("long"))


@query(
    "kmers_sliding",
    f"WITH c AS (SELECT doc_id, {DNA.format('text')} AS s FROM documents) SELECT doc_id, i - 1 AS pos, substr(s, i, {K}) AS kmer FROM c, LATERAL (SELECT unnest(range(1, length(s) - {K - 2})) AS i) WHERE length(s) >= {K}",
)
def _(t):
    return cells_of(t).select(F.col("cell_id").alias("doc_id"), F.posexplode(codec.sliding(F.col("seq"), K)).alias("pos", "kmer")).withColumn("pos", F.col("pos").cast("long"))


@query("prefix_suffix_split", f"{_WORDS}, c AS (SELECT item_id, pos, {CODE.format('kmer')} AS code FROM w) SELECT item_id, pos, code >> 8 AS prefix, code & 255 AS suffix FROM c")
def _(t):
    code = words_of(t).select("item_id", "pos", codec.encode(F.col("kmer")).alias("code"))
    return code.select("item_id", "pos", codec.prefix(F.col("code"), 4).alias("prefix"), codec.suffix(F.col("code"), 4).alias("suffix"))


@query("composite_ids", "WITH c AS (SELECT doc_id, (CAST(length(lang) AS BIGINT) << 23) | (doc_id & 8388607) AS code FROM documents) SELECT doc_id, code, code >> 23 AS sample_id, code & 8388607 AS cell_id FROM c")
def _(t):
    code = t("documents").select("doc_id", codec.composite(F.length("lang"), F.col("doc_id")).alias("code"))
    return code.select("doc_id", "code", codec.composite_sample(F.col("code")).alias("sample_id"), codec.composite_cell(F.col("code")).alias("cell_id"))


@query("reverse_barcode", f"{_WORDS}, r AS (SELECT item_id, pos, reverse(kmer) AS s FROM w) SELECT item_id, pos, {CODE.format('s')} AS code FROM r")
def _(t):
    return words_of(t).select("item_id", "pos", codec.reverse_barcode(codec.encode(F.col("kmer")), K).alias("code"))


_LETTERS = "WITH l AS (SELECT item_id, {0} AS s FROM benchmark), c AS (SELECT item_id, c.c, count(*) AS n, min(i) AS first FROM l, LATERAL (SELECT unnest(string_split(s, '')) AS c, generate_subscripts(string_split(s, ''), 1) AS i) c WHERE c.c <> '' GROUP BY ALL)"


@query(
    "rep_vector",
    _LETTERS.format(DNA.format("text")) + ", r AS (SELECT item_id, list_reverse_sort(list(n)) AS v FROM c GROUP BY item_id) SELECT b.item_id, list_concat(coalesce(v, []), list_transform(range(4 - coalesce(len(v), 0)), lambda x: CAST(0 AS BIGINT))) AS rep FROM benchmark b LEFT JOIN r USING (item_id)",
)
def _(t):
    return groups_of(t).select(F.col("group_id").alias("item_id"), dna.residue_counts(F.col("seq"), 4).cast("array<bigint>").alias("rep"))


@query(
    "entropy",
    _LETTERS.format(DNA.format("text")) + ", p AS (SELECT item_id, n / sum(n) OVER (PARTITION BY item_id) AS p FROM c), h AS (SELECT item_id, sum(-p * ln(p) / ln(4.0)) AS h FROM p GROUP BY item_id) SELECT b.item_id, round(coalesce(h, 0) + 0.0, 6) AS entropy FROM benchmark b LEFT JOIN h USING (item_id)",
)
def _(t):
    return groups_of(t).select(F.col("group_id").alias("item_id"), F.round(dna.complexity(F.col("seq"), 4) + 0.0, 6).alias("entropy"))


@query(
    "tokenise_query",
    r"WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(trim(text, ' '), '[,\s]+'), lambda x: x <> '') AS w FROM benchmark)"
    " SELECT item_id, list_transform(w, lambda x: CASE WHEN regexp_matches(upper(x), '^[ACGTNU]+$') THEN upper(x) ELSE 'gene:' || x || ';type:cdna' END) AS queries FROM w",
)
def _(t):
    return t("benchmark").select("item_id", dna.tokenise_query(F.col("text")).alias("queries"))


@query("fasta_wrap", r"WITH g AS (SELECT item_id, text FROM benchmark) SELECT item_id, '>' || item_id || chr(10) || rtrim(regexp_replace(replace(text, chr(10), ' '), '(.{60})', '\1' || chr(10), 'g'), chr(10)) AS fasta FROM g")
def _(t):
    return t("benchmark").select("item_id", dna.wrap_fasta(F.col("item_id").cast("string"), F.replace("text", F.lit("\n"), F.lit(" "))).alias("fasta"))


@query(
    "run_metrics",
    "WITH c AS (SELECT lang, count(*) AS total_reads, count(*) FILTER (length(text) >= 100) AS indexed_reads, sum(length(text)) AS total_nt, sum(length(text)) FILTER (length(text) >= 100) AS indexed_nt FROM documents GROUP BY lang)"
    " SELECT lang, total_reads - indexed_reads AS unindexed_reads, round(100.0 * indexed_reads / total_reads, 2) AS indexed_pct, round(total_reads / 2.0, 2) AS reads_per_s FROM c",
)
def _(t):
    n, long = F.length("text"), F.length("text") >= 100
    c = t("documents").groupBy("lang").agg(F.count("*").alias("total_reads"), F.count(F.when(long, 1)).alias("indexed_reads"), F.sum(n).alias("total_nt"), F.sum(F.when(long, n)).alias("indexed_nt"))
    return metrics.run_metrics(c.withColumn("seconds", F.lit(2.0))).select("lang", "unindexed_reads", "indexed_pct", "reads_per_s")


@query("throughput_percentiles", "SELECT event_type, [round(quantile_cont(value, 0.05), 6), round(quantile_cont(value, 0.5), 6), round(quantile_cont(value, 0.95), 6)] AS p FROM events GROUP BY event_type")
def _(t):
    return t("events").groupBy("event_type").agg(F.transform(metrics.percentiles("value"), lambda x: F.round(x, 6)).alias("p"))
