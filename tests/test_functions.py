import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandweave.functions import codec, dna, hashing, metrics
from strandweave.operators import search


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_codes(spark):
    assert one(spark, codec.encode(F.lit("ACTG"))) == 27
    assert one(spark, codec.encode(F.lit("actg"))) == 27
    assert one(spark, codec.encode(F.lit("ACNG"))) is None
    assert one(spark, codec.encode(F.lit(""))) is None
    for text in ("0123", "AC0GT", "3", "AC GT", "A" * 32):
        assert one(spark, codec.encode(F.lit(text))) is None
    assert one(spark, codec.digits(F.lit("aC0GT3u"))) == "01N32N2"
    assert one(spark, codec.encode(F.lit("G" * 31))) == 4**31 - 1
    assert one(spark, codec.decode(F.lit(27), 6)) == "AAACTG"
    assert one(spark, codec.reverse_barcode(F.lit(27), 4)) == one(spark, codec.encode(F.lit("GTCA")))
    with pytest.raises(ValueError):
        codec.check_k(32)


def test_cuts(spark):
    assert one(spark, codec.tiled(F.lit("ACGTACGTAC"), 4)) == ["ACGT", "ACGT", "GTAC"]
    assert one(spark, codec.sliding(F.lit("ACGT"), 3)) == ["ACG", "CGT"]
    assert one(spark, codec.sliding(F.lit("AC"), 3)) == []
    assert one(spark, codec.tiled(F.lit("AC"), 3)) == []


def test_dna(spark):
    assert one(spark, dna.sanitize(F.lit(" ac gu-nX\n"))) == "ACGTN"
    assert one(spark, dna.reverse_complement(F.lit("AACG"))) == "CGTT"
    assert one(spark, dna.split_range(F.lit("AACGTT"), F.lit(1), F.lit(4))) == "ACG"
    assert one(spark, dna.split_range(F.lit("AACGTA"), F.lit(4), F.lit(1))) == "TACGTT"[1:4]
    assert one(spark, dna.split_range(F.lit("AACG"), F.lit(2), F.lit(None).cast("int"))) == "CG"
    assert one(spark, dna.parse_multifasta(F.lit(">a\nAC\nGU\n>b\nTT"))) == ["ACGT", "TT"]
    assert one(spark, dna.parse_gene_lists(F.lit("see ['A', \"B\"] and ['C'] or ['D']"))) == [["A", "B"], ["C"]]
    assert one(spark, dna.wrap_fasta(F.lit("h"), F.lit("A" * 61))) == ">h\n" + "A" * 60 + "\nA"


@pytest.mark.parametrize("text, kind", [("ACGU", "dna"), (">x\nACG", "dna"), ("ENSG00000139618", "ensembl"), ("BRCA2", "gene"), ("gene:BRCA2;type:cdna", "gene"), ("", "error"), ("a b", "error")])
def test_classify(spark, text, kind):
    assert one(spark, dna.classify_query(F.lit(text))) == kind


def test_gene_queries(spark):
    got = one(spark, dna.parse_gene_query(F.lit("gene:X;species:mouse;split:5,2")))
    assert tuple(got) == ("X", "mouse", "genomic", 5, 2)
    assert tuple(one(spark, dna.parse_ensembl_query(F.lit("ensembl:ENSG1;type:cdna")))) == ("ENSG1", "cdna", 0, None)
    for bad in ("gene:X;split:1", "gene:X;split:a,2", "gene:X;gene:Y"):
        with pytest.raises(Exception, match="not a gene query"):
            one(spark, dna.parse_gene_query(F.lit(bad)))


@pytest.mark.parametrize("seq, n, want", [("TACT", 5, [2, 1, 1, 0, 0]), ("CCGTTTTA", 3, [4, 2, 1]), ("", 2, [0, 0])])
def test_residues(spark, seq, n, want):
    assert one(spark, dna.residue_counts(F.lit(seq), n)) == want


def test_complexity(spark):
    assert one(spark, dna.complexity(F.lit("ACGT"), 4)) == pytest.approx(1)
    assert one(spark, dna.complexity(F.lit("AAAA"), 4)) == pytest.approx(0)
    masked = one(spark, dna.mask_low_complexity(F.lit("ACGTGCATGACTGCTAGCATCGATCG" + "A" * 14 + "GCTAGCATCGATGCACTGATCG"), n=4, window=8))
    assert "NNNN" in masked and masked.startswith("ACGTGCAT")
    assert one(spark, dna.mask_low_complexity(F.lit("ACG"))) == "ACG"


def test_mask_by_counts(spark):
    # counts 4, 0, 0, 0 as letters: one kind once, one three times
    quarter = -(0.25 * math.log(0.25, 4) + 0.75 * math.log(0.75, 4))
    assert one(spark, dna.counts_complexity(F.array(F.lit(4), F.lit(0), F.lit(0), F.lit(0)), 4)) == pytest.approx(quarter)
    seq = "ACGTGCATGACTGCTAGCATCGATCG" + "AC" * 8 + "GCTAGCATCGATGCACTGATCG"
    both = [one(spark, dna.mask_low_complexity(F.lit(seq), n=4, window=8, mode=m)) for m in ("entropy", "reference")]
    assert both[0] != both[1] and all(len(x) == len(seq) for x in both)
    with pytest.raises(ValueError):
        dna.mask_low_complexity(F.lit(seq), mode="other")


def test_sql_functions(spark):
    from strandweave.functions import sql

    sql.register(spark)
    row = spark.sql("SELECT dna_encode('actg') a, dna_encode('A0') b, dna_decode(27, 6) c, dna_revcomp('AACG') d, dna_sanitize('ac u-x') e, dna_entropy('ACGT', 4) f, dna_entropy('AAAA', 4) g, kmer_bucket(27L, 4, 2, 100) h").first()
    assert tuple(row)[:5] == (27, None, "AAACTG", "CGTT", "ACT") and row.f == pytest.approx(1) and row.g == 0
    assert row.h == int(hashing.signatures(np.array([27]), 4, 2)[0] % np.uint64(100))
    got = spark.sql("SELECT s, pos, kmer FROM VALUES ('ACGTA'), ('AC') AS t(s), LATERAL kmers(s, 3, 2)").collect()
    assert sorted(map(tuple, got)) == [("ACGTA", 0, "ACG"), ("ACGTA", 2, "GTA")]


def test_window_lengths():
    assert search.usable_window(24, 8, 30) == (24, None) == search.usable_window(24, 8, None)
    length, warning = search.usable_window(24, 8, 11)
    assert length == 11 and "11" in warning
    for args in ((7, 8, 30), (24, 8, 7)):
        with pytest.raises(ValueError):
            search.usable_window(*args)


def test_small_parsers(spark):
    assert one(spark, dna.bytes_of(F.lit("1.5K"))) == 1536
    assert one(spark, dna.bytes_of(F.lit("2G"))) == 2 << 30
    assert one(spark, dna.bytes_of(F.lit(""))) is None
    assert tuple(one(spark, dna.cell_spec(F.lit("r1[2:27]")))) == (1, 2, 27)
    with pytest.raises(Exception, match="not a cell position"):
        one(spark, dna.cell_spec(F.lit("r3[2:27]")))
    assert one(spark, dna.bam_tag(F.lit("CR:{cell}"))) == "CR"
    assert one(spark, dna.bam_tag(F.lit("none"))) == "CB"
    assert one(spark, dna.has_unsafe(F.lit("f()")))


def test_signatures_by_hand():
    wrap, kmer, k, w = (1 << 64) - 1, 0b110110001101, 6, 3

    def mix(x, ms):
        for m in ms:
            x = ((x ^ x >> 33) * m) & wrap
        return x ^ x >> 33

    words = [kmer >> 2 * i & 63 for i in range(4)]
    want = min(mix(x, hashing.FIRST_MIX) for x in words) ^ (min(mix(x, hashing.SECOND_MIX) for x in words) * hashing.JOIN & wrap)
    assert int(hashing.signatures(np.array([kmer]), k, w)[0]) == want
    with pytest.raises(ValueError):
        hashing.bucket_of(3, 4, 10)


def test_metrics(spark):
    assert [round(x, 2) for x in spark.range(0, 41).agg(metrics.percentiles("id")).first()[0]] == [2, 20, 38]
    assert spark.range(0).agg(metrics.percentiles("id")).first()[0] == [0, 0, 0]
    row = metrics.run_metrics(spark.createDataFrame([(250, 40, 9000, 700, 4.0)], "total_reads long, indexed_reads long, total_nt long, indexed_nt long, seconds double"))
    got = row.first()
    assert (got.unindexed_reads, got.indexed_pct, got.reads_per_s) == (210, 16.0, 62.5)
    assert "METRIC indexed_pct=16.0" in [r.line for r in metrics.summary_lines(row).collect()]


def test_votes():
    assert search.vote_threshold(24, 8, 0.65) == 2
    assert search.vote_threshold(24, 8, 1.0) == 3
    assert search.vote_threshold(24, 8, 0.0) == 1
    with pytest.raises(ValueError):
        search.vote_threshold(24, 8, 1.1)
    assert math.isclose(0.65, 0.65)
