import gzip
import lzma
import struct

import pytest

from strandweave.sources import files, readers


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    readers.register(spark)


def fastq(n, end="\n"):
    return "".join(f"@r{i} x{end}{'ACGT'[i % 4] * (5 + i % 7)}{end}+{end}{'@' * (5 + i % 7)}{end}" for i in range(n)).encode()


@pytest.mark.parametrize("ending", ["fastq", "fastq.gz", "fastq.xz", "fastq.zst", "fastq.bz2"])
def test_fastq(spark, tmp_path, ending):
    path = f"{tmp_path}/a.{ending}"
    with files.open_writer(path) as f:
        f.write(fastq(50, "\r\n"))
    rows = spark.read.format("fastq").load(path).orderBy("read_no").collect()
    assert [r.read_no for r in rows] == list(range(50)) and rows[1].seq == "CCCCCC" and rows[1].name == "r1 x"


def test_fastq_pieces_lose_nothing(spark, tmp_path):
    (tmp_path / "a.fastq").write_bytes(fastq(300))
    with files.open_writer(f"{tmp_path}/b.fastq.gz") as f:
        f.write(fastq(300))
    whole = sorted(map(tuple, spark.read.format("fastq").load(f"{tmp_path}/a.fastq").collect()))
    for size in (97, 1000, 1 << 27):
        assert sorted(map(tuple, readers.read_fastq(spark, f"{tmp_path}/a.fastq", size).collect())) == whole
    # a split and an unsplit file of a pair still meet by number
    pair = readers.read_fastq(spark, f"{tmp_path}/a.fastq", 500).join(readers.read_fastq(spark, f"{tmp_path}/b.fastq.gz").withColumnRenamed("name", "other"), "read_no")
    assert pair.count() == 300 and pair.where("name != other").count() == 0
    both = readers.read_fastq(spark, f"{tmp_path}/a.fastq,{tmp_path}/b.fastq.gz", 500)
    assert both.count() == 600 and both.select("read_no").distinct().count() == 600


def test_fastq_pieces_stay_few(spark, tmp_path, monkeypatch):
    (tmp_path / "a.fastq").write_bytes(fastq(2000))
    monkeypatch.setattr(readers, "PIECES", 6)
    whole = sorted(map(tuple, spark.read.format("fastq").load(f"{tmp_path}/a.fastq").collect()))
    got = readers.read_fastq(spark, f"{tmp_path}/a.fastq", 64)
    assert got.rdd.getNumPartitions() <= 6 and sorted(map(tuple, got.collect())) == whole
    assert readers.piece_bytes(f"{tmp_path}/a.fastq", 1 << 20) == 1 << 20


def test_compression_by_content(tmp_path):
    (tmp_path / "plain").write_bytes(gzip.compress(b"hello"))
    (tmp_path / "other").write_bytes(lzma.compress(b"hello"))
    assert files.open_binary(f"{tmp_path}/plain").read() == files.open_binary(f"{tmp_path}/other").read() == b"hello"
    with pytest.raises(ValueError):
        files.open_writer(f"{tmp_path}/x.gz", 12)


def test_fasta_and_genes(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">t1 gene:ENSG1.2 gene_symbol:Abc\nAC\nGT\n>t2 gene:ENSG1.3 gene_symbol:Abc\nTTTT")
    records = spark.read.format("fasta").load(f"{tmp_path}/a.fa")
    assert [r.seq for r in records.orderBy("record_no").collect()] == ["ACGT", "TTTT"]
    db = readers.gene_database(records)
    names = spark.createDataFrame([("aBC",), ("ensg1",), ("none",)], "name string")
    assert sorted(map(tuple, readers.look_up_gene(db, names).collect())) == [("aBC", "TTTT"), ("ensg1", "TTTT")]


def bam_bytes(reads):
    """A BAM file, in BGZF members of a few records, of (sequence, tags)."""
    head = b"@HD\tVN:1.6\n"
    blocks = [b"BAM\1" + struct.pack("<i", len(head)) + head + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)]
    for i, (seq, tags) in enumerate(reads):
        codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0]
        packed = bytes(codes[j] << 4 | codes[j + 1] for j in range(0, len(seq), 2))
        name = f"r{i}".encode() + b"\0"
        body = struct.pack("<iiBBHHHiiii", -1, -1, len(name), 0, 0, 1, 4, len(seq), -1, -1, 0) + name + struct.pack("<I", 16) + packed + b"\xff" * len(seq) + tags
        blocks.append(struct.pack("<i", len(body)) + body)
    whole = b"".join(blocks)
    return b"".join(gzip.compress(whole[i : i + 100]) for i in range(0, len(whole), 100)) + gzip.compress(b"")


def test_bam(spark, tmp_path):
    tag = lambda name, text: name.encode() + b"Z" + text.encode() + b"\0"
    other = b"NHC\x05" + b"XAAx" + b"XBBs" + struct.pack("<i", 2) + b"\1\0\2\0" + b"XFf" + struct.pack("<f", 1.5) + b"XHHAB\0"
    reads = [("ACGTN", other + tag("CB", "ACGT-1")), ("ACG", tag("CB", "GGGG") + tag("UR", "TTTT")), ("", tag("CB", "AAAA")), ("TTTTTT", other)]
    (tmp_path / "x.bam").write_bytes(bam_bytes(reads))
    key = lambda rows: sorted(map(repr, map(tuple, rows)))
    assert key(readers.read_bam(spark, f"{tmp_path}/x.bam").collect()) == key([("ACGT-1", "ACGTN"), ("GGGG", "ACG"), ("AAAA", None), (None, "TTTTTT")])
    assert key(readers.read_bam(spark, f"{tmp_path}/x.bam", "CB", "UR").select("seq").collect()) == key([(None,), ("TTTT",), (None,), (None,)])
    with pytest.warns(UserWarning, match="75%"):
        readers.read_bam(spark, f"{tmp_path}/x.bam", "UR")
    (tmp_path / "y.bam").write_bytes(gzip.compress(b"text"))
    with pytest.raises(ValueError):
        readers.missing_share(f"{tmp_path}/y.bam", "CB")


def test_gene_store(spark, tmp_path):
    store = readers.GeneStore(spark, f"{tmp_path}/genes")
    genes = lambda *rows: spark.createDataFrame(rows, "gene_name string, ensembl_id string, sequence string")
    assert not store.exists()
    store.put(genes(("A", "E1", "AC"), ("B", "E2", "GG")))
    store.put(genes(("A", "E1", "TT"), ("C", "E3", "CC")))
    assert store.exists() and sorted(map(tuple, store.read().collect())) == [("A", "E1", "TT"), ("B", "E2", "GG"), ("C", "E3", "CC")]
    assert dict(map(tuple, store.known(spark.createDataFrame([("a",), ("e3",), ("x",)], "name string")).collect())) == {"a": True, "e3": True, "x": False}


def test_barcode_lists(spark, tmp_path):
    (tmp_path / "w.txt").write_text("ACGT\nGGGG\nTTTT")
    assert [tuple(r) for r in readers.read_whitelist(spark, f"{tmp_path}/w.txt").collect()] == [("ACGT", 1), ("GGGG", 2), ("TTTT", 3)]
    (tmp_path / "s.csv").write_text("barcode,x,y\nACGT,1,2\nGGGG\t3.5\t4")
    assert [tuple(r) for r in readers.read_spatial(spark, f"{tmp_path}/s.csv").collect()] == [("ACGT", 0, 1.0, 2.0), ("GGGG", 1, 3.5, 4.0)]
    (tmp_path / "b.bin").write_bytes(struct.pack("<QIIQII", 0b110100, 70000, 2, 0, 1, 1))
    rows = spark.read.format("stomics").option("barcode_length", 3).load(f"{tmp_path}/b.bin").collect()
    assert rows[0].barcode == "ACG" and rows[0].x == 70000 - 65536 and len(rows) == 2


def test_markers(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"T": ["CD3", "CD4"], "technical_mt": ["MT"]}')
    assert readers.read_markers(spark, f"{tmp_path}/m.json").count() == 2
    assert readers.read_markers(spark, f"{tmp_path}/m.json", technical=True).count() == 3


def test_flavor_files(tmp_path):
    (tmp_path / "one.yaml").write_text("cell: r2[3:9]\nbam_tags: XC:{cell}\n")
    (tmp_path / "some.yaml").write_text("barcode_flavors:\n  mine:\n    cell: r1[1:7]\n")
    assert readers.load_flavor(f"{tmp_path}/one.yaml") == ("XC", "r2", 3, 9)
    assert readers.load_flavor(f"{tmp_path}/some.yaml") == ("CB", "r1", 1, 7)


def test_imported_counts(spark, tmp_path):
    from strandweave.operators import postings

    (tmp_path / "c.fa").write_text(">3\nACTG\n>12\nacgt\n>x\nAAAA\n>4\nANNA\n>5\nACTG\n")
    rows = postings.import_counts(spark.read.format("fasta").load(f"{tmp_path}/c.fa")).collect()
    assert sorted(map(tuple, rows)) == [(0b00011011, 5), (0b00011110, 12)]


def test_kinds():
    assert readers.input_type(["a", "b"]) == "fastq" and readers.input_type(["x.BAM"]) == "bam" and readers.input_type(["x.sra"]) == "sra"
    with pytest.raises(ValueError):
        readers.input_type(["x.txt"])
    assert readers.flavor("openst") == readers.load_flavor("openst") == ("CB", "r1", 2, 27)
    assert readers.parse_slice("2:9") == slice(2, 9) and readers.parse_slice(":9:2") == slice(None, 9, 2) and readers.parse_slice("4") == slice(4, 5)
    for bad in ("", "1:2:3:4", "a:b"):
        with pytest.raises(ValueError):
            readers.parse_slice(bad)
    with pytest.raises(ValueError):
        readers.flavor("none")
