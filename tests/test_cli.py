import gzip
import io
import json
import random
import struct
import zipfile
import zlib

import numpy as np
import pytest

from strandweave import cli
from strandweave.operators import postings
from strandweave.sources import sinks

BARCODES = ["ACGTACGT", "CCCCGGGG", "TTTTACGA", "GATTACAG"]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """An index of four cells with coordinates: the first two hold gene A, the third gene B, the fourth nothing."""
    d = tmp_path_factory.mktemp("cli")
    r = random.Random(5)
    genes = {g: "".join(r.choice("ACGT") for _ in range(80)) for g in "AB"}
    pairs = [(BARCODES[0], genes["A"]), (BARCODES[1], genes["A"]), (BARCODES[2], genes["B"]), ("GGGGGGGG", genes["B"])]
    for name, rows in (("r1", [b + "AA" for b, _ in pairs]), ("r2", [s for _, s in pairs])):
        (d / f"{name}.fastq").write_text("".join(f"@x{i}\n{s}\n+\n{'I' * len(s)}\n" for i, s in enumerate(rows)))
    (d / "spots.csv").write_text("barcode,x,y\n" + "".join(f"{b},{i},{i % 2}\n" for i, b in enumerate(BARCODES)))
    (d / "ref.fa").write_text("".join(f">{g}:t\n{s}\n" for g, s in genes.items()))
    cli.main(["index", "--reads-in", f"{d}/r1.fastq", f"{d}/r2.fastq", "--spatial-bc-in", f"{d}/spots.csv", "--index-out", f"{d}/index", "--cell", "r1[0:8]", "--kmer-length", "8", "--overlapping"])
    return d, genes


VOTES = ["--kmer-min", "0", "--sliding-size", "24"]


def test_index_counts_what_it_read(spark, made):
    meta = postings.read_meta(spark, f"{made[0]}/index")
    assert meta["n_cells"] == 4 and meta["id_base"] == 0
    assert [meta["metrics"][c] for c in ("total_reads", "indexed_reads", "total_nt", "indexed_nt", "unindexed_reads")] == [4, 3, 320, 240, 1]


def test_search_and_report(made, capsys):
    d, genes = made
    cli.main(["search", "--index-in", f"{d}/index", *VOTES, "--query", genes["A"], "T" * 40, "--report", f"{d}/report.zip", "--json"])
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [x["cells"] for x in lines] == ["0, 1", ""]
    with zipfile.ZipFile(io.BytesIO((d / "report.zip").read_bytes())) as z:
        assert sorted(z.namelist()) == ["log.txt", "report.html", "sequences.fasta", "summary.json"]
        assert [g["n_cells"] for g in json.loads(z.read("summary.json"))["groups"]] == [2, 0]
        assert z.read("sequences.fasta").decode().splitlines()[1] == genes["A"][:60]
    with pytest.raises(SystemExit):
        cli.main(["search", "--index-in", f"{d}/index"])


def test_search_by_gene(made, capsys):
    d, genes = made
    (d / "genes.fa").write_text("".join(f">t{i} gene:ENSG{i}.1 gene_symbol:Gene{g}\n{s}\n" for i, (g, s) in enumerate(genes.items())))
    cli.main(["search", "--index-in", f"{d}/index", *VOTES, "--genes", f"{d}/genes.fa", "--query", "geneb", "gene:GeneA;split:0,40", "ensg0", genes["B"].lower(), "--json"])
    assert [json.loads(x)["cells"] for x in capsys.readouterr().out.splitlines()] == ["2", "0, 1", "0, 1", "2"]
    with pytest.raises(SystemExit, match="geneC"):
        cli.main(["search", "--index-in", f"{d}/index", *VOTES, "--genes", f"{d}/genes.fa", "--query", "geneC"])


def test_background_of_counts(spark, tmp_path):
    (tmp_path / "c.fa").write_text(">2\nACGT\n>7\nTTTT\n")
    cli.main(["background", "--counts", f"{tmp_path}/c.fa", "--output", f"{tmp_path}/out"])
    assert sorted(r.n_genes for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [2, 7]
    with pytest.raises(SystemExit):
        cli.main(["background", "--output", f"{tmp_path}/out"])


def test_quant_writes_one_matrix_file(spark, made):
    d, _ = made
    cli.main(["quant", "--index-in", f"{d}/index", *VOTES, "--reference", f"{d}/ref.fa", "--folder-out", f"{d}/quant", "--bin-size", "50"])
    lines = gzip.open(f"{d}/quant/matrix.mtx.gz", "rt").read().splitlines()
    assert lines[0].startswith("%%MatrixMarket") and lines[1] == "4 2 3"
    assert sorted(x.split()[:2] for x in lines[2:]) == [["1", "1"], ["2", "1"], ["3", "2"]]
    assert gzip.open(f"{d}/quant/features.tsv.gz", "rt").read().split() == ["A", "B"]
    whole, binned = (spark.read.parquet(f"{d}/quant/{x}").groupBy().sum("value").first()[0] for x in ("matrix", "binned"))
    assert whole == binned > 0


def test_show(made):
    d, genes = made
    cli.main(["show", "--index-in", f"{d}/index", *VOTES, "--query", *genes.values(), "T" * 40, "--image-out", f"{d}/a.tif", "--render-smoothing", "0", "--multichannel", "--save-npy"])
    layers = np.load(f"{d}/a.npy")
    assert layers.shape == (3, 2, 4) and sorted(map(tuple, np.argwhere(layers > 0))) == [(0, 0, 0), (0, 1, 1), (1, 0, 2)]
    data, pages = (d / "a.tif").read_bytes(), []
    at = struct.unpack_from("<I", data, 4)[0]
    while at:
        n = struct.unpack_from("<H", data, at)[0]
        tags = {t: v for t, _, _, v in (struct.unpack_from("<HHII", data, at + 2 + 12 * i) for i in range(n))}
        pages.append(np.frombuffer(zlib.decompress(data[tags[273] : tags[273] + tags[279]]), np.uint8).reshape(tags[257], tags[256]))
        at = struct.unpack_from("<I", data, at + 2 + 12 * n)[0]
    assert len(pages) == 3 and pages[0][0, 0] == 255 and not pages[2].any()


def test_png():
    image = np.arange(12, dtype=np.uint8).reshape(3, 4)
    data = sinks.png(image)
    n = struct.unpack_from(">I", data, 33)[0]
    rows = np.frombuffer(zlib.decompress(data[41 : 41 + n]), np.uint8).reshape(3, 5)
    assert data[:4] == b"\x89PNG" and (rows[:, 1:] == image).all()
    assert not sinks.to_bytes(np.full((2, 2), 3.0)).any() and sinks.to_bytes(np.array([[0.0, 1.0]]), 0, 1).tolist() == [[0, 255]]


def test_cellxmer_combine_verify(spark, made, capsys):
    d, _ = made
    cli.main(["cellxmer", "--index-in", f"{d}/index", "--kmer-min", "0", "--out", f"{d}/kmers", "--save-kmer"])
    assert spark.read.parquet(f"{d}/kmers").select("cell_id").distinct().count() == 3
    cli.main(["combine", "--index-in", f"{d}/index", f"{d}/index", "--index-out", f"{d}/twice"])
    capsys.readouterr()
    assert cli.main(["verify", "--old", f"{d}/index", "--new", f"{d}/twice"]) == 0
    assert json.loads(capsys.readouterr().out)["ok"] == postings.open_index(spark, f"{d}/index")[1].count()
    cli.main(["index", "--reads-in", "7", f"{d}/r2.fastq", "--index-out", f"{d}/bulk", "--kmer-length", "8", "--overlapping"])
    assert cli.main(["verify", "--old", f"{d}/index", "--new", f"{d}/bulk", "--n-sample", "0"]) == 1


def test_autoannotate(spark, tmp_path):
    r = random.Random(2)
    rows = [(c, g, float(r.randint(20, 30) if (g < "g3") == (c < 20) else r.randint(1, 2))) for c in range(40) for g in (f"g{i}" for i in range(6))]
    spark.createDataFrame(rows, "cell_id long, feature string, value double").write.parquet(f"{tmp_path}/matrix")
    (tmp_path / "m.json").write_text(json.dumps({"T": ["g0", "g1", "g2"], "B": ["g3", "g4", "g5"], "technical_x": ["g0"]}))
    cli.main(["autoannotate", "--matrix-in", f"{tmp_path}/matrix", "--out", f"{tmp_path}/out", "--reference", f"{tmp_path}/m.json", "--clusters", "2"])
    got = {x["cell_id"]: x["label"] for x in spark.read.parquet(f"{tmp_path}/out/cells").collect()}
    assert got == {c: "T" if c < 20 else "B" for c in range(40)}
