"""Python data sources for sequencing files, and readers for barcode lists.

A compressed file can't be split, so it is one partition; plans should spread its rows before heavy work. Plain FASTQ
files are split by bytes by ``read_fastq``, which numbers their records all the same.
"""

from __future__ import annotations

import re
import struct
import warnings
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import bam, files

BATCH = 4096
#: Records of a BAM file that are looked at for a tag before it is read.
PROBED = 200
#: Record numbers of file i begin at i << FILE_BITS.
FILE_BITS = 40
#: Plain FASTQ files are cut into this many pieces at most, while pieces are smaller than PIECE_BYTES.
PIECES, PIECE_BYTES = 128, 1 << 27


@dataclass
class Piece(InputPartition):
    path: str
    number: int
    start: int = 0
    end: int | None = None


class _FileReader(DataSourceReader):
    def __init__(self, options):
        self.paths = files.expand(options["path"])
        self.split = int(options.get("split_bytes", 0))

    def partitions(self):
        out = []
        for i, path in enumerate(self.paths):
            fs, at = files.locate(path)
            size = fs.get_file_info(at).size
            if self.split and self.splittable and files.compression_of(path) is None:
                out += [Piece(path, i, s, min(s + self.split, size)) for s in range(0, max(size, 1), self.split)]
            else:
                out.append(Piece(path, i))
        return out

    splittable = False

    def rows(self, piece):
        raise NotImplementedError

    def read(self, partition):
        columns = list(zip(self.names, self.types, strict=True))
        batch = []
        for row in self.rows(partition):
            batch.append(row)
            if len(batch) == BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*batch, strict=True), columns, strict=True)], names=self.names)
                batch = []
        if batch:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*batch, strict=True), columns, strict=True)], names=self.names)


class FastqReader(_FileReader):
    names, types, splittable = ["read_no", "name", "seq", "qual"], [pa.int64(), pa.string(), pa.string(), pa.string()], True

    def __init__(self, options):
        super().__init__(options)
        self.split = 0  # a piece can't tell how many records come before it; see FastqPiecesReader

    def rows(self, piece):
        base = piece.number << FILE_BITS
        if piece.end is None:
            with files.open_binary(piece.path) as stream:
                for i, x in enumerate(files.fastq_records(stream)):
                    yield base + i, *x
            return
        # records that begin in [start, end)
        fs, at = files.locate(piece.path)
        with fs.open_input_file(at) as f:
            f.seek(piece.start)
            pos, pending = piece.start, []
            source = self._lines_at(f, pos)
            if piece.start:  # a record begins where @ opens a line and + opens the line two below
                next(source, None) if not self._at_line_start(f, piece.start) else None
                window = [x for _, x in zip(range(8), source, strict=False)]
                k = next((i for i in range(len(window) - 2) if window[i][1].startswith(b"@") and window[i + 2][1].startswith(b"+")), None)
                if k is None:
                    return
                pending = window[k:]
            chain = iter(pending)

            def following():
                got = next(chain, None)
                return got if got is not None else next(source, None)

            while (head := following()) is not None and head[0] < piece.end:
                if not head[1]:
                    continue
                seq, _, qual = following(), following(), following()
                yield base + head[0], head[1][1:].decode(), seq[1].decode(), qual[1].decode() if qual else ""

    @staticmethod
    def _at_line_start(f, at):
        f.seek(at - 1)
        same = f.read(1) == b"\n"
        f.seek(at)
        return same

    @staticmethod
    def _lines_at(f, pos):
        rest = b""
        while True:
            block = f.read(1 << 16)
            if not block:
                break
            rest += block
            parts = rest.split(b"\n")
            rest = parts.pop()
            for x in parts:
                yield pos, x.rstrip(b"\r")
                pos += len(x) + 1
        if rest:
            yield pos, rest.rstrip(b"\r")


class FastqPiecesReader(FastqReader):
    """Records by file and piece, numbered within the piece."""

    names, types = ["file", "piece", "at", "name", "seq", "qual"], [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def __init__(self, options):
        super().__init__(options)
        self.split = int(options.get("split_bytes", 0))

    def rows(self, piece):
        for i, x in enumerate(super().rows(piece)):
            yield piece.number, piece.start, i, *x[1:]


class FastaReader(_FileReader):
    names, types = ["record_no", "header", "seq"], [pa.int64(), pa.string(), pa.string()]

    def rows(self, piece):
        with files.open_binary(piece.path) as stream:
            for i, x in enumerate(files.sequence_records(stream)):
                yield (piece.number << FILE_BITS) + i, *x


class StomicsReader(_FileReader):
    """Rows of u64 key, u32 x, u32 y. The key's bases are in reverse order; coordinates keep their low 16 bits."""

    names, types = ["barcode", "cell_id", "x", "y"], [pa.string(), pa.int64(), pa.float32(), pa.float32()]

    def __init__(self, options):
        super().__init__(options)
        self.length = int(options.get("barcode_length", 25))
        if not 1 <= self.length <= 32:
            raise ValueError("barcode_length must be between 1 and 32")

    def rows(self, piece):
        number = 0
        with files.open_binary(piece.path) as stream:
            rest = b""
            while block := stream.read(1 << 20):
                rest += block
                whole = len(rest) // 16 * 16
                for key, x, y in struct.iter_unpack("<QII", rest[:whole]):
                    bases = "".join("ACTG"[key >> 2 * i & 3] for i in range(self.length))
                    yield bases, number, float(x & 0xFFFF), float(y & 0xFFFF)
                    number += 1
                rest = rest[whole:]


class BamReader(_FileReader):
    names, types = ["barcode", "seq"], [pa.string(), pa.string()]

    def __init__(self, options):
        super().__init__(options)
        self.barcode, self.sequence = options.get("barcode_tag", "CB"), options.get("sequence_tag", "")

    def rows(self, piece):
        with files.open_binary(piece.path) as stream:
            for seq, tags in bam.records(stream):
                yield tags.get(self.barcode), tags.get(self.sequence) if self.sequence else seq


def _source(label: str, reader: type, schema_text: str) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls):
            return label

        def schema(self):
            return schema_text

        def reader(self, schema):
            return reader(self.options)

    Source.__name__ = Source.__qualname__ = f"{label.title()}Source"
    return Source


SOURCES = [
    _source("fastq", FastqReader, "read_no bigint, name string, seq string, qual string"),
    _source("fastq_pieces", FastqPiecesReader, "file bigint, piece bigint, at bigint, name string, seq string, qual string"),
    _source("fasta", FastaReader, "record_no bigint, header string, seq string"),
    _source("bam", BamReader, "barcode string, seq string"),
    _source("stomics", StomicsReader, "barcode string, cell_id bigint, x float, y float"),
]

# Where each kit has its barcode, and the tag that holds it in BAM files.
FLAVORS = {
    "openst": ("CB", "r1[2:27]"), "seq_scope_v1": ("CB", "r1[0:20]"), "stereo_seq": ("CB", "r1[0:25]"), "visium": ("CR", "r1[0:16]"), "slide_seq": ("XC", "r1[0:14]"),
    "sc_10x_v3": ("CB", "r1[0:16]"), "sc_10x_v2": ("CB", "r1[0:16]"), "sc_10x_v1": ("CB", "r1[0:14]"), "sc_dropseq": ("CB", "r1[0:12]"), "bulk": ("CB", "r1[0:12]"),
}


def register(spark: SparkSession) -> None:
    for s in SOURCES:
        spark.dataSource.register(s)


def piece_bytes(path: str, split_bytes: int) -> int:
    """``split_bytes``, or as many more as keep plain files at PIECES pieces, up to PIECE_BYTES: each piece is a task that
    opens its file, so small ones would have tasks grow in number with the input, whatever they read."""
    total = 0
    for one in files.expand(path):
        fs, at = files.locate(one)
        total += 0 if files.compression_of(one) else fs.get_file_info(at).size
    return max(split_bytes, min(PIECE_BYTES, -(-total // PIECES)))


def read_fastq(spark: SparkSession, path: str, split_bytes: int = PIECE_BYTES) -> DataFrame:
    """read_no, name, seq, qual of FASTQ files, as the source ``fastq`` gives them, but read in pieces of about
    ``split_bytes`` at once, or of ``piece_bytes`` if those would be too many. A first pass counts the records of each
    piece, so that numbers are those of an unsplit file; the counts are a row a partition and are broadcast. Compressed
    files are one piece each, and aren't counted."""
    split_bytes = piece_bytes(path, split_bytes)
    pieces = spark.read.format("fastq_pieces").option("split_bytes", split_bytes).load(path)
    number = F.shiftleft("file", FILE_BITS)
    if all(p.end is None for p in FastqPiecesReader({"path": path, "split_bytes": split_bytes}).partitions()):
        return pieces.select((number + F.col("at")).alias("read_no"), "name", "seq", "qual")
    sizes = pieces.groupBy("file", "piece").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("file", "piece", before.alias("before"))
    return pieces.join(F.broadcast(starts), ["file", "piece"]).select((number + F.col("before") + F.col("at")).alias("read_no"), "name", "seq", "qual")


def load_flavor(name: str) -> tuple[str, str, int, int]:
    """Like ``flavor``; a name that ends in .yaml is a file of one entry (cell, bam_tags), or of several below
    barcode_flavors, of which the first counts. Needs PyYAML."""
    if not name.lower().endswith(".yaml"):
        return flavor(name)
    import yaml

    with files.open_binary(name) as f:
        entry = yaml.safe_load(f.read())
    if "barcode_flavors" in entry:
        entry = next(iter(entry["barcode_flavors"].values()))
    tag = re.match(r"([A-Z][A-Z0-9]):\{cell\}", entry.get("bam_tags") or "")
    return flavor("custom", {"custom": (tag[1] if tag else "CB", entry["cell"])})


def parse_slice(text: str) -> slice:
    """``a:b`` or ``a:b:c`` as a slice, where parts may be empty; a number alone is that one place."""
    parts = [int(p) if p.strip() else None for p in text.split(":")]
    if len(parts) > 3 or parts == [None]:
        raise ValueError(f"not a slice: {text}")
    return slice(parts[0], parts[0] + 1) if len(parts) == 1 else slice(*parts)


def flavor(name: str, custom: dict[str, tuple[str, str]] | None = None) -> tuple[str, str, int, int]:
    """tag, read, start, end of a kit, known or given."""
    known = FLAVORS | (custom or {})
    if name not in known:
        raise ValueError(f"unknown flavor {name}; there are {', '.join(sorted(known))}")
    tag, cell = known[name]
    m = re.fullmatch(r"r([12])\[(\d+):(\d+)\]", cell)
    if not m:
        raise ValueError(f"not a cell position: {cell}")
    return tag, f"r{m[1]}", int(m[2]), int(m[3])


def input_type(reads: list) -> str:
    """fastq of two files, or of a number and a file; sra or bam of one."""
    if len(reads) == 2:
        return "fastq"
    end = str(reads[0]).lower() if len(reads) == 1 else ""
    if end.endswith((".sra", ".sralite")):
        return "sra"
    if end.endswith(".bam"):
        return "bam"
    raise ValueError(f"can't tell the type of {reads}")


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """line_no, value: lines of a list, numbered in order from 0, of several files in the order of their names: by their
    place in a block of a file, on top of the lines of the blocks before. Only a row a block meets in one window."""
    block = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")]
    rows = spark.read.text(path).select(*block, F.monotonically_increasing_id().alias("_m"), "value")
    sizes = rows.groupBy("_file", "_start").agg(F.count("*").alias("n"), F.min("_m").alias("_first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_file", "_start", "_first", before.alias("_at"))
    return rows.join(F.broadcast(starts), ["_file", "_start"]).select((F.col("_at") + F.col("_m") - F.col("_first")).alias("line_no"), "value")


def read_whitelist(spark: SparkSession, path: str) -> DataFrame:
    """barcode, cell_id: a barcode a line, ids from 1."""
    rows = _numbered(spark, path).where(F.trim("value") != "")
    return rows.select(F.trim("value").alias("barcode"), (F.col("line_no") + 1).alias("cell_id"))


def read_spatial(spark: SparkSession, path: str) -> DataFrame:
    """barcode, cell_id, x, y of lines parted by commas or tabs below a header; ids from 0."""
    rows = _numbered(spark, path).where("line_no > 0 and trim(value) != ''")
    part = F.split("value", "[,\t]")
    return rows.select(F.trim(part[0]).alias("barcode"), (F.col("line_no") - 1).alias("cell_id"), part[1].cast("float").alias("x"), part[2].cast("float").alias("y"))


def read_markers(spark: SparkSession, path: str, technical: bool = False) -> DataFrame:
    """cell_type, gene of a JSON object of lists."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    rows = text.select(F.explode("m").alias("cell_type", "genes")).select("cell_type", F.explode("genes").alias("gene"))
    return rows if technical else rows.where(~F.col("cell_type").startswith("technical_"))


def missing_share(path: str, tag: str, reads: int = PROBED) -> float:
    """The share of the first ``reads`` records of the first file that lack a tag; 0 of none."""
    with files.open_binary(files.expand(path)[0]) as stream:
        lacking = [tag not in tags for _, (_, tags) in zip(range(reads), bam.records(stream), strict=False)]
    return sum(lacking) / max(len(lacking), 1)


def read_bam(spark: SparkSession, path: str, barcode_tag: str = "CB", sequence_tag: str | None = None) -> DataFrame:
    """barcode, seq of BAM files, a task a file; of the sequence's tag if one is named. What a record lacks is null. If
    more than half of the first records have no barcode, a warning says so."""
    if (share := missing_share(path, barcode_tag)) > 0.5:
        warnings.warn(f"{share:.0%} of the first {PROBED} records of {path} have no tag {barcode_tag}", stacklevel=2)
    return spark.read.format("bam").option("barcode_tag", barcode_tag).option("sequence_tag", sequence_tag or "").load(path)


def gene_database(records: DataFrame) -> DataFrame:
    """gene_name, ensembl_id, sequence of FASTA records whose headers hold ``gene_symbol:``; the last of a pair wins."""
    named = records.select(F.regexp_extract("header", r"gene_symbol:(\S+)", 1).alias("gene_name"), F.regexp_extract("header", r"gene:(\S+?)(?:\.\d+)?(?:\s|$)", 1).alias("ensembl_id"), "seq", "record_no")
    return named.where("gene_name != '' or ensembl_id != ''").groupBy("gene_name", "ensembl_id").agg(F.max_by("seq", "record_no").alias("sequence"))


class GeneStore:
    """A gene database in a folder of Parquet. Genes that are put again replace their older rows when it is read, so that
    putting is an append, which other readers never see half done."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, genes: DataFrame) -> None:
        """Adds gene_name, ensembl_id, sequence, of a later version than all that are there."""
        last = self._rows().agg(F.max("version")).first()[0] if self.exists() else None
        version = F.lit((last or 0) + 1).cast("long").alias("version")
        genes.select("gene_name", "ensembl_id", "sequence", version).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self._rows().groupBy("gene_name", "ensembl_id").agg(F.max_by("sequence", "version").alias("sequence"))

    def exists(self) -> bool:
        """Whether anything was ever put."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def known(self, names: DataFrame) -> DataFrame:
        """name, known: whether each distinct ``name`` is a gene's name or id, in any case."""
        found = look_up_gene(self.read(), names).select("name").distinct().withColumn("known", F.lit(True))
        return names.select("name").distinct().join(found, "name", "left").select("name", F.coalesce("known", F.lit(False)).alias("known"))

    def _rows(self) -> DataFrame:
        return self.spark.read.schema("gene_name string, ensembl_id string, sequence string, version long").parquet(self.path)


def look_up_gene(database: DataFrame, names: DataFrame) -> DataFrame:
    """name, sequence: of each name that is a gene's name or id, in any case. Two equality joins, not one with OR."""
    wanted = names.select("name", F.lower("name").alias("_n")).distinct()
    by = lambda c: wanted.join(database.select(F.lower(c).alias("_n"), "gene_name", "ensembl_id", "sequence"), "_n")
    return by("gene_name").union(by("ensembl_id")).distinct().select("name", "sequence")
