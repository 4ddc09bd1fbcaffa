"""The command line: ``python -m strandweave COMMAND``. Each command is a plan over one Spark session, whose master and
resources are those of spark-submit or of the configuration; ``--threads`` asks for a local one."""

from __future__ import annotations

import argparse
import json
import sys
import time

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .functions import dna, metrics
from .operators import annotate, barcodes, cells, cellxmer, postings, quant, router, search, spatial
from .sources import files, readers, sinks


def session(threads: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName("strandweave")
    spark = (builder.master(f"local[{threads}]") if threads else builder).getOrCreate()
    readers.register(spark)
    return spark


def barcode_list(spark: SparkSession, path: str, length: int) -> tuple[DataFrame, bool]:
    """The barcodes of a file, and whether they have coordinates: binary by its ending, a table by its first line."""
    if path.endswith(".bin"):
        return spark.read.format("stomics").option("barcode_length", length).load(path), True
    with files.open_binary(path) as f:
        first = next(files.lines(f), b"")
    spaced = b"," in first or b"\t" in first
    return (readers.read_spatial if spaced else readers.read_whitelist)(spark, path), spaced


def counted(reads: DataFrame, seen: Observation) -> DataFrame:
    """``reads``, whose number and bases are counted while they pass."""
    return reads.observe(seen, F.count(F.lit(1)).alias("reads"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("nt"))


def run_index(args) -> None:
    """Reads become an index in one pass: what they count is observed on the way."""
    spark, began = session(args.threads), time.time()
    _, read, start, end = readers.flavor("given", {"given": ("CB", args.cell)}) if args.cell else readers.load_flavor(args.flavor)
    total, kept = Observation("total"), Observation("kept")
    spaced, known = False, None
    bulk = len(args.reads_in) == 2 and args.reads_in[0].isdigit() or args.flavor == "bulk" and len(args.reads_in) == 1
    if bulk:
        number = int(args.reads_in[0]) if len(args.reads_in) == 2 else args.bulk_id
        reads = counted(readers.read_fastq(spark, args.reads_in[-1]).select("seq"), total)
        assigned, n_cells = barcodes.bulk_cells(reads, number).where(F.length("seq") >= args.kmer_length), 1
    else:
        if not args.spatial_bc_in:
            raise SystemExit("--spatial-bc-in is needed unless the reads are of one sample")
        kind = readers.input_type(args.reads_in)
        known, spaced = barcode_list(spark, args.spatial_bc_in, end - start)
        n_cells = known.count()
        if kind == "fastq":
            r1, r2 = (readers.read_fastq(spark, p).select("read_no", "seq") for p in args.reads_in)
            r1, r2 = (counted(r1, total), r2) if read == "r2" else (r1, counted(r2, total))
            assigned = barcodes.assign_cells(r1, r2, known, start, end, args.kmer_length, read == "r2")
        elif kind == "bam":
            tag = args.bam_barcode_tag or readers.load_flavor(args.flavor)[0]
            reads = counted(readers.read_bam(spark, args.reads_in[0], tag, args.bam_sequence_tag), total)
            assigned = barcodes.tagged_cells(reads, known, args.kmer_length)
        else:
            raise SystemExit("SRA archives can't be read here; convert them to FASTQ first")
    assigned = counted(assigned.select("cell_id", "seq"), kept)
    meta = {"kmer_size": args.kmer_length, "stride": 1 if args.overlapping else args.kmer_length, "n_cells": n_cells, "id_base": 0 if spaced else 1, "flavor": args.flavor, "uuid": args.uuid}
    postings.write_index(postings.build_postings(assigned, args.kmer_length, args.overlapping), args.index_out, meta, dealt=True)
    if spaced:
        known.select("cell_id", "x", "y").write.mode("overwrite").parquet(f"{args.index_out}/cells")
    figures = (total.get["reads"], kept.get["reads"], total.get["nt"], kept.get["nt"], time.time() - began)
    row = metrics.run_metrics(spark.createDataFrame([figures], "total_reads long, indexed_reads long, total_nt long, indexed_nt long, seconds double"))
    for line in metrics.summary_lines(row).collect():
        print(line[0])
    postings.patch_meta(spark, args.index_out, metrics=row.first().asDict())


def opened(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame, dict]:
    """One index, or several over the same cells as one, whose stats are counted anew."""
    if len(paths) == 1:
        return postings.open_index(spark, paths[0])
    each = [postings.open_index(spark, p) for p in paths]
    if len({m["kmer_size"] for _, _, m in each}) > 1:
        raise SystemExit("the indices have different k")
    merged = postings.merge_lanes(*(p for p, _, _ in each))
    return merged, postings.kmer_stats(merged), each[0][2] | {"n_cells": max(m["n_cells"] for _, _, m in each)}


def vote_options(args) -> dict:
    return {"pct_threshold": args.pct_threshold, "count_at_least": args.kmer_min, "count_at_most": args.kmer_max, "single_count": args.single_count}


def binned(spark: SparkSession, path: str, matrix: DataFrame, size: float) -> DataFrame:
    """cell_id, feature, value summed on hexagons, whose numbers go by their place."""
    at = spark.read.parquet(f"{path}/cells")
    bins, summed = spatial.meshed_matrix(at, matrix, "hexagon", size)
    numbered = bins.select("bin", F.xxhash64("bin").alias("cell_id"))
    return summed.join(numbered, "bin").select("cell_id", "feature", F.col("value").cast("double").alias("value"))


def run_quant(args) -> None:
    spark = session(args.threads)
    posted, stats, meta = opened(spark, args.index_in)
    records = spark.read.format("fasta").load(args.reference).withColumn("seq", dna.sanitize(F.col("seq")))
    background = spark.read.parquet(args.background_model) if args.background_model else None
    matrix, features = quant.quantify(records, posted, stats, meta["kmer_size"], args.sliding_size, background=background, **vote_options(args))
    folder = args.folder_out
    matrix.write.mode("overwrite").parquet(f"{folder}/entries")
    features.write.mode("overwrite").parquet(f"{folder}/features")
    matrix, features = spark.read.parquet(f"{folder}/entries"), spark.read.parquet(f"{folder}/features")
    quant.write_matrix(matrix, features, folder, meta["n_cells"], meta["id_base"])
    sinks.write_matrix_file(folder, f"{folder}/matrix.mtx.gz")
    sinks.join_text([f"{folder}/features.tsv"], f"{folder}/features.tsv.gz")
    named = matrix.join(features, "feature").select("cell_id", F.col("gene").alias("feature"), F.col("value").cast("double").alias("value"))
    named = named.groupBy("cell_id", "feature").agg(F.sum("value").alias("value"))
    named.write.mode("overwrite").parquet(f"{folder}/matrix")
    if args.bin_size > 0:
        binned(spark, args.index_in[0], named, args.bin_size).write.mode("overwrite").parquet(f"{folder}/binned")


def asked(args) -> list[tuple[int, str, str]]:
    """group_id, name, sequence of the request: letters, or the records of a file, a group each."""
    if bool(args.query) == bool(args.file):
        raise SystemExit("give either --query or --file")
    if args.query:
        return [(i, f"query{i}", q) for i, q in enumerate(args.query)]
    with files.open_binary(args.file) as f:
        return [(i, name, seq) for i, (name, seq) in enumerate(files.sequence_records(f))]


def found(spark: SparkSession, args) -> tuple[list, DataFrame, dict]:
    posted, stats, meta = opened(spark, args.index_in)
    queries = asked(args)
    frame = spark.createDataFrame(queries, "group_id long, name string, seq string")
    if args.genes:
        database = readers.gene_database(spark.read.format("fasta").load(args.genes))
        routed = router.route(frame.select(F.col("group_id").alias("query_id"), F.col("seq").alias("text")), database)
        rows = routed.collect()  # a few for each query asked for
        if lost := sorted(r["query_id"] for r in rows if r["kind"] == "error"):
            raise SystemExit("not a sequence and no known gene: " + ", ".join(queries[i][2][:50] for i in lost))
        frame = spark.createDataFrame([(r["query_id"], r["seq"]) for r in rows], "group_id long, seq string")
    else:
        frame = frame.select("group_id", dna.sanitize(F.col("seq")).alias("seq"))
    return queries, search.where(frame, posted, stats, meta["kmer_size"], args.sliding_size, **vote_options(args)), meta


def run_search(args) -> None:
    spark = session(args.threads)
    queries, scores, _ = found(spark, args)
    if args.output:
        scores.write.mode("overwrite").parquet(args.output)
        scores = spark.read.parquet(args.output)
    else:
        scores = scores.persist()
    if args.report:
        options = vote_options(args) | {"index": args.index_in, "sliding_size": args.sliding_size}
        sinks.save(sinks.report(queries, scores, options, [f"{len(queries)} sequences"]), args.report)
    lines = {r["group_id"]: r["line"] for r in search.display(scores).collect()}  # a row a sequence asked for
    for group, name, seq in queries:
        shown = seq if len(seq) <= 50 else seq[:50] + "..."
        print(json.dumps({"name": name, "sequence": seq, "cells": lines.get(group, "")}) if args.json else f"{name} {shown}: {lines.get(group, 'no cells')}")


def run_show(args) -> None:
    """An image for each query, or one of a page for each: scores on the cells' coordinates."""
    spark = session(args.threads)
    queries, scores, _ = found(spark, args)
    at = spark.read.parquet(f"{args.index_in[0]}/cells")
    xmin, xmax, ymin, ymax = spatial.limits(at).first()
    nx, ny = (max(1, int((hi + 1 - lo) * args.render_scale)) for lo, hi in ((xmin, xmax), (ymin, ymax)))
    if nx * ny > args.max_pixels:
        raise SystemExit(f"{nx} by {ny} pixels are over --max-pixels; lower --render-scale")
    scores, layers = scores.persist(), []
    for group, _, _ in queries:
        points = scores.where(F.col("group_id") == group).join(at, "cell_id").select("x", "y", F.col("score").alias("value"))
        pixels = spatial.histogram2d(points, nx, ny, (xmin, xmax + 1, ymin, ymax + 1))
        if args.render_smoothing > 0:
            pixels = spatial.smooth(pixels, nx, ny, args.render_smoothing)
        layers.append(sinks.pixel_array(pixels, nx, ny))
    scores.unpersist()
    stem, _, ending = args.image_out.rpartition(".")
    grey = [sinks.to_bytes(x, 0, x.max()) for x in layers]
    if args.multichannel or len(grey) == 1:
        sinks.save(sinks.png(grey[0]) if ending == "png" and len(grey) == 1 else sinks.tiff(grey), args.image_out)
    else:
        for i, image in enumerate(grey):
            sinks.save(sinks.png(image) if ending == "png" else sinks.tiff([image]), f"{stem}_{i}.{ending}")
    if args.save_npy:
        np.save(f"{stem}.npy", np.stack(layers))


def run_cellxmer(args) -> None:
    spark = session(args.threads)
    posted, stats, meta = opened(spark, args.index_in)
    usable = stats.where(search.abundant(args.kmer_min, args.kmer_max)).select("kmer")
    posted = posted.join(usable, "kmer", "left_semi")
    k = meta["kmer_size"]
    if args.save_kmer:
        matrix = cellxmer.cell_by_kmer(posted, k)
    else:
        matrix = cellxmer.cell_by_bucket(posted, k, args.w_size, args.num_buckets).withColumnRenamed("bucket", "feature")
    if args.bin_size > 0:
        matrix = binned(spark, args.index_in[0], matrix, args.bin_size)
    matrix.write.mode("overwrite").parquet(args.out)


def run_autoannotate(args) -> None:
    """Clusters and their types of a matrix folder (cell_id, feature, value): cells, clusters and markers."""
    spark = session(args.threads)
    raw = spark.read.parquet(args.matrix_in)
    kept = cells.filter_matrix(raw, args.min_counts, args.min_genes, args.min_cells)
    cells.normalize_log1p(kept).write.mode("overwrite").parquet(f"{args.out}/normalised")
    matrix = spark.read.parquet(f"{args.out}/normalised")
    n_cells = matrix.select("cell_id").distinct().count()
    if n_cells < 2:
        raise SystemExit("fewer than two cells pass the filters")
    variable = [r["feature"] for r in annotate.highly_variable(matrix, n_cells, args.top_genes).collect()]  # at most top_genes
    annotate.cluster_cells(matrix, variable, args.clusters).write.mode("overwrite").parquet(f"{args.out}/clusters")
    clusters = spark.read.parquet(f"{args.out}/clusters")
    annotate.cluster_means(matrix, clusters).write.mode("overwrite").parquet(f"{args.out}/means")
    means = spark.read.parquet(f"{args.out}/means")
    scores = annotate.marker_scores(means, annotate.annotation_markers(readers.read_markers(spark, args.reference)))
    labels = annotate.annotate_clusters(scores, clusters).join(annotate.top_markers(means), "cluster", "left")
    labels.write.mode("overwrite").parquet(f"{args.out}/labels")
    clusters.join(spark.read.parquet(f"{args.out}/labels"), "cluster").write.mode("overwrite").parquet(f"{args.out}/cells")


def run_combine(args) -> None:
    print(json.dumps(postings.combine(session(args.threads), args.index_in, args.index_out, args.merge_projects), default=str))


def run_convert(args) -> None:
    """Parquet rows of a legacy index's arrays (indices, indptr, data) become an index."""
    spark = session(args.threads)
    posted = postings.csr_to_postings(spark.read.parquet(args.input))
    postings.write_index(posted, args.output, {"kmer_size": args.kmer_length, "n_cells": args.n_cells})


def run_verify(args) -> int:
    """Compares k-mers of two indices, some or with 0 all; 1 if any differs."""
    spark = session(args.threads)
    (old, stats, _), (new, new_stats, _) = postings.open_index(spark, args.old), postings.open_index(spark, args.new)
    if args.n_sample:
        both = stats.select("kmer").union(new_stats.select("kmer")).distinct()
        some = postings.sample_kmers(both, args.n_sample, args.seed).persist()
        old, new = (p.join(some, "kmer", "left_semi") for p in (old, new))
    counts = {r["status"]: r["count"] for r in postings.verify(old, new).groupBy("status").count().collect()}
    print(json.dumps({s: counts.get(s, 0) for s in ("ok", "mismatch", "missing", "extra")}))
    return int(any(n for s, n in counts.items() if s != "ok"))


def run_background(args) -> None:
    """In how many genes of a reference each k-mer occurs, or what a k-mer counter exported."""
    spark = session(args.threads)
    if bool(args.reference) == bool(args.counts):
        raise SystemExit("give either --reference or --counts")
    if args.counts:
        postings.import_counts(spark.read.format("fasta").load(args.counts)).write.mode("overwrite").parquet(args.output)
        return
    records = spark.read.format("fasta").load(args.reference).withColumn("seq", dna.sanitize(F.col("seq")))
    quant.background_model(records, args.kmer_length).write.mode("overwrite").parquet(args.output)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandweave", description="Sequence search over single cells.")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, run) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=(run.__doc__ or name).split(".")[0])
        p.add_argument("--threads", type=int, help="run locally with this many threads")
        p.set_defaults(run=run)
        return p

    def index_of(p) -> None:
        p.add_argument("--index-in", nargs="+", required=True)

    def abundance(p) -> None:
        p.add_argument("--kmer-min", type=int, default=10)
        p.add_argument("--kmer-max", type=int, default=10_000)

    def votes(p) -> None:
        abundance(p)
        p.add_argument("--sliding-size", type=int, default=128)
        p.add_argument("--pct-threshold", type=float, default=0.65)
        p.add_argument("--single-count", action="store_true")

    def request(p) -> None:
        p.add_argument("--query", "--sequence", nargs="+")
        p.add_argument("--genes", help="FASTA of genes, by whose names and ids queries can ask")
        p.add_argument("--file", help="FASTA or FASTQ")

    p = command("index", run_index)
    p.add_argument("--reads-in", nargs="+", required=True, help="two FASTQ files, a BAM file, or a cell's number and a FASTQ file")
    p.add_argument("--spatial-bc-in", help="a barcode a line, a table barcode,x,y or a STOmics file")
    p.add_argument("--index-out", required=True)
    p.add_argument("--flavor", default="openst")
    p.add_argument("--cell", help="where the barcode is, as in r1[2:27]")
    p.add_argument("--kmer-length", type=int, default=24)
    p.add_argument("--bulk-id", type=int, default=1)
    p.add_argument("--overlapping", action="store_true")
    p.add_argument("--uuid")
    p.add_argument("--bam-barcode-tag")
    p.add_argument("--bam-sequence-tag")

    p = command("quant", run_quant)
    index_of(p)
    votes(p)
    p.add_argument("--reference", required=True, help="FASTA whose headers begin with gene:")
    p.add_argument("--background-model")
    p.add_argument("--folder-out", required=True)
    p.add_argument("--bin-size", type=float, default=0)

    p = command("search", run_search)
    index_of(p)
    votes(p)
    request(p)
    p.add_argument("--output", help="a folder for all scores")
    p.add_argument("--report", help="a ZIP file")
    p.add_argument("--json", action="store_true")

    p = command("show", run_show)
    index_of(p)
    votes(p)
    request(p)
    p.add_argument("--image-out", required=True)
    p.add_argument("--multichannel", action="store_true")
    p.add_argument("--save-npy", action="store_true")
    p.add_argument("--render-scale", type=float, default=1)
    p.add_argument("--render-smoothing", type=float, default=1.5)
    p.add_argument("--max-pixels", type=int, default=100_000_000)

    p = command("cellxmer", run_cellxmer)
    index_of(p)
    abundance(p)
    p.add_argument("--out", required=True)
    p.add_argument("--save-kmer", action="store_true", help="k-mers, not buckets, as features")
    p.add_argument("--bin-size", type=float, default=0)
    p.add_argument("--w-size", type=int, default=16)
    p.add_argument("--num-buckets", type=int, default=100_000)

    p = command("autoannotate", run_autoannotate)
    p.add_argument("--matrix-in", required=True, help="the folder matrix that quant writes")
    p.add_argument("--out", required=True)
    p.add_argument("--reference", required=True, help="JSON of marker genes by cell type")
    p.add_argument("--min-counts", type=float, default=0)
    p.add_argument("--min-genes", type=int, default=0)
    p.add_argument("--min-cells", type=int, default=0)
    p.add_argument("--top-genes", type=int, default=2000)
    p.add_argument("--clusters", type=int, default=8)

    p = command("combine", run_combine)
    index_of(p)
    p.add_argument("--index-out", required=True)
    p.add_argument("--merge-projects", action="store_true", help="the indices have cells of their own")

    p = command("convert", run_convert)
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--kmer-length", type=int, required=True)
    p.add_argument("--n-cells", type=int, default=0)

    p = command("verify", run_verify)
    p.add_argument("--old", required=True)
    p.add_argument("--new", required=True)
    p.add_argument("--n-sample", type=int, default=100_000)
    p.add_argument("--seed", type=int, default=42)

    p = command("background", run_background)
    p.add_argument("--reference")
    p.add_argument("--counts", help="FASTA of k-mers named by their counts")
    p.add_argument("--kmer-length", type=int, default=24)
    p.add_argument("--output", required=True)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(args) or 0


if __name__ == "__main__":
    sys.exit(main())
