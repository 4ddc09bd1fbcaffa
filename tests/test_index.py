"""Crafted reads through index, search, merging and streaming."""

import math
import os
import random

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from strandweave.functions import codec, dna
from strandweave.operators import annotate, barcodes, cells, cellxmer, quant, search, spatial, windows
from strandweave.operators import postings as P
from strandweave.plans import catalog, cell_plans
from strandweave.streaming import ingest

QUERY, ABSENT = "ACGTTGCATGCCATGGATCCGTAA", "T" * 24


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def reads(spark):
    r = random.Random(3)
    rows = [(i, QUERY if i < 5 else "".join(r.choices("ACGT", k=60))) for i in range(20)]
    return frame(spark, [*rows, (0, "ACNT"), (30, "")], "cell_id long, seq string")


def brute_where(queries, reads, k, w, need, lo, hi):
    index, out = {}, {}
    for c, s in reads:
        for i in range(len(s) - k + 1):
            index.setdefault(s[i : i + k], set()).add(c)
    for g, s in queries:
        for win in {s[i : i + w] for i in range(len(s) - w + 1)}:
            out.setdefault(g, set()).add(win)
    score = {}
    for g, wins in out.items():
        for win in wins:
            votes = {}
            for j in range(w // k):
                got = index.get(win[j * k : j * k + k], set())
                if lo < len(got) < hi:
                    for c in got:
                        votes[c] = votes.get(c, 0) + 1
            for c, v in votes.items():
                if v >= need:
                    score[g, c] = score.get((g, c), 0) + 1
    return score


def test_search_against_brute_force(spark, reads):
    p = P.build_postings(reads, 4, overlapping=True)
    stats = P.kmer_stats(p)
    r = random.Random(5)
    queries = [(1, QUERY), (1, QUERY[3:]), (2, ABSENT), (3, "".join(r.choices("ACGT", k=40))), (4, "ACG")]
    got = search.where(frame(spark, queries, "group_id long, seq string"), p, stats, 4, 12, 0.65, 0, 100)
    want = brute_where(queries, [(x.cell_id, x.seq) for x in reads.collect() if "N" not in x.seq], 4, 12, search.vote_threshold(12, 4, 0.65), 0, 100)
    assert {(x.group_id, x.cell_id): x.score for x in got.collect()} == want
    assert {x.cell_id for x in got.where("group_id = 1").collect()} >= set(range(5))
    long = P.build_postings(reads, 8, overlapping=True)
    absent = search.where(frame(spark, [(2, ABSENT), (3, QUERY)], "group_id long, seq string"), long, P.kmer_stats(long), 8, 24, 0.65, 0, 100)
    assert {x.group_id for x in absent.collect()} == {3}
    single = search.where(frame(spark, queries, "group_id long, seq string"), p, stats, 4, 12, 0.65, 0, 100, single_count=True)
    assert {(x.group_id, x.cell_id) for x in single.collect()} == set(want) and single.where("score != 1").count() == 0
    strict = search.where(frame(spark, queries, "group_id long, seq string"), p, stats, 4, 12, 0.99, 0, 100)
    assert {(x.group_id, x.cell_id) for x in strict.collect()} <= set(want)


def test_find_kmer_bounds_are_strict(spark):
    reads = frame(spark, [(i, "ACGTACGT") for i in range(3)], "cell_id long, seq string")
    p = P.build_postings(reads, 8)
    stats, wanted = P.kmer_stats(p), P.kmers_of(reads, 8)
    assert search.find_kmer(wanted, p, stats, 2, 4).first().cells == [0, 1, 2]
    assert search.find_kmer(wanted, p, stats, 3, 9).count() == 0
    assert search.find_kmer(wanted, p, stats, 0, 3).count() == 0


def test_write_merge_verify(spark, reads, tmp_path):
    p = P.build_postings(reads, 8, overlapping=True)
    P.write_index(p, f"{tmp_path}/a", {"kmer_size": 8, "n_cells": 31, "uuid": "ua", "own": 1})
    again, stats, meta = P.open_index(spark, f"{tmp_path}/a")
    assert P.verify(p, again).where("status != 'ok'").count() == 0 and meta["own"] == 1
    assert stats.agg(F.sum("n_cells")).first()[0] == again.count()
    assert P.patch_meta(spark, f"{tmp_path}/a", flavor="visium")["own"] == 1
    P.write_index(P.build_postings(frame(spark, [(0, ABSENT)], "cell_id long, seq string"), 8, True), f"{tmp_path}/b", {"kmer_size": 8, "n_cells": 1, "uuid": "ub"})
    P.write_index(p.where(F.lit(False)), f"{tmp_path}/empty", {"kmer_size": 8})
    assert P.open_index(spark, f"{tmp_path}/empty")[0].count() == 0
    assert P.combine(spark, [f"{tmp_path}/{x}" for x in "ab"], f"{tmp_path}/lanes")["n_cells"] == 31
    assert P.open_index(spark, f"{tmp_path}/lanes")[0].count() == p.count() + 1
    meta = P.combine(spark, [f"{tmp_path}/{x}" for x in "ab"], f"{tmp_path}/samples", merge=True)
    assert meta["samples"] == {"ua": 0, "ub": 1} and meta["n_cells"] == 32
    assert {r.status for r in P.verify(p, again.where("cell_id != 0")).collect()} >= {"ok", "mismatch"}


def test_order_of_reads_does_not_matter(spark, reads):
    a, b = P.build_postings(reads, 6), P.build_postings(reads.orderBy(F.rand(1)), 6)
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_offsets_and_csr(spark, reads):
    p = P.build_postings(reads, 6, True)
    rows = sorted(P.kmer_arrays(p).collect())
    at = 0
    for r in rows:
        assert r.offset == at
        at += len(r.cells)
    chunk = frame(spark, [([r.kmer for r in rows], [r.offset for r in rows] + [at], [c for r in rows for c in r.cells])], "indices array<long>, indptr array<int>, data array<long>")
    assert P.csr_to_postings(chunk).exceptAll(p.select("kmer", "cell_id")).count() == 0


def test_barcodes(spark):
    listed = frame(spark, [("ACGT", 0), ("GGGG", 1), ("GGGG", 2), ("AAAA", 3)], "barcode string, cell_id long")
    r1 = frame(spark, [(0, "NNACGT"), (1, "NNGGGG"), (2, "NNTTTT"), (3, "NNA"), (4, "NNAAAA")], "read_no long, seq string")
    r2 = frame(spark, [(i, QUERY) for i in range(4)] + [(4, "AC")], "read_no long, seq string")
    got = barcodes.assign_cells(r1, r2, listed, 2, 6, 8)
    assert sorted((x.read_no, x.cell_id) for x in got.collect()) == [(0, 0), (1, 2)]
    assert sorted((x.read_no, x.cell_id) for x in barcodes.assign_cells(r2, r1, listed, 2, 6, 8, barcode_in_r2=True).collect()) == [(0, 0), (1, 2)]
    tagged = frame(spark, [("ACGT-1", QUERY), (None, QUERY), ("AAAA", QUERY), ("GGGG", "AC"), ("GGGG", None)], "barcode string, seq string")
    assert [x.cell_id for x in barcodes.tagged_cells(tagged, listed, 8).collect()] == [0]
    assert sorted(x[0] for x in barcodes.unique_barcodes(r1, 2, 6).collect()) == ["A", "AAAA", "ACGT", "GGGG", "TTTT"]


def test_streaming_equals_batch(spark, reads, tmp_path):
    reads.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    ingest.start_ingest(stream, f"{tmp_path}/idx", 6, f"{tmp_path}/cp", overlapping=True).awaitTermination()
    ingest.compact(spark, f"{tmp_path}/idx", f"{tmp_path}/out", {"kmer_size": 6})
    want = P.build_postings(reads, 6, True)
    got = P.open_index(spark, f"{tmp_path}/out")[0]
    assert got.count() == want.count() == got.join(want, ["kmer", "cell_id"]).count()


def test_quant_and_background(spark, reads, tmp_path):
    records = frame(spark, [(0, "geneA:tx1", QUERY + QUERY), (1, "geneA:tx2", QUERY), (2, "geneB:tx1", "AC"), (3, "geneA:tx3", ABSENT + ABSENT)], "record_no long, header string, seq string")
    assert [r.run for r in quant.gene_runs(records).orderBy("record_no").collect()] == [1, 1, 2, 3]
    p = P.build_postings(reads, 4, True)
    matrix, features = quant.quantify(records, p, P.kmer_stats(p), 4, 12, count_at_least=0)
    assert [r.gene for r in features.orderBy("feature").collect()] == ["geneA", "geneA"]
    assert tuple(quant.matrix_shape(matrix, features, 31).first())[:2] == (31, 2)
    quant.write_matrix(matrix, features, str(tmp_path), 31)
    assert spark.read.text(f"{tmp_path}/matrix.mtx.entries").count() == matrix.count()
    same = frame(spark, [(0, "a:1", "ACGTACGT"), (1, "b:1", "ACGTACGT")], "record_no long, header string, seq string")
    assert {r.n_genes for r in quant.background_model(same, 4).collect()} == {2}


def test_cell_matrices(spark, reads):
    p = P.build_postings(reads, 8, True)
    assert cellxmer.cell_by_bucket(p, 8, 4, 10).agg(F.sum("value")).first()[0] == p.count()
    ids = frame(spark, [(1,), (2,)], "cell_id long")
    assert [r[0] for r in cellxmer.zero_based(ids, 2, False).collect()] == [0, 1]
    assert [r[0] for r in cellxmer.zero_based(ids, 2, True).collect()] == [1, 2]


def test_intervals(spark):
    got = windows.group_intervals(frame(spark, [(1, p) for p in (10, 15, 20, 40, 46, 90)] + [(2, 16)], "key long, pos long"), 5)
    assert sorted((r.key, r.start, r.end) for r in got.collect()) == [(1, 10, 20), (1, 40, 40), (1, 46, 46), (1, 90, 90), (2, 16, 16)]


def test_space(spark):
    grid = frame(spark, [(10 * i + j, 10.0 * i, 10.0 * j, 1.0) for i in range(10) for j in range(10)], "cell_id long, x double, y double, value double")
    binned = spatial.hexbin(grid, 4)
    bins, matrix = spatial.aggregate_bins(binned, grid.select("cell_id", F.lit(1).alias("feature"), "value"))
    known = binned.where("bin is not null").count()
    assert bins.agg(F.sum("n_joined")).first()[0] == known == matrix.agg(F.sum("value")).first()[0]
    assert spatial.nonsingular(1.0, 1.0, 0.1) == (0.9, 1.1)
    assert spatial.nonsingular(0.0, 0.0) == (-0.001, 0.001)
    assert spatial.nonsingular(3.0, -1.0) == (-1.0, 3.0)
    flat = spatial.smooth(frame(spark, [(5, 5, 4.0)], "px int, py int, value double"), 11, 11, 1.0)
    assert flat.agg(F.sum("value")).first()[0] == pytest.approx(4.0, rel=1e-3)
    nodes = spatial.mesh(spark, (0.0, 90.0, 0.0, 90.0), 15.0).collect()
    for r in spatial.nearest_node(grid, 15.0).where("x < 80 and y < 80").collect():
        assert r.node_distance == pytest.approx(min(((r.x - n.node_x) ** 2 + (r.y - n.node_y) ** 2) ** 0.5 for n in nodes))
    assert spatial.raster(grid, 0.5)[0].agg(F.sum("value")).first()[0] == 100


def test_chi2_and_bh(spark):
    got = frame(spark, [(3.841458820694124, 1), (18.307038053275146, 10), (5.0, 0), (400.0, 10)], "s double, d long").select(cells.chi2_tail("s", "d")).collect()
    assert [round(x[0], 9) for x in got] == [0.05, 0.05, 1.0, 0.0]
    tests = frame(spark, [(i, p) for i, p in enumerate([0.001, 0.008, 0.039, 0.041, 0.9])], "t long, p_value double")
    assert [r.significant for r in cells.benjamini_hochberg(tests, 0.05).orderBy("t").collect()] == [True, True, False, False, False]


def test_expected_cells(spark):
    r = random.Random(1)
    totals = [(i, r.randint(800, 1200)) for i in range(300)] + [(300 + i, r.randint(1, 30)) for i in range(3000)]
    qc = frame(spark, totals, "cell_id long, total long")
    expected, threshold = cells.ordmag_expected(cells.histogram_of_totals(qc))
    assert 250 <= expected <= 350 and 80 < threshold < 160
    assert cells.call_cells(qc).count() == 300
    assert cells.good_turing(frame(spark, [(i, c) for i, c in enumerate([0, 1, 1, 2, 3, 9])], "feature long, value long")).agg(F.sum("p")).first()[0] == pytest.approx(1)


def brute_empty_drops(matrix, threshold, low, high, least, alpha):
    """matrix: {cell: {feature: count}}."""
    totals = {c: sum(v.values()) for c, v in matrix.items()}
    called = {c for c, t in totals.items() if t > threshold}
    profile = {f: 0.0 for v in matrix.values() for f in v}
    for c, v in matrix.items():
        if low <= totals[c] <= high and c not in called:
            for f, n in v.items():
                profile[f] += n
    counts = {}
    for n in profile.values():
        if n > 0:
            counts[n] = counts.get(n, 0) + 1
    x, y, whole = [math.log(r) for r in counts], [math.log(n) for n in counts.values()], sum(r * n for r, n in counts.items())
    mx, my = sum(x) / len(x), sum(y) / len(y)
    slope = sum((a - mx) * (b - my) for a, b in zip(x, y)) / sum((a - mx) ** 2 for a in x)
    unseen, ones = sum(n <= 0 for n in profile.values()), counts.get(1.0, 0)
    raw = {f: (n + 1) * counts.get(n + 1, math.exp(my - slope * mx + slope * math.log(n + 1))) / (counts[n] * whole) if n > 0 else (ones / whole if ones else 0.1) / unseen for f, n in profile.items()}
    p = {f: v / sum(raw.values()) for f, v in raw.items()}
    tests = []
    for c, v in matrix.items():
        if high < totals[c] <= threshold and totals[c] >= least:
            statistic, df = 2 * sum(n * math.log(n / max(p[f] * totals[c], 1e-10)) for f, n in v.items()), len(v) - 1
            half, k, tail = statistic / 2, df / 2, 1.0
            # upper tail of chi-squared by integrating its density over even steps of the variable's logarithm
            if df > 0:
                grid = [half * math.exp(i / 4000) for i in range(16_001)]
                dens = [math.exp(k * math.log(g) - g - math.lgamma(k)) for g in grid]
                tail = sum((a + b) / 2 for a, b in zip(dens, dens[1:])) / 4000
            tests.append((tail, c))
    cut = max((q for i, (q, _) in enumerate(sorted(tests)) if q <= (i + 1) * alpha / len(tests)), default=-1)
    return {c: "OrdMag" for c in called} | {c: "EmptyDrops" for q, c in tests if q <= cut}


def test_empty_drops_against_brute_force(spark):
    r = random.Random(4)
    matrix = {}
    for c in range(160):
        size, skew = (r.randint(900, 1200), 3) if c < 20 else (r.randint(150, 300), 3 if c < 60 else 1) if c < 90 else (r.randint(5, 60), 1)
        weights = [1 + (f % 4 == 0) * 9 * (skew > 1) + f % 3 for f in range(40)]
        matrix[c] = {}
        for f in r.choices(range(40), weights, k=size):
            matrix[c][f] = matrix[c].get(f, 0) + 1
    df = frame(spark, [(c, f, n) for c, v in matrix.items() for f, n in v.items()], "cell_id long, feature long, value long")
    got = {x.cell_id: x.method for x in cells.empty_drops(df, 800, 1, 100, 120, 0.01).collect()}
    assert got == brute_empty_drops(matrix, 800, 1, 100, 120, 0.01)
    assert {"OrdMag", "EmptyDrops"} == set(got.values()) and not any(c >= 90 for c in got)


def test_ranks_with_ties_and_reals(spark):
    r = random.Random(6)
    rows = [(i * 977, float(r.choice([1, 1, 1, 2, 3, r.random() * 50]))) for i in range(3000)] + [(-5, 0.0), (-9000, 1.0)]
    got = {x.cell_id: x.rank for x in cells.barcode_rank(frame(spark, rows, "cell_id long, total double")).collect()}
    assert got == {c: i + 1 for i, (_, c) in enumerate(sorted((-t, c) for c, t in rows))}


def test_crowded_p_values(spark):
    r = random.Random(7)
    ps = [0.0] * 500 + [1.0] * 800 + [r.random() ** 6 for _ in range(2000)]
    got = cells.benjamini_hochberg(frame(spark, list(enumerate(ps)), "t long, p_value double"), 0.05).collect()
    cut = max(p for i, p in enumerate(sorted(ps)) if p <= (i + 1) * 0.05 / len(ps))
    assert len(got) == len(ps) and all(x.significant == (x.p_value <= cut) for x in got)


def test_runs_over_blocks(spark):
    r = random.Random(8)
    numbers = sorted(r.sample(range(1 << 19), 400)) + [(1 << 40) + i for i in range(5)]
    genes = [r.choice("AB") if i % 50 else "C" for i in range(400)] + [None, None, "A", "A", None]
    rows = [(n, None if g is None else f"{g}:x", "ACGT") for n, g in zip(numbers, genes)]
    want, run, last = {}, 0, object()
    for n, g in zip(numbers, genes):
        run, last = run + (g != last), g
        want[n] = run
    got = quant.gene_runs(frame(spark, rows, "record_no long, header string, seq string")).collect()
    assert {x.record_no: x.run for x in got} == want


def test_offsets_at_any_k(spark):
    r = random.Random(9)
    for k in (3, 8, 16, 31):
        kmers = sorted({r.randrange(4**k) for _ in range(300)} | {0, 4**k - 1})
        rows = [(x, c) for x in kmers for c in range(r.randint(1, 4))]
        got = [(x.kmer, x.offset) for x in P.kmer_arrays(frame(spark, rows, "kmer long, cell_id long"), k=k).orderBy("kmer").collect()]
        before, want = 0, []
        for x in kmers:
            want.append((x, before))
            before += sum(y == x for y, _ in rows)
        assert got == want


def test_smoothing_against_numpy(spark):
    import numpy as np

    r = np.random.default_rng(3)
    for nx, ny in ((9, 4), (3, 20)):  # narrower than the kernel too
        image = r.random((nx, ny)) * (r.random((nx, ny)) < 0.4)
        weights = np.array(spatial.kernel_of(1.5))
        reach, want = len(weights) // 2, image
        for axis in (0, 1):
            wide = np.pad(want, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
            want = np.apply_along_axis(np.convolve, axis, wide, weights, mode="valid")
        rows = [(i, j, float(v)) for (i, j), v in np.ndenumerate(image) if v]
        got = np.zeros((nx, ny))
        for x in spatial.smooth(frame(spark, rows, "px int, py int, value double"), nx, ny).collect():
            got[x.px, x.py] = x.value
        assert np.allclose(got, want)


def test_control_genes(spark):
    rows = [(c, f, float(1 + f // 10)) for f in range(40) for c in range(3)]
    genes = frame(spark, [(5,), (25,)], "gene long")
    found = {x.gene for x in annotate.control_genes(frame(spark, rows, "cell_id long, feature long, value double"), genes, n=4, bins=4).collect()}
    assert len(found) == 8 and not found & {5, 25} and {f // 10 for f in found} == {0, 2}


def test_annotation(spark):
    labels = frame(spark, [(i, 0, "T" if i < 8 else "B") for i in range(10)] + [(i, 1, "TBNM"[i % 4]) for i in range(10, 22)], "cell_id long, cluster long, cell_type string")
    assert {r.cluster: r.composition for r in annotate.cluster_composition(labels).collect()} == {0: "T", 1: "Mixed"}
    scores = frame(spark, [(1, "a", 2.0), (1, "b", 1.9), (2, "a", 9.0), (2, "b", 1.0)], "cluster long, cell_type string, score double")
    clusters = frame(spark, [(1, 1), (2, 2), (3, 3)], "cell_id long, cluster long")
    assert {r.cluster: (r.label, r.confidence) for r in annotate.annotate_clusters(scores, clusters).collect()} == {1: ("a/b", "medium"), 2: ("a", "high"), 3: ("Unknown", "low")}


def test_kmers_beside_other_letters(spark):
    """Letters of several bytes, as any that isn't a base, take one place and give no k-mer; lower case and U are read."""
    reads = frame(spark, [(1, "acguéAACC"), (2, "AANCCC\U0001f600GG"), (3, ""), (4, None), (5, "ACG")], "cell_id long, seq string")
    named = lambda df: sorted(tuple(r) for r in df.select("cell_id", codec.decode(F.col("kmer"), 3)).collect())
    assert named(P.kmers_of(reads, 3, overlapping=True)) == [(1, "AAC"), (1, "ACC"), (1, "ACG"), (1, "CGT"), (2, "CCC"), (5, "ACG")]
    assert named(P.kmers_of(reads, 3)) == [(1, "ACC"), (1, "ACG"), (2, "CCC"), (5, "ACG")]


def test_stored_index_comes_back(spark):
    import shutil

    from strandweave.plans import index_plans

    tables = catalog.Tables(spark, DATA)
    n = index_plans.stored_index(tables)[0].count()
    path = index_plans._stored[spark.sparkContext.applicationId, DATA]
    assert index_plans.stored_index(tables)[0].count() == n and index_plans._stored[spark.sparkContext.applicationId, DATA] == path
    shutil.rmtree(path.removeprefix("file://"))
    assert index_plans.stored_index(tables)[0].count() == n


def test_merge_samples_keeps_other_languages(spark, same, tmp_path):
    for name in os.listdir(DATA):
        if name != "documents.parquet":
            os.symlink(f"{DATA}/{name}", tmp_path / name)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    lang = F.when(F.col("doc_id") % 5 == 0, "it").when(F.col("doc_id") % 5 == 1, F.lit(None)).otherwise(F.col("lang"))
    docs.withColumn("lang", lang).coalesce(1).write.parquet(f"{tmp_path}/new")
    os.rename(next((tmp_path / "new").glob("part-*.parquet")), tmp_path / "documents.parquet")
    same(catalog.QUERIES["merge_samples"](spark, str(tmp_path)), catalog.ORACLE_SQL["merge_samples"], str(tmp_path))


def test_kmeans_takes_all_features(spark, monkeypatch, tmp_path):
    for name in os.listdir(DATA):
        if name not in ("part.parquet", "lineitem.parquet"):
            os.symlink(f"{DATA}/{name}", tmp_path / name)
    spark.range(700).selectExpr("id AS p_partkey", "concat('brand', id) AS p_brand", "'x y' AS p_type").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(1400).selectExpr("id % 700 AS l_partkey", "id % 20 AS l_suppkey", "id % 9 + 1.0D AS l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    taken = []
    monkeypatch.setattr(cell_plans.annotate, "cluster_cells", lambda matrix, features, **_: taken.extend(features) or matrix)
    catalog.QUERIES["kmeans_clusters"](spark, str(tmp_path))
    assert len(taken) == 700


def test_kmers_across_chunks(spark, monkeypatch):
    import numpy as np

    r = random.Random(4)
    seqs = ["".join(r.choices("0123N", [9, 9, 9, 9, 1], k=r.randint(0, 90))) for _ in range(40)]
    data, offsets = np.frombuffer("".join(seqs).encode(), np.uint8), np.cumsum([0] + [len(x) for x in seqs])
    for chunk in (7, 1000):
        monkeypatch.setattr(P, "CHUNK", chunk)
        for k, overlapping in ((1, True), (5, False), (8, True), (24, False), (31, True)):
            want = []
            for i, x in enumerate(seqs):
                last = len(x) - k
                places = range(last + 1) if overlapping else [min(j, last) for j in range(0, len(x), k)] if last >= 0 else []
                want += [(i, int(x[p : p + k], 4)) for p in places if "N" not in x[p : p + k]]
            cut = [(a, b) for rows, kmers in P._cut(data, offsets, k, overlapping) for a, b in zip(rows.tolist(), kmers.tolist())]
            assert cut == want
            once = P._once(*np.array(cut, np.int64).reshape(-1, 2).T, k)
            assert sorted(zip(once[0].tolist(), once[1].tolist())) == sorted(set(want))


def shuffles(df) -> int:
    """How often all rows are shuffled, in the plan before it runs."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")


def test_repeated_postings_need_one_shuffle(spark, reads):
    k = 6
    want = P.build_postings(reads, k, True)
    twice = P.postings_of(reads.union(reads), k, True)
    assert shuffles(want) == shuffles(P.merge_lanes(twice, twice)) == shuffles(P.cell_changes(twice, twice)) == 1
    assert P.merge_lanes(twice, twice).exceptAll(want).count() == want.exceptAll(P.merge_lanes(twice, twice)).count() == 0
    assert P.cell_changes(twice, want).count() == 0
    some = want.where("cell_id % 2 = 0")
    lost, gained = want.where("cell_id % 2 = 1"), P.cell_changes(some.union(some), twice)
    assert gained.where("change != 'gained'").count() == 0 and gained.drop("change").exceptAll(lost).count() == lost.exceptAll(gained.drop("change")).count() == 0


def test_offsets_of_repeated_postings(spark, reads):
    want = P.kmer_arrays(P.build_postings(reads, 31, True))
    got = P.kmer_arrays(P.postings_of(reads.union(reads), 31, True), repeated=True)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    offsets = got.select("kmer", "offset")
    offsets.collect()
    plan = offsets._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan


def test_index_of_repeated_postings(spark, reads, tmp_path):
    want = P.build_postings(reads, 8, True)
    P.write_index(P.postings_of(reads.union(reads), 8, True), f"{tmp_path}/a", {"kmer_size": 8}, repeated=True)
    got, stats, _ = P.open_index(spark, f"{tmp_path}/a")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    assert sorted(map(tuple, stats.collect())) == sorted(map(tuple, P.kmer_stats(want).collect()))


def test_held_windows_are_joined_windows(spark, reads, monkeypatch):
    p = P.build_postings(reads, 4, overlapping=True)
    stats, queries = P.kmer_stats(p), frame(spark, [("a", QUERY), ("b", QUERY[3:]), ("c", ABSENT)], "group_id string, seq string")
    for single in (False, True):
        args = (queries, p, stats, 4, 12, 0.65, 0, 100, single)
        monkeypatch.undo()
        held = search.where(*args)
        monkeypatch.setattr(search, "LOOKED_UP", 1)  # a cell at once
        few = search.where(*args)
        monkeypatch.setattr(search, "HELD", 0)
        joined = search.where(*args)
        assert " Join" not in held._jdf.queryExecution().analyzed().toString().replace("Join LeftSemi", "")
        assert sorted(map(tuple, held.collect())) == sorted(map(tuple, few.collect())) == sorted(map(tuple, joined.collect())) != []
    assert search.where(queries.where("group_id = 'none'"), p, stats, 4, 12).columns == ["group_id", "cell_id", "score"]


def test_texts_are_cleaned_once(spark):
    texts = [None, "", "acgu N", "\ufb06ra\u1e97e \u1e9a ug", "AC\nGT\U0001f600t", "\u0131\u00df"]
    rows = frame(spark, list(enumerate(texts)), "id long, text string")
    assert sorted(map(tuple, dna.with_bases(rows).collect())) == sorted(map(tuple, rows.select("id", dna.bases_only(F.col("text")).alias("seq")).collect()))


def test_postings_of_any_ids(spark, monkeypatch):
    """Packed or as Arrow has them, parts give what a set gives, in order within a part."""
    r = random.Random(12)
    text = lambda: "".join(r.choices("ACGTUacgtNé\U0001f600 ", [4] * 9 + [1] * 4, k=r.randint(0, 60)))
    ids = {
        "cell_id long": [5, -(1 << 63), (1 << 63) - 1, 0],
        "cell_id int": [7, -7, None, 1],
        "cell_id string": ["a", None, "", "b"],
        "sample_id int, cell_id long": [(1, 5), (2, 5), (1, 6), (2, -1)],
        "sample_id string, cell_id long": [("x", 5), (None, 5), ("x", None), ("y", 1 << 40)],
    }
    for names, cells in ids.items():
        rows = [(*(c if isinstance(c, tuple) else (c,)), text()) for c in cells * 6] + [(*(c if isinstance(c, tuple) else (c,)), None) for c in cells[:1]]
        reads = frame(spark, rows, f"{names}, seq string").repartition(3)
        for k, dealt, bases in ((3, 1, False), (8, 1 << 22, True), (20, 9, True), (31, 1 << 22, True)):
            monkeypatch.setattr(P, "DEALT", dealt)
            clean = lambda s: "".join(c for c in (s or "").upper().replace("U", "T") if c in "ACGT" or not bases)
            words = {(*row[:-1], clean(row[-1])[i : i + k]) for row in rows for i in range(len(clean(row[-1])) - k + 1)}
            want = {(int(w[-1].translate(str.maketrans("ACTG", "0123")), 4), *w[:-1]) for w in words if set(w[-1]) <= set("ACGT")}
            got = P.build_postings(reads, k, True, bases)
            found = list(map(tuple, got.collect()))
            assert len(found) == len(set(found)) and set(found) == want
            assert sorted(map(repr, map(tuple, P.postings_of(reads, k, True, bases).distinct().collect()))) == sorted(map(repr, want))


def test_an_index_takes_one_pass_and_shuffles_parts(spark, tmp_path):
    """Texts are read once, not once more for the bounds of ranges, and a task shuffles a row a part, not a row a posting."""
    texts = frame(spark, [(i, "".join(random.Random(i).choices("ACGT", k=900))) for i in range(60)], "cell_id long, seq string")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    postings = P.build_postings(texts.coalesce(1).mapInArrow(counted, texts.schema), 8, overlapping=True)
    P.write_index(postings, f"{tmp_path}/a", {"kmer_size": 8}, dealt=True)
    assert read.value == 60
    stored, stats, _ = P.open_index(spark, f"{tmp_path}/a")
    assert stored.count() == stored.distinct().count() == stats.agg(F.sum("n_cells")).first()[0] > 50_000
    plan = postings._jdf.queryExecution().executedPlan().toString()
    assert shuffles(postings) == 1 and "hashpartitioning(part" in plan and "Aggregate" not in plan


def test_held_windows_with_any_ids(spark, monkeypatch):
    """Null is a cell like others; hits are shuffled as parts, not a row each."""
    r = random.Random(13)
    texts = [QUERY, QUERY[:20], QUERY[2:], "".join(r.choices("ACGT", k=50)), QUERY * 2]
    ids = {
        "cell_id long": [5, None, (1 << 63) - 1, -(1 << 63), 0],
        "cell_id string": ["a", None, "", "b", "c"],
        "sample_id int, cell_id long": [(1, 5), (2, 5), (None, 5), (1, None), (2, 6)],
    }
    for names, cells in ids.items():
        rows = [(*(c if isinstance(c, tuple) else (c,)), x) for c, x in zip(cells, texts)]
        p = P.build_postings(frame(spark, rows, f"{names}, seq string"), 4, overlapping=True)
        queries = frame(spark, [(1, QUERY), (2, QUERY[5:]), (None, texts[3])], "group_id long, seq string")
        for single in (False, True):
            args = (queries, p, P.kmer_stats(p), 4, 12, 0.65, 0, 100, single)
            monkeypatch.undo()
            held = search.where(*args)
            assert "hashpartitioning(part" in held._jdf.queryExecution().executedPlan().toString()
            monkeypatch.setattr(search, "HELD", 0)
            joined = search.where(*args)
            assert held.columns == joined.columns and sorted(map(repr, map(tuple, held.collect()))) == sorted(map(repr, map(tuple, joined.collect()))) != []
