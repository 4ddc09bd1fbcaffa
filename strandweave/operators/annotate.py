"""Annotation of cells and clusters by marker genes. A matrix is (cell_id, feature, value); markers (cell_type, gene)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Added where a logarithm or a ratio must not meet 0.
EPSILON = 1e-9


def annotation_markers(markers: DataFrame) -> DataFrame:
    """Without technical and hallmark sets."""
    return markers.where(~F.col("cell_type").rlike("technical_|HALLMARK_"))


def cluster_means(matrix: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster, feature, mean_in, mean_rest, fold_change, diff: absent entries count as 0. ``clusters``: cell_id, cluster."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    everything = clusters.agg(F.count("*").alias("n_all"))
    own = matrix.join(clusters, "cell_id").groupBy("cluster", "feature").agg(F.sum("value").alias("s"))
    total = own.groupBy("feature").agg(F.sum("s").alias("t"))
    # every cluster by every feature: the result's own rows
    grid = total.join(F.broadcast(sizes.join(F.broadcast(everything), F.lit(True))), F.lit(True))
    joined = grid.join(own, ["cluster", "feature"], "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    inside, rest = F.col("s") / F.col("n"), F.when(F.col("n_all") > F.col("n"), (F.col("t") - F.col("s")) / (F.col("n_all") - F.col("n"))).otherwise(0.0)
    means = joined.select("cluster", "feature", inside.alias("mean_in"), rest.alias("mean_rest"))
    return means.withColumns({"fold_change": (F.col("mean_in") + EPSILON) / (F.col("mean_rest") + EPSILON), "diff": F.col("mean_in") - F.col("mean_rest")})


def marker_scores(means: DataFrame, markers: DataFrame, least_diff: float = 0.4, least_markers: int = 3, top: int = 10) -> DataFrame:
    """cluster, cell_type, score: the geometric mean of the top differences of types with enough markers."""
    present = markers.join(means.select("feature").distinct(), F.col("gene") == F.col("feature"), "left_semi").distinct()
    enough = present.groupBy("cell_type").agg(F.count("*").alias("n")).where(F.col("n") >= least_markers).select("cell_type")
    used = present.join(enough, "cell_type", "left_semi")
    strong = means.where(F.col("diff") > least_diff).join(used, F.col("feature") == F.col("gene"))
    ranked = strong.withColumn("rank", F.row_number().over(Window.partitionBy("cluster", "cell_type").orderBy(F.desc("diff"), "gene")))
    return ranked.groupBy("cluster", "cell_type").agg(F.exp(F.avg(F.when(F.col("rank") <= top, F.log(F.col("diff") + EPSILON)))).alias("score"), F.count("*").alias("n")).where(F.col("n") >= least_markers).drop("n")


def top_markers(means: DataFrame, top: int = 5) -> DataFrame:
    """cluster, markers: the features of the largest differences, as "gene (d.ddx)"."""
    ranked = means.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("diff"), "feature"))).where(F.col("rank") <= top)
    named = F.struct("rank", F.format_string("%s (%.2fx)", F.col("feature").cast("string"), F.col("fold_change")).alias("text"))
    return ranked.groupBy("cluster").agg(F.sort_array(F.collect_list(named)).alias("m")).select("cluster", F.concat_ws(", ", F.col("m.text")).alias("markers"))


def annotate_clusters(scores: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster, label, confidence, score: the best type, or the best two if they are closer than 1.5 times."""
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("score"), "cell_type"))).where("rank <= 2")
    pick = lambda c, r: F.max(F.when(F.col("rank") == r, F.col(c)))
    best = ranked.groupBy("cluster").agg(pick("cell_type", 1).alias("t1"), pick("score", 1).alias("s1"), pick("cell_type", 2).alias("t2"), pick("score", 2).alias("s2"))
    joined = clusters.select("cluster").distinct().join(best, "cluster", "left")
    close = F.col("t2").isNotNull() & (F.col("s1") / F.col("s2") < 1.5)
    label = F.when(F.col("t1").isNull(), "Unknown").when(close, F.concat_ws("/", "t1", "t2")).otherwise(F.col("t1"))
    confidence = F.when(F.col("t1").isNull(), "low").when(close, "medium").otherwise("high")
    return joined.select("cluster", label.alias("label"), confidence.alias("confidence"), F.coalesce("s1", F.lit(0.0)).alias("score"))


def top_cell_types(scores: DataFrame, n: int = 3) -> DataFrame:
    """cell_id, rank, cell_type, score: the n best of each cell. ``scores``: cell_id, cell_type, score."""
    order = Window.partitionBy("cell_id").orderBy(F.desc("score"), "cell_type")
    return scores.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n).select("cell_id", "rank", "cell_type", "score")


def cluster_composition(labels: DataFrame) -> DataFrame:
    """cluster, composition: a type with more than 70 % of the cells, a pair with more than 80 %, or Mixed.

    ``labels``: cell_id, cluster, cell_type."""
    counts = labels.groupBy("cluster", "cell_type").agg(F.count("*").alias("n"))
    own = Window.partitionBy("cluster")
    ranked = counts.withColumns({"share": F.col("n") / F.sum("n").over(own), "rank": F.row_number().over(own.orderBy(F.desc("n"), "cell_type"))}).where("rank <= 2")
    pick = lambda c, r: F.max(F.when(F.col("rank") == r, F.col(c)))
    two = ranked.groupBy("cluster").agg(pick("cell_type", 1).alias("t1"), pick("share", 1).alias("p1"), pick("cell_type", 2).alias("t2"), pick("share", 2).alias("p2"))
    text = F.when(F.col("p1") > 0.7, F.col("t1")).when(F.col("p1") + F.coalesce("p2", F.lit(0.0)) > 0.8, F.concat_ws("/", "t1", "t2")).otherwise("Mixed")
    return two.select("cluster", text.alias("composition"))


def gene_set_score(matrix: DataFrame, genes: DataFrame, controls: DataFrame) -> DataFrame:
    """cell_id, score: the mean over a set of genes less that over control genes, absent entries as 0."""
    sizes = genes.agg(F.count("*").alias("n_set")).join(controls.agg(F.count("*").alias("n_control")), F.lit(True))  # one row each
    marks = genes.select(F.col("gene").alias("feature"), F.lit(1.0).alias("s"), F.lit(0.0).alias("c")).union(controls.select("gene", F.lit(0.0), F.lit(1.0)))
    joined = matrix.join(marks.groupBy("feature").agg(F.max("s").alias("s"), F.max("c").alias("c")), "feature", "left")
    sums = joined.groupBy("cell_id").agg(F.sum(F.col("value") * F.coalesce("s", F.lit(0.0))).alias("a"), F.sum(F.col("value") * F.coalesce("c", F.lit(0.0))).alias("b"))
    mean = lambda x, n: F.when(F.col(n) > 0, F.col(x) / F.col(n)).otherwise(0.0)
    return sums.join(F.broadcast(sizes), F.lit(True)).select("cell_id", (mean("a", "n_set") - mean("b", "n_control")).alias("score"))


def control_genes(matrix: DataFrame, genes: DataFrame, n: int = 50, bins: int = 25) -> DataFrame:
    """gene: up to n other features from each bin of mean expression that a gene of the set is in, of the smallest hashes."""
    means = matrix.groupBy("feature").agg(F.avg("value").alias("m"))
    ends = means.agg(F.percentile("m", F.array(*[F.lit(i / bins) for i in range(1, bins)])).alias("cuts"))
    binned = means.join(F.broadcast(ends), F.lit(True)).select("feature", F.size(F.filter("cuts", lambda c: c < F.col("m"))).alias("bin"))
    wanted = binned.join(genes, F.col("feature") == F.col("gene"), "left_semi").select("bin").distinct()
    others = binned.join(genes, F.col("feature") == F.col("gene"), "left_anti").join(wanted, "bin")
    order = Window.partitionBy("bin").orderBy(F.xxhash64("feature"), "feature")
    return others.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select(F.col("feature").alias("gene"))


def technical_figures(matrix: DataFrame, genes: DataFrame, n_cells: int | None = None) -> DataFrame:
    """feature, mean, pct: over all cells, absent entries as 0."""
    size = matrix.agg(F.count_distinct("cell_id").alias("n")) if n_cells is None else matrix.sparkSession.range(1).select(F.lit(n_cells).alias("n"))
    own = matrix.join(genes, F.col("feature") == F.col("gene"), "left_semi").groupBy("feature").agg(F.sum("value").alias("s"), F.count(F.when(F.col("value") > 0, 1)).alias("k"))
    return own.join(F.broadcast(size), F.lit(True)).select("feature", (F.col("s") / F.col("n")).alias("mean"), (100.0 * F.col("k") / F.col("n")).alias("pct"))


def rank_genes(matrix: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster, feature, t: Welch's t of each cluster against the rest, from sums and sums of squares, absent as 0."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    everything = clusters.agg(F.count("*").alias("n_all"))
    own = matrix.join(clusters, "cell_id").groupBy("cluster", "feature").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    total = own.groupBy("feature").agg(F.sum("s").alias("ts"), F.sum("q").alias("tq"))
    grid = total.join(F.broadcast(sizes.join(F.broadcast(everything), F.lit(True))), F.lit(True)).join(own, ["cluster", "feature"], "left").fillna(0.0, ["s", "q"])
    n, m = F.col("n"), F.col("n_all") - F.col("n")
    mean1, mean2 = F.col("s") / n, (F.col("ts") - F.col("s")) / m
    var1, var2 = (F.col("q") - n * mean1 * mean1) / (n - 1), (F.col("tq") - F.col("q") - m * mean2 * mean2) / (m - 1)
    spread = F.greatest(var1, F.lit(0.0)) / n + F.greatest(var2, F.lit(0.0)) / m
    return grid.where((n > 1) & (m > 1)).select("cluster", "feature", F.when(spread > 0, (mean1 - mean2) / F.sqrt(spread)).otherwise(0.0).alias("t"))


def highly_variable(matrix: DataFrame, n_cells: int, top: int = 2000, bins: int = 20) -> DataFrame:
    """feature, dispersion, z, rank: features by their dispersion against others of like mean."""
    sums = matrix.groupBy("feature").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    mean = F.col("s") / n_cells
    variance = (F.col("q") - n_cells * mean * mean) / (n_cells - 1)
    base = sums.select("feature", F.log1p(mean).alias("m"), F.log(variance / mean).alias("dispersion")).where(F.col("dispersion").isNotNull())
    ends = base.agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("m") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1))).otherwise(0)
    binned = base.join(F.broadcast(ends), F.lit(True)).withColumn("bin", place)
    stats = binned.groupBy("bin").agg(F.avg("dispersion").alias("bm"), F.stddev_samp("dispersion").alias("bs"))  # a row a bin
    z = F.when(F.col("bs") > 0, (F.col("dispersion") - F.col("bm")) / F.col("bs")).otherwise(1.0)
    scored = binned.join(F.broadcast(stats), "bin").select("feature", "dispersion", z.alias("z"))
    return scored.orderBy(F.desc(F.round("z", 9)), "feature").limit(top)


def cluster_cells(matrix: DataFrame, features: list, k: int = 8, components: int = 10, seed: int = 1) -> DataFrame:
    """cell_id, cluster: k-means on principal components of the listed features. Stands in for graph clustering, which
    Spark has no operator for; the number of features is bounded by the list."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    # the list is at hand, so the size of its table is known; PCA takes no more than 65,535 features
    spark, kind = matrix.sparkSession, matrix.schema["feature"].dataType.simpleString()
    places = spark.createDataFrame([(f, i) for i, f in enumerate(features)], f"feature {kind}, place int")
    known = matrix.join(F.broadcast(places), "feature")
    entries = known.groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct("place", F.col("value").cast("double")))).alias("e"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(len(features) - 1)), lambda i: F.coalesce(F.try_element_at("e", i), F.lit(0.0)))
    vectors = entries.select("cell_id", array_to_vector(dense).alias("vector"))
    reduced = PCA(k=min(components, len(features)), inputCol="vector", outputCol="features").fit(vectors).transform(vectors)
    return KMeans(k=k, seed=seed).fit(reduced).transform(reduced).select("cell_id", F.col("prediction").alias("cluster"))
