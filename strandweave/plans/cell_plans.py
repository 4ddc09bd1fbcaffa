"""Cell calling and annotation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotate, cells
from .catalog import MATRIX, matrix_of, query

_QC = f"{MATRIX}, qc AS (SELECT cell_id, sum(value) AS total, count(*) FILTER (value > 0) AS n_features FROM matrix GROUP BY cell_id)"


@query("qc_metrics", f"WITH {_QC} SELECT * FROM qc")
def _(t):
    return cells.qc_metrics(matrix_of(t))


@query("barcode_rank", f"WITH {_QC} SELECT cell_id, total, n_features, row_number() OVER (ORDER BY total DESC, cell_id) AS rank FROM qc")
def _(t):
    return cells.barcode_rank(cells.qc_metrics(matrix_of(t)))


@query("filter_cells_genes", f"WITH {_QC}, kept AS (SELECT m.* FROM matrix m SEMI JOIN (SELECT cell_id FROM qc WHERE total >= 1000 AND n_features >= 20) q USING (cell_id)) SELECT * FROM kept SEMI JOIN (SELECT feature FROM kept WHERE value > 0 GROUP BY feature HAVING count(*) >= 3) f USING (feature)")
def _(t):
    return cells.filter_matrix(matrix_of(t), 1000, 20, 3)


@query("normalize_log1p", f"WITH {_QC} SELECT cell_id, feature, round(ln(1 + value * (SELECT quantile_cont(total, 0.5) FROM qc) / total), 6) AS value FROM matrix JOIN qc USING (cell_id)")
def _(t):
    return cells.normalize_log1p(matrix_of(t)).withColumn("value", F.round("value", 6))


_AMBIENT = f"{_QC}, cut AS (SELECT quantile_cont(total, 0.5) AS m FROM qc), ambient AS (SELECT cell_id FROM qc, cut WHERE total BETWEEN 1 AND m), prof AS (SELECT feature, coalesce(sum(value) FILTER (cell_id IN (SELECT cell_id FROM ambient)), 0) AS value FROM matrix GROUP BY feature)"


def profile_of(t):
    matrix = matrix_of(t)
    qc = cells.qc_metrics(matrix)
    median = qc.agg(F.percentile("total", F.lit(0.5))).first()[0]
    return matrix, qc, median, cells.ambient_profile(matrix, qc, 1, median)


@query("ambient_profile", f"WITH {_AMBIENT} SELECT feature, CAST(value AS DOUBLE) AS value FROM prof")
def _(t):
    return profile_of(t)[3].withColumn("value", F.col("value").cast("double"))


_TURING = f"""{_AMBIENT}, n AS (SELECT CAST(value AS DOUBLE) AS r, CAST(count(*) AS DOUBLE) AS n FROM prof WHERE value > 0 GROUP BY value),
line AS (SELECT regr_slope(ln(n), ln(r)) AS b, regr_intercept(ln(n), ln(r)) AS a, sum(r * n) AS total FROM n),
unseen AS (SELECT count(*) FILTER (value <= 0) AS n0, count(*) FILTER (value = 1) AS n1 FROM prof),
raw AS (SELECT feature, CASE WHEN value > 0 THEN (value + 1) * coalesce(m.n, exp(a + b * ln(value + 1))) / (n.n * total) ELSE CASE WHEN n1 > 0 THEN n1 / total ELSE 0.1 END / n0 END AS p
  FROM prof LEFT JOIN n ON n.r = value LEFT JOIN n m ON m.r = value + 1, line, unseen),
turing AS (SELECT feature, p / (SELECT sum(p) FROM raw) AS p FROM raw)"""


@query("good_turing", f"WITH {_TURING} SELECT feature, round(p, 9) AS p FROM turing")
def _(t):
    return cells.good_turing(profile_of(t)[3]).withColumn("p", F.round("p", 9))


_STAT = f"""{_TURING}, own AS (SELECT m.cell_id, m.feature, m.value, q.total FROM matrix m JOIN qc q USING (cell_id), cut WHERE q.total > cut.m AND value > 0)
SELECT cell_id, round(2 * sum(value * ln(value / greatest(p * total, 1e-10))), 4) AS statistic, count(*) - 1 AS df FROM own JOIN turing USING (feature) GROUP BY cell_id"""


def tests_of(t):
    matrix, qc, median, profile = profile_of(t)
    return cells.ambient_statistic(matrix, cells.good_turing(profile), qc.where(F.col("total") > median))


@query("emptydrops_stat", f"WITH {_STAT}")
def _(t):
    return tests_of(t).withColumn("statistic", F.round("statistic", 4))


@query("emptydrops_p_values")
def _(t):
    return tests_of(t).withColumn("p_value", cells.chi2_tail("statistic", "df"))


@query("empty_drops")
def _(t):
    matrix = matrix_of(t)
    low, mid, high = cells.qc_metrics(matrix).agg(F.percentile("total", F.array(F.lit(0.2), F.lit(0.3), F.lit(0.9)))).first()[0]
    return cells.empty_drops(matrix, high, 1, low, mid)


_P = "p AS (SELECT o_orderkey AS test, o_totalprice / (SELECT max(o_totalprice) * 4 FROM orders) AS p_value FROM orders)"


@query(
    "bh_fdr",
    f"WITH {_P}, r AS (SELECT *, count(*) OVER (ORDER BY p_value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS j, count(*) OVER () AS m FROM p) SELECT test, coalesce(p_value <= (SELECT max(p_value) FROM r WHERE p_value <= j * 0.2 / m), false) AS significant FROM r",
)
def _(t):
    orders = t("orders")
    most = orders.agg((F.max("o_totalprice") * 4).alias("most"))
    tests = orders.join(F.broadcast(most), F.lit(True)).select(F.col("o_orderkey").alias("test"), (F.col("o_totalprice") / F.col("most")).alias("p_value"))
    return cells.benjamini_hochberg(tests, 0.2).select("test", "significant")


# suppliers' nations are clusters; parts are genes, and their brands cell types
_CLUSTERED = f"{MATRIX}, cl AS (SELECT s_suppkey AS cell_id, s_nationkey AS cluster FROM supplier), sz AS (SELECT cluster, count(*) AS n, (SELECT count(*) FROM cl) AS n_all FROM cl GROUP BY cluster)"
_MEANS = f"""{_CLUSTERED}, bm AS (SELECT l_suppkey AS cell_id, p_brand AS feature, sum(l_quantity) / 10.0 AS value FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
own AS (SELECT cluster, feature, sum(value) AS s, sum(value * value) AS q FROM bm JOIN cl USING (cell_id) GROUP BY ALL), tot AS (SELECT feature, sum(s) AS t, sum(q) AS tq FROM own GROUP BY feature),
grid AS (SELECT sz.*, tot.*, coalesce(s, 0) AS s, coalesce(q, 0) AS q FROM sz CROSS JOIN tot LEFT JOIN own ON own.cluster = sz.cluster AND own.feature = tot.feature),
means AS (SELECT cluster, feature, s / n AS mean_in, CASE WHEN n_all > n THEN (t - s) / (n_all - n) ELSE 0 END AS mean_rest FROM grid),
d AS (SELECT *, mean_in - mean_rest AS diff, (mean_in + 1e-9) / (mean_rest + 1e-9) AS fold_change FROM means)"""


def clusters_of(t):
    return t("supplier").select(F.col("s_suppkey").alias("cell_id"), F.col("s_nationkey").alias("cluster"))


def brands_of(t):
    """cell_id, feature, value: brands as genes."""
    sold = t("lineitem").join(t("part"), F.col("p_partkey") == F.col("l_partkey"))
    return sold.groupBy(F.col("l_suppkey").alias("cell_id"), F.col("p_brand").alias("feature")).agg((F.sum("l_quantity") / 10.0).alias("value"))


def markers_of(t):
    """cell_type, gene: the first word of a part's type, and the brands that come in it."""
    return t("part").select(F.substring_index("p_type", " ", 1).alias("cell_type"), F.col("p_brand").alias("gene")).distinct()


_MARKERS = "mk AS (SELECT DISTINCT string_split(p_type, ' ')[1] AS cell_type, p_brand AS gene FROM part)"


@query("annotation_markers", "SELECT DISTINCT string_split(p_type, ' ')[1] AS cell_type, p_brand AS gene FROM part WHERE p_size % 3 = 0")
def _(t):
    named = F.when(F.col("p_size") % 3 == 1, F.concat(F.lit("technical_"), F.substring_index("p_type", " ", 1))).when(F.col("p_size") % 3 == 2, F.concat(F.lit("HALLMARK_"), "p_type")).otherwise(F.substring_index("p_type", " ", 1))
    return annotate.annotation_markers(t("part").select(named.alias("cell_type"), F.col("p_brand").alias("gene"))).distinct()


@query("cluster_fold_change", f"WITH {_MEANS} SELECT cluster, feature, round(mean_in, 6) AS mean_in, round(mean_rest, 6) AS mean_rest, round(diff, 6) AS diff, round(fold_change, 4) AS fold_change FROM d")
def _(t):
    m = annotate.cluster_means(brands_of(t), clusters_of(t))
    return m.select("cluster", "feature", *[F.round(c, 6).alias(c) for c in ("mean_in", "mean_rest", "diff")], F.round("fold_change", 4).alias("fold_change"))


_SCORES = f"""{_MEANS}, {_MARKERS}, enough AS (SELECT cell_type FROM mk WHERE gene IN (SELECT feature FROM d) GROUP BY cell_type HAVING count(*) >= 3),
strong AS (SELECT cluster, cell_type, gene, diff, row_number() OVER (PARTITION BY cluster, cell_type ORDER BY diff DESC, gene) AS r FROM d JOIN mk ON gene = feature SEMI JOIN enough USING (cell_type) WHERE diff > 0.4),
scores AS (SELECT cluster, cell_type, exp(avg(ln(diff + 1e-9)) FILTER (r <= 10)) AS score FROM strong GROUP BY ALL HAVING count(*) >= 3)"""


def marker_scores_of(t):
    return annotate.marker_scores(annotate.cluster_means(brands_of(t), clusters_of(t)), annotate.annotation_markers(markers_of(t)))


@query("marker_scores", f"WITH {_SCORES} SELECT cluster, cell_type, round(score, 6) AS score FROM scores")
def _(t):
    return marker_scores_of(t).withColumn("score", F.round("score", 6))


@query(
    "annotate_clusters",
    f"WITH {_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, cell_type) AS r FROM scores), two AS (SELECT cluster, max(cell_type) FILTER (r = 1) AS t1, max(score) FILTER (r = 1) AS s1, max(cell_type) FILTER (r = 2) AS t2, max(score) FILTER (r = 2) AS s2 FROM r GROUP BY cluster)"
    " SELECT c.cluster, CASE WHEN t1 IS NULL THEN 'Unknown' WHEN t2 IS NOT NULL AND s1 / s2 < 1.5 THEN t1 || '/' || t2 ELSE t1 END AS label, CASE WHEN t1 IS NULL THEN 'low' WHEN t2 IS NOT NULL AND s1 / s2 < 1.5 THEN 'medium' ELSE 'high' END AS confidence, round(coalesce(s1, 0), 6) AS score FROM (SELECT DISTINCT cluster FROM cl) c LEFT JOIN two USING (cluster)",
)
def _(t):
    return annotate.annotate_clusters(marker_scores_of(t), clusters_of(t)).withColumn("score", F.round("score", 6))


@query(
    "top_markers",
    f"WITH {_MEANS}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY diff DESC, feature) AS r FROM d) SELECT cluster, string_agg(format('{{}} ({{:.2f}}x)', feature, fold_change), ', ' ORDER BY r) AS markers FROM r WHERE r <= 5 GROUP BY cluster",
)
def _(t):
    return annotate.top_markers(annotate.cluster_means(brands_of(t), clusters_of(t)))


_TYPES = "ts AS (SELECT l_suppkey AS cell_id, string_split(p_type, ' ')[1] AS cell_type, sum(l_quantity) AS score FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)"


def type_scores(t):
    sold = t("lineitem").join(t("part"), F.col("p_partkey") == F.col("l_partkey"))
    return sold.groupBy(F.col("l_suppkey").alias("cell_id"), F.substring_index("p_type", " ", 1).alias("cell_type")).agg(F.sum("l_quantity").alias("score"))


@query("top_cell_types", f"WITH {_TYPES} SELECT * FROM (SELECT cell_id, row_number() OVER (PARTITION BY cell_id ORDER BY score DESC, cell_type) AS rank, cell_type, score FROM ts) WHERE rank <= 3")
def _(t):
    return annotate.top_cell_types(type_scores(t), 3)


@query(
    "cluster_composition",
    f"WITH {_TYPES}, best AS (SELECT cell_id, cell_type FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY score DESC, cell_type) AS r FROM ts) WHERE r = 1), n AS (SELECT s_nationkey AS cluster, cell_type, count(*) AS n FROM best JOIN supplier ON s_suppkey = cell_id GROUP BY ALL),"
    " r AS (SELECT *, n / sum(n) OVER (PARTITION BY cluster) AS p, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, cell_type) AS r FROM n), two AS (SELECT cluster, max(cell_type) FILTER (r = 1) AS t1, max(p) FILTER (r = 1) AS p1, max(cell_type) FILTER (r = 2) AS t2, max(p) FILTER (r = 2) AS p2 FROM r GROUP BY cluster)"
    " SELECT cluster, CASE WHEN p1 > 0.7 THEN t1 WHEN p1 + coalesce(p2, 0) > 0.8 THEN t1 || '/' || t2 ELSE 'Mixed' END AS composition FROM two",
)
def _(t):
    best = annotate.top_cell_types(type_scores(t), 1).join(clusters_of(t), "cell_id")
    return annotate.cluster_composition(best.select("cell_id", "cluster", "cell_type"))


def _genes(t, first: str):
    return markers_of(t).where(F.col("cell_type") == first).select("gene")


@query(
    "gene_set_score",
    "WITH m AS (SELECT l_suppkey AS cell_id, p_brand AS feature, sum(l_quantity) / 10.0 AS value FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL), g AS (SELECT DISTINCT p_brand AS gene FROM part WHERE p_size < 3), c AS (SELECT DISTINCT p_brand AS gene FROM part WHERE p_size >= 3)"
    " SELECT cell_id, round(coalesce(sum(value) FILTER (feature IN (SELECT gene FROM g)), 0) / (SELECT count(*) FROM g) - coalesce(sum(value) FILTER (feature IN (SELECT gene FROM c)), 0) / (SELECT count(*) FROM c), 6) + 0.0 AS score FROM m GROUP BY cell_id",
)
def _(t):
    pick = lambda on: t("part").where(on).select(F.col("p_brand").alias("gene")).distinct()
    return annotate.gene_set_score(brands_of(t), pick("p_size < 3"), pick("p_size >= 3")).select("cell_id", (F.round("score", 6) + 0.0).alias("score"))


@query("technical_figures", "WITH m AS (SELECT l_suppkey AS cell_id, p_brand AS feature, sum(l_quantity) / 10.0 AS value FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL) SELECT feature, round(sum(value) / (SELECT count(DISTINCT cell_id) FROM m), 6) AS mean, round(100.0 * count(*) FILTER (value > 0) / (SELECT count(DISTINCT cell_id) FROM m), 6) AS pct FROM m GROUP BY feature")
def _(t):
    genes = t("part").select(F.col("p_brand").alias("gene")).distinct()
    return annotate.technical_figures(brands_of(t), genes).select("feature", F.round("mean", 6).alias("mean"), F.round("pct", 6).alias("pct"))


@query(
    "rank_genes_ttest",
    f"WITH {_MEANS}, v AS (SELECT *, n_all - n AS m, s / n AS m1, (t - s) / (n_all - n) AS m2 FROM grid WHERE n > 1 AND n_all - n > 1), w AS (SELECT *, greatest((q - n * m1 * m1) / (n - 1), 0) / n + greatest((tq - q - m * m2 * m2) / (m - 1), 0) / m AS w FROM v) SELECT cluster, feature, round(CASE WHEN w > 0 THEN (m1 - m2) / sqrt(w) ELSE 0 END, 5) + 0.0 AS t FROM w",
)
def _(t):
    return annotate.rank_genes(brands_of(t), clusters_of(t)).select("cluster", "feature", (F.round("t", 5) + 0.0).alias("t"))


@query(
    "highly_variable",
    f"""WITH {_QC}, x AS (SELECT feature, ln(1 + value * (SELECT quantile_cont(total, 0.5) FROM qc) / total) AS v FROM matrix JOIN qc USING (cell_id)), c AS (SELECT count(*) AS n FROM supplier),
s AS (SELECT feature, sum(v) / any_value(n) AS mean, (sum(v * v) - sum(v) * sum(v) / any_value(n)) / (any_value(n) - 1) AS var FROM x, c GROUP BY feature), b AS (SELECT feature, ln(1 + mean) AS m, ln(var / mean) AS dispersion FROM s WHERE var > 0),
e AS (SELECT min(m) AS lo, max(m) AS hi FROM b), g AS (SELECT feature, dispersion, CASE WHEN hi > lo THEN least(floor((m - lo) * 20 / (hi - lo)), 19) ELSE 0 END AS bin FROM b, e),
t AS (SELECT bin, avg(dispersion) AS bm, stddev_samp(dispersion) AS bs FROM g GROUP BY bin)
SELECT feature, round(dispersion, 5) AS dispersion, round(CASE WHEN bs > 0 THEN (dispersion - bm) / bs ELSE 1 END, 4) AS z FROM g JOIN t USING (bin) ORDER BY round(CASE WHEN bs > 0 THEN (dispersion - bm) / bs ELSE 1 END, 9) DESC, feature LIMIT 200""",
)
def _(t):
    found = annotate.highly_variable(cells.normalize_log1p(matrix_of(t)), t("supplier").count(), top=200)
    return found.select("feature", F.round("dispersion", 5).alias("dispersion"), F.round("z", 4).alias("z"))


@query("kmeans_clusters")
def _(t):
    brands = brands_of(t)
    # all brands, which a catalogue has few of; PCA fails beyond 65,535
    features = sorted(r[0] for r in brands.select("feature").distinct().collect())
    return annotate.cluster_cells(brands, features, k=4, components=5)
