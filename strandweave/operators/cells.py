"""Cell calling: quality figures, ranks, expected-cell thresholds, ambient profiles and tests against them.

A matrix is (cell_id, feature, value) without zeros.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


#: Distinct totals that reach the driver at most.
MOST_TOTALS = 2_000_000


def qc_metrics(matrix: DataFrame) -> DataFrame:
    """cell_id, total, n_features."""
    return matrix.groupBy("cell_id").agg(F.sum("value").alias("total"), F.count(F.when(F.col("value") > 0, 1)).alias("n_features"))


def filter_matrix(matrix: DataFrame, min_counts: float = 0, min_features: int = 0, min_cells: int = 0) -> DataFrame:
    """Cells with enough counts and features, then features in enough cells."""
    cells = qc_metrics(matrix).where((F.col("total") >= min_counts) & (F.col("n_features") >= min_features)).select("cell_id")
    kept = matrix.join(cells, "cell_id", "left_semi")
    features = kept.where("value > 0").groupBy("feature").agg(F.count("*").alias("n")).where(F.col("n") >= min_cells).select("feature")
    return kept.join(features, "feature", "left_semi")


def normalize_log1p(matrix: DataFrame) -> DataFrame:
    """Values scaled so that each cell's total is the median total, then log(1 + x)."""
    totals = matrix.groupBy("cell_id").agg(F.sum("value").alias("total"))
    median = totals.agg(F.percentile("total", F.lit(0.5)).alias("median"))
    scaled = matrix.join(totals, "cell_id").join(F.broadcast(median), F.lit(True))  # one row
    return scaled.select("cell_id", "feature", F.log1p(F.col("value") * F.col("median") / F.col("total")).alias("value"))


def histogram_of_totals(qc: DataFrame) -> pd.DataFrame:
    """total, n in descending order of total: what ranks and thresholds need, far less than a row a cell. Totals of counts
    are whole and few; more than MOST_TOTALS distinct ones are an error, and should be rounded first."""
    sizes = qc.groupBy("total").agg(F.count("*").alias("n"))
    if sizes.limit(MOST_TOTALS + 1).count() > MOST_TOTALS:
        raise ValueError("there are too many distinct totals to rank; round them")
    return sizes.orderBy(F.desc("total")).toPandas()


def barcode_rank(qc: DataFrame) -> DataFrame:
    """``qc`` with rank, from the largest total on, ties by cell_id.

    Ranks come from how many cells have a larger total, which is a sum over ranges of totals and over those in one range,
    and among equal ones from how many are in ranges of smaller ids and a row number; so no task sorts all cells, nor all
    of the same total.
    """
    coarse = F.floor(F.log1p(F.greatest(F.col("total").cast("double"), F.lit(0.0))) * 256)  # a few thousand ranges
    cut = qc.withColumns({"_block": F.shiftright(F.col("cell_id").cast("long"), 12), "_coarse": coarse})
    blocks = cut.groupBy("_coarse", "total", "_block").agg(F.count("*").alias("n"))
    totals = blocks.groupBy("_coarse", "total").agg(F.sum("n").alias("n"))
    ranges = totals.groupBy("_coarse").agg(F.sum("n").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = ranges.select("_coarse", before(Window.orderBy(F.desc("_coarse"))).alias("a"))
    at = totals.join(at, "_coarse").select("_coarse", "total", (F.col("a") + before(Window.partitionBy("_coarse").orderBy(F.desc("total")))).alias("a"))
    at = blocks.join(at, ["_coarse", "total"]).select("total", "_block", (F.col("a") + before(Window.partitionBy("total").orderBy("_block"))).alias("a"))
    within = F.row_number().over(Window.partitionBy("total", "_block").orderBy("cell_id"))
    return cut.withColumn("_own", within).join(at, ["total", "_block"]).select(*qc.columns, (F.col("a") + F.col("_own")).cast("long").alias("rank"))


def _top_percentile(totals: np.ndarray, ends: np.ndarray, n: int) -> float:
    """The interpolated 99th percentile of the n largest, of distinct totals in descending order."""
    place = 0.99 * (n - 1)
    value = lambda i: float(totals[np.searchsorted(ends, n - 1 - i, side="right")])  # noqa: E731  i counts from the least of the n
    low, high = math.floor(place), math.ceil(place)
    return value(low) + (value(high) - value(low)) * (place - low)


def ordmag_expected(hist: pd.DataFrame, most: int = 45_000, candidates: int = 100) -> tuple[int, float]:
    """The expected number of cells and the threshold on totals.

    Of candidates spaced evenly on a logarithmic scale, the one is taken whose number of cells above a tenth of the 99th
    percentile of its top cells fits it best; then the best whole number between its half and its double, on a finer scale.
    """
    totals, ends = hist["total"].to_numpy(float), np.cumsum(hist["n"].to_numpy())
    n = int(ends[-1]) if len(ends) else 0
    if n < 4:
        return n, 0.0

    def loss(x: int) -> float:
        above = int(np.searchsorted(-totals, -_top_percentile(totals, ends, x) / 10, side="left"))
        observed = int(ends[above - 1]) if above else 0
        return (observed - x) ** 2 / x

    grid = lambda a, b: sorted({min(max(int(x), 2), n - 1) for x in np.geomspace(a, b, candidates)})
    best = min(grid(2, max(min(n / 2, most), 2)), key=loss)
    best = min([best, *grid(max(best / 2, 2), min(2 * best, n - 1))], key=loss)
    return best, _top_percentile(totals, ends, best) / 10


def call_cells(qc: DataFrame) -> DataFrame:
    """``qc`` of the cells above the threshold."""
    return qc.where(F.col("total") > ordmag_expected(histogram_of_totals(qc))[1])


def ambient_profile(matrix: DataFrame, qc: DataFrame, low: float, high: float, called: DataFrame | None = None) -> DataFrame:
    """feature, value: summed over cells with a total between the bounds that aren't called; 0 for features not met."""
    ambient = qc.where(F.col("total").between(low, high)).select("cell_id")
    ambient = ambient.join(called.select("cell_id"), "cell_id", "left_anti") if called is not None else ambient
    sums = matrix.join(ambient, "cell_id", "left_semi").groupBy("feature").agg(F.sum("value").alias("value"))
    return matrix.select("feature").distinct().join(sums, "feature", "left").select("feature", F.coalesce("value", F.lit(0)).alias("value"))


def good_turing(profile: DataFrame) -> DataFrame:
    """feature, p: Simple Good-Turing probabilities of a profile, which sum to 1.

    Seen features share by (c + 1) n(c + 1) / (n(c) N), where n(c + 1) is observed or from the log-log line; unseen ones
    share n(1) / N, or 0.1 without singletons. With fewer than two distinct counts: (c + 1) / (N + features).
    """
    seen = profile.where("value > 0")
    counts = seen.groupBy(F.col("value").cast("double").alias("r")).agg(F.count("*").cast("double").alias("n"))
    line = counts.agg(F.regr_slope(F.log("n"), F.log("r")).alias("b"), F.regr_intercept(F.log("n"), F.log("r")).alias("a"), F.sum(F.col("r") * F.col("n")).alias("total"), F.count("*").alias("kinds"))
    unseen = profile.agg(F.count(F.when(F.col("value") <= 0, 1)).alias("n0"), F.count("*").alias("features"), F.count(F.when(F.col("value") == 1, 1)).cast("double").alias("n1"))
    one = line.join(unseen, F.lit(True))  # one row each
    following = counts.select((F.col("r") - 1).alias("r"), F.col("n").alias("n_next"))
    table = counts.join(following, "r", "left")
    joined = profile.join(table, profile["value"].cast("double") == table["r"], "left").join(F.broadcast(one), F.lit(True))
    c = F.col("value").cast("double")
    expected = F.coalesce("n_next", F.exp(F.col("a") + F.col("b") * F.log(c + 1)))
    smooth = F.when(c > 0, (c + 1) * expected / (F.col("n") * F.col("total"))).otherwise(F.when(F.col("n1") > 0, F.col("n1") / F.col("total")).otherwise(0.1) / F.col("n0"))
    raw = F.when(F.col("kinds") < 2, (c + 1) / (F.coalesce("total", F.lit(0.0)) + F.col("features"))).otherwise(smooth)
    shares = joined.select("feature", raw.alias("raw"))
    return shares.join(F.broadcast(shares.agg(F.sum("raw").alias("whole"))), F.lit(True)).select("feature", (F.col("raw") / F.col("whole")).alias("p"))


def ambient_statistic(matrix: DataFrame, profile: DataFrame, candidates: DataFrame) -> DataFrame:
    """cell_id, statistic, df: likelihood ratio of each candidate's counts against the profile (feature, p)."""
    own = matrix.join(candidates.select("cell_id"), "cell_id", "left_semi").where("value > 0")
    totals = own.groupBy("cell_id").agg(F.sum("value").alias("total"))
    o, e = F.col("value").cast("double"), F.greatest(F.col("p") * F.col("total"), F.lit(1e-10))
    joined = own.join(totals, "cell_id").join(profile, "feature")
    return joined.groupBy("cell_id").agg((2 * F.sum(o * F.log(o / e))).alias("statistic"), (F.count("*") - 1).alias("df"))


def _upper_gamma(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function, by series or continued fraction."""
    if x <= 0 or a <= 0:
        return 1.0
    lead = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for k in range(1, 10_000):
            term *= x / (a + k)
            total += term
            if term < total * 1e-16:
                break
        return max(0.0, 1 - lead * total)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for k in range(1, 10_000):
        an = -k * (k - a)
        b += 2
        d = 1 / (d_new if abs(d_new := an * d + b) > tiny else tiny)
        c = c_new if abs(c_new := b + an / c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return lead * h


@pandas_udf(DoubleType())
def chi2_tail(statistic: pd.Series, df: pd.Series) -> pd.Series:
    """1 - the chi-squared distribution function; 1 without degrees of freedom."""
    return pd.Series([1.0 if d <= 0 else _upper_gamma(d / 2, max(s, 0.0) / 2) for s, d in zip(statistic, df, strict=True)], dtype="float64")


#: Parts of the distinct p-values that are ranked each by one task.
PARTS = 256


def benjamini_hochberg(tests: DataFrame, alpha: float = 0.01, p: str | Column = "p_value") -> DataFrame:
    """``tests`` with significant: whether the p-value is at most the largest that lies under the line j * alpha / m.

    Equal p-values are counted first, then cut into parts of about equal numbers of them; ranks within a part are added
    to the sizes of the parts before. So no task sorts all tests, wherever they crowd.
    """
    value = F.col(p) if isinstance(p, str) else p
    ranged = tests.withColumn("_p", value)
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    cuts = sizes.agg(F.percentile_approx("_p", [i / PARTS for i in range(1, PARTS)], 10_000).alias("_cuts"))  # one row
    parted = sizes.join(F.broadcast(cuts), F.lit(True)).select("_p", "_n", F.size(F.filter("_cuts", lambda c: c < F.col("_p"))).alias("_part"))
    before = parted.groupBy("_part").agg(F.sum("_n").alias("_n"))  # PARTS rows at most
    before = before.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_above"))
    rank = F.sum("_n").over(Window.partitionBy("_part").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0))
    ranked = parted.withColumn("_own", rank).join(F.broadcast(before), "_part").withColumn("_rank", F.col("_above") + F.col("_own"))
    m = tests.agg(F.count("*").alias("_m"))
    cut = ranked.join(F.broadcast(m), F.lit(True)).where(F.col("_p") <= F.col("_rank") * alpha / F.col("_m")).agg(F.max("_p").alias("_cut"))
    return ranged.join(F.broadcast(cut), F.lit(True)).select(*tests.columns, F.coalesce(F.col("_p") <= F.col("_cut"), F.lit(False)).alias("significant"))


def empty_drops(matrix: DataFrame, threshold: float, ambient_min: float = 1, ambient_max: float = 100, min_total: float = 500, alpha: float = 0.01) -> DataFrame:
    """cell_id, method: cells called by their total (OrdMag) or by their difference from the ambient profile (EmptyDrops).

    If fewer than 10 cells are ambient, ambient_max becomes the 10th percentile of the totals.
    """
    qc = qc_metrics(matrix)
    called = qc.where(F.col("total") > threshold).select("cell_id")
    if qc.where(F.col("total").between(ambient_min, ambient_max)).count() < 10:
        ambient_max = qc.agg(F.percentile("total", F.lit(0.1))).first()[0] or ambient_max
    profile = good_turing(ambient_profile(matrix, qc, ambient_min, ambient_max, called))
    candidates = qc.where((F.col("total") > ambient_max) & (F.col("total") >= min_total) & (F.col("total") <= threshold))
    tests = ambient_statistic(matrix, profile, candidates).withColumn("p_value", chi2_tail("statistic", "df"))
    found = benjamini_hochberg(tests, alpha).where("significant").select("cell_id", F.lit("EmptyDrops").alias("method"))
    return called.withColumn("method", F.lit("OrdMag")).unionByName(found)
