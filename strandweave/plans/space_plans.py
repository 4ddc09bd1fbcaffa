"""Coordinates, rasters, intervals and rolling means."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import spatial, windows
from .catalog import POINTS, points_of, query

#: The extent that plans with fixed bins use; coordinates of these tables lie well inside.
EXTENT = (-0.5, 0.5, -0.5, 0.5)


@query("coord_limits", f"WITH {POINTS} SELECT min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax FROM points")
def _(t):
    return spatial.limits(points_of(t))


@query(
    "histogram2d",
    f"WITH {POINTS} SELECT CAST(least(floor((x + 0.5) * 32 / 1.0), 31) AS INTEGER) AS px, CAST(least(floor((y + 0.5) * 32 / 1.0), 31) AS INTEGER) AS py, round(sum(value), 6) AS value FROM points WHERE x BETWEEN -0.5 AND 0.5 AND y BETWEEN -0.5 AND 0.5 GROUP BY ALL",
)
def _(t):
    return spatial.histogram2d(points_of(t), 32, 32, EXTENT).withColumn("value", F.round("value", 6))


_NX, _NY = 20, int(20 / math.sqrt(3))
_PAD = 1e-9 * 1.0
_X0, _SX, _SY = -0.5 - _PAD, (0.5 + _PAD - (-0.5 - _PAD)) / _NX, 1.0 / _NY
_HEX = f"""{POINTS}, uv AS (SELECT *, (x - {_X0!r}::DOUBLE) / {_SX!r}::DOUBLE AS u, (y - (-0.5::DOUBLE)) / {_SY!r}::DOUBLE AS v FROM points),
near AS (SELECT *, round_even(u, 0) AS ua, round_even(v, 0) AS va, floor(u) AS ub, floor(v) AS vb FROM uv),
hex AS (SELECT cell_id, value, CASE WHEN (u - ua) * (u - ua) + 3.0 * (v - va) * (v - va) < (u - ub - 0.5) * (u - ub - 0.5) + 3.0 * (v - vb - 0.5) * (v - vb - 0.5)
  THEN CASE WHEN ua >= 0 AND ua < {_NX + 1} AND va >= 0 AND va < {_NY} THEN CAST(ua * {_NY} + va AS BIGINT) END
  ELSE CASE WHEN ub >= 0 AND ub < {_NX} AND vb >= 0 AND vb < {_NY} THEN CAST({(_NX + 1) * _NY} + ub * {_NY} + vb AS BIGINT) END END AS bin FROM near)"""


@query("hexbin", f"WITH {_HEX} SELECT cell_id, bin FROM hex")
def _(t):
    return spatial.hexbin(points_of(t), _NX, extent=EXTENT).select("cell_id", "bin")


@query("hexbin_aggregate", f"WITH {_HEX} SELECT bin, count(*) AS n_joined, list_sort(list(cell_id)) AS cells, round(sum(value), 6) AS value FROM hex WHERE bin IS NOT NULL GROUP BY bin")
def _(t):
    points = points_of(t)
    bins, matrix = spatial.aggregate_bins(spatial.hexbin(points, _NX, extent=EXTENT), points.select("cell_id", F.lit(1).alias("feature"), "value"))
    return bins.join(matrix.select("bin", F.round("value", 6).alias("value")), "bin")


@query("radius_search", f"WITH {POINTS} SELECT cell_id, round(sqrt((x - 0.1) * (x - 0.1) + (y + 0.2) * (y + 0.2)), 6) AS distance FROM points WHERE sqrt((x - 0.1) * (x - 0.1) + (y + 0.2) * (y + 0.2)) <= 0.2")
def _(t):
    return spatial.radius_search(points_of(t), 0.1, -0.2, 0.2).select("cell_id", F.round("distance", 6).alias("distance"))


_DY = math.sqrt(3) * 0.025
_NODES = f"""{POINTS}, uv AS (SELECT *, x / 0.025 AS u, y / {_DY!r}::DOUBLE AS v FROM points),
nodes AS (SELECT *, round_even(u, 0) * 0.025 AS ax, round_even(v, 0) * {_DY!r}::DOUBLE AS ay, (floor(u) + 0.5) * 0.025 AS bx, (floor(v) + 0.5) * {_DY!r}::DOUBLE AS b_y FROM uv),
far AS (SELECT *, sqrt((x - ax) * (x - ax) + (y - ay) * (y - ay)) AS da, sqrt((x - bx) * (x - bx) + (y - b_y) * (y - b_y)) AS db FROM nodes)"""


@query("circle_bins", f"WITH {_NODES} SELECT cell_id, round(least(da, db), 6) AS node_distance FROM far WHERE least(da, db) < (0.02 - 0.002) / 2")
def _(t):
    return spatial.circle_bins(points_of(t), 0.02, 0.025, 0.002).select("cell_id", F.round("node_distance", 6).alias("node_distance"))


@query(
    "meshed_matrix",
    f"WITH {_NODES}, put AS (SELECT *, CASE WHEN da <= db THEN ax ELSE bx END AS nx, CASE WHEN da <= db THEN ay ELSE b_y END AS ny FROM far WHERE least(da, db) < 0.01) SELECT round(nx, 6) + 0.0 AS x, round(ny, 6) + 0.0 AS y, round(sum(value), 6) AS value FROM put GROUP BY ALL",
)
def _(t):
    points = points_of(t)
    _, matrix = spatial.meshed_matrix(points, points.select("cell_id", F.lit(1).alias("feature"), "value"), "circle", 0.02, 0.025)
    return matrix.select((F.col("bin.x") + 0.0).alias("x"), (F.col("bin.y") + 0.0).alias("y"), F.round("value", 6).alias("value"))


_GRID = f"""{POINTS}, r AS (SELECT (floor(max(x) / 0.025) + 1)::BIGINT AS nx, (floor(max(y) / {_DY!r}::DOUBLE) + 1)::BIGINT AS ny FROM points)
SELECT round(i * 0.025::DOUBLE + h * 0.0125::DOUBLE, 6) AS node_x, round(j * {_DY!r}::DOUBLE + h * {_DY / 2!r}::DOUBLE, 6) AS node_y FROM r, LATERAL (SELECT unnest(range(nx)) AS i) a, LATERAL (SELECT unnest(range(ny)) AS j) b, (SELECT unnest(range(2)) AS h) c"""


@query("mesh_lattice", f"WITH {_GRID}")
def _(t):
    xmax, ymax = spatial.limits(points_of(t)).select("xmax", "ymax").first()
    return spatial.mesh(t.spark, (0.0, xmax, 0.0, ymax), 0.025).select(F.round("node_x", 6).alias("node_x"), F.round("node_y", 6).alias("node_y"))


@query(
    "tile_raster",
    f"WITH {POINTS}, b AS (SELECT min(x) AS x0, min(y) AS y0, greatest(max(x) - min(x), max(y) - min(y)) / 2 AS s FROM points)"
    " SELECT CAST(least(floor((x - (x0 + 0 * s)) * 64 / ((x0 + 1 * s) - (x0 + 0 * s))), 63) AS INTEGER) AS px, CAST(least(floor((y - (y0 + 0 * s)) * 64 / ((y0 + 1 * s) - (y0 + 0 * s))), 63) AS INTEGER) AS py, round(avg(value), 6) AS value"
    " FROM points, b WHERE x >= x0 AND x < x0 + s AND y >= y0 AND y < y0 + s GROUP BY ALL",
)
def _(t):
    points = points_of(t)
    extent = tuple(spatial.limits(points).first())
    return spatial.tile_raster(points, extent, 1, 0, 0, 64).withColumn("value", F.round("value", 6))


@query("scaled_intensity", f"WITH {POINTS}, p AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM points) SELECT cell_id, round((greatest(least(value, hi), lo) - lo) * 255.0 / (hi - lo), 6) AS value FROM points, p")
def _(t):
    return spatial.scale_intensity(points_of(t)).select("cell_id", F.round("value", 6).alias("value"))


def _smoothed(n: int) -> str:
    """SQL of both passes of the filter, mirrored at the edges, and of the scaling."""
    kernel = spatial.kernel_of(1.5)
    reach = len(kernel) // 2
    shares = ", ".join(f"({d - reach}, {w!r}::DOUBLE)" for d, w in enumerate(kernel))
    # the pixel that a place beyond the edge mirrors
    inner = f"CASE WHEN {{0}} < 0 THEN -1 - ({{0}}) WHEN {{0}} >= {n} THEN {2 * n - 1} - ({{0}}) ELSE {{0}} END"
    places = f"(SELECT unnest(range({n})) AS o) o, k"
    return f"""k(d, w) AS (VALUES {shares}),
mx AS (SELECT o, {inner.format("o + d")} AS px, w FROM {places}), sx AS (SELECT mx.o AS px, py, sum(value * w) AS value FROM img JOIN mx ON mx.px = img.px GROUP BY ALL),
sy AS (SELECT sx.px, mx.o AS py, sum(value * w) AS value FROM sx JOIN mx ON mx.px = sx.py GROUP BY ALL)"""


@query(
    "smoothed_raster",
    f"WITH {POINTS}, img AS (SELECT CAST(least(floor((x + 0.5) * 64 / 1.0), 63) AS INTEGER) AS px, CAST(least(floor((y + 0.5) * 64 / 1.0), 63) AS INTEGER) AS py, sum(value) AS value FROM points WHERE x BETWEEN -0.5 AND 0.5 AND y BETWEEN -0.5 AND 0.5 GROUP BY ALL),"
    f" {_smoothed(64)} SELECT 0 AS layer, CAST(px AS INTEGER) AS px, CAST(py AS INTEGER) AS py, round(value * 255 / (SELECT max(value) FROM sy), 5) AS value FROM sy WHERE value > 0",
)
def _(t):
    return spatial.smooth(spatial.histogram2d(points_of(t), 64, 64, EXTENT), 64, 64, normalise=True).withColumn("value", F.round("value", 5))


@query(
    "hexagon_matrix",
    f"WITH {_NODES.replace('0.025', repr(math.sqrt(3) * 0.03) + '::DOUBLE').replace(repr(_DY), repr(3 * 0.03))}, put AS (SELECT value, CASE WHEN da <= db THEN ax ELSE bx END AS nx, CASE WHEN da <= db THEN ay ELSE b_y END AS ny FROM far) SELECT round(nx, 6) + 0.0 AS x, round(ny, 6) + 0.0 AS y, round(sum(value), 6) AS value FROM put GROUP BY ALL",
)
def _(t):
    points = points_of(t)
    _, matrix = spatial.meshed_matrix(points, points.select("cell_id", F.lit(1).alias("feature"), "value"), "hexagon", 0.03)
    return matrix.select((F.col("bin.x") + 0.0).alias("x"), (F.col("bin.y") + 0.0).alias("y"), F.round("value", 6).alias("value"))


_RANGES = "(SELECT CASE WHEN vec_id % 50 = 0 THEN -vec_id - 1 ELSE label END AS grp, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings UNION ALL SELECT -1000000, 0.0::DOUBLE)"


@query(
    "nonsingular_ranges",
    f"SELECT grp, CASE WHEN hi - lo > greatest(abs(lo), abs(hi)) * 1e-15 THEN lo WHEN lo = 0 THEN -0.001 ELSE lo - 0.001 * abs(lo) END AS low, CASE WHEN hi - lo > greatest(abs(lo), abs(hi)) * 1e-15 THEN hi WHEN lo = 0 THEN 0.001 ELSE hi + 0.001 * abs(hi) END AS high FROM (SELECT grp, min(x) AS lo, max(x) AS hi FROM {_RANGES} GROUP BY grp)",
)
def _(t):
    at = t("embeddings").select(F.when(F.col("vec_id") % 50 == 0, -F.col("vec_id") - 1).otherwise(F.col("label")).alias("grp"), F.col("embedding")[0].cast("double").alias("x"))
    at = at.union(t.spark.sql("SELECT -1000000L, 0.0D"))
    ends = at.groupBy("grp").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))  # a row a group
    rows = [(g, *spatial.nonsingular(lo, hi)) for g, lo, hi in ends.collect()]
    return t.spark.createDataFrame(rows, "grp long, low double, high double")


_EVENTS = "e AS (SELECT DISTINCT user_id AS key, CAST(floor(epoch(ts) / 60) AS BIGINT) AS pos FROM events)"


@query(
    "group_intervals",
    f"WITH {_EVENTS}, n AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY key ORDER BY pos) <= 600 THEN 0 ELSE 1 END AS fresh FROM e), r AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY pos) AS run FROM n) SELECT key, min(pos) AS start, max(pos) AS \"end\" FROM r GROUP BY key, run",
)
def _(t):
    positions = t("events").select(F.col("user_id").alias("key"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60).alias("pos")).distinct()
    return windows.group_intervals(positions, 600)


@query(
    "rolling_scores",
    "WITH m AS (SELECT event_type AS key, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS pos, avg(value) AS v FROM events GROUP BY ALL),"
    " r AS (SELECT key, pos, CASE WHEN row_number() OVER o >= 24 THEN avg(v) OVER (PARTITION BY key ORDER BY pos ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) ELSE 0 END AS r FROM m WINDOW o AS (PARTITION BY key ORDER BY pos)),"
    " b AS (SELECT *, min(r) OVER (PARTITION BY key) AS lo, max(r) OVER (PARTITION BY key) AS hi FROM r) SELECT key, pos, round(CASE WHEN hi > lo THEN (r - lo) / (hi - lo) ELSE r END, 6) AS score FROM b",
)
def _(t):
    rows = t("events").select(F.col("event_type").alias("key"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).alias("pos"), "value")
    return windows.rolling_scores(rows).withColumn("score", F.round("score", 6))
