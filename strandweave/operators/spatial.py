"""Coordinates: bounds, histograms, hexagonal bins, meshes, tiles, radius search, smoothing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Extent = tuple[float, float, float, float]  # xmin, xmax, ymin, ymax


def limits(cells: DataFrame) -> DataFrame:
    """xmin, xmax, ymin, ymax: one row."""
    return cells.agg(F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"))


def nonsingular(low: float, high: float, expander: float = 0.001, tiny: float = 1e-15) -> tuple[float, float]:
    """An increasing range; one that is too narrow, or not finite, is widened."""
    if not (math.isfinite(low) and math.isfinite(high)):
        return -expander, expander
    low, high = min(low, high), max(low, high)
    if high - low <= max(abs(low), abs(high)) * tiny:
        return (-expander, expander) if low == high == 0 else (low - expander * abs(low), high + expander * abs(high))
    return low, high


def extent_of(cells: DataFrame, expander: float = 0.1) -> Extent:
    xmin, xmax, ymin, ymax = limits(cells).first()
    return *nonsingular(xmin, xmax, expander), *nonsingular(ymin, ymax, expander)


def histogram2d(points: DataFrame, nx: int, ny: int, extent: Extent | None = None, weight: str = "value") -> DataFrame:
    """px, py, value: summed weights; the last bin of each axis holds its upper edge, and points outside are left out."""
    xmin, xmax, ymin, ymax = extent or extent_of(points)
    place = lambda c, lo, hi, n: F.least(F.floor((F.col(c) - lo) * n / (hi - lo)).cast("int"), F.lit(n - 1))
    inside = points.where(F.col("x").between(xmin, xmax) & F.col("y").between(ymin, ymax))
    return inside.groupBy(place("x", xmin, xmax, nx).alias("px"), place("y", ymin, ymax, ny).alias("py")).agg(F.sum(weight).alias("value"))


def raster(points: DataFrame, scale: float = 1.0) -> tuple[DataFrame, int, int]:
    """px, py, value and the size of an image whose axes run from the least coordinate to the largest plus one."""
    xmin, xmax, ymin, ymax = limits(points).first()
    nx, ny = int((xmax + 1 - xmin) * scale), int((ymax + 1 - ymin) * scale)
    return histogram2d(points, nx, ny, (xmin, xmax + 1, ymin, ymax + 1)), nx, ny


def hexbin(cells: DataFrame, nx: int, ny: int | None = None, extent: Extent | None = None, last_row: bool = False) -> DataFrame:
    """``cells`` with bin, bin_x, bin_y: the nearest node of two offset lattices; null where that is off the lattice.

    The range of x is padded by 1e-9 of itself on each side, that of y isn't.
    """
    ny = ny or int(nx / math.sqrt(3))
    xmin, xmax, ymin, ymax = extent or extent_of(cells)
    pad = 1e-9 * (xmax - xmin)
    xmin, xmax = xmin - pad, xmax + pad
    sx, sy = (xmax - xmin) / nx, (ymax - ymin) / ny
    ny1 = ny + 1 if last_row else ny
    u, v = (F.col("x") - xmin) / sx, (F.col("y") - ymin) / sy
    placed = cells.withColumns({"_u": u, "_v": v}).withColumns({"_ua": F.rint("_u"), "_va": F.rint("_v"), "_ub": F.floor("_u").cast("double"), "_vb": F.floor("_v").cast("double")})
    near = lambda a, b, half: (F.col("_u") - F.col(a) - half) * (F.col("_u") - F.col(a) - half) + 3.0 * (F.col("_v") - F.col(b) - half) * (F.col("_v") - F.col(b) - half)
    first = near("_ua", "_va", 0.0) < near("_ub", "_vb", 0.5)
    on = lambda c, n: (F.col(c) >= 0) & (F.col(c) < n)
    number = F.when(first & on("_ua", nx + 1) & on("_va", ny1), F.col("_ua") * ny1 + F.col("_va"))
    number = number.when(~first & on("_ub", nx) & on("_vb", ny), F.lit(float((nx + 1) * ny1)) + F.col("_ub") * ny + F.col("_vb"))
    centre = lambda a, b, lo, step: F.when(first, F.col(a) * step + lo).otherwise((F.col(b) + 0.5) * step + lo)
    return placed.select(*cells.columns, number.cast("long").alias("bin"), centre("_ua", "_ub", xmin, sx).alias("bin_x"), centre("_va", "_vb", ymin, sy).alias("bin_y"))


def aggregate_bins(binned: DataFrame, matrix: DataFrame) -> tuple[DataFrame, DataFrame]:
    """bins (bin, n_joined, cells) and the summed matrix (bin, feature, value)."""
    known = binned.where("bin is not null").select("cell_id", "bin")
    bins = known.groupBy("bin").agg(F.count("*").alias("n_joined"), F.sort_array(F.collect_list("cell_id")).alias("cells"))
    return bins, matrix.join(known, "cell_id").groupBy("bin", "feature").agg(F.sum("value").alias("value"))


def mesh(spark, extent: Extent, distance: float, start_at_minimum: bool = False) -> DataFrame:
    """node, node_x, node_y: two rectangular grids of distance by sqrt(3) times it, the second moved by half of each."""
    xmin, xmax, ymin, ymax = extent
    x0, y0 = (xmin, ymin) if start_at_minimum else (0.0, 0.0)
    dy = math.sqrt(3) * distance
    columns, rows = int((xmax - x0) // distance) + 1, int((ymax - y0) // dy) + 1
    grid = spark.range(2 * columns * rows).select("id", (F.col("id") % 2).alias("h"), F.floor(F.col("id") / 2).alias("i"))
    col, row = F.col("i") % columns, F.floor(F.col("i") / columns)
    return grid.select(F.col("id").alias("node"), (col * distance + F.col("h") * (distance / 2) + x0).alias("node_x"), (row * dy + F.col("h") * (dy / 2) + y0).alias("node_y"))


def nearest_node(cells: DataFrame, distance: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """``cells`` with node_x, node_y, node_distance of the nearest mesh node, in closed form: no pairs are made."""
    dy = math.sqrt(3) * distance
    u, v = (F.col("x") - x0) / distance, (F.col("y") - y0) / dy
    ax, ay = F.rint(u) * distance + x0, F.rint(v) * dy + y0
    bx, by = (F.floor(u) + 0.5) * distance + x0, (F.floor(v) + 0.5) * dy + y0
    away = lambda nx, ny: (F.col("x") - nx) * (F.col("x") - nx) + (F.col("y") - ny) * (F.col("y") - ny)
    a = away(ax, ay) <= away(bx, by)
    pick = lambda p, q: F.when(a, p).otherwise(q)
    return cells.withColumns({"node_x": pick(ax, bx), "node_y": pick(ay, by), "node_distance": F.sqrt(pick(away(ax, ay), away(bx, by)))})


def circle_bins(cells: DataFrame, spot: float, distance: float, bead: float = 0.0, **origin) -> DataFrame:
    """Cells nearer to a mesh node than half of what the spot's diameter exceeds the bead's, with the node."""
    return nearest_node(cells, distance, **origin).where(F.col("node_distance") < (spot - bead) / 2)


def meshed_matrix(cells: DataFrame, matrix: DataFrame, shape: str, diameter: float, distance: float | None = None, bead: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """bins and summed matrix on circles, or on hexagons that leave no gaps."""
    if shape == "hexagon":
        placed = nearest_node(cells, math.sqrt(3) * diameter)
    elif shape == "circle":
        placed = circle_bins(cells, diameter, distance or diameter, bead)
    else:
        raise ValueError("shape must be circle or hexagon")
    key = F.struct(F.round("node_x", 6).alias("x"), F.round("node_y", 6).alias("y"))
    return aggregate_bins(placed.withColumn("bin", key), matrix)


def tile_bounds(extent: Extent, zoom: int, tx: int, ty: int) -> Extent:
    """A square tile; the larger extent is cut into 2 ** zoom."""
    xmin, xmax, ymin, ymax = extent
    size = max(xmax - xmin, ymax - ymin) / 2**zoom
    return xmin + tx * size, xmin + (tx + 1) * size, ymin + ty * size, ymin + (ty + 1) * size


def tile_raster(points: DataFrame, extent: Extent, zoom: int, tx: int, ty: int, pixels: int = 256) -> DataFrame:
    """px, py, value: the mean of each pixel of a tile, at most pixels * pixels rows."""
    x0, x1, y0, y1 = tile_bounds(extent, zoom, tx, ty)
    inside = points.where((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))
    place = lambda c, lo, hi: F.least(F.floor((F.col(c) - lo) * pixels / (hi - lo)).cast("int"), F.lit(pixels - 1))
    return inside.groupBy(place("x", x0, x1).alias("px"), place("y", y0, y1).alias("py")).agg(F.avg("value").alias("value"))


def scale_intensity(points: DataFrame) -> DataFrame:
    """``points`` with value clipped to its 1st and 99th percentile and scaled to 0 to 255."""
    ends = points.agg(F.percentile("value", F.array(F.lit(0.01), F.lit(0.99))).alias("_p"))
    low, high = F.get("_p", F.lit(0)), F.get("_p", F.lit(1))
    scaled = F.when(high > low, (F.greatest(F.least(F.col("value"), high), low) - low) * 255.0 / (high - low)).otherwise(0.0)
    return points.join(F.broadcast(ends), F.lit(True)).withColumn("value", scaled).drop("_p")  # one row


def radius_search(cells: DataFrame, x: float, y: float, radius: float) -> DataFrame:
    """Cells within a radius of a point; the box around it reaches the scan."""
    box = F.col("x").between(x - radius, x + radius) & F.col("y").between(y - radius, y + radius)
    away = F.sqrt((F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y))
    return cells.where(box).withColumn("distance", away).where(F.col("distance") <= radius)


def kernel_of(sigma: float) -> list[float]:
    """Weights of a Gaussian at the offsets -reach to reach, where reach is 4 sigma."""
    reach = int(4 * sigma + 0.5)
    weights = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    return [w / sum(weights) for w in weights]


def smooth(pixels: DataFrame, nx: int, ny: int, sigma: float = 1.5, normalise: bool = False) -> DataFrame:
    """layer, px, py, value of images after a Gaussian filter, mirrored at their edges; pixels of 0 are left out. Layers go
    by a column layer, if there is one.

    The filter goes along each axis in turn: every pixel gives its share to those within reach, also as the mirror images
    of it that lie beyond the edges, and the shares are added up. Pixels are spread over all tasks, whatever an image's
    size. ``normalise`` scales each layer's largest value to 255; one that is 0 stays."""
    kernel = kernel_of(sigma)
    reach = len(kernel) // 2
    layered = pixels if "layer" in pixels.columns else pixels.withColumn("layer", F.lit(0))
    out = layered.select(F.col("layer").cast("int").alias("layer"), F.col("px").cast("int").alias("px"), F.col("py").cast("int").alias("py"), F.col("value").cast("double").alias("value"))
    for axis, n in (("px", nx), ("py", ny)):
        turns = range(-(reach // (2 * n)) - 1, reach // (2 * n) + 2)
        images = F.array(*[c + 2 * n * j for j in turns for c in (F.col(axis), -F.col(axis) - 1)])
        shares = F.array(*[F.struct(F.lit(d - reach).alias("d"), F.lit(w).alias("w")) for d, w in enumerate(kernel)])
        spread = out.withColumn("_e", F.explode(images)).where(F.col("_e").between(-reach, n - 1 + reach)).withColumn("_s", F.explode(shares))
        moved = spread.withColumn(axis, F.col("_e") + F.col("_s.d")).where(F.col(axis).between(0, n - 1))
        out = moved.groupBy("layer", "px", "py").agg(F.sum(F.col("value") * F.col("_s.w")).alias("value"))
    out = out.where("value > 0")
    if normalise:
        most = out.groupBy("layer").agg(F.max("value").alias("most"))  # a row an image
        out = out.join(most, "layer").select("layer", "px", "py", (F.col("value") * 255 / F.col("most")).alias("value"))
    return out.select("layer", "px", "py", "value")
