"""Ordered operators: intervals of near positions, rolling means."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def group_intervals(positions: DataFrame, gap: int, key: str = "key", position: str = "pos") -> DataFrame:
    """key, start, end: runs of a key's positions in which none is farther than ``gap`` from the one before."""
    order = Window.partitionBy(key).orderBy(position)
    new = F.when(F.col(position) - F.lag(position).over(order) <= gap, 0).otherwise(1)
    runs = positions.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order))
    return runs.groupBy(key, "_run").agg(F.min(position).alias("start"), F.max(position).alias("end")).drop("_run")


def rolling_scores(scores: DataFrame, frame: int = 24, key: str = "key", position: str = "pos", value: str = "value") -> DataFrame:
    """key, pos, score: per position the mean, over a full frame of positions the mean of those (0 before it is full),
    scaled to 0 to 1 within the key."""
    means = scores.groupBy(key, position).agg(F.avg(value).alias("_v"))
    order = Window.partitionBy(key).orderBy(position)
    full = order.rowsBetween(1 - frame, 0)
    rolled = means.withColumn("_r", F.when(F.row_number().over(order) >= frame, F.avg("_v").over(full)).otherwise(0.0))
    own = Window.partitionBy(key)
    low, high = F.min("_r").over(own), F.max("_r").over(own)
    return rolled.withColumns({"_lo": low, "_hi": high}).select(key, position, F.when(F.col("_hi") > F.col("_lo"), (F.col("_r") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.col("_r")).alias("score"))


def is_constant(df: DataFrame, column: str) -> bool:
    """Whether a column has one distinct value; its least and largest are compared, so nothing is shuffled by value."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    return low is not None and low == high
