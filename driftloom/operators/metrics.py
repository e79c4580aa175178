"""Scores of predicted density grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import clamped
from .grid import cells


def fds(located: DataFrame, grid: DataFrame, g: int, by: str = "frame_id", per_frame: bool = True) -> DataFrame:
    """(by, fds, n): weighted mean of p * g * g at the posts' cells; 1 if there is no weight.

    Posts are first summed by cell, so the join with the grid is of cells, not posts. per_frame says whether the grid
    has a key for each frame or one grid for all.
    """
    at = located.groupBy(by, "r", "c").agg(F.sum("weight").alias("w"), F.count("*").alias("n"))
    side = grid.withColumnRenamed("key", by) if per_frame else grid.drop("key")
    j = at.join(side, [by, "r", "c"] if per_frame else ["r", "c"], "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    return j.groupBy(by).agg(F.coalesce(F.sum(F.col("w") * F.col("p") * F.lit(float(g * g))) / F.nullif(F.sum("w"), F.lit(0.0)), F.lit(1.0)).alias("fds"), F.sum("n").alias("n"))


def kl(truth: DataFrame, pred: DataFrame, g: int, per_frame: bool = True, eps: float = 1e-10) -> DataFrame:
    """(key, kl) over all g * g cells: both grids are raised by eps and normalised again."""
    spark = truth.sparkSession
    full = truth.select("key").distinct().crossJoin(F.broadcast(cells(spark, g)))
    q = pred if per_frame else pred.drop("key")
    j = full.join(truth.withColumnRenamed("p", "a"), ["key", "r", "c"], "left").join(q.withColumnRenamed("p", "b"), ["key", "r", "c"] if per_frame else ["r", "c"], "left")
    w = W.partitionBy("key")
    a, b = F.coalesce("a", F.lit(0.0)) + eps, F.coalesce("b", F.lit(0.0)) + eps
    j = j.select("key", (a / F.sum(a).over(w)).alias("a"), (b / F.sum(b).over(w)).alias("b"))
    return j.groupBy("key").agg(F.sum(F.col("a") * F.log(F.col("a") / F.col("b"))).alias("kl"))


def summary(scores: DataFrame) -> DataFrame:
    """Count-weighted means over frames, their spread, frames and posts."""
    wm = lambda c: F.coalesce(F.sum(F.col(c) * F.col("n")) / F.nullif(F.sum("n"), F.lit(0)), F.avg(c))
    return scores.agg(wm("fds").alias("field_density_score"), wm("kl").alias("kl_divergence"), F.stddev_pop("fds").alias("score_std"), F.count("*").alias("frames_evaluated"), F.sum("n").alias("total_test_posts"))


def nll(located: DataFrame, grid: DataFrame) -> DataFrame:
    """Weighted mean of -ln(p + 1e-8) at the posts' cells, under one grid."""
    at = located.groupBy("r", "c").agg(F.sum("weight").alias("w")).join(grid, ["r", "c"], "left")
    return at.agg((F.sum(-F.col("w") * F.log(F.coalesce("p", F.lit(0.0)) + 1e-8)) / F.sum("w")).alias("nll"))


def frame_difference(grid: DataFrame, g: int) -> DataFrame:
    """(key, mean_abs_diff) between a frame's grid and the one before."""
    b = grid.select((F.col("key") + 1).alias("key"), "r", "c", F.col("p").alias("q"))
    return grid.join(b, ["key", "r", "c"]).groupBy("key").agg((F.sum(F.abs(F.col("p") - F.col("q"))) / (g * g)).alias("mean_abs_diff"))


def centre_movement(df: DataFrame) -> DataFrame:
    """(frame_id, move): how far the posts' mean went since the frame before."""
    m = df.groupBy("frame_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    w = W.orderBy("frame_id")
    return m.select("frame_id", F.sqrt(F.pow(F.col("cx") - F.lag("cx").over(w), 2) + F.pow(F.col("cy") - F.lag("cy").over(w), 2)).alias("move")).filter("move is not null")


def autocorrelation(df: DataFrame) -> DataFrame:
    n = df.groupBy("frame_id").agg(F.count("*").alias("n"))
    return n.withColumn("next", F.lead("n").over(W.orderBy("frame_id"))).filter("next is not null").agg(F.corr("n", "next").alias("lag1"), F.count("*").alias("pairs"))


def diversity(grid: DataFrame) -> DataFrame:
    return grid.groupBy("key").agg(F.stddev_pop("p").alias("std"), F.min("p").alias("low"), F.max("p").alias("high"))


def softmax(df: DataFrame, value: str, *group: str) -> DataFrame:
    """`share`: exp of the value less the group's largest, over the group's sum; one aggregate by group, joined back."""
    top = df.groupBy(*group).agg(F.max(value).alias("_top"))
    e = df.join(top, list(group)).withColumn("_e", F.exp(F.col(value) - F.col("_top"))).drop("_top")
    return e.join(e.groupBy(*group).agg(F.sum("_e").alias("_sum")), list(group)).withColumn("share", F.col("_e") / F.col("_sum")).drop("_e", "_sum")


def renormalised(df: DataFrame, value: str, *group: str) -> DataFrame:
    """`share`: the value, at least 0, over the group's sum; null where that is 0."""
    v = df.withColumn("_v", clamped(F.col(value)))
    sums = v.groupBy(*group).agg(F.sum("_v").alias("_sum"))
    return v.join(sums, list(group)).withColumn("share", F.when(F.col("_sum") > 0, F.col("_v") / F.col("_sum"))).drop("_v", "_sum")
