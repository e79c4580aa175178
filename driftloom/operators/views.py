"""Data sets behind the pictures: coloured points, heat-map pairs, animation steps, landscapes, and checks of timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import DAY_US, cell, distance
from . import points

#: Ten even stops of the viridis palette, dark to light, as red, green, blue.
VIRIDIS = [
    (68, 1, 84), (72, 40, 120), (62, 73, 137), (49, 104, 142), (38, 130, 142),
    (31, 158, 137), (53, 183, 121), (110, 206, 88), (181, 222, 43), (253, 231, 37),
]


def rgba(norm: Column, stops: list[tuple[int, int, int]] = VIRIDIS) -> dict[str, Column]:
    """r, g, b, a from 0 to 255, cut, of numbers from 0 to 1: straight lines between the stops of a palette of 256 steps."""
    u = F.least(F.floor(norm * 256), F.lit(255)) / 255.0 * (len(stops) - 1)
    k = F.least(F.floor(u), F.lit(len(stops) - 2)).cast("int")
    out = {}
    for i, name in enumerate("rgb"):
        at = F.array(*[F.lit(float(s[i])) for s in stops])
        lo, hi = F.element_at(at, k + 1), F.element_at(at, k + 2)
        out[name] = F.when(norm.isNotNull(), F.floor(lo + (hi - lo) * (u - k) + 1e-9).cast("int"))
    return out | {"a": F.when(norm.isNotNull(), F.lit(255))}


def point_frame(df: DataFrame) -> DataFrame:
    """(id, x, y, dist, r, g, b, a, size, week) of every post, coloured by its distance from the centre of all."""
    c = df.agg(F.avg("x").alias("_cx"), F.avg("y").alias("_cy"))
    d = df.crossJoin(F.broadcast(c)).withColumn("dist", distance(F.col("x"), F.col("y"), F.col("_cx"), F.col("_cy")))
    n = points.min_max(d, "dist", "_n").withColumns(rgba(F.col("_n")))
    return n.select("id", "x", "y", "dist", "r", "g", "b", "a", F.lit(1.0).alias("size"), F.weekofyear("day").alias("week"))


def hover(df: DataFrame, places: list[tuple[float, float]], reach: float = 0.5) -> DataFrame:
    """(place, id, dist): the post nearest to each of some literal places, the least id of equals, if it is nearer than `reach`."""
    near = [F.min(F.struct(distance(F.col("x"), F.col("y"), F.lit(float(a)), F.lit(float(b))).alias("dist"), F.col("id"))).alias(f"p{i}") for i, (a, b) in enumerate(places)]
    one = df.agg(*near).select(F.posexplode(F.array(*[F.col(f"p{i}") for i in range(len(places))])).alias("place", "e"))
    return one.filter(F.col("e.dist") < reach).select("place", "e.id", "e.dist")


def heat_pair(predicted: DataFrame, true: DataFrame) -> DataFrame:
    """(key, r, c, predicted, true): two grids cell by cell; a cell that one side lacks is 0 there."""
    a, b = predicted.select("key", "r", "c", F.col("p").alias("predicted")), true.select("key", "r", "c", F.col("p").alias("true"))
    return a.join(b, ["key", "r", "c"], "full_outer").na.fill(0.0, ["predicted", "true"])


def animation(predicted: DataFrame, framed: DataFrame, box: DataFrame, g: int) -> DataFrame:
    """(step, key, r, c, p, n): two steps a frame, the forecast alone (n null), then with the number of posts in each cell."""
    at = framed.crossJoin(F.broadcast(box)).select(F.col("frame_id").alias("key"), cell(F.col("y"), F.col("y0"), F.col("y1"), g).alias("r"), cell(F.col("x"), F.col("x0"), F.col("x1"), g).alias("c"))
    n = at.groupBy("key", "r", "c").agg(F.count("*").alias("n"))
    both = predicted.select("key", "r", "c", "p").join(n, ["key", "r", "c"], "left").na.fill(0, ["n"])
    steps = F.array(F.struct(F.lit(0).alias("half"), F.lit(None).cast("long").alias("n")), F.struct(F.lit(1).alias("half"), F.col("n").alias("n")))
    out = both.withColumn("e", F.explode(steps))
    return out.select((F.col("key") * 2 + F.col("e.half")).alias("step"), "key", "r", "c", "p", "e.n")


def landscapes(df: DataFrame, days: int = 14, step: int = 7, least: int = 100) -> DataFrame:
    """(window, n, cx, cy): windows of `days` days, one every `step` days from the first post, that hold `least` posts.

    A post is repeated for each window that holds it (days / step of them); sums are combined before the shuffle.
    """
    t0 = df.agg(F.min("us").alias("_t0"))
    at = F.expr(f"(us - _t0) div {step * DAY_US}")
    first = F.greatest(F.expr(f"(us - _t0 - {days * DAY_US}) div {step * DAY_US}") + F.when(F.col("us") - F.col("_t0") >= days * DAY_US, 1).otherwise(0), F.lit(0))
    held = df.crossJoin(F.broadcast(t0)).select("x", "y", F.explode(F.sequence(first, at)).alias("window"))
    return held.groupBy("window").agg(F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy")).filter(F.col("n") >= least)


def timeline_differences(old: DataFrame, new: DataFrame, by: str = "date") -> DataFrame:
    """(field, old, new): fields of the posts that `new` lacks, and days whose numbers of posts differ; no row if all agrees."""
    spark = old.sparkSession
    lost = [(f"post.{c}", "present", "missing") for c in old.columns if c not in new.columns]
    fields = spark.createDataFrame(lost, "field string, old string, new string")
    a, b = (t.groupBy(by).agg(F.count("*").alias(n)) for t, n in ((old, "old"), (new, "new")))
    days = a.join(b, by, "full_outer").na.fill(0, ["old", "new"]).filter("old <> new")
    return fields.unionByName(days.select(F.concat(F.lit("frames."), F.col(by).cast("string")).alias("field"), F.col("old").cast("string"), F.col("new").cast("string")))
