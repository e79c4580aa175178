"""Frames, bounds and density grids in long form (key, r, c, p)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import DAY_US, cell, nearest_node


#: Cells of partial grids that a task holds.
HELD = 8_000_000


def assign_frames(df: DataFrame, days: float = 1.0) -> DataFrame:
    """`frame_id` by arithmetic on the time since the first post; the last post on a frame's edge is in none (-1)."""
    step = int(days * DAY_US)
    t = df.agg(F.min("us").alias("_t0"), F.max("us").alias("_t1"))
    d = df.crossJoin(F.broadcast(t)).withColumn("_rel", F.col("us") - F.col("_t0"))
    loose = (F.col("us") == F.col("_t1")) & (F.col("_rel") > 0) & (F.col("_rel") % step == 0)
    return d.withColumn("frame_id", F.when(loose, F.lit(-1)).otherwise(F.expr(f"_rel div {step}")).cast("long")).drop("_t0", "_t1", "_rel")


def bounds(df: DataFrame, *by: str) -> DataFrame:
    """Padded extent: each side by a fifth of the range, 0.5 at least."""
    pad = lambda c: F.greatest(F.lit(0.5), (F.max(c) - F.min(c)) * 0.2)
    return df.groupBy(*by).agg((F.min("x") - pad("x")).alias("x0"), (F.max("x") + pad("x")).alias("x1"), (F.min("y") - pad("y")).alias("y0"), (F.max("y") + pad("y")).alias("y1"))


def cells(spark, g: int) -> DataFrame:
    return spark.range(g * g).select(F.expr(f"cast(id div {g} as int)").alias("r"), (F.col("id") % g).cast("int").alias("c"))


def located(df: DataFrame, box: DataFrame, g: int) -> DataFrame:
    """`r` and `c` of each post under a one-row box; r runs along y."""
    d = df.crossJoin(F.broadcast(box))
    return d.withColumns({"r": cell(F.col("y"), F.col("y0"), F.col("y1"), g), "c": cell(F.col("x"), F.col("x0"), F.col("x1"), g)}).drop("x0", "x1", "y0", "y1")


def raw_grid(df: DataFrame, box: DataFrame, g: int, sigma: float, key: str = "grp", weight: Column | None = None, batch: int = 4096) -> DataFrame:
    """(key, r, c, v): sums of weighted Gaussian kernels at the nodes of a one-row box, before normalising.

    The kernel is a product of one factor for each axis, so a post costs 2g exponentials; each task turns its posts
    into one g by g product per key, and those partial grids are summed. The posts are read once and not crossed
    with the grid. A task sends its partial grids on once they hold HELD cells.
    """
    w = F.lit(1.0) if weight is None else weight
    src = df.select(F.col(key).cast("long").alias("key"), "x", "y", w.cast("double").alias("w")).crossJoin(F.broadcast(box))

    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}

        def flush():
            for one, v in sums.items():
                r, c = np.divmod(np.arange(g * g, dtype=np.int32), g)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(g * g, one)), pa.array(r), pa.array(c), pa.array(v.ravel())], names=["key", "r", "c", "v"])
            sums.clear()

        for b in batches:
            k, x, y, w, x0, x1, y0, y1 = (b.column(i).to_numpy() for i in range(8))
            for one in np.unique(k):
                at = np.flatnonzero(k == one)
                gx, gy = (lo[0] + (hi[0] - lo[0]) * np.arange(g) / (g - 1) for lo, hi in ((x0, x1), (y0, y1)))
                out = sums.setdefault(int(one), np.zeros((g, g)))
                for lo in range(0, len(at), batch):
                    i = at[lo : lo + batch]
                    kx = np.exp(-((x[i][:, None] - gx) ** 2) / (2 * sigma * sigma)) * w[i][:, None]
                    ky = np.exp(-((y[i][:, None] - gy) ** 2) / (2 * sigma * sigma))
                    out += ky.T @ kx
                if len(sums) * g * g >= HELD:
                    yield from flush()
        yield from flush()

    parts = src.mapInArrow(run, "key long, r int, c int, v double")
    return parts.groupBy("key", "r", "c").agg(F.sum("v").alias("v"))


def normalised(grid: DataFrame, g: int, key: str = "key") -> DataFrame:
    """(key, r, c, p): each key's grid sums to 1; a grid without mass is uniform. One key's grid is g * g rows."""
    s = F.sum("v").over(W.partitionBy(key))
    return grid.withColumn("p", F.when(s > 0, F.col("v") / s).otherwise(F.lit(1.0 / (g * g)))).drop("v")


def density(df: DataFrame, box: DataFrame, g: int, sigma: float, key: str = "grp", weight: Column | None = None) -> DataFrame:
    return normalised(raw_grid(df, box, g, sigma, key, weight), g)


def point_mass(df: DataFrame, box: DataFrame, g: int, key: str) -> DataFrame:
    """(key, r, c, p): shares of posts by nearest node."""
    d = df.crossJoin(F.broadcast(box))
    d = d.select(F.col(key).alias("key"), nearest_node(F.col("y"), F.col("y0"), F.col("y1"), g).alias("r"), nearest_node(F.col("x"), F.col("x0"), F.col("x1"), g).alias("c"))
    n = d.groupBy("key", "r", "c").agg(F.count("*").alias("v"))
    return n.withColumn("p", F.col("v") / F.sum("v").over(W.partitionBy("key"))).drop("v")


def history(grids: DataFrame, frames: DataFrame, back: int | None) -> DataFrame:
    """Sums of the raw grids of the `back` frames before each frame (all before, if None or if those hold nothing).

    Raw grids add up, so histories are running sums of frames' grids, each made once: one shuffle by cell, in which
    each of the g * g cells is a window over its frames. frames(frame_id) are the wanted ones, a few rows.
    """
    span = grids.select("r", "c").distinct()
    wanted = span.crossJoin(F.broadcast(frames.select(F.col("frame_id").cast("long").alias("key")).distinct()))
    both = grids.select("key", "r", "c", "v", F.lit(False).alias("asked")).unionByName(wanted.select("key", "r", "c", F.lit(None).cast("double").alias("v"), F.lit(True).alias("asked")))
    by_cell = W.partitionBy("r", "c").orderBy("key")
    whole = F.sum("v").over(by_cell.rangeBetween(W.unboundedPreceding, -1))
    near = whole if back is None else F.sum("v").over(by_cell.rangeBetween(-back, -1))
    summed = both.select("key", "r", "c", "asked", whole.alias("whole"), near.alias("near")).filter("asked and whole is not null")
    return summed.select("key", "r", "c", F.coalesce("near", "whole").alias("v"))


def sequences(frames: DataFrame, length: int, value: str) -> DataFrame:
    """Each frame with the `length` values before it; frames are few, one row each."""
    w = W.orderBy("frame_id")
    s = frames.withColumns({"inputs": F.collect_list(value).over(w.rowsBetween(-length, -1)), "target": F.col(value)})
    return s.filter(F.size("inputs") == length)


def rescaled(grid: DataFrame, g: int, to: int) -> DataFrame:
    """A grid at another size by bilinear interpolation, normalised again."""
    spark = grid.sparkSession
    f = lambda i: F.col(i) * F.lit((g - 1) / (to - 1))
    t = cells(spark, to).withColumns({"fr": f("r"), "fc": f("c")})
    corners = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    t = t.withColumn("k", corners).withColumns({"lr": F.least(F.floor("fr"), F.lit(g - 2)).cast("int"), "lc": F.least(F.floor("fc"), F.lit(g - 2)).cast("int")})
    share = lambda a, x, lo: F.when(F.col(a) == 1, F.col(x) - F.col(lo)).otherwise(1 - (F.col(x) - F.col(lo)))
    t = t.select("r", "c", (F.col("lr") + F.col("k.a")).alias("sr"), (F.col("lc") + F.col("k.b")).alias("sc"), (share("k.a", "fr", "lr") * share("k.b", "fc", "lc")).alias("w"))
    s = grid.select("key", F.col("r").alias("sr"), F.col("c").alias("sc"), "p")
    out = s.join(t, ["sr", "sc"]).groupBy("key", "r", "c").agg(F.sum(F.col("p") * F.col("w")).alias("v"))
    return normalised(out, to)
