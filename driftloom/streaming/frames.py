"""Streams of posts: frame counts, sliding densities, arriving posts scored against a known grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.grid import located
from ..operators.metrics import fds


def event_time(df: DataFrame) -> DataFrame:
    """`ts` as a timestamp with zone, which watermarks ask for."""
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def frame_counts(stream: DataFrame, late: str = "1 day", frame: str = "1 day") -> DataFrame:
    return event_time(stream).withWatermark("ts", late).groupBy(F.window("ts", frame)).agg(F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy")).select(F.col("window.start").alias("start"), "n", "cx", "cy")


def sliding_cells(stream: DataFrame, box: DataFrame, g: int, late: str = "1 day", span: str = "7 days", every: str = "1 day") -> DataFrame:
    """Posts by cell in sliding windows: the state is one number for each window and cell."""
    at = located(event_time(stream).withWatermark("ts", late), box, g)
    return at.groupBy(F.window("ts", span, every), "r", "c").agg(F.sum("weight").alias("w")).select(F.col("window.end").alias("end"), "r", "c", "w")


def moves(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """(kind, day, n, move): how far each kind's mean went since its day before; state is the last day's mean."""

    def run(key, frames, state):
        import pandas as pd

        rows = pd.concat(list(frames)).sort_values("start")
        last = state.get if state.exists else None
        out = []
        for r in rows.itertuples():
            move = float("nan") if last is None else ((r.cx - last[0]) ** 2 + (r.cy - last[1]) ** 2) ** 0.5
            last = (float(r.cx), float(r.cy))
            out.append((key[0], r.start, int(r.n), move))
        state.update(last)
        yield pd.DataFrame(out, columns=["kind", "start", "n", "move"])

    daily = event_time(stream).withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "kind").agg(F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    flat = daily.select("kind", F.col("window.start").alias("start"), "n", "cx", "cy")
    return flat.groupBy("kind").applyInPandasWithState(run, "kind string, start timestamp, n long, move double", "cx double, cy double", "append", "NoTimeout")


def scored_batches(stream: DataFrame, grid: DataFrame, box: DataFrame, g: int, sink: str, checkpoint: str):
    """A running query that writes each micro-batch's FDS under a fixed grid."""

    def one(batch: DataFrame, batch_id: int) -> None:
        at = located(batch.withColumn("frame_id", F.lit(batch_id)), box, g)
        fds(at, grid, g, per_frame=False).write.mode("append").parquet(sink)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
