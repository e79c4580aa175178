"""Rolling evaluation of forecast models: fit once, forecast each test frame, score, record."""

from __future__ import annotations

import argparse
import time
from dataclasses import asdict, dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import DAY_US
from ..operators import drift, metrics, sequence
from ..operators.grid import assign_frames, bounds, cells, density, history, located, normalised, point_mass, raw_grid
from ..operators.points import date_range, drop_missing, sample_exact, temporal_cut


@dataclass
class Setting:
    g: int = 100
    frame_days: float = 1.0
    test_weeks: int = 10
    back: int | None = None  # frames of history that a model sees; None: all before


@dataclass
class Split:
    """One evaluation's tables: framed posts, training posts, the box around them, and the frames to score."""

    framed: DataFrame
    train: DataFrame
    box: DataFrame
    frames: DataFrame
    setting: Setting


class Model(Protocol):
    """A forecast: (key, r, c, p) for each test frame, or one grid for all if per_frame is False."""

    per_frame: bool

    def name(self) -> str: ...
    def predict(self, split: Split) -> DataFrame: ...


@dataclass
class Uniform:
    per_frame: bool = False

    def name(self) -> str:
        return "Random Uniform"

    def predict(self, split: Split) -> DataFrame:
        g = split.setting.g
        return cells(split.train.sparkSession, g).select(F.lit(0).cast("long").alias("key"), "r", "c", F.lit(1.0 / g**2).alias("p"))


@dataclass
class HistoricalAverage:
    bandwidth: float = 0.1
    per_frame: bool = False

    def name(self) -> str:
        return f"Historical Average (h={self.bandwidth})"

    def predict(self, split: Split) -> DataFrame:
        return density(split.train.withColumn("grp", F.lit(0)), split.box, split.setting.g, self.bandwidth)


@dataclass
class GaussianHistory:
    """Weighted smoothing of the frames before each frame; raw grids of frames are made once and summed."""

    sigma: float = 0.05
    half_life_days: float | None = None
    per_frame: bool = True

    def name(self) -> str:
        return f"Gaussian Smoothed Historical (sigma={self.sigma})"

    def predict(self, split: Split) -> DataFrame:
        raw = raw_grid(split.framed.filter("frame_id >= 0"), split.box, split.setting.g, self.sigma, "frame_id", F.col("weight"))
        return normalised(history(raw, split.frames.select("frame_id"), split.setting.back), split.setting.g)


@dataclass
class DriftField:
    params: drift.Params = field(default_factory=drift.Params)
    tune: bool = False
    calls: int = 10
    initial: int = 5
    per_frame: bool = True  # refreshed before each frame; False: one forecast from the training posts

    def name(self) -> str:
        return "DriftField"

    def predict(self, split: Split) -> DataFrame:
        p = drift.tuned(split.train, split.setting.g, self.calls, self.initial)[0] if self.tune else self.params
        if self.per_frame:
            return drift.refreshed(split.framed, split.frames, split.box, split.setting.g, p, split.setting.frame_days)
        grid = drift.predict(split.train, split.setting.g, p)
        return grid.withColumn("key", F.lit(0).cast("long")).select("key", "r", "c", "p")


@dataclass
class SequenceForecast:
    length: int = 5
    sigma: float = 0.1
    epochs: int = 60
    seed: int = 42
    per_frame: bool = True

    def name(self) -> str:
        return f"LSTM Predictor (length={self.length})"

    def predict(self, split: Split) -> DataFrame:
        g, spark = split.setting.g, split.train.sparkSession
        ids, series = sequence.frame_matrix(split.train, split.box, g, self.sigma)
        wanted = [r[0] for r in split.frames.select("frame_id").orderBy("frame_id").collect()]
        out = sequence.forecast(series, self.length, max(wanted) - ids[-1] if wanted else 0, self.seed, self.epochs)
        rows = [(f, i // g, i % g, float(v)) for f in wanted for i, v in enumerate(out[max(f - ids[-1] - 1, 0)])]
        return spark.createDataFrame(rows, "key long, r int, c int, p double")


MODELS = [Uniform, HistoricalAverage, GaussianHistory, DriftField, SequenceForecast]


def load(df: DataFrame, sample: int | None = None, start_us: int | None = None, end_us: int | None = None) -> DataFrame:
    """Sample first, then drop missing values, then apply the date range."""
    if sample is not None:
        df = sample_exact(df, sample)
    return date_range(drop_missing(df, "x", "y", "us"), start_us, end_us)


def split(posts: DataFrame, setting: Setting) -> Split:
    """Training posts lie before the last test_weeks; frames with a post after them are scored, with all their posts."""
    cut = F.broadcast(temporal_cut(posts, setting.test_weeks).select("cut"))
    framed = assign_frames(posts, setting.frame_days).crossJoin(cut).withColumn("_train", F.col("us") < F.col("cut")).drop("cut")
    train = framed.filter("_train")
    last = F.broadcast(train.agg(F.max("us").alias("last")))
    frames = framed.filter("frame_id >= 0").crossJoin(last).groupBy("frame_id").agg(F.max(F.col("us") > F.col("last")).alias("hit"), F.count("*").alias("n")).filter("hit").select("frame_id", "n")
    return Split(framed, train, bounds(train), frames, setting)


def scores(model: Model, s: Split, pred: DataFrame | None = None) -> DataFrame:
    """(frame_id, fds, n, kl) of every scored frame, in one plan; pred: the model's forecast if it is there already."""
    g = s.setting.g
    pred = model.predict(s) if pred is None else pred
    test = s.framed.join(F.broadcast(s.frames.select("frame_id")), "frame_id")
    f = metrics.fds(located(test, s.box, g), pred, g, per_frame=model.per_frame)
    k = metrics.kl(point_mass(test, s.box, g, "frame_id"), pred, g, model.per_frame)
    return f.join(k.withColumnRenamed("key", "frame_id"), "frame_id")


def evaluate(posts: DataFrame, models: list[Model], setting: Setting, sink: str | None = None) -> list[dict]:
    """Each model's record; framed posts are read once and kept for all models."""
    from ..sources.tables import append_record

    spark = posts.sparkSession
    s = split(posts, setting)
    s.framed.persist()
    # one row, and one row a frame: literal from here on, so no model derives them anew
    box, s.frames = s.box.first(), s.frames.persist()
    s.box = spark.createDataFrame([box], s.box.schema)
    sizes = s.train.count(), s.frames.agg(F.sum("n")).first()[0] or 0
    out = []
    for m in models:
        began = time.time()
        pred = m.predict(s).persist()  # read by both scores
        r = metrics.summary(scores(m, s, pred)).first().asDict()
        pred.unpersist()
        record = {
            "timestamp": time.strftime("%Y%m%d_%H%M%S"), "model_name": m.name(), "model_params": {k: str(v) for k, v in asdict(m).items()}, "config": {k: str(v) for k, v in asdict(setting).items()},
            "scores": r, "runtime_seconds": time.time() - began, "test_weeks": setting.test_weeks, "train_size": sizes[0], "test_size": sizes[1],
        }
        out.append(record)
        if sink:
            append_record(spark, record, sink)
    s.frames.unpersist()
    s.framed.unpersist()
    return out


def report(records: list[dict]) -> str:
    return "\n".join(f"{r['model_name']}: FDS {r['scores']['field_density_score']:.4f}, KL {r['scores']['kl_divergence']:.4f}, std {r['scores']['score_std']:.4f}, {r['runtime_seconds']:.2f} s" for r in records)


def main() -> None:
    from ..sources.tables import posts

    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("folder")
    p.add_argument("--grid", type=int, default=100)
    p.add_argument("--frame-days", type=float, default=1.0)
    p.add_argument("--test-weeks", type=int, default=10)
    p.add_argument("--sample", type=int)
    p.add_argument("--sink")
    a = p.parse_args()
    spark = SparkSession.builder.getOrCreate()
    got = evaluate(load(posts(spark, a.folder), a.sample), [m() for m in MODELS], Setting(a.grid, a.frame_days, a.test_weeks), a.sink)
    print(report(got))


if __name__ == "__main__":
    main()
