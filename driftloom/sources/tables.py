"""Readers, writers and adapters: posts, vectors, ratings, timelines, experiment records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import importance, micros

ARCHIVE = (
    "id LONG, full_text STRING, created_at STRING, retweet_count LONG, favorite_count LONG, in_reply_to_status_id LONG, "
    "in_reply_to_screen_name STRING, screen_name STRING, username STRING, datetime TIMESTAMP"
)
RECORD = (
    "timestamp STRING, model_name STRING, model_params MAP<STRING, STRING>, config MAP<STRING, STRING>, "
    "scores STRUCT<field_density_score: DOUBLE, kl_divergence: DOUBLE, score_std: DOUBLE, frames_evaluated: LONG, total_test_posts: LONG>, "
    "runtime_seconds DOUBLE, test_weeks INT, train_size LONG, test_size LONG"
)


def parquet(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A Parquet file or folder, local or in any store Spark reads; credentials come from the session only."""
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)


def csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """CSV with a header whose text may hold line breaks and doubled quotes."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (r.schema(schema) if schema is not None else r.option("inferSchema", True)).csv(path)


def csv_columns(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).csv(path).columns


def json_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first path that exists in its store."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            return p
    raise FileNotFoundError(", ".join(paths))


def array_files(spark: SparkSession, path: str, keys: tuple[str, ...] = ("embeddings", "arr_0")) -> DataFrame:
    """(path, row, vector) from NumPy archives: the first of `keys` that an archive holds. One file is one task's work."""

    def run(batches):
        import io

        import numpy as np
        import pyarrow as pa

        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                z = np.load(io.BytesIO(data), allow_pickle=False)
                a = z[next((k for k in keys if k in z.files), z.files[0])].astype(np.float64)
                for lo in range(0, len(a), 5000):
                    part = a[lo : lo + 5000]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(range(lo, lo + len(part)), pa.int64()), pa.array(part.tolist(), pa.list_(pa.float64()))], names=["path", "row", "vector"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, row long, vector array<double>")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').mode("overwrite").csv(path)


def write_timeline(frames: DataFrame, path: str) -> None:
    """Timeline posts as JSON lines, one folder a day."""
    frames.write.partitionBy("date").mode("overwrite").json(path)


def append_record(spark: SparkSession, record: dict, path: str) -> None:
    spark.createDataFrame([record], RECORD).coalesce(1).write.mode("append").json(path)


def records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).json(path)


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """posts(id, us, day, x, y, retweet_count, favorite_count, weight, author, kind) from the events table."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = e.select(
        F.col("event_id").alias("id"), micros().alias("us"), F.col("ts").cast("date").alias("day"), (F.col("value") / 50).alias("x"),
        (F.get_json_object("props", "$.k").cast("double") / 20).alias("y"), (F.col("user_id") % 5).alias("retweet_count"),
        F.floor("value").cast("long").alias("favorite_count"), F.col("user_id").alias("author"), F.col("event_type").alias("kind"),
    )
    return e.withColumn("weight", importance(F.col("retweet_count"), F.col("favorite_count")))


#: Centres of the planted clusters of synthetic_posts.
CENTRES = [(-3.0, -2.0), (-1.0, 3.0), (0.0, 0.0), (2.5, -2.5), (3.0, 2.0)]


def synthetic_posts(spark: SparkSession, n: int = 5000, noise: float = 0.15, days: int = 59, seed: int = 42) -> DataFrame:
    """Posts of planted Gaussian clusters whose centres drift slowly, and uniform noise over [-6, 6] squared."""
    base = spark.range(n).withColumns({"u": F.rand(seed), "t": F.rand(seed + 1), "gx": F.randn(seed + 2), "gy": F.randn(seed + 3), "ux": F.rand(seed + 4), "uy": F.rand(seed + 5)})
    k = (F.col("id") % len(CENTRES)).cast("int") + 1
    cx = F.element_at(F.array(*[F.lit(c[0]) for c in CENTRES]), k)
    cy = F.element_at(F.array(*[F.lit(c[1]) for c in CENTRES]), k)
    sway = F.sin(F.col("t") * 6.283185307179586) * 0.3
    out = F.col("u") < noise
    return base.select(
        "id", F.expr(f"timestampadd(SECOND, cast(t * {days * 86400} as int), timestamp_ntz'2023-01-01 00:00:00')").alias("ts"),
        F.when(out, F.col("ux") * 12 - 6).otherwise(cx + sway + F.col("gx") * 0.8).alias("x"),
        F.when(out, F.col("uy") * 12 - 6).otherwise(cy + sway + F.col("gy") * 0.8).alias("y"),
        F.when(out, F.lit(-1)).otherwise(k - 1).alias("cluster"),
    )


def pareto_counts(df: DataFrame, zero: float = 0.75, alpha: float = 2.5, scale: float = 10.0, cap: int = 1000, seed: int = 42) -> DataFrame:
    """df with `count`: zero for a share of the rows, else a capped Pareto number of at least one."""
    heavy = F.floor(F.pow(F.lit(1.0) / (F.lit(1.0) - F.rand(seed + 1)), F.lit(1.0 / alpha)) * scale)
    return df.withColumn("count", F.when(F.rand(seed) < zero, 0).otherwise(F.greatest(F.lit(1), F.least(heavy, F.lit(cap)))).cast("long"))


def mini_sample(spark: SparkSession) -> DataFrame:
    """33 fixed points in three groups of 15, 10 and 8 on small circles."""
    import math

    groups = [(15, -1.0, 0.5, 0.4), (10, 1.0, 1.0, 0.3), (8, 0.2, -1.2, 0.25)]
    rows = [(cx + r * math.cos(6.283 * i / n), cy + r * math.sin(6.283 * i / n), k) for k, (n, cx, cy, r) in enumerate(groups) for i in range(n)]
    return spark.createDataFrame(rows, "x double, y double, cluster int")
