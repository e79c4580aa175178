"""The rating job: sample, rate, score, record; and how well a lens does on rows that it has not seen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ratings as parsed
from . import lens as L
from . import points

#: Answers between two written parts of a job.
EVERY = 1000


def rated(df: DataFrame, lens: L.Lens, raters: L.Raters, backend: str, text: str = "text") -> DataFrame:
    """df with a column a dimension, `error` and the lens's score; where the back-end failed the dimensions are null."""
    got = raters.rate(df, lens, backend, text).withColumn("_r", F.when(F.col("error").isNull(), parsed(F.col("answer"), len(lens.dims), lens.default)))
    got = got.withColumns({d: F.col("_r")[i] for i, d in enumerate(lens.dims)}).drop("_r", "answer")
    return L.scored(got, list(lens.dims), f"{lens.name}_score")


def summary(df: DataFrame, lens: L.Lens) -> DataFrame:
    """One row: rows, those with and without ratings, and the mean of each dimension and of the score."""
    first = F.col(lens.dims[0])
    means = [F.avg(c).alias(f"mean_{c}") for c in (*lens.dims, f"{lens.name}_score")]
    return df.agg(F.count("*").alias("total"), F.count(first).alias("succeeded"), F.count_if(first.isNull()).alias("failed"), *means)


def distributions(df: DataFrame, lens: L.Lens) -> DataFrame:
    """(dim, value, n): how often each rating was given."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("value")) for d in lens.dims]))
    return df.select(pairs.alias("p")).select("p.dim", "p.value").dropna().groupBy("dim", "value").agg(F.count("*").alias("n"))


def job(df: DataFrame, lens: L.Lens, raters: L.Raters, backend: str, folder: str, n: int, key: str = "id", text: str = "text", every: int = EVERY, seed: int = 42) -> DataFrame:
    """Rates a sample of n rows and leaves in `folder` the manifest of chosen keys, the rated parts and the summary.

    Parts of about `every` rows are written one by one; a job that starts anew in the same folder keeps the sample of its
    manifest and rates only what no part holds yet, so that no answer is paid for twice.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def there(name: str) -> bool:
        p = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/_SUCCESS")
        return p.getFileSystem(conf).exists(p)

    if not there("manifest"):
        points.sample_exact(df, n, key, seed).select(key, F.lit(lens.name).alias("lens"), F.lit(backend).alias("backend")).coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    chosen = spark.read.schema(df.select(key).schema).json(f"{folder}/manifest")
    rows = df.join(F.broadcast(chosen) if n <= 1_000_000 else chosen, key, "left_semi")
    parts = max(-(-n // every), 1)
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)))
    for part in range(parts):
        if not there(f"part={part}"):
            rated(rows.filter(F.col("_part") == part).drop("_part"), lens, raters, backend, text).write.mode("overwrite").parquet(f"{folder}/part={part}")
    out = spark.read.parquet(*[f"{folder}/part={part}" for part in range(parts)])
    summary(out, lens).coalesce(1).write.mode("overwrite").json(f"{folder}/summary")
    distributions(out, lens).coalesce(1).write.mode("overwrite").json(f"{folder}/distribution")
    return out


def held_out(rows: DataFrame, dims: list[str], ridge: float = 1e-6, key: str = "id", column: str = "embedding") -> tuple[DataFrame, dict]:
    """((dim, n, r_scaled, r), model): fitted on four fifths of the keys, correlated on the rest with ratings in both
    scales, and then fitted anew on all rows."""
    split = points.split_by_hash(rows, key)
    train, test = (split.filter(F.col("part") == p) for p in ("train", "test"))
    m = L.fit(train, dims, ridge, column)
    guessed = L.project(test.select(column, *[F.col(d).cast("double").alias(f"_{d}") for d in dims]), m, column)
    scaled = {d: (F.col(f"_{d}") - F.lit(float(m["y_mean"][k]))) / F.lit(float(m["y_std"][k])) for k, d in enumerate(dims)}
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("p"), scaled[d].alias("s"), F.col(f"_{d}").alias("y")) for d in dims]))
    table = guessed.select(each.alias("e")).groupBy("e.dim").agg(F.count("e.y").alias("n"), F.corr("e.p", "e.s").alias("r_scaled"), F.corr("e.p", "e.y").alias("r"))
    return table, L.fit(rows, dims, ridge, column)


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r): the correlation matrix of some columns, all pairs in one pass over the rows."""
    pairs = [(a, b) for a in columns for b in columns]
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)])).alias("e")).select("e.*")
