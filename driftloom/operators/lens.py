"""Lenses: rating texts, fitting a linear map from vectors to ratings, and applying it to all vectors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import composite, dot, too_short


@dataclass(frozen=True)
class Lens:
    name: str
    dims: tuple[str, ...]
    scale: tuple[float, float]
    default: float
    prompt: str = "Rate the text on {dims} from {low} to {high}; answer with numbers and commas only.\n\n{text}"

    def filled(self, text):
        """The prompt as a column for a text column."""
        head, tail = self.prompt.format(dims=", ".join(self.dims), low=self.scale[0], high=self.scale[1], text="\x00").split("\x00")
        return F.concat(F.lit(head), text, F.lit(tail))


LENSES = {
    "good_faith": Lens("good_faith", ("sincerity", "charity"), (1, 7), 4),
    "excitement_directedness": Lens("excitement_directedness", ("excitement", "directedness"), (0, 10), 5),
}


@dataclass
class Raters:
    """Back-ends by name: functions from a list of prompts to a list of answers."""

    known: dict[str, Callable[[list[str]], list[str]]] = field(default_factory=dict)

    def rate(self, df: DataFrame, lens: Lens, backend: str, text: str = "text", threads: int = 8, tasks: int = 8) -> DataFrame:
        """df with `answer` and `error`: tasks call the back-end with several threads, in order; short texts are not sent."""
        call = self.known[backend]
        names = df.columns
        src = df.withColumn("_prompt", F.when(~too_short(F.col(text)), lens.filled(F.col(text)))).repartition(tasks)

        def run(batches):
            from concurrent.futures import ThreadPoolExecutor

            import pyarrow as pa

            def one(p):
                if p is None:
                    return None, "text too short"
                try:
                    return call([p])[0], None
                except Exception as e:  # a failed call leaves the defaults and says why
                    return None, str(e)[:200]

            with ThreadPoolExecutor(threads) as pool:
                for b in batches:
                    got = list(pool.map(one, b.column(len(names)).to_pylist()))
                    yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([a for a, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())], names=[*names, "answer", "error"])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        return src.mapInArrow(run, f"{kinds}, answer string, error string")


def scored(ratings: DataFrame, dims: list[str], out: str = "score") -> DataFrame:
    return ratings.withColumn(out, composite(F.array(*[F.col(d).cast("double") for d in dims])))


def rating_summary(ratings: DataFrame, dim: str) -> DataFrame:
    return ratings.groupBy(F.col(dim).alias("value")).agg(F.count("*").alias("n"))


def moments(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(pos, mean, std) by position; a spread of 0 counts as 1."""
    e = vectors.select(F.posexplode(column).alias("pos", "v"))
    return e.groupBy("pos").agg(F.avg(F.col("v").cast("double")).alias("mean"), F.stddev_pop(F.col("v").cast("double")).alias("std")).withColumn("std", F.when(F.col("std") > 0, F.col("std")).otherwise(1.0))


def fit(rows: DataFrame, dims: list[str], ridge: float = 1e-6, column: str = "embedding") -> dict:
    """Standardised least squares of each rating on the vectors: weights d by k, intercept, and both scalers.

    Sums of products are made in the tasks (d * d numbers each), so the rows never reach the driver.
    """
    import numpy as np

    src = rows.select(F.col(column).cast("array<double>"), *[F.col(d).cast("double") for d in dims]).dropna()

    def run(batches):
        import pyarrow as pa

        total = None
        for b in batches:
            if b.num_rows:
                z = np.column_stack([np.ones(b.num_rows), np.array(b.column(0).to_pylist()), *[b.column(1 + i).to_numpy() for i in range(len(dims))]])
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.shape[0]], pa.int32()), pa.array([total.ravel().tolist()])], names=["m", "s"])

    parts = src.mapInArrow(run, "m int, s array<double>")
    summed = parts.select("m", F.posexplode("s")).groupBy("m", "pos").agg(F.sum("col").alias("v")).collect()
    m = summed[0][0]
    s = np.zeros(m * m)
    for _, i, v in summed:
        s[i] = v
    s = s.reshape(m, m)
    n, mean = s[0, 0], s[0] / s[0, 0]
    cov = s / n - np.outer(mean, mean)
    std = np.sqrt(np.maximum(np.diag(cov), 0))
    std = np.where(std > 1e-12, std, 1)
    corr = cov / np.outer(std, std)
    x, y = slice(1, m - len(dims)), slice(m - len(dims), m)
    w = np.linalg.solve(corr[x, x] + ridge * np.eye(m - 1 - len(dims)), corr[x, y])
    return {"weights": w, "intercept": np.zeros(len(dims)), "x_mean": mean[x], "x_std": std[x], "y_mean": mean[y], "y_std": std[y], "dims": dims}


def project(vectors: DataFrame, model: dict, column: str = "embedding") -> DataFrame:
    """vectors with one column a dimension, in standardised units; a sum in the JVM for each."""
    out = {}
    for k, dim in enumerate(model["dims"]):
        w = model["weights"][:, k] / model["x_std"]
        shift = float(model["intercept"][k] - (model["x_mean"] * w).sum())
        out[dim] = dot(F.col(column).cast("array<double>"), F.array(*[F.lit(float(x)) for x in w])) + F.lit(shift)
    return vectors.withColumns(out)


def save(spark, model: dict, path: str) -> None:
    spark.createDataFrame([(k, [float(x) for x in model[k].ravel()] if k != "dims" else None, list(model["dims"])) for k in model], "name string, values array<double>, dims array<string>").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark, path: str) -> dict:
    import numpy as np

    rows = {r[0]: (r[1], r[2]) for r in spark.read.parquet(path).collect()}
    dims = rows["dims"][1]
    out = {k: np.array(v[0]) for k, v in rows.items() if k != "dims"}
    return out | {"weights": out["weights"].reshape(-1, len(dims)), "dims": dims}


def principal(vectors: DataFrame, k: int = 2, column: str = "embedding") -> dict:
    """Leading axes of the vectors from their summed products; each axis's largest component is positive."""
    import numpy as np

    model = fit(vectors.withColumn("_y", F.lit(0.0)), ["_y"], column=column)
    src = vectors.select(F.col(column).cast("array<double>")).dropna()

    def run(batches):
        import pyarrow as pa

        total = None
        for b in batches:
            if b.num_rows:
                z = np.array(b.column(0).to_pylist()) - model["x_mean"]
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()])], names=["s"])

    d = len(model["x_mean"])
    s = np.zeros(d * d)
    for i, v in src.mapInArrow(run, "s array<double>").select(F.posexplode("s")).groupBy("pos").agg(F.sum("col")).collect():
        s[i] = v
    values, axes = np.linalg.eigh(s.reshape(d, d))
    axes = axes[:, ::-1][:, :k]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(k)])
    return {"weights": axes, "intercept": np.zeros(k), "x_mean": model["x_mean"], "x_std": np.ones(d), "y_mean": np.zeros(k), "y_std": np.ones(k), "dims": ["x", "y", "z"][:k]}


def hashed(texts: DataFrame, dims: int = 256, text: str = "text") -> DataFrame:
    """texts with `embedding`: word counts by hashed slot, of unit length, where no sentence encoder is at hand."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\W+"), lambda w: w != "")
    slots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dims)).cast("int"))
    # sorted with one mark for each slot, a slot's count is the step between marks: no pass over the words for each slot
    marked = F.array_sort(F.concat(slots, F.sequence(F.lit(0), F.lit(dims))))
    marks = F.filter(F.transform(marked, lambda v, i: F.when((i == 0) | (F.get(marked, i - 1) != v), i)), lambda i: i.isNotNull())
    base = texts.withColumn("_m", marks)
    v = base.withColumn("embedding", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: (F.get("_m", i + 1) - F.get("_m", i) - 1).cast("double")))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    return v.withColumn("embedding", F.when(norm > 0, F.transform("embedding", lambda x: x / norm)).otherwise(F.col("embedding"))).drop("_m")
