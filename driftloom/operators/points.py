"""Filters, samples, joins and time bins over posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import DAY_US, distance


def resolve_coords(df: DataFrame) -> DataFrame:
    """x and y from the columns sincerity and charity if both are there, else from x and y."""
    for a, b in (("sincerity", "charity"), ("x", "y")):
        if a in df.columns and b in df.columns:
            rest = [c for c in df.columns if c not in (a, b, "x", "y")]
            return df.select(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"), *rest)
    raise ValueError("no coordinate columns: need sincerity and charity, or x and y")


def drop_missing(df: DataFrame, *columns: str) -> DataFrame:
    """Rows without null or NaN in the columns."""
    for c in columns:
        df = df.filter(F.col(c).isNotNull() & (~F.isnan(c) if dict(df.dtypes)[c] in ("double", "float") else F.lit(True)))
    return df


def date_range(df: DataFrame, start_us: int | None = None, end_us: int | None = None) -> DataFrame:
    """Both ends inclusive; an end that is a date means its midnight."""
    if start_us is not None:
        df = df.filter(F.col("us") >= start_us)
    return df if end_us is None else df.filter(F.col("us") <= end_us)


def outlier_prune(df: DataFrame, q: float = 0.99) -> DataFrame:
    """Rows within the q-quantile of distance to the centroid, with `dist`; two one-row aggregates, broadcast."""
    c = df.agg(F.avg("x").alias("_cx"), F.avg("y").alias("_cy"))
    d = df.crossJoin(F.broadcast(c)).withColumn("dist", distance(F.col("x"), F.col("y"), F.col("_cx"), F.col("_cy"))).drop("_cx", "_cy")
    edge = d.agg(F.percentile("dist", F.lit(q)).alias("_edge"))
    return d.crossJoin(F.broadcast(edge)).filter("dist <= _edge").drop("_edge")


def sample_exact(df: DataFrame, n: int, key: str = "id", seed: int = 42) -> DataFrame:
    """n rows in the order of a hash of the key: the same rows wherever they lie; a top-n, not a full sort."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(n)


def bootstrap(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    return df.sample(withReplacement=True, fraction=fraction, seed=seed)


def split_by_hash(df: DataFrame, key: str = "id", folds: int = 5) -> DataFrame:
    """`part`: test for one fold of the ids, else train."""
    return df.withColumn("part", F.when(F.col(key) % folds == 0, "test").otherwise("train"))


def temporal_cut(df: DataFrame, weeks: int) -> DataFrame:
    """One row: t0, t1 and cut = t1 less the weeks."""
    return df.agg(F.min("us").alias("t0"), F.max("us").alias("t1")).withColumn("cut", F.col("t1") - weeks * 7 * DAY_US)


def temporal_split(df: DataFrame, weeks: int) -> DataFrame:
    return df.crossJoin(F.broadcast(temporal_cut(df, weeks).select("cut"))).withColumn("part", F.when(F.col("us") < F.col("cut"), "train").otherwise("test")).drop("cut")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with `row` from 0 in the given order, by range partitions and their counts, not in one task."""
    sorted_ = df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33)).persist()
    before = sorted_.groupBy("_part").count().withColumn("_before", F.sum("count").over(W.orderBy("_part")) - F.col("count")).drop("count")
    return sorted_.join(F.broadcast(before), "_part").withColumn("row", F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id", "_part", "_before")


def zip_strict(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Rows of both sides by key; an error if a side has a key that the other lacks."""
    a, b = left.count(), right.count()
    out = left.join(right, key)
    if not a == b == out.count():
        raise ValueError(f"sides don't match: {a} and {b} rows")
    return out


def zip_shortest(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """The k-th row of one side with the k-th of the other, as far as both go."""
    return numbered(left, left_order).join(numbered(right, right_order), "row")


def gather(vectors: DataFrame, ids: DataFrame, vec_key: str, id_key: str) -> DataFrame:
    return vectors.join(ids, vectors[vec_key] == ids[id_key])


def weekly_groups(df: DataFrame, days: int = 7) -> DataFrame:
    """`grp`: bins of so many days from the first post, empty ones dropped and the rest numbered from 0."""
    t0 = df.agg(F.min("us").alias("_t0"))
    b = df.crossJoin(F.broadcast(t0)).withColumn("_bin", F.expr(f"(us - _t0) div {days * DAY_US}")).drop("_t0")
    bins = b.select("_bin").distinct().withColumn("grp", (F.dense_rank().over(W.orderBy("_bin")) - 1).cast("long"))
    return b.join(F.broadcast(bins), "_bin").drop("_bin")


def in_intervals(df: DataFrame, intervals: DataFrame, width_us: int) -> DataFrame:
    """Rows of df with each of the intervals (start <= us < end) that holds them, overlapping or not.

    Both sides are cut into bins of width_us, so the join is on bins and the range is tested within one; an interval
    is repeated for each bin that it touches.
    """
    cut = F.explode(F.sequence(F.expr(f"floor(start / {width_us})"), F.expr(f"floor((end - 1) / {width_us})")))
    some = intervals.filter("start < end").withColumn("_bin", cut)
    held = df.withColumn("_bin", F.expr(f"floor(us / {width_us})")).join(some, "_bin")
    return held.filter("us >= start and us < end").drop("_bin", "start", "end")


def min_max(df: DataFrame, column: str, out: str = "norm") -> DataFrame:
    m = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    return df.crossJoin(F.broadcast(m)).withColumn(out, (F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).drop("_lo", "_hi")


def schema_difference(a: DataFrame, b: DataFrame) -> tuple[set[str], set[str]]:
    """(missing in a, extra in a)."""
    return set(b.columns) - set(a.columns), set(a.columns) - set(b.columns)


def compare(a: DataFrame, b: DataFrame, key: str, rtol: float = 1e-5) -> DataFrame:
    """Rows whose numbers differ by more than rtol, or that one side lacks."""
    nums = [c for c, t in a.dtypes if t in ("double", "float", "bigint", "int") and c != key and c in b.columns]
    bad = F.lit(False)
    for c in nums:
        bad = bad | ~F.coalesce(F.abs(F.col(f"l.{c}") - F.col(f"r.{c}")) <= rtol * F.greatest(F.abs(F.col(f"r.{c}")), F.lit(1e-12)), F.col(f"l.{c}").isNull() & F.col(f"r.{c}").isNull())
    return a.alias("l").join(b.alias("r"), key, "full_outer").filter(bad)


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select([c for c in df.columns if c.startswith(prefix)])


def first_match(points: DataFrame, regions: DataFrame) -> DataFrame:
    """The region of lowest id that holds a point (regions: few, broadcast only while they are few), and how many do."""
    side = F.broadcast(regions) if regions.limit(10_001).count() <= 10_000 else regions
    held = points.join(side, distance(F.col("x"), F.col("y"), F.col("cx"), F.col("cy")) <= F.col("radius"))
    return held.groupBy("id").agg(F.min("region_id").alias("region_id"), F.count("*").alias("n_regions"))


def nearest_site(points: DataFrame, sites: list[tuple[float, float]]) -> DataFrame:
    """`site` and `site_dist` of the nearest of some literal sites, the first of equals; no join."""
    d: list[Column] = [distance(F.col("x"), F.col("y"), F.lit(float(a)), F.lit(float(b))) for a, b in sites]
    best = F.array_min(F.array(*[F.struct(x.alias("d"), F.lit(i).alias("i")) for i, x in enumerate(d)]))
    return points.withColumn("_b", best).withColumns({"site": F.col("_b.i"), "site_dist": F.col("_b.d")}).drop("_b")
