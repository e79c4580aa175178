"""Mixing sources to target weights by hash-threshold histograms; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, aside, restored, settle, small

#: Hash bits that one histogram level resolves, and how many levels there are: 4096 buckets, then 4096 parts of one.
BITS, LEVELS = 12, 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cell() -> Column:
    """The first 36 bits of the MD5 of id and text: a hash that other engines have too."""
    digest = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), "text").cast("binary"))
    return F.conv(F.substring(digest, 1, BITS * LEVELS // 4), 16, 10).cast("long")


def ranked(df: DataFrame, by: Column) -> DataFrame:
    """df with `rank` from 0 in the order of `by`, without gathering the rows in one task.

    Range partitions are sorted one by one and shifted by the rows before them.
    """
    at = df.repartitionByRange(by).sortWithinPartitions(by).withColumn("_id", F.monotonically_increasing_id())
    at = settle(at.select("*", F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_nth")), "ranked")
    parts = at.groupBy("_part").count().withColumnRenamed("count", "_n")
    before = parts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    return at.join(F.broadcast(before), "_part").withColumn("rank", F.col("_before") + F.col("_nth")).drop("_id", "_part", "_nth", "_before", "_n")


def water_level(sources: DataFrame, budget: float, ceiling: float) -> float:
    """The level at which sum(min(ceiling * size, level * weight)) is the budget.

    Each round reshares the excess of the sources found full; a source once full stays full, so rounds end.
    The driver sees two sums a round.
    """
    level, full = 0.0, -1
    while True:
        over = F.col("source_size") * ceiling <= F.col("weight") * level
        held, weight, n = sources.agg(
            F.coalesce(F.sum(F.when(over, F.col("source_size") * ceiling)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)),
            F.count_if(over),
        ).first()
        if n == full or not weight:
            return level
        full, level = n, (budget - held) / weight


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """Every row of docs(doc_id, text, source, ...) with size, source_size, target and taken (words the mix takes).

    Sources in code-point order, null last, get `weights` in turn; targets share `share` of all sizes by weight up to
    `ceiling` times a source's size. A document is taken floor(target / source_size) times, and once more if its hash
    lies under its source's threshold. Thresholds come from histograms of words by source and hash bucket: the running
    sum finds the bucket in which the rest of the budget ends, and only that bucket is summed again at a finer grain,
    so a smaller budget takes a subset of a larger one and nothing is sorted.

    Null or empty texts have size 0; a source of size 0 has target 0. Rows equal in doc_id and text share a hash and
    are taken together; ties in the hash likewise. An empty table gives no rows. Further columns pass through; input
    columns named like an output column are replaced.
    """
    made = ["size", "source_size", "target", "taken"]
    used = ["doc_id", "text", "source"]
    docs, names = aside(docs, used, made)
    spark = docs.sparkSession
    # text is read once here and once for the result
    sized = docs.select("source", word_count(F.col("text")).alias("size"), cell().alias("cell"))
    slim = settle(sized, "sizes")
    plan = budgets(slim, weights, share, ceiling)
    out = docs.withColumns({"size": word_count(F.col("text")), "_cell": cell()})
    taken = F.col("size") * (F.col("copies") + F.when(F.col("_cell") < F.col("threshold"), 1).otherwise(0))
    return restored(_joined(out, plan, spark).withColumn("taken", taken), names, used, *made)


def _joined(rows: DataFrame, plan: DataFrame, spark) -> DataFrame:
    """rows with their source's plan: broadcast while the sources are few, else a salted join, as one may hold a third of the rows."""
    n = plan.count()
    keyed = plan.withColumnRenamed("source", "_source")
    if n <= 100_000:
        return rows.join(small(keyed, n), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    salts = 32
    spread = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = rows.withColumn("_s", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    return rows.join(spread, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_s") == F.col("_salt"))).drop("_source", "_salt", "_s")


def budgets(slim: DataFrame, weights: tuple[float, ...], share: float, ceiling: float) -> DataFrame:
    """(source, source_size, target, copies, threshold) for every source of slim(source, size, cell)."""
    spark = slim.sparkSession
    sources = ranked(slim.groupBy("source").agg(F.sum("size").alias("source_size")), F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    sources = settle(sources.withColumn("weight", F.element_at(turn, (F.col("rank") % len(weights)).cast("int") + 1)).drop("rank"), "sources")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level = water_level(sources, share * total, ceiling)
    plan = sources.withColumn("target", F.least(F.col("source_size") * F.lit(ceiling), F.col("weight") * F.lit(level)))
    plan = plan.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("left", F.col("target") - F.col("copies") * F.col("source_size")).withColumns({"threshold": F.lit(0).cast("long"), "taken_below": F.lit(0).cast("long")})
    for k in range(LEVELS):
        shift = BITS * (LEVELS - 1 - k)
        near = slim
        if k:  # only the boundary bucket of each source
            near = _joined(slim.withColumn("doc_id", F.col("cell")), plan.select("source", F.col("threshold").alias("edge"), "left"), spark)
            near = near.filter((F.col("left") > 0) & (F.shiftright("cell", shift + BITS) == F.shiftright("edge", shift + BITS)))
        bars = near.groupBy("source", F.shiftright("cell", shift).alias("bar")).agg(F.sum("size").alias("own"))
        # At most 4096 bars a source, so this window is bounded however large the source.
        bars = bars.withColumn("upto", F.sum("own").over(W.partitionBy("source").orderBy("bar")))
        keyed = plan.select(F.col("source").alias("_source"), "left", "taken_below")
        ends = bars.join(keyed, F.col("source").eqNullSafe(F.col("_source")))
        rest = F.col("left") - F.col("taken_below")
        past = ends.filter((F.col("left") > 0) & (F.col("upto") >= rest))
        edge = past.groupBy("source").agg(F.min(F.struct("bar", "own", "upto")).alias("e")).select(F.col("source").alias("_source"), "e")
        plan = plan.join(edge, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
        found = F.col("e").isNotNull()
        if k < LEVELS - 1:
            bar, below = F.col("e.bar"), F.col("e.upto") - F.col("e.own")
        else:  # the last bar is taken if that ends nearer to the target
            rest = F.col("left") - F.col("taken_below")
            whole = (F.col("e.upto") - rest) <= (rest - (F.col("e.upto") - F.col("e.own")))
            bar, below = F.col("e.bar") + F.when(whole, 1).otherwise(0), F.lit(0)
        plan = plan.withColumns({
            "threshold": F.when(found, F.shiftleft(bar, shift)).otherwise(F.col("threshold")).cast("long"),
            "taken_below": F.when(found, F.col("taken_below") + below).otherwise(F.col("taken_below")).cast("long"),
        }).drop("e")
        plan = settle(plan, "plan")
    return plan.select("source", "source_size", "target", "copies", F.col("threshold"))
