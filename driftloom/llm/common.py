"""Helpers that the corpus operators share: words, shared storage, exact components."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: The largest number of rows that any operator broadcasts (two 8-byte columns: 16 MB).
BROADCAST_ROWS = 1_000_000


def words(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text; bytes.split() divides at exactly the six characters of WORD."""
    return text.split() if text else []


def shared_dir(spark: SparkSession) -> str:
    """The folder for tables that cut lineage: spark.checkpoint.dir, or one of our own in local mode only."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if where is None and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        where = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if where is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="driftloom-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


_LIVE: list[tuple[SparkSession, str]] = []


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _LIVE:
        try:
            delete(spark, path)
        except Exception:  # the session has ended before us; its folder goes with it
            return


#: Bytes that a task's Parquet writer holds.
ROW_GROUP = 32 << 20


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends here and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/driftloom-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    _LIVE.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def settle_by(df: DataFrame, tag: str, key: str, buckets: int, *order: str) -> DataFrame:
    """As settle(), with the rows of a key in one file of `buckets` at most: grouping by it later needs no shuffle.

    A file is sorted by `order`, then by the key.
    """
    spark = df.sparkSession
    name = f"driftloom_{tag}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    buckets = min(buckets, 50_000)
    out = df.repartition(buckets, key).write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP)
    out.option("path", path).format("parquet").bucketBy(buckets, key).sortBy(*order, key).saveAsTable(name)
    _LIVE.append((spark, path))
    out = spark.table(name)
    out._settled = path
    return out


def release(df: DataFrame) -> None:
    """Delete a settled table that no later plan reads."""
    spark, path = df.sparkSession, df._settled
    delete(spark, path)
    _LIVE.remove((spark, path))


def settled() -> set[str]:
    """The folders of settled tables that are still there."""
    return {path for _, path in _LIVE}


def sweep(before: set[str]) -> None:
    """Delete the tables settled since `before` was taken: for a caller that has written all that was made from them."""
    for spark, path in [x for x in _LIVE if x[1] not in before]:
        delete(spark, path)
        _LIVE.remove((spark, path))


def aside(docs: DataFrame, used: list[str], made: list[str] = []) -> tuple[DataFrame, list[str]]:
    """docs with all columns but `used` put away in one struct `rest`, where no name can clash; and the names to restore.

    Columns named in `made` are left out: the caller makes them anew.
    """
    extra = [c for c in docs.columns if c not in used and c not in made]
    rest = F.struct(*[F.col(f"`{c}`") for c in extra]) if extra else F.struct(F.lit(0).alias("none"))
    return docs.select(*used, rest.alias("rest")), [c for c in docs.columns if c not in made]


def restored(df: DataFrame, names: list[str], used: list[str], *made: str) -> DataFrame:
    """The columns `names` that aside() put away or left, in their order, and the made ones."""
    return df.select(*[F.col(c) if c in used else F.col("rest").getField(c).alias(c) for c in names], *made)


#: Rows and bytes of an Arrow batch at most: a task holds several batches at once, on both sides.
BATCH_ROWS, BATCH_BYTES = 1000, 1 << 20


def few_rows(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Small Arrow batches for this session, as whole texts are long. Plans run later, so the settings stay."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = int(spark.conf.get(key).rstrip("b"))
        if now > most or now <= 0:
            spark.conf.set(key, most)


def small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if its counted rows stay within the bound; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= most else df


def buckets_for(spark: SparkSession, size: int, each: int) -> int:
    """How many buckets of about `each` units hold `size` units, one for each shuffle partition at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each), 1)


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the decimal text of an id, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def tidy() -> None:
    """Give freed memory back to the system: Python workers live on between tasks, several to an executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


_slot: dict = {}


def held(tag: str, make):
    """A worker's one lasting object: make() for a new tag, whose predecessor is dropped first."""
    if tag not in _slot:
        _slot.clear()
        tidy()
        _slot[tag] = make()
    return _slot[tag]


def forget() -> None:
    """Drop what a worker holds. (Tasks call this by name, so it acts on the worker's own copy.)"""
    _slot.clear()
    tidy()


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of unsigned 64-bit numbers (three xor-shifts and two odd products)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9FB21C651E98DF25)
    x = x ^ (x >> np.uint64(28))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values in a sorted array."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))


def streamed_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of equal keys from batches sorted by them, one at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(b.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        change[0] = last is not None and tuple(c[0] for c in cols) != last
        cuts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo < b.num_rows and change[lo] and held:
                yield pa.Table.from_batches(held)
                held = []
            if hi > lo:
                held.append(b.slice(lo, hi - lo))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


class UnionFind:
    """Disjoint sets over 0..n-1 within one task; the smaller index leads."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _renamed(edges: DataFrame, on: str, names: DataFrame) -> DataFrame | None:
    """edges with `m`, what names(n, m) calls the node `on`, or null; None if there are no names.

    names holds only the nodes whose name differs, mostly few: they are broadcast while their count allows, so that a
    hub's edges stay where they are; beyond that edges are salted, and every name is sent to each salt.
    """
    names = settle(names, "names")
    n = names.count()
    if not n:
        release(names)
        return None
    if n <= BROADCAST_ROWS:
        return edges.join(F.broadcast(names), F.col(on) == F.col("n"), "left").drop("n")
    salts = 16
    names = names.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = edges.withColumn("_s", F.pmod(F.xxhash64("a", "b"), F.lit(salts)).cast("int"))
    return spread.join(names, (F.col(on) == F.col("n")) & (F.col("_s") == F.col("_salt")), "left").drop("n", "_s", "_salt")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over the edges (a, b), for every node with an edge to another.

    Alternating large and small stars, until every node has one smaller neighbour, which has none. Each step takes a
    minimum by node (combined before the shuffle) and joins back those that change an edge, so a hub's edges are not
    gathered. Every round is written to the shared folder; the driver sees counts.
    """
    star = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    star = settle(star, "edges")
    while True:
        # large star: (a, b) becomes (a, m), m being the least neighbour of b, if b has one under it
        heads = star.select(F.col("b").alias("_b")).distinct()
        least = star.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).join(heads, F.col("n") == F.col("_b"), "left_semi")
        moved = _renamed(star, "b", least)
        if moved is not None:
            large = settle(moved.select("a", F.coalesce("m", "b").alias("b")).distinct(), "edges")
            release(star)
            star = large
        # small star: all but the least of several neighbours under a, and a itself, are joined to that least one
        several = star.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"), F.max("b").alias("x")).filter("m < x").select("n", "m")
        joined = _renamed(star, "a", several)
        if joined is not None:
            joined = joined.withColumn("m", F.coalesce("m", "b"))
            joined = joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            small_ = settle(joined.select("e.a", "e.b").filter("a <> b").distinct(), "edges")
            release(star)
            star = small_
        elif moved is None:
            break
    return star.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        star.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
