"""A quality classifier by compression with dictionaries of good and of bad text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, few_rows, settle

#: Labelled rows of each class that are learned from (every other one goes to the dictionary, the rest calibrate), and
#: parts of all texts of a class that its dictionary is trained on, picked by hash.
SAMPLE_DOCS, DICTIONARY_PARTS = 3000, 4000
#: Bytes of a dictionary, and of the parts in which whole texts are compressed.
DICTIONARY_BYTES, PART_BYTES, LEVEL = 1 << 16, 1 << 12, 3


@dataclass
class Model:
    good: bytes
    bad: bytes
    coef: np.ndarray
    mean: np.ndarray
    scale: np.ndarray


class Sizer:
    """Compressed sizes of whole texts under each dictionary and under none."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard as zstd

        def coder(d: bytes):
            if not d:
                return zstd.ZstdCompressor(level=LEVEL)
            known = zstd.ZstdCompressionDict(d, dict_type=zstd.DICT_TYPE_AUTO)
            known.precompute_compress(level=LEVEL)
            return zstd.ZstdCompressor(level=LEVEL, dict_data=known, write_dict_id=False, write_content_size=False)

        self.coders = [coder(good), coder(bad), coder(b"")]

    def features(self, text: bytes | None) -> list[float]:
        """Normalised size difference, sizes per byte, and log length; parts keep a long text from teaching the coder itself."""
        text = text or b""
        if not text:
            return [0.0, 1.0, 1.0, 0.0]
        parts = split(text)
        g, b, n = (sum(len(c.compress(p)) for p in parts) for c in self.coders)
        return [(b - g) / (b + g), g / n, n / len(text), np.log1p(len(text))]


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.3, rounds: int = 50) -> np.ndarray:
    """Weighted logistic regression by Newton's method; the first column is the constant."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (w * (y - p)) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def split(text: bytes) -> list[bytes]:
    return [text[i : i + PART_BYTES] for i in range(0, len(text), PART_BYTES)]


def dictionary(parts: list[bytes]) -> bytes:
    """A dictionary of the parts: trained where the library can, else as many whole parts as it holds, in their order."""
    import zstandard as zstd

    try:
        return zstd.train_dictionary(DICTIONARY_BYTES, parts, level=LEVEL).as_bytes()
    except (zstd.ZstdError, ValueError):  # too few or too short samples
        return b"".join(p for p, n in zip(parts, np.cumsum([len(p) for p in parts])) if n <= DICTIONARY_BYTES)


def sampled_parts(texts: DataFrame, quality: int) -> list[bytes]:
    """Parts of the whole texts of a class: those of the DICTIONARY_PARTS least hashes."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                parts = split(t)
                mark = [xxhash.xxh3_64_intdigest(b"%d %d" % (doc, k)) >> 1 for k in range(len(parts))]
                yield pa.RecordBatch.from_arrays([pa.array(mark, pa.int64()), pa.array(parts, pa.binary())], names=["mark", "part"])

    got = texts.filter((F.col("quality") == quality) & (F.col("role") == 0)).select("doc_id", "text").mapInArrow(run, "mark long, part binary")
    return [bytes(r[1]) for r in got.orderBy("mark", "part").limit(DICTIONARY_PARTS).collect()]


def measured(texts: DataFrame, good: bytes, bad: bytes) -> np.ndarray:
    """Rows (doc_id, quality, role, features) of the sampled texts, measured whole on the executors."""
    shared = texts.sparkSession.sparkContext.broadcast((good, bad))

    def run(batches: Iterator[pa.RecordBatch]):
        sizer = Sizer(*shared.value)
        for b in batches:
            f = [sizer.features(t) for t in b.column(3).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(f, pa.list_(pa.float64()))], names=["doc_id", "quality", "role", "f"])

    got = texts.select("doc_id", "quality", "role", "text").mapInArrow(run, "doc_id long, quality int, role int, f array<double>").orderBy("doc_id").collect()
    return np.array([[*r[:3], *r[3]] for r in got], float)


def _design(f: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Constant and features on one scale; the size difference carries the score, the other three calibrate it."""
    return np.column_stack((np.ones(len(f)), (f - mean) / scale))


def learn(docs: DataFrame, labels: DataFrame, held_out=lambda c: crc_mod(c, 4) == 2) -> Model:
    """Dictionaries and calibration from a bounded sample of labelled rows that are not held out, picked by a hash of the id.

    The sample has SAMPLE_DOCS rows of each class; of these the whole texts count. The driver sees DICTIONARY_PARTS
    parts of PART_BYTES of each class, and four numbers a row. Rows with a null id, label or text teach nothing; of rows
    that share an id the least text counts. If a class has no row, every score is the other class's share.
    """
    spark = docs.sparkSession
    few_rows(spark)
    known = labels.filter("doc_id is not null and quality is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    roles = []
    for q in (0, 1):
        ids = known.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id", F.lit(8)), "doc_id").select("doc_id").limit(SAMPLE_DOCS).collect()
        roles += [(r[0], q, k % 2) for k, r in enumerate(ids)]
    wanted = F.broadcast(spark.createDataFrame(roles, "doc_id long, quality int, role int"))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("text is not null").join(wanted, "doc_id")
    texts = settle(texts.groupBy("doc_id", "quality", "role").agg(F.min("text").alias("text")), "labelled")
    good, bad = (dictionary(sampled_parts(texts, q)) for q in (1, 0))
    got = measured(texts, good, bad)
    of = {q: got[got[:, 1] == q] if len(got) else got for q in (0, 1)}
    if not len(of[0]) or not len(of[1]):
        flat = 4.0 if len(of[1]) else -4.0 if len(of[0]) else 0.0
        return Model(b"", b"", np.array([flat] + [0.0] * 4), np.zeros(4), np.ones(4))
    rest = np.concatenate([x[x[:, 2] == 1] if (x[:, 2] == 1).any() else x for x in of.values()])
    f, y = rest[:, 3:], rest[:, 1]
    # the classes count by their share among all labels that may be learned from
    n = dict(known.groupBy("quality").count().collect())
    w = np.where(y == 1, n.get(1, 1) / max(y.sum(), 1), n.get(0, 1) / max((1 - y).sum(), 1))
    mean, scale = f.mean(0), np.maximum(f.std(0), 1e-9)
    return Model(good, bad, logistic(_design(f, mean, scale), y, w * len(y) / w.sum()), mean, scale)


def score(docs: DataFrame, model: Model, least: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) of every whole text; null and empty texts get the score of no evidence, 0.

    Equal texts score alike; ids may be null or repeated; an empty table gives no rows.
    """
    few_rows(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        m = shared.value
        sizer = Sizer(m.good, m.bad)
        for b in batches:
            ts = b.column(1).cast(pa.binary()).to_pylist()
            if not ts:
                continue
            f = np.array([sizer.features(t) for t in ts])
            p = 1 / (1 + np.exp(-np.clip(_design(f, m.mean, m.scale) @ m.coef, -35, 35)))
            p = np.where([not t or not t.strip() for t in ts], 0.0, p)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= least).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, predicted int")
