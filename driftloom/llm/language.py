"""Language identification by error-correcting output codes over n-gram classifiers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, few_rows, settle

#: Hash slots of n-grams of one, two and three bytes of lower-cased text.
SLOTS = 1 << 13
#: Languages whose counts a task holds before it hands them on.
HELD = 64
_LETTER = regex.compile(r"\p{L}")


def slots(text: str) -> np.ndarray:
    """Counts of hashed n-grams of a whole text."""
    b = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace"), np.uint8)
    b = np.where((b < 65) & (b != 32) & (b != 10), 32, b).astype(np.uint32)  # digits and marks count as a space
    two = b[:-1] << 8 | b[1:]
    three = two[:-1] << 8 | b[2:]
    h = np.concatenate((b * np.uint32(2654435761), two * np.uint32(2246822519) + np.uint32(97), three * np.uint32(3266489917) + np.uint32(51)))
    return np.bincount(h >> np.uint32(19), minlength=SLOTS)


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k codewords of +1 and -1: every two-way split of up to five languages, else random ones far apart."""
    if k <= 1:
        return np.ones((k, 1), np.int8)
    if k <= 5:  # the exhaustive code: 2**(k-1) - 1 bits, any two words differ in 2**(k-2) of them
        bits = np.arange(1, 2 ** (k - 1))
        rest = (bits[None, :] >> np.arange(k - 1)[:, None]) & 1
        return np.concatenate((np.zeros((1, len(bits)), int), rest)).astype(np.int8) * 2 - 1
    rng = np.random.default_rng(seed)
    n, best, far = int(np.ceil(15 * np.log2(k))), None, -1
    for _ in range(200 if k <= 256 else 1):  # random words of so many bits lie far apart without a search
        code = np.where(rng.random((k, n)) < 0.5, -1, 1).astype(np.int8)
        code = code[:, np.abs(code.sum(0)) < k]  # a bit must split the languages
        if k > 256:
            return code
        d = (code[:, None] != code[None]).sum(2) + 10**6 * np.eye(k, dtype=int)
        if d.min() > far:
            best, far = code, d.min()
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # language, bit
    weights: np.ndarray  # slot, bit
    bias: np.ndarray  # bit
    sure: np.ndarray  # bit: how far the classes' mean margins lie apart, as a weight

    def margins(self, x: np.ndarray) -> np.ndarray:
        return (x / np.maximum(x.sum(1, keepdims=True), 1)) @ self.weights + self.bias

    def decode(self, margins: np.ndarray) -> np.ndarray:
        """Probabilities by language from the weighted logistic loss to each codeword."""
        loss = (self.sure * np.logaddexp(0, -self.code[None] * (6 * margins / self.sure)[:, None, :])).sum(2) / self.sure.sum()
        p = np.exp(-6 * (loss - loss.min(1, keepdims=True)))
        return p / p.sum(1, keepdims=True)


def counts(docs: DataFrame) -> DataFrame:
    """(lang, slot, n): n-gram counts of whole texts by language, summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]):
        sums: dict[str, np.ndarray] = {}

        def out():
            langs, v = list(sums), np.stack(list(sums.values()))
            at, slot = np.nonzero(v)
            return pa.RecordBatch.from_arrays([pa.array(langs).take(pa.array(at)), pa.array(slot), pa.array(v[at, slot])], names=["lang", "slot", "n"])

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if lang not in sums and len(sums) >= HELD:
                    yield out()
                    sums.clear()
                sums[lang] = sums.get(lang, 0) + slots(text)
        if sums:
            yield out()

    kept = docs.filter("lang is not null and text is not null").select("lang", "text")
    return kept.mapInArrow(run, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))


def learn(train: DataFrame) -> Model:
    """The model of all training rows (lang, text): for each bit, log ratios of smoothed n-gram shares of its two sides.

    Every language is learned and weighs the same. Their counts stay on the executors, which sum the shares of each
    bit's sides; the driver holds SLOTS numbers a bit, and a name, a codeword and a margin a bit of each language.
    """
    spark = train.sparkSession
    table = settle(counts(train), "grams")
    size = sorted((r[0], r[1]) for r in table.groupBy("lang").agg(F.sum("n")).collect())
    langs = [x for x, _ in size]
    code = codewords(len(langs))
    if len(langs) < 2:
        return Model(langs, code, np.zeros((SLOTS, 1)), np.ones(1), np.ones(1))
    whole = np.array([n for _, n in size]) + 0.5 * SLOTS
    bits = code.shape[1]
    side = np.stack([(code > 0) / (code > 0).sum(0), (code < 0) / (code < 0).sum(0)], 1)  # language, side, bit
    shared = spark.sparkContext.broadcast(({x: i for i, x in enumerate(langs)}, whole, side))
    few = table.coalesce(16)

    def tally(batches: Iterator[pa.RecordBatch]):
        at, whole_, side_ = shared.value
        sums = np.zeros((SLOTS, 2, bits))
        for b in batches:
            i = np.array([at[x] for x in b.column(0).to_pylist()], np.int64)
            for lo in range(0, len(i), 4096):
                k = i[lo : lo + 4096]
                np.add.at(sums, b.column(1).to_numpy()[lo : lo + 4096], (b.column(2).to_numpy()[lo : lo + 4096] / whole_[k])[:, None, None] * side_[k])
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

    shares = np.sum([np.frombuffer(r[0]).reshape(SLOTS, 2, bits) for r in few.mapInArrow(tally, "sums binary").collect()], 0)
    shares = np.round(shares + np.einsum("l,lsb->sb", 0.5 / whole, side), 12)
    w = np.log(shares[:, 0] / shares[:, 1])
    shared_w = spark.sparkContext.broadcast(w)

    def middle(batches: Iterator[pa.RecordBatch]):
        at, whole_, _ = shared.value
        w_, sums = shared_w.value, {}
        for b in batches:
            n, slot = b.column(2).to_numpy(), b.column(1).to_numpy()
            i = np.array([at[x] for x in b.column(0).to_pylist()], np.int64)
            for k in np.unique(i).tolist():
                own = np.flatnonzero(i == k)
                sums[k] = sums.get(k, 0) + (n[own] / whole_[k]) @ w_[slot[own]]
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    centre = (0.5 / whole)[:, None] * w.sum(0)  # mean margin of each language at each bit
    for k, v in few.mapInArrow(middle, "lang int, v array<double>").collect():
        centre[k] += v
    centre = np.round(centre, 10)
    high, low = np.where(code > 0, centre, np.inf).min(0), np.where(code < 0, centre, -np.inf).max(0)
    return Model(langs, code, w, -(high + low) / 2, np.maximum((high - low) / 2, 1e-3))


def tagged(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """docs with lang_pred, score and ambiguous: score is the chosen language's share after decoding.

    A text that is null or has no letter is `und` with score 0; ambiguous says that the score is under `least` or
    the language undetermined. Ties go to the language first in code-point order. Null ids and repeated rows stay;
    input columns named like the new ones are replaced.
    """
    new = ["lang_pred", "score", "ambiguous"]
    docs = docs.drop(*new)
    few_rows(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]):
        m = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                texts = b.column(at).to_pylist()
                ok = np.array([bool(t) and bool(m.languages) and _LETTER.search(t) is not None for t in texts], bool)
                pred, score = np.full(len(texts), "und", object), np.zeros(len(texts))
                if ok.any():
                    x = np.stack([slots(t) for t, k in zip(texts, ok) if k]).astype(np.float64)
                    p = m.decode(m.margins(x))
                    top = p.argmax(1)
                    pred[ok], score[ok] = np.array(m.languages, object)[top], p[np.arange(len(top)), top]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred.tolist(), pa.string()), pa.array(score), pa.array((score < least) | (pred == "und"))], names=[*names, *new])

    kind = T.StructType([*docs.schema.fields, *(T.StructField(c, t) for c, t in zip(new, (T.StringType(), T.DoubleType(), T.BooleanType())))])
    return docs.mapInArrow(run, kind)


def predict(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) of every row."""
    return tagged(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), model, least).drop("text")


def training(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from: crc32 of the id, modulo 3, is not 1."""
    return docs.filter(crc_mod(F.col("doc_id"), 3) != 1).select("lang", "text")


def identify(docs: DataFrame) -> DataFrame:
    """predict() for docs(doc_id, text, lang) after learn() from its training rows; null languages teach nothing."""
    return predict(docs, learn(training(docs)))
