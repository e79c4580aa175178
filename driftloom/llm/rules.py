"""Quality rules that vote or abstain, weighed by expectation-maximisation."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few_rows, settle, small

#: Characters that count as symbols (fixed by the contract).
SYMBOLS = "#*$%&|<>"
_BLANK = " \t\n\x0b\x0c\r"
#: The rules: name, then (value below or above which it votes bad, value from which it votes good, direction).
#: direction 1: small values are bad; -1: large values are bad; between the two bounds the rule abstains.
RULES: dict[str, tuple[float, float, int]] = {
    "mean_word": (2.0, 3.0, 1),
    "long_word": (14.0, 10.0, -1),
    "symbols_per_word": (0.1, 0.02, -1),
    "dup_line_share": (0.3, 0.05, -1),
    "repeat_share": (0.3, 0.08, -1),
    "distinct_words": (0.8, 1.3, 1),
    "upper_share": (0.5, 0.2, -1),
    "letter_share": (0.88, 0.92, 1),
    "punct_per_word": (0.45, 0.3, -1),
}
#: Distinct words of natural texts grow about as this power of their words, so their ratio tells texts of all lengths apart.
DISTINCT_POWER = 0.75
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(ws: list[bytes], n: int = 3) -> int:
    """Words that lie in an n-word window found twice or more in the text, the first one included."""
    if len(ws) <= n:
        return 0
    grams = list(zip(*(ws[k:] for k in range(n))))
    found = Counter(grams)
    if len(found) == len(grams):
        return 0
    hit = bytearray(len(ws))
    one = b"\x01" * n
    for i, g in enumerate(grams):
        if found[g] > 1:
            hit[i : i + n] = one
    return sum(hit)


def measures(text: str | None) -> tuple[list[int], list[float]]:
    """(COUNTS, values of RULES) of one whole text; null counts as empty."""
    text = text or ""
    ws = text.encode("utf-8", "surrogatepass").split()
    n = len(ws)
    chars = len(text) - sum(map(text.count, _BLANK))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    dup = len(lines) - len(set(lines))
    rep = repeated_words(ws)
    counts = [n, chars, symbols, dup, rep]
    if not n:
        return counts, [0.0] * len(RULES)
    upper = sum(1 for c in text if c.isupper()) if not text.isascii() else sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits_etc = len(text.translate(_NOT_PUNCT))
    digit = sum(map(text.count, "0123456789"))
    letters = max(chars - digits_etc - digit, 0)
    mean = chars / n
    return counts, [mean, mean, symbols / n, dup / len(lines), rep / n, len(set(ws)) / n**DISTINCT_POWER, upper / max(letters, 1), letters / chars, digits_etc / n]


class _Punct(dict):
    """Translation that deletes every character but ASCII punctuation."""

    def __missing__(self, c: int):
        self[c] = chr(c) if 33 <= c <= 126 and not chr(c).isalnum() else None
        return self[c]


_NOT_PUNCT = _Punct()


def votes(values: np.ndarray) -> np.ndarray:
    """-1 bad, 1 good, 0 abstains; one column a rule."""
    out = np.zeros(values.shape, np.int8)
    for k, (bad, good, way) in enumerate(RULES.values()):
        v = values[:, k] * way
        out[:, k] = np.where(v < bad * way, -1, np.where(v >= good * way, 1, 0))
    return out


def fit(patterns: np.ndarray, n: np.ndarray, rounds: int = 100, prior: float = 0.9) -> dict:
    """Expectation-maximisation of each rule's vote rates given the hidden class, from counted vote patterns.

    Two classes, of any share (one text's worth of `prior` keeps it from 0 and 1); rules are independent given the class. It starts from rules that are right four times in five and
    keeps every good-vote rate higher in the good class, so that the classes can't change places.
    """
    good, bad, none = (patterns == 1), (patterns == -1), (patterns == 0)
    kinds = np.stack([bad, none, good])  # vote, pattern, rule
    p = {1: np.tile([[0.05], [0.15], [0.8]], (1, patterns.shape[1])), 0: np.tile([[0.4], [0.2], [0.4]], (1, patterns.shape[1]))}
    share, w = prior, n.astype(float)
    for _ in range(rounds):
        like = {c: np.log(share if c else 1 - share) + np.einsum("vpr,vr->p", kinds, np.log(p[c])) for c in (0, 1)}
        post = 1 / (1 + np.exp(np.clip(like[0] - like[1], -700, 700)))
        new = {}
        for c, q in ((1, post), (0, 1 - post)):
            got = np.einsum("vpr,p->vr", kinds, w * q) + 1.0
            new[c] = got / got.sum(0)
        swap = (new[1][2] - new[1][0]) < (new[0][2] - new[0][0])  # such a rule carries no vote
        new[1][:, swap] = new[0][:, swap] = ((new[1] + new[0]) / 2)[:, swap]
        moved = max(np.abs(new[c] - p[c]).max() for c in (0, 1))
        p, share = new, float(((w * post).sum() + prior) / (w.sum() + 1))
        if moved < 1e-7:
            break
    return {"post": post if len(n) else np.zeros(0), "share": share, "rates": p}


def weigh(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, quality, base_failed, kept) per row of docs.

    A document fails the base if it has under 50 words or over half of them lie in repeated 3-word windows; it is kept
    if it passes and its posterior probability of good quality, given all rules' votes, is at least `least`. All texts
    are read whole and once; vote patterns (3^9 at most, whatever the corpus) are counted on the executors and the
    fit sees only those counts. Null and empty texts have counts 0 and fail; null ids stay; an empty table gives no rows.
    """
    few_rows(docs.sparkSession)
    fields = [pa.field("doc_id", pa.int64()), *[pa.field(c, pa.int64()) for c in COUNTS], pa.field("pattern", pa.int32())]

    def run(batches):
        for b in batches:
            got = [measures(t) for t in b.column(1).to_pylist()]
            if not got:
                continue
            v = votes(np.array([x[1] for x in got], float))
            code = ((v + 1).astype(np.int64) * 3 ** np.arange(v.shape[1])).sum(1)
            c = np.array([x[0] for x in got], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *[pa.array(c[:, k]) for k in range(c.shape[1])], pa.array(code.astype(np.int32))], schema=pa.schema(fields))

    kind = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", pattern int"
    seen = settle(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, kind), "votes")
    counted = seen.filter("n_words > 0").groupBy("pattern").count().collect()
    codes = np.array([r[0] for r in counted], np.int64)
    order = np.argsort(codes)
    codes, n = codes[order], np.array([r[1] for r in counted], np.int64)[order]
    patterns = (codes[:, None] // 3 ** np.arange(len(RULES)) % 3 - 1) if len(codes) else np.zeros((0, len(RULES)), np.int64)
    model = fit(patterns, n)
    table = docs.sparkSession.createDataFrame([(int(c), float(p)) for c, p in zip(codes, model["post"])], "pattern int, quality double")
    out = seen.join(small(table, len(codes)), "pattern", "left").withColumn("quality", F.coalesce("quality", F.lit(0.0)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("doc_id", *COUNTS, "quality", failed.alias("base_failed"), (~failed & (F.col("quality") >= least)).alias("kept"))
