"""Exact removal of repeated word passages behind a count-min prefilter."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scan
from .common import aside, buckets_for, few_rows, forget, restored, runs, text_bytes, tidy, words

#: Bits of a sketch row's width at least and at most (2 rows of 2**28 one-bit results: 64 MB broadcast, whatever the corpus).
LEAST_BITS, MOST_BITS, ROWS = 16, 28, 2
#: Shards of each row while the partial sketches are merged.
SHARDS = 64
#: Windows that a task holds before it hands them on.
HELD = 1_000_000


def rolled(h: np.ndarray, n: int, base: int) -> np.ndarray:
    """A polynomial hash of every n consecutive values, by doubling: log2(n) passes."""
    with np.errstate(over="ignore"):
        size, power = 1, np.uint64(base)
        spans = [(1, h, power)]
        while size * 2 <= n:
            _, x, p = spans[-1]
            spans.append((size * 2, x[: len(x) - size] * p + x[size:], p * p))
            size *= 2
        out, done = None, 0
        for size, x, p in reversed(spans):
            if done + size <= n:
                m = max(len(h) - (done + size) + 1, 0)
                out = x[:m] if out is None else out[:m] * p + x[done : done + m]
                done += size
        out = out ^ (out >> np.uint64(29))
        return out * np.uint64(0xBF58476D1CE4E5B9) ^ (out >> np.uint64(32))


def windows(buf: np.ndarray, edge: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first hash, second hash, document's index, position) of every window that lies within one text of buf."""
    start, end, lens = scan.words(buf, edge)
    if len(start) < n:
        e = np.zeros(0, np.uint64)
        return e, e, np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = scan.hashes(buf, start, end)
    a, b = rolled(h[0], n, 0x9E3779B97F4A7C15), rolled(h[1], n, 0xD1B54A32D192ED03)
    many = np.maximum(lens - n + 1, 0)
    doc = np.repeat(np.arange(len(lens)), many)
    pos = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    at = np.repeat(np.cumsum(lens) - lens, many) + pos
    return a[at], b[at], doc, pos


def packed(sorted_cells: np.ndarray) -> bytes:
    """Gaps of increasing numbers, one byte for each 254 or less and one more for each 255 in them."""
    gaps = np.diff(sorted_cells.astype(np.int32), prepend=np.int32(0))
    q = gaps // 255
    out = np.full(int(q.sum()) + len(gaps), 255, np.uint8)
    out[np.cumsum(q + 1) - 1] = gaps % 255
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    return np.cumsum(raw.astype(np.int64))[raw != 255]


def cells(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.uint32)


def sketch(docs: DataFrame, n: int, bits: int) -> list[tuple[int, int, bytes]]:
    """(row, shard, compressed bits): which cells of each row of the merged count-min sketch count two or more.

    Each task counts its own windows in a sparse sketch (0, 1, or 2 and more), which takes about a byte a window; the
    shards are merged on the executors, and only one bit a cell goes on.
    """
    each = (1 << bits) // SHARDS

    def partial(batches):
        forget()
        held, total = [], 0

        def out():
            rows, shards, ones, manys = [], [], [], []
            for row in range(ROWS):
                c = np.sort(np.concatenate([h[row] for h in held]))
                at = runs(c)
                many = np.diff(np.append(at, len(c))) > 1
                u = c[at]
                cut = np.searchsorted(u, np.arange(SHARDS + 1) * each)
                for s in range(SHARDS):
                    x, m = u[cut[s] : cut[s + 1]] - s * each, many[cut[s] : cut[s + 1]]
                    if len(x):
                        rows.append(row), shards.append(s), ones.append(packed(x[~m])), manys.append(packed(x[m]))
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(shards, pa.int32()), pa.array(ones, pa.binary()), pa.array(manys, pa.binary())], names=["row", "shard", "ones", "manys"])

        for _, buf, edge in scan.slices(batches, 0):
            a, b, _, _ = windows(buf, edge, n)
            if len(a):
                held.append((cells(a, bits), cells(b, bits)))
                total += len(a)
            if total > HELD:
                yield out()
                held, total = [], 0
        if held:
            yield out()
        tidy()

    def merge(batches):
        """One shard's counts at a time, however many tasks sent a part of it."""
        key, count = None, None

        def done():
            bits_ = zstandard.compress(np.packbits(count > 1, bitorder="little").tobytes(), 1)
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([bits_], pa.binary())], names=["row", "shard", "bits"])

        for b in batches:
            for row, shard, one, many in zip(*(b.column(i).to_pylist() for i in range(4))):
                if (row, shard) != key:
                    if key is not None:
                        yield done()
                    key, count = (row, shard), np.zeros(each, np.uint8)
                at = unpacked(one)
                count[at] = np.minimum(count[at] + 1, 2)
                count[unpacked(many)] = 2
        if key is not None:
            yield done()

    got = docs.select("text").mapInArrow(partial, "row int, shard int, ones binary, manys binary")
    merged = got.repartition("row", "shard").sortWithinPartitions("row", "shard").mapInArrow(merge, "row int, shard int, bits binary")
    return [(r[0], r[1], bytes(r[2])) for r in merged.collect()]


def opened(shared: Broadcast, bits: int) -> np.ndarray:
    """The sketch's bits, unpacked for one task.

    Neither they nor the broadcast's compressed bits stay with the worker: idle ones, of which an executor may have
    several, would hold up to 64 MB each and as much again.
    """
    each = (1 << bits) // SHARDS // 8
    b = np.zeros((ROWS, each * SHARDS), np.uint8)
    for row, s, data in shared.value:
        b[row, s * each : (s + 1) * each] = np.frombuffer(zstandard.decompress(data), np.uint8)
    if getattr(shared, "_path", None):  # the next task reads it from there again
        shared.__dict__.pop("_value", None)
    return b


def _hit(b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (b[c >> 3] >> (c & 7).astype(np.uint8)) & 1 == 1


def marks(docs: DataFrame, n: int, bits: int, parts: list[tuple[int, int, bytes]], buckets: int) -> DataFrame:
    """(doc_id, row_key, at): starts of windows that occur elsewhere, as packed positions, one row a document.

    Windows that the sketch counts once are unique for certain. Of the others, a task finds the repeats among its own
    rows itself and sends each distinct window once, with the place of a window that it saw once; buckets of hashes
    (96 bits) then tell which windows other tasks hold too. So a window's group has one entry a task, not one a copy.
    """
    shared = docs.sparkSession.sparkContext.broadcast(parts)

    def local(batches):
        forget()
        held, total = [], 0
        sketch_ = opened(shared, bits)

        def out():
            a, b, doc, key, pos = (np.concatenate([h[k] for h in held]) for k in range(5))
            null = np.concatenate([h[5] for h in held])
            order = np.lexsort((b, a))
            sa, sb = a[order], b[order]
            first = np.ones(len(sa), bool)
            first[1:] = (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])
            at = np.flatnonzero(first)
            size = np.diff(np.append(at, len(sa)))
            one, many = order[at[size == 1]], order[at[size > 1]]
            own = order[np.repeat(size > 1, size)]  # repeats within this task
            here = _places(doc, key, null, pos, own, buckets)
            if here:
                yield _batch(here)
            for chosen, kind in ((one, 1), (many, 2)):
                to = (a[chosen] >> np.uint64(40)).astype(np.int64) * buckets >> 24
                cut = np.searchsorted(to, np.arange(buckets + 1))  # chosen is in hash order
                rows = []
                for k in np.flatnonzero(np.diff(cut)):
                    x = chosen[cut[k] : cut[k + 1]]
                    parts_ = [a[x].astype("<u8").tobytes(), b[x].astype("<u4").tobytes()]
                    if kind == 1:
                        parts_ += [doc[x].astype("<i8").tobytes(), key[x].astype("<i8").tobytes(), pos[x].astype("<u4").tobytes(), null[x].astype(np.uint8).tobytes()]
                    rows.append((int(k), kind, zstandard.compress(b"".join(parts_), 1)))
                if rows:
                    yield _batch(rows)

        for s, buf, edge in scan.slices(batches, 2):
            a, b, d, p = windows(buf, edge, n)
            if not len(a):
                continue
            hit = _hit(sketch_[0], cells(a, bits)) & _hit(sketch_[1], cells(b, bits))
            a, b, d, p = a[hit], (b[hit] & np.uint64(0xFFFFFFFF)), d[hit], p[hit]
            ids, keys = s.column(0), s.column(1).to_numpy()
            null = np.array(ids.is_null().to_numpy(zero_copy_only=False))
            held.append((a, b, ids.fill_null(0).to_numpy()[d], keys[d], p, null[d]))
            total += len(a)
            if total > HELD // 4:
                yield from out()
                held, total = [], 0
        if total:
            yield from out()
        del sketch_
        tidy()

    def confirm(t: pa.Table) -> pa.Table:
        forget()
        mine, rows = [], []
        shard = t.column("bucket")[0].as_py()
        for kind, data in zip(*(t.column(c).to_pylist() for c in ("kind", "data"))):
            if kind == 0:
                rows.append((shard, 0, data))
                continue
            raw = zstandard.decompress(data)
            m = len(raw) // (12 if kind == 2 else 33)
            take = lambda lo, hi, kind_: np.frombuffer(raw[lo * m : hi * m], kind_)
            part = [take(0, 8, "<u8"), take(8, 12, "<u4"), np.full(m, kind, np.uint8)]
            part += [take(12, 20, "<i8"), take(20, 28, "<i8"), take(28, 32, "<u4"), take(32, 33, np.uint8)] if kind == 1 else [np.zeros(m, "<i8"), np.zeros(m, "<i8"), np.zeros(m, "<u4"), np.zeros(m, np.uint8)]
            mine.append(part)
        if mine:
            a, b, kind, doc, key, pos, null = (np.concatenate([x[k] for x in mine]) for k in range(7))
            order = np.lexsort((b, a))
            sa, sb = a[order], b[order]
            first = np.ones(len(sa), bool)
            first[1:] = (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])
            at = np.flatnonzero(first)
            total = np.add.reduceat(kind[order].astype(np.int64), at)
            again = order[np.repeat(total > 1, np.diff(np.append(at, len(sa)))) & (kind[order] == 1)]
            rows += _places(doc, key, null, pos, again, buckets)
        return pa.table({"shard": pa.array([r[0] for r in rows], pa.int32()), "data": pa.array([r[2] for r in rows], pa.binary())})

    sent = docs.select(F.col("doc_id").cast("long"), _row_key(), "text").mapInArrow(local, "bucket int, kind int, data binary")
    places = sent.groupBy("bucket").applyInArrow(confirm, "shard int, data binary")
    return places.groupBy("shard").applyInArrow(_merged, "doc_id long, row_key long, at binary")


def _row_key():
    return F.xxhash64("doc_id", "text").alias("row_key")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["bucket", "kind", "data"])


def _places(doc, key, null, pos, chosen, buckets: int) -> list[tuple[int, int, bytes]]:
    """Rows (shard, 0, places) for the chosen entries: a document's places go to the shard of its key, many in a row."""
    if not len(chosen):
        return []
    shard = key[chosen].astype(np.uint64) % np.uint64(buckets)
    order = np.lexsort((pos[chosen], doc[chosen], key[chosen], shard))
    o, shard = chosen[order], shard[order].astype(np.int64)
    cut = np.searchsorted(shard, np.arange(buckets + 1))
    out = []
    for k in np.flatnonzero(np.diff(cut)).tolist():
        x = o[cut[k] : cut[k + 1]]
        out.append((k, 0, zstandard.compress(doc[x].astype("<i8").tobytes() + key[x].astype("<i8").tobytes() + pos[x].astype("<u4").tobytes() + null[x].astype(np.uint8).tobytes(), 1)))
    return out


def _read_places(data: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    m = len(raw) // 21
    return [np.frombuffer(raw[lo * m : hi * m], kind) for lo, hi, kind in ((0, 8, "<i8"), (8, 16, "<i8"), (16, 20, "<u4"), (20, 21, "u1"))]


def _merged(t: pa.Table) -> pa.Table:
    """(doc_id, row_key, at): one row a document, from the places of a shard."""
    doc, key, pos, null = (np.concatenate(x) for x in zip(*map(_read_places, t.column("data").to_pylist())))
    order = np.lexsort((pos, null, doc, key))
    doc, key, pos, null = doc[order], key[order], pos[order], null[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (null[1:] != null[:-1])
    at = np.flatnonzero(first)
    packs = [packed(np.unique(pos[lo:hi])) for lo, hi in zip(at, np.append(at[1:], len(key)))]
    return pa.table({"doc_id": pa.array(doc[at], pa.int64(), mask=null[at].astype(bool)), "row_key": pa.array(key[at]), "at": pa.array(packs, pa.binary())})


def covered(n_words: int, at: bytes | None, n: int) -> np.ndarray:
    """Which words lie in a window that starts at one of the packed positions."""
    edge = np.zeros(n_words + 1, np.int64)
    p = unpacked(at or b"")
    np.add.at(edge, p, 1)
    np.add.at(edge, np.minimum(p + n, n_words), -1)
    return np.cumsum(edge[:-1]) > 0


def marked(docs: DataFrame, n: int = 35) -> DataFrame:
    """docs with `at`, the packed starts of the repeated windows of n words; every row stays."""
    few_rows(docs.sparkSession, 250)
    size = text_bytes(docs)
    bits = int(np.clip(np.ceil(np.log2(max(size / 6 * 2, 1))), LEAST_BITS, MOST_BITS))
    found = marks(docs, n, bits, sketch(docs, n, bits), buckets_for(docs.sparkSession, size, 24 << 20))
    found = found.select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"), "at")
    keyed = docs.drop("at").withColumn("row_key", _row_key())
    return keyed.join(found, (F.col("row_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id", "_key", "row_key")


def dedup(docs: DataFrame, n: int = 35) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row: words in windows that occur elsewhere are removed.

    A window is n consecutive words of one document; it is repeated if its word sequence also starts anywhere else,
    the same document included, judged on the input. kept_sha256 is of the kept words joined by one space. Texts that
    are null or empty have 0 words and the hash of the empty string; texts of under n words lose nothing. Rows equal
    in doc_id and text count as two places and lose all they share. An empty table gives no rows.
    """
    kind = "doc_id long, n_words long, n_removed long, kept_sha256 string"

    def run(batches):
        for b in batches:
            rows = []
            for doc, text, at in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()):
                ws = words(text)
                gone = 0
                if at:
                    cover = covered(len(ws), at, n)
                    gone = int(cover.sum())
                    kept = [w for w, c in zip(ws, cover.tolist()) if not c]
                else:
                    kept = ws
                joined = b" ".join(kept)
                rows.append((doc, len(ws), gone, hashlib.sha256(joined).hexdigest()))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return marked(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), n).select("doc_id", "text", "at").mapInArrow(run, kind)


def trimmed(docs: DataFrame, n: int = 35) -> DataFrame:
    """docs with n_words and n_removed; where words go, text is the kept words joined by one space. Every row stays.

    Edge cases are those of dedup(). Further columns pass through; input columns named like the new ones are replaced.
    """
    new, used = ["n_words", "n_removed"], ["doc_id", "text"]
    docs, before = aside(docs, used, new)
    docs = marked(docs, n)
    names = docs.drop("at").columns
    spot, kept_at = docs.columns.index("at"), names.index("text")

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                b = whole.slice(lo, 500)
                texts, total, gone = [], [], []
                for text, at in zip(b.column(b.schema.get_field_index("text")).cast(pa.binary()).to_pylist(), b.column(spot).to_pylist()):
                    ws = words(text)
                    cover = covered(len(ws), at, n)
                    total.append(len(ws)), gone.append(int(cover.sum()))
                    texts.append(text if not gone[-1] else b" ".join([w for w, c in zip(ws, cover.tolist()) if not c]))
                cols = [b.column(b.schema.get_field_index(c)) for c in names]
                cols[kept_at] = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*cols, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=[*names, *new])

    kind = T.StructType([*docs.drop("at").schema.fields, *(T.StructField(c, T.LongType()) for c in new)])
    return restored(docs.mapInArrow(run, kind), before, used, *new)
