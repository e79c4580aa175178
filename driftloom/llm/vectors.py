"""Near-duplicate vectors by an exact metric range join over pivot cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, settle, small

#: Vectors aimed at in a block (a cell or part of one), and the most pivots.
BLOCK, MOST_PIVOTS = 4096, 1024
#: Rows of the streamed side compared at a time.
CHUNK = 2048
#: Pivots at most this far apart are one.
TWINS = 1e-6


def units(vectors: DataFrame) -> DataFrame:
    """(vec_id, ok, v): v is the vector's doubles as bytes; ok says that it can link (no null, not zero, all finite)."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            ok, out = [], []
            for x in b.column(1).to_pylist():
                v = np.array(x, np.float64) if x and None not in x else np.zeros(0)
                with np.errstate(over="ignore", invalid="ignore"):
                    top = np.abs(v).max() if len(v) else 0.0
                ok.append(bool(np.isfinite(top) and top > 0))
                out.append(v.tobytes() if ok[-1] else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ok, pa.bool_()), pa.array(out, pa.binary())], names=["vec_id", "ok", "v"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, ok boolean, v binary")


def unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # very large and very small components keep their direction
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def apart(p: np.ndarray) -> np.ndarray:
    """Distances between pivots, from differences: 2 - 2 * cos would lose small ones."""
    return np.stack([np.sqrt(np.einsum("ij,ij->i", p - x, p - x)) for x in p])


def distinct(p: np.ndarray) -> np.ndarray:
    """The pivots without those within TWINS of an earlier one, whose cells only rounding would tell apart."""
    near = np.triu(apart(p) <= TWINS, 1)
    kept = np.ones(len(p), bool)
    for i in range(len(p)):
        if kept[i]:
            kept &= ~near[i]
    return p[kept]


def assigned(texts: DataFrame, pivots: dict[int, np.ndarray], radius: float, parts: dict[tuple[int, int], int] | None) -> DataFrame:
    """The nearest pivot's cell of each vector; with parts, also each block that it must meet.

    A vector y within `radius` of x lies in cell j only if x is no farther than `radius` from that cell's half-space
    against x's own cell: by the triangle inequality in the plane of x and both pivots this distance is
    (d(x, pj)^2 - d(x, pi)^2) / 2 d(pi, pj), and at most d(x, pj) - radius(cell). A pair of cells meets in the one
    that comes later, so each pair of vectors is compared once. The bound is tested without dividing by d(pi, pj), with
    the rounding of both squared distances, of both vectors, on top: near-equal pivots then reach each other.
    """
    shared = texts.sparkSession.sparkContext.broadcast((pivots, parts))
    fields = ["dim", "cell", "part", "own", "rep", "n", "v"]

    def run(batches: Iterator[pa.RecordBatch]):
        piv, parts_ = shared.value
        gaps = {dim: apart(p) for dim, p in piv.items()} if parts_ is not None else {}
        for b in batches:
            raw, rep, n, mark = b.column("v").to_pylist(), b.column("rep").to_numpy(), b.column("n").to_numpy(), b.column("mark").to_numpy()
            rows = []
            for dim in sorted({len(r) // 8 for r in raw}):
                at = [i for i, r in enumerate(raw) if len(r) // 8 == dim]
                p = piv[dim]
                x = unit([raw[i] for i in at])
                d2 = np.maximum(2 - 2 * (x @ p.T), 0)
                near = d2.argmin(1)
                if parts_ is None:
                    rows += [(dim, int(c), 0, True, int(rep[i]), int(n[i]), b"") for i, c in zip(at, near)]
                    continue
                slack = 8 * (dim + 16) * np.finfo(float).eps
                reach = d2 - d2[np.arange(len(at)), near][:, None] <= 2 * gaps[dim][near] * np.sqrt(radius**2 + slack) + slack
                for row, i in enumerate(at):
                    c = int(near[row])
                    k = int(mark[i]) % parts_.get((dim, c), 1)
                    for to in np.flatnonzero(reach[row, : c + 1]).tolist():
                        last = k if to == c else parts_.get((dim, to), 1) - 1
                        for part in range(last + 1):
                            rows.append((dim, to, part, to == c and part == k, int(rep[i]), int(n[i]), raw[i]))
                        if len(rows) >= 5000:
                            yield _rows(rows, fields)
                            rows = []
            if rows:
                yield _rows(rows, fields)

    return texts.mapInArrow(run, "dim int, cell int, part int, own boolean, rep long, n long, v binary")


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def compared(entries: DataFrame, least: float) -> DataFrame:
    """From blocks sorted with their own vectors first: (a, null, links) and a spanning set of links (a, b, 0).

    A block's own vectors are held (at most a few thousand); the others stream by.
    """
    tell = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    class Block:
        def __init__(self):
            self.raw, self.rep, self.n = [], [], []
            self.x = None

        def close(self):
            self.x, self.ids, self.n = unit(self.raw), np.array(self.rep), np.array(self.n)
            self.links = np.zeros(len(self.ids), np.int64)
            self.raw = None
            for lo in range(0, len(self.ids), CHUNK):
                hit = self.x[lo : lo + CHUNK] @ self.x.T >= least
                hit[np.arange(len(hit)), lo + np.arange(len(hit))] = False
                self.links[lo : lo + CHUNK] += hit @ self.n
                a, b = span(hit)
                if len(a):
                    a += lo
                    yield pa.RecordBatch.from_arrays([pa.array(self.ids[a]), pa.array(self.ids[b]), pa.array(np.zeros(len(a), np.int64))], schema=tell)

        def meet(self, raw, rep, n):
            y = unit(raw)
            hit = y @ self.x.T >= least
            got = hit @ self.n
            self.links += np.array(n) @ hit
            r = np.flatnonzero(got)
            if len(r):
                rep = np.array(rep)[r]
                h = hit[r]
                x, y_ = span(h)
                a, b = rep[x], self.ids[y_]
                links = pa.array(np.concatenate((got[r], np.zeros(len(a), np.int64))))
                whole_b = pa.array(np.concatenate((np.zeros(len(r), np.int64), b)), mask=np.arange(len(r) + len(a)) < len(r))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((rep, a))), whole_b, links], schema=tell)

        def end(self):
            r = np.flatnonzero(self.links)
            if len(r):
                yield pa.RecordBatch.from_arrays([pa.array(self.ids[r]), pa.nulls(len(r), pa.int64()), pa.array(self.links[r])], schema=tell)

    def run(batches):
        key, block, wait = None, None, ([], [], [])

        def flush():
            if wait[0]:
                yield from block.meet(*wait)
                for w in wait:
                    w.clear()

        def finish():
            if block is not None and block.rep:
                if block.x is None:
                    yield from block.close()
                yield from flush()
                yield from block.end()

        for b in batches:
            for dim, cell, part, own, rep, n, v in zip(*(b.column(i).to_pylist() for i in range(7))):
                if (dim, cell, part) != key:
                    yield from finish()
                    key, block = (dim, cell, part), Block()
                if own:
                    block.raw.append(v), block.rep.append(rep), block.n.append(n)
                    continue
                if block.x is None:
                    if not block.rep:  # a cell part without own vectors
                        continue
                    yield from block.close()
                wait[0].append(v), wait[1].append(rep), wait[2].append(n)
                if len(wait[0]) >= CHUNK:
                    yield from flush()
        yield from finish()

    return entries.mapInArrow(run, "a long, b long, links long")


def span(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, column) that join all that the true entries of hit join, one or two for each row and column.

    Labels spread over rows and columns until each set has one; every row and column then links towards where its
    label came from.
    """
    r, c = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
    if not len(r):
        return r, c
    h = hit[np.ix_(r, c)]
    label = np.arange(len(r))
    a, b = [], []
    while True:
        down = np.where(h, label[:, None], len(r)).min(0)  # of each column: the least row label
        by = np.where(h, label[:, None], len(r)).argmin(0)
        a.append(by), b.append(np.arange(len(c)))
        new = np.where(h, down[None, :], len(r)).min(1)
        a.append(np.arange(len(r))), b.append(np.where(h, down[None, :], len(r)).argmin(1))
        if (new == label).all():
            break
        label = new
    pairs = np.unique(np.stack((np.concatenate(a), np.concatenate(b))), axis=1)
    return r[pairs[0]], c[pairs[1]]


def link(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors(vec_id, embedding).

    Two vectors are linked if their cosine, in double precision, is at least `least`: on unit vectors a range join at
    distance sqrt(2 - 2 * least). Equal vectors are compared as one and counted as many. Pivots (one for each BLOCK
    vectors, MOST_PIVOTS at most, picked by hash) divide the rest; large cells are dealt into parts by hash, so a hot
    cell is many tasks. Where data fill all directions, cells reach one another and the join nears all pairs of
    blocks; no pair is lost either way.

    Vectors that are null, empty or zero, or hold a null or a non-finite component, link with nothing; vectors of
    different length don't link. A null id takes part under a hash of its vector. Rows that share an id count as other rows
    for n_links. An empty table gives no rows.
    """
    radius = float(np.sqrt(2 - 2 * least))
    rows = settle(units(vectors).withColumn("sid", F.coalesce("vec_id", F.xxhash64("v"))), "units")
    live = rows.filter("ok")
    texts = settle(live.groupBy("v").agg(F.min("sid").alias("rep"), F.count("*").alias("n")).withColumn("mark", F.shiftrightunsigned(F.xxhash64("v"), 8)), "vectors")
    dims = {r[0]: r[1] for r in texts.groupBy((F.length("v") / 8).cast("int").alias("dim")).count().collect()}
    pivots = {}
    for dim, n in dims.items():
        k = int(min(max(-(-n // BLOCK), 1), MOST_PIVOTS))
        pivots[dim] = distinct(unit([bytes(r[0]) for r in texts.filter(F.length("v") == 8 * dim).orderBy("mark", "v").limit(k).select("v").collect()]))
    cells = assigned(texts, pivots, radius, None).groupBy("dim", "cell").count().collect()
    parts = {(r[0], r[1]): -(-r[2] // BLOCK) for r in cells}
    entries = assigned(texts, pivots, radius, parts)
    entries = entries.repartition("dim", "cell", "part").sortWithinPartitions("dim", "cell", "part", F.desc("own"), "rep")
    found = settle(compared(entries, least), "vector-links")
    links = found.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    whole = components(found.filter("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    known = texts.select(F.col("v").alias("_v"), "rep", "n").join(links, "rep", "left").join(whole, "rep", "left")
    out = rows.join(known, F.col("v") == F.col("_v"), "left")
    out = out.withColumn("component_id", F.coalesce("component", "rep", "sid"))
    n = F.when(F.col("ok"), F.col("n") - 1 + F.coalesce("links", F.lit(0))).otherwise(F.lit(0))
    return out.select("vec_id", n.cast("long").alias("n_links"), "component_id", (F.col("sid") == F.col("component_id")).alias("kept"))
