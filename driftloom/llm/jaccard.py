"""Near-duplicate join by Jaccard similarity of word n-grams: a MinHash LSH forest, then exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan
from .common import aside, components, few_rows, mix, restored, settle, small, streamed_groups, tidy
from .substrings import rolled

#: Trees of the forest, levels below its roots, and the share of links to be found.
TREES, LEVELS, RECALL = 32, 3, 0.99999
#: Bits of a label that each level takes; the root takes the rest of 64.
LEVEL_BITS = 6
#: Texts in a block of one verification task; larger groups are verified block by block.
BLOCK = 512


def found_share(similarity: np.ndarray | float, depth: int, trees: int = TREES) -> np.ndarray | float:
    """How likely two texts share a prefix of `depth` MinHash values in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def root_depth(similarity: float, trees: int = TREES, recall: float = RECALL) -> int:
    """MinHash values at the root: the longest prefix that meets the target recall even if no pair is more similar than asked."""
    k = 1
    while found_share(similarity, k + 1, trees) >= recall:
        k += 1
    return k


def shingles(buf: np.ndarray, edge: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, number a text, digests): 64-bit hashes of each text's n-grams and 128 bits of its word sequence.

    A text of 1 to n-1 words has one n-gram, of all its words.
    """
    start, end, lens = scan.words(buf, edge)
    h = scan.hashes(buf, start, end)
    first = np.cumsum(lens) - lens
    digest = np.zeros((len(lens), 2), np.uint64)
    live = np.flatnonzero(lens)
    if len(live):
        with np.errstate(over="ignore"):
            turn = (np.arange(len(start)) - np.repeat(first, lens) + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for k in (0, 1):
                digest[live, k] = mix(np.add.reduceat(mix(h[k] + turn), first[live]) + lens[live].astype(np.uint64))
    many = np.where(lens >= n, lens - n + 1, np.minimum(lens, 1))
    doc = np.repeat(np.arange(len(lens)), many)
    at = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    full = lens[doc] >= n
    out = digest[doc, 0]
    if full.any():
        out[full] = rolled(h[0], n, 0x9E3779B97F4A7C15)[at[full]]
    return out, many, digest


def signatures(h: np.ndarray, many: np.ndarray, root: int, trees: int = TREES) -> np.ndarray:
    """One label a tree for each text that has n-grams: its MinHash values in order, the first `root` of them as one symbol.

    Labels compare as their sequences do, so sorting them lays out the tree's leaves, and a common prefix of labels is
    a common prefix of signatures.
    """
    live = many > 0
    starts = (np.cumsum(many) - many)[live]
    low = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    rng = np.random.default_rng(20)
    k = root + LEVELS
    odd = rng.integers(0, 1 << 31, trees * k, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    add = rng.integers(0, 1 << 32, trees * k, dtype=np.uint32)
    labels = np.zeros((int(live.sum()), trees), np.uint64)
    if not len(labels):
        return labels
    tail = np.uint64(LEVELS * LEVEL_BITS)
    with np.errstate(over="ignore"):
        for t in range(trees):
            own = np.full(len(labels), t + 1, np.uint64)
            for j in range(k):
                least = np.minimum.reduceat(low * odd[t * k + j] + add[t * k + j], starts).astype(np.uint64)
                if j < root:
                    own = mix(own * np.uint64(0x9E3779B97F4A7C15) + least)
                    if j == root - 1:
                        own = own >> tail << tail
                else:
                    own |= mix(least) >> np.uint64(64 - LEVEL_BITS) << np.uint64((root + LEVELS - 1 - j) * LEVEL_BITS)
            labels[:, t] = own
    return labels


def sketched(docs: DataFrame, n: int, root: int) -> DataFrame:
    """(doc_id, row_key, k1, k2, n_grams, labels) of every row: 128 bits of the word sequence, and a label for each tree."""

    def run(batches: Iterator[pa.RecordBatch]):
        for s, buf, edge in scan.slices(batches, 2):
            h, many, digest = shingles(buf, edge, n)
            live = many > 0
            flat = signatures(h, many, root).view(np.int64)
            digest = digest.view(np.int64)
            flat = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.where(live, TREES, 0)))).astype(np.int32)), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), pa.array(many), flat], names=["doc_id", "row_key", "k1", "k2", "n_grams", "labels"])
        tidy()

    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("row_key"), F.col("text").cast("string"))
    return keyed.mapInArrow(run, "doc_id long, row_key long, k1 long, k2 long, n_grams long, labels array<long>")


def _level(x: np.ndarray) -> np.ndarray:
    """Levels of the common prefix of two labels, from their exclusive or: 0 at the root, -1 if not even that is shared."""
    bits = LEVELS * LEVEL_BITS
    return np.select([x >> np.uint64(bits) != 0, *[x >> np.uint64(bits - LEVEL_BITS * k) != 0 for k in range(1, LEVELS + 1)]], [-1, *range(LEVELS)], LEVELS)


def trie_edges(live: DataFrame) -> DataFrame:
    """(a, b, level): edges that join, at every level, the texts that share a prefix so long in some tree.

    live(k1, labels) has each text once. Labels are sorted over the whole cluster, which lays out the tries' leaves.
    Each leaf then shares its longest prefix with its neighbour, and is joined to the first leaf under that prefix:
    one edge a leaf, and a star under each trie node. A node with very many leaves is several tasks; the seams are
    mended from the first and the last leaf of each.
    """
    leaves = live.select(F.explode("labels").alias("label"), "k1")
    leaves = leaves.select(F.col("label").bitwiseXOR(F.lit(-(1 << 63))).alias("label"), "k1")  # signed order is that of bits
    spread = leaves.repartitionByRange("label", "k1").sortWithinPartitions("label", "k1")
    tell = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("level", pa.int32()), ("label", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]):
        heads = last = first = None
        for batch in batches:
            if not batch.num_rows:
                continue
            label, node = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            if first is None:
                first = (int(batch.column(0)[0].as_py()), int(node[0]))
                heads = np.full(LEVELS + 1, node[0])
                last = (label[0], node[0])
            level = _level(label ^ np.concatenate(([last[0]], label[:-1])))
            # the first leaf under each leaf's prefix of k levels: where that prefix last changed, or the head held over
            at = np.arange(len(label))
            head = np.empty((LEVELS + 1, len(label)), np.int64)
            for k in range(LEVELS + 1):
                new = np.maximum.accumulate(np.where(level < k, at, -1))
                head[k] = np.where(new >= 0, node[new], heads[k])
            heads, last = head[:, -1].copy(), (label[-1], node[-1])
            # an edge to the head of the longest prefix that is shared with the leaf before
            hit = np.flatnonzero(level >= 0)
            to = head[level[hit], hit]
            hit, to = hit[node[hit] != to], to[node[hit] != to]
            yield pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(to), pa.array(level[hit].astype(np.int32)), pa.nulls(len(hit), pa.int64())], schema=tell)
        if first is not None:
            end = (int(np.uint64(last[0]).astype(np.int64)), int(last[1]))
            yield pa.RecordBatch.from_arrays([pa.array([first[1], end[1]]), pa.nulls(2, pa.int64()), pa.nulls(2, pa.int32()), pa.array([first[0], end[0]])], schema=tell)

    found = settle(spread.mapInArrow(run, "a long, b long, level int, label long"), "leaves")
    edges = found.filter("b is not null").select("a", "b", "level")
    seams = sorted((r[0], r[1]) for r in found.filter("b is null").select("label", "a").collect())
    mended = []
    for (x, a), (y, b) in zip(seams, seams[1:]):
        level = int(_level(np.array([(x ^ y) & ((1 << 64) - 1)], np.uint64))[0])
        if level >= 0 and a != b:
            mended.append((b, a, level))
    if mended:
        edges = edges.unionByName(live.sparkSession.createDataFrame(mended, "a long, b long, level int"))
    pair = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "level")
    return pair.groupBy("a", "b").agg(F.max("level").alias("level"))


def gathered(docs: DataFrame, n: int) -> DataFrame:
    """docs(..., text) with the text replaced by its sorted distinct n-gram hashes, 8 bytes each."""
    names = [c for c in docs.columns if c != "text"]

    def run(batches):
        for s, buf, edge in scan.slices(batches, len(names)):
            h, many, _ = shingles(buf, edge, n)
            ends = np.cumsum(many)
            sets = [np.unique(h[e - m : e]).astype("<u8").tobytes() for e, m in zip(ends.tolist(), many.tolist())]
            yield pa.RecordBatch.from_arrays([*[s.column(i) for i in range(len(names))], pa.array(sets, pa.binary())], names=[*names, "grams"])
        tidy()

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*names, "text").mapInArrow(run, f"{kinds}, grams binary")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 columns for the n-grams that two sets or more hold."""
    m = len(sets)
    all_ = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    who = np.repeat(np.arange(m), [len(s) for s in sets])
    _, col, n = np.unique(all_, return_inverse=True, return_counts=True)
    shared = n[col] > 1
    new = np.cumsum(n > 1) - 1
    col, who = new[col[shared]], who[shared]
    inter = np.zeros((m, m), np.float64)
    order = np.argsort(col, kind="stable")
    col, who = col[order], who[order]
    width = max(256, min(8192, 4_000_000 // max(m, 1)))
    total = int(col[-1]) + 1 if len(col) else 0
    for lo in range(0, total, width):
        a, b = np.searchsorted(col, (lo, lo + width))
        x = np.zeros((m, min(width, total - lo)), np.float32)
        x[who[a:b], col[a:b] - lo] = 1
        inter += x @ x.T
    return inter


def verify(nodes: DataFrame, similarity: float, root: int) -> DataFrame:
    """From (part, i, j, mine, sub, rep, n, grams): rows (a, null, links, null) summing copies linked, (a, b, 0, null) that
    span the links, and (null, null, 0, sums): the links found, and how many more a prefix of each length may have missed.

    Rows are sorted by block and text; a text repeated in a block counts once. (Both steps are one Python worker a task:
    each more that a stage needs stays on its executor, idle, for the stages after it.) Texts of one `sub` have met before. A link whose texts meet with probability p stands for 1/p, so (1 - p) / p are
    missing (the Horvitz-Thompson estimate).
    """
    tell = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64()), ("sums", pa.list_(pa.float64()))])

    def run(batches):
        for g in streamed_groups(_once(batches), ["part", "i", "j"]):
            if g.num_rows < 2:
                continue
            rep, n, mine, sub = (g.column(c).to_numpy() for c in ("rep", "n", "mine", "sub"))
            sets = [np.frombuffer(x, "<u8") for x in g.column("grams").to_pylist()]
            size = np.array([len(s) for s in sets])
            inter = overlaps(sets)
            union = size[:, None] + size[None, :] - inter
            link = (inter >= similarity * union - 1e-9) & (sub[:, None] != sub[None, :])
            i, j = g.column("i")[0].as_py(), g.column("j")[0].as_py()
            if i != j:
                link &= mine[:, None] != mine[None, :]
            hit = np.flatnonzero(link.any(1))
            if not len(hit):
                continue
            link = link[np.ix_(hit, hit)]
            alike = (inter[np.ix_(hit, hit)][link] / union[np.ix_(hit, hit)][link])
            shares = [found_share(alike, root + k) for k in range(LEVELS + 1)]
            sums = [len(alike) / 2, *[float(((1 - p) / p).sum() / 2) for p in shares]]
            label = np.arange(len(hit))
            while True:
                least = np.minimum(label, np.where(link, label[None, :], len(hit)).min(1))
                least = least[least]
                if (least == label).all():
                    break
                label = least
            far = np.flatnonzero(label != np.arange(len(hit)))
            a = np.concatenate((rep[hit], rep[hit[far]], [0]))
            m = len(a)
            b = pa.array(np.concatenate((np.zeros(len(hit), np.int64), rep[hit[label[far]]], [0])), mask=(np.arange(m) < len(hit)) | (np.arange(m) == m - 1))
            c = np.concatenate((link @ n[hit], np.zeros(len(far) + 1, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(a, mask=np.arange(m) == m - 1), b, pa.array(c), pa.array([None] * (m - 1) + [sums], pa.list_(pa.float64()))], schema=tell)
        tidy()

    return nodes.mapInArrow(run, "a long, b long, links long, sums array<double>")


def met(docs: DataFrame, nodes: DataFrame, parts: DataFrame, n: int) -> DataFrame:
    """Blocks of texts to verify, (part, i, j, mine, sub, rep, n, grams), from parts(node, component, sub): those with several subs."""
    sizes = parts.groupBy("component").agg(F.count("*").alias("size"), F.min("sub").alias("low"), F.max("sub").alias("high")).filter("low < high").select("component", "size")
    n_parts = parts.count()
    parts = parts.join(small(sizes, n_parts // 2), "component")
    chosen = nodes.join(small(parts, n_parts), F.col("k1") == F.col("node"))
    chosen = settle(chosen.select(F.col("row_key").alias("_key"), "k2", "rep", "n", F.col("component").alias("part"), "sub", "size"), "chosen")
    texts = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), F.col("text").cast("string").alias("text"))
    texts = texts.join(small(chosen, chosen.count()), F.col("row_key") == F.col("_key")).select("part", "sub", "size", "k2", "rep", "n", "text")
    blocks = F.ceil(F.col("size") / BLOCK)
    sets = gathered(texts, n).withColumn("mine", F.pmod("k2", blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    sets = sets.select("part", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "sub", "rep", "n", "grams")
    # a row repeated in the input (the same id and text) is one text, counted in n; verify() leaves its repeats out
    return sets.repartition("part", "i", "j").sortWithinPartitions("part", "i", "j", "rep")


def join(docs: DataFrame, n: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, row_key, class_id, n_links, kept) of every row of docs(doc_id, text).

    Two texts are linked if the sets of their word n-grams have a Jaccard similarity of at least `similarity`; a text
    of 1 to n-1 words has one n-gram, of all its words. n_links counts the other rows linked to a row, copies too;
    class_id is the smallest id reachable over links; kept marks the rows that bear it.

    Rows of one word sequence are one text, sent on once. Texts are the leaves of TREES tries over their MinHash
    signatures, laid out by one sort. Texts that share the longest prefixes come first: they are joined to parts, whose
    pairs are verified exactly, in blocks of texts against texts. Then the prefix is shortened to the length at which the
    links found say that under 1 - RECALL of all are missing, and the pairs that now come together are verified, and so
    on until the links found ask for no shorter one, or it is so short that no similarity asked for could lose more. Counts and a spanning set of links come out of a
    block, not pairs.

    Texts without a word link to nothing and are their own class. A row with a null id goes under a hash of its text.
    Rows that share an id are one class if their texts are. An empty table gives no rows; other columns are ignored.
    """
    few_rows(docs.sparkSession)
    root = root_depth(similarity)
    rows = settle(sketched(docs, n, root).withColumn("sid", F.coalesce("doc_id", "row_key")), "forest")
    live = rows.filter("n_grams > 0")
    nodes = live.groupBy("k1", "k2").agg(F.min("sid").alias("rep"), F.count("*").alias("n"), F.min(F.struct("sid", "row_key")).alias("pick"), F.first("labels").alias("labels"))
    nodes = settle(nodes.select("k1", "k2", "rep", "n", F.col("pick.row_key").alias("row_key"), "labels"), "texts")
    edges = settle(trie_edges(nodes.select("k1", "labels")), "tries")
    found, before = None, None
    sums = np.zeros(LEVELS + 2)
    level = LEVELS
    while True:
        parts = settle(components(edges.filter(F.col("level") >= level).select("a", "b")), "parts")
        if before is None:
            named = parts.withColumn("sub", F.col("node"))
        else:
            known = before.select(F.col("node").alias("_n"), F.col("component").alias("_sub"))
            named = parts.join(known, F.col("node") == F.col("_n"), "left").select("node", "component", F.coalesce("_sub", "node").alias("sub"))
        new = settle(verify(met(docs, nodes, settle(named, "parts"), n), similarity, root), "links")
        got = new.filter("sums is not null").agg(*[F.coalesce(F.sum(F.col("sums")[k]), F.lit(0.0)) for k in range(LEVELS + 2)]).first()
        sums += np.array(got)
        found, before = new if found is None else found.unionByName(new), parts
        # the longest prefix under which the links found so far say that no more than asked are missing
        enough = max([k for k in range(LEVELS + 1) if sums[1 + k] <= (1 - RECALL) * sums[0]], default=0)
        if enough >= level or not level:
            break
        level = enough
    links = found.filter("a is not null and b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    classes = components(found.filter("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    known = nodes.select("k1", "k2", "rep", "n").join(links, "rep", "left").join(classes, "rep", "left")
    known = known.select(F.col("k1").alias("_1"), F.col("k2").alias("_2"), F.coalesce("component", "rep").alias("class"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    out = rows.join(known, (F.col("k1") == F.col("_1")) & (F.col("k2") == F.col("_2")) & (F.col("n_grams") > 0), "left")
    out = out.withColumns({"class_id": F.coalesce("class", "sid"), "n_links": F.coalesce("links", F.lit(0)).cast("long")})
    return out.select("doc_id", "row_key", "class_id", "n_links", (F.col("sid") == F.col("class_id")).alias("kept"))


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted sets without repeats of a text within a block (repeated input rows come one after another)."""
    last = None
    for b in batches:
        key = list(zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("part", "i", "j", "mine", "sub", "rep", "grams"))))
        keep = [k != p for k, p in zip(key, [last, *key[:-1]])]
        last = key[-1] if key else last
        yield b.filter(pa.array(keep, pa.bool_()))


def kept_rows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with one row of each class: that with the class's id. Rows without a link all stay; columns stay.

    Of several rows with that id the one with the least hash of id and text stays, and of rows equal in both the least
    in the order of the columns.
    """
    linked = settle(found.filter("n_links > 0").select("row_key", "class_id", "kept"), "linked")
    firsts = linked.filter("kept").groupBy("class_id").agg(F.min("row_key").alias("first"), F.count("*").alias("n")).filter("n > 1")
    firsts = settle(firsts, "firsts")
    n = firsts.count()
    others = linked.filter("kept").join(small(firsts, n), "class_id").filter("row_key <> first").select("row_key")
    gone = settle(linked.filter("not kept").select("row_key").unionByName(others).select(F.col("row_key").alias("_gone")).distinct(), "gone")
    used = ["doc_id", "text"]
    packed, names = aside(docs, used)
    left = packed.withColumn("_key", F.xxhash64(*used)).join(small(gone, gone.count()), F.col("_key") == F.col("_gone"), "left_anti")
    if not n:
        return restored(left, names, used)
    twice = firsts.select(F.col("first").alias("_twice"))
    rest = left.join(small(twice, n), F.col("_key") == F.col("_twice"), "left_anti")
    again = left.join(small(twice, n), F.col("_key") == F.col("_twice"), "left_semi")
    again = again.groupBy("_key").agg(F.min(F.struct(*used, "rest")).alias("_row")).select("_row.*")
    return restored(rest, names, used).unionByName(restored(again, names, used))
