"""Best-fit packing of documents into sequences, after Martello-Toth dominance reduction."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scan
from .common import few_rows, held, settle, tidy

#: Entries of each generation of a worker's cache; beyond it the older one goes, so memory is bounded.
CACHE = 100_000
#: How the tokenizer of word_bpe_49k.json divides lower-case text (its own pattern, fixed values, for the letters below).
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-zß-öø-ſ0-9]+")
#: Characters whose lower case and normal form are plain and as long: printable ASCII, Latin letters with marks; with white space.
PLAIN = re.compile("[!-~À-ÖØ-öø-įıĲ-ňŊ-ſ]+")
PLAIN_TEXT = re.compile("[\t-\r -~À-ÖØ-öø-įıĲ-ňŊ-ſ]*")
_HIDDEN = [*range(33), 127, *range(128, 161), 173]
#: Byte-level models write each byte as a character (here its code): itself if it prints, else the next from U+0100. A
#: blank, which no piece holds, stays one.
BYTE_CHARS = np.arange(256, dtype="<u2")
BYTE_CHARS[_HIDDEN] = 256 + np.arange(len(_HIDDEN))
BYTE_CHARS[32] = 32
#: Classes of bytes of lower-case plain text: white space, letter (any byte of a marked letter too), digit, other.
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[[*range(97, 123), *range(128, 256)]] = _LETTER
_KIND[48:58] = _DIGIT


class Recent:
    """A dictionary that forgets what was not asked for lately: two generations, of which the older is dropped."""

    def __init__(self, most: int, make):
        self.most, self.make, self.new, self.old = most, make, {}, {}

    def __call__(self, keys: list) -> list:
        """The values of distinct keys; make() gives all the missing ones in one call."""
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        got = list(map(self.new.get, keys))
        lost = [i for i, v in enumerate(got) if v is None]
        for i in lost:
            got[i] = self.old.get(keys[i])
        unknown = [i for i in lost if got[i] is None]
        for i, v in zip(unknown, self.make([keys[i] for i in unknown]) if unknown else ()):
            got[i] = v
        self.new.update([(keys[i], got[i]) for i in lost])
        return got


def divided(buf: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the pieces (see PIECES) of lower-case plain texts that lie end to end in buf."""
    n = len(buf)
    kind = np.full(n + 1, _SPACE, np.uint8)
    kind[:n] = _KIND[buf]
    new_text = np.zeros(n + 1, bool)
    new_text[edge] = True
    before = np.concatenate((np.full(1, _SPACE, np.uint8), kind[:-1]))
    before[new_text] = _SPACE
    start = (kind != _SPACE) & ((kind != before) | (kind == _DIGIT))
    # a quote mark that begins a piece, with one of seven endings after it, is a piece of two or three bytes
    at = np.flatnonzero((buf == 39) & (before[:n] != _OTHER))
    if len(at):
        stop = edge[np.searchsorted(edge, at, "right")]
        x, y = (buf[np.minimum(at + k, n - 1)] for k in (1, 2))
        short = np.isin(x, list(b"stmd")) & (at + 1 < stop)
        long_ = (((x == ord("r")) | (x == ord("v"))) & (y == ord("e")) | (x == ord("l")) & (y == ord("l"))) & (at + 2 < stop)
        for hit, size in ((short, 2), (long_, 3)):
            start[at[hit] + 1] = False
            after = at[hit] + size
            start[after] |= kind[after] != _SPACE
    end = np.zeros(n + 1, bool)
    end[1:] = (kind[:-1] != _SPACE) & (start[1:] | (kind[1:] == _SPACE) | new_text[1:])
    return np.flatnonzero(start), np.flatnonzero(end)


def alike(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of each distinct string, number of each string among them), by hashes that are then compared in full."""
    _, first, of = np.unique(scan.hashes(buf, start, end, 1)[0], return_index=True, return_inverse=True)
    size, like = end - start, first[of]
    same = size[like] == size
    if same.all():
        here = np.arange(int(size.sum()))
        gap = start - (np.cumsum(size) - size)
        same = buf[np.repeat(gap, size) + here] == buf[np.repeat(gap + (start[like] - start), size) + here]
    return (first, of) if same.all() else (np.arange(len(start)), np.arange(len(start)))


class Coder:
    """Token ids of whole texts.

    The tokenizer's pieces never cross white space (its splitter drops it), so a text's ids are those of its words in
    turn. Plain texts are divided into pieces here, as arrays, and the distinct pieces are encoded by the tokenizer's
    model, many in a call, if that agrees with the whole tokenizer on a probe text; other words go through the whole
    tokenizer. A piece's ids depend on the piece alone, so caches change no result.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        self.words, self.pieces = Recent(CACHE, self._whole), Recent(CACHE, self._parts)
        told = json.loads(spec)
        self.divides = told["model"].get("type") == "BPE" and told["model"].get("end_of_word_suffix") == "</w>"
        if not self.divides:
            return
        vocab = told["model"]["vocab"]
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for k, i in vocab.items() if k.endswith("</w>")]] = True
        self.model = Tokenizer.from_str(json.dumps(told | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "WhitespaceSplit"}}))
        plain = [c for c in map(chr, range(33, 0x180)) if PLAIN.fullmatch(c)]
        probe = "Don't we'LL 3x42 #a_b! (see) I'm \"x's\" re's A1b2 'd ÉCOLE's Straße, naïve; œuvre ''s 's're a''ve " + " ".join(plain) + " " + "".join(plain) + " " + "-".join(plain)
        buf = np.frombuffer(probe.lower().encode(), np.uint8)
        try:
            self.divides = self._plain(buf, np.array([0, len(buf)])) == [b"".join(self._whole(probe.split()))]
        except ValueError:
            self.divides = False

    def _whole(self, ws: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(ws, add_special_tokens=False)]

    def _parts(self, xs: list[bytes]) -> list[bytes]:
        shown = BYTE_CHARS[np.frombuffer(b" ".join(xs), np.uint8)].tobytes().decode("utf-16-le")
        ids = np.array(self.model.encode_batch_fast([shown], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()  # the last token of each piece says so
        if len(ends) != len(xs):
            raise ValueError("the model joins or drops pieces")
        raw = ids.tobytes()
        return [raw[lo:hi] for lo, hi in zip([0, *ends], ends)]

    def _plain(self, buf: np.ndarray, edge: np.ndarray) -> list[bytes]:
        """Ids of lower-case plain texts."""
        start, end = divided(buf, edge)
        first, of = alike(buf, start, end)
        raw = buf.tobytes()
        keys = [raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())]
        distinct = dict.fromkeys(keys)  # as many as keys but for a clash of hashes
        distinct = dict(zip(distinct, self.pieces(list(distinct))))
        got = [distinct[k] for k in keys]
        ids = np.frombuffer(b"".join(got), "<u4")
        size = np.fromiter(map(len, got), np.int64, len(got)) >> 2
        n, at = size[of], (np.cumsum(size) - size)[of]
        stop = np.cumsum(n)
        flat = ids[np.repeat(at - (stop - n), n) + np.arange(int(n.sum()))]
        cut = np.concatenate(([0], stop))[np.searchsorted(start, edge)].tolist()
        return [flat[a:b].tobytes() for a, b in zip(cut, cut[1:])]

    def _mixed(self, text: str) -> bytes:
        """Ids of a text that is not plain: its plain words by pieces, the others by the whole tokenizer."""
        keys: list = []
        for w in map(bytes.decode, text.encode().split()):
            if self.divides and "<|" not in w and PLAIN.fullmatch(w):  # special tokens have that form
                keys += map(str.encode, PIECES.findall(w.lower()))
            else:
                keys.append(w)
        parts, whole = ([k for k in dict.fromkeys(keys) if isinstance(k, kind)] for kind in (bytes, str))
        of = dict(zip(parts, self.pieces(parts) if parts else ())) | dict(zip(whole, self.words(whole)))
        return b"".join(map(of.__getitem__, keys))

    def encode(self, buf: np.ndarray, edge: np.ndarray) -> list[bytes]:
        """Packed 32-bit ids of each of the texts that lie end to end in buf."""
        if len(edge) == 2 and len(buf) > 4 * scan.SLICE:
            return [b"".join(x for part in _cut(buf) for x in self.encode(part, np.array([0, len(part)])))]
        text = buf.tobytes().decode("utf-8", "replace")
        if self.divides and "<|" not in text and PLAIN_TEXT.fullmatch(text):
            return self._plain(np.frombuffer(text.lower().encode(), np.uint8), edge)
        if len(edge) > 2:
            return [x for a, b in zip(edge.tolist(), edge[1:].tolist()) for x in self.encode(buf[a:b], np.array([0, b - a]))]
        return [self._mixed(text)]


def _cut(buf: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in parts of about 2 * scan.SLICE bytes that end where a word does."""
    gaps = np.flatnonzero(_KIND[buf] == _SPACE)
    lo = 0
    while lo < len(buf):
        k = int(np.searchsorted(gaps, lo + 2 * scan.SLICE))
        hi = int(gaps[k]) if k < len(gaps) else len(buf)
        yield buf[lo:hi]
        lo = hi


def pieces_of(docs: DataFrame, spec: str, limit: int, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row of docs; spec is a tokenizer's JSON text (a few MB)."""
    spark = docs.sparkSession
    few_rows(spark)
    shared = spark.sparkContext.broadcast(spec)
    end = int(end_id).to_bytes(4, "little")
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]):
        text = shared.value
        coder = held(f"coder {zlib.crc32(text.encode())} {len(text)}", lambda: Coder(text))
        for b, buf, edge in scan.slices(batches, 1, 2 * scan.SLICE):
            rows = []
            for doc, ids in zip(b.column(0).to_pylist(), coder.encode(buf, edge)):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at : at + 4 * limit]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        tidy()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Stock:
    """How many pieces of each length 1..limit remain."""

    def __init__(self, counts: np.ndarray):
        self.n = counts.astype(np.int64)

    def largest(self, most: int) -> int:
        """The largest length in stock that is at most `most`; 0 if there is none."""
        if most < 1:
            return 0
        have = np.flatnonzero(self.n[: most + 1])
        return int(have[-1]) if len(have) and have[-1] > 0 else 0

    def smallest(self, k: int) -> list[int]:
        """The k smallest pieces, by length, repeats counted."""
        out: list[int] = []
        for length in np.flatnonzero(self.n):
            out += [int(length)] * min(k - len(out), int(self.n[length]))
            if len(out) >= k:
                break
        return out


def best_pair(stock: Stock, room: int) -> tuple[int, int]:
    """Two pieces in stock, larger first, with the largest sum that `room` holds; (0, 0) if there are none."""
    best = (0, 0)
    for a in np.flatnonzero(stock.n[: room + 1])[::-1]:
        a = int(a)
        if 2 * a <= sum(best):
            break
        stock.n[a] -= 1
        b = stock.largest(min(a, room - a))
        stock.n[a] += 1
        if b and a + b > sum(best):
            best = (a, b)
            if a + b == room:
                break
    return best


def between(stock: Stock, j: int, pair: tuple[int, int]) -> list[float]:
    """The two smallest pieces longer than the shorter of the pair, besides j and the longer; infinite if there are not two.

    Only two such pieces could fill the room beside j and not be replaced, one by one, by the pair.
    """
    a, b = pair
    stock.n[j] -= 1
    stock.n[a] -= 1
    out: list[float] = []
    for length in (b + 1 + np.flatnonzero(stock.n[b + 1 :])).tolist():
        out += [length] * min(2 - len(out), int(stock.n[length]))
        if len(out) == 2:
            break
    stock.n[j] += 1
    stock.n[a] += 1
    return out if len(out) == 2 else [np.inf]


def plan(counts: np.ndarray, limit: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, how many such sequences) for counts[length] pieces, using every piece once.

    First the reduction of Martello and Toth: from the longest piece down, with k the number of the smallest pieces
    that fit beside it, a set is fixed for good where it dominates every other set holding that piece: alone (k = 0);
    with its largest partner (k = 1, or the sequence is then full, or k = 2 and no pair is larger); or (k = 2) with the
    pair of the largest sum, if that has the largest partner and no two of the pieces between the pair's fit beside it. A whole run of equal lengths is fixed at a time. What is left is packed best-fit, longest first,
    again a run at a time, so the work depends on the number of lengths, not on the number of pieces.
    """
    stock, out = Stock(counts), []

    def fix(lengths: tuple[int, ...], times: int) -> None:
        for x in lengths:
            stock.n[x] -= times
        out.append((lengths, times))

    def times_of(lengths: tuple[int, ...]) -> int:
        return min(int(stock.n[x]) // lengths.count(x) for x in set(lengths))

    for j in range(limit, 0, -1):
        while stock.n[j]:
            room = limit - j
            stock.n[j] -= 1
            low = stock.smallest(3)
            mate = stock.largest(room)
            k = sum(1 for s in np.cumsum(low) if s <= room)
            pair = best_pair(stock, room) if k == 2 and mate and j + mate < limit else (0, 0)
            stock.n[j] += 1
            if k == 0:
                fix((j,), int(stock.n[j]) if stock.n[j] == 1 or 2 * j > limit else 1)
            elif k == 1 or j + mate == limit or (k == 2 and mate >= sum(pair)):
                # Removing pieces leaves no new partner, so the rule holds for every copy while the mate lasts.
                fix((j, mate), times_of((j, mate)))
            elif k == 2 and pair[0] == mate and j + sum(between(stock, j, pair)) > limit:
                fix((j, *pair), times_of((j, *pair)))
            else:
                break
    return out + best_fit(stock, limit)


def best_fit(stock: Stock, limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counted lengths: open sequences alike are kept as one entry with a count."""
    open_: dict[int, dict[tuple[int, ...], int]] = {}
    rooms = np.zeros(limit + 1, np.int64)

    def put(lengths: tuple[int, ...], times: int) -> None:
        room = limit - sum(lengths)
        here = open_.setdefault(room, {})
        here[lengths] = here.get(lengths, 0) + times
        rooms[room] += times

    for j in range(limit, 0, -1):
        left, stock.n[j] = int(stock.n[j]), 0
        while left:
            fits = np.flatnonzero(rooms[j:])
            if not len(fits):
                each = limit // j
                if left >= each:  # best-fit fills a new sequence with equal pieces until none fits
                    put((j,) * each, left // each)
                    left %= each
                if left:
                    put((j,) * left, 1)
                left = 0
                continue
            room = j + int(fits[0])
            lengths, times = open_[room].popitem()
            each = min(room // j, left)
            used = min(times, left // each)
            if times > used:
                open_[room][lengths] = times - used
            rooms[room] -= used
            put(lengths + (j,) * each, used)
            left -= used * each
    return [(lengths, times) for here in open_.values() for lengths, times in here.items()]


def ranges(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, number, first sequence, offset): pieces of a length, by rank, to consecutive sequences."""
    rows, used, base = [], {}, 0
    for lengths, times in patterns:
        at = 0
        for x in lengths:
            rows.append((x, used.get(x, 0), times, base, at))
            used[x] = used.get(x, 0) + times
            at += x
        base += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, spec: str | None = None, path: str | None = None, limit: int = 2048, end_id: int = 0, each: int = 200_000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row of docs.

    Only counts by length reach the driver (`limit` numbers). It plans on those counts; the plan gives each length's
    pieces, by rank, ranges of sequences. Ranks come from windows over (length, part): a length is dealt to as many
    parts as keep a part near `each` pieces, so a length that holds a third of all rows is no larger task, and the
    parts' sizes give each part's first rank.

    A null or empty text is the end id alone: one piece of length 1. Rows with equal or null ids are documents of
    their own and equal pieces may change places; an empty table gives no rows. A long text is cut into pieces of
    `limit` ids, of which the last may be shorter. Other columns are ignored.
    """
    spark = docs.sparkSession
    if spec is None:
        spec = Path(path).read_text()
    made = settle(pieces_of(docs, spec, limit, end_id), "pieces")
    tally = made.groupBy("length").count().collect()
    counts = np.zeros(limit + 1, np.int64)
    for r in tally:
        counts[r[0]] = r[1]
    table = ranges(plan(counts, limit))
    parts = int(max(16, -(-counts.max() // each)))
    dealt = made.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    order = W.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("_nth", F.row_number().over(order) - 1)
    sizes = dealt.groupBy("length", "_part").count()
    first = sizes.select(F.col("length").alias("_l"), F.col("_part").alias("_p"), (F.sum("count").over(W.partitionBy("length").orderBy("_part")) - F.col("count")).alias("_first"))
    cells = int((counts > 0).sum()) * parts
    first = F.broadcast(first) if cells <= 500_000 else first
    ranked = ranked.join(first, (F.col("length") == F.col("_l")) & (F.col("_part") == F.col("_p"))).withColumn("_rank", F.col("_first") + F.col("_nth"))
    return placed(ranked.select(*made.columns, "_rank"), table)


def placed(ranked: DataFrame, table: np.ndarray) -> DataFrame:
    """ranked with sequence_id and offset from the plan's ranges (a table bounded by the number of lengths)."""
    shared = ranked.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]):
        t = shared.value
        edge = np.searchsorted(t[:, 0], np.arange(t[-1, 0] + 2 if len(t) else 1))
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            at = np.empty(len(length), np.int64)
            order = np.lexsort((rank, length))
            ls = length[order]
            cuts = [0, *(np.flatnonzero(np.diff(ls)) + 1).tolist(), len(ls)] if len(ls) else []
            for lo, hi in zip(cuts, cuts[1:]):
                x = ls[lo]
                own = t[edge[x] : edge[x + 1]]
                at[order[lo:hi]] = edge[x] + np.searchsorted(own[:, 1], rank[order[lo:hi]], "right") - 1
            seq, off = t[at, 3] + rank - t[at, 1], t[at, 4]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(5)], pa.array(seq), pa.array(off)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
