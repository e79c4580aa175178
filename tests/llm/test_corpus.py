"""The corpus operators against brute force and on edge cases."""

import hashlib
import pickle
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import zstandard
from pyspark import Broadcast
from pyspark.sql import functions as F

from driftloom.llm import chat, common, jaccard, language, lm, mixing, packing, quality, queries, rules, substrings, vectors

public_tokenizers = pytest.importorskip("public_tokenizers")
KIND = "doc_id long, text string, lang string, source string, n_chars long, size long, score double"
rng = np.random.default_rng(3)
VOCAB = ["w%d" % i for i in range(300)]


def text(n):
    return " ".join(rng.choice(VOCAB, n))


@pytest.fixture(scope="module")
def rows():
    passage, base = text(60), text(120)
    out = [text(int(n)) for n in rng.integers(3, 150, 40)]
    out += [base, base, base + " tail", "head " + base, base.replace("w1", "x1", 1), passage + " " + text(40), text(30) + " " + passage]
    out += ["", None, " \t\n", "one two", "one two", "é " * 40, text(5000)]
    docs = [(i, t, ["en", "fr", None][i % 3], [None, "a", "b", "hot", "hot"][i % 5], 1, 7, 0.5) for i, t in enumerate(out)]
    return docs + [docs[0], (None, text(50), "en", "a", 1, 7, 0.5), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, KIND)


def empty(spark):
    return spark.createDataFrame([], KIND)


def split(t):
    return (t or "").encode().split()


def test_mixing(spark, docs, rows):
    got = mixing.mix(docs).toPandas()
    assert len(got) == len(rows)
    size = {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + len(split(r[1]))
    order = sorted([s for s in size if s is not None]) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, budget = {}, set(order), 1.5 * sum(size.values())
    while True:
        level = (budget - sum(2 * size[s] for s in order if s not in free)) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= 2 * size[s]}
        if not over:
            break
        free -= over
    target = {s: weight[s] * level if s in free else 2.0 * size[s] for s in order}
    for s, g in got.assign(source=got.source.where(got.source.notna(), None)).groupby("source", dropna=False):
        s = s if isinstance(s, str) else None
        assert g.source_size.iloc[0] == size[s] and g.target.iloc[0] == pytest.approx(target[s])
        assert abs(g.taken.sum() - target[s]) <= g["size"].max() + 1
    assert (got.taken <= 2 * got["size"]).all()
    again = mixing.mix(docs).toPandas()
    assert Counter(zip(got.doc_id.fillna(-1), got.taken)) == Counter(zip(again.doc_id.fillna(-1), again.taken))
    assert mixing.mix(empty(spark)).count() == 0


def test_rules(spark, docs, rows):
    got = rules.weigh(docs).toPandas()
    assert len(got) == len(rows) and not (got.kept & got.base_failed).any()
    t = "a b c a b c d\nx\nx\n \n# $1 é"
    counts, _ = rules.measures(t)
    assert counts == [12, 13, 2, 1, 6]
    assert rules.weigh(empty(spark)).count() == 0


def test_language_model(spark, docs, rows):
    got = lm.score(docs).toPandas().sort_values(["doc_id", "n_tokens"]).reset_index(drop=True)
    toks = [[w.lower() for w in split(r[1])] + [None] for r in rows]
    out = [zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 7 == 2 for r in rows]
    c = Counter(w for t, h in zip(toks, out) if not h for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((r[0] if r[0] is not None else 10**9, len(t), sum(w in c for w in t), sum(np.log10((c[w] + 1) / (n + v + 1)) for w in t)) for r, t in zip(rows, toks))
    assert len(got) == len(want) and (got.train_tokens == n).all()
    for (i, k, known, base), g in zip(want, got.itertuples()):
        assert (g.n_tokens, g.n_known) == (k, known) and g.base_score == pytest.approx(base)
    assert (got.score <= 0).all() and got.score[~got.held_out].sum() > got.base_score[~got.held_out].sum()
    assert lm.score(empty(spark)).count() == 0
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    again = lm.score(docs).toPandas().sort_values(["doc_id", "n_tokens"]).reset_index(drop=True)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert np.allclose(again.score, got.score, rtol=1e-9)  # whatever the cluster
    for r in lm.perplexity(lm.score(docs)).collect():
        own = got[got.held_out == r.held_out]
        assert r.perplexity == pytest.approx(10 ** (-own.score.sum() / own.n_tokens.sum()))


def test_rare_contexts_have_restaurants(spark, monkeypatch):
    """Contexts joined by slices, and heavy words dealt out by them, score as those that are broadcast do."""
    r = np.random.default_rng(5)
    texts_ = [" ".join(f"w{x}" for x in np.cumsum(r.integers(1, 3, 60)) % 40) for _ in range(300)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts_)], "doc_id long, text string")

    def scored():
        return lm.score(docs).toPandas().sort_values("doc_id").reset_index(drop=True)

    want = scored()
    for contexts, share, bytes_ in ((0, 2e-3, 1 << 30), (5, 2e-3, 2000), (5, 0.03, 2000)):
        monkeypatch.setattr(lm, "CONTEXTS", max(contexts, 1))
        monkeypatch.setattr(lm, "HEAVY_SHARE", share)
        monkeypatch.setattr(lm, "BUCKET_BYTES", bytes_ * 4)
        monkeypatch.setattr(lm, "SLICE_BYTES", bytes_ * 8)
        got = scored()
        assert (got.n_known == want.n_known).all() and np.allclose(got.base_score, want.base_score)
        assert np.abs(got.score / want.score - 1).max() < 0.02
        # next words are one of two: far better than without a context
        assert got.score[got.held_out].sum() > 0.5 * got.base_score[got.held_out].sum()


def test_every_context_and_customer_is_counted(spark, monkeypatch):
    """However few contexts are broadcast and however small buckets and slices are."""
    seen, models, settle, totals = [], [], lm.settle, lm._totals
    monkeypatch.setattr(lm, "settle", lambda df, tag: (seen.append(settle(df, tag)), seen[-1])[1])
    monkeypatch.setattr(lm, "_totals", lambda light, hot, plan: (models.append(hot), totals(light, hot, plan))[1])
    for name, value in (("CONTEXTS", 3), ("HEAVY_SHARE", 0.03), ("BUCKET_BYTES", 4000), ("SLICE_BYTES", 8000)):
        monkeypatch.setattr(lm, name, value)
    r = np.random.default_rng(6)
    texts_ = [" ".join(f"w{x}" for x in r.zipf(1.3, 40) % 5000) for _ in range(200)]
    lm.score(spark.createDataFrame([(k, t) for k, t in enumerate(texts_)], "doc_id long, text string")).count()
    train = Counter(w for k, t in enumerate(texts_) if zlib.crc32(str(k).encode()) % 7 != 2 for w in [*t.split(), None])
    rows_ = seen[-1].toPandas()
    near, far = rows_[(rows_.kind == 0) & (rows_.number >= 0)], rows_[rows_.kind == 2]
    parts = [lm._unpack(d, *lm.RARE) for d in far.data]
    assert models[0].n.sum() + near.c.sum() + sum(p[1].sum() for p in parts) == sum(train.values())
    # contexts that only held-out texts have take part without a customer
    held = {x for p in parts for x, n in zip(np.cumsum(p[0].astype(np.int64)).tolist(), p[1].tolist()) if n}
    assert len(held) == len(train) - 3 and len(held) > 500


def test_crowds_keep_customers():
    n = np.array([70, 100, 900])
    s = lm.Crowd(n, np.full(3, 0.5), np.random.default_rng(0))
    for want in (n, n + [100, -60, 3], n):
        t = s.sweep(want, np.full(3, 0.5))
        which = np.repeat(np.arange(3), s.room)
        assert np.bincount(which, s.sizes).tolist() == want.tolist() and np.bincount(which, s.sizes > 0).tolist() == t.tolist()


def test_tables_follow_their_conditional():
    """Both samplers against weights that are counted out: every way to seat 6 customers, one after another."""
    d, open_, rng_ = lm.DISCOUNT, 0.8, np.random.default_rng(1)
    weight = Counter()

    def seat(sizes, w, left):
        if not left:
            weight[len(sizes)] += w
            return
        for k, x in enumerate(sizes):
            seat([*sizes[:k], x + 1, *sizes[k + 1 :]], w * (x - d), left - 1)
        seat([*sizes, 1], w * open_, left - 1)

    seat([], 1.0, 6)
    share = np.array([weight[t] for t in range(1, 7)]) / sum(weight.values())
    m = 40_000
    got = lm.drawn(np.full(m, 6), np.full(m, np.log(open_)), np.ones(m), 0.0, rng_)
    assert np.abs(np.bincount(got, minlength=7)[1:] / m - share).max() < 0.02
    crowd = lm.Crowd(np.full(m, 6), np.full(m, open_), rng_)
    got = crowd.sweep(np.full(m, 6), np.full(m, open_))
    assert np.abs(np.bincount(got, minlength=7)[1:] / m - share).max() < 0.02


@pytest.mark.parametrize("seed", [0, 1])
def test_probabilities_sum_to_one(seed):
    """Words dealt to three models and a driver's, as score() does: after each context they sum to one."""
    r = np.random.default_rng(seed)
    words_, contexts = 400, 12
    pairs = np.minimum(r.zipf(1.3, (30_000, 2)) - 1, [words_ - 1, contexts - 1])
    n = np.zeros((words_, contexts), int)
    np.add.at(n, (pairs[:, 0], pairs[:, 1]), 1)
    v, models, whole = int((n.sum(1) > 0).sum()), [], n.sum()
    for k, own in enumerate([np.arange(3), *[np.arange(3 + k, words_, 3) for k in range(3)]]):
        w, c = np.nonzero(n[own])
        models.append((own, w, c, lm.Model(w, c, n[own][w, c], len(own), contexts, whole / max(n[own].sum(), 1), v, k)))
    total = models[0][3].sums(contexts)
    for m in models[1:]:
        for key, x in m[3].sums(contexts).items():
            total[key] = total[key] + x
    total["V"] = float(v)
    assert total["c"].tolist() == n.sum(0).tolist()
    back, p = lm.back_off(total), np.zeros((words_, contexts))
    for own, w, c, m in models:
        here = np.einsum("sc,sw->wc", back, m.parents(total)) / lm.SAMPLES
        here[w, c] += m.own(total)
        p[own] = here
    seen = n.sum(1) > 0
    unknown = np.mean(back * ((lm.STRENGTH + lm.DISCOUNT * total["T0"]) / (total["V"] + 1) / (lm.STRENGTH + total["C0"]))[:, None], 0)
    assert np.abs(p[seen].sum(0) + unknown - 1).max() < 1e-9 and (p > 0).all()
    # frequent pairs come near their shares
    big = n > 300
    assert np.abs(p[big] / (n / n.sum(0))[big] - 1).max() < 0.05


def linked(a):
    label = np.arange(len(a))
    while True:
        new = np.minimum(label, np.where(a, label[None], len(a)).min(1))
        if (new == label).all():
            return label
        label = new


def test_vectors(spark):
    x = rng.normal(size=(60, 8))
    x[10:30] = x[0] + rng.normal(size=(20, 8)) * 0.1
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(60, x[0].tolist()), (61, None), (62, [0.0] * 8), (63, [float("nan")] * 8), (64, [None] * 8), (65, []), (66, [1.0, 2.0])]
    got = vectors.link(spark.createDataFrame(data, "vec_id long, embedding array<double>")).toPandas().sort_values("vec_id")
    u = np.vstack((x, x[:1]))
    u /= np.linalg.norm(u, axis=1)[:, None]
    a = u @ u.T >= 0.95
    np.fill_diagonal(a, False)
    assert got.n_links.tolist() == a.sum(1).tolist() + [0] * 6
    assert got.component_id.tolist() == linked(a).tolist() + list(range(61, 67))
    assert vectors.link(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


@pytest.mark.parametrize("twins", [1e-6, -1.0])
def test_scaled_copies_link_across_pivots(spark, monkeypatch, twins):
    """Scalar multiples of one vector give near-equal pivots; with twins = -1 those stay, and their cells must meet."""
    monkeypatch.setattr(vectors, "BLOCK", 50)
    monkeypatch.setattr(vectors, "TWINS", twins)
    r = np.random.default_rng(8)
    x = r.normal(size=(600, 64))
    x[:300] = x[0] * r.uniform(0.1, 9, 300)[:, None].astype(np.float32)
    got = vectors.link(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).toPandas().sort_values("vec_id")
    assert got.n_links.tolist() == [299] * 300 + [0] * 300 and (got.component_id[:300] == 0).all()


def test_substrings(spark, docs, rows):
    got = substrings.dedup(docs, 35).toPandas()
    ws = [split(r[1]) for r in rows]
    c = Counter(tuple(w[i : i + 35]) for w in ws for i in range(len(w) - 34))
    want = Counter()
    for r, w in zip(rows, ws):
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - 34):
            if c[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = True
        want[(r[0], len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())] += 1
    key = got.doc_id.astype(object).where(got.doc_id.notna(), None)
    assert Counter(zip([None if k is None else int(k) for k in key], got.n_words, got.n_removed, got.kept_sha256)) == want
    assert sum(k[2] for k in want) > 300
    assert substrings.dedup(empty(spark)).count() == 0


def test_packing(spark, docs, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    limit = 256
    got = packing.pack(docs, path=path, limit=limit).toPandas()
    want = Counter()
    for r in rows:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), limit)):
            part = np.array(ids[at : at + limit], "<u4")
            want[(r[0], k, at, len(part), zlib.crc32(part.tobytes()))] += 1
    key = got.doc_id.astype(object).where(got.doc_id.notna(), None)
    assert Counter(zip([None if k is None else int(k) for k in key], got.piece, got.start, got.length, got.ids_crc32)) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= limit
    assert got.sequence_id.nunique() <= -(-got.length.sum() // limit) * 1.05 + 1
    assert packing.pack(empty(spark), path=path).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_plan_is_whole_and_near_the_bound(seed):
    r = np.random.default_rng(seed)
    n = np.bincount(r.integers(1, 41, r.integers(0, 80)), minlength=41)
    plan = packing.plan(n, 40)
    used = np.zeros(41, int)
    for lengths, times in plan:
        assert sum(lengths) <= 40 and times > 0
        for x in lengths:
            used[x] += times
    assert (used == n).all()
    assert sum(t for _, t in plan) <= np.ceil((n * np.arange(41)).sum() / 40) * 1.2 + 1


def fewest(pieces, limit):
    """The least number of sequences, by trying every set that the longest piece can be put with."""
    from functools import lru_cache
    from itertools import combinations

    @lru_cache(None)
    def best(left):
        if not left:
            return 0
        first, rest = left[0], left[1:]
        out = len(left)
        for k in range(len(rest) + 1):
            for at in combinations(range(len(rest)), k):
                if first + sum(rest[i] for i in at) <= limit:
                    out = min(out, 1 + best(tuple(x for i, x in enumerate(rest) if i not in at)))
        return out

    return best(tuple(sorted(pieces, reverse=True)))


def test_reduction_keeps_the_best_plan(monkeypatch):
    """What the dominance rule fixes is part of a best plan, and the whole is never worse than best fit alone."""
    for seed in range(400):
        r = np.random.default_rng(seed)
        pieces = r.integers(2, 31, int(r.integers(1, 10))).tolist()
        n = np.bincount(pieces, minlength=31)
        left = []
        with monkeypatch.context() as m:
            m.setattr(packing, "best_fit", lambda stock, limit: left.extend(np.repeat(np.arange(31), stock.n).tolist()) or [])
            fixed = sum(t for _, t in packing.plan(n, 30))
        assert fixed + fewest(left, 30) == fewest(pieces, 30)
    for seed in range(1000):
        r = np.random.default_rng(seed)
        n = np.bincount(r.integers(1, 61, r.integers(1, 40)), minlength=61)
        assert sum(t for _, t in packing.plan(n, 60)) <= sum(t for _, t in packing.best_fit(packing.Stock(n), 60))


def test_coder_equals_the_tokenizer():
    """Random texts of plain, marked and other characters, apostrophes, digits and special tokens; in slices and in parts."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    from driftloom.llm import scan

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, coder = Tokenizer.from_file(path), packing.Coder(open(path).read())
    assert coder.divides
    r = np.random.default_rng(1)
    signs = [*"abAZ '’stmdrevl019.,!-\t\nàÉŉİſ漢<|>", "<|endoftext|>", "'re", "'LL", " 's"]
    given = ["".join(r.choice(signs[: int(k)], int(r.integers(0, 40)))) for k in r.choice([25, 30, len(signs)], 1500)] + [None, "", "x" * 300]
    batch = pa.RecordBatch.from_arrays([pa.array(given, pa.string())], names=["text"])
    for size in (200, 1 << 20):
        for s, buf, edge in scan.slices([batch], 0, size):
            for t, ids in zip(s.column(0).to_pylist(), coder.encode(buf, edge)):
                assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t or "", add_special_tokens=False).ids, t


def test_words_of_slices():
    import pyarrow as pa

    from driftloom.llm import scan

    r = np.random.default_rng(0)
    given = [None, "", "a b", " x\ty ", "end", "start", "é è" + "z" * 200 + " q", "\x0b\x0c\r\n k"] + ["".join(r.choice(list("ab \n"), int(r.integers(0, 30)))) for _ in range(300)]
    b = pa.RecordBatch.from_arrays([pa.array(given, pa.string())], names=["text"])
    of, n = {}, 0
    for s, buf, edge in scan.slices([b.slice(0, 3), b.slice(3, 0), b.slice(3)], 0, 100):
        start, end, many = scan.words(buf, edge)
        h, at = scan.hashes(buf, start, end), 0
        for t, m in zip(s.column(0).to_pylist(), many.tolist()):
            ws = [buf[x:y].tobytes() for x, y in zip(start[at : at + m], end[at : at + m])]
            assert ws == split(t)
            for w, x in zip(ws, h[:, at : at + m].T.tolist()):
                assert of.setdefault(w, x) == x
            at, n = at + m, n + 1
    assert n == len(given) and len({tuple(x) for x in of.values()}) == len(of)


def test_chat(spark):
    rows = [
        (1, 0, "u", "Hello world this is a question.\nSecond line is here too.", 1), (1, 1, "a", "> Hello  world this is a QUESTION.\n> Second line is here too.\nMy answer is forty two.", 1),
        (1, 2, "u", ">> Hello world this is a question.\n> My answer is forty two.\nThanks.", 1), (1, 3, "x", None, 1), (None, None, None, "", None), (1, 4, "y", "> nobody said this\n" + "> long\n" * 20_000, 1),
    ]
    got = chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth int")).orderBy("conv_id", "position").collect()
    assert [(r.turn, r.parent_turn, r.root_turn, r.depth, r.position, r.n_quotes) for r in got] == [
        (None, None, None, 0, 0, 0), (0, None, 0, 0, 0, 0), (1, 0, 0, 1, 1, 1), (2, 1, 0, 2, 2, 2), (3, None, 3, 0, 3, 0), (4, None, 4, 0, 4, 1),
    ]
    assert [r.text for r in got][2:4] == ["My answer is forty two.", "Thanks."]
    assert chat.link(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_short_lines_and_runs_of_lines_are_found(spark):
    rows = [
        (1, 0, "u", "We could stay at home.\nLet's go.\nIt is late."), (1, 1, "a", "a\nb\n\nc\nd\ne\nf\na"), (1, 2, "u", "b\nc"),
        (1, 3, "a", "> Let's go.\nYes."), (1, 4, "u", "> B\n> c\n>\n> d\n> e\nRight."), (1, 5, "a", "> b\n> c\nAll."), (1, 6, "u", "> e\n> b\nNo run."),
        (2, 0, "u", "b\nc\nd"), (1, 7, "u", "> It is late.\n> nobody said this\nSo?"), (1, 8, "u", "> a\n> b\n> c\n> d\n> e\n> f\n> a\nWhole."), (1, 9, "u", "> x y\nNone."),
    ]
    got = chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, r.turn): r.parent_turn for r in got} == {
        (1, 0): None, (1, 1): None, (1, 2): None, (1, 3): 0, (1, 4): 1, (1, 5): 2, (1, 6): 1, (2, 0): None, (1, 7): 0, (1, 8): 1, (1, 9): None,
    }
    run = [(1, 0, "u", "b x\nq"), (1, 1, "u", "c x\nq"), (1, 2, "u", "a x\nb x\nc x\nd x"), (1, 3, "a", "> b x\n> c x\nOf the run.")]
    got = chat.link(spark.createDataFrame(run, "conv_id long, turn long, role string, text string")).collect()
    assert {r.turn: r.parent_turn for r in got} == {0: None, 1: None, 2: None, 3: 2}  # by its lines alone it would be 1


def test_quality(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score(docs, quality.learn(docs, labels)).toPandas().merge(labels.toPandas(), on="doc_id")
    out = got[[zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]]
    assert (out.predicted == out.quality).mean() > 0.93
    none = quality.learn(empty(spark), labels.limit(0))
    assert quality.score(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), none).count() == 2
    assert quality.score(empty(spark), none).count() == 0


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    out = got[[zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]]
    assert (out.lang_pred == out.lang).mean() > 0.95
    odd = spark.createDataFrame([(1, None, "en"), (2, "123 !!", "en"), (3, "hello there", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language.identify(odd).orderBy("doc_id").collect()][:2] == ["und", "und"]
    assert language.identify(empty(spark)).count() == 0
    wide = spark.createDataFrame([(i, "%s%s " % (chr(97 + i % 23), chr(97 + i % 7)) * 9, "l%02d" % (i % 23)) for i in range(230)], "doc_id long, text string, lang string")
    assert {(r.doc_id, r.lang_pred) for r in language.identify(wide).collect()} == {(i, "l%02d" % (i % 23)) for i in range(230)}
    code = language.codewords(9)
    assert min((code[i] != code[j]).sum() for i in range(9) for j in range(i)) >= 15


def test_language_model_of_each_bit(spark, monkeypatch):
    """Weights and margins against plain sums, with counts handed on two languages at a time."""
    monkeypatch.setattr(language, "HELD", 2)
    r = np.random.default_rng(4)
    rows_ = [("l%d" % (i % 7), "".join(r.choice(list("abcdefgh "[i % 7 : i % 7 + 3]), 40))) for i in range(70)]
    got = language.learn(spark.createDataFrame(rows_, "lang string, text string").repartition(3))
    n = {}
    for lang, t in rows_:
        n[lang] = n.get(lang, 0) + language.slots(t)
    langs = sorted(n)
    share = np.array([(n[x] + 0.5) / (n[x] + 0.5).sum() for x in langs])
    code = language.codewords(7)
    w = np.stack([np.log(share[code[:, b] > 0].mean(0) / share[code[:, b] < 0].mean(0)) for b in range(code.shape[1])], 1)
    centre = share @ w
    high, low = np.where(code > 0, centre, np.inf).min(0), np.where(code < 0, centre, -np.inf).max(0)
    assert got.languages == langs and np.allclose(got.weights, w, atol=1e-6) and np.allclose(got.bias, -(high + low) / 2, atol=1e-6)


def test_rules_fit_equals_plain_em(spark, docs, rows):
    """quality and kept against expectation-maximisation written out text by text, rule by rule."""
    got = rules.weigh(docs).collect()
    live = [r for r in rows if split(r[1])]
    v = rules.votes(np.array([rules.measures(r[1])[1] for r in live]))
    p = {1: [[0.05, 0.15, 0.8]] * 9, 0: [[0.4, 0.2, 0.4]] * 9}
    share = 0.9
    for _ in range(100):
        post = []
        for row in v:
            a, b = share, 1 - share
            for k, x in enumerate(row):
                a, b = a * p[1][k][x + 1], b * p[0][k][x + 1]
            post.append(a / (a + b))
        new = {c: [[(1 + sum(q for q, row in zip(w, v) if row[k] == x)) / (3 + sum(w)) for x in (-1, 0, 1)] for k in range(9)] for c, w in ((1, post), (0, [1 - q for q in post]))}
        for k in range(9):
            if new[1][k][2] - new[1][k][0] < new[0][k][2] - new[0][k][0]:
                new[1][k] = new[0][k] = [(a + b) / 2 for a, b in zip(new[1][k], new[0][k])]
        moved = max(abs(a - b) for c in (0, 1) for x, y in zip(new[c], p[c]) for a, b in zip(x, y))
        p, share = new, (sum(post) + 0.9) / (len(post) + 1)
        if moved < 1e-7:
            break
    want = sorted(round(x, 6) for x in post)
    assert want == pytest.approx(sorted(round(g.quality, 6) for g in got if g.n_words), abs=1e-5)
    assert all(g.kept == (not g.base_failed and g.quality >= 0.5) for g in got)
    junk = rules.measures(" ".join("w%d" % (i % 100) for i in range(10_000)))[1]
    assert rules.votes(np.array([junk]))[0][list(rules.RULES).index("distinct_words")] == -1


def test_jaccard(spark, docs, rows):
    got = jaccard.join(docs).toPandas()
    grams = []
    for r in rows:
        w = split(r[1])
        grams.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    a = np.array([[i != j and bool(x) and len(x & y) >= 0.8 * len(x | y) for j, y in enumerate(grams)] for i, x in enumerate(grams)])
    links = Counter((r[0], int(n)) for r, n in zip(rows, a.sum(1)))
    key = [None if np.isnan(k) else int(k) for k in got.doc_id]
    assert Counter(zip(key, got.n_links)) == links
    ids = [r[0] for r in rows]
    label = linked(a)
    want = {i: min(j for j, k in zip(ids, label) if k == m and j is not None) for i, m in zip(ids, label) if i is not None}
    assert {k: c for k, c in zip(key, got.class_id) if k is not None} == want
    left = jaccard.kept_rows(docs, jaccard.join(docs)).count()
    assert left == len({label[i] for i in range(len(rows)) if grams[i]}) + sum(not g for g in grams)
    assert jaccard.join(empty(spark)).count() == 0
    assert jaccard.root_depth(0.8) == 5


def test_trie_edges_join_what_shares_a_prefix(spark):
    """At each level, the edges' components are the texts that share a prefix of labels in some tree."""
    r = np.random.default_rng(9)
    labels = (r.integers(0, 6, (150, 2)).astype(np.uint64) << np.uint64(61)) | (r.integers(0, 1 << 7, (150, 2)).astype(np.uint64) << np.uint64(11))
    live = spark.createDataFrame([(i, [int(x) for x in row.view(np.int64)]) for i, row in enumerate(labels)], "k1 long, labels array<long>")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    edges = [tuple(e) for e in jaccard.trie_edges(live).collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for level in range(jaccard.LEVELS + 1):
        keep = np.uint64(jaccard.LEVEL_BITS * (jaccard.LEVELS - level))
        cut = labels >> keep
        a = (cut[:, None, :, None] == cut[None, :, None, :]).any((2, 3))
        b = np.zeros((150, 150), bool)
        for x, y, at in edges:
            if at >= level:
                b[x, y] = b[y, x] = True
        assert linked(a).tolist() == linked(b).tolist()


def test_near_copies_are_all_found(spark):
    """Texts of many lengths and similarities from 0.8 up: the forest finds the links that brute force finds."""
    r = np.random.default_rng(10)
    texts_ = []
    for k in range(40):
        base = ["w%d" % x for x in r.integers(0, 5000, int(r.choice([12, 40, 150, 600])))]
        texts_.append(base)
        for _ in range(4):
            new = list(base)
            for at in r.choice(len(new), max(int(len(new) * r.choice([0.005, 0.015, 0.022])), 0), replace=False):
                new[at] = "x%d" % r.integers(10**6)
            texts_.append(new)
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts_]
    want = [sum(i != j and len(x & y) >= 0.8 * len(x | y) for j, y in enumerate(grams)) for i, x in enumerate(grams)]
    got = jaccard.join(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts_)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [g.n_links for g in got] == want and sum(want) > 200


def test_verification_is_one_python_step(spark, monkeypatch):
    """Each Python step that a stage chains costs its executor one more worker for every task it runs at once."""
    seen, whole = [], jaccard.settle
    monkeypatch.setattr(jaccard, "settle", lambda df, tag: (seen.append(df) if tag == "links" else None, whole(df, tag))[1])
    base = text(100)
    got = jaccard.join(spark.createDataFrame([(1, base), (1, base), (2, base + " a"), (3, base + " b")], "doc_id long, text string")).toPandas()
    assert sorted(zip(got.doc_id, got.n_links, got.class_id)) == [(1, 3, 1), (1, 3, 1), (2, 3, 1), (3, 3, 1)]
    for df in seen:
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("MapInArrow") == 2, plan  # one on each side of the shuffle: n-grams, links
    assert seen


def test_repeats_in_a_block_count_once():
    """Across batches too: rows repeated in the input come one after another."""
    names = ["part", "i", "j", "mine", "sub", "rep", "grams"]
    batches = [pa.RecordBatch.from_arrays([*([pa.array([0] * len(r))] * 5), pa.array(r), pa.array([b"x"] * len(r))], names=names) for r in ([1, 1, 2], [2, 2], [], [2, 3], [1])]
    assert [x for b in jaccard._once(iter(batches)) for x in b.column(5).to_pylist()] == [1, 2, 3, 1]


def test_sketch_is_not_kept_by_workers(tmp_path):
    """Nor is what it was unpacked from, if that can be read again."""
    bits, want = 16, np.random.default_rng(1).integers(0, 256, (substrings.ROWS, (1 << 16) // 8)).astype(np.uint8)
    parts = [(row, s, zstandard.compress(x.tobytes(), 1)) for row, r in enumerate(want) for s, x in enumerate(np.split(r, substrings.SHARDS))]
    with (tmp_path / "sent").open("wb") as f:
        pickle.dump(parts, f)
    shared = Broadcast(path=str(tmp_path / "sent"))
    common.forget()
    for _ in range(2):
        assert (substrings.opened(shared, bits) == want).all()
        assert not common._slot and "_value" not in vars(shared)


def test_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    base = text(200).split()
    many = [(i, " ".join(base[: i + 5] + ["z%d" % i] + base[i + 6 :])) for i in range(60)]
    got = jaccard.join(spark.createDataFrame(many, "doc_id long, text string")).toPandas()
    assert (got.n_links == 59).all() and (got.class_id == 0).all()


def frame(rows_, columns):
    out = rows_[sorted(columns)].astype(object)
    return Counter(tuple(None if pd.isna(x) else x for x in r) for r in out.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(spark, rows):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, duck, name):
    a, b = queries.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas(), duck.sql(queries.ORACLES[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and frame(a, a.columns) == frame(b, b.columns)


@pytest.mark.parametrize("name", ["op1_mix_sources", "op5_substring_dedup"])
def test_edge_cases_equal_sql(spark, docs, name, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    a, b = queries.QUERIES[name](spark, str(tmp_path)).toPandas(), con.sql(queries.ORACLES[name]).df()
    assert frame(a, a.columns) == frame(b, b.columns)


def test_rule_counts(spark, docs, rows):
    got = rules.weigh(docs).toPandas()
    want = Counter()
    for r in rows:
        t = r[1] or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        c = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
        rep = len({k for i in range(len(ws) - 2) if c[tuple(ws[i : i + 3])] > 1 for k in range(i, i + 3)})
        want[(r[0], len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep, len(ws) < 50 or 100 * rep > 50 * len(ws))] += 1
    names = ["doc_id", *rules.COUNTS, "base_failed"]
    assert Counter(tuple(None if pd.isna(x) else x for x in r) for r in got[names].astype(object).itertuples(index=False)) == want


def quoted_parts(passage):
    parts = [passage, *re.split(r"\n[ \t]*\n", passage), *[x for x in passage.split("\n") if len(x) >= chat.LEAST_LINE]]
    return list(dict.fromkeys(x for x in (" ".join(p.lower().split()) for p in parts) if x))


def test_chat_equals_brute_force(spark):
    r = np.random.default_rng(5)
    convs = []
    for conv in range(12):
        said = []
        for turn in range(int(r.integers(1, 25))):
            lines = []
            for _ in range(int(r.integers(0, 3))):
                if said:
                    old = said[int(r.integers(len(said)))].split("\n")
                    lo = int(r.integers(len(old)))
                    lines += ["> " + x if r.random() < 0.9 else ">" + x for x in old[lo : lo + int(r.integers(1, 4))]]
            lines += [text(int(r.integers(0, 6))) for _ in range(int(r.integers(0, 4)))]
            said.append("\n".join(lines))
        convs += [(conv, k, "u", t) for k, t in enumerate(said)]
    want, bodies = {}, {}
    for conv, turn, _, t in convs:
        runs, body, last = [], [], 0
        for line in t.split("\n"):
            marks = re.match(r"(?:[ \t]{0,3}>)*", line).group()
            level = marks.count(">")
            plain = re.sub(r"^[ \t]", "", line[len(marks) :]) if level else line
            if not level:
                body.append(line)
            elif level == last:
                runs[-1][1].append(plain)
            else:
                runs.append((level, [plain]))
            last = level
        hits = []
        for level, ls in runs:
            for k, x in enumerate(quoted_parts("\n".join(ls))):
                origin = bodies.get((conv, x))
                if origin is not None and origin < turn:
                    hits.append((level, min(k, 1), -origin))
        for x in quoted_parts("\n".join(body).strip()):
            bodies.setdefault((conv, x), turn)
        parent = -min(hits)[2] if hits else None
        root, depth = (want[conv, parent][1], want[conv, parent][2] + 1) if hits else (turn, 0)
        want[conv, turn] = (parent, root, depth, len(runs), "\n".join(body).strip())
    got = chat.link(spark.createDataFrame(convs, "conv_id long, turn long, role string, text string")).collect()
    assert {(g.conv_id, g.turn): (g.parent_turn, g.root_turn, g.depth, g.n_quotes, g.text) for g in got} == want
    assert max(w[2] for w in want.values()) > 3
    for conv in range(12):
        own = sorted((g for g in got if g.conv_id == conv), key=lambda g: g.position)
        assert [g.position for g in own] == list(range(len(own))) and [(g.root_turn, g.turn) for g in own] == sorted((g.root_turn, g.turn) for g in own)


def brute_classes(texts):
    grams = []
    for t in texts:
        w = split(t)
        grams.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    a = np.array([[i != j and bool(x) and len(x & y) >= 0.8 * len(x | y) for j, y in enumerate(grams)] for i, x in enumerate(grams)])
    return linked(a)


def brute_trimmed(texts):
    ws = [split(t) for t in texts]
    c = Counter(tuple(w[i : i + 35]) for w in ws for i in range(len(w) - 34))
    out = []
    for t, w in zip(texts, ws):
        gone = {k for i in range(len(w) - 34) if c[tuple(w[i : i + 35])] > 1 for k in range(i, i + 35)}
        left = b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
        out.append(None if gone and not left else (True, left) if gone else (False, t))
    return out


def check_stage(spark, name, before, out):
    """A stage's rows against brute force over the rows it was given."""
    import corpus_pipeline

    rows_ = [tuple(r) for r in before.select(*corpus_pipeline.COLUMNS).collect()]
    got = Counter(tuple(r) for r in out.collect())
    if name == "language_id":
        bare = before.select(*corpus_pipeline.COLUMNS)
        found = language.tagged(bare, language.learn(language.training(bare))).collect()
        assert got == Counter((r.doc_id, r.text, r.lang_pred, r.source, r.n_chars) for r in found if r.lang_pred != "und" and r.score >= 0.5)
    elif name == "jaccard_join":
        label = brute_classes([r[1] for r in rows_])
        of = {}
        for r, k in zip(rows_, label):
            of.setdefault(int(k), []).append(r)
        assert sum(got.values()) == len(of)
        for members in of.values():
            mine = [r for r in members if r in got]
            assert mine and (None in {r[0] for r in members} or min(r[0] for r in mine) == min(r[0] for r in members))
    elif name == "substring_dedup":
        want = Counter()
        for r, new in zip(rows_, brute_trimmed([r[1] for r in rows_])):
            if new is not None:
                want[(r[0], new[1], *r[2:4], len(new[1]) if new[0] else r[4])] += 1
        assert got == want
    elif name == "mix_sources":
        con = duckdb.connect()
        before.select(*corpus_pipeline.COLUMNS).toPandas().astype({"doc_id": "Int64", "n_chars": "Int64"}).pipe(lambda d: con.register("documents", d))
        taken = con.sql(queries.ORACLES["op1_mix_sources"]).fetchall()
        want = Counter()
        for doc, size, *_, words_, source in taken:
            want[doc, source] += words_ // size if size else 0
        have = Counter()
        for r, n in got.items():
            have[r[0], r[3]] += n
        assert have == +want
    else:
        assert set(out.columns) >= {"doc_id", "piece", "sequence_id", "offset"}


def test_stages_on_edge_cases(spark, docs, rows):
    import corpus_pipeline

    wide = docs.withColumns({c: F.lit("x") for c in ("row_key", "at", "n_words", "lang_pred", "_key", "taken", "copies")})
    wide = wide.union(spark.createDataFrame([(*rows[0][:2], "de", "other", 2, 7, 0.5, *["y"] * 7), (2, rows[2][1] + " more", "de", "a", 1, 7, 0.5, *["y"] * 7)], wide.schema))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, wide, "")
        if k < 4:
            assert out.columns == corpus_pipeline.COLUMNS, name
        check_stage(spark, name, wide, out)
        assert stage(spark, wide.limit(0), "").count() == 0


def test_pipeline(spark, tmp_path):
    """Each stage over what its predecessor kept, as run() chains them, against brute force on its own input."""
    import corpus_pipeline

    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, given, "/root/testdata/sf0.001").write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        check_stage(spark, name, given, out)
        given = out
    before = common.settled()
    whole = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert common.settled() == before  # nothing but the last stage stays
    folder = Path(whole.inputFiles()[0].removeprefix("file:")).parent
    assert [p.name for p in folder.parent.iterdir() if not p.name.startswith(".")] == [corpus_pipeline.STAGES[-1][0]]
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert frame(whole.toPandas(), key) == frame(given.toPandas(), key)
    assert whole.count() > 0 and whole.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048
