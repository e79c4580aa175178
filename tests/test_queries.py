"""Every query with SQL against DuckDB on the smallest tables, and the invariants of the forecasts."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom import catalog
from driftloom.functions import scalar as S
from driftloom.operators import drift, grid, lens, points, rating, sequence, views
from driftloom.plans import evaluate as E
from driftloom.sources import tables

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, duck, name):
    a = catalog.QUERIES[name](spark, DIR).toPandas()
    b = duck.sql(catalog.ORACLES[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and len(a) == len(b)
    cols = sorted(a.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    for c in cols:
        if a[c].dtype.kind == "f" or b[c].dtype.kind == "f":
            assert np.allclose(a[c].astype(float), b[c].astype(float), atol=2e-6, equal_nan=True), c
        else:
            assert a[c].tolist() == b[c].tolist(), c


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_rows_only(spark, name):
    if name not in ("lens_fit", "drift_tuning"):
        assert catalog.QUERIES[name](spark, DIR).count() > 0


def test_uniform_scores_one(spark):
    got = catalog.QUERIES["uniform_fds"](spark, DIR).toPandas()
    assert np.allclose(got.fds, 1)


def test_frame_edges(spark):
    day = S.DAY_US
    df = spark.createDataFrame([(i, i * day) for i in range(3)], "id long, us long")
    assert [r.frame_id for r in grid.assign_frames(df).orderBy("id").collect()] == [0, 1, -1]


def test_frames_run_to_the_last_post(spark, tmp_path):
    e = spark.read.parquet(f"{DIR}/events.parquet").limit(50)
    late = e.withColumn("ts", F.expr("ts + interval 70 days"))
    e.unionByName(late).write.parquet(str(tmp_path / "events.parquet"))
    got = catalog.QUERIES["frame_range_join"](spark, str(tmp_path)).agg(F.sum("n"), F.max("frame_id")).first()
    assert got[0] >= 99 and got[1] >= 69


def test_null_and_nan_both_go(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, float("nan"))], "id long, x double")
    assert [r.id for r in points.drop_missing(df, "x").collect()] == [1]


@pytest.mark.parametrize("text,want", [("5,3", [5, 3]), ("score: 6", [6, 4]), ("", [4, 4]), ("7,8,9", [7, 8]), ("a,b", [4, 4]), ("4.5 , 2", [4.5, 2])])
def test_rating_parser(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(S.ratings(F.col("t"), 2, 4.0)).first()[0] == want


def test_one_place_gets_padding(spark):
    df = spark.createDataFrame([(1.0, 2.0)] * 3, "x double, y double")
    assert tuple(grid.bounds(df).first()) == (0.5, 1.5, 1.5, 2.5)


def test_mass_is_kept_beyond_the_edge(spark):
    g = 4
    p = spark.createDataFrame([(0, 3, 0.5), (2, 2, 0.5)], "r int, c int, p double")
    v = spark.createDataFrame([(0, 3, -1.0, 1.0), (2, 2, 1.0, 0.0)], "r int, c int, vr double, vc double")
    assert abs(drift.advected(p, v, g, drift.Params(step=5.0)).agg(F.sum("v")).first()[0] - 1) < 1e-9


def test_blur(spark):
    one = spark.createDataFrame([(0, 0, 1.0)], "r int, c int, v double")
    assert drift.diffused(one, 5, 0.05).collect() == one.collect()
    assert abs(drift.diffused(one, 5, 0.3).agg(F.sum("v")).first()[0] - 1) < 1e-9


def test_joined_step_equals_arrays(spark):
    p = tables.posts(spark, DIR)
    grids = drift._matrices(drift.weekly_grids(p, 8), 8)
    want = drift._roll(grids[-drift.Params().history :], drift.Params(), 8)
    got = {(r.r, r.c): r.p for r in drift.predict(p, 8).collect()}
    assert np.allclose([[got[i, j] for j in range(8)] for i in range(8)], want, atol=1e-9)


def _plain_refresh(pdf, frames, box, g, p):
    """Each frame's forecast from arrays of all posts: the window before it, or all before it where that is empty."""
    x0, x1, y0, y1 = box
    gx, gy = np.linspace(x0, x1, g), np.linspace(y0, y1, g)
    out = {}
    for f in frames:
        w = pdf[(pdf.frame_id >= max(f - p.history, 0)) & (pdf.frame_id < f)]
        w = w if len(w) else pdf[(pdf.frame_id >= 0) & (pdf.frame_id < f)]
        if not len(w):
            continue
        b = (w.us - w.us.min()) // (7 * S.DAY_US)
        grids = []
        for k in sorted(set(b)):
            one = w[b == k]
            v = np.exp(-((one.y.values[:, None] - gy) ** 2) / 0.08).T @ np.exp(-((one.x.values[:, None] - gx) ** 2) / 0.08)
            grids.append(v / v.sum())
        out[f] = drift._roll(np.array(grids[-p.history :]), p, g)
    return out


@pytest.mark.parametrize("history,gap", [(7, None), (10, None), (2, (9, 26)), (2, (3, 28))])
def test_refreshed_equals_plain_windows(spark, history, gap):
    p = drift.Params(history=history)
    df = tables.posts(spark, DIR)
    framed = grid.assign_frames(df).select("id", "us", "x", "y", "weight", "frame_id")
    if gap:
        framed = framed.filter(~F.col("frame_id").between(*gap))
    frames = spark.createDataFrame([(f,) for f in (0, 1, 8, 21, 27, 28, 29)], "frame_id long")
    box = grid.bounds(df)
    want = _plain_refresh(framed.toPandas(), [0, 1, 8, 21, 27, 28, 29], tuple(box.first()), 6, p)
    got = drift.refreshed(framed, frames, box, 6, p).toPandas()
    assert set(got.key) == set(want) and len(got) == 36 * len(want)
    for f, m in want.items():
        one = got[got.key == f].sort_values(["r", "c"])
        assert np.allclose(one.p.values.reshape(6, 6), m, atol=1e-9), f


def test_held_grids_are_sent_on(spark, monkeypatch):
    df = grid.assign_frames(tables.posts(spark, DIR))
    box = grid.bounds(df)
    want = grid.raw_grid(df, box, 5, 0.3, "frame_id").toPandas().sort_values(["key", "r", "c"])
    monkeypatch.setattr(grid, "HELD", 1)
    got = grid.raw_grid(df, box, 5, 0.3, "frame_id").toPandas().sort_values(["key", "r", "c"])
    assert np.allclose(got.v, want.v) and got.key.tolist() == want.key.tolist()


def test_overlapping_intervals(spark):
    p = spark.createDataFrame([(i, i * 10) for i in range(10)], "id long, us long")
    f = spark.createDataFrame([("a", -15, 35), ("b", 30, 31), ("c", 90, 90), ("d", 20, 95)], "k string, start long, end long")
    got = sorted((r.id, r.k) for r in points.in_intervals(p, f, 25).collect())
    assert got == sorted((i, k) for i in range(10) for k, a, b in (("a", -15, 35), ("b", 30, 31), ("d", 20, 95)) if a <= i * 10 < b)


def test_lens_recovers_a_linear_map(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5))
    y = x @ [1.0, -2.0, 0.5, 0.0, 3.0] + 1
    df = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))], "id long, embedding array<double>, y double")
    out = lens.project(df, lens.fit(df, ["y"]).copy() | {"dims": ["z"]}).toPandas()
    assert np.corrcoef(out.z, out.y)[0, 1] > 0.9999


def test_sequence_model_is_repeatable():
    s = np.random.default_rng(1).dirichlet(np.ones(9), 12)
    a, b = sequence.forecast(s, 3, 2, epochs=5), sequence.forecast(s, 3, 2, epochs=5)
    assert np.array_equal(a, b) and np.allclose(a.sum(1), 1)


def test_harness_and_record(spark, tmp_path):
    got = E.evaluate(tables.posts(spark, DIR), [E.Uniform(), E.HistoricalAverage(0.3)], E.Setting(10, 1.0, 1), str(tmp_path / "log"))
    assert got[0]["scores"]["field_density_score"] == pytest.approx(1)
    assert tables.records(spark, str(tmp_path / "log")).count() == 2


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"\nc', 0.5)], "id long, t string, x double")
    tables.write_csv(df, str(tmp_path / "c"))
    assert tables.csv(spark, str(tmp_path / "c"), df.schema).collect() == df.collect()
    np.savez(tmp_path / "v.npz", embeddings=np.eye(3))
    assert tables.array_files(spark, str(tmp_path / "v.npz")).count() == 3


def test_stream_frames_equal_batch(spark, tmp_path):
    from driftloom.streaming import frames

    src = tables.posts(spark, DIR).withColumn("ts", F.timestamp_micros("us"))
    src.write.parquet(str(tmp_path / "in"))
    q = frames.frame_counts(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("frames_out").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.start: r.n for r in spark.table("frames_out").collect()}
    want = {r.d: r.n for r in src.groupBy(F.date_trunc("day", "ts").alias("d")).agg(F.count("*").alias("n")).collect()}
    assert got and all(want[k] == v for k, v in got.items())


def test_rating_job_goes_on_where_it_stopped(spark, tmp_path):
    df = spark.createDataFrame([(i, f"sincerity {i % 7 + 1}, charity {i % 5 + 1}" if i % 9 else "x") for i in range(60)], "id long, text string")
    good = lens.Raters({"r": lambda prompts: [p.rsplit("\n\n", 1)[-1] for p in prompts]})
    kind = lens.LENSES["good_faith"]
    got = rating.job(df, kind, good, "r", str(tmp_path), 40, every=10).toPandas().sort_values("id")
    assert len(got) == 40 and got.id.is_unique
    for r in got.itertuples():
        if r.id % 9:
            assert (r.sincerity, r.charity, r.good_faith_score) == (r.id % 7 + 1, r.id % 5 + 1, (r.id % 7 + r.id % 5) / 2 + 1)
        else:
            assert r.error == "text too short" and np.isnan(r.sincerity)
    one = spark.read.json(f"{tmp_path}/summary").first()
    assert (one.total, one.failed) == (40, sum(i % 9 == 0 for i in got.id)) and one.succeeded == 40 - one.failed
    assert sorted(r.id for r in spark.read.json(f"{tmp_path}/manifest").collect()) == got.id.tolist()

    def down(prompts):
        raise RuntimeError("no answer")

    again = rating.job(df, kind, lens.Raters({"r": down}), "r", str(tmp_path), 40, every=10).toPandas().sort_values("id")
    assert again.error.fillna("").tolist() == got.error.fillna("").tolist()  # nothing was asked anew
    lost = rating.rated(df.filter("id = 1"), kind, lens.Raters({"r": down}), "r").first()
    assert lost.error == "no answer" and lost.sincerity is None and lost.good_faith_score is None


def test_held_out_correlation(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 4))
    y = x @ [1.0, -1.0, 0.5, 2.0] + rng.normal(size=500)
    df = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))], "id long, embedding array<double>, y double")
    table, model = rating.held_out(df, ["y"])
    test = np.arange(500) % 5 == 0
    a = np.column_stack([x, np.ones(500)])
    w = np.linalg.lstsq(a[~test], y[~test], rcond=None)[0]
    want = np.corrcoef(a[test] @ w, y[test])[0, 1]
    r = table.first()
    assert r.n == 100 and r.r == pytest.approx(want, abs=1e-4) and r.r_scaled == pytest.approx(r.r)
    assert np.allclose(model["x_mean"], x.mean(0))


def test_hashed_vectors(spark):
    df = spark.createDataFrame([(1, "b a b"), (2, None), (3, "")], "id long, text string")
    got = {r.id: np.array(r.embedding) for r in lens.hashed(df, 16).collect()}
    assert sorted(got[1][got[1] > 0]) in ([pytest.approx(5**-0.5), pytest.approx(2 * 5**-0.5)], [1.0]) and not got[2].any() and len(got[3]) == 16


def test_palette_ends(spark):
    got = spark.createDataFrame([(0.0,), (1.0,), (None,)], "n double").select(*[c.alias(k) for k, c in views.rgba(F.col("n")).items()]).collect()
    assert [tuple(r) for r in got] == [(*views.VIRIDIS[0], 255), (*views.VIRIDIS[-1], 255), (None, None, None, None)]
