"""Queries of the point, field and lens operators over the tables of a folder, each beside equivalent DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import drift, grid, lens, metrics, points, rating, views
from ..sources import tables
from . import evaluate as E

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Parameters of the registered forecasts.
G, TEST_WEEKS, SIGMA, BANDWIDTH = 20, 1, 0.3, 0.1
DAY = S.DAY_US

POSTS = """posts AS (SELECT event_id AS id, epoch_us(ts) AS us, CAST(ts AS DATE) AS day, value / 50::DOUBLE AS x,
 CAST(json_extract_string(props, '$.k') AS DOUBLE) / 20::DOUBLE AS y, user_id % 5 AS retweet_count, CAST(floor(value) AS BIGINT) AS favorite_count,
 CAST(user_id % 5 + floor(value) + 1 AS DOUBLE) AS weight, user_id AS author, event_type AS kind FROM events)"""
FRAMED = f"""span AS (SELECT min(us) AS t0, max(us) AS t1, max(us) - {TEST_WEEKS * 7 * DAY} AS cut FROM posts),
framed AS (SELECT p.*, CASE WHEN us = t1 AND us > t0 AND (us - t0) % {DAY} = 0 THEN -1 ELSE (us - t0) // {DAY} END AS frame_id, us < cut AS train FROM posts p, span)"""
BOX = """(SELECT min(x) - greatest(0.5::DOUBLE, (max(x) - min(x)) * 0.2::DOUBLE) AS x0, max(x) + greatest(0.5::DOUBLE, (max(x) - min(x)) * 0.2::DOUBLE) AS x1,
 min(y) - greatest(0.5::DOUBLE, (max(y) - min(y)) * 0.2::DOUBLE) AS y0, max(y) + greatest(0.5::DOUBLE, (max(y) - min(y)) * 0.2::DOUBLE) AS y1 FROM {})"""
CUT = lambda v, a, b, g: f"CAST(floor(least(greatest(({v} - {a}) / ({b} - {a}) * {g - 1}::DOUBLE, 0), {g - 1})) AS INTEGER)"
NEAR = lambda v, a, b, g: f"CAST(ceil(least(greatest(({v} - {a}) / ({b} - {a}) * {g - 1}::DOUBLE, 0), {g - 1}) - 0.5::DOUBLE) AS INTEGER)"


def cell_table(g: int) -> str:
    return f"cells AS (SELECT CAST(a.range AS INTEGER) AS r, CAST(b.range AS INTEGER) AS c FROM range({g}) a, range({g}) b)"


def kernel_sql(name: str, src: str, box: str, key: str, g: int, sigma: float, weight: str = "1") -> str:
    return f"""{name}_v AS (SELECT {key} AS key, r, c, sum({weight} * exp(-((x - (x0 + (x1 - x0) * c / {g - 1}::DOUBLE)) ** 2 + (y - (y0 + (y1 - y0) * r / {g - 1}::DOUBLE)) ** 2) / {2 * sigma * sigma}::DOUBLE)) AS v
 FROM {src}, {box}, cells GROUP BY ALL), {name} AS (SELECT key, r, c, v / sum(v) OVER (PARTITION BY key) AS p FROM {name}_v)"""


def query(sql: str | None = None, ctes: str = POSTS):
    """Registers a function of (spark, folder) under its name; sql follows the common table expressions."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH {ctes} {sql}" if ctes else sql
        return f

    return add


def posts(spark: SparkSession, d: str) -> DataFrame:
    return tables.posts(spark, d)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def setting() -> E.Setting:
    return E.Setting(G, 1.0, TEST_WEEKS)


@query("SELECT id, retweet_count * 1.0::DOUBLE + favorite_count + 1 AS importance FROM posts")
def importance_weight(spark, d):
    return posts(spark, d).select("id", S.importance(F.col("retweet_count"), F.col("favorite_count")).alias("importance"))


@query("SELECT id, x, y FROM posts")
def resolve_coords(spark, d):
    renamed = posts(spark, d).withColumnsRenamed({"x": "sincerity", "y": "charity"})
    return points.resolve_coords(renamed).select("id", "x", "y")


@query("SELECT id FROM (SELECT id, CASE WHEN id % 7 = 0 THEN NULL WHEN id % 11 = 0 THEN 'nan'::DOUBLE ELSE x END AS x FROM posts) WHERE x IS NOT NULL AND NOT isnan(x)")
def null_drop(spark, d):
    p = posts(spark, d).withColumn("x", F.when(F.col("id") % 7 == 0, F.lit(None)).when(F.col("id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("x")))
    return points.drop_missing(p, "x").select("id")


@query("SELECT id, x FROM posts WHERE us >= epoch_us(TIMESTAMP '2024-01-05') AND us <= epoch_us(TIMESTAMP '2024-01-20')")
def date_range(spark, d):
    return points.date_range(posts(spark, d), 1_704_412_800_000_000, 1_705_708_800_000_000).select("id", "x")


@query("""SELECT id, round(dist, 6) AS dist FROM (SELECT id, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS dist FROM posts, (SELECT avg(x) AS cx, avg(y) AS cy FROM posts))
 WHERE dist <= (SELECT quantile_cont(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)), 0.99) FROM posts, (SELECT avg(x) AS cx, avg(y) AS cy FROM posts)) + 1e-12""")
def outlier_prune(spark, d):
    return points.outlier_prune(posts(spark, d)).select("id", F.round("dist", 6).alias("dist"))


@query("SELECT doc_id, text IS NULL OR length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) < 10 AS short FROM documents", "")
def short_text(spark, d):
    return table(spark, d, "documents").select("doc_id", S.too_short(F.col("text")).alias("short"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS hover FROM documents", "")
def hover_text(spark, d):
    return table(spark, d, "documents").select("doc_id", S.truncated(F.col("text")).alias("hover"))


@query("SELECT p.id, p.x, d.source FROM posts p JOIN documents d ON d.doc_id = p.id")
def zip_join(spark, d):
    p = posts(spark, d)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source")
    return points.zip_strict(p.join(docs.select("id"), "id", "left_semi").select("id", "x"), docs.join(p.select("id"), "id", "left_semi"))


@query("""SELECT a.row, a.id, b.vec_id FROM (SELECT row_number() OVER (ORDER BY us, id) - 1 AS row, id FROM posts) a
 JOIN (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, vec_id FROM embeddings) b USING (row)""")
def zip_truncated(spark, d):
    a = points.numbered(posts(spark, d).select("us", "id"), "us", "id").select("row", "id")
    return a.join(points.numbered(table(spark, d, "embeddings").select("vec_id"), "vec_id"), "row").select("row", "id", "vec_id")


@query("SELECT vec_id, quality FROM embeddings JOIN labels ON vec_id = doc_id", "")
def gather_vectors(spark, d):
    return points.gather(table(spark, d, "embeddings"), table(spark, d, "labels"), "vec_id", "doc_id").select("vec_id", "quality")


@query("SELECT frame_id, count(*) AS n FROM framed GROUP BY 1", f"{POSTS}, {FRAMED}")
def frame_assign(spark, d):
    return grid.assign_frames(posts(spark, d)).groupBy("frame_id").agg(F.count("*").alias("n"))


@query(f"""SELECT f.k AS frame_id, count(*) AS n FROM (SELECT unnest(range((t1 - t0) // {DAY} + 1)) AS k FROM span) f, span, posts
 WHERE us >= t0 + f.k * {DAY} AND us < t0 + (f.k + 1) * {DAY} GROUP BY 1""", f"{POSTS}, {FRAMED}")
def frame_range_join(spark, d):
    p = posts(spark, d)
    t = p.agg(F.min("us").alias("t0"), F.max("us").alias("t1"))
    f = t.select(F.explode(F.sequence(F.lit(0), F.expr(f"(t1 - t0) div {DAY}"))).alias("frame_id"), "t0")
    f = f.select("frame_id", (F.col("t0") + F.col("frame_id") * DAY).alias("start"), (F.col("t0") + (F.col("frame_id") + 1) * DAY).alias("end"))
    return points.in_intervals(p, f, DAY).groupBy("frame_id").agg(F.count("*").alias("n"))


@query("""SELECT a.frame_id, CAST(coalesce(sum(b.n) FILTER (b.frame_id >= a.frame_id - 3), sum(b.n)) AS BIGINT) AS n FROM f a JOIN f b ON b.frame_id < a.frame_id GROUP BY 1""",
       f"{POSTS}, {FRAMED}, f AS (SELECT frame_id, count(*) AS n FROM framed GROUP BY 1)")
def history_sliding(spark, d):
    f = grid.assign_frames(posts(spark, d)).groupBy("frame_id").agg(F.count("*").alias("n"))
    w = W.orderBy("frame_id")
    near, all_ = F.sum("n").over(w.rangeBetween(-3, -1)), F.sum("n").over(w.rangeBetween(W.unboundedPreceding, -1))
    return f.select("frame_id", F.coalesce(near, all_).alias("n")).filter("n is not null")


@query("SELECT a.frame_id, CAST(sum(b.n) AS BIGINT) AS n FROM f a JOIN f b ON b.frame_id < a.frame_id GROUP BY 1", f"{POSTS}, {FRAMED}, f AS (SELECT frame_id, count(*) AS n FROM framed GROUP BY 1)")
def history_expanding(spark, d):
    f = grid.assign_frames(posts(spark, d)).groupBy("frame_id").agg(F.count("*").alias("n"))
    return f.select("frame_id", F.sum("n").over(W.orderBy("frame_id").rowsBetween(W.unboundedPreceding, -1)).alias("n")).filter("n is not null")


@query(f"SELECT * FROM {BOX.format('posts')}")
def bounds_global(spark, d):
    return grid.bounds(posts(spark, d))


@query("SELECT frame_id, " + BOX.format("framed GROUP BY frame_id")[8:-1].replace("FROM framed", "FROM framed"), f"{POSTS}, {FRAMED}")
def bounds_frame(spark, d):
    return grid.bounds(grid.assign_frames(posts(spark, d)), "frame_id")


@query("SELECT round(avg(x), 8) AS cx, round(avg(y), 8) AS cy FROM posts")
def centroid(spark, d):
    return posts(spark, d).agg(F.round(F.avg("x"), 8).alias("cx"), F.round(F.avg("y"), 8).alias("cy"))


@query("SELECT strftime(date_trunc('week', day), '%Y-%m-%d') AS week, count(*) AS n FROM posts GROUP BY 1")
def weekly_counts(spark, d):
    return posts(spark, d).groupBy(F.date_format(F.date_trunc("week", "day"), "yyyy-MM-dd").alias("week")).agg(F.count("*").alias("n"))


@query("SELECT CAST(week(day) AS INTEGER) AS iso_week, count(*) AS n FROM posts GROUP BY 1")
def iso_week_counts(spark, d):
    return posts(spark, d).groupBy(F.weekofyear("day").alias("iso_week")).agg(F.count("*").alias("n"))


@query("""SELECT count(DISTINCT day) AS total_days, count(*) AS total_posts, strftime(min(day), '%Y-%m-%d') AS first_day, strftime(max(day), '%Y-%m-%d') AS last_day,
 count(*) / count(DISTINCT day)::DOUBLE AS per_day, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM posts""")
def timeline_meta(spark, d):
    return posts(spark, d).agg(F.countDistinct("day").alias("total_days"), F.count("*").alias("total_posts"), F.date_format(F.min("day"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("day"), "yyyy-MM-dd").alias("last_day"), (F.count("*") / F.countDistinct("day")).alias("per_day"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))


def _timeline(p: DataFrame) -> DataFrame:
    e = F.col("retweet_count") + F.col("favorite_count")
    size = S.marker_size(e)
    return p.select(F.date_format("day", "yyyy-MM-dd").alias("date"), "id", "x", "y", "favorite_count", "retweet_count", "author", F.lit(0).alias("age_days"), F.round(size, 6).alias("base_size"), F.round(size, 6).alias("final_size"), F.lit(1.0).alias("opacity"))


@query("""SELECT strftime(day, '%Y-%m-%d') AS date, id, x, y, favorite_count, retweet_count, author, 0 AS age_days, round(CASE WHEN e = 0 THEN 1 ELSE log10(e + 1) * 1.5::DOUBLE + 1 END, 6) AS base_size,
 round(CASE WHEN e = 0 THEN 1 ELSE log10(e + 1) * 1.5::DOUBLE + 1 END, 6) AS final_size, 1.0::DOUBLE AS opacity FROM (SELECT *, retweet_count + favorite_count AS e FROM posts)""")
def timeline_frames(spark, d):
    return _timeline(posts(spark, d))


@query("SELECT strftime(day, '%Y-%m-%d') AS date, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM posts GROUP BY 1")
def timeline_nested(spark, d):
    n = _timeline(posts(spark, d)).groupBy("date").agg(F.sort_array(F.collect_list(F.struct("id", "x", "y", "final_size"))).alias("posts"))
    return n.select("date", F.size("posts").cast("long").alias("n"), F.array_join(F.transform("posts", lambda p: p.id.cast("string")), ",").alias("ids"))


@query("SELECT id, round(CASE WHEN e = 0 THEN 1 ELSE log10(e + 1) * 1.5::DOUBLE + 1 END, 8) AS size FROM (SELECT id, retweet_count + favorite_count AS e FROM posts)")
def marker_size(spark, d):
    return posts(spark, d).select("id", F.round(S.marker_size(F.col("retweet_count") + F.col("favorite_count")), 8).alias("size"))


@query(f"SELECT r, c, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 9) AS p FROM (SELECT {NEAR('y', 'y0', 'y1', G)} AS r, {NEAR('x', 'x0', 'x1', G)} AS c FROM posts, {BOX.format('posts')}) GROUP BY r, c")
def point_mass_grid(spark, d):
    p = posts(spark, d).withColumn("grp", F.lit(0))
    return grid.point_mass(p, grid.bounds(p), G, "grp").select("r", "c", F.round("p", 9).alias("p"))


@query(f"SELECT id, {CUT('y', 'y0', 'y1', G)} AS r, {CUT('x', 'x0', 'x1', G)} AS c FROM posts, {BOX.format('posts')}")
def cell_truncate(spark, d):
    p = posts(spark, d)
    return grid.located(p, grid.bounds(p), G).select("id", "r", "c")


def _kernel_query(name: str, sigma: float, weight: str | None):
    def f(spark, d):
        p = posts(spark, d).withColumn("grp", F.lit(0))
        return grid.density(p, grid.bounds(p), 10, sigma, weight=F.col(weight) if weight else None).select("r", "c", F.round("p", 9).alias("p"))

    f.__name__ = name
    query("SELECT r, c, round(p, 9) AS p FROM k", f"{POSTS}, {cell_table(10)}, {kernel_sql('k', 'posts', BOX.format('posts'), '0', 10, sigma, weight or '1')}")(f)


_kernel_query("kde_grid", 0.3, None)
_kernel_query("weighted_grid", 0.25, "weight")


@query(f"SELECT r, c, round(v / sum(v) OVER (), 9) AS p FROM (SELECT r, c, sum(w * exp(-((x - (x0 + (x1 - x0) * c / 9::DOUBLE)) ** 2 + (y - (y0 + (y1 - y0) * r / 9::DOUBLE)) ** 2) / 0.18::DOUBLE)) AS v FROM (SELECT *, weight * exp(-(t1 - us) / {3 * DAY}::DOUBLE) AS w FROM posts, span), {BOX.format('posts')}, cells GROUP BY ALL)", f"{POSTS}, {FRAMED}, {cell_table(10)}")
def decay_kde(spark, d):
    p = posts(spark, d)
    t = p.agg(F.max("us").alias("t1"))
    aged = p.crossJoin(F.broadcast(t)).withColumns({"grp": F.lit(0), "w": F.col("weight") * F.exp(-(F.col("t1") - F.col("us")) / F.lit(3.0 * DAY))})
    return grid.density(aged, grid.bounds(p), 10, 0.3, weight=F.col("w")).select("r", "c", F.round("p", 9).alias("p"))


TEST = f"""{POSTS}, {FRAMED}, {cell_table(G)}, train AS (SELECT * FROM framed WHERE train), box AS {BOX.format('train')},
wanted AS (SELECT frame_id FROM framed WHERE frame_id >= 0 GROUP BY 1 HAVING max(us) > (SELECT max(us) FROM train)),
test AS (SELECT f.*, {CUT('y', 'y0', 'y1', G)} AS r, {CUT('x', 'x0', 'x1', G)} AS c, {NEAR('y', 'y0', 'y1', G)} AS nr, {NEAR('x', 'x0', 'x1', G)} AS nc FROM framed f JOIN wanted USING (frame_id), box),
truth AS (SELECT frame_id AS key, nr AS r, nc AS c, count(*) / sum(count(*)) OVER (PARTITION BY frame_id)::DOUBLE AS p FROM test GROUP BY 1, 2, 3)"""
FDS = f"SELECT frame_id, round(sum(weight * coalesce(p, 0)) * {G * G} / sum(weight), 6) AS fds, count(*) AS n FROM test LEFT JOIN pred USING (r, c) GROUP BY 1"
HISTORY = f"{TEST}, {kernel_sql('pred', 'train', 'box', '0', G, BANDWIDTH)}"


def _scored(spark, d, model):
    s = E.split(posts(spark, d), setting())
    test = s.framed.join(F.broadcast(s.frames.select("frame_id")), "frame_id")
    f = metrics.fds(grid.located(test, s.box, G), model.predict(s), G, per_frame=model.per_frame)
    return f.select("frame_id", F.round("fds", 6).alias("fds"), "n")


@query(FDS, f"{TEST}, pred AS (SELECT r, c, 1 / {G * G}::DOUBLE AS p FROM cells)")
def uniform_fds(spark, d):
    return _scored(spark, d, E.Uniform())


@query(FDS, HISTORY)
def history_fds(spark, d):
    return _scored(spark, d, E.HistoricalAverage(BANDWIDTH))


@query(f"SELECT frame_id, round(sum(weight * coalesce(p, 0)) * {G * G} / sum(weight), 6) AS fds, count(*) AS n FROM test LEFT JOIN pred ON pred.key = frame_id AND pred.r = test.r AND pred.c = test.c GROUP BY 1",
       f"""{TEST}, {kernel_sql('raw', '(SELECT * FROM framed WHERE frame_id >= 0)', 'box', 'frame_id', G, SIGMA, 'weight')},
 summed AS (SELECT w.frame_id AS key, r, c, sum(v) AS v FROM wanted w JOIN raw_v ON raw_v.key < w.frame_id GROUP BY ALL), pred AS (SELECT key, r, c, v / sum(v) OVER (PARTITION BY key) AS p FROM summed)""")
def gaussian_fds(spark, d):
    return _scored(spark, d, E.GaussianHistory(SIGMA))


REFRESHED = f"""{TEST}, {kernel_sql('raw', '(SELECT * FROM framed WHERE frame_id >= 0)', 'box', 'frame_id', G, 0.2)},
 summed AS (SELECT w.frame_id AS key, r, c, sum(v) AS v FROM wanted w JOIN raw_v ON raw_v.key < w.frame_id AND raw_v.key >= w.frame_id - 7 GROUP BY ALL), pred AS (SELECT key, r, c, v / sum(v) OVER (PARTITION BY key) AS p FROM summed)"""


@query(f"SELECT frame_id, round(sum(weight * coalesce(p, 0)) * {G * G} / sum(weight), 5) AS fds, count(*) AS n FROM test LEFT JOIN pred ON pred.key = frame_id AND pred.r = test.r AND pred.c = test.c GROUP BY 1", REFRESHED)
def drift_refresh(spark, d):
    """At the default seven daily frames a window is one group of seven days, so its forecast is that group's grid."""
    return _scored(spark, d, E.DriftField()).select("frame_id", F.round("fds", 5).alias("fds"), "n")


KL = f"""j AS (SELECT k.key, (coalesce(t.p, 0) + 1e-10::DOUBLE) AS a, (pred.p + 1e-10::DOUBLE) AS b FROM (SELECT DISTINCT key FROM truth) k CROSS JOIN cells
 LEFT JOIN truth t ON t.key = k.key AND t.r = cells.r AND t.c = cells.c JOIN pred ON pred.r = cells.r AND pred.c = cells.c),
kls AS (SELECT key AS frame_id, sum(a * ln(a / b)) AS kl FROM (SELECT key, a / sum(a) OVER (PARTITION BY key) AS a, b / sum(b) OVER (PARTITION BY key) AS b FROM j) GROUP BY 1)"""


@query("SELECT frame_id, round(kl, 6) AS kl FROM kls", f"{HISTORY}, {KL}")
def kl_by_frame(spark, d):
    s = E.split(posts(spark, d), setting())
    test = s.framed.join(F.broadcast(s.frames.select("frame_id")), "frame_id")
    k = metrics.kl(grid.point_mass(test, s.box, G, "frame_id"), E.HistoricalAverage(BANDWIDTH).predict(s), G, False)
    return k.select(F.col("key").alias("frame_id"), F.round("kl", 6).alias("kl"))


@query("""SELECT round(sum(fds * n) / sum(n), 5) AS field_density_score, round(sum(kl * n) / sum(n), 5) AS kl_divergence, round(stddev_pop(fds), 5) AS score_std, count(*) AS frames_evaluated,
 CAST(sum(n) AS BIGINT) AS total_test_posts FROM f JOIN kls USING (frame_id)""", f"{HISTORY}, {KL}, f AS ({FDS.replace('round(', '(').replace(', 6)', ')')})")
def score_summary(spark, d):
    r = metrics.summary(E.scores(E.HistoricalAverage(BANDWIDTH), E.split(posts(spark, d), setting())))
    return r.select(*[F.round(c, 5).alias(c) for c in ("field_density_score", "kl_divergence", "score_std")], "frames_evaluated", "total_test_posts")


@query("SELECT round(sum(-weight * ln(coalesce(p, 0) + 1e-8::DOUBLE)) / sum(weight), 6) AS nll FROM test LEFT JOIN pred USING (r, c)", HISTORY)
def nll_metric(spark, d):
    s = E.split(posts(spark, d), setting())
    test = s.framed.join(F.broadcast(s.frames.select("frame_id")), "frame_id")
    return metrics.nll(grid.located(test, s.box, G), E.HistoricalAverage(BANDWIDTH).predict(s)).select(F.round("nll", 6).alias("nll"))


@query("SELECT CASE WHEN train THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM framed GROUP BY 1", f"{POSTS}, {FRAMED}")
def temporal_split(spark, d):
    return points.temporal_split(posts(spark, d), TEST_WEEKS).groupBy("part").agg(F.count("*").alias("n"))


@query("SELECT frame_id, count(*) AS n FROM framed JOIN wanted USING (frame_id) GROUP BY 1", TEST)
def test_frames(spark, d):
    return E.split(posts(spark, d), setting()).frames


@query(f"SELECT dense_rank() OVER (ORDER BY b) - 1 AS grp, count(*) AS n FROM (SELECT (us - t0) // {7 * DAY} AS b FROM posts, span WHERE (us - t0) // {7 * DAY} <> 1) GROUP BY b", f"{POSTS}, {FRAMED}")
def weekly_groups(spark, d):
    p = posts(spark, d)
    t0 = p.agg(F.min("us").alias("_m"))
    gap = p.crossJoin(F.broadcast(t0)).filter(F.expr(f"(us - _m) div {7 * DAY}") != 1)
    return points.weekly_groups(gap).groupBy("grp").agg(F.count("*").alias("n"))


DG = 12
DRIFT = f"""{POSTS}, {cell_table(DG)}, span AS (SELECT min(us) AS t0 FROM posts), grouped AS (SELECT p.*, dense_rank() OVER (ORDER BY (us - t0) // {7 * DAY}) - 1 AS grp FROM posts p, span),
{kernel_sql('week', 'grouped', BOX.format('posts'), 'grp', DG, 0.2)}, weekly AS (SELECT key, r, c, round(p, 12) AS p FROM week),
near AS (SELECT n.key, n.r, n.c, o.di, o.dj, m.p AS prev FROM weekly n, (SELECT a.range - 1 AS di, b.range - 1 AS dj FROM range(3) a, range(3) b WHERE a.range <> 1 OR b.range <> 1) o JOIN weekly m
 ON m.key = n.key - 1 AND m.r = n.r + o.di AND m.c = n.c + o.dj WHERE n.p >= 0.001::DOUBLE),
velo AS (SELECT key, r, c, di / sqrt(di * di + dj * dj)::DOUBLE AS vr, dj / sqrt(di * di + dj * dj)::DOUBLE AS vc FROM (SELECT *, row_number() OVER (PARTITION BY key, r, c ORDER BY prev DESC, di, dj) AS k FROM near) WHERE k = 1),
last AS (SELECT max(key) AS l FROM weekly)"""
AVERAGE = """recent AS (SELECT v.* FROM velo v, last WHERE key > l - 6), steps AS (SELECT DISTINCT key, 0.8::DOUBLE ** (l - key) AS w FROM recent, last), tw AS (SELECT sum(w) AS tw FROM steps),
mean AS (SELECT r, c, sum(vr * w) / min(tw) AS vr, sum(vc * w) / min(tw) AS vc FROM recent JOIN steps USING (key), tw GROUP BY 1, 2)"""
#: The forecast's fixed values, stated here apart from the operator's; BLUR_SIGMA is wide enough for taps.
P, MOVED, STEP, BLUR_SIGMA = drift.Params(), 0.28, 1.0, 0.6
ADVECT = f"""tgt AS (SELECT g.r, g.c, g.p, least(greatest(g.r + coalesce(vr, 0) * {STEP}::DOUBLE, 0), {DG - 1 - 1e-6}::DOUBLE) AS tr, least(greatest(g.c + coalesce(vc, 0) * {STEP}::DOUBLE, 0), {DG - 1 - 1e-6}::DOUBLE) AS tc
 FROM (SELECT w.* FROM weekly w, last WHERE key = l AND p >= 1e-10::DOUBLE) g LEFT JOIN mean USING (r, c)),
parts AS (SELECT r, c, p * {1 - MOVED}::DOUBLE AS v FROM tgt UNION ALL SELECT CAST(floor(tr) AS INTEGER) + a.range, CAST(floor(tc) AS INTEGER) + b.range,
 p * {MOVED}::DOUBLE * CASE WHEN a.range = 1 THEN tr - floor(tr) ELSE 1 - tr + floor(tr) END * CASE WHEN b.range = 1 THEN tc - floor(tc) ELSE 1 - tc + floor(tc) END FROM tgt, range(2) a, range(2) b),
adv AS (SELECT r, c, sum(v) AS v FROM parts GROUP BY 1, 2)"""
TAPS = f"taps AS (SELECT d, w / sum(w) OVER () AS w FROM (SELECT range - 2 AS d, exp(-(range - 2) * (range - 2) / {2 * BLUR_SIGMA**2}::DOUBLE) AS w FROM range(5)))"
FOLD = lambda v: f"CASE WHEN {v} < 0 THEN -({v}) - 1 WHEN {v} >= {DG} THEN {2 * DG - 1} - ({v}) ELSE {v} END"
BLUR = f"{TAPS}, rows_ AS (SELECT {FOLD('r + d')} AS r, c, sum(v * w) AS v FROM adv, taps GROUP BY 1, 2), blurred AS (SELECT r, {FOLD('c + d')} AS c, sum(v * w) AS v FROM rows_, taps GROUP BY 1, 2)"


def _weekly(spark, d):
    return drift.weekly_grids(posts(spark, d), DG)


@query("SELECT key, r, c, round(vr, 9) AS vr, round(vc, 9) AS vc FROM velo", DRIFT)
def velocity_field(spark, d):
    return drift.velocities(_weekly(spark, d), DG).select("key", "r", "c", F.round("vr", 9).alias("vr"), F.round("vc", 9).alias("vc"))


def _recent(spark, d):
    p = drift.Params()
    return drift.fitted(posts(spark, d), DG, p)


@query("SELECT r, c, round(vr, 9) AS vr, round(vc, 9) AS vc FROM mean", f"{DRIFT}, {AVERAGE}")
def velocity_avg(spark, d):
    return _recent(spark, d)[1].select("r", "c", F.round("vr", 9).alias("vr"), F.round("vc", 9).alias("vc"))


@query("SELECT r, c, round(v, 9) AS v FROM adv", f"{DRIFT}, {AVERAGE}, {ADVECT}")
def advect_step(spark, d):
    g, v = _recent(spark, d)
    return drift.advected(g, v, DG, P).select("r", "c", F.round("v", 9).alias("v"))


@query("SELECT r, c, round(v, 9) AS v FROM blurred", f"{DRIFT}, {AVERAGE}, {ADVECT}, {BLUR}")
def diffuse_step(spark, d):
    g, v = _recent(spark, d)
    return drift.diffused(drift.advected(g, v, DG, P), DG, BLUR_SIGMA).select("r", "c", F.round("v", 9).alias("v"))


@query("SELECT CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, round(coalesce(v, 0) / (SELECT sum(v) FROM adv), 8) AS p FROM cells LEFT JOIN adv USING (r, c)", f"{DRIFT}, {AVERAGE}, {ADVECT}")
def drift_predict(spark, d):
    return drift.predict(posts(spark, d), DG, P).select("r", "c", F.round("p", 8).alias("p"))


AGAIN = (
    f"once AS (SELECT CAST(cells.r AS INTEGER) AS r, CAST(cells.c AS INTEGER) AS c, coalesce(v, 0) / (SELECT sum(v) FROM adv) AS p FROM cells LEFT JOIN adv USING (r, c)), "
    + ADVECT.replace("(SELECT w.* FROM weekly w, last WHERE key = l AND p >= 1e-10::DOUBLE)", "(SELECT * FROM once WHERE p >= 1e-10::DOUBLE)").replace("tgt", "tgt2").replace("parts", "parts2").replace("adv AS", "adv2 AS")
)


@query("SELECT CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, round(coalesce(v, 0) / (SELECT sum(v) FROM adv2), 7) AS p FROM cells LEFT JOIN adv2 USING (r, c)", f"{DRIFT}, {AVERAGE}, {ADVECT}, {AGAIN}")
def drift_rollout(spark, d):
    return drift.predict(posts(spark, d), DG, P, steps=2).select("r", "c", F.round("p", 7).alias("p"))


@query()
def drift_tuning(spark, d):
    p, score = drift.tuned(posts(spark, d), DG, 8, 4)
    return spark.createDataFrame([(k, float(v)) for k, v in p.asdict().items()] + [("fds", score)], "name string, value double")


@query("SELECT round(corr(n, nx), 8) AS lag1, count(*) AS pairs FROM (SELECT n, lead(n) OVER (ORDER BY frame_id) AS nx FROM (SELECT frame_id, count(*) AS n FROM framed GROUP BY 1)) WHERE nx IS NOT NULL", f"{POSTS}, {FRAMED}")
def frame_autocorr(spark, d):
    return metrics.autocorrelation(grid.assign_frames(posts(spark, d))).select(F.round("lag1", 8).alias("lag1"), "pairs")


@query(f"SELECT a.key, round(sum(abs(a.p - b.p)) / {DG * DG}, 10) AS mean_abs_diff FROM weekly a JOIN weekly b ON b.key = a.key - 1 AND a.r = b.r AND a.c = b.c GROUP BY 1", DRIFT)
def frame_diff(spark, d):
    return metrics.frame_difference(_weekly(spark, d), DG).select("key", F.round("mean_abs_diff", 10).alias("mean_abs_diff"))


@query("""SELECT frame_id, round(move, 7) AS move FROM (SELECT frame_id, sqrt((cx - lag(cx) OVER o) ** 2 + (cy - lag(cy) OVER o) ** 2) AS move FROM (SELECT frame_id, avg(x) AS cx, avg(y) AS cy FROM framed GROUP BY 1)
 WINDOW o AS (ORDER BY frame_id)) WHERE move IS NOT NULL""", f"{POSTS}, {FRAMED}")
def com_movement(spark, d):
    return metrics.centre_movement(grid.assign_frames(posts(spark, d))).select("frame_id", F.round("move", 7).alias("move"))


@query("SELECT key, round(stddev_pop(p), 10) AS std, round(min(p), 10) AS low, round(max(p), 10) AS high FROM weekly GROUP BY 1", DRIFT)
def grid_diversity(spark, d):
    return metrics.diversity(_weekly(spark, d)).select("key", *[F.round(c, 10).alias(c) for c in ("std", "low", "high")])


@query("SELECT id, (x - (SELECT min(x) FROM posts)) / ((SELECT max(x) FROM posts) - (SELECT min(x) FROM posts)) AS norm FROM posts")
def minmax_norm(spark, d):
    return points.min_max(posts(spark, d), "x").select("id", "norm")


@query("SELECT id FROM posts ORDER BY md5(CAST(id AS VARCHAR) || ':42'), id LIMIT 500")
def sample_exact(spark, d):
    return points.sample_exact(posts(spark, d), 500).select("id")


@query("SELECT CASE WHEN id % 5 = 0 THEN 'test' ELSE 'train' END AS part, count(*) AS n FROM posts GROUP BY 1")
def train_test_split(spark, d):
    return points.split_by_hash(posts(spark, d)).groupBy("part").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, coalesce(CAST(nullif(a, '') AS DOUBLE), CAST(nullif(b, '') AS DOUBLE), 4) AS first, CASE WHEN a <> '' AND b <> '' THEN CAST(b AS DOUBLE) ELSE 4 END AS second FROM (SELECT doc_id,
 regexp_extract(quality || ' pts', '\\b(\\d+(?:\\.\\d+)?)\\b', 1) AS a, regexp_extract('score ' || toxic, '\\b(\\d+(?:\\.\\d+)?)\\b', 1) AS b FROM labels)""", "")
def rating_parse(spark, d):
    a = F.concat(F.col("quality").cast("string"), F.lit(" pts,score "), F.col("toxic").cast("string"))
    r = table(spark, d, "labels").withColumn("r", S.ratings(a, 2, 4.0))
    return r.select("doc_id", F.col("r")[0].alias("first"), F.col("r")[1].alias("second"))


@query("SELECT doc_id, (quality + toxic) / 2::DOUBLE AS score FROM labels", "")
def composite_score(spark, d):
    return lens.scored(table(spark, d, "labels"), ["quality", "toxic"]).select("doc_id", "score")


@query("SELECT quality AS value, count(*) AS n FROM labels GROUP BY 1", "")
def rating_summary(spark, d):
    return lens.rating_summary(table(spark, d, "labels"), "quality")


@query("SELECT round(corr(quality, embedding[1]), 6) AS r FROM embeddings JOIN labels ON vec_id = doc_id", "")
def lens_corr(spark, d):
    j = points.gather(table(spark, d, "embeddings"), table(spark, d, "labels"), "vec_id", "doc_id")
    return j.agg(F.round(F.corr("quality", F.col("embedding")[0].cast("double")), 6).alias("r"))


@query("SELECT pos, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM (SELECT CAST(unnest(embedding) AS DOUBLE) AS v, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos FROM embeddings) GROUP BY 1", "")
def embed_moments(spark, d):
    return lens.moments(table(spark, d, "embeddings")).select("pos", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query()
def lens_fit(spark, d):
    j = points.gather(table(spark, d, "embeddings"), table(spark, d, "labels"), "vec_id", "doc_id")
    m = lens.fit(j, ["quality", "toxic"], 1e-3)
    return spark.createDataFrame([(i, *map(float, w)) for i, w in enumerate(m["weights"])], "pos int, quality double, toxic double")


LENS = [((i * 7) % 11 - 5) / 10 for i in range(64)]


@query(
       f"SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), {LENS}::DOUBLE[]), 4) AS lens FROM embeddings", "")
def lens_project(spark, d):
    import numpy as np

    m = {"weights": np.array(LENS)[:, None], "intercept": np.zeros(1), "x_mean": np.zeros(64), "x_std": np.ones(64), "dims": ["lens"]}
    return lens.project(table(spark, d, "embeddings"), m).select("vec_id", F.round("lens", 4).alias("lens"))


@query()
def pca_2d(spark, d):
    v = table(spark, d, "embeddings")
    return lens.project(v, lens.principal(v)).select("vec_id", "x", "y")


SITES = [(0.5, 1.0), (1.0, 3.0), (2.0, 2.0), (0.2, 4.5), (4.0, 1.5)]
_SITE = ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE)" for i, (a, b) in enumerate(SITES))


@query(f"SELECT id, site, round(sd, 8) AS site_dist FROM (SELECT id, site, sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)) AS sd, row_number() OVER (PARTITION BY id ORDER BY sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)), site) AS k FROM posts, (VALUES {_SITE}) t(site, sx, sy)) WHERE k = 1")
def nearest_site(spark, d):
    return points.nearest_site(posts(spark, d), SITES).select("id", "site", F.round("site_dist", 8).alias("site_dist"))


@query(f"""SELECT region_id, n, round(n / t::DOUBLE, 8) AS rate, round(n / t::DOUBLE * dens, 8) AS score FROM (SELECT site AS region_id, count(*) AS n, min((site + 1) * 0.2::DOUBLE) AS dens FROM posts, (VALUES {_SITE}) s(site, sx, sy)
 WHERE sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)) <= 0.8::DOUBLE GROUP BY 1), (SELECT count(*) AS t FROM posts)""")
def region_capture(spark, d):
    p = posts(spark, d)
    regions = spark.createDataFrame([(i, a, b, 0.8, (i + 1) * 0.2) for i, (a, b) in enumerate(SITES)], "region_id int, cx double, cy double, radius double, dens double")
    held = p.join(F.broadcast(regions), S.distance(F.col("x"), F.col("y"), F.col("cx"), F.col("cy")) <= F.col("radius")).groupBy("region_id").agg(F.count("*").alias("n"), F.min("dens").alias("dens"))
    rate = F.col("n") / F.col("t")
    return held.crossJoin(F.broadcast(p.agg(F.count("*").alias("t")))).select("region_id", "n", F.round(rate, 8).alias("rate"), F.round(rate * F.col("dens"), 8).alias("score"))


@query(f"SELECT p.id, min(site) AS region_id, count(*) AS n_regions FROM posts p, (VALUES {_SITE}) s(site, sx, sy) WHERE sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)) <= 0.8::DOUBLE GROUP BY 1")
def region_first(spark, d):
    regions = spark.createDataFrame([(i, a, b, 0.8) for i, (a, b) in enumerate(SITES)], "region_id int, cx double, cy double, radius double")
    return points.first_match(posts(spark, d), regions)


@query("SELECT id, round(s, 8) AS score, CASE WHEN s >= 0.7 THEN 'high' WHEN s >= 0.3 THEN 'middle' ELSE 'low' END AS class FROM (SELECT id, exp(-0.5::DOUBLE * sqrt((x - 0.6::DOUBLE) * (x - 0.6::DOUBLE) + (y - 2.5::DOUBLE) * (y - 2.5::DOUBLE))) AS s FROM posts)")
def harshness(spark, d):
    s, k = S.harshness(S.distance(F.col("x"), F.col("y"), F.lit(0.6), F.lit(2.5)), 0.5)
    return posts(spark, d).select("id", F.round(s, 8).alias("score"), k.alias("class"))


@query("SELECT id, round(0.6::DOUBLE * exp(-((x - 1) ** 2 / 0.25::DOUBLE + (y - 2) ** 2 / 1::DOUBLE) / 2) / (2 * pi() * 0.5::DOUBLE) + 0.4::DOUBLE * exp(-((x - 0.5::DOUBLE) ** 2 + (y - 4) ** 2 / 0.25::DOUBLE) / 2) / (2 * pi() * 0.5::DOUBLE), 8) AS pdf FROM posts")
def mixture_pdf(spark, d):
    x, y = F.col("x"), F.col("y")
    return posts(spark, d).select("id", F.round(S.normal_pdf(x, y, 1.0, 2.0, 0.5, 1.0) * 0.6 + S.normal_pdf(x, y, 0.5, 4.0, 1.0, 0.5) * 0.4, 8).alias("pdf"))


@query("SELECT id, CASE WHEN s < 0.3 THEN 'core' WHEN s < 0.6 THEN 'near' WHEN s < 1.0 THEN 'edge' ELSE 'outside' END AS class FROM (SELECT id, sqrt((x - 0.6::DOUBLE) * (x - 0.6::DOUBLE) + (y - 2.5::DOUBLE) * (y - 2.5::DOUBLE)) AS s FROM posts)")
def distance_class(spark, d):
    return posts(spark, d).select("id", S.distance_class(S.distance(F.col("x"), F.col("y"), F.lit(0.6), F.lit(2.5))).alias("class"))


@query("SELECT id, CAST(floor(255 * n) AS INTEGER) AS red, CAST(floor(255 * (1 - n)) AS INTEGER) AS blue FROM (SELECT id, (x - (SELECT min(x) FROM posts)) / ((SELECT max(x) FROM posts) - (SELECT min(x) FROM posts)) AS n FROM posts)")
def colour_ramp(spark, d):
    n = points.min_max(posts(spark, d), "x", "n")
    return n.select("id", F.floor(255 * F.col("n")).cast("int").alias("red"), F.floor(255 * (1 - F.col("n"))).cast("int").alias("blue"))


@query("SELECT frame_id, ids[1] AS first, ids[5] AS last, n AS target FROM (SELECT frame_id, n, list(n) OVER (ORDER BY frame_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS ids FROM (SELECT frame_id, count(*) AS n FROM framed GROUP BY 1)) WHERE len(ids) = 5", f"{POSTS}, {FRAMED}")
def sequences(spark, d):
    n = grid.assign_frames(posts(spark, d)).groupBy("frame_id").agg(F.count("*").alias("n"))
    return grid.sequences(n, 5, "n").select("frame_id", F.col("inputs")[0].alias("first"), F.col("inputs")[4].alias("last"), "target")


@query("SELECT strftime(date_trunc('week', day), '%Y-%m-%d') AS week, count(*) AS n, round(min(x) - (max(x) - min(x)) * 0.1::DOUBLE, 9) AS x_low, round(max(x) + (max(x) - min(x)) * 0.1::DOUBLE, 9) AS x_high FROM posts GROUP BY 1")
def weekly_frames(spark, d):
    pad = (F.max("x") - F.min("x")) * 0.1
    return posts(spark, d).groupBy(F.date_format(F.date_trunc("week", "day"), "yyyy-MM-dd").alias("week")).agg(F.count("*").alias("n"), F.round(F.min("x") - pad, 9).alias("x_low"), F.round(F.max("x") + pad, 9).alias("x_high"))


@query("SELECT kind, count(*) AS n, avg(CAST(favorite_count AS DOUBLE)) AS mean, max(favorite_count) AS most, count(*) FILTER (favorite_count = 0) AS zeros FROM posts GROUP BY 1")
def dataset_stats(spark, d):
    f = F.col("favorite_count")
    return posts(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.avg(f).alias("mean"), F.max(f).alias("most"), F.count_if(f == 0).alias("zeros"))


@query()
def sequence_forecast(spark, d):
    s = E.split(posts(spark, d), E.Setting(8, 1.0, TEST_WEEKS))
    return E.SequenceForecast(length=5, sigma=0.3, epochs=20).predict(s)


@query()
def synthetic_clusters(spark, d):
    return tables.synthetic_posts(spark).groupBy("cluster").agg(F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))


@query()
def pareto_counts(spark, d):
    return tables.pareto_counts(spark.range(2000))


@query("SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS n, round(avg(x), 8) AS cx FROM posts GROUP BY 1")
def daily_frames(spark, d):
    return posts(spark, d).groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.round(F.avg("x"), 8).alias("cx"))


_FAR = [*SITES, (9.0, 9.0)]
_PLACE = ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE)" for i, (a, b) in enumerate(_FAR))


@query(f"""SELECT place, id, round(dist, 8) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY dist, id) AS k FROM (SELECT place, id, sqrt((x - a) * (x - a) + (y - b) * (y - b)) AS dist
 FROM posts, (VALUES {_PLACE}) t(place, a, b))) WHERE k = 1 AND dist < 0.5""")
def hover_nearest(spark, d):
    return views.hover(posts(spark, d), _FAR).select("place", "id", F.round("dist", 8).alias("dist"))


def _stop(i: int) -> str:
    at = [f"{s[i]}::DOUBLE" for s in views.VIRIDIS]
    return f"CAST(floor([{', '.join(at)}][k + 1] + ([{', '.join(at)}][k + 2] - [{', '.join(at)}][k + 1]) * (u - k) + 1e-9) AS INTEGER)"


@query(f"""SELECT id, x, y, round(dist, 8) AS dist, {_stop(0)} AS r, {_stop(1)} AS g, {_stop(2)} AS b, 255 AS a, 1::DOUBLE AS size, CAST(week(day) AS INTEGER) AS week
 FROM (SELECT *, CAST(least(floor(u), 8) AS INTEGER) AS k FROM (SELECT *, least(floor((dist - min(dist) OVER ()) / (max(dist) OVER () - min(dist) OVER ()) * 256), 255) / 255::DOUBLE * 9 AS u
 FROM (SELECT p.*, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS dist FROM posts p, (SELECT avg(x) AS cx, avg(y) AS cy FROM posts))))""")
def point_frame(spark, d):
    return views.point_frame(posts(spark, d)).withColumn("dist", F.round("dist", 8))


@query("SELECT coalesce(a.key + 1, b.key) AS key, coalesce(a.r, b.r) AS r, coalesce(a.c, b.c) AS c, round(coalesce(a.p, 0), 9) AS predicted, round(coalesce(b.p, 0), 9) AS true FROM weekly a FULL JOIN weekly b ON b.key = a.key + 1 AND a.r = b.r AND a.c = b.c", DRIFT)
def heat_pair(spark, d):
    w = _weekly(spark, d)
    out = views.heat_pair(w.withColumn("key", F.col("key") + 1), w)
    return out.select("key", "r", "c", F.round("predicted", 9).alias("predicted"), F.round("true", 9).alias("true"))


@query(f"""SELECT w.key * 2 + half AS step, w.key, w.r, w.c, round(w.p, 9) AS p, CASE WHEN half = 1 THEN coalesce(n, 0) ELSE -1 END AS n FROM weekly w CROSS JOIN (VALUES (0), (1)) h(half) LEFT JOIN
 (SELECT grp AS key, {CUT("y", "y0", "y1", DG)} AS r, {CUT("x", "x0", "x1", DG)} AS c, count(*) AS n FROM grouped, {BOX.format("posts")} GROUP BY ALL) q ON q.key = w.key AND q.r = w.r AND q.c = w.c""", DRIFT)
def animation_frames(spark, d):
    p = posts(spark, d)
    framed = points.weekly_groups(p).withColumnRenamed("grp", "frame_id")
    return views.animation(_weekly(spark, d), framed, grid.bounds(p), DG).withColumns({"p": F.round("p", 9), "n": F.coalesce("n", F.lit(-1))})


@query(f"""SELECT w AS window, count(*) AS n, round(avg(x), 8) AS cx, round(avg(y), 8) AS cy FROM posts, (SELECT min(us) AS t0, max(us) AS t1 FROM posts), (SELECT range AS w FROM range(10000))
 WHERE us >= t0 + w * {7 * DAY} AND us < t0 + (w + 2) * {7 * DAY} GROUP BY 1 HAVING count(*) >= 100""")
def landscape_windows(spark, d):
    return views.landscapes(posts(spark, d)).select("window", "n", F.round("cx", 8).alias("cx"), F.round("cy", 8).alias("cy"))


@query("""SELECT 'post.final_size' AS field, 'present' AS old, 'missing' AS new UNION ALL SELECT 'frames.' || strftime(day, '%Y-%m-%d'), CAST(count(*) AS VARCHAR), CAST(count(*) FILTER (id % 50 <> 3) AS VARCHAR) FROM posts
 GROUP BY day HAVING count(*) FILTER (id % 50 = 3) > 0""")
def timeline_validation(spark, d):
    old = _timeline(posts(spark, d))
    return views.timeline_differences(old, old.filter("id % 50 <> 3").drop("final_size"))


_OFFLINE = lens.Lens("offline", ("quality", "toxic"), (0, 1), 4)


def _rated(spark, d):
    """Labels rated by a back-end that needs no network: it answers with the numbers that its text holds."""
    raters = lens.Raters({"offline": lambda prompts: [p.rsplit("\n\n", 1)[-1] for p in prompts]})
    text = F.format_string("quality %d, toxic %d", "quality", "toxic")
    src = table(spark, d, "labels").select("doc_id", F.when(F.col("doc_id") % 10 != 0, text).otherwise("short").alias("text"))
    return rating.rated(src, _OFFLINE, raters, "offline")


_LABELLED = "r AS (SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN CAST(quality AS DOUBLE) END AS quality, CASE WHEN doc_id % 10 <> 0 THEN CAST(toxic AS DOUBLE) END AS toxic FROM labels)"


@query("SELECT doc_id, quality, toxic, CASE WHEN quality IS NULL THEN 'text too short' END AS error, (quality + toxic) / 2 AS offline_score FROM r", _LABELLED)
def rating_job(spark, d):
    return _rated(spark, d).select("doc_id", "quality", "toxic", "error", "offline_score")


@query("SELECT count(*) AS total, count(quality) AS succeeded, count(*) - count(quality) AS failed, round(avg(quality), 9) AS mean_quality, round(avg(toxic), 9) AS mean_toxic, round(avg((quality + toxic) / 2), 9) AS mean_offline_score FROM r", _LABELLED)
def rating_totals(spark, d):
    out = rating.summary(_rated(spark, d), _OFFLINE)
    return out.select(*[F.round(c, 9).alias(c) if c.startswith("mean") else c for c in out.columns])


@query("SELECT 'quality' AS dim, quality AS value, count(*) AS n FROM r WHERE quality IS NOT NULL GROUP BY 2 UNION ALL SELECT 'toxic', toxic, count(*) FROM r WHERE toxic IS NOT NULL GROUP BY 2", _LABELLED)
def rating_distribution(spark, d):
    return rating.distributions(_rated(spark, d), _OFFLINE)


@query()
def lens_holdout(spark, d):
    j = points.gather(table(spark, d, "embeddings"), table(spark, d, "labels"), "vec_id", "doc_id")
    return rating.held_out(j, ["quality", "toxic"], 1e-3, "doc_id")[0]


_COLS = {"quality": "quality", "toxic": "toxic", "e1": "embedding[1]", "e2": "embedding[2]"}


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({x}, {y}), 6) AS r FROM embeddings JOIN labels ON vec_id = doc_id" for a, x in _COLS.items() for b, y in _COLS.items()), "")
def corr_matrix(spark, d):
    j = points.gather(table(spark, d, "embeddings"), table(spark, d, "labels"), "vec_id", "doc_id")
    j = j.select("quality", "toxic", F.col("embedding")[0].alias("e1"), F.col("embedding")[1].alias("e2"))
    return rating.correlations(j, list(_COLS)).select("a", "b", F.round("r", 6).alias("r"))


@query("SELECT kind, count(*) AS n, count(*) FILTER (favorite_count = 0) AS zeros, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL AND author IS NOT NULL) AS complete FROM posts GROUP BY 1")
def present_counts(spark, d):
    whole = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("author").isNotNull()
    return posts(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("favorite_count") == 0).alias("zeros"), F.count_if(whole).alias("complete"))


@query("SELECT event_id, coalesce(epoch_us(TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'not a time' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP)), -1) AS us FROM events", "")
def parse_times(spark, d):
    e = table(spark, d, "events").withColumn("t", F.when(F.col("event_id") % 7 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))
    return e.withColumn("t", S.parsed_time(F.col("t"))).select("event_id", F.coalesce(S.micros("t"), F.lit(-1)).alias("us"))


@query("SELECT id, kind, round(exp(x - max(x) OVER w) / sum(exp(x)) OVER w * exp(max(x) OVER w), 10) AS share FROM posts WINDOW w AS (PARTITION BY kind)")
def softmax_by_kind(spark, d):
    return metrics.softmax(posts(spark, d), "x", "kind").select("id", "kind", F.round("share", 10).alias("share"))


@query("SELECT id, kind, round(greatest(x - 0.5::DOUBLE, 0) / sum(greatest(x - 0.5::DOUBLE, 0)) OVER (PARTITION BY kind), 10) AS share FROM posts")
def clamped_shares(spark, d):
    v = posts(spark, d).withColumn("v", F.col("x") - 0.5)
    return metrics.renormalised(v, "v", "kind").select("id", "kind", F.round("share", 10).alias("share"))


@query("SELECT id, CASE WHEN p > 0.1 THEN 'dense' WHEN p > 0.05 THEN 'middle' ELSE 'sparse' END AS class FROM (SELECT id, exp(-((x - 1) ** 2 / 0.25::DOUBLE + (y - 2) ** 2 / 1::DOUBLE) / 2) / (2 * pi() * 0.5::DOUBLE) AS p FROM posts)")
def density_class(spark, d):
    return posts(spark, d).select("id", S.density_class(S.normal_pdf(F.col("x"), F.col("y"), 1.0, 2.0, 0.5, 1.0)).alias("class"))


@query("SELECT id, us < cut AS early FROM framed, span", f"{POSTS}, {FRAMED}".replace("us < cut AS train", "us < cut AS train_"))
def row_union(spark, d):
    parts = points.temporal_split(posts(spark, d), TEST_WEEKS)
    early, late = (parts.filter(F.col("part") == p).select("id", F.lit(p == "train").alias("early")) for p in ("train", "test"))
    return early.unionByName(late)
