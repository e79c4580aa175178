"""The drift-field forecast: weekly grids, velocities, advection and diffusion, as joins of cells."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import DAY_US
from .grid import bounds, cells, density, normalised
from .points import weekly_groups


@dataclass
class Params:
    """Defaults are fixed values; `decay` scales all cells alike, so it drops out where a forecast is normalised."""

    persistence: float = 0.6
    momentum: float = 0.7
    step: float = 1.0
    diffusion: float = 0.05
    decay: float = 0.01
    window: int = 3
    history: int = 7
    importance: float = 1.5

    def asdict(self) -> dict:
        return asdict(self)


#: Bounds of the search, as (low, high), fixed values; whole numbers for the window and the history.
SPACE = {"history": (2, 10), "decay": (0.001, 0.8), "step": (0.1, 3.0), "momentum": (0.1, 0.95), "persistence": (0.1, 0.9), "window": (2, 6), "diffusion": (0.001, 0.5), "importance": (1.0, 3.0)}
#: Groups from which tuning makes sense.
LEAST_GROUPS = 3


def weekly_grids(df: DataFrame, g: int, sigma: float = 0.2, days: int = 7) -> DataFrame:
    """(key, r, c, p) of each group, rounded so that ties in the velocity are the same on every run."""
    grid = density(weekly_groups(df, days), bounds(df), g, sigma)
    return grid.withColumn("p", F.round("p", 12))


def velocities(grids: DataFrame, g: int, window: int = 3, least: float = 0.001, forward: bool = False) -> DataFrame:
    """(key, r, c, vr, vc): from each dense cell towards the neighbour with the largest product of its earlier density
    and the cell's own; the first in row order of equals. It points to where the mass came from unless `forward`."""
    h = window // 2
    offsets = F.explode(F.array(*[F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj")) for i in range(-h, h + 1) for j in range(-h, h + 1) if i or j]))
    now = grids.filter(F.col("p") >= least).withColumn("o", offsets).select("key", "r", "c", (F.col("key") - 1).alias("pk"), (F.col("r") + F.col("o.di")).alias("nr"), (F.col("c") + F.col("o.dj")).alias("nc"), "o.di", "o.dj")
    past = grids.select(F.col("key").alias("pk"), F.col("r").alias("nr"), F.col("c").alias("nc"), F.col("p").alias("prev"))
    best = now.join(past, ["pk", "nr", "nc"]).groupBy("key", "r", "c").agg(F.max(F.struct("prev", (-F.col("di")).alias("a"), (-F.col("dj")).alias("b"))).alias("m"))
    sign = -1.0 if forward else 1.0
    di, dj = -F.col("m.a"), -F.col("m.b")
    n = F.sqrt((di * di + dj * dj).cast("double"))
    return best.select("key", "r", "c", (di / n * sign).alias("vr"), (dj / n * sign).alias("vc"))


def averaged(v: DataFrame, last: int, decay: float = 0.8) -> DataFrame:
    """(r, c, vr, vc): means over steps, each older one counting `decay` times as much; a step without a velocity counts as none."""
    steps = v.select("key").distinct().withColumn("w", F.pow(F.lit(decay), F.lit(last) - F.col("key")))
    total = steps.agg(F.sum("w").alias("tw"))
    j = v.join(F.broadcast(steps), "key").crossJoin(F.broadcast(total))
    return j.groupBy("r", "c").agg((F.sum(F.col("vr") * F.col("w")) / F.first("tw")).alias("vr"), (F.sum(F.col("vc") * F.col("w")) / F.first("tw")).alias("vc"))


def advected(grid: DataFrame, v: DataFrame, g: int, p: Params) -> DataFrame:
    """(r, c, v): each cell keeps a share and sends the rest along its velocity to the four cells around the target."""
    j = grid.filter("p >= 1e-10").join(v, ["r", "c"], "left").fillna(0.0, ["vr", "vc"])
    moved = (1 - p.persistence) * p.momentum
    top = F.lit(g - 1 - 1e-6)
    j = j.withColumns({"tr": F.least(F.greatest(F.col("r") + F.col("vr") * p.step, F.lit(0.0)), top), "tc": F.least(F.greatest(F.col("c") + F.col("vc") * p.step, F.lit(0.0)), top)})
    j = j.withColumns({"fr": F.floor("tr").cast("int"), "fc": F.floor("tc").cast("int")}).withColumns({"ar": F.col("tr") - F.col("fr"), "ac": F.col("tc") - F.col("fc")})
    out = [F.struct(F.col("r").alias("r"), F.col("c").alias("c"), (F.col("p") * (1 - moved)).alias("v"))]
    for a in (0, 1):
        for b in (0, 1):
            w = (F.col("ar") if a else 1 - F.col("ar")) * (F.col("ac") if b else 1 - F.col("ac"))
            out.append(F.struct((F.col("fr") + a).alias("r"), (F.col("fc") + b).alias("c"), (F.col("p") * moved * w).alias("v")))
    e = j.select(F.explode(F.array(*out)).alias("e")).select("e.*")
    return e.groupBy("r", "c").agg(F.sum("v").alias("v"))


def kernel(sigma: float) -> list[float]:
    """Weights of a Gaussian at whole offsets up to floor(4 sigma + 0.5); one weight if that is 0."""
    import math

    n = int(4 * sigma + 0.5)
    w = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-n, n + 1)] if sigma > 0 else [1.0]
    return [x / sum(w) for x in w]


def diffused(grid: DataFrame, g: int, sigma: float) -> DataFrame:
    """(r, c, v) blurred along rows, then columns, with edges reflected; two sums of exploded offsets."""
    w = kernel(sigma)
    n = len(w) // 2
    if not n:
        return grid
    taps = F.explode(F.array(*[F.struct(F.lit(k - n).alias("d"), F.lit(x).alias("w")) for k, x in enumerate(w)]))
    for axis in ("r", "c"):
        other = "c" if axis == "r" else "r"
        e = grid.withColumn("t", taps).withColumn("_i", F.col(axis) + F.col("t.d"))
        e = e.withColumn("_i", F.when(F.col("_i") < 0, -F.col("_i") - 1).when(F.col("_i") >= g, 2 * g - 1 - F.col("_i")).otherwise(F.col("_i")))
        grid = e.groupBy(F.col("_i").alias(axis), other).agg(F.sum(F.col("v") * F.col("t.w")).alias("v"))
    return grid.select("r", "c", "v")


def step(grid: DataFrame, v: DataFrame, g: int, p: Params) -> DataFrame:
    """The next frame's (r, c, p) from (r, c, p). Decay scales all cells alike and drops out in the normalising."""
    out = diffused(advected(grid, v, g, p), g, p.diffusion)
    full = cells(grid.sparkSession, g).join(out, ["r", "c"], "left").fillna(0.0, ["v"]).withColumn("key", F.lit(0))
    return normalised(full, g).drop("key")


def fitted(df: DataFrame, g: int, p: Params, sigma: float = 0.2, days: int = 7) -> tuple[DataFrame, DataFrame]:
    """(last grid, averaged velocities) of the last `history` groups."""
    grids = weekly_grids(df, g, sigma, days).persist()
    last = grids.agg(F.max("key")).first()[0]
    grids = grids.filter(F.col("key") > last - p.history)
    return grids.filter(F.col("key") == last).select("r", "c", "p"), averaged(velocities(grids, g, p.window), last)


def predict(df: DataFrame, g: int, p: Params | None = None, steps: int = 1, sigma: float = 0.2, days: int = 7) -> DataFrame:
    """(r, c, p) so many steps ahead; a roll-out of several steps is checkpointed at each where the session has a folder for it."""
    p = p or Params()
    grid, v = fitted(df, g, p, sigma, days)
    for k in range(steps):
        grid = step(grid, v, g, p)
        if k < steps - 1 and grid.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            grid = grid.checkpoint()
    return grid


def refreshed(framed: DataFrame, frames: DataFrame, box: DataFrame, g: int, p: Params | None = None, frame_days: float = 1.0, sigma: float = 0.2, days: int = 7) -> DataFrame:
    """(key, r, c, p): the forecast of each wanted frame from the posts of the `history` frames before it.

    A frame whose window holds no post sees all posts before it; one with none before it has no rows. A window's posts
    are grouped by `days` from its own first post, and the last `history` groups count. A post serves at most `history`
    frames (as a window) or groups (as a history), so posts are multiplied by that and summed into partial grids at
    once; what each frame's roll-forward reads is its groups' grids. frames(frame_id) and groups grow with time alone.
    """
    p = p or Params()
    step_us = days * DAY_US
    posts = framed.filter("frame_id >= 0").select("frame_id", "us", "x", "y")
    wanted = frames.select(F.col("frame_id").cast("long").alias("key")).distinct()
    firsts = posts.groupBy(F.col("frame_id").alias("key")).agg(F.min("us").alias("us"))
    both = firsts.select("key", "us", F.lit(False).alias("asked")).unionByName(wanted.select("key", F.lit(None).cast("long").alias("us"), F.lit(True).alias("asked")))
    by_time = W.orderBy("key")
    windows = both.select(
        "key", "asked", F.min("us").over(by_time.rangeBetween(-p.history, -1)).alias("near"), F.min("us").over(by_time.rangeBetween(W.unboundedPreceding, -1)).alias("t0")
    ).filter("asked and t0 is not null")
    slid = windows.filter("near is not null").select("key", F.col("near").alias("t0"))
    near = posts.withColumn("key", F.explode(F.sequence(F.col("frame_id") + 1, F.col("frame_id") + p.history))).join(F.broadcast(slid), "key")
    near = near.select("key", F.expr(f"(us - t0) div {step_us}").alias("bin"), "x", "y")
    binned = posts.crossJoin(F.broadcast(posts.agg(F.min("us").alias("t0")))).withColumn("bin", F.expr(f"(us - t0) div {step_us}"))
    bins = binned.groupBy("bin").agg(F.min("frame_id").alias("first"))
    whole = windows.filter("near is null").select("key").join(F.broadcast(bins), F.col("first") < F.col("key"))
    whole = whole.withColumn("k", F.row_number().over(W.partitionBy("key").orderBy(F.desc("bin")))).filter(F.col("k") <= p.history).select("key", "bin")
    far = binned.join(F.broadcast(whole), "bin").filter("frame_id < key").select("key", "bin", "x", "y")
    parts = near.unionByName(far).withColumn("grp", F.shiftleft("key", 24) + F.col("bin"))
    grids = density(parts, box, g, sigma).withColumn("p", F.round("p", 12))

    def run(key, t):
        import numpy as np
        import pandas as pd

        at, inside = np.unique(t["key"].to_numpy(), return_inverse=True)
        m = np.zeros((len(at), g, g))
        m[inside, t["r"].to_numpy(), t["c"].to_numpy()] = t["p"].to_numpy()
        r, c = np.divmod(np.arange(g * g, dtype=np.int32), g)
        return pd.DataFrame({"key": np.int64(key[0]), "r": r, "c": c, "p": _roll(m[-p.history :], p, g).ravel()})

    return grids.groupBy(F.shiftright("key", 24).alias("frame")).applyInPandas(run, "key long, r int, c int, p double")


def _matrices(grids: DataFrame, g: int):
    """The last groups' grids as arrays for the search; groups times g * g numbers, bounded by the history."""
    import numpy as np

    got = grids.select("key", "r", "c", "p").toArrow()
    key, r, c, p = (got.column(i).to_numpy() for i in range(4))
    keys, at = np.unique(key, return_inverse=True)
    out = np.zeros((len(keys), g, g))
    out[at, r, c] = p
    return out


def _roll(grids, p: Params, g: int):
    """One forecast from arrays of consecutive groups, as step() makes it."""
    import numpy as np

    v, tw = np.zeros((2, g, g)), 0.0
    h = p.window // 2
    for age, (prev, now) in enumerate(zip(grids[::-1][1:], grids[::-1][:-1])):
        pad = np.pad(prev, h, constant_values=-1)
        best, arg = np.full((g, g), -1.0), np.zeros((2, g, g))
        for di in range(-h, h + 1):
            for dj in range(-h, h + 1):
                near = pad[h + di : h + di + g, h + dj : h + dj + g]
                if di or dj:
                    up = near > best
                    best = np.where(up, near, best)
                    arg[0][up], arg[1][up] = di, dj
        n = np.hypot(*arg)
        v += 0.8**age * np.where(now >= 0.001, arg / np.where(n > 0, n, 1), 0)
        tw += 0.8**age
    v = v / tw if tw else v
    now = grids[-1]
    moved = (1 - p.persistence) * p.momentum
    out = now * (1 - moved)
    r, c = np.mgrid[0:g, 0:g]
    tr, tc = np.clip(r + v[0] * p.step, 0, g - 1 - 1e-6), np.clip(c + v[1] * p.step, 0, g - 1 - 1e-6)
    fr, fc = tr.astype(int), tc.astype(int)
    for a in (0, 1):
        for b in (0, 1):
            np.add.at(out, (fr + a, fc + b), now * moved * np.where(a, tr - fr, 1 - tr + fr) * np.where(b, tc - fc, 1 - tc + fc))
    w = np.array(kernel(p.diffusion))
    n = len(w) // 2
    if n:
        for axis in (0, 1):
            wide = np.pad(out, [(n, n) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
            out = sum(x * np.take(wide, np.arange(k, k + g), axis) for k, x in enumerate(w))
    return out / out.sum() if out.sum() > 0 else np.full((g, g), 1 / g**2)


def tuned(df: DataFrame, g: int, calls: int = 10, initial: int = 5, seed: int = 42, sigma: float = 0.2, days: int = 7) -> tuple[Params, float]:
    """Parameters with the best mean FDS in rolling one-step forecasts, by a Gaussian process with expected improvement.

    Grids and posts' cells don't depend on the parameters: Spark makes them once; a candidate costs array work only.
    Under LEAST_GROUPS groups the defaults stand.
    """
    import math

    import numpy as np

    grouped = weekly_groups(df, days)
    grids = _matrices(weekly_grids(df, g, sigma, days), g)
    if len(grids) < LEAST_GROUPS:
        return Params(), float("nan")
    from .grid import located

    at = located(grouped, bounds(df), g).groupBy("grp", "r", "c").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).collect()
    weight, count = np.zeros_like(grids), np.zeros(len(grids))
    for k, r, c, w, n in at:
        weight[k, r, c] += w
        count[k] += n

    def value(p: Params) -> float:
        first = max(2, p.history)  # the first group with a whole history before it
        if first >= len(grids):
            return 0.0
        got = [(((weight[t] * _roll(grids[max(0, t - p.history) : t], p, g)).sum() * g * g / max(weight[t].sum(), 1e-12)), count[t]) for t in range(first, len(grids))]
        return float(np.average([x for x, _ in got], weights=[n for _, n in got]))

    rng = np.random.default_rng(seed)
    lo, hi = (np.array([b[i] for b in SPACE.values()], float) for i in (0, 1))

    def params(u) -> Params:
        x = dict(zip(SPACE, lo + u * (hi - lo)))
        return Params(**{k: (int(round(v)) if k in ("window", "history") else float(v)) for k, v in x.items()})

    us, ys = list(rng.random((initial, len(lo)))), []
    ys = [value(params(u)) for u in us]
    for _ in range(max(calls - initial, 0)):
        x, y = np.array(us), (np.array(ys) - np.mean(ys)) / (np.std(ys) + 1e-9)
        k = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2).sum(2) / 0.5)
        inv = np.linalg.inv(k(x, x) + 1e-4 * np.eye(len(x)))
        cand = rng.random((500, len(lo)))
        kc = k(cand, x)
        mu, sd = kc @ inv @ y, np.sqrt(np.maximum(1 - np.einsum("ij,jk,ik->i", kc, inv, kc), 1e-12))
        z = (mu - y.max()) / sd
        ei = sd * (z * 0.5 * (1 + np.array([math.erf(t / math.sqrt(2)) for t in z])) + np.exp(-z * z / 2) / math.sqrt(2 * math.pi))
        us.append(cand[ei.argmax()])
        ys.append(value(params(us[-1])))
    best = int(np.argmax(ys))
    return params(us[best]), ys[best]
