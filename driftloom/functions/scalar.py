"""Column expressions over posts; none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
DAY_US = 86_400_000_000


def micros(ts: str = "ts") -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, cast({ts} as timestamp_ntz))")


def importance(retweets: Column, favorites: Column, w_retweet: float = 1.0, w_favorite: float = 1.0, floor: float = 1.0) -> Column:
    return (retweets * F.lit(w_retweet) + favorites * F.lit(w_favorite) + F.lit(floor)).cast("double")


def marker_size(engagement: Column) -> Column:
    return F.when(engagement == 0, F.lit(1.0)).otherwise(F.log10(engagement + F.lit(1.0)) * 1.5 + 1.0)


def truncated(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def too_short(text: Column, least: int = 10) -> Column:
    return text.isNull() | (F.length(F.btrim(text, F.lit(" \t\n\r"))) < least)


def distance(x: Column, y: Column, cx: Column | float = 0.0, cy: Column | float = 0.0) -> Column:
    dx, dy = x - cx, y - cy
    return F.sqrt(dx * dx + dy * dy)


def cell(v: Column, lo: Column, hi: Column, g: int) -> Column:
    """The cell of a point, cut towards the lower edge."""
    u = (v - lo) / (hi - lo) * F.lit(float(g - 1))
    return F.floor(F.least(F.greatest(u, F.lit(0.0)), F.lit(float(g - 1)))).cast("int")


def nearest_node(v: Column, lo: Column, hi: Column, g: int) -> Column:
    """The nearest grid node of a point; of two as near, the lower."""
    u = F.least(F.greatest((v - lo) / (hi - lo) * F.lit(float(g - 1)), F.lit(0.0)), F.lit(float(g - 1)))
    return F.ceil(u - F.lit(0.5)).cast("int")


def node(i: Column, lo: Column, hi: Column, g: int) -> Column:
    return lo + (hi - lo) * i.cast("double") / F.lit(float(g - 1))


def gaussian(d2: Column, sigma: float) -> Column:
    return F.exp(-d2 / F.lit(2.0 * sigma * sigma))


def harshness(dist: Column, h: float) -> tuple[Column, Column]:
    """Score exp(-h * distance) and its class: high from 0.7, middle from 0.3."""
    s = F.exp(-F.lit(h) * dist)
    return s, F.when(s >= 0.7, "high").when(s >= 0.3, "middle").otherwise("low")


def distance_class(d: Column) -> Column:
    return F.when(d < 0.3, "core").when(d < 0.6, "near").when(d < 1.0, "edge").otherwise("outside")


def density_class(p: Column) -> Column:
    return F.when(p > 0.1, "dense").when(p > 0.05, "middle").otherwise("sparse")


def normal_pdf(x: Column, y: Column, cx: float, cy: float, sx: float, sy: float) -> Column:
    import math

    z = (x - cx) * (x - cx) / (sx * sx) + (y - cy) * (y - cy) / (sy * sy)
    return F.exp(-z / 2.0) / F.lit(2.0 * math.pi * sx * sy)


def ratings(text: Column, k: int, default: float) -> Column:
    """k ratings from an answer such as "5, 3": the first number of each comma part, padded with the default and cut."""
    parts = F.transform(F.split(text, ","), lambda p: F.regexp_extract(p, r"\b(\d+(?:\.\d+)?)\b", 1))
    found = F.transform(F.filter(parts, lambda p: p != ""), lambda p: p.cast("double"))
    return F.slice(F.concat(found, F.array_repeat(F.lit(float(default)), k)), 1, k)


def composite(values: Column) -> Column:
    """The mean of an array's values that are not null."""
    known = F.filter(values, lambda v: v.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.size(known))


def dot(v: Column, weights: Column) -> Column:
    return F.aggregate(F.zip_with(v, weights, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def duration_label(days: Column) -> Column:
    return F.when(days >= 1, F.concat(F.round(days, 1).cast("string"), F.lit("d"))).otherwise(F.concat(F.round(days * 24, 1).cast("string"), F.lit("h")))


def file_stem(name: Column) -> Column:
    """A name fit for a file: blanks as underscores, nothing from an opening bracket on."""
    return F.translate(F.trim(F.split(name, r"\(").getItem(0)), " /", "__")


def parsed_time(text: Column) -> Column:
    """A timestamp without zone from text; null where it is none."""
    return F.btrim(text).try_cast("timestamp_ntz")


def clamped(v: Column) -> Column:
    """Numbers less than 0, and NaN, as 0."""
    return F.when(v > 0, F.when(F.isnan(v), 0.0).otherwise(v)).otherwise(0.0)
