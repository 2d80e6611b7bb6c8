"""Guards and arithmetic on numbers, boxes and times. Missing evidence stays null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite_or_null(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def unit_or_null(x: Column) -> Column:
    """A probability or score in [0, 1], else null."""
    return F.when(finite_or_null(x).between(0, 1), x)


def valid_interval(a: Column, b: Column) -> Column:
    return F.coalesce((a >= 0) & (a < b), F.lit(False))


def ratio(n: Column, of: Column, places: int = 6) -> Column:
    """n / of rounded; null without a denominator."""
    return F.round(F.try_divide(n.cast("double"), F.nullif(of, F.lit(0)).cast("double")), places)


def decibels(power: Column, places: int = 4) -> Column:
    """Ten times the common logarithm, rounded; minus infinity of silence (Spark's logarithm of 0 is null), null without a level.

    As SQL's, a level a little below 0 is rounded to -0.0, which Spark's round has no sign for.
    """
    level = F.round(10 * F.log10(power), places)
    return F.when(power == 0, F.lit(float("-inf"))).when((level == 0) & (power < 1), F.lit(-0.0)).otherwise(level)


def mean_of(*xs: Column) -> Column:
    """The mean of those that are not null; null if none is."""
    n = reduce(lambda a, b: a + b, [x.isNotNull().cast("int") for x in xs])
    return F.try_divide(reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) for x in xs]), F.nullif(n, F.lit(0)))


def iou(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    """Intersection over union of two boxes; 0 without an intersection."""
    w = F.greatest(F.lit(0.0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    h = F.greatest(F.lit(0.0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    return F.coalesce(F.try_divide(w * h, aw * ah + bw * bh - w * h), F.lit(0.0))


def valid_box(x, y, w, h, slack: float = 1e-6) -> Column:
    """Inside [0, 1] and of positive size."""
    return F.coalesce((x >= -slack) & (y >= -slack) & (w > 0) & (h > 0) & (x + w <= 1 + slack) & (y + h <= 1 + slack), F.lit(False))


def direction(vx: Column, vy: Column, deadzone: float) -> Column:
    """Eight-way name of a velocity; still inside the dead zone."""
    across = F.when(vx > deadzone, "right").when(vx < -deadzone, "left")
    along = F.when(vy > deadzone, "down").when(vy < -deadzone, "up")
    return F.coalesce(F.nullif(F.concat_ws("-", along, across), F.lit("")), F.lit("still"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def stamp(us: Column, separator: str = ",") -> Column:
    """hh:mm:ss,mmm of a time, rounded to milliseconds."""
    ms = F.floor((us + 500) / 1000).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    second, milli = F.floor(ms / 1000).cast("long"), F.lpad((ms % 1000).cast("string"), 3, "0")
    hour = F.floor(second / 3600).cast("long")
    shown = F.when(hour < 10, two(hour)).otherwise(hour.cast("string"))
    return F.concat(shown, F.lit(":"), two(F.floor(second / 60).cast("long") % 60), F.lit(":"), two(second % 60), F.lit(separator), milli)
