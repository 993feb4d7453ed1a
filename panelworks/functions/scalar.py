"""Scalar column functions. Missing values are NULL, never NaN."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add_intercept(df: DataFrame, name: str = "x0") -> DataFrame:
    return df.withColumn(name, F.lit(1.0))


def clip(x: Column, lo: float, hi: float) -> Column:
    """NULL stays NULL: least and greatest alone would skip it."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def sigmoid(z: Column, bound: float = 40.0) -> Column:
    return 1.0 / (1.0 + F.exp(-clip(z, -bound, bound)))


def label_at(p: Column, threshold: float = 0.5) -> Column:
    return (p >= threshold).cast("int")


def reversion_position(z: Column, entry: float = 0.5) -> Column:
    """Long below -entry, short above it, else flat; NULL is flat."""
    return F.when(z < -entry, 1.0).when(z > entry, -1.0).otherwise(0.0)


def smooth_position(forecast: Column, gain: float = 50.0) -> Column:
    return clip(F.tanh(forecast * gain), -1.0, 1.0)


def dead_zone(mu: Column, bound: float, least: float) -> Column:
    """Clip to +-bound, then what is smaller than ``least`` is 0."""
    c = clip(mu, -bound, bound)
    return F.when(F.abs(c) < least, 0.0).otherwise(c)


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose columns are all finite numbers."""
    for c in columns:
        df = df.filter(is_finite(F.col(c)))
    return df


def finite_or_zero(x: Column) -> Column:
    return F.when(is_finite(x), x).otherwise(0.0)


def nonzero(x: Column) -> Column:
    """NULL in place of 0: a divisor that can't divide."""
    return F.nullif(x, F.lit(0.0))


def is_rebalance_day(dt: Column, mode: str = "weekly", day: int = 4, force: bool = False) -> Column:
    """Mondays are 0; Fridays, 4, are the default."""
    if force or mode == "daily":
        return dt.isNotNull()
    return F.weekday(dt) == day


def business_days(df: DataFrame, dt: str = "dt", by: str | None = None) -> DataFrame:
    """All days from Monday to Friday between the first and last date, of each ``by``."""
    keys = [by] if by else []
    span = df.groupBy(*keys).agg(F.min(dt).alias("d0"), F.max(dt).alias("d1"))
    days = span.select(*keys, F.explode(F.sequence("d0", "d1", F.expr("interval 1 day"))).alias(dt))
    return days.filter(F.weekday(dt) < 5)


def gaps(df: DataFrame, dt: str = "dt", by: str | None = None) -> DataFrame:
    """(by, dt): business days between the first and last date, of each ``by``, on which there is no row."""
    keys = [*([by] if by else []), dt]
    return business_days(df, dt, by).join(df.select(*keys).distinct(), keys, "left_anti")


def tail_name(x: Column) -> Column:
    """What stands after the last point."""
    return F.substring_index(x, ".", -1)


def soft_threshold(z: Column, g: float) -> Column:
    return F.signum(z) * F.greatest(F.abs(z) - g, F.lit(0.0))


def moments(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), ddof: int = 1) -> DataFrame:
    std = F.stddev_samp if ddof else F.stddev_pop
    return df.groupBy(*by).agg(*[F.avg(c).alias(f"{c}_mean") for c in columns], *[std(c).alias(f"{c}_std") for c in columns])


def standardize(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), ddof: int = 1) -> DataFrame:
    """Columns to mean 0 and deviation 1, in each group; a deviation of 0 counts as 1."""
    m = moments(df, columns, by, ddof)
    out = df.join(m, list(by)) if by else df.crossJoin(F.broadcast(m))  # without groups: one row
    scaled = {c: (F.col(c) - F.col(f"{c}_mean")) / F.coalesce(nonzero(F.col(f"{c}_std")), F.lit(1.0)) for c in columns}
    return out.withColumns(scaled).drop(*[f"{c}_{x}" for c in columns for x in ("mean", "std")])


def abs_cosine(a: Column, b: Column) -> Column:
    """Aggregate: |cos| of the angle between two vectors given by components."""
    return F.least(F.lit(1.0), F.abs(F.sum(a * b)) / F.sqrt(F.sum(a * a) * F.sum(b * b)))


def angle(a: Column, b: Column) -> Column:
    """Aggregate: angle in radians, whatever the signs."""
    return F.acos(abs_cosine(a, b))


def linear(columns: Sequence[str], coef: Sequence[float | Column], intercept: float | Column = 0.0) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    out = as_col(intercept)
    for c, b in zip(columns, coef, strict=True):
        out = out + as_col(b) * F.col(c)
    return out


def add_zero(x: Column, digits: int) -> Column:
    """Rounded, and never a negative 0."""
    return F.round(x, digits) + F.lit(0.0)
