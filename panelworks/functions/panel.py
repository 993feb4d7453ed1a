"""Window functions over a panel. All take the same partition and order, so Spark sorts once for all of them.

Rolling functions are NULL until their window is full of values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelworks.functions.scalar import complete, nonzero

ANNUAL = 252


@dataclass(frozen=True)
class Series:
    """The key and order columns of a panel."""

    key: str = "asset"
    order: str = "dt"

    def all(self) -> WindowSpec:
        return Window.partitionBy(self.key).orderBy(self.order)

    def rows(self, a: int, b: int) -> WindowSpec:
        return self.all().rowsBetween(a, b)

    def until_now(self) -> WindowSpec:
        return self.rows(Window.unboundedPreceding, 0)


S = Series()


def simple_return(price: str = "price", k: int = 1, s: Series = S) -> Column:
    return F.col(price) / nonzero(F.lag(price, k).over(s.all())) - 1


def log_return(price: str = "price", s: Series = S) -> Column:
    return F.log(F.col(price) / nonzero(F.lag(price).over(s.all())))


def lagged(x: str = "ret", k: int = 1, s: Series = S) -> Column:
    return F.lag(x, k).over(s.all())


def forward(x: str = "ret", k: int = 1, s: Series = S) -> Column:
    """The value ``k`` rows later: a target, never a feature."""
    return F.lead(x, k).over(s.all())


def growth(ret: str = "ret", s: Series = S) -> Column:
    return F.product(1 + F.col(ret)).over(s.until_now())


def drawdown(cum: str = "cum", s: Series = S) -> Column:
    """Below the highest value so far. The first value is the first peak, so a loss on the first day is none."""
    return F.col(cum) / F.max(cum).over(s.until_now()) - 1


def carried(w: str = "w", sticky_zero: bool = True, s: Series = S) -> Column:
    """The last weight carried forward. With ``sticky_zero`` a weight of 0 counts as missing and takes the last other one."""
    value = nonzero(F.col(w)) if sticky_zero else F.col(w)
    return F.coalesce(F.last(value, ignorenulls=True).over(s.until_now()), F.lit(0.0))


def prior(w: str = "w", s: Series = S) -> Column:
    return F.coalesce(F.lag(w).over(s.all()), F.lit(0.0))


def change(w: str = "w", s: Series = S) -> Column:
    return F.col(w) - F.lag(w).over(s.all())


def _full(value: Column, count: Column, n: int) -> Column:
    return F.when(count == n, value)


def rolling_mean(x: str = "ret", n: int = 20, s: Series = S) -> Column:
    w = s.rows(1 - n, 0)
    return _full(F.avg(x).over(w), F.count(x).over(w), n)


def rolling_std(x: str = "ret", n: int = 20, s: Series = S) -> Column:
    w = s.rows(1 - n, 0)
    return _full(F.stddev_samp(x).over(w), F.count(x).over(w), n)


def rolling_zscore(x: str = "ret", n: int = 20, s: Series = S, flat: float = 1e-12) -> Column:
    """NULL where the window is flat, up to rounding."""
    std = rolling_std(x, n, s)
    return F.when(std > flat, (F.col(x) - rolling_mean(x, n, s)) / std)


def rolling_beta(y: str = "ret", x: str = "mkt_ret", n: int = 20, s: Series = S) -> Column:
    """Covariance by variance over the window that ends today."""
    w = s.rows(1 - n, 0)
    both = F.count(F.when(F.col(y).isNotNull() & F.col(x).isNotNull(), 1)).over(w)
    return _full(F.covar_samp(y, x).over(w) / nonzero(F.var_samp(x).over(w)), both, n)


def rolling_beta_lagged(y: str = "ret", x: str = "mkt_ret", n: int = 20, s: Series = S, flat: float = 1e-12) -> Column:
    """Slope over the ``n`` rows before today; NULL if one is missing or ``x`` is flat."""
    w = s.rows(-n, -1)
    both = F.count(F.when(F.col(y).isNotNull() & F.col(x).isNotNull(), 1)).over(w)
    return F.when((both == n) & (F.stddev_pop(x).over(w) >= flat), F.regr_slope(F.col(y), F.col(x)).over(w))


def realized_vol(ret: str = "ret", n: int = 63, s: Series = S) -> Column:
    return rolling_std(ret, n, s) * (ANNUAL**0.5)


def last_vol(df: DataFrame, ret: str = "ret", n: int = 21, s: Series = S, annual: bool = True) -> DataFrame:
    """Deviation of the last ``n`` rows of each series; 0 for shorter ones."""
    back = Window.partitionBy(s.key).orderBy(F.desc(s.order))
    rows = df.filter(F.col(ret).isNotNull()).withColumn("_rn", F.row_number().over(back)).filter(F.col("_rn") <= n)
    vol = F.stddev_samp(ret) * (ANNUAL**0.5 if annual else 1.0)
    return rows.groupBy(s.key).agg(F.when(F.count("*") == n, vol).otherwise(0.0).alias("vol"))


@dataclass(frozen=True)
class FeatureSpec:
    """``level`` False: mean return, z-score of the return. True: change of the price, z-score of the price."""

    momentum: int = 20
    volatility: int = 20
    zscore: int = 20
    beta: int = 20
    level: bool = False


DAILY = FeatureSpec()
LEVEL = FeatureSpec(momentum=21, volatility=21, zscore=63, beta=63, level=True)
FEATURES = ["momentum", "volatility", "zscore", "beta_mkt", "ret_lag1"]


def features(panel: DataFrame, spec: FeatureSpec = DAILY, s: Series = S, drop_incomplete: bool = True) -> DataFrame:
    """``panel`` (key, order, price, ret, mkt_ret) with its features; one sort for all."""
    out = panel.withColumns(
        {
            "momentum": simple_return("price", spec.momentum, s) if spec.level else rolling_mean("ret", spec.momentum, s),
            "volatility": rolling_std("ret", spec.volatility, s),
            "zscore": rolling_zscore("price" if spec.level else "ret", spec.zscore, s),
            "beta_mkt": rolling_beta("ret", "mkt_ret", spec.beta, s),
            "ret_lag1": lagged("ret", 1, s),
        }
    )
    return complete(out, FEATURES) if drop_incomplete else out
