"""Profit after costs, baselines and whole backtests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.functions.panel import S, Series, change, prior
from panelworks.functions.scalar import clip, is_rebalance_day, reversion_position, smooth_position


def asset_pnl(df: DataFrame, w: str = "w", ret: str = "ret", bps: float = 5.0, s: Series = S) -> DataFrame:
    """``net``: yesterday's weight, within +-1, times today's return, less the cost of the change of weight."""
    rows = df.withColumn(w, clip(F.col(w), -1.0, 1.0)).withColumn("_prev", prior(w, s))
    return rows.withColumn("net", F.col("_prev") * F.col(ret) - bps / 1e4 * F.abs(F.col(w) - F.col("_prev"))).drop("_prev")


def portfolio_pnl(weights: DataFrame, returns: DataFrame, bps: float = 5.0, books: Sequence[str] = ("book_id",), cost_day: int | None = None) -> DataFrame:
    """(book.., dt, gross, cost, net) of daily ``weights`` (book.., dt, asset, w).

    Gross is the sum of yesterday's weights times today's returns; cost is charged on the sum of the changes, on ``cost_day`` alone if set.
    """
    s = Series("_series", "dt")
    rows = weights.withColumn("_series", F.struct(*books, "asset")).withColumns({"_prev": prior("w", s), "_dw": F.abs(F.coalesce(change("w", s), F.col("w")))})
    rows = rows.join(returns.select("dt", "asset", "ret"), ["dt", "asset"], "left")
    sums = rows.groupBy(*books, "dt").agg(F.sum(F.col("_prev") * F.coalesce("ret", F.lit(0.0))).alias("gross"), F.sum("_dw").alias("turnover"))
    cost = F.col("turnover") * (bps / 1e4)
    if cost_day is not None:
        cost = F.when(is_rebalance_day(F.col("dt"), day=cost_day), cost).otherwise(0.0)
    return sums.withColumn("cost", cost).withColumn("net", F.col("gross") - F.col("cost"))


def equal_weight_hold(panel: DataFrame) -> DataFrame:
    return panel.groupBy("dt").agg(F.avg("ret").alias("ret"))


def reversion(features: DataFrame, entry: float = 0.5, bps: float = 5.0) -> DataFrame:
    """(strategy, asset, dt, ret): buy and hold beside mean reversion on the z-score, after costs."""
    rows = asset_pnl(features.withColumn("w", reversion_position(F.col("zscore"), entry)), bps=bps)
    both = F.array(F.struct(F.lit("hold").alias("strategy"), F.col("ret").alias("ret")), F.struct(F.lit("reversion").alias("strategy"), F.col("net").alias("ret")))
    return rows.select("asset", "dt", F.explode(both).alias("x")).select("x.strategy", "asset", "dt", "x.ret")


def forecast_pnl(forecasts: DataFrame, bps: float = 5.0) -> DataFrame:
    """(strategy, asset, dt, ret) of ``forecasts`` (asset, dt, ret, yhat), sized smoothly; a row without a forecast is flat."""
    rows = asset_pnl(forecasts.withColumn("w", F.coalesce(smooth_position(F.col("yhat")), F.lit(0.0))), bps=bps)
    return rows.select(F.lit("ridge").alias("strategy"), "asset", "dt", F.col("net").alias("ret"))
