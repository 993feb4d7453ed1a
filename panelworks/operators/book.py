"""Orders, fills, positions, books that finance themselves, and the gates of a live run."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelworks.functions.scalar import nonzero
from panelworks.operators.folds import fold_days, vector


def orders_to_weights(book: DataFrame, slippage_bps: float = 1.0, whole: bool = False) -> DataFrame:
    """``book`` (.., equity, w, shares, price) with ``qty`` to reach the weight and the ``fill_px`` after slippage."""
    want = F.col("w") * F.col("equity") - F.col("shares") * F.col("price")
    qty = F.coalesce(want / nonzero(F.col("price")), F.lit(0.0))
    if whole:
        qty = F.signum(qty) * F.floor(F.abs(qty))
    return book.withColumn("qty", qty).withColumn("fill_px", F.col("price") * (1 + F.signum("qty") * (slippage_bps / 1e4)))


def positions(trades: DataFrame, prices: DataFrame) -> DataFrame:
    """(book_id, dt, asset, shares, price) on all dates of ``prices`` (dt, asset, price) for the assets that a book has traded."""
    t = trades.groupBy("book_id", "asset", "dt").agg(F.sum("qty").alias("qty"))
    grid = trades.select("book_id", "asset").distinct().join(prices.select("dt", "asset", "price"), "asset")
    w = Window.partitionBy("book_id", "asset").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(t, ["book_id", "asset", "dt"], "left").withColumn("shares", F.coalesce(F.sum("qty").over(w), F.lit(0.0))).select("book_id", "dt", "asset", "shares", "price")


def equity(trades: DataFrame, prices: DataFrame, starting_cash: float = 500.0) -> DataFrame:
    """(book_id, dt, cash, value, equity): starting cash less all fills and fees so far, and the shares at today's price."""
    value = positions(trades, prices).groupBy("book_id", "dt").agg(F.sum(F.col("shares") * F.col("price")).alias("value"))
    spent = trades.groupBy("book_id", "dt").agg(F.sum(F.col("fill_px") * F.col("qty") + F.col("fee")).alias("spent"))
    w = Window.partitionBy("book_id").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    rows = value.join(spent, ["book_id", "dt"], "left").withColumn("cash", F.lit(float(starting_cash)) - F.coalesce(F.sum("spent").over(w), F.lit(0.0)))
    return rows.select("book_id", "dt", "cash", "value", (F.col("cash") + F.col("value")).alias("equity"))


def replay_days(weights: DataFrame, prices: DataFrame, cash: float = 500.0, slippage_bps: float = 1.0, fee: float = 0.0, leverage: float = 1.5, attempts: int = 4, feasible_only: bool = True, whole: bool = False, state: DataFrame | None = None) -> DataFrame:
    """(book_id, dt, assets, w, shares, cash, trades): the days of ``replay``, with a book's shares and cash after each. ``state``: rows of an earlier run, from which books go on."""
    days = weights.join(prices.select("dt", "asset", "price"), ["dt", "asset"]).groupBy("book_id", "dt").agg(F.array_sort(F.collect_list(F.struct("asset", "w", "price"))).alias("rows"))

    def step(now: dict, day: dict) -> dict:
        today = {r["asset"]: r for r in day["rows"]}
        assets = sorted({*now["assets"], *today})
        w, px = (np.array([today[a][c] if a in today and today[a][c] is not None else np.nan for a in assets], float) for c in ("w", "price"))
        w, px = np.nan_to_num(w), np.where(np.isfinite(px), px, 0.0)
        shares, have, trades = np.array(vector(assets, now["assets"], now["shares"])), now["cash"], []
        if now["w"] is None or (np.abs(w - vector(assets, now["assets"], now["w"])) > 1e-9).any():
            target = np.clip(w, -leverage, leverage) if feasible_only else w
            for _ in range(attempts if feasible_only else 1):
                eq = have + (shares * px).sum()
                if feasible_only and eq <= 0:
                    break
                qty = np.where(px != 0, (target * eq - shares * px) / np.where(px != 0, px, 1), 0.0)
                if whole:
                    qty = np.sign(qty) * np.floor(np.abs(qty))
                fill = px * (1 + slippage_bps / 1e4 * np.sign(qty))
                left = have - (fill * qty).sum() - fee * (qty != 0).sum()
                held = (shares + qty) * px
                worth = left + held.sum()
                if not feasible_only or (worth > 0 and left >= 0 and np.abs(held).sum() / worth <= leverage):
                    trades = [{"asset": a, "qty": q, "fill_px": f, "fee": fee} for a, q, f in zip(assets, qty.tolist(), fill.tolist(), strict=True) if q != 0]
                    shares, have = shares + qty, left
                    break
                target = target * 0.5
        return {"assets": assets, "w": w.tolist(), "shares": shares.tolist(), "cash": float(have), "trades": trades}

    fields = "assets array<string>, w array<double>, shares array<double>, cash double, trades array<struct<asset:string,qty:double,fill_px:double,fee:double>>"
    return fold_days(days, fields, lambda: {"assets": [], "w": None, "shares": [], "cash": float(cash), "trades": []}, step, state)


def replay(weights: DataFrame, prices: DataFrame, cash: float = 500.0, slippage_bps: float = 1.0, fee: float = 0.0, leverage: float = 1.5, attempts: int = 4, feasible_only: bool = True, whole: bool = False) -> DataFrame:
    """Trades (book_id, dt, asset, qty, fill_px, fee) of books that follow daily weights (book_id, dt, asset, w) on their own equity.

    A book trades when a weight moves. If cash would be negative or leverage too high, all targets are halved, at most ``attempts`` times, else the day is
    left out; with ``feasible_only`` False it trades whatever comes. A book is one ordered stream; books run in parallel.
    """
    days = replay_days(weights, prices, cash, slippage_bps, fee, leverage, attempts, feasible_only, whole)
    return days.select("book_id", "dt", F.explode("trades").alias("_t")).select("book_id", "dt", "_t.asset", "_t.qty", "_t.fill_px", "_t.fee")


def gates(books: DataFrame, budget: float, turnover_cap: float = 0.5, vol_cap: float = 0.5, force: bool = False) -> DataFrame:
    """One row for each book of (book_id, asset, target, current, vol): turnover, vol and ``go``. A book without positions, or one that is forced, always goes."""
    rows = books.groupBy("book_id").agg((F.sum(F.abs(F.col("target") - F.col("current"))) / nonzero(F.lit(float(budget)))).alias("turnover"), F.max("vol").alias("vol"), F.max((F.col("current") != 0).cast("int")).alias("_held"))
    rows = rows.withColumn("turnover", F.coalesce("turnover", F.lit(0.0)))
    go = F.lit(force) | (F.col("_held") == 0) | ((F.col("turnover") <= turnover_cap) & (F.coalesce("vol", F.lit(0.0)) <= vol_cap))
    return rows.withColumn("go", go).drop("_held")


def order_list(book: DataFrame, budget: float, least: float = 0.02, limit: float = 0.002, shorts: bool = False) -> DataFrame:
    """(asset, delta, side, notional, limit_price, qty, status) of (asset, w, current, price); orders are not sent."""
    target = F.col("w") * budget
    delta = target - F.col("current")
    # The texts of the status.
    status = F.when(F.lit(not shorts) & (target < 0), "SKIP: long-only").when(F.abs(delta) < least * budget, "SKIP: below threshold").otherwise("ORDER")
    rows = book.select("asset", "price", delta.alias("delta"), status.alias("status"))
    live = F.col("status") == "ORDER"
    side = F.when(live, F.when(F.col("delta") > 0, "BUY").otherwise("SELL"))
    rows = rows.withColumns({"side": side, "notional": F.when(live, F.round(F.abs("delta"), 2))})
    rows = rows.withColumn("_px", F.when(live, F.col("price") * F.when(F.col("side") == "BUY", 1 + limit).otherwise(1 - limit)))
    return rows.select("asset", "delta", "side", "notional", F.round("_px", 4).alias("limit_price"), F.round(F.col("notional") / nonzero(F.col("_px")), 6).alias("qty"), "status")
