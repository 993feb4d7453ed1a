"""Portfolio weights from forecasts and covariances, their constraints, and the weekly job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelworks.functions.panel import ANNUAL, Series, carried
from panelworks.functions.scalar import clip
from panelworks.operators.folds import fold_days, long, vector


def by_date(cov: DataFrame) -> DataFrame:
    """(dt, covs): the tiles of a date (``risk.ewma_cov_tiles``), or its pairs as tiles of one cell. A date holds as many numbers as its assets squared."""
    if "assets_a" not in cov.columns:
        cov = cov.select("dt", F.array("asset_a").alias("assets_a"), F.array("asset_b").alias("assets_b"), F.array("cov").alias("cov"))
    return cov.groupBy("dt").agg(F.collect_list(F.struct("assets_a", "assets_b", "cov")).alias("covs"))


def whole_dates(cov: DataFrame, n: int) -> DataFrame:
    """Dates on which all pairs of ``n`` assets have a covariance."""
    if "assets_a" not in cov.columns:
        return cov.groupBy("dt").agg(F.count("*").alias("n")).filter(F.col("n") == n * (n + 1) // 2).select("dt")
    cells = F.size(F.filter("cov", lambda v: v.isNotNull()))
    # A tile beside itself holds its pairs twice.
    return cov.groupBy("dt").agg(F.sum(F.when(F.col("tile_a") == F.col("tile_b"), cells).otherwise(2 * cells)).alias("n")).filter(F.col("n") == n * n).select("dt")


def per_date(mu: DataFrame, cov: DataFrame) -> DataFrame:
    """(dt, mus, covs): the vectors of a date as arrays, assets in order, and its covariances."""
    m = mu.groupBy("dt").agg(F.array_sort(F.collect_list(F.struct("asset", "mu"))).alias("mus"))
    return m.join(by_date(cov), "dt")


def dense(assets: Sequence[str], covs) -> np.ndarray:
    """The matrix of ``assets`` from a date's tiles; 0 where it has none."""
    at = {a: k for k, a in enumerate(assets)}
    out = np.zeros((len(at), len(at)))
    for r in covs:
        i, j = (np.array([at.get(a, -1) for a in r[c]]) for c in ("assets_a", "assets_b"))
        m = np.nan_to_num(np.array(r["cov"], float).reshape(len(i), len(j)))[np.ix_(i >= 0, j >= 0)]
        i, j = i[i >= 0], j[j >= 0]
        out[np.ix_(i, j)] = m
        out[np.ix_(j, i)] = m.T
    return out


def capped(w: np.ndarray, gross_cap: float | None, asset_cap: float | None) -> np.ndarray:
    """Each weight first, then the sum of their sizes."""
    if asset_cap is not None:
        w = np.clip(w, -asset_cap, asset_cap)
    gross = np.abs(w).sum()
    return w * (gross_cap / gross) if gross_cap is not None and gross > gross_cap else w


def long_only(w: np.ndarray, cap: float | None) -> np.ndarray:
    """No shorts, sum 1; after the cap they are scaled to 1 again, which may exceed it."""
    w = np.maximum(w, 0)
    w = w / w.sum() if w.sum() != 0 else np.ones_like(w) / len(w)
    if cap is not None:
        w = np.minimum(w, cap)
        w = w / w.sum() if abs(w.sum()) > 1e-12 else w
    return w


def _solve(mu: DataFrame, cov: DataFrame, f) -> DataFrame:
    def run(frames):
        for frame in frames:
            out = []
            for dt, mus, covs in zip(frame["dt"], frame["mus"], frame["covs"], strict=True):
                assets = [r["asset"] for r in mus]
                w = f(np.array([r["mu"] for r in mus], float), dense(assets, covs))
                out += list(zip([dt] * len(assets), assets, w.tolist(), strict=True))
            yield pd.DataFrame(out, columns=["dt", "asset", "w"])

    return per_date(mu, cov).mapInPandas(run, "dt date, asset string, w double")


def mean_variance(mu: DataFrame, cov: DataFrame, gross_cap: float | None = 1.5, asset_cap: float | None = None) -> DataFrame:
    """(dt, asset, w): the inverse covariance times the forecasts, capped; dates in parallel."""
    return _solve(mu, cov, lambda m, s: capped(np.linalg.pinv(s, rcond=1e-10) @ m, gross_cap, asset_cap))


def mean_variance_books(mu: DataFrame, cov: DataFrame, gross_caps: Mapping[str, float], asset_cap: float | None = None) -> DataFrame:
    """(book_id, dt, asset, w): ``mean_variance`` of many caps on the sum of sizes from one solution of each date."""
    one = mean_variance(mu, cov, None, asset_cap)
    gross = F.sum(F.abs("w")).over(Window.partitionBy("dt"))
    books = F.explode(F.array(*[F.struct(F.lit(b).alias("book_id"), F.lit(float(g)).alias("cap")) for b, g in gross_caps.items()]))
    rows = one.withColumn("gross", gross).withColumn("b", books)
    return rows.select("b.book_id", "dt", "asset", F.when(F.col("gross") > F.col("b.cap"), F.col("w") * (F.col("b.cap") / F.col("gross"))).otherwise(F.col("w")).alias("w"))


def mean_variance_long(mu: DataFrame, cov: DataFrame, cap: float | None = 0.40) -> DataFrame:
    return _solve(mu, cov, lambda m, s: long_only(np.linalg.solve(s, m), cap))


def beta_neutral(weights: DataFrame, beta: str = "beta", per: Sequence[str] = ("dt",)) -> DataFrame:
    """Weights less their projection on the betas; as they are where the betas are about 0."""
    w = Window.partitionBy(*per)
    b = F.coalesce(F.col(beta), F.lit(0.0))
    num, den = F.sum(b * F.col("w")).over(w), F.sum(b * b).over(w)
    return weights.withColumn("w", F.when(den > 1e-12, F.col("w") - num / den * b).otherwise(F.col("w")))


def portfolio_variance(weights: DataFrame, cov: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by.., dt, var): w' S w of each date, and of each book if ``by`` names one."""
    kinds = dict(weights.dtypes)
    rows = weights.groupBy(*by, "dt").agg(F.array_sort(F.collect_list(F.struct("asset", "w"))).alias("ws")).join(by_date(cov), "dt")

    def run(frames):
        for frame in frames:
            var = []
            for ws, covs in zip(frame["ws"], frame["covs"], strict=True):
                w = np.array([x["w"] for x in ws], float)
                var.append(float(w @ dense([x["asset"] for x in ws], covs) @ w))
            yield frame[[*by, "dt"]].assign(var=var)

    return rows.select(*by, "dt", "ws", "covs").mapInPandas(run, ", ".join([*[f"{c} {kinds[c]}" for c in by], "dt date", "var double"]))


def vol_target(weights: DataFrame, cov: DataFrame, target: float = 0.12, cap: float = 0.30) -> DataFrame:
    """Weights scaled so that the yearly volatility by the covariance is ``target``, then clipped; unscaled where it is about 0."""
    vol = portfolio_variance(weights, cov).select("dt", (F.sqrt(F.greatest("var", F.lit(0.0))) * ANNUAL**0.5).alias("_vol"))
    rows = weights.join(vol, "dt", "left")
    scale = F.when(F.col("_vol") > 1e-8, F.lit(target) / F.col("_vol")).otherwise(1.0)
    return rows.withColumn("w", clip(F.col("w") * scale, -cap, cap)).drop("_vol")


# -- folds: what depends on the path runs down the days of a book --------------------------------


def history_vol_days(books: DataFrame, target: float = 0.10, cap: float = 1.5, window: int = 60, state: DataFrame | None = None) -> DataFrame:
    """(book_id, dt, assets, w, past): the days of ``history_vol_target``, each with the book's last ``window`` simulated returns, which is all that the next day needs of the past.

    ``state``: rows of an earlier run, from which books go on. An asset that a book has held and that is missing on a day has weight 0.
    """
    days = books.groupBy("book_id", "dt").agg(F.array_sort(F.collect_list(F.struct("asset", "w", "ret"))).alias("rows"), F.first("sigma_vol", ignorenulls=True).alias("sigma"))

    def step(now: dict, day: dict) -> dict:
        today = {r["asset"]: r for r in day["rows"]}
        assets = sorted({*now["assets"], *today})
        w, ret = (np.array([(today[a][c] or 0.0) if a in today else 0.0 for a in assets]) for c in ("w", "ret"))
        past, vol = now["past"], np.nan
        if len(past) >= 2:
            # Within the slice weights are moved by one row, so its first return is that of weights 0.
            vol = float(np.std([0.0, *past[1:]], ddof=1)) * ANNUAL**0.5
        if not np.isfinite(vol) or vol == 0:
            vol = day["sigma"] if day["sigma"] is not None else np.nan
        scaled = np.clip(w * (target / vol if np.isfinite(vol) and vol > 1e-8 else 1.0), -cap, cap)
        earned = float(ret @ vector(assets, now["assets"], now["w"]))
        return {"assets": assets, "w": scaled.tolist(), "past": [*past, earned][-window:]}

    return fold_days(days, "assets array<string>, w array<double>, past array<double>", lambda: {"assets": [], "w": [], "past": []}, step, state)


def history_vol_target(books: DataFrame, target: float = 0.10, cap: float = 1.5, window: int = 60) -> DataFrame:
    """(book_id, dt, asset, w) of raw weights (book_id, dt, asset, w, ret, sigma_vol): scaled by the volatility of the book's own last ``window`` simulated returns.

    Within the slice the weights are moved by one row, its first row being 0; where the volatility is missing or 0, ``sigma_vol`` takes its place.
    The clip of single weights comes last and may exceed the cap of their sum.
    """
    return long(history_vol_days(books, target, cap, window), "w").select("book_id", "dt", "asset", "w")


def blended_days(books: DataFrame, cov: DataFrame, blend: float = 0.60, asset_cap: float = 0.30, gross_cap: float = 1.5, target: float | None = 0.12, state: DataFrame | None = None) -> DataFrame:
    """(book_id, dt, assets, w): the days of ``blended``. ``state``: rows of an earlier run, from which books go on."""
    days = books.groupBy("book_id", "dt").agg(F.array_sort(F.collect_list(F.struct("asset", "w", "beta"))).alias("ws")).join(by_date(cov), "dt").select("book_id", "dt", "ws", "covs")

    def step(now: dict, day: dict) -> dict:
        assets = [x["asset"] for x in day["ws"]]
        w = (1 - blend) * np.array([x["w"] for x in day["ws"]], float) + blend * np.array(vector(assets, now["assets"], now["w"]))
        w = capped(w, gross_cap, asset_cap)
        beta = np.nan_to_num(np.array([x["beta"] for x in day["ws"]], float))
        if beta @ beta > 1e-12:
            w = w - (beta @ w) / (beta @ beta) * beta
        w = np.clip(w, -asset_cap, asset_cap)
        if target is not None:
            vol = float(np.sqrt(max(w @ dense(assets, day["covs"]) @ w, 0.0))) * ANNUAL**0.5
            w = np.clip(w * (target / vol if vol > 1e-8 else 1.0), -asset_cap, asset_cap)
        return {"assets": assets, "w": w.tolist()}

    return fold_days(days, "assets array<string>, w array<double>", lambda: {"assets": [], "w": []}, step, state)


def blended(books: DataFrame, cov: DataFrame, blend: float = 0.60, asset_cap: float = 0.30, gross_cap: float = 1.5, target: float | None = 0.12) -> DataFrame:
    """(book_id, dt, asset, w) of raw weights (book_id, dt, asset, w, beta) on rebalance dates: blended with the weights before, capped, made beta neutral, scaled to a volatility.

    Each date needs the result of the one before, so a book is one stream; it reads rebalance dates alone. All that doesn't depend on the path is done before.
    """
    return long(blended_days(books, cov, blend, asset_cap, gross_cap, target), "w").select("book_id", "dt", "asset", "w")


def daily(weights: DataFrame, grid: DataFrame, sticky_zero: bool = True) -> DataFrame:
    """Rebalance weights carried to all dates of ``grid`` (dt, asset), 0 before the first: a row for each asset that the book ever has a weight of."""
    s = Series("_series", "dt")
    rows = weights.select("book_id", "asset").distinct().join(grid.select("dt", "asset").distinct(), "asset")
    rows = rows.join(weights, ["book_id", "dt", "asset"], "left").withColumn("_series", F.struct("book_id", "asset"))
    return rows.withColumn("w", carried("w", sticky_zero, s)).select("book_id", "dt", "asset", "w")


def weekly_weights(features: DataFrame, forecasts: DataFrame, cov: DataFrame, book: str = "weekly", gross_cap: float = 1.5, asset_cap: float = 0.30, blend: float = 0.60, target: float = 0.12) -> DataFrame:
    """Daily weights (book_id, dt, asset, w): mean-variance on rebalance dates, blend, caps, beta neutrality, volatility target, carried between."""
    raw = mean_variance(forecasts.select("dt", "asset", "mu"), cov, gross_cap, asset_cap)
    raw = raw.join(features.select("dt", "asset", F.col("beta_mkt").alias("beta")), ["dt", "asset"], "left").withColumn("book_id", F.lit(book))
    return daily(blended(raw, cov, blend, asset_cap, gross_cap, target), features)
