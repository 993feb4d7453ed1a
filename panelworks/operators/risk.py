"""Covariances, turnover, exposure, attribution and the risk table."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelworks.functions.panel import ANNUAL, Series, change, drawdown, growth, rolling_std
from panelworks.sources.shared import written


def return_pairs(panel: DataFrame, ret: str = "ret") -> DataFrame:
    """(asset_a <= asset_b, dt, ra, rb) of returns on the same date: an equi-join on the date."""
    a = panel.filter(F.col(ret).isNotNull()).select("dt", F.col("asset").alias("asset_a"), F.col(ret).alias("ra"))
    b = panel.filter(F.col(ret).isNotNull()).select("dt", F.col("asset").alias("asset_b"), F.col(ret).alias("rb"))
    return a.join(b, "dt").filter("asset_a <= asset_b")


# -- covariances in tiles -----------------------------------------------------------------------

#: Assets of a tile, about.
TILE = 64


def tiles_of(panel: DataFrame, ret: str = "ret", size: int = TILE) -> DataFrame:
    """(tile, assets, days, rows): the returns of about ``size`` assets side by side, a row of numbers a date (NaN: none), dates ascending.

    A tile is one row of dates x assets x 8 bytes: 1.2 MB for 64 assets and ten years of days.
    """
    rows = panel.filter(F.col(ret).isNotNull()).select("asset", "dt", F.col(ret).cast("double").alias("r"))
    n = max(1, -(-rows.select("asset").distinct().count() // size))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        wide = frame.pivot(index="dt", columns="asset", values="r").sort_index()
        days = pd.to_datetime(wide.index).to_numpy("datetime64[D]").astype(np.int32)
        return pd.DataFrame({"tile": [int(frame["tile"].iloc[0])], "assets": [wide.columns.tolist()], "days": [days.tobytes()], "rows": [wide.to_numpy(float).tobytes()]})

    return rows.withColumn("tile", F.pmod(F.xxhash64("asset"), F.lit(n)).cast("int")).groupBy("tile").applyInPandas(pack, "tile int, assets array<string>, days binary, rows binary")


def _ewma(a: np.ndarray, b: np.ndarray, n: int, lam: float) -> np.ndarray:
    w = (1 - lam) * lam ** np.arange(len(a) - 1, -1, -1.0)
    return (a * w[:, None]).T @ b


def _sample(a: np.ndarray, b: np.ndarray, n: int, lam: float) -> np.ndarray:
    if len(a) < 2:
        return np.full((a.shape[1], b.shape[1]), np.inf)  # told apart from pairs without a row
    return (a - a.mean(0)).T @ (b - b.mean(0)) / (len(a) - 1)


def _alike(ok: np.ndarray) -> list[np.ndarray]:
    """Columns that have their values on the same dates, together."""
    _, of = np.unique(ok.T, axis=0, return_inverse=True)
    return [np.flatnonzero(of.reshape(-1) == k) for k in range(of.max() + 1)]


def _windows(a: np.ndarray, b: np.ndarray, at: np.ndarray, kernel, n: int, lam: float) -> np.ndarray:
    """Matrices (dates of ``at``, columns of a, columns of b) over the ``n`` rows before, which each pair counts by itself; NaN where a pair has no row on the date."""
    out = np.full((len(at), a.shape[1], b.shape[1]), np.nan)
    ok_a, ok_b = ~np.isnan(a), ~np.isnan(b)
    for g in _alike(ok_a):
        for h in _alike(ok_b):
            rows = np.flatnonzero(ok_a[:, g[0]] & ok_b[:, h[0]])
            x, y = a[np.ix_(rows, g)], b[np.ix_(rows, h)]
            place = np.searchsorted(rows, at)
            there = (place < len(rows)) & (rows[np.minimum(place, len(rows) - 1)] == at) if len(rows) else np.zeros(len(at), bool)
            for t in np.flatnonzero(there):
                k = place[t]
                lo = max(0, k - n)
                out[np.ix_([t], g, h)] = kernel(x[lo:k], y[lo:k], n, lam)
    return out


def _cov_tiles(panel: DataFrame, kernel, n: int, lam: float, ridge: float, bare: float, only_rebalance: bool, size: int) -> DataFrame:
    """``ridge`` goes on the diagonal, ``bare`` where a pair has too few rows for the kernel (0 off the diagonal)."""
    tiles = written(tiles_of(panel, size=size))
    last = tiles.agg(F.max("tile")).first()[0] or 0
    left = tiles.withColumn("tile_b", F.explode(F.sequence(F.col("tile"), F.lit(last)))).select(F.col("tile").alias("tile_a"), "tile_b", F.col("assets").alias("assets_a"), F.col("days").alias("days_a"), F.col("rows").alias("rows_a"))
    right = tiles.withColumn("tile_a", F.explode(F.sequence(F.lit(0), F.col("tile")))).select("tile_a", F.col("tile").alias("tile_b"), F.col("assets").alias("assets_b"), F.col("days").alias("days_b"), F.col("rows").alias("rows_b"))
    schema = pa.schema([("tile_a", pa.int32()), ("tile_b", pa.int32()), ("dt", pa.date32()), ("assets_a", pa.list_(pa.string())), ("assets_b", pa.list_(pa.string())), ("cov", pa.list_(pa.float64()))])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                days, ia, ib = np.intersect1d(np.frombuffer(r["days_a"], np.int32), np.frombuffer(r["days_b"], np.int32), assume_unique=True, return_indices=True)
                a = np.frombuffer(r["rows_a"]).reshape(-1, len(r["assets_a"]))[ia]
                b = np.frombuffer(r["rows_b"]).reshape(-1, len(r["assets_b"]))[ib]
                at = np.flatnonzero((days + 3) % 7 == 4) if only_rebalance else np.arange(len(days))
                diagonal = r["tile_a"] == r["tile_b"]
                eye = np.eye(a.shape[1]) if diagonal else np.zeros((a.shape[1], b.shape[1]))
                for lot in np.split(at, range(256, len(at), 256)):  # bounded memory
                    if not len(lot):
                        continue
                    found = _windows(a, b, lot, kernel, n, lam)
                    found = np.where(np.isinf(found), bare * eye, found + ridge * eye)
                    flat = found.reshape(len(lot), -1)
                    cov = pa.ListArray.from_arrays(pa.array(np.arange(len(lot) + 1) * flat.shape[1], pa.int32()), pa.array(flat.reshape(-1), from_pandas=True))
                    yield pa.RecordBatch.from_arrays([pa.array([r["tile_a"]] * len(lot), pa.int32()), pa.array([r["tile_b"]] * len(lot), pa.int32()), pa.array(days[lot], pa.int32()).cast(pa.date32()), pa.array([r["assets_a"]] * len(lot)), pa.array([r["assets_b"]] * len(lot)), cov], schema=schema)

    return left.join(right, ["tile_a", "tile_b"]).mapInArrow(run, "tile_a int, tile_b int, dt date, assets_a array<string>, assets_b array<string>, cov array<double>")


def sample_cov_tiles(panel: DataFrame, n: int = 60, ridge: float = 1e-4, only_rebalance: bool = False, size: int = TILE) -> DataFrame:
    """(tile_a, tile_b, dt, assets_a, assets_b, cov): ``sample_cov`` as matrices, row by row; NULL where a pair has no return on the date."""
    return _cov_tiles(panel, _sample, n, 0.0, ridge, 1e-4, only_rebalance, size)


def ewma_cov_tiles(panel: DataFrame, lam: float = 0.94, n: int = 252, ridge: float = 1e-6, only_rebalance: bool = True, size: int = TILE) -> DataFrame:
    """``ewma_cov`` as matrices, each the product of two blocks of rows, the older ones weighted less: no powers grow, whatever ``n`` is."""
    return _cov_tiles(panel, _ewma, n, lam, ridge, 0.0, only_rebalance, size)


def from_tiles(tiles: DataFrame) -> DataFrame:
    """(asset_a <= asset_b, dt, cov): a row for each pair."""
    cells = tiles.select("tile_a", "tile_b", "dt", "assets_a", "assets_b", F.posexplode("cov").alias("k", "cov")).filter("cov is not null")
    q = F.size("assets_b")
    cells = cells.select((F.col("tile_a") == F.col("tile_b")).alias("same"), "dt", F.col("assets_a")[F.floor(F.col("k") / q).cast("int")].alias("a"), F.col("assets_b")[F.col("k") % q].alias("b"), "cov")
    return cells.filter("not same or a <= b").select(F.least("a", "b").alias("asset_a"), F.greatest("a", "b").alias("asset_b"), "dt", "cov")


def sample_cov(panel: DataFrame, n: int = 60, ridge: float = 1e-4, only_rebalance: bool = False) -> DataFrame:
    """(asset_a, asset_b, dt, cov): sample covariance of the ``n`` rows before, plus ``ridge`` on the diagonal; with fewer than two, 1e-4 of the identity."""
    return from_tiles(sample_cov_tiles(panel, n, ridge, only_rebalance))


def ewma_cov(panel: DataFrame, lam: float = 0.94, n: int = 252, ridge: float = 1e-6, only_rebalance: bool = True) -> DataFrame:
    """(asset_a, asset_b, dt, cov): S <- lam S + (1 - lam) r r' over the ``n`` rows before, from 0, plus ``ridge`` on the diagonal."""
    return from_tiles(ewma_cov_tiles(panel, lam, n, ridge, only_rebalance))


def turnover(weights: DataFrame, books: Sequence[str] = ("book_id",)) -> DataFrame:
    """(book.., dt, turnover): sum of the changes of weight; a first weight is no change."""
    s = Series("_series", "dt")
    rows = weights.withColumn("_series", F.struct(*books, "asset")).withColumn("_dw", F.abs(change("w", s)))
    return rows.groupBy(*books, "dt").agg(F.coalesce(F.sum("_dw"), F.lit(0.0)).alias("turnover"))


def exposures(positions: DataFrame) -> DataFrame:
    """(book_id, dt, asset, notional) of ``positions`` (book_id, dt, asset, shares, price)."""
    return positions.select("book_id", "dt", "asset", (F.col("shares") * F.col("price")).alias("notional"))


def attribution(positions: DataFrame, method: str = "reference") -> DataFrame:
    """(book_id, dt, asset, pnl). ``reference``: today's shares times price times return; ``exact``: yesterday's shares times the change of price."""
    if method == "reference":
        pnl = F.col("shares") * F.col("price") * F.coalesce("ret", F.lit(0.0))
    elif method == "exact":
        w = Window.partitionBy("book_id", "asset").orderBy("dt")
        pnl = F.coalesce(F.lag("shares").over(w) * (F.col("price") - F.lag("price").over(w)), F.lit(0.0))
    else:
        raise ValueError("method is 'reference' or 'exact'")
    return positions.select("book_id", "dt", "asset", pnl.alias("pnl"))


def risk_series(equity: DataFrame, turn: DataFrame) -> DataFrame:
    """(book_id, dt, ret, vol63, turnover, drawdown) of ``equity`` (book_id, dt, equity)."""
    s = Series("book_id", "dt")
    rows = equity.withColumn("ret", F.coalesce(F.col("equity") / F.lag("equity").over(s.all()) - 1, F.lit(0.0)))
    rows = rows.withColumns({"vol63": rolling_std("ret", 63, s) * ANNUAL**0.5, "cum": growth("ret", s)}).withColumn("drawdown", drawdown("cum", s))
    return rows.join(turn, ["book_id", "dt"], "left").select("book_id", "dt", "ret", "vol63", F.coalesce("turnover", F.lit(0.0)).alias("turnover"), "drawdown")
