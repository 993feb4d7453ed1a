"""Linear models from moments.

One pass over the rows gives each group's means and covariances, by Spark's own mergeable aggregates; all models of a group are then
solved from a matrix of as many columns as there are features.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.sources.shared import written


def _pairs(d: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(d) for b in range(a, d)]


def square(upper, d: int) -> np.ndarray:
    """Symmetric matrices (.., d, d) from upper triangles (.., d (d + 1) / 2)."""
    upper = np.asarray(upper, float)
    out = np.empty((*upper.shape[:-1], d, d))
    for k, (a, b) in enumerate(_pairs(d)):
        out[..., a, b] = out[..., b, a] = upper[..., k]
    return out


def gram(df: DataFrame, x: Sequence[str], y: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by.., n, mean, cov, y_mean, xy_cov, y_var): population moments of complete rows; ``cov`` is the upper triangle."""
    for c in [*x, *([y] if y else [])]:
        df = df.filter(F.col(c).isNotNull() & ~F.isnan(c))
    cols = [F.count("*").alias("n"), F.array(*[F.avg(c) for c in x]).alias("mean"), F.array(*[F.covar_pop(x[a], x[b]) for a, b in _pairs(len(x))]).alias("cov")]
    if y:
        cols += [F.avg(y).alias("y_mean"), F.array(*[F.covar_pop(c, y) for c in x]).alias("xy_cov"), F.var_pop(y).alias("y_var")]
    return df.groupBy(*by).agg(*cols)


def _solved(moments: DataFrame, d: int, by: Sequence[str], extra: str, f) -> DataFrame:
    """Rows of ``f(n, mean, cov, y_mean, xy_cov)``, each with its group's keys."""
    kinds = dict(moments.dtypes)

    def run(frames):
        for m in frames:
            out = []
            for row in m.itertuples(index=False):
                keys = [getattr(row, k) for k in by]
                got = f(float(row.n), np.array(row.mean), square(np.array(row.cov), d), float(row.y_mean), np.array(row.xy_cov))
                out += [(*keys, *g) for g in got]
            yield pd.DataFrame(out, columns=[*by, *[c.split()[0] for c in extra.split(", ")]])

    head = ", ".join(f"{k} {kinds[k]}" for k in by)
    return moments.mapInPandas(run, f"{head}, {extra}" if head else extra)


def _names(d: int) -> str:
    return ", ".join(f"b{j} double" for j in range(d + 1))


def ols(df: DataFrame, x: Sequence[str], y: str, by: Sequence[str] = ()) -> DataFrame:
    """(by.., b0..bd), from triangular factors, so that nearly collinear columns keep their digits. Columns without spread get 0."""

    def f(n, r):
        # Below the first row stands the factor of the columns less their means.
        mean, inner = r[0, 1:] / r[0, 0], r[1:, 1:]
        size = np.sqrt((inner**2).sum(0))
        flat = size <= 1e-14 * np.abs(r[0, 1:])
        size = np.where(flat | (size == 0), 1.0, size)
        a = np.where(flat[:-1], 0.0, inner[:, :-1] / size[:-1])
        b = np.linalg.lstsq(a, inner[:, -1], rcond=None)[0] / size[:-1]
        return [(float(mean[-1] - b @ mean[:-1]), *b.tolist())]

    return _from_factors(triangular(df, [*x, y], by), len(x) + 1, by, _names(len(x)), f)


# -- triangular factors -------------------------------------------------------------------------

#: Rows that are factored at a time, groups of which a task keeps a factor, and factors that meet in a step of the tree.
QR_ROWS, QR_GROUPS, QR_FAN = 16_384, 5_000, 16


def _factor(a: np.ndarray) -> np.ndarray:
    """The triangular factor, square and with a positive diagonal."""
    r = np.linalg.qr(a, mode="r")
    r = np.vstack([r, np.zeros((a.shape[1] - len(r), a.shape[1]))]) if len(r) < a.shape[1] else r
    return r * np.where(np.diagonal(r) < 0, -1.0, 1.0)[:, None]


def triangular(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by.., n, r): the triangular factor R of [1, columns] over complete rows, by rows of its square.

    Each task folds its rows into a factor a group; factors then meet in a tree, ``QR_FAN`` at a time. R has the singular values of the rows themselves,
    where a Gram matrix has their squares and so loses half the digits. A task holds ``QR_GROUPS`` factors at most and sends them on when there are more.
    """
    d = len(columns) + 1
    for c in columns:
        df = df.filter(F.col(c).isNotNull() & ~F.isnan(c))
    keys = [f"_k{k}" for k in range(len(by))]
    rows = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], *[F.col(c).cast("double").alias(f"_x{j}") for j, c in enumerate(columns)])
    kinds = dict(rows.dtypes)
    head = "".join(f"{k} {kinds[k]}, " for k in keys)

    def sent(held: dict) -> pd.DataFrame:
        return pd.DataFrame([(*g, n, r.ravel().tolist()) for g, (n, r) in held.items()], columns=[*keys, "n", "r"])

    def fold(frames):
        held: dict[tuple, tuple[int, np.ndarray]] = {}
        for frame in frames:
            a = np.column_stack([np.ones(len(frame)), frame[[f"_x{j}" for j in range(d - 1)]].to_numpy(float)])
            parts = frame.groupby(keys, dropna=False, sort=False).indices.items() if keys else [((), np.arange(len(frame)))]
            for g, at in parts:
                g = g if isinstance(g, tuple) else (g,)
                g = tuple(None if pd.isna(v) else v for v in g)
                for k in range(0, len(at), QR_ROWS):
                    part = a[at[k : k + QR_ROWS]]
                    n, r = held.get(g, (0, np.zeros((0, d))))
                    held[g] = (n + len(part), _factor(np.vstack([r, part])))
                if len(held) > QR_GROUPS:
                    yield sent(held)
                    held = {}
        if held:
            yield sent(held)

    parts = written(rows.mapInPandas(fold, head + "n long, r array<double>").withColumn("_node", F.spark_partition_id()))
    nodes = (parts.agg(F.max("_node")).first()[0] or 0) + 1

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        r = _factor(np.vstack([np.asarray(v).reshape(d, d) for v in frame["r"]]))
        return pd.DataFrame([(*[frame[k].iloc[0] for k in keys], int(frame["n"].sum()), r.ravel().tolist(), frame["_node"].iloc[0])], columns=[*keys, "n", "r", "_node"])

    while True:
        nodes = -(-nodes // QR_FAN)
        parts = parts.withColumn("_node", F.floor(F.col("_node") / QR_FAN).cast("int")).groupBy(*keys, "_node").applyInPandas(meet, head + "n long, r array<double>, _node int")
        if nodes == 1:
            return parts.select(*[F.col(k).alias(b) for b, k in zip(by, keys, strict=True)], "n", "r")


def _from_factors(factors: DataFrame, d: int, by: Sequence[str], extra: str, f) -> DataFrame:
    """Rows of ``f(n, r)``, each with its group's keys."""
    kinds = dict(factors.dtypes)

    def run(frames):
        for m in frames:
            out = []
            for row in m.itertuples(index=False):
                out += [(*[getattr(row, k) for k in by], *g) for g in f(int(row.n), np.asarray(row.r, float).reshape(d + 1, d + 1))]
            yield pd.DataFrame(out, columns=[*by, *[c.split()[0] for c in extra.split(", ")]])

    head = ", ".join(f"{k} {kinds[k]}" for k in by)
    return factors.mapInPandas(run, f"{head}, {extra}" if head else extra)


def _spread(cov: np.ndarray) -> np.ndarray:
    s = np.sqrt(np.maximum(np.diagonal(cov), 0))
    return np.where(s == 0, 1.0, s)


def condition(df: DataFrame, x: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by.., cond, warn): largest by smallest singular value of [1, X], from its triangular factor; infinite where columns depend on one another."""

    def f(n, r):
        s = np.linalg.svd(r, compute_uv=False)
        c = float(s[0] / s[-1]) if s[-1] > 0 else float("inf")
        return [(c, c > 1e6)]

    return _from_factors(triangular(df, x, by), len(x), by, "cond double, warn boolean", f)


def _unscaled(w, n, mean, cov, y_mean):
    s = _spread(cov) * np.sqrt(n / max(n - 1, 1))
    b = w / s
    return (y_mean - b @ mean, *b)


def _corr(n, cov, xy):
    """Correlations, and covariances with y by the sample deviation of x."""
    s = _spread(cov)
    r = cov / np.outer(s, s)
    return r, xy * np.sqrt(n / max(n - 1, 1)) / s


def ridge(df: DataFrame, x: Sequence[str], y: str, lams: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by.., lam, b0..bd) for each penalty, on columns standardized by their sample deviation; the intercept is free. One pass for all penalties."""

    def f(n, mean, cov, y_mean, xy):
        r, c = _corr(n, cov, xy)
        return [(float(lam), *_unscaled(np.linalg.solve((n - 1) * r + lam * np.eye(len(c)), (n - 1) * c), n, mean, cov, y_mean)) for lam in lams]

    return _solved(gram(df, x, y, by), len(x), by, f"lam double, {_names(len(x))}", f)


def coordinate_descent(g: np.ndarray, c: np.ndarray, threshold: float | np.ndarray, sweeps: int, tol: float = 0.0) -> np.ndarray:
    """Cyclic descent for many problems at once: g (.., d, d), c (.., d). Coordinates without spread stay 0."""
    w = np.zeros_like(c)
    for _ in range(sweeps):
        before = w.copy()
        for j in range(c.shape[-1]):
            rho = c[..., j] - np.einsum("...k,...k->...", g[..., j, :], w) + g[..., j, j] * w[..., j]
            size = g[..., j, j]
            w[..., j] = np.where(size > 0, np.sign(rho) * np.maximum(np.abs(rho) - threshold, 0) / np.where(size > 0, size, 1), 0.0)
        if np.sqrt(((w - before) ** 2).sum(-1)).max(initial=0.0) < tol:
            break
    return w


def lasso(df: DataFrame, x: Sequence[str], y: str, lams: Sequence[float], by: Sequence[str] = (), penalty_scale: str = "reference", sweeps: int = 5000, tol: float = 1e-6) -> DataFrame:
    """(by.., lam, b0..bd). ``reference``: a threshold of lam / n on sums over rows; ``standard``: lam on means over rows."""
    if penalty_scale not in ("reference", "standard"):
        raise ValueError("penalty_scale is 'reference' or 'standard'")

    def f(n, mean, cov, y_mean, xy):
        r, c = _corr(n, cov, xy)
        g, b = (n - 1) * r, (n - 1) * c
        return [(float(lam), *_unscaled(coordinate_descent(g, b, lam / n if penalty_scale == "reference" else lam * n, sweeps, tol), n, mean, cov, y_mean)) for lam in lams]

    return _solved(gram(df, x, y, by), len(x), by, f"lam double, {_names(len(x))}", f)


def ridge_forecast(n, mean, cov, y_mean, xy, at, alpha: float) -> np.ndarray:
    """Forecasts at ``at`` (N, d) of ridges, one for each row of moments, on columns scaled by their population deviation."""
    s = np.sqrt(np.maximum(np.diagonal(cov, axis1=-2, axis2=-1), 0))
    s = np.where(s <= 1e-150, 1.0, s)
    r = cov / (s[:, :, None] * s[:, None, :])
    eye = np.eye(mean.shape[1])
    w = np.linalg.solve(r + (alpha / n)[:, None, None] * eye, (xy / s)[..., None])[..., 0]
    return y_mean + ((at - mean) / s * w).sum(1)
