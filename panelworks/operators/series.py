"""Tests on many series at once: Ljung-Box and augmented Dickey-Fuller."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelworks.functions.panel import Series
from panelworks.operators.stats import acf, chi2_tail

T = Series("series_id", "t")


def ljung_box(df: DataFrame, lags: int = 10, value: str = "value", s: Series = T) -> DataFrame:
    """(series_id, lag, q, p_value) for 1 to ``lags`` lags."""
    rows = acf(df, lags, value, s)
    w = Window.partitionBy(s.key).orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)
    q = F.col("n") * (F.col("n") + 2) * F.sum(F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag"))).over(w)
    return rows.select(s.key, "lag", q.alias("q")).withColumn("p_value", chi2_tail(F.col("q"), F.col("lag"), lags))


def mackinnon_p(stat: float) -> float:
    """Approximate p-value of the test with a constant. Published response-surface coefficients."""
    if stat > 2.74:
        return 1.0
    if stat < -18.83:
        return 0.0
    c = (2.1659, 1.4412, 0.038269) if stat <= -1.61 else (1.7339, 0.93202, -0.12745, -0.010368)
    z = sum(a * stat**k for k, a in enumerate(c))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _adf_row(n: int, grams: np.ndarray, ys: np.ndarray, yy: np.ndarray, rows: np.ndarray) -> tuple[float, int, int]:
    """Pick the lag of least AIC on the common sample, then the statistic on the sample of that lag alone.

    ``grams[m]``: moments of (1, level, m lags) on the sample of m lags; the last is also the common sample's.
    """
    top = len(rows) - 1

    def fit(g, b, s, m, k):
        g, b = g[: 2 + k, : 2 + k], b[: 2 + k]
        coef = np.linalg.lstsq(g, b, rcond=None)[0]
        return coef, max(s - coef @ b, 1e-300), g

    best = min(range(top + 1), key=lambda k: rows[top] * math.log(fit(grams[top], ys[top], yy[top], rows[top], k)[1] / rows[top]) + 2 * (2 + k))
    coef, sse, g = fit(grams[best], ys[best], yy[best], rows[best], best)
    var = sse / (rows[best] - 2 - best) * np.linalg.pinv(g)[1, 1]
    return float(coef[1] / math.sqrt(var)), best, int(rows[best])


def adf(df: DataFrame, max_lag: int | None = None, value: str = "value", s: Series = T) -> DataFrame:
    """(series_id, stat, p_value, lags, n_obs): augmented Dickey-Fuller with a constant, lag by AIC.

    One sort gives the level and the lagged differences; moments of all samples come from one aggregation, so a series
    is a few matrices of max_lag + 2 columns when it reaches the helper. ``max_lag`` None: the common rule, for the longest series.
    """
    rows = df.filter(F.col(value).isNotNull()).withColumn("_n", F.count("*").over(Window.partitionBy(s.key)))
    if max_lag is None:
        n = rows.agg(F.max("_n")).first()[0] or 10
        max_lag = max(0, min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2))
    w = s.all()
    rows = rows.withColumn("_d", F.col(value) - F.lag(value).over(w)).withColumns({"_y": F.lag(value).over(w), "_i": F.row_number().over(w)})
    rows = rows.withColumns({f"_d{k}": F.lag("_d", k).over(w) for k in range(1, max_lag + 1)})
    # Levels about the series' mean, for accuracy; the constant takes it up.
    rows = rows.withColumn("_y", F.col("_y") - F.avg(value).over(Window.partitionBy(s.key)))
    x = [F.lit(1.0), F.col("_y"), *[F.col(f"_d{k}") for k in range(1, max_lag + 1)]]
    # Row i (from 1) belongs to the samples of at most i - 2 lags: sums by that number, added up from above.
    rows = rows.filter("_i >= 2").withColumn("_s", F.least(F.col("_i") - 2, F.lit(max_lag)))
    pairs = [(a, b) for a in range(len(x)) for b in range(a, len(x))]
    sums = rows.groupBy(s.key, "_s", "_n").agg(
        F.count("*").alias("m"),
        F.sum(F.col("_d") * F.col("_d")).alias("yy"),
        F.array(*[F.coalesce(F.sum(c * F.col("_d")), F.lit(0.0)) for c in x]).alias("xy"),
        F.array(*[F.coalesce(F.sum(x[a] * x[b]), F.lit(0.0)) for a, b in pairs]).alias("xx"),
    )
    one = sums.groupBy(s.key, "_n").agg(F.array_sort(F.collect_list(F.struct("_s", "m", "yy", "xy", "xx"))).alias("parts"))  # at most max_lag + 1 parts
    d = len(x)

    def run(frames):
        for f in frames:
            out = []
            for key, n, parts in zip(f[s.key], f["_n"], f["parts"], strict=True):
                grams, ys = np.zeros((max_lag + 1, d, d)), np.zeros((max_lag + 1, d))
                yy, m = np.zeros(max_lag + 1), np.zeros(max_lag + 1)
                for p in parts:
                    g = np.zeros((d, d))
                    for (a, b), v in zip(pairs, p["xx"], strict=True):
                        g[a, b] = g[b, a] = v
                    k = p["_s"]
                    grams[: k + 1] += g
                    ys[: k + 1] += np.array(p["xy"])
                    yy[: k + 1] += p["yy"]
                    m[: k + 1] += p["m"]
                top = max(0, min(max_lag, math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2))
                stat, lag, obs = _adf_row(n, grams[: top + 1], ys[: top + 1], yy[: top + 1], m[: top + 1])
                out.append((key, stat, mackinnon_p(stat), lag, obs))
            yield pd.DataFrame(out, columns=[s.key, "stat", "p_value", "lags", "n_obs"])

    kind = dict(df.dtypes)[s.key]
    return one.mapInPandas(run, f"{s.key} {kind}, stat double, p_value double, lags int, n_obs long")
