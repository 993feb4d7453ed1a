"""Forecasts, books and mini-batches against plain loops in numpy."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_models import naive_lasso, naive_ridge

from panelworks.functions.panel import FEATURES
from panelworks.operators import alpha, learn, stats, weights

DAY = dt.date(2021, 1, 1)
N = 300


@pytest.fixture(scope="module")
def panel(spark):
    rng, rows = np.random.default_rng(11), []
    for a in "AB":
        x = rng.normal(size=(N, 5)) * [1e-3, 1e-2, 1, 0.5, 1e-2]
        ret = rng.normal(size=N) * 0.01 + 0.3 * np.r_[0, x[:-1, 4]]
        rows += [(a, DAY + dt.timedelta(days=i), float(ret[i]), *map(float, x[i])) for i in range(N)]
    df = spark.createDataFrame(rows, "asset string, dt date, ret double, momentum double, volatility double, zscore double, beta_mkt double, ret_lag1 double").persist()
    return df, df.filter("asset = 'A'").orderBy("dt").toPandas()


def xy(a):
    return a[FEATURES].to_numpy(), np.r_[a["ret"].to_numpy()[1:], np.nan]


def naive_stack(xs, ys, at, x_all, y_all, k, ridge, lasso, meta):
    """Expanding folds with the remainder first, a meta-ridge on their predictions, bases refit on all rows."""
    size = len(ys) // (k + 1)
    starts = [len(ys) - (k - j) * size for j in range(k)]
    p = np.array([[naive_ridge(xs[:e], ys[:e], xs[i], ridge)[0], naive_lasso(xs[:e], ys[:e], xs[i], lasso)] for e in starts for i in range(e, e + size)])
    o = ys[starts[0] :]
    w = np.linalg.solve((p - p.mean(0)).T @ (p - p.mean(0)) + meta * np.eye(2), (p - p.mean(0)).T @ (o - o.mean()))
    base = np.array([naive_ridge(x_all, y_all, at, ridge)[0], naive_lasso(x_all, y_all, at, lasso)])
    return o.mean() + (base - p.mean(0)) @ w, p, o


def test_out_of_fold(panel):
    df, a = panel
    got = alpha.out_of_fold(df).filter("asset = 'A'").orderBy("dt").toPandas()
    x, y = xy(a)
    x, y = x[:-1][-252:], y[:-1][-252:]
    _, p, o = naive_stack(x, y, x[0], x, y, 5, 5.0, 0.0005, 1.0)
    assert got["fold"].tolist() == [i // 42 for i in range(210)]
    assert got[["p_ridge", "p_lasso"]].to_numpy() == pytest.approx(p, abs=1e-10) and got["y"].to_numpy() == pytest.approx(o)


@pytest.mark.parametrize("t", [120, 185, 251])
def test_stack_of_a_short_history(panel, t):
    df, a = panel
    got = alpha.stacked(df, min_train=60, only_rebalance=False).filter("asset = 'A'").orderBy("dt").toPandas()
    x, y = xy(a)
    assert got["dt"].iloc[0] == a["dt"].iloc[120]  # fewer rows make no stack
    assert got["raw"].iloc[t - 120] == pytest.approx(naive_stack(x[:t], y[:t], x[t], x[:t], y[:t], 5, 5.0, 0.0005, 1.0)[0], abs=1e-10)


def test_forecast_today(panel):
    df, a = panel
    got = {r["asset"]: r for r in alpha.forecast_today(df).collect()}
    x, y = xy(a)
    x, y = x[:-1], y[:-1]
    assert got["A"]["n"] == N - 1
    assert got["A"]["mu"] == pytest.approx(naive_stack(x, y, x[-1], x, y, 3, 1.0, 0.001, 5.0)[0], abs=1e-10)


def test_trees_and_their_stack(spark, panel):
    df, a = panel
    few = {"forest": {"numTrees": 3}, "boosting": {"maxIter": 2}}
    got = alpha.tree_out_of_fold(df, **few).orderBy("asset", "dt").toPandas()
    assert len(got) == 2 * 210 and got.groupby(["asset", "fold"]).size().eq(42).all()
    # What comes after a fold does not change its predictions.
    cut = a["dt"].iloc[-3]
    late = df.withColumn("ret", F.when(F.col("dt") > F.lit(cut), 9.0).otherwise(F.col("ret")))
    again = alpha.tree_out_of_fold(late, **few).orderBy("asset", "dt").toPandas()
    early = got["fold"] < 4
    assert got.loc[early, ["p_forest", "p_boost"]].equals(again.loc[early, ["p_forest", "p_boost"]])
    whole = {r["asset"]: r for r in alpha.stacked_with_trees(df, **few).collect()}["A"]
    linear = alpha.out_of_fold(df).filter("asset = 'A'").orderBy("dt").toPandas()
    p = np.column_stack([linear[["p_ridge", "p_lasso"]].to_numpy(), got.loc[got["asset"] == "A", ["p_forest", "p_boost"]].to_numpy()])
    y = linear["y"].to_numpy()
    w = np.linalg.solve((p - p.mean(0)).T @ (p - p.mean(0)) + np.eye(4), (p - p.mean(0)).T @ (y - y.mean()))
    base = np.array([whole[b] for b in alpha.BASES])
    x, y_all = xy(a)
    assert base[0] == pytest.approx(naive_ridge(x[:-1], y_all[:-1], x[-1], 5.0)[0], abs=1e-10)
    assert whole["n"] == 210 and whole["raw"] == pytest.approx(y.mean() + (base - p.mean(0)) @ w, abs=1e-10)


def books(spark, n=90):
    rng, rows = np.random.default_rng(4), []
    for b in ("x", "y", "z"):
        for i in range(n):
            rows += [(b, DAY + dt.timedelta(days=i), a, float(rng.normal() * 0.3), float(rng.normal() * 0.01), float(rng.normal()), 0.15) for a in "PQR"]
    return rows, spark.createDataFrame(rows, "book_id string, dt date, asset string, w double, ret double, beta double, sigma_vol double")


def test_history_vol_target(spark):
    rows, df = books(spark)
    got = {(r["book_id"], r["dt"], r["asset"]): r["w"] for r in weights.history_vol_target(df, window=20).collect()}
    for b in ("x", "z"):
        raw, ret = (np.array([r[j] for r in rows if r[0] == b]).reshape(-1, 3) for j in (3, 4))
        out = np.zeros_like(raw)
        for t in range(len(raw)):
            past, vol = range(max(0, t - 20), t), float("nan")
            if len(past) >= 2:
                vol = np.std([sum(ret[i, j] * (out[i - 1, j] if i > past[0] else 0.0) for j in range(3)) for i in past], ddof=1) * 252**0.5
            vol = vol if np.isfinite(vol) and vol != 0 else 0.15
            out[t] = np.clip(raw[t] * 0.10 / vol, -1.5, 1.5)
        assert all(got[b, DAY + dt.timedelta(days=t), a] == pytest.approx(out[t, j]) for t in range(len(raw)) for j, a in enumerate("PQR"))


def test_blended(spark):
    rows, df = books(spark, 12)
    cov = np.diag([1e-4, 2e-4, 3e-4]) + 2e-5
    pairs = [(DAY + dt.timedelta(days=i), a, b, float(cov[j, k])) for i in range(12) for j, a in enumerate("PQR") for k, b in enumerate("PQR") if j <= k]
    got = {(r["book_id"], r["dt"], r["asset"]): r["w"] for r in weights.blended(df, spark.createDataFrame(pairs, "dt date, asset_a string, asset_b string, cov double")).collect()}
    for b in ("x", "y"):
        raw, beta = (np.array([r[j] for r in rows if r[0] == b]).reshape(-1, 3) for j in (3, 5))
        last = np.zeros(3)
        for t in range(12):
            w = np.clip(0.4 * raw[t] + 0.6 * last, -0.3, 0.3)
            w = w * min(1.0, 1.5 / np.abs(w).sum())
            w = np.clip(w - (beta[t] @ w) / (beta[t] @ beta[t]) * beta[t], -0.3, 0.3)
            last = np.clip(w * 0.12 / (np.sqrt(w @ cov @ w) * 252**0.5), -0.3, 0.3)
            assert [got[b, DAY + dt.timedelta(days=t), a] for a in "PQR"] == pytest.approx(last.tolist())


@pytest.mark.parametrize("name", ["sgd", "momentum", "adam"])
def test_minibatches_follow_the_update_rules(spark, name):
    rng = np.random.default_rng(9)
    x, c = rng.normal(size=(150, 2)), rng.integers(0, 2, 150)
    df = spark.createDataFrame([(i, float(a), float(b), float(y)) for i, ((a, b), y) in enumerate(zip(x, c, strict=True))], "row_id long, x1 double, x2 double, c double")
    opt = {"sgd": learn.sgd(0.2), "momentum": learn.momentum(0.15), "adam": learn.adam(0.05)}[name]
    got, losses = learn.train_minibatch(df, ["x1", "x2"], "c", "row_id", opt, 64, 2)
    z, w, m, v, t = np.column_stack([np.ones(150), x]), np.zeros(3), np.zeros(3), np.zeros(3), 0
    for epoch in (1, 2):
        batch = np.array([r["b"] for r in df.select("row_id", stats.batch_of("row_id", epoch, 3).alias("b")).orderBy("row_id").collect()])
        assert set(batch) == {0, 1, 2}
        for b in range(3):
            rows, t = batch == b, t + 1
            g = z[rows].T @ (1 / (1 + np.exp(-z[rows] @ w)) - c[rows]) / rows.sum()
            if name == "sgd":
                w = w - 0.2 * g
            elif name == "momentum":
                m = 0.9 * m + g
                w = w - 0.15 * m
            else:
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    assert got == pytest.approx(w) and len(losses) == 2


def test_gram_and_its_leading_pair(spark):
    x = np.random.default_rng(2).normal(size=(80, 4)) + [3, 0, 1, 0]
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>")
    gram = learn.gram_of_vectors(df)
    assert {(r["i"], r["j"]): pytest.approx(r["v"]) for r in gram.collect()} == {(i + 1, j + 1): (x.T @ x)[i, j] for i in range(4) for j in range(4)}
    lam, vec = learn.power_iteration(gram)
    values, vectors = np.linalg.eigh(x.T @ x)
    assert lam == pytest.approx(values[-1], rel=1e-12)
    assert np.abs([r["x"] for r in vec.orderBy("i").collect()]) == pytest.approx(np.abs(vectors[:, -1]), abs=1e-8)
    assert learn.gram_of_vectors(df.limit(0)).count() == 0


def test_stack_with_trees_computes_its_features_once(spark, panel):
    df, _ = panel
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    few = {"forest": {"numTrees": 2}, "boosting": {"maxIter": 1}}
    assert alpha.stacked_with_trees(df.mapInArrow(count, df.schema), **few).count() == 2
    assert seen.value == df.count()
