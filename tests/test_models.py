"""Models against plain numpy: row by row, refit by refit, day by day."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelworks.functions.panel import FEATURES, S, Series
from panelworks.operators import alpha, book, learn, linear, risk, series, weights

RNG = np.random.default_rng(7)
DAY = dt.date(2020, 1, 1)


@pytest.fixture(scope="module")
def table(spark):
    x = RNG.normal(size=(300, 3)) @ np.array([[1, 0.3, 0], [0, 1, 0.5], [0, 0, 2]]) + [1, -2, 30]
    y = x @ [2, -1.5, 0.5] + 3 + RNG.normal(size=300) * 0.1
    rows = [("g", i, *map(float, r), float(v), float(v > np.median(y))) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    return x, y, spark.createDataFrame(rows, "grp string, row_id long, x1 double, x2 double, x3 double, y double, c double").persist()


X = ["x1", "x2", "x3"]


def coef(df):
    r = df.first()
    return np.array([r[f"b{j}"] for j in range(4)])


def test_ols(table):
    x, y, df = table
    b = np.column_stack([np.ones(len(x)), x])
    assert coef(linear.ols(df, X, "y", ["grp"])) == pytest.approx(np.linalg.lstsq(b, y, rcond=None)[0], rel=1e-8)
    assert linear.condition(df, X).first()["cond"] == pytest.approx(np.linalg.cond(b), rel=1e-6)


def test_ridge(table):
    x, y, df = table
    s = x.std(0, ddof=1)
    z = np.column_stack([np.ones(len(x)), (x - x.mean(0)) / s])
    w = np.linalg.solve(z.T @ z + 10 * np.diag([0, 1, 1, 1]), z.T @ y)
    want = [w[0] - (w[1:] * x.mean(0) / s).sum(), *(w[1:] / s)]
    assert coef(linear.ridge(df, X, "y", [10.0])) == pytest.approx(want, rel=1e-8)


def test_lasso_conditions(table):
    x, y, df = table
    lam = 0.3
    b = coef(linear.lasso(df, X, "y", [lam], penalty_scale="standard"))
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    g = z.T @ (y - b[0] - x @ b[1:]) / len(x)
    for j in range(3):
        assert g[j] == pytest.approx(lam * np.sign(b[1 + j]), abs=1e-5) if b[1 + j] else abs(g[j]) <= lam + 1e-6


def test_logistic(table):
    x, _, df = table
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    c = np.array([r["c"] for r in df.orderBy("row_id").collect()])
    std = df.sparkSession.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(z, c, strict=True))], "row_id long, x1 double, x2 double, x3 double, c double")
    w, losses = learn.logistic_gd(std, X, "c", 0.4, 6, 0.0, 1.0)
    v, b = np.zeros(4), np.column_stack([np.ones(len(z)), z])
    for k in range(6):
        p = 1 / (1 + np.exp(-b @ v))
        assert losses[k] == pytest.approx(-np.mean(c * np.log(p) + (1 - c) * np.log(1 - p)))
        v = v - 0.4 * (b.T @ (p - c) / len(c) + np.r_[0, v[1:]] / len(c))
    assert w == pytest.approx(v)
    first = {n: learn.train_minibatch(std, X, "c", "row_id", o, 300, 2)[1] for n, o in (("sgd", learn.sgd(0.2)), ("mom", learn.momentum(0.15)), ("adam", learn.adam(0.05)))}
    assert all(a[1] < a[0] < np.log(2) for a in first.values())


def test_power_iteration(spark):
    a = RNG.normal(size=(6, 6))
    a = a @ a.T + np.eye(6)
    rows = [(i, j, float(a[i, j])) for i in range(6) for j in range(6)]
    lam, x = learn.power_iteration(spark.createDataFrame(rows, "i long, j long, v double"), 60, 1e-3)
    assert lam == pytest.approx(np.linalg.eigvalsh(a)[-1], rel=1e-3)


def test_kmeans_and_pca(spark, table):
    x, _, df = table
    pts = df.select("row_id", F.array(*X).alias("x"))
    start = x[[0, 100, 200]]
    centres, inertia, _ = learn.kmeans(pts, start, max_iter=3, tol=0.0)
    want = start.copy()
    for _ in range(3):
        near = ((x[:, None] - want) ** 2).sum(-1).argmin(1)
        want = np.array([x[near == k].mean(0) if (near == k).any() else want[k] for k in range(3)])
    assert centres == pytest.approx(want)
    assert inertia == pytest.approx(((x[:, None] - want) ** 2).sum(-1).min(1).sum())
    m = learn.pca(df, X, 3)
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert m.ratios == pytest.approx(values / values.sum())
    z = df.withColumns({f"z{j}": c for j, c in enumerate(m.scores(X))})
    back = z.select(*[c.alias(f"r{j}") for j, c in enumerate(m.rebuilt(["z0", "z1", "z2"]))], *X).collect()
    assert all(abs(r[f"r{j}"] - r[X[j]]) < 1e-9 for r in back for j in range(3))


@pytest.fixture(scope="module")
def panel(spark):
    rows, n = [], 330
    for a in "AB":
        x = RNG.normal(size=(n, 5)) * [1e-3, 1e-2, 1, 0.5, 1e-2]
        ret = RNG.normal(size=n) * 0.01 + 0.2 * np.r_[0, x[:-1, 4]]
        rows += [(a, DAY + dt.timedelta(days=i), float(ret[i]), *map(float, x[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "asset string, dt date, ret double, momentum double, volatility double, zscore double, beta_mkt double, ret_lag1 double").persist()
    return df, df.filter("asset = 'A'").orderBy("dt").toPandas()


def naive_ridge(x, y, at, alpha):
    mu, s = x.mean(0), x.std(0)
    z = (x - mu) / s
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return (y.mean() + (at - mu) / s @ w), mu, s, w


def naive_lasso(x, y, at, alpha):
    mu, s = x.mean(0), x.std(0)
    z = (x - mu) / s
    w = linear.coordinate_descent(z.T @ z / len(z), z.T @ (y - y.mean()) / len(z), alpha, 200, 1e-14)
    return y.mean() + (at - mu) / s @ w


def test_walk_forward_is_a_refit_each_day(panel):
    df, a = panel
    got = alpha.walk_forward_ridge(df).filter("asset = 'A'").orderBy("dt").toPandas()
    x, y = a[FEATURES].to_numpy(), np.r_[a["ret"].to_numpy()[1:], np.nan]
    want = [naive_ridge(x[:t], y[:t], x[t], 5.0)[0] for t in range(252, len(a) - 1)]
    assert got["yhat"].to_numpy() == pytest.approx(np.array(want), abs=1e-12)


@pytest.mark.parametrize("meta", [1.0, 1e-5])
def test_stack_from_moments_is_a_stack_of_rows(panel, meta):
    df, a = panel
    got = alpha.stacked(df, meta_alpha=meta, only_rebalance=False).filter("asset = 'A'").orderBy("dt").toPandas()
    x, y = a[FEATURES].to_numpy(), np.r_[a["ret"].to_numpy()[1:], np.nan]
    for row, t in ((0, 252), (40, 292)):
        xs, ys = x[t - 252 : t], y[t - 252 : t]
        p = np.array([[naive_ridge(xs[:e], ys[:e], xs[i], 5.0)[0], naive_lasso(xs[:e], ys[:e], xs[i], 0.0005)] for k in range(5) for e in (42 + 42 * k,) for i in range(e, e + 42)])
        o = ys[42:]
        w = np.linalg.solve((p - p.mean(0)).T @ (p - p.mean(0)) + meta * np.eye(2), (p - p.mean(0)).T @ (o - o.mean()))
        base = np.array([naive_ridge(x[:t], y[:t], x[t], 5.0)[0], naive_lasso(x[:t], y[:t], x[t], 0.0005)])
        assert got.loc[row, ["meta_ridge", "meta_lasso"]].to_numpy(float) == pytest.approx(w, rel=1e-6)
        assert got.loc[row, "raw"] == pytest.approx(o.mean() + (base - p.mean(0)) @ w, abs=1e-10)


def test_ewma(panel):
    df, _ = panel
    wide = df.groupBy("dt").pivot("asset").agg(F.first("ret")).orderBy("dt").toPandas()
    r, s = wide[["A", "B"]].to_numpy(), np.zeros((2, 2))
    for v in r[300 - 252 : 300]:
        s = 0.94 * s + 0.06 * np.outer(v, v)
    got = risk.ewma_cov(df, only_rebalance=False).filter(F.col("dt") == F.lit(DAY + dt.timedelta(days=300))).collect()
    assert {(g["asset_a"], g["asset_b"]): pytest.approx(g["cov"]) for g in got} == {("A", "A"): s[0, 0] + 1e-6, ("A", "B"): s[0, 1], ("B", "B"): s[1, 1] + 1e-6}


def test_weights_on_the_identity(spark):
    mu = spark.createDataFrame([(DAY, "A", 0.01), (DAY, "B", -0.02)], "dt date, asset string, mu double")
    cov = spark.createDataFrame([(DAY, "A", "A", 1.0), (DAY, "A", "B", 0.0), (DAY, "B", "B", 1.0)], "dt date, asset_a string, asset_b string, cov double")
    w = {r["asset"]: r["w"] for r in weights.mean_variance(mu, cov, 0.015).collect()}
    assert w == {"A": pytest.approx(0.005), "B": pytest.approx(-0.01)}
    assert {r["asset"]: r["w"] for r in weights.mean_variance_long(mu, cov, None).collect()} == {"A": 1.0, "B": 0.0}


def test_replay_is_self_financing(spark):
    rows = [("b", DAY + dt.timedelta(days=i), a, w, p) for i, (wa, wb, pa, pb) in enumerate([(0.5, 0.4, 10, 20), (0.5, 0.4, 11, 19), (-0.2, 1.0, 12, 21), (1.4, 1.4, 9, 25)]) for a, w, p in (("A", wa, float(pa)), ("B", wb, float(pb)))]
    df = spark.createDataFrame(rows, "book_id string, dt date, asset string, w double, price double")
    trades = book.replay(df.drop("price"), df.select("dt", "asset", "price"))
    t = trades.orderBy("dt", "asset").collect()
    assert {r["dt"].day for r in t} == {1, 3, 4}  # the second day moves no weight
    eq = book.equity(trades, df.select("dt", "asset", "price")).orderBy("dt").collect()
    assert eq[0]["equity"] == pytest.approx(500 - 500 * 0.9 * 1e-4) and min(e["cash"] for e in eq) >= 0
    assert t[0]["qty"] == pytest.approx(25.0) and t[0]["fill_px"] == pytest.approx(10.001)


def test_adf(spark):
    n = 300
    walk, noise = np.cumsum(RNG.normal(size=n)), RNG.normal(size=n)
    rows = [(k, i, float(v[i])) for k, v in (("walk", walk), ("noise", noise)) for i in range(n)]
    got = {r["series_id"]: r for r in series.adf(spark.createDataFrame(rows, "series_id string, t int, value double"), 4).collect()}
    for k, v in (("walk", walk), ("noise", noise)):
        d, best = np.diff(v), None
        for lag in range(5):
            fit = lambda first, lag: (np.column_stack([np.ones(n - 1 - first), v[first : n - 1], *[d[first - j : n - 1 - j] for j in range(1, lag + 1)]]), d[first:])  # noqa: B023, E731
            x, y = fit(4, lag)
            e = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
            aic = len(y) * np.log(e @ e / len(y)) + 2 * x.shape[1]
            best = min(best or (aic, lag), (aic, lag))
        x, y = fit(best[1], best[1])
        c = np.linalg.lstsq(x, y, rcond=None)[0]
        e = y - x @ c
        se = np.sqrt(e @ e / (len(y) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])
        assert got[k]["lags"] == best[1] and got[k]["stat"] == pytest.approx(c[1] / se, rel=1e-6)
    assert got["noise"]["p_value"] < 0.01 < got["walk"]["p_value"]
    assert series.mackinnon_p(-2.86) == pytest.approx(0.05, abs=0.002)


def test_series_keys():
    assert S == Series("asset", "dt")


def test_weekly_books_follow_the_forecasts(spark, monkeypatch):
    from panelworks.functions import panel as P
    from panelworks.plans import model_queries as m

    # Seven assets, two years of dates: no number of assets is given.
    rng, start = np.random.default_rng(5), DAY
    days = [t for t in (start + dt.timedelta(days=i) for i in range(620)) if t.weekday() < 5]
    rows = [(f"a{k}", t, float(p), float(v)) for k in range(7) for v_ in [rng.normal(0, 0.01, len(days))] for t, p, v in zip(days, 100 * np.cumprod(1 + v_), v_, strict=True)]
    frame = spark.createDataFrame(rows, "asset string, dt date, price double, ret double").withColumn("mkt_ret", F.avg("ret").over(Window.partitionBy("dt"))).persist()
    monkeypatch.setattr(m, "panel", lambda *_: frame)
    seen = {}
    made = m.weights.weekly_weights
    monkeypatch.setattr(m.weights, "weekly_weights", lambda f, mu, cov, book: seen.setdefault(book, mu) is None or made(f, mu, cov, book=book))
    got = {(r["book_id"], r["asset"], r["dt"]): r["w"] for r in m.o7_weekly_weights(spark, "").collect()}
    f = P.features(frame)
    want = {"ridge": (m.alpha.walk_forward_ridge(f), "yhat"), "stacked": (m.alpha.stacked(f), "mu")}
    for book, (all_, name) in want.items():
        mu = {(r["asset"], r["dt"]): r["mu"] for r in seen[book].collect()}
        full = {(r["asset"], r["dt"]): r[name] for r in all_.collect()}
        assert len(mu) >= 7 * 20 and all(v == pytest.approx(full[k], abs=1e-12) for k, v in mu.items())
        assert any(w for (b, _, _), w in got.items() if b == book)
    assert {r["strategy"] for r in m.n5_weekly_backtest(spark, "").collect()} == {"ridge", "stacked", "equal"}


def test_x3_lags_go_by_length(spark, monkeypatch):
    from panelworks.plans import panel_queries as q

    # A memory of 20 rows in a series of 2,400, where the rule allows 27 lags; the short series is allowed 12.
    rng, n = np.random.default_rng(3), 2400
    v = rng.normal(size=n)
    for i in range(20, n):
        v[i] += 0.6 * v[i - 20]
    rows = [(k, DAY + dt.timedelta(days=i), float(x)) for k, part in (("long", v), ("short", v[:100])) for i, x in enumerate(part)]
    monkeypatch.setattr(q, "panel", lambda *_: spark.createDataFrame(rows, "asset string, dt date, ret double"))
    got = {r["asset"]: r["lags"] for r in q.x3_adf(spark, "").collect()}
    assert 12 < got["long"] <= 27 and got["short"] <= 12
