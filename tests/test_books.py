"""Whole jobs against plain loops over dates: the multi-asset book, the stacked weekly book and the live run."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelworks.functions import panel as P
from panelworks.operators import alpha, stats
from panelworks.plans import model_queries as m

ASSETS = ["aa", "bbb", "cccc"]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(11)
    days = [t for t in (dt.date(2022, 1, 3) + dt.timedelta(days=i) for i in range(520)) if t.weekday() < 5]
    rows = []
    for a in ASSETS:
        v = rng.normal(0, 0.01, len(days))
        v[1:] += 0.1 * v[:-1]
        rows += [(a, t, float(p), float(r)) for t, p, r in zip(days, 100 * np.cumprod(1 + v), v, strict=True)]
    df = spark.createDataFrame(rows, "asset string, dt date, price double, ret double")
    return df.withColumn("mkt_ret", F.avg("ret").over(Window.partitionBy("dt"))).persist()


@pytest.fixture(scope="module")
def plain(frame):
    """Dates, returns (dates, assets) of the panel, and the features by date and asset."""
    wide = frame.groupBy("dt").pivot("asset", ASSETS).agg(F.first("ret")).orderBy("dt").toPandas()
    feats = {(r["dt"], r["asset"]): r for r in P.features(frame).collect()}
    return list(wide["dt"]), wide[ASSETS].to_numpy(), feats


def capped(w, gross, each):
    w = np.clip(w, -each, each)
    return w * min(1.0, gross / np.abs(w).sum()) if np.abs(w).sum() > 0 else w


def metrics(net):
    growth = np.cumprod(1 + np.array(net))
    return len(net), growth[-1] - 1, np.mean(net) / np.std(net, ddof=1) * 252**0.5, (growth / np.maximum.accumulate(growth) - 1).min()


def check(got, net):
    n, total, sharpe, drawdown = metrics(net)
    assert got["n"] == n and got["total_return"] == pytest.approx(total, abs=2e-6)
    assert got["sharpe"] == pytest.approx(sharpe, abs=2e-5) and got["max_drawdown"] == pytest.approx(drawdown, abs=2e-6)


def test_multi_asset_books(spark, frame, plain, monkeypatch):
    monkeypatch.setattr(m, "panel", lambda *_: frame)
    got = {r["strategy"]: r for r in m.n5_multi_asset(spark, "").collect()}
    days, ret, feats = plain
    own = [t for t in days if all((t, a) in feats for a in ASSETS)]
    x = {a: np.array([[feats[t, a][c] for c in P.FEATURES] for t in own]) for a in ASSETS}
    r = np.array([[feats[t, a]["ret"] for a in ASSETS] for t in own])
    for book, gross in m.CAPS.items():
        held, scaled, net = [], [], []
        for k in range(252, len(own) - 1):
            mu = []
            for j, a in enumerate(ASSETS):
                z, y = x[a][:k], r[1 : k + 1, j]
                s = z.std(0)
                z = (z - z.mean(0)) / s
                w = np.linalg.solve(z.T @ z + 5 * np.eye(z.shape[1]), z.T @ (y - y.mean()))
                mu.append(y.mean() + (x[a][k] - x[a][:k].mean(0)) / s @ w)
            t = days.index(own[k])
            cov = np.cov(ret[t - 60 : t].T) + 1e-4 * np.eye(3)
            raw = capped(np.linalg.pinv(cov, rcond=1e-10) @ np.array(mu), gross, 0.3)
            i = len(held)
            lo, vol = max(0, i - 60), np.nan
            if i - lo >= 2:
                before = np.vstack([np.zeros((1, 3)), np.array(scaled[lo : i - 1]).reshape(-1, 3)])
                vol = np.std((np.array([h[1] for h in held[lo:i]]) * before).sum(1), ddof=1) * 252**0.5
            if not np.isfinite(vol) or vol == 0:
                vol = np.sqrt(raw @ cov @ raw) * 252**0.5
            w = np.clip(raw * (0.10 / vol if vol > 1e-8 else 1.0), -1.5, 1.5)
            last = scaled[-1] if scaled else np.zeros(3)
            net.append(last @ r[k] - 5e-4 * np.abs(w - last).sum())
            held.append((own[k], r[k]))
            scaled.append(w)
        check(got[book], net)


def test_plan_of_the_multi_asset_books_is_short(spark, frame, monkeypatch):
    monkeypatch.setattr(m, "panel", lambda *_: frame)
    jobs = m.n5_multi_asset(spark, "")._jdf.queryExecution().optimizedPlan().toString()
    assert jobs.count("Join") <= 4 and len(jobs) < 60_000


def test_stacked_weekly_book(spark, frame, plain, monkeypatch):
    monkeypatch.setattr(m, "panel", lambda *_: frame)
    made = alpha.stacked_trees
    monkeypatch.setattr(m.alpha, "stacked_trees", lambda f: made(f, n_trees=2, rounds=3, bound=0.05, least=0.0))
    monkeypatch.setattr(m, "TOP_K", 2)
    got = {r["strategy"]: r for r in m.n5_stacked_trees(spark, "").collect()}
    days, ret, feats = plain
    mus = {(q["dt"], q["asset"]): q["mu"] for q in made(P.features(frame), n_trees=2, rounds=3, bound=0.05, least=0.0).collect()}
    own = [t for t in days if all((t, a) in feats for a in ASSETS)]
    w, net, n = np.zeros(3), [], 0
    for t in own:
        r = np.array([feats[t, a]["ret"] for a in ASSETS])
        last = w
        if all((t, a) in mus for a in ASSETS):
            mu = np.array([mus[t, a] for a in ASSETS])
            mu[np.argsort(-np.abs(mu), kind="stable")[2:]] = 0.0
            k, s = days.index(t), np.zeros((3, 3))
            for v in ret[max(0, k - 252) : k]:
                s = 0.94 * s + 0.06 * np.outer(v, v)
            s = s + 5e-6 * np.eye(3)
            new = capped(np.linalg.pinv(s, rcond=1e-10) @ mu, 1.5, 0.3)
            beta = np.array([feats[t, a]["beta_mkt"] for a in ASSETS])
            new = np.clip(new - (beta @ new) / (beta @ beta) * beta, -0.3, 0.3)
            vol = np.sqrt(max(new @ s @ new, 0)) * 252**0.5
            new = np.clip(new * (0.12 / vol if vol > 1e-8 else 1.0), -0.3, 0.3)
            w = np.where(new == 0, last, new)  # a weight of 0 is carried as the one before
            n += 1
        net.append(last @ r - (2e-4 * np.abs(w - last).sum() if t.weekday() == 4 else 0.0))
    assert n > 5
    check(got["stacked_trees"], net)
    check(got["equal"], [np.mean([feats[t, a]["ret"] for a in ASSETS]) for t in own])


def test_live_run(spark, frame, plain, monkeypatch):
    monkeypatch.setattr(m, "panel", lambda *_: frame)
    got = {r["asset"]: r for r in m.l3_live_run(spark, "").collect()}
    _, ret, _ = plain
    mu = {r["asset"]: r["mu"] for r in alpha.forecast_today(P.features(frame, P.LEVEL)).collect()}
    s = np.zeros((3, 3))
    for v in ret[-253:-1]:
        s = 0.94 * s + 0.06 * np.outer(v, v)
    w = np.maximum(np.linalg.solve(s + 1e-6 * np.eye(3), np.array([mu[a] for a in ASSETS])), 0)
    w = w / w.sum() if w.sum() else np.full(3, 1 / 3)
    w = np.minimum(w, 0.4)
    w = w / w.sum()
    price = {r["asset"]: r["price"] for r in stats.latest(frame).collect()}
    assert set(got) == set(ASSETS)
    for a, v in zip(ASSETS, w, strict=True):
        delta = v * 500 - (90.0 if len(a) % 2 == 0 else 0.0)
        order = abs(delta) >= 10
        assert got[a]["delta"] == pytest.approx(delta, abs=1e-5)
        assert got[a]["status"] == ("ORDER" if order else "SKIP: below threshold")
        if order:
            assert got[a]["side"] == ("BUY" if delta > 0 else "SELL") and got[a]["notional"] == pytest.approx(round(abs(delta), 2), abs=0.011)
            assert got[a]["limit_price"] == pytest.approx(price[a] * (1.002 if delta > 0 else 0.998), rel=1e-5)
