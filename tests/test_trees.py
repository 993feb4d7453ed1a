"""Trees that grow together against plain ones, one set and one node at a time."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from panelworks.operators import alpha, trees

DAY = dt.date(2023, 1, 2)


def plain_tree(b, y, w, depth, at):
    """Predictions at rows ``at`` (bins) of a tree on rows (b, y, w), node by node."""
    n = w.sum()
    mean = (w * y).sum() / n if n else 0.0
    if depth == 0 or n == 0:
        return np.full(len(at), mean)
    best = (1e-15, None, None)
    for j in range(b.shape[1]):
        for v in range(b[:, j].max() + 1):
            left = b[:, j] <= v
            nl, nr = w[left].sum(), w[~left].sum()
            if nl and nr:
                sl, sr = (w * y)[left].sum(), (w * y)[~left].sum()
                gain = sl * sl / nl + sr * sr / nr - (sl + sr) ** 2 / n
                if gain > best[0] * (1 + 1e-9):
                    best = (gain, j, v)
    if best[1] is None:
        return np.full(len(at), mean)
    left, there = b[:, best[1]] <= best[2], at[:, best[1]] <= best[2]
    out = np.empty(len(at))
    out[there] = plain_tree(b[left], y[left], w[left], depth - 1, at[there])
    out[~there] = plain_tree(b[~left], y[~left], w[~left], depth - 1, at[~there])
    return out


def plain_forest(b, y, at, n, depth, last, seed=0):
    total = np.zeros(len(at))
    for t in range(n):
        picks = (trees.mixed(seed, t, last, len(y), np.arange(len(y))) % np.uint64(len(y))).astype(int)
        total += plain_tree(b, y, np.bincount(picks, minlength=len(y)).astype(float), depth, at)
    return total / n


def plain_boost(b, y, at, n, depth, rate):
    left, out = y - y.mean(), np.full(len(at), y.mean())
    for _ in range(n):
        own = plain_tree(b, left, np.ones(len(y)), depth, np.vstack([b, at]))
        left, out = left - rate * own[: len(y)], out + rate * own[len(y) :]
    return out


def data(n, d=3, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    return x, np.where(x[:, 0] > 0, 1.0, -1.0) * x[:, 1] + 0.1 * rng.normal(size=n)


def test_trees_grown_together(spark):
    x, y = data(300)
    cut = trees.binned(x, trees.bin_edges(x, 12))
    train, test = [(0, 40), (10, 200), (0, 290), (5, 6)], [(40, 60), (200, 210), (290, 300), (6, 9)]
    sets = trees.Sets.of(train, test)
    table = trees.Table(cut, sets, 12)
    f, g = trees.forest(table, y, 7, 4), trees.boosted(table, y, 9, 2, 0.1)
    for k, ((a, b), (c, e)) in enumerate(zip(train, test, strict=True)):
        assert f[sets.test_fit == k] == pytest.approx(plain_forest(cut.T[a:b], y[a:b], cut.T[c:e], 7, 4, b - 1))
        assert g[sets.test_fit == k] == pytest.approx(plain_boost(cut.T[a:b], y[a:b], cut.T[c:e], 9, 2, 0.1))
    one = trees.Table(cut, trees.Sets.of([(0, 250)], [(250, 300)]), 12)
    assert np.mean((trees.boosted(one, y, 200, 2, 0.1) - y[250:]) ** 2) < 0.5 * y[250:].var()


def test_stack_of_every_friday(spark):
    x, r = data(430, 2, seed=3)
    rows = [(f"S{a}", DAY + dt.timedelta(days=t), float(r[t] * (a + 1) / 100), float(x[t, 0]), float(x[(t + a) % 430, 1])) for a in range(2) for t in range(430 if a else 200)]
    df = spark.createDataFrame(rows, "asset string, dt date, ret double, f double, g double").repartition(3)
    opts = {"window": 60, "k": 3, "min_train": 130, "n_trees": 3, "rounds": 4, "bins": 8, "quarter": 5, "meta_alpha": 1e-3}
    got = {(q["asset"], q["dt"]): q for q in alpha.stacked_trees(df, ["f", "g"], **opts).collect()}
    n = 0
    for a, part in pd.DataFrame(rows, columns=["a", "d", "r", "f", "g"]).groupby("a"):
        z, y, days = part[["f", "g"]].to_numpy(), part.r.shift(-1).to_numpy(), part.d.tolist()
        fridays = [t for t in range(len(part) - 1) if days[t].weekday() == 4 and t >= 130]
        for i, t in enumerate(fridays):
            edges = trees.bin_edges(z[: fridays[i // 5 * 5]], 8)
            b = trees.binned(z, edges).T
            lo, first, step = t - 60, t - 45, 15

            def bases(tr, te):
                m, s = z[tr].mean(0), z[tr].std(0)
                zs, yc = (z[tr] - m) / s, y[tr] - y[tr].mean()
                ridge = np.linalg.solve(zs.T @ zs + 5 * np.eye(2), zs.T @ yc)
                w, gram, c = np.zeros(2), zs.T @ zs / len(yc), zs.T @ yc / len(yc)
                for _ in range(500):
                    for j in range(2):
                        v = c[j] - gram[j] @ w + gram[j, j] * w[j]
                        w[j] = np.sign(v) * max(abs(v) - 0.0005, 0) / gram[j, j]
                new = (z[te] - m) / s
                return np.column_stack([y[tr].mean() + new @ ridge, y[tr].mean() + new @ w, plain_forest(b[tr], y[tr], b[te], 3, 4, tr.stop - 1), plain_boost(b[tr], y[tr], b[te], 4, 2, 0.05)])

            p = np.vstack([bases(slice(lo, first + q * step), slice(first + q * step, first + (q + 1) * step)) for q in range(3)])
            v, now = y[first:t], bases(slice(0, t), slice(t, t + 1))[0]
            meta = np.linalg.solve((p - p.mean(0)).T @ (p - p.mean(0)) + 1e-3 * np.eye(4), (p - p.mean(0)).T @ (v - v.mean()))
            q = got[a, days[t]]
            assert [q[c] for c in alpha.BASES] == pytest.approx(now.tolist(), abs=1e-9)
            assert q["raw"] == pytest.approx(v.mean() + meta @ (now - p.mean(0)), abs=1e-9)
            n += 1
    assert len(got) == n > 40


def test_stack_looks_at_nothing_later(spark):
    x, r = data(220, 2, seed=5)
    rows = [("S", DAY + dt.timedelta(days=t), float(r[t] / 100), float(x[t, 0]), float(x[t, 1])) for t in range(220)]
    opts = {"window": 60, "k": 3, "min_train": 130, "n_trees": 2, "rounds": 2, "bins": 8, "quarter": 3}
    run = lambda rs: {q["dt"]: q["raw"] for q in alpha.stacked_trees(spark.createDataFrame(rs, "asset string, dt date, ret double, f double, g double"), ["f", "g"], **opts).collect()}
    whole, part = run(rows), run(rows[:180])
    assert len(part) > 3 and all(whole[d] == v for d, v in part.items())
    assert run(rows[:100]) == {} and run([]) == {}
