"""Streams, selections, factors and tiles against their plain forms on one machine."""

import datetime as dt

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelworks.functions.digest import md5_heads
from panelworks.operators import alpha, book, learn, linear, risk, stats, weights

DAY = dt.date(2024, 1, 1)


def plain_descent(rows, batch_of, opt, epochs, l2):
    """(weights, loss) after each epoch; rows: id, y, x.."""
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    y, x = rows[:, 1], np.column_stack([np.ones(len(rows)), rows[:, 2:]])
    w, t, out = np.zeros(x.shape[1]), 0, []
    state = opt.start(len(w))
    for epoch in range(1, epochs + 1):
        of = batch_of(epoch)
        for b in np.unique(of):
            at, t = of == b, t + 1
            g = x[at].T @ (1 / (1 + np.exp(-np.clip(x[at] @ w, -40, 40))) - y[at]) / at.sum()
            g[1:] += l2 / at.sum() * w[1:]
            change, state = opt.step(state, g, t)
            w = w + change
        p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -40, 40))), 1e-12, 1 - 1e-12)
        out.append((w, -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))))
    return out


@pytest.mark.parametrize("at_once", [20_000_000, 1000])
def test_streams_of_many_models(spark, monkeypatch, at_once):
    monkeypatch.setattr(learn, "ROWS_AT_ONCE", at_once)
    rng = np.random.default_rng(1)
    rows = np.column_stack([np.arange(300), rng.integers(0, 2, 300), rng.normal(size=(300, 2))])
    df = spark.createDataFrame([(int(r[0]), *map(float, r[1:])) for r in rows] + [(999, None, 1.0, 1.0)], "id long, y double, a double, b double").repartition(3)
    models = {"sgd": learn.sgd(0.2), "momentum": learn.momentum(0.15), "adam": learn.adam(0.05), "slow": learn.adam(0.001)}
    got = learn.train_streams(df, ["a", "b"], "y", "id", models, 64, 7, l2=0.5)
    dealt = {e: np.array([r["b"] for r in df.filter("y is not null").select("id", stats.batch_of("id", e, 5).alias("b")).orderBy("id").collect()]) for e in range(1, 8)}
    for name, opt in models.items():
        want = plain_descent(rows, dealt.__getitem__, opt, 7, 0.5)
        assert [w.tolist() for w, _ in got[name]] == [pytest.approx(w.tolist()) for w, _ in want]
        assert [loss for _, loss in got[name]] == pytest.approx([loss for _, loss in want])


@pytest.mark.parametrize("passes", [100, 2])
@pytest.mark.parametrize("size", [64, 1])
def test_lanes_of_a_stream_meet(spark, monkeypatch, passes, size):
    """Lanes of two batches, some without rows, all passes or one lane after two: as the plain loop."""
    for name, value in (("LANE_STEPS", 2), ("LANES_A_TASK", 2), ("CELLS", 4), ("PIECE_ROWS", 3), ("PACKED_ROWS", 50), ("PASSES", passes), ("ROWS_AT_ONCE", 500)):
        monkeypatch.setattr(learn, name, value)
    rng = np.random.default_rng(3)
    n = 200 if size > 1 else 20
    rows = np.column_stack([np.arange(n) + 5, rng.integers(0, 2, n), rng.normal(size=(n, 2))])
    df = spark.createDataFrame([(f"k{int(r[0]):04d}" if size > 1 else int(r[0]), *map(float, r[1:])) for r in rows], f"id {'string' if size > 1 else 'int'}, y double, a double, b double")
    models = {"sgd": learn.sgd(0.2), "momentum": learn.momentum(0.15), "adam": learn.adam(0.05)}
    got = learn.train_streams(df, ["a", "b"], "y", "id", models, size, 5, 0.5)
    dealt = {e: np.array([r["b"] for r in df.select("id", stats.batch_of("id", e, -(-n // size)).alias("b")).orderBy("id").collect()]) for e in range(1, 6)}
    for name, opt in models.items():
        want = plain_descent(rows, dealt.__getitem__, opt, 5, 0.5)
        assert [w.tolist() for w, _ in got[name]] == [pytest.approx(w.tolist(), rel=1e-9) for w, _ in want]
        assert [loss for _, loss in got[name]] == pytest.approx([loss for _, loss in want])


def test_long_streams_are_spread_over_tasks(spark, monkeypatch):
    """A stream of many batches is lanes in several tasks that meet after a few passes; all in one lane gives the same."""
    df = spark.range(24_000).select("id", (F.xxhash64("id") % 2 == 0).cast("double").alias("y"), ((F.xxhash64("id", F.lit(1)) % 1000) / 500).alias("a"))
    models, cuts, fold = {"sgd": learn.sgd(0.2), "momentum": learn.momentum(0.15), "adam": learn.adam(0.05, b2=0.9)}, [], learn._fold

    def seen(*args):
        cuts.append(args[3])
        return fold(*args)

    monkeypatch.setattr(learn, "_fold", seen)
    monkeypatch.setattr(learn, "LANE_STEPS", 1000)
    got = learn.train_streams(df, ["a"], "y", "id", models, 4, 2)
    assert 2 <= len(cuts) <= 4 and {(c.lanes, c.tasks, c.steps) for c in cuts} == {(12, 4, 1000)}
    monkeypatch.setattr(learn, "LANE_STEPS", 10**6)
    want = learn.train_streams(df, ["a"], "y", "id", models, 4, 2)
    assert cuts[-1].lanes == 1
    for m in models:
        assert [(*w, loss) for w, loss in got[m]] == [pytest.approx((*w, loss), rel=1e-10) for w, loss in want[m]]


def test_rows_are_dealt_in_numpy_as_in_spark(spark):
    ids = [0, 9, 10, 99, -7, 12345678901, 2**63 - 1, -(2**63), 10**18 - 1, 10**18]
    numbers = spark.createDataFrame([(i,) for i in ids], "id long")
    texts = spark.createDataFrame([("",), ("a",), ("\u00fcx" * 40,)], "id string")
    for df, own in ((numbers, np.array(ids)), (texts, ["", "a", "\u00fcx" * 40])):
        want = np.array([list(r) for r in df.select(*[stats.batch_of("id", e, 1000).alias(str(e)) for e in (1, 60, 123456)]).collect()]).T
        assert (md5_heads(own, [":1", ":60", ":123456"]) % 1000).tolist() == want.tolist()


def test_batches_are_packed_as_rows_of_bytes():
    rng = np.random.default_rng(2)
    batch, ids, v = rng.integers(5, 9, 100).astype(np.int32), rng.permutation(100), rng.normal(size=(100, 2))
    rows = pa.table({"epoch": np.full(100, 3, np.int32), "near": np.zeros(100, np.int64), "batch": batch, "id": ids, "a": v[:, 0], "b": v[:, 1]})
    got = learn._pack(["a", "b"])(rows).to_pylist()
    assert [(r["epoch"], r["batch"]) for r in got] == [(3, b) for b in range(5, 9)]
    for r in got:
        at = np.flatnonzero(batch == r["batch"])
        assert np.frombuffer(r["v"]).reshape(-1, 2).tolist() == v[at[np.argsort(ids[at])]].tolist()


def test_streams_of_nothing(spark):
    df = spark.createDataFrame([], "id long, y double, a double")
    got = learn.train_streams(df, ["a"], "y", "id", {"m": learn.sgd(0.1)}, 64, 2)
    assert [w.tolist() for w, _ in got["m"]] == [[0, 0], [0, 0]] and all(np.isnan(loss) for _, loss in got["m"])


@pytest.mark.parametrize("most", [10_000, 1])
def test_stratified_cut_is_that_of_the_sort(spark, monkeypatch, most):
    monkeypatch.setattr(stats, "CUT_ROWS", most)
    rows = spark.range(30_000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3000 == 1, "rare").when(F.col("id") % 5000 == 2, F.lit(None)).otherwise("hot").alias("c"))
    w, h = Window.partitionBy("c"), F.xxhash64("row_id", F.lit(7))
    want = {r[0] for r in rows.withColumn("t", F.row_number().over(w.orderBy(h, "row_id")) <= F.round(F.count("*").over(w) * 0.3)).filter("t").select("row_id").collect()}
    got = stats.stratified_split(rows, "c", "row_id", seed=7)
    assert {r[0] for r in got.filter("split = 'test'").select("row_id").collect()} == want and got.count() == 30_000
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert stats.stratified_split(rows.limit(0), "c", "row_id").count() == 0
    one = stats.stratified_split(rows.filter("c = 'rare'").limit(1), "c", "row_id").collect()  # round(0.3) is none
    assert [r["split"] for r in one] == ["train"]


def frame(spark, a, y=None):
    names = [f"x{j}" for j in range(a.shape[1])]
    rows = [(*map(float, r), float(v), int(k % 2)) for k, (r, v) in enumerate(zip(a, y if y is not None else np.zeros(len(a)), strict=True))]
    return names, spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names) + ", y double, g int").repartition(7)


def test_condition_of_1e12(spark):
    rng = np.random.default_rng(1)
    u, _, vt = np.linalg.svd(rng.normal(size=(2000, 4)), full_matrices=False)
    a = u * np.array([1e6, 1, 1e-3, 1e-6]) @ vt
    names, df = frame(spark, a)
    s = np.linalg.svd(np.column_stack([np.ones(2000), a]), compute_uv=False)
    assert linear.condition(df, names).first()["cond"] == pytest.approx(s[0] / s[-1], rel=0.01) and s[0] / s[-1] > 1e11
    _, twice = frame(spark, np.column_stack([a[:3, 0], a[:3, 0]]))
    assert linear.condition(twice, ["x0", "x1"]).first()["cond"] > 1e14


def test_nearly_collinear_ols_by_group(spark, monkeypatch):
    monkeypatch.setattr(linear, "QR_ROWS", 37)
    monkeypatch.setattr(linear, "QR_GROUPS", 1)
    rng = np.random.default_rng(2)
    a = rng.normal(size=(600, 3)) + [0, 0, 1000]
    a[:, 1] = a[:, 0] + 1e-7 * rng.normal(size=600)
    y = a @ [1.0, 2.0, 3.0] + rng.normal(size=600)
    names, df = frame(spark, a, y)
    for r in linear.ols(df, names, "y", ["g"]).collect():
        at = np.arange(600) % 2 == r["g"]
        want = np.linalg.lstsq(np.column_stack([np.ones(at.sum()), a[at]]), y[at], rcond=None)[0]
        assert [r[f"b{j}"] for j in range(4)] == pytest.approx(want.tolist(), rel=1e-5)


def test_components_of_nearly_equal_columns(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(500, 3))
    a[:, 2] = a[:, 0] + 1e-9 * a[:, 2]
    names, df = frame(spark, a)
    got = learn.pca(df, names, 3)
    s = np.linalg.svd(a - a.mean(0), compute_uv=False) ** 2
    assert got.ratios[:2] == pytest.approx((s / s.sum())[:2]) and got.ratios[2] == pytest.approx(s[2] / s.sum(), rel=1e-3)


def holes(spark, n_assets=9, days=400):
    """Returns of assets that begin late, end early and miss days."""
    rng = np.random.default_rng(4)
    rows = []
    for a in range(n_assets):
        r = rng.normal(0, 0.01, days)
        for t in range(days):
            if (a == 3 and t < 350) or (a == 4 and t > 20) or (a == 5 and t % 7 == 2) or (a == 6 and t == 77):
                continue
            rows.append((f"A{a}", DAY + dt.timedelta(days=t), None if a == 7 and t % 50 == 3 else float(r[t])))
    return rows, spark.createDataFrame(rows, "asset string, dt date, ret double")


@pytest.mark.parametrize("size", [64, 2])
def test_tiles_against_rows_of_pairs(spark, size):
    rows, df = holes(spark)
    by = {a: {d: r for b, d, r in rows if b == a and r is not None} for a in {r[0] for r in rows}}
    ewma = {(r["asset_a"], r["asset_b"], r["dt"]): r["cov"] for r in risk.from_tiles(risk.ewma_cov_tiles(df, 0.9, 60, 1e-3, size=size)).collect()}
    sample = {(r["asset_a"], r["asset_b"], r["dt"]): r["cov"] for r in risk.from_tiles(risk.sample_cov_tiles(df, 20, 1e-3, size=size)).collect()}
    n = m = 0
    for a in sorted(by):
        for b in sorted(by):
            if a > b:
                continue
            days = sorted(by[a].keys() & by[b].keys())
            x, y = np.array([by[a][d] for d in days]), np.array([by[b][d] for d in days])
            for k, d in enumerate(days):
                lo = max(0, k - 20)
                want = np.cov(x[lo:k], y[lo:k])[0, 1] + 1e-3 * (a == b) if k - lo >= 2 else 1e-4 * (a == b)
                assert sample[a, b, d] == pytest.approx(want, abs=1e-14)
                n += 1
                if d.weekday() == 4:
                    s = 0.0
                    for v in x[max(0, k - 60) : k] * y[max(0, k - 60) : k]:
                        s = 0.9 * s + 0.1 * v
                    assert ewma[a, b, d] == pytest.approx(s + 1e-3 * (a == b), abs=1e-14)
                    m += 1
    assert (len(sample), len(ewma)) == (n, m)


def test_long_windows_stay_finite(spark):
    _, df = holes(spark, 2)
    assert risk.ewma_cov(df, lam=0.5, n=1100).filter("cov is null or isnan(cov) or abs(cov) > 1").count() == 0


def test_weights_from_tiles_and_from_pairs(spark):
    _, df = holes(spark, 3)
    tiles = risk.ewma_cov_tiles(df, n=60, ridge=1e-4, size=2)
    mu = df.filter("ret is not null").select("asset", "dt", (F.col("ret") / 100).alias("mu"))
    both = [{(r["asset"], r["dt"]): r["w"] for r in weights.mean_variance(mu, c, 1.5, 0.3).collect()} for c in (tiles, risk.from_tiles(tiles))]
    assert both[0] == pytest.approx(both[1]) and len(both[0]) > 100
    books = weights.mean_variance_books(mu, tiles, {"small": 0.2, "large": 1.5}, 0.3)
    assert {(r["asset"], r["dt"]): r["w"] for r in books.filter("book_id = 'large'").collect()} == pytest.approx(both[0])
    gross = [r["g"] for r in books.filter("book_id = 'small'").groupBy("dt").agg(F.sum(F.abs("w")).alias("g")).collect()]
    assert max(gross) == pytest.approx(0.2)
    var = {(r["book_id"], r["dt"]): r["var"] for r in weights.portfolio_variance(books, tiles, ["book_id"]).collect()}
    pairs = {(r["asset_a"], r["asset_b"], r["dt"]): r["cov"] for r in risk.from_tiles(tiles).collect()}
    held = {}
    for r in books.collect():
        held.setdefault((r["book_id"], r["dt"]), {})[r["asset"]] = r["w"]
    for (b, d), w in held.items():
        want = sum(w[i] * w[j] * pairs.get((min(i, j), max(i, j), d), 0.0) for i in w for j in w)
        assert var[b, d] == pytest.approx(want, abs=1e-15)
    assert weights.whole_dates(tiles, 3).count() == weights.whole_dates(risk.from_tiles(tiles), 3).count()


def test_custom_models_stream_over_batches(spark):
    rng = np.random.default_rng(6)
    rows = [(f"S{a}", DAY + dt.timedelta(days=t), float(rng.normal()), float(rng.normal())) for a in range(4) for t in range(150 + 40 * a)]
    df = spark.createDataFrame(rows, "asset string, dt date, ret double, f double").repartition(5)
    def last_five(x, y, new):
        return np.array([x[-5:].sum() + y.sum() + 100 * new[0, 0] + len(x)])

    def broken(x, y, new):
        raise ValueError

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {(r["asset"], r["dt"], r["model"]): r["mu"] for r in alpha.custom_models(df, {"m": last_five, "bad": broken}, ["f"], window=30, least=10).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    n = 0
    for a, part in pd.DataFrame(rows, columns=["a", "d", "r", "f"]).groupby("a"):
        y, f = part.r.shift(-1).to_numpy(), part.f.to_numpy()
        for t, d in enumerate(part.d):
            if d.weekday() == 4:
                lo = max(0, t - 30)
                want = float(last_five(f[lo:t, None], y[lo:t], f[t : t + 1, None])[0]) if t - lo >= 10 else 0.0
                assert got[a, d, "m"] == pytest.approx(want) and got[a, d, "bad"] == 0.0
                n += 1
    assert len(got) == 2 * n


def many_books(spark, n_books=150, days=24):
    rng = np.random.default_rng(8)
    rows = []
    for b in range(n_books):
        for t in range(days):
            for a in "PQRS"[: 2 + b % 3]:
                if (b + t) % 11 == 3 and a == "Q":
                    continue
                rows.append((f"b{b:03d}", DAY + dt.timedelta(days=t), a, float(rng.normal() * 0.4) if (t + b) % 3 else 0.2, float(rng.normal() * 0.01), float(rng.normal()), 0.15, 10.0 + float(rng.normal())))
    return spark.createDataFrame(rows, "book_id string, dt date, asset string, w double, ret double, beta double, sigma_vol double, price double")


def two_halves(run, split):
    """``run(days, state)`` of all days at once, and of two halves, the second from what the first left."""
    whole = sorted(map(str, run(F.lit(True), None).collect()))
    first = run(F.col("dt") < split, None).persist()
    second = run(F.lit(True), first)  # days that have been run are left out
    return whole, sorted(map(str, first.union(second).collect()))


@pytest.mark.parametrize("batch", ["10000", "7"])
def test_books_go_on_from_their_state(spark, batch):
    df, split = many_books(spark), F.lit(DAY + dt.timedelta(days=13))
    prices = df.groupBy("dt", "asset").agg(F.max("price").alias("price"))
    pairs = [(DAY + dt.timedelta(days=i), a, b, 2e-4 if a == b else 3e-5) for i in range(24) for a in "PQRS" for b in "PQRS" if a <= b]
    cov = spark.createDataFrame(pairs, "dt date, asset_a string, asset_b string, cov double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for run in (
            lambda days, state: weights.history_vol_days(df.filter(days), window=5, state=state),
            lambda days, state: weights.blended_days(df.filter(days), cov, state=state),
            lambda days, state: book.replay_days(df.filter(days).drop("price"), prices, state=state, fee=0.01),
        ):
            whole, halves = two_halves(run, split)
            assert whole == halves and len(whole) == 150 * 24
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
