"""Windows, scalars, statistics and splits on small literal tables."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelworks.functions import panel as W
from panelworks.functions import scalar as P
from panelworks.operators import stats as A

DAY = dt.date(2024, 1, 1)


def series(spark, values, name="ret", asset="A"):
    return spark.createDataFrame([(asset, DAY + dt.timedelta(days=i), float(v) if v is not None else None) for i, v in enumerate(values)], f"asset string, dt date, {name} double")


def column(df, name="v"):
    return [r[name] for r in df.orderBy("asset", "dt").collect()]


def test_flat_returns_have_no_score(spark):
    df = series(spark, [0.01] * 30).withColumn("strategy", F.lit("s"))
    got = df.withColumns({"s": W.rolling_std(), "z": W.rolling_zscore()}).orderBy("dt").collect()[-1]
    assert abs(got["s"]) < 1e-15 and got["z"] is None
    m = A.performance(df).first()
    assert m["sharpe"] is None and m["max_drawdown"] == 0 and m["hit_rate"] == 1


def test_first_loss_is_no_drawdown(spark):
    assert A.performance(series(spark, [-0.5, 0.1, 0.2]).withColumn("strategy", F.lit("s"))).first()["max_drawdown"] == 0
    assert A.performance(series(spark, [0.1, -0.5, 0.2]).withColumn("strategy", F.lit("s"))).first()["max_drawdown"] == pytest.approx(-0.5)


def test_carried_weights(spark):
    df = series(spark, [0.3, 0.0, 0.2, None], "w")
    assert column(df.withColumn("v", W.carried())) == [0.3, 0.3, 0.2, 0.2]
    assert column(df.withColumn("v", W.carried(sticky_zero=False))) == [0.3, 0.0, 0.2, 0.2]


def test_beta_of_a_flat_market(spark):
    df = series(spark, np.linspace(0, 1, 30)).withColumn("mkt_ret", F.lit(0.0))
    assert set(column(df.withColumn("v", W.rolling_beta()))) == {None} == set(column(df.withColumn("v", W.rolling_beta_lagged())))


def test_no_look_ahead(spark):
    x = np.random.default_rng(0).normal(size=60) * 0.01
    y = x.copy()
    y[45:] += 1.0
    make = lambda v: W.features(series(spark, v).withColumns({"price": F.lit(1.0), "mkt_ret": F.col("ret") / 2 + F.hash("dt") % 7 * 1e-3}), drop_incomplete=False).orderBy("dt").collect()
    a, b = make(x), make(y)
    assert [r["volatility"] for r in a[:45]] == [r["volatility"] for r in b[:45]] and a[50]["volatility"] != b[50]["volatility"]


def test_complete_dates(spark):
    df = series(spark, [1, 2, 3]).union(series(spark, [1, 2], asset="B"))
    assert A.complete_dates(df).count() == 4


def test_folds(spark):
    df = spark.createDataFrame([("s", i) for i in range(11)], "series_id string, t int")
    rows = A.expanding_folds(df, 3, W.Series("series_id", "t")).orderBy("t").collect()
    assert [r["fold"] for r in rows] == [None] * 5 + [0, 0, 1, 1, 2, 2]


def test_union_book(spark):
    t, c = (spark.createDataFrame([r], "asset string, notional double") for r in (("A", 100.0), ("B", 40.0)))
    rows = A.union_book(t, c).collect()
    assert sum(abs(r["target"] - r["current"]) for r in rows) / 500 == pytest.approx(0.28)


def test_scalars(spark):
    row = spark.range(1).select(
        P.clip(F.lit(None).cast("double"), 0, 1).alias("null"),
        P.sigmoid(F.lit(-1e9)).alias("low"),
        P.soft_threshold(F.lit(-3.0), 1.0).alias("soft"),
        P.dead_zone(F.lit(0.0004), 0.004, 0.0005).alias("dead"),
        P.finite_or_zero(F.lit(float("nan"))).alias("nan"),
        P.tail_name(F.lit("Order.Side.BUY")).alias("tail"),
    ).first()
    assert (row["null"], row["soft"], row["dead"], row["nan"], row["tail"]) == (None, -2.0, 0.0, 0.0, "BUY") and 0 < row["low"] < 1e-17


def test_chi2_tail(spark):
    rows = spark.createDataFrame([(3.841459, 1), (5.991465, 2), (18.307038, 10), (0.0, 3)], "x double, k int")
    got = [r[0] for r in rows.select(A.chi2_tail(F.col("x"), F.col("k"))).collect()]
    assert got[:3] == pytest.approx([0.05] * 3, abs=1e-6) and got[3] == pytest.approx(1.0, abs=1e-6)
