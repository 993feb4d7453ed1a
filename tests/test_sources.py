"""Sources and sinks, the streamed run, and the registry."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelworks.sources import tables
from panelworks.streaming import bars

DAY = dt.date(2024, 1, 1)


@pytest.fixture()
def prices(spark):
    rows = [(a, DAY + dt.timedelta(days=i), 10.0 + i + k) for k, a in enumerate("AB") for i in range(40)]
    return spark.createDataFrame(rows, tables.BARS)


def test_read_bars(spark, prices, tmp_path):
    prices.write.parquet(str(tmp_path / "b"))
    got = tables.read_bars(spark, str(tmp_path / "b"), ["A"], "2024-01-05", "2024-01-09")
    assert got.count() == 5
    assert "PushedFilters: [" in got._jdf.queryExecution().toString() and "In(asset" in got._jdf.queryExecution().toString() or "EqualTo(asset" in got._jdf.queryExecution().toString()


def test_logs_are_idempotent(spark, prices, tmp_path):
    path = str(tmp_path / "log")
    for df in (prices.filter("dt < '2024-01-10'"), prices, prices):
        tables.append_once(df, path)
    assert spark.read.parquet(path).count() == 80
    for _ in range(2):
        tables.write_daily(prices.limit(5), str(tmp_path / "daily"))
    assert spark.read.parquet(str(tmp_path / "daily")).count() == 5


def test_require_columns(prices):
    with pytest.raises(ValueError, match="nope"):
        tables.require_columns(prices, ["asset", "nope"])
    assert tables.lookback("2024-03-01", 10) == ("2024-02-13", "2024-03-01")


def test_features_round_trip(spark, prices, tmp_path):
    panel = prices.select("asset", "dt", F.col("close").alias("price")).withColumns({"ret": F.rand(1), "mkt_ret": F.rand(2)})
    made = tables.load_or_build_features(spark, str(tmp_path / "f"), panel)
    tables.write_features(made, str(tmp_path / "f"))
    assert tables.load_or_build_features(spark, str(tmp_path / "f"), panel.limit(0)).count() == made.count() > 0


def test_stream_equals_batch(spark, prices, tmp_path):
    make = lambda df: df.withColumn("v", F.avg("close").over(bars.Window.partitionBy("asset").orderBy("dt").rowsBetween(-9, 0)))
    p = {k: str(tmp_path / k) for k in ("in", "store", "out", "state")}
    for a, z in ((0, 30), (30, 40), (40, 40)):
        lot = prices.filter((F.dayofyear("dt") > a) & (F.dayofyear("dt") <= z))
        if not lot.isEmpty():
            lot.coalesce(1).write.mode("append").parquet(p["in"])
        bars.run_available(spark, p["in"], p["store"], p["out"], p["state"], make)
    rows = lambda df: sorted(map(tuple, df.select("asset", "dt", "close", "v").collect()))
    assert rows(spark.read.parquet(p["out"])) == rows(make(prices))


def test_registry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_stored_layout_needs_no_exchange(spark, tmp_path):
    from panelworks.functions import panel as W

    days = [dt.date(2021, 12, 1) + dt.timedelta(days=i) for i in range(120)]
    rows = [(a, t, 10.0 + i % 7, 0.01 * (i % 5) - 0.02, 0.001 * (i % 3)) for a in "ABCDE" for i, t in enumerate(days)]
    df = spark.createDataFrame(rows, "asset string, dt date, price double, ret double, mkt_ret double")
    tables.write_layout(df, "layout_test", f"file://{tmp_path}/layout", buckets=3)
    back = tables.read_layout(spark, "layout_test", "2022-01-05", "2022-03-10")
    want = df.filter("dt between date '2022-01-05' and date '2022-03-10'")
    assert sorted(map(str, back.select(df.columns).collect())) == sorted(map(str, want.collect()))
    made = W.features(back)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" in plan and "Bucketed: true" in plan
    assert "PartitionFilters: [isnotnull(year" in plan and back.inputFiles() and not any("year=2021" in f for f in back.inputFiles())
    assert sorted(map(str, made.select(*W.FEATURES, "asset", "dt").collect())) == sorted(map(str, W.features(want).select(*W.FEATURES, "asset", "dt").collect()))
    both = back.join(back.select("asset", "dt", W.simple_return("price", 1).alias("r")), ["asset", "dt"])
    assert both._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 0 or "BroadcastHashJoin" in both._jdf.queryExecution().executedPlan().toString()
    spark.sql("drop table layout_test")


def test_gaps(spark):
    from panelworks.functions import scalar

    monday = dt.date(2024, 1, 1)
    rows = [("A", monday + dt.timedelta(days=i)) for i in (0, 1, 3, 7, 7)] + [("B", monday)]
    got = {(r["asset"], r["dt"]) for r in scalar.gaps(spark.createDataFrame(rows, "asset string, dt date"), by="asset").collect()}
    assert got == {("A", monday + dt.timedelta(days=i)) for i in (2, 4)}
