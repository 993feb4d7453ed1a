"""Sources, sinks and the streamed run: what was written is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelworks.functions import panel as W
from panelworks.operators import book, risk
from panelworks.plans import model_queries as M
from panelworks.plans.panel_queries import FEAT, PAN, out, rnd
from panelworks.plans.registry import query
from panelworks.sources import tables
from panelworks.sources.fixtures import panel, prices, table
from panelworks.sources.shared import new_folder as folder
from panelworks.streaming import bars


def put_bars(spark, d) -> str:
    path = folder(spark)
    prices(spark, d).withColumnRenamed("price", "close").write.parquet(path)
    return path


@query(PAN + " select asset, cast(dt as varchar) dt, round(price, 6) + 0.0 as close from panel where asset in ('ECONOMY', 'SMALL') and dt between date '1996-01-01' and date '1997-12-31'")
def s1_read_bars(spark, d):
    return out(tables.read_bars(spark, put_bars(spark, d), ["ECONOMY", "SMALL"], "1996-01-01", "1997-12-31"), 6)


@query(FEAT + " select asset, cast(dt as varchar) dt, round(momentum, 8) + 0.0 as momentum from feat")
def s2_load_or_build(spark, d):
    """Built where nothing is stored, stored, and loaded; what comes back is what was loaded."""
    path, rows = folder(spark), panel(spark, d)
    tables.write_features(tables.load_or_build_features(spark, path, rows), path)
    return out(tables.load_or_build_features(spark, path, rows.limit(0)).select("asset", "dt", "momentum"))


@query(FEAT + " select asset, cast(dt as varchar) dt, round(volatility, 8) + 0.0 as volatility from feat")
def s4_write_features(spark, d):
    path = folder(spark)
    tables.write_features(W.features(panel(spark, d)), path)
    return out(spark.read.parquet(path).select("asset", "dt", "volatility"))


RISK_SQL = (
    M.POS
    + """, rr as (select dt, coalesce(equity / lag(equity) over (order by dt) - 1, 0) ret from eq), ps as (select dt, sum(shares * price * coalesce(ret, 0)) pnl, sum(shares * price) exposure, sum(shares * price * coalesce(ret, 0)) filter (asset = 'SMALL') small from gd group by dt)
select 'friday' book_id, cast(eq.dt as varchar) dt, round(equity, 4) + 0.0 as equity, round(rr.ret, 6) + 0.0 as ret, round(pnl, 4) + 0.0 as pnl, round(exposure, 4) + 0.0 as exposure, round(coalesce(small, 0), 4) + 0.0 as small_pnl
from eq join rr using (dt) join ps using (dt)"""
)


@query(RISK_SQL)
def s5_risk_tables(spark, d):
    """All four tables are written and read back: equity, the risk series' return, sums over the columns of profit and exposure, one asset's column."""
    path, rows = folder(spark), M.held(spark, d)
    e = book.equity(M.trades(spark, d), M.fed_prices(spark, d)).select("book_id", "dt", "equity")
    names = [r["asset"] for r in rows.select("asset").distinct().orderBy("asset").collect()]  # the universe
    tables.write_risk_tables(path, e, risk.risk_series(e, risk.turnover(M.daily_book(spark, d))), risk.attribution(rows), risk.exposures(rows), names)
    eq, ts, pnl, ex = (spark.read.parquet(f"{path}/{t}") for t in ("equity", "risk_timeseries", "pnl_by_asset", "exposures"))
    total = lambda name: sum((F.col(f"`{a}`") for a in names), F.lit(0.0)).alias(name)
    small = F.col("SMALL") if "SMALL" in names else F.lit(0.0)
    rows = eq.join(ts.select("book_id", "dt", F.round("ret", 6).alias("ret")), ["book_id", "dt"]).join(pnl.select("book_id", "dt", total("pnl"), small.alias("small_pnl")), ["book_id", "dt"]).join(ex.select("book_id", "dt", total("exposure")), ["book_id", "dt"])
    return out(rows, 4, ("book_id", "ret"))


@query(M.TRADES + " select 'friday' book_id, asset, cast(dt as varchar) dt, round(qty, 6) + 0.0 as qty from tr")
def s6_daily_logs(spark, d):
    """Written twice, as appended rows and as snapshots by day: the second run changes nothing. What comes back stands in both."""
    path, rows = folder(spark), M.trades(spark, d).select("book_id", "asset", "dt", "qty")
    for _ in range(2):
        tables.append_once(rows, f"{path}/log")
        tables.write_daily(rows, f"{path}/days")
    days = spark.read.parquet(f"{path}/days")
    return out(spark.read.parquet(f"{path}/log").join(days.select("book_id", "asset", F.col("dt").cast("date").alias("dt"), F.col("qty").alias("again")), ["book_id", "asset", "dt"], "full").filter("qty = again").drop("again"), 6, ("book_id", "asset"))


@query(FEAT + f"select asset, cast(dt as varchar) dt, {', '.join(rnd(c, c, 6) for c in W.FEATURES)} from feat")
def s4_stored_layout(spark, d):
    """The panel stored in buckets by asset and folders by year, and the features of what is read back: no exchange comes before their windows."""
    name = f"panel_{uuid.uuid4().hex}"
    tables.write_layout(panel(spark, d), name, f"{folder(spark)}/{name}")
    return out(W.features(tables.read_layout(spark, name)).select("asset", "dt", *W.FEATURES), 6)


EVENTS = """with b as (select event_type as asset, cast(ts as date) as dt, avg(value) as price from events group by 1, 2),
r as (select *, price / lag(price) over (partition by asset order by dt) - 1 as ret from b)
select asset, cast(dt as varchar) dt, round(avg(ret) over w, 8) + 0.0 as momentum, round(stddev_samp(ret) over w, 8) + 0.0 as volatility from r
window w as (partition by asset order by dt rows between 19 preceding and current row) qualify count(ret) over w = 20"""


@query(EVENTS)
def v1_streamed_features(spark, d):
    """Daily bars of events arrive in two lots; the stream runs once after each."""
    base = folder(spark)
    rows = table(spark, d, "events").groupBy(F.col("event_type").alias("asset"), F.to_date("ts").alias("dt")).agg(F.avg("value").alias("close"))
    for late in (False, True):
        rows.filter((F.dayofmonth("dt") > 25) == F.lit(late)).coalesce(1).write.mode("append").parquet(f"{base}/in")
        bars.run_available(spark, f"{base}/in", f"{base}/store", f"{base}/out", f"{base}/state", window_features)
    return out(spark.read.parquet(f"{base}/out").select("asset", "dt", "momentum", "volatility"))


def window_features(rows):
    p = rows.select("asset", "dt", F.col("close").alias("price")).withColumn("ret", W.simple_return())
    return p.withColumns({"momentum": W.rolling_mean(), "volatility": W.rolling_std()}).filter("momentum is not null")
