"""Panels, series and matrices derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, dt, u): mean unit price of each part type on each ship date."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("dt"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("asset"))
    return lines.join(parts, "l_partkey").groupBy("asset", "dt").agg(F.avg("unit").alias("u"))


def prices(spark: SparkSession, sf_dir: str, smooth: int = 60) -> DataFrame:
    """(asset, dt, price): moving average of the bars, from the first full window on."""
    w = Window.partitionBy("asset").orderBy("dt")
    out = bars(spark, sf_dir).withColumns({"price": F.avg("u").over(w.rowsBetween(1 - smooth, 0)), "rn": F.row_number().over(w)})
    return out.filter(F.col("rn") >= smooth).select("asset", "dt", "price")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, dt, price, ret, mkt_ret)."""
    w = Window.partitionBy("asset").orderBy("dt")
    rows = prices(spark, sf_dir).withColumn("ret", F.col("price") / F.lag("price").over(w) - 1)
    return rows.withColumn("mkt_ret", F.avg("ret").over(Window.partitionBy("dt")))


def regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, y, x1..x5): line price by quantity, discount, tax, retail price and size."""
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", F.col("p_size").cast("double").alias("x5"))
    rows = lines.join(parts, lines["l_partkey"] == parts["p_partkey"])
    return rows.select(F.col("l_returnflag").alias("grp"), F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("x1"), F.col("l_discount").alias("x2"), F.col("l_tax").alias("x3"), F.col("p_retailprice").alias("x4"), "x5")


def classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, y, x1, x2): urgent orders by total price and the customer's balance, standardized."""
    from panelworks.functions.scalar import standardize

    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("double").alias("y"), F.col("o_totalprice").alias("x1"), F.col("c_acctbal").alias("x2"))
    return standardize(rows, ["x1", "x2"])


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, t, value): the events of each user in order."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").cast("string").alias("series_id"), F.row_number().over(w).alias("t"), "value")


#: The same as SQL, to stand before a query's own ``select``.
PANEL_SQL = """
daily as (select p_type as asset, cast(l_shipdate as date) as dt, avg(l_extendedprice / l_quantity) as u
  from lineitem join part on l_partkey = p_partkey group by 1, 2),
px as (select asset, dt, avg(u) over (partition by asset order by dt rows between 59 preceding and current row) as price,
  row_number() over (partition by asset order by dt) as rn from daily),
rt as (select asset, dt, price, price / lag(price) over (partition by asset order by dt) - 1 as ret from px where rn >= 60),
panel as (select asset, dt, price, ret, avg(ret) over (partition by dt) as mkt_ret from rt)
"""
FEATURE_SQL = (
    PANEL_SQL
    + """,
raw_f as (select *, case when count(ret) over w = 20 then avg(ret) over w end as momentum,
  case when count(ret) over w = 20 then stddev_samp(ret) over w end as volatility,
  case when count(ret) over w = 20 then covar_samp(ret, mkt_ret) over w / nullif(var_samp(mkt_ret) over w, 0) end as beta_mkt,
  lag(ret) over (partition by asset order by dt) as ret_lag1
  from panel window w as (partition by asset order by dt rows between 19 preceding and current row)),
feat as (select asset, dt, price, ret, mkt_ret, momentum, volatility, case when volatility > 1e-12 then (ret - momentum) / volatility end as zscore, beta_mkt, ret_lag1
  from raw_f where momentum is not null and volatility > 1e-12 and beta_mkt is not null and ret_lag1 is not null)
"""
)
REGRESSION_SQL = """
reg as (select l_returnflag as grp, l_extendedprice as y, l_quantity as x1, l_discount as x2, l_tax as x3, p_retailprice as x4, cast(p_size as double) as x5
  from lineitem join part on l_partkey = p_partkey)
"""
CLASS_SQL = """
cls0 as (select o_orderkey as row_id, case when o_orderpriority in ('1-URGENT', '2-HIGH') then 1.0::double else 0.0::double end as y, o_totalprice as r1, c_acctbal as r2
  from orders join customer on o_custkey = c_custkey),
cls as (select row_id, y, (r1 - m1) / s1 as x1, (r2 - m2) / s2 as x2 from cls0, (select avg(r1) m1, avg(r2) m2, stddev_samp(r1) s1, stddev_samp(r2) s2 from cls0))
"""
SERIES_SQL = """
ser as (select cast(user_id as varchar) as series_id, row_number() over (partition by user_id order by ts, event_id) as t, value from events)
"""
