"""Scalars, windows, features, aggregations, joins, rankings and splits over the panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.functions import panel as W
from panelworks.functions import scalar as P
from panelworks.functions.scalar import add_zero as r
from panelworks.operators import stats as A
from panelworks.plans.registry import query
from panelworks.sources.fixtures import CLASS_SQL, FEATURE_SQL, PANEL_SQL, REGRESSION_SQL, SERIES_SQL, classification, event_series, panel, prices, regression, table

PAN = "with " + PANEL_SQL
FEAT = "with " + FEATURE_SQL
WIN = " window w as (partition by asset order by dt)"


def out(df: DataFrame, digits: int = 8, keep: tuple[str, ...] = ("asset",)) -> DataFrame:
    """Key, date as text, and the other columns rounded."""
    head = [c for c in keep if c in df.columns] + (["dt"] if "dt" in df.columns else [])
    kinds = dict(df.dtypes)
    rest = [(r(F.col(c), digits) if kinds[c] == "double" else F.col(c)).alias(c) for c in df.columns if c not in head]
    return df.select(*[F.col("dt").cast("string").alias("dt") if c == "dt" else c for c in head], *rest)


def rnd(x: str, name: str, digits: int = 8) -> str:
    return f"round({x}, {digits}) + 0.0 as {name}"


# -- P: scalars ---------------------------------------------------------------------------------


@query("select o_orderkey, 1.0::double as x0, o_totalprice as x1 from orders")
def p1_add_intercept(spark, d):
    return P.add_intercept(table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("x1")))


@query(PAN + f"select asset, cast(dt as varchar) dt, {rnd('case when ret is not null then least(greatest(ret, -0.02), 0.02) end', 'clipped')} from panel")
def p2_clip(spark, d):
    return out(panel(spark, d).select("asset", "dt", P.clip(F.col("ret"), -0.02, 0.02).alias("clipped")))


@query(PAN + f"select asset, cast(dt as varchar) dt, {rnd('1 / (1 + exp(-least(greatest(ret * 5000, -40), 40)))', 'p')} from panel where ret is not null")
def p3_sigmoid(spark, d):
    return out(panel(spark, d).filter("ret is not null").select("asset", "dt", P.sigmoid(F.col("ret") * 5000).alias("p")))


@query(PAN + "select asset, cast(dt as varchar) dt, cast(1 / (1 + exp(-ret)) >= 0.5 as int) as label from panel where ret is not null")
def p4_label(spark, d):
    return out(panel(spark, d).filter("ret is not null").select("asset", "dt", P.label_at(P.sigmoid(F.col("ret"))).alias("label")))


@query(FEAT + "select asset, cast(dt as varchar) dt, case when zscore < -0.5 then 1.0 when zscore > 0.5 then -1.0 else 0.0 end::double as pos from feat")
def p5_reversion_position(spark, d):
    return out(W.features(panel(spark, d)).select("asset", "dt", P.reversion_position(F.col("zscore")).alias("pos")))


@query(FEAT + f"select asset, cast(dt as varchar) dt, {rnd('least(greatest(tanh(momentum * 50), -1), 1)', 'pos')} from feat")
def p6_smooth_position(spark, d):
    return out(W.features(panel(spark, d)).select("asset", "dt", P.smooth_position(F.col("momentum")).alias("pos")))


@query(FEAT + f", c as (select *, least(greatest(momentum, -0.002), 0.002) m from feat) select asset, cast(dt as varchar) dt, {rnd('case when abs(m) < 0.0005 then 0.0 else m end', 'mu')} from c")
def p7_dead_zone(spark, d):
    return out(W.features(panel(spark, d)).select("asset", "dt", P.dead_zone(F.col("momentum"), 0.002, 0.0005).alias("mu")))


@query(FEAT + "select asset, count(*)::bigint as n from feat group by asset")
def p8_complete_rows(spark, d):
    return W.features(panel(spark, d)).groupBy("asset").agg(F.count("*").alias("n"))


@query(PAN + f"select asset, cast(dt as varchar) dt, {rnd('case when ret is null or isnan(ret) or isinf(ret) then 0 else ret end', 'ret')} from panel")
def p9_finite_or_zero(spark, d):
    return out(panel(spark, d).select("asset", "dt", P.finite_or_zero(F.col("ret")).alias("ret")))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, round(l_extendedprice / nullif(l_discount, 0), 4) + 0.0 as ratio from lineitem")
def p10_nonzero(spark, d):
    rows = table(spark, d, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", r(F.col("l_extendedprice") / P.nonzero(F.col("l_discount")), 4).alias("ratio"))


@query(PAN + "select asset, cast(dt as varchar) dt, isodow(dt) = 5 as rebalance from panel")
def p11_rebalance_day(spark, d):
    return out(panel(spark, d).select("asset", "dt", P.is_rebalance_day(F.col("dt")).alias("rebalance")))


@query(PAN + ", s as (select asset, min(dt) a, max(dt) b from panel group by asset) select asset, cast(x as varchar)[1:10] dt from s, unnest(generate_series(a, b, interval 1 day)) u(x) where isodow(x) < 6")
def p12_business_days(spark, d):
    return out(P.business_days(panel(spark, d), by="asset"))


@query(PAN + ", s as (select asset, min(dt) a, max(dt) b from panel group by asset), c as (select asset, cast(cast(x as varchar)[1:10] as date) dt from s, unnest(generate_series(a, b, interval 1 day)) u(x) where isodow(x) < 6) select asset, cast(dt as varchar) dt from c anti join panel using (asset, dt)")
def p12_gaps(spark, d):
    return out(P.gaps(panel(spark, d), by="asset"))


@query("select o_orderkey, split_part('Status.' || o_orderstatus, '.', -1) as status from orders")
def p13_tail_name(spark, d):
    return table(spark, d, "orders").select("o_orderkey", P.tail_name(F.concat(F.lit("Status."), "o_orderstatus")).alias("status"))


@query(PAN + f"select asset, cast(dt as varchar) dt, {rnd('sign(ret) * greatest(abs(ret) - 0.005, 0)', 's')} from panel where ret is not null")
def p14_soft_threshold(spark, d):
    return out(panel(spark, d).filter("ret is not null").select("asset", "dt", P.soft_threshold(F.col("ret"), 0.005).alias("s")))


@query("with " + CLASS_SQL + "select row_id, y, round(x1, 8) + 0.0 as x1, round(x2, 8) + 0.0 as x2 from cls")
def p15_standardize(spark, d):
    return out(classification(spark, d), keep=("row_id", "y"))


@query(PAN + f"select asset, {rnd('least(1, abs(sum(ret * mkt_ret)) / sqrt(sum(ret * ret) * sum(mkt_ret * mkt_ret)))', 'cosine')}, {rnd('acos(least(1, abs(sum(ret * mkt_ret)) / sqrt(sum(ret * ret) * sum(mkt_ret * mkt_ret))))', 'angle', 6)} from panel group by asset")
def p16_angle(spark, d):
    g = panel(spark, d).groupBy("asset").agg(P.abs_cosine(F.col("ret"), F.col("mkt_ret")).alias("c"), P.angle(F.col("ret"), F.col("mkt_ret")).alias("a"))
    return g.select("asset", r(F.col("c"), 8).alias("cosine"), r(F.col("a"), 6).alias("angle"))


@query("with " + REGRESSION_SQL + "select grp, round(avg(10 + 1000 * x1 - 50 * x2 + 0.5 * x4), 4) + 0.0 as mean_yhat, count(*)::bigint as n from reg group by grp")
def p17_linear_prediction(spark, d):
    return regression(spark, d).withColumn("yhat", P.linear(["x1", "x2", "x4"], [1000, -50, 0.5], 10)).groupBy("grp").agg(r(F.avg("yhat"), 4).alias("mean_yhat"), F.count("*").alias("n"))


# -- W, R: windows ------------------------------------------------------------------------------


def _w(name: str, spark_col, sql: str, digits: int = 8):
    """A query with one window column over the panel."""

    def f(spark, d):
        return out(panel(spark, d).withColumn("v", spark_col()).select("asset", "dt", "v"), digits)

    f.__name__ = name
    query(PAN + f"select asset, cast(dt as varchar) dt, {rnd(sql, 'v', digits)} from panel" + WIN)(f)


def rows(n: int, last: str = "current row") -> str:
    return f"(partition by asset order by dt rows between {n} preceding and {last})"


_w("w1_simple_return", W.simple_return, "price / lag(price) over w - 1")
_w("w2_log_return", W.log_return, "ln(price / lag(price) over w)")
_w("w3_k_return", lambda: W.simple_return("price", 21), "price / lag(price, 21) over w - 1")
_w("w4_lagged_return", W.lagged, "lag(ret) over w")
_w("w5_forward_return", W.forward, "lead(ret) over w")
_w("w6_growth", W.growth, "product(1 + ret) over (partition by asset order by dt rows unbounded preceding)")
_w("r1_momentum", W.rolling_mean, f"case when count(ret) over {rows(19)} = 20 then avg(ret) over {rows(19)} end")
_w("r2_volatility", W.rolling_std, f"case when count(ret) over {rows(19)} = 20 then stddev_samp(ret) over {rows(19)} end")
_w("r3_zscore", W.rolling_zscore, f"case when count(ret) over {rows(19)} = 20 and stddev_samp(ret) over {rows(19)} > 1e-12 then (ret - avg(ret) over {rows(19)}) / stddev_samp(ret) over {rows(19)} end", 6)
_w("r4_price_zscore", lambda: W.rolling_zscore("price", 63), f"case when count(price) over {rows(62)} = 63 and stddev_samp(price) over {rows(62)} > 1e-12 then (price - avg(price) over {rows(62)}) / stddev_samp(price) over {rows(62)} end", 6)
_w("r5_rolling_beta", W.rolling_beta, f"case when count(ret) over {rows(19)} = 20 then covar_samp(ret, mkt_ret) over {rows(19)} / nullif(var_samp(mkt_ret) over {rows(19)}, 0) end", 6)
_w(
    "r6_rolling_beta_lagged",
    W.rolling_beta_lagged,
    f"case when count(ret) over {rows(20, '1 preceding')} = 20 and stddev_pop(mkt_ret) over {rows(20, '1 preceding')} >= 1e-12 then regr_slope(ret, mkt_ret) over {rows(20, '1 preceding')} end",
    6,
)
_w("r8_realized_vol", W.realized_vol, f"case when count(ret) over {rows(62)} = 63 then stddev_samp(ret) over {rows(62)} * sqrt(252) end")


@query(PAN + f", c as (select asset, dt, product(1 + ret) over (partition by asset order by dt rows unbounded preceding) cum from panel) select asset, cast(dt as varchar) dt, {rnd('cum / max(cum) over (partition by asset order by dt rows unbounded preceding) - 1', 'dd')} from c")
def w7_drawdown(spark, d):
    return out(panel(spark, d).withColumn("cum", W.growth()).withColumn("dd", W.drawdown()).select("asset", "dt", "dd"))


WEIGHTS = FEAT + ", wt as (select asset, dt, price, ret, case when isodow(dt) = 5 then case when zscore < -0.5 then 0.5 when zscore > 0.5 then -0.5 else 0.0 end end as w from feat)"


def friday_weights(spark, d):
    w = F.when(P.is_rebalance_day(F.col("dt")), P.reversion_position(F.col("zscore")) * 0.5)
    return W.features(panel(spark, d)).select("asset", "dt", "ret", w.alias("w"))


@query(
    WEIGHTS
    + """ select asset, cast(dt as varchar) dt, coalesce(last_value(nullif(w, 0) ignore nulls) over v, 0)::double as sticky, coalesce(last_value(w ignore nulls) over v, 0)::double as carried
from wt window v as (partition by asset order by dt rows unbounded preceding)"""
)
def w8_carried(spark, d):
    rows_ = friday_weights(spark, d)
    return out(rows_.select("asset", "dt", W.carried().alias("sticky"), W.carried(sticky_zero=False).alias("carried")))


@query(WEIGHTS + ", h as (select asset, dt, coalesce(w, 0)::double w from wt) select asset, cast(dt as varchar) dt, coalesce(lag(w) over w_, 0)::double as prior, (w - lag(w) over w_)::double as change from h window w_ as (partition by asset order by dt)")
def w9_prior_and_change(spark, d):
    rows_ = friday_weights(spark, d).withColumn("w", F.coalesce("w", F.lit(0.0)))
    return out(rows_.select("asset", "dt", W.prior().alias("prior"), W.change().alias("change")))


@query(FEAT + f"select asset, cast(dt as varchar) dt, {', '.join(rnd(c, c, 6) for c in W.FEATURES)} from feat")
def r7_features(spark, d):
    return out(W.features(panel(spark, d)).select("asset", "dt", *W.FEATURES), 6)


@query(PAN + f", b as (select *, row_number() over (partition by asset order by dt desc) rn from panel where ret is not null) select asset, {rnd('case when count(*) = 21 then stddev_samp(ret) * sqrt(252) else 0 end', 'vol')} from b where rn <= 21 group by asset")
def r9_last_vol(spark, d):
    return out(W.last_vol(panel(spark, d)))


# -- A: aggregations ----------------------------------------------------------------------------

PERF = """, cum as (select *, product(1 + ret) over (partition by strategy, asset order by dt rows unbounded preceding) c from strat where ret is not null),
dd as (select *, c / max(c) over (partition by strategy, asset order by dt rows unbounded preceding) - 1 dd from cum),
perf as (select strategy, asset, count(*) n, product(1 + ret) - 1 tot, avg(ret) m, stddev_samp(ret) s, min(dd) mdd, avg(cast(ret > 0 as double)) hit from dd group by 1, 2)
select strategy, asset, n::bigint n, round(tot, 6) + 0.0 as total_return, round(case when tot <= -0.999999 then -1 else pow(1 + tot, 252.0 / n) - 1 end, 6) + 0.0 as cagr,
round(case when s > 1e-15 then m / s * sqrt(252) end, 6) + 0.0 as sharpe, round(mdd, 6) + 0.0 as max_drawdown, round(hit, 6) + 0.0 as hit_rate from perf"""

COSTED = """, pos as (select asset, dt, ret, case when zscore < -0.5 then 1.0 when zscore > 0.5 then -1.0 else 0.0 end as w from feat),
pnl as (select asset, dt, ret, w, coalesce(lag(w) over (partition by asset order by dt), 0) * ret - 0.0005 * abs(w - coalesce(lag(w) over (partition by asset order by dt), 0)) as net from pos)"""


@query(PAN + ", strat as (select 'hold' strategy, asset, dt, ret from panel)" + PERF)
def a1_performance(spark, d):
    rows_ = panel(spark, d).withColumn("strategy", F.lit("hold"))
    return out(A.performance(rows_, ["strategy", "asset"]), 6, ("strategy", "asset"))


PRED = "with " + REGRESSION_SQL + ", pr as (select *, x1 * x4 as yhat from reg) "


def predicted(spark, d):
    return regression(spark, d).withColumn("yhat", F.col("x1") * F.col("x4"))


@query(PRED + ", m as (select grp, avg(y) my from pr group by grp) select grp, round(1 - sum(pow(y - yhat, 2)) / sum(pow(y - my, 2)), 8) + 0.0 as r2 from pr join m using (grp) group by grp")
def a2_r_squared(spark, d):
    return out(A.r_squared(predicted(spark, d), "y", "yhat", ["grp"]), keep=("grp",))


@query(PRED + "select grp, round(avg(y - yhat), 4) + 0.0 as mean, round(stddev_samp(y - yhat), 4) + 0.0 as std, round(max(abs(y - yhat)), 4) + 0.0 as max_abs from pr group by grp")
def a3_residual_stats(spark, d):
    return out(A.residual_stats(predicted(spark, d), "y", "yhat", ["grp"]), 4, ("grp",))


SCORED = "with " + CLASS_SQL + ", sc as (select *, 1 / (1 + exp(-(0.3 * x1 - 0.2 * x2))) p from cls) "


def scored(spark, d):
    return classification(spark, d).withColumn("p", P.sigmoid(P.linear(["x1", "x2"], [0.3, -0.2])))


@query(SCORED + "select round(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 8) + 0.0 as loss from sc")
def a4_log_loss(spark, d):
    return scored(spark, d).agg(r(A.log_loss(F.col("y"), F.col("p")), 8).alias("loss"))


@query(SCORED + "select round(avg(cast(cast(p >= 0.5 as int) = y as double)), 8) + 0.0 as accuracy from sc")
def a5_accuracy(spark, d):
    return scored(spark, d).agg(r(A.accuracy(F.col("y"), P.label_at(F.col("p")).cast("double")), 8).alias("accuracy"))


@query(PRED + "select grp, round(sqrt(avg(pow(y - yhat, 2))), 4) + 0.0 as rmse from pr group by grp")
def a6_rmse(spark, d):
    return predicted(spark, d).groupBy("grp").agg(r(A.rmse(F.col("y"), F.col("yhat")), 4).alias("rmse"))


@query(FEAT + ", t as (select asset, lead(ret) over (partition by asset order by dt) y, -ret p from feat) select asset, round(avg(pow(y - p, 2)), 10) + 0.0 as mse, round(avg(case when sign(y) <> 0 then cast(sign(y) = sign(p) as double) end), 8) + 0.0 as diracc from t where y is not null group by asset")
def a7_mse_direction(spark, d):
    t = W.features(panel(spark, d)).withColumn("y", W.forward()).filter("y is not null").withColumn("p", -F.col("ret"))
    return t.groupBy("asset").agg(r(A.mse(F.col("y"), F.col("p")), 10).alias("mse"), r(A.directional_accuracy(F.col("y"), F.col("p")), 8).alias("diracc"))


@query(FEAT + ", t as (select *, lead(ret) over (partition by asset order by dt) fwd from feat) " + " union all ".join(f"select '{a}' f1, '{b}' f2, round(corr({a}, {b}), 8) + 0.0 as corr from t" for a in W.FEATURES for b in [*W.FEATURES, "fwd"]))
def a8_correlations(spark, d):
    t = W.features(panel(spark, d)).withColumn("fwd", W.forward())
    return out(A.correlations(t, W.FEATURES, [*W.FEATURES, "fwd"]), keep=("f1", "f2"))


@query(PAN + 'select asset, count(*)::bigint n, cast(min(dt) as varchar) "first", cast(max(dt) as varchar) "last", round(avg(price), 6) + 0.0 as mean, round(max_by(price, dt), 6) + 0.0 as last_value from panel group by asset')
def a9_span(spark, d):
    s = A.span(panel(spark, d), "price").withColumn("first", F.col("first").cast("string")).withColumn("last", F.col("last").cast("string"))
    return out(s, 6)


@query("with v as (select label pc, var_pop(e) v from (select label, unnest(embedding)::double e from embeddings) group by 1), t as (select pc, v / sum(v) over () ratio from v), c as (select *, sum(ratio) over (order by pc) cum from t) select pc, round(ratio, 8) + 0.0 as ratio, round(cum, 8) + 0.0 as cum, (select min(pc) from c where cum >= 0.95) as k from c")
def a10_explained(spark, d):
    v = table(spark, d, "embeddings").select(F.col("label").alias("pc"), F.explode("embedding").alias("e")).groupBy("pc").agg(F.var_pop(F.col("e").cast("double")).alias("v"))
    total = v.agg(F.sum("v").alias("t"))
    return out(A.explained(v.crossJoin(F.broadcast(total)).select("pc", (F.col("v") / F.col("t")).alias("ratio"))), keep=("pc", "k"))


# -- J, T, D ------------------------------------------------------------------------------------


@query(PAN + ", m as (select dt, avg(ret) m from rt group by dt) select asset, cast(dt as varchar) dt, round(m, 8) + 0.0 as mkt_ret from rt left join m using (dt)")
def j1_market_return(spark, d):
    p = panel(spark, d).select("asset", "dt", "ret")
    return out(A.with_market(p.drop("ret"), p.groupBy("dt").agg(F.avg("ret").alias("mkt_ret"))))


@query(WEIGHTS + ", h as (select asset, dt, coalesce(w, 0) w from wt) select cast(h.dt as varchar) dt, round(sum(w * coalesce(ret, 0)), 8) + 0.0 as port_ret from h left join panel p on h.asset = p.asset and h.dt = p.dt group by h.dt")
def j2_portfolio_return(spark, d):
    w = friday_weights(spark, d).select("asset", "dt", F.coalesce("w", F.lit(0.0)).alias("w"))
    return out(A.portfolio_returns(w, panel(spark, d).select("asset", "dt", "ret")))


@query(PAN + "select asset, cast(dt as varchar) dt, round(ret, 8) + 0.0 as arith, round(ln(1 + ret), 8) + 0.0 as log from panel where ret is not null")
def j3_aligned_series(spark, d):
    p = panel(spark, d).withColumns({"arith": W.simple_return(), "log": W.log_return()}).filter("arith is not null")
    long = p.select("asset", "dt", F.inline(F.array(*[F.struct(F.lit(x).alias("strategy"), F.col(x).alias("v")) for x in ("arith", "log")])))
    wide = long.groupBy("asset", "dt").pivot("strategy", ["arith", "log"]).agg(F.first("v")).dropna()
    return out(wide)


BOOK = """with r as (select l_returnflag flag, p_type, p_brand, p_size, l_extendedprice v from lineitem join part on l_partkey = p_partkey),
t as (select case when flag = 'A' then p_type else p_brand end asset, sum(v) notional from r where flag <> 'R' group by 1),
c as (select case when p_size % 2 = 0 then p_type else 'size ' || p_size end asset, sum(v) notional from r where flag = 'R' group by 1),
u as (select coalesce(t.asset, c.asset) asset, coalesce(t.notional, 0) target, coalesce(c.notional, 0) current from t full join c on t.asset = c.asset) """


def books(spark, d):
    """All rows go into one of two books: returned ones are held, the others wanted; some assets are in both."""
    rows_ = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    total = F.sum("l_extendedprice").alias("notional")
    target = rows_.filter("l_returnflag <> 'R'").groupBy(F.when(F.col("l_returnflag") == "A", F.col("p_type")).otherwise(F.col("p_brand")).alias("asset")).agg(total)
    current = rows_.filter("l_returnflag = 'R'").groupBy(F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.concat(F.lit("size "), F.col("p_size"))).alias("asset")).agg(total)
    return target, current


@query(BOOK + "select asset, round(target, 2) + 0.0 as target, round(current, 2) + 0.0 as current from u")
def j4_union_book(spark, d):
    return out(A.union_book(*books(spark, d)), 2)


@query(PAN + "select a.asset asset_a, b.asset asset_b, cast(a.dt as varchar) dt, round(a.ret * b.ret, 10) + 0.0 as prod from panel a join panel b on a.dt = b.dt and a.asset <= b.asset where a.ret is not null and b.ret is not null")
def j5_return_pairs(spark, d):
    from panelworks.operators.risk import return_pairs

    return out(return_pairs(panel(spark, d)).select("asset_a", "asset_b", "dt", (F.col("ra") * F.col("rb")).alias("prod")), 10, ("asset_a", "asset_b"))


@query(FEAT + COSTED + ", strat as (select 'hold' strategy, asset, dt, ret from pnl union all select 'reversion', asset, dt, net from pnl)" + PERF)
def j6_stacked_strategies(spark, d):
    from panelworks.operators.backtest import reversion

    return out(A.performance(reversion(W.features(panel(spark, d))), ["strategy", "asset"]), 6, ("strategy", "asset"))


@query(PAN + ", t as (select *, row_number() over (partition by asset order by dt desc) rn from panel) select asset, cast(dt as varchar) dt, round(price, 6) + 0.0 as price from t where rn <= 5")
def t1_last_rows(spark, d):
    return out(A.last_rows(panel(spark, d).select("asset", "dt", "price"), 5), 6)


@query(FEAT + ", t as (select *, row_number() over (partition by dt order by abs(momentum) desc, asset) rn from feat) select asset, cast(dt as varchar) dt, round(case when rn <= 2 then momentum else 0 end, 8) + 0.0 as mu from t")
def t2_top_k(spark, d):
    return out(A.top_k(W.features(panel(spark, d)).select("asset", "dt", F.col("momentum").alias("mu")), 2))


@query(FEAT + "select asset, cast(max(dt) as varchar) dt, round(max_by(zscore, dt), 6) + 0.0 as zscore from feat group by asset")
def t3_latest(spark, d):
    return out(A.latest(W.features(panel(spark, d)).select("asset", "dt", "zscore")), 6)


@query(FEAT + COSTED + ", q as (select asset, dt, w - coalesce(lag(w) over (partition by asset order by dt), 0) qty from pos) select asset, cast(dt as varchar) dt, qty::double qty from q where qty <> 0 order by dt, asset")
def t4_trade_log(spark, d):
    pos = W.features(panel(spark, d)).withColumn("w", P.reversion_position(F.col("zscore")))
    return A.sorted_log(pos.withColumn("qty", F.col("w") - W.prior()).filter("qty <> 0").select("asset", F.col("dt").cast("string").alias("dt"), "qty"))


@query("with " + SERIES_SQL + ", n as (select *, count(*) over (partition by series_id) n from ser) select series_id, sum(cast(t - 1 < floor(n * 0.7) as int))::bigint as train, sum(cast(t - 1 >= floor(n * 0.7) as int))::bigint as test from n group by 1")
def d1_time_split(spark, d):
    s = A.time_split(event_series(spark, d), 0.7, W.Series("series_id", "t"))
    return s.groupBy("series_id").agg(F.sum((F.col("split") == "train").cast("int")).alias("train"), F.sum((F.col("split") == "test").cast("int")).alias("test"))


@query("with " + CLASS_SQL + "select y, round(0.3 * count(*))::bigint as test, (count(*) - round(0.3 * count(*)))::bigint as train from cls group by y")
def d2_stratified_split(spark, d):
    s = A.stratified_split(classification(spark, d), "y", "row_id")
    return s.groupBy("y").agg(F.count(F.when(F.col("split") == "test", 1)).alias("test"), F.count(F.when(F.col("split") == "train", 1)).alias("train"))


@query("with " + SERIES_SQL + ", n as (select *, count(*) over (partition by series_id) n from ser), f as (select *, n // 6 test from n) select series_id, t::bigint t, cast((t - 1 - (n - 5 * test)) // test as int) as fold from f where t - 1 >= n - 5 * test")
def d3_expanding_folds(spark, d):
    return A.expanding_folds(event_series(spark, d), 5, W.Series("series_id", "t")).filter("fold is not null").select("series_id", F.col("t").cast("long").alias("t"), "fold")


@query("with " + CLASS_SQL + ", b as (select cast('0x' || substr(md5(row_id::varchar || ':1'), 1, 8) as bigint) % (select ceil(count(*) / 64)::bigint from cls) as batch from cls) select batch::int as batch, count(*)::bigint as n from b group by 1")
def d4_mini_batches(spark, d):
    return A.mini_batches(classification(spark, d), "row_id", 64, 1).groupBy("batch").agg(F.count("*").alias("n"))


@query(PAN + ", e as (select asset, dt, row_number() over w - 1 i, count(ret) over (partition by asset order by dt rows between unbounded preceding and 1 preceding) n_obs from panel window w as (partition by asset order by dt)) select asset, cast(dt as varchar) dt, n_obs::bigint n_obs from e where i >= 252 and n_obs >= 60")
def d5_eligible(spark, d):
    return out(A.eligible(panel(spark, d)).select("asset", "dt", "n_obs"))


# -- X: time series -----------------------------------------------------------------------------


def _acf_sql(lags: int) -> str:
    z = "with " + SERIES_SQL + ", z as (select *, value - avg(value) over (partition by series_id) z from ser), l as (select *, " + ", ".join(f"lag(z, {k}) over w l{k}" for k in range(1, lags + 1)) + " from z window w as (partition by series_id order by t)), "
    return z + "a as (select series_id, count(*) n, " + ", ".join(f"sum(z * l{k}) / sum(z * z) a{k}" for k in range(1, lags + 1)) + " from l group by 1), acf as (" + " union all ".join(f"select series_id, n, {k} lag, a{k} acf from a" for k in range(1, lags + 1)) + ") "


@query(_acf_sql(10) + "select series_id, n::bigint n, lag, round(acf, 8) + 0.0 as acf from acf")
def x1_acf(spark, d):
    return out(A.acf(event_series(spark, d)), keep=("series_id", "n", "lag"))


@query(_acf_sql(10) + "select series_id, lag, round(n * (n + 2) * sum(acf * acf / (n - lag)) over (partition by series_id order by lag), 8) + 0.0 as q from acf")
def x2_ljung_box(spark, d):
    from panelworks.operators.series import ljung_box

    return out(ljung_box(event_series(spark, d)).drop("p_value"), keep=("series_id", "lag"))


def _chi2_sql(lags: int) -> str:
    """Upper tails of 1 to ``lags`` degrees of freedom of ``q``, by the same published fit of the error function."""
    h, c = "(q / 2)", [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    t, poly = f"(1 / (1 + sqrt({h}) / 2))", str(c[-1])
    for a in reversed(c[:-1]):
        poly = f"({poly} * {t} + ({a}))"
    odd, even = f"{t} * exp(-{h} + {poly})", "0"
    text, term_o, term_e = "", f"exp(-{h}) * sqrt({h}) / 0.8862269254527580", f"exp(-{h})"
    for k in range(1, lags + 1):
        if k % 2 == 0:
            even, term_e = f"{even} + {term_e}", f"{term_e} * {h} / {k // 2}"
        text += f" when lag = {k} then {even if k % 2 == 0 else odd}"
        if k % 2:
            odd, term_o = f"{odd} + {term_o}", f"{term_o} * {h} / {k // 2 + 1.5}"
    return f"case{text} end"


@query(_acf_sql(10) + ", lb as (select series_id, lag, n * (n + 2) * sum(acf * acf / (n - lag)) over (partition by series_id order by lag) as q from acf) select series_id, lag, round(q, 6) + 0.0 as q, round(" + _chi2_sql(10) + ", 6) + 0.0 as p_value from lb")
def x2_ljung_box_p(spark, d):
    from panelworks.operators.series import ljung_box

    return out(ljung_box(event_series(spark, d)), 6, keep=("series_id", "lag"))


@query()
def x3_adf(spark, d):
    from panelworks.operators.series import adf

    return out(adf(panel(spark, d), value="ret", s=W.S), 6, ("asset", "lags", "n_obs"))


@query(
    PAN
    + """, o as (select asset, dt, ret, row_number() over (partition by asset order by dt) - 1 i, count(*) over (partition by asset) n from panel where ret is not null),
s as (select *, case when i < floor(n * 0.7) then 'train' else 'test' end split from o), l as (select *, lag(ret) over (partition by asset, split order by dt) x from s),
f as (select asset, regr_slope(ret, x) phi, regr_intercept(ret, x) c, (select count(*) from s s2 where s2.asset = l.asset and split = 'train') tn from l where split = 'train' and x is not null group by asset),
t as (select asset, ret y, c + phi * x p, phi, c, tn from l join f using (asset) where split = 'test' and x is not null)
select asset, round(min(phi), 8) + 0.0 as phi, round(min(c), 8) + 0.0 as const, min(tn)::bigint train_n, count(*)::bigint test_n, round(avg(pow(y - p, 2)), 10) + 0.0 as mse,
round(avg(case when sign(y) <> 0 then cast(sign(y) = sign(p) as double) end), 8) + 0.0 as diracc from t group by asset"""
)
def x4_ar1(spark, d):
    a = A.ar1(panel(spark, d))
    return a.select("asset", r(F.col("phi"), 8).alias("phi"), r(F.col("const"), 8).alias("const"), "train_n", "test_n", r(F.col("mse"), 10).alias("mse"), r(F.col("diracc"), 8).alias("diracc"))


@query(PAN + ", c as (select *, count(*) over (partition by dt) k from px where rn >= 60) select asset, cast(dt as varchar) dt, round(price, 6) + 0.0 as price from c where k = (select count(distinct asset) from px where rn >= 60)")
def s3_complete_dates(spark, d):
    return out(A.complete_dates(prices(spark, d)), 6)
