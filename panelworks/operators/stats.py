"""Aggregations, splits, alignment and rankings over panels and predictions."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelworks.functions.panel import ANNUAL, S, Series, drawdown, growth
from panelworks.functions.scalar import clip, nonzero
from panelworks.sources.shared import written

# -- performance --------------------------------------------------------------------------------


def performance(returns: DataFrame, keys: Sequence[str] = ("strategy",), order: str = "dt", ret: str = "ret", flat: float = 1e-15) -> DataFrame:
    """One row for each key: n, total_return, cagr, sharpe, max_drawdown, hit_rate. Rows without a return are left out."""
    s = Series("_key", order)
    rows = returns.filter(F.col(ret).isNotNull()).withColumn("_key", F.struct(*keys))
    rows = rows.withColumn("_cum", growth(ret, s)).withColumn("_dd", drawdown("_cum", s))
    total = F.product(1 + F.col(ret)) - 1
    std = F.stddev_samp(ret)
    cagr = F.when(total <= -0.999999, -1.0).otherwise(F.pow(1 + total, F.lit(float(ANNUAL)) / F.count("*")) - 1)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        total.alias("total_return"),
        cagr.alias("cagr"),
        F.when(std > flat, F.avg(ret) / std * ANNUAL**0.5).alias("sharpe"),
        F.min("_dd").alias("max_drawdown"),
        F.avg((F.col(ret) > 0).cast("double")).alias("hit_rate"),
    )


# -- predictions --------------------------------------------------------------------------------


def r_squared(df: DataFrame, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    """1 - SSE / SST. Both sums come from one pass: SST is the variance times n."""
    sst = F.var_pop(y) * F.count(y)
    return df.groupBy(*by).agg((1 - F.sum(F.pow(F.col(y) - F.col(yhat), 2)) / nonzero(sst)).alias("r2"))


def residual_stats(df: DataFrame, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    e = F.col(y) - F.col(yhat)
    return df.groupBy(*by).agg(F.avg(e).alias("mean"), F.stddev_samp(e).alias("std"), F.max(F.abs(e)).alias("max_abs"))


def log_loss(y: Column, p: Column, eps: float = 1e-12) -> Column:
    """Aggregate."""
    q = clip(p, eps, 1 - eps)
    return -F.avg(y * F.log(q) + (1 - y) * F.log(1 - q))


def accuracy(y: Column, yhat: Column) -> Column:
    return F.avg((y == yhat).cast("double"))


def rmse(a: Column, b: Column) -> Column:
    return F.sqrt(F.avg(F.pow(a - b, 2)))


def mse(a: Column, b: Column) -> Column:
    return F.avg(F.pow(a - b, 2))


def directional_accuracy(y: Column, yhat: Column) -> Column:
    """Share of equal signs where the true one isn't 0; NULL if it always is."""
    return F.avg(F.when(F.signum(y) != 0, (F.signum(y) == F.signum(yhat)).cast("double")))


# -- tables -------------------------------------------------------------------------------------


def correlations(df: DataFrame, left: Sequence[str], right: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by.., f1, f2, corr) of all pairs, each over the rows where both are there; one pass."""
    pairs = [(a, b) for a in left for b in right]
    wide = df.groupBy(*by).agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])
    return wide.select(*by, F.inline(cells))


def span(df: DataFrame, value: str, keys: Sequence[str] = ("asset",), order: str = "dt") -> DataFrame:
    """Rows, first and last date, mean and last value by key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(order).alias("first"), F.max(order).alias("last"), F.avg(value).alias("mean"), F.max_by(value, order).alias("last_value"))


def explained(ratios: DataFrame, share: float = 0.95) -> DataFrame:
    """(pc, ratio) with its running sum, and the least number of components that reach ``share``. As many rows as components."""
    cum = ratios.withColumn("cum", F.sum("ratio").over(Window.partitionBy(F.lit(0)).orderBy("pc")))
    least = cum.agg(F.min(F.when(F.col("cum") >= share, F.col("pc"))).alias("k"))
    return cum.crossJoin(F.broadcast(least))  # one row


def last_rows(df: DataFrame, n: int, s: Series = S) -> DataFrame:
    w = Window.partitionBy(s.key).orderBy(F.desc(s.order))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def top_k(df: DataFrame, k: int, value: str = "mu", per: str = "dt", tie: str = "asset") -> DataFrame:
    """The ``k`` largest by size stay for each ``per``, the others become 0; ties go to the first ``tie``."""
    w = Window.partitionBy(per).orderBy(F.desc(F.abs(value)), tie)
    return df.withColumn("_rn", F.row_number().over(w)).withColumn(value, F.when(F.col("_rn") <= k, F.col(value)).otherwise(0.0)).drop("_rn")


def latest(df: DataFrame, s: Series = S) -> DataFrame:
    """The last row of each series, by a partial aggregation."""
    rest = [c for c in df.columns if c != s.key]
    return df.groupBy(s.key).agg(F.max_by(F.struct(*rest), s.order).alias("r")).select(s.key, "r.*")


def sorted_log(trades: DataFrame) -> DataFrame:
    return trades.orderBy("dt", "asset")


def complete_dates(df: DataFrame, n_assets: int | None = None, s: Series = S) -> DataFrame:
    """Rows of dates on which all assets have one."""
    if n_assets is None:
        n_assets = df.agg(F.countDistinct(s.key)).first()[0]
    return df.withColumn("_n", F.count(s.key).over(Window.partitionBy(s.order))).filter(F.col("_n") == n_assets).drop("_n")


def with_market(panel: DataFrame, market: DataFrame, dt: str = "dt", most_rows: int = 1_000_000) -> DataFrame:
    """The market's return by date. A market of at most ``most_rows`` dates goes out as a broadcast; a larger one is joined by a shuffle."""
    small = market.limit(most_rows + 1).count() <= most_rows
    return panel.join(F.broadcast(market) if small else market, dt, "left")


def portfolio_returns(weights: DataFrame, returns: DataFrame, w: str = "w", ret: str = "ret", keys: Sequence[str] = ("dt",), dt: str = "dt") -> DataFrame:
    """Sum of weight times return by date; a missing one counts 0."""
    both = weights.join(returns, [dt, "asset"], "left")
    return both.groupBy(*keys).agg(F.sum(F.col(w) * F.coalesce(ret, F.lit(0.0))).alias("port_ret"))


def aligned(long: DataFrame, names: Sequence[str], name: str = "strategy", value: str = "ret", dt: str = "dt") -> DataFrame:
    """One column for each name, on dates where all have a value."""
    return long.groupBy(dt).pivot(name, list(names)).agg(F.first(value)).dropna()


def union_book(target: DataFrame, current: DataFrame, key: str = "asset") -> DataFrame:
    """Target and current notional over all symbols of either; missing is 0."""
    t, c = target.select(key, F.col("notional").alias("target")), current.select(key, F.col("notional").alias("current"))
    return t.join(c, key, "full_outer").select(key, F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce("current", F.lit(0.0)).alias("current"))


# -- splits -------------------------------------------------------------------------------------


def numbered(df: DataFrame, s: Series = S) -> DataFrame:
    """``i`` from 0 in order and the length ``n`` of each series."""
    return df.withColumn("i", F.row_number().over(s.all()) - 1).withColumn("n", F.count("*").over(Window.partitionBy(s.key)))


def time_split(df: DataFrame, frac: float = 0.7, s: Series = S) -> DataFrame:
    """``split``: train for the first int(n * frac) rows of each series, then test. ``frac`` counts as written: as a double, 0.7 of 90 rows would be 62."""
    return numbered(df, s).withColumn("split", F.when(F.col("i") < F.floor(F.col("n") * F.lit(Decimal(str(frac)))), "train").otherwise("test"))


#: Bits of the hash that one pass of ``hash_cuts`` looks at, and rows of a class that it orders in the end.
CUT_BITS, CUT_ROWS = 12, 10_000


def hash_cuts(df: DataFrame, label: str, row_id: str, share: float, seed: int = 0) -> DataFrame:
    """(label, h, id): of each class the hash and id of the last of its first round(share * n) rows by (hash, id); classes of which none is taken are left out.

    A class is counted by the leading bits of the hash; the bucket in which the cut lies is counted by the next bits, until it holds few rows, and those alone are
    ordered. So no class is sorted, whatever its size: a pass sends at most 2^``CUT_BITS`` rows for each class and task.
    """
    rows = df.select(F.col(label).alias("label"), F.col(row_id).alias("id"), F.xxhash64(F.col(row_id), F.lit(seed)).alias("h"))
    shift = 64 - CUT_BITS
    counts = written(rows.groupBy("label", F.shiftright("h", shift).alias("b")).agg(F.count("*").alias("n")))
    cuts = counts.groupBy("label").agg(F.round(F.sum("n") * share).cast("long").alias("k")).filter("k > 0")
    below = Window.partitionBy("label").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        counts = counts.withColumnRenamed("label", "_l").join(cuts, F.col("_l").eqNullSafe(F.col("label"))).drop("_l")
        counts = counts.withColumn("before", F.coalesce(F.sum("n").over(below), F.lit(0)))
        cuts = written(counts.filter((F.col("before") < F.col("k")) & (F.col("k") <= F.col("before") + F.col("n"))).select("label", (F.col("k") - F.col("before")).alias("k"), "b", "n"))
        of = (F.col("_l").eqNullSafe(F.col("label"))) & (F.shiftright("h", shift) == F.col("b"))
        inside = rows.withColumnRenamed("label", "_l").join(few(cuts.drop("n")), of)
        if shift == 0 or (cuts.agg(F.max("n")).first()[0] or 0) <= CUT_ROWS:
            break
        shift = max(0, shift - CUT_BITS)
        counts = written(inside.groupBy("label", F.shiftright("h", shift).alias("b")).agg(F.count("*").alias("n")))
        cuts = cuts.select("label", "k")
    upto = Window.partitionBy("label").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0)
    ids = inside.groupBy("label", "k", "h", "id").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(upto))
    return ids.filter("upto >= k").groupBy("label").agg(F.min(F.struct("h", "id")).alias("_c")).select("label", "_c.h", "_c.id")


def few(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` to be sent to all tasks if it has at most so many rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def stratified_split(df: DataFrame, label: str, row_id: str, test: float = 0.3, seed: int = 0, exact: bool = True) -> DataFrame:
    """``split`` within each class by a hash of the row's id: round(test * n) test rows, or with ``exact`` False about as many.

    Rows of a NULL class are a class; rows that share an id go together, so a class may then have a few test rows more.
    """
    h = F.xxhash64(F.col(row_id), F.lit(seed))
    if not exact:
        return df.withColumn("split", F.when(F.pmod(h, F.lit(1_000_000)) < int(test * 1_000_000), "test").otherwise("train"))
    cuts = written(hash_cuts(df, label, row_id, test, seed)).select(F.col("label").alias("_l"), F.col("h").alias("_h"), F.col("id").alias("_id"))
    rows = df.join(few(cuts), F.col("_l").eqNullSafe(F.col(label)), "left")
    return rows.withColumn("split", F.when((h < F.col("_h")) | ((h == F.col("_h")) & (F.col(row_id) <= F.col("_id"))), "test").otherwise("train")).drop("_l", "_h", "_id")


def expanding_folds(df: DataFrame, k: int, s: Series = S) -> DataFrame:
    """``fold`` 0..k-1 in which a row is tested (NULL: only trained on). Fold f trains on all rows before its first test row."""
    rows = numbered(df, s)
    test = F.floor(F.col("n") / (k + 1))
    first = F.col("n") - test * k
    return rows.withColumn("fold", F.when((F.col("i") >= first) & (test > 0), F.floor((F.col("i") - first) / test)).cast("int"))


def batch_of(row_id: str, epoch: int | Column, batches: int) -> Column:
    """Number of a row's batch: a hash of id and epoch that other engines have too."""
    epoch = F.lit(epoch) if isinstance(epoch, int) else epoch
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(row_id).cast("string"), epoch.cast("string"))), 1, 8), 16, 10).cast("long")
    return F.pmod(h, F.lit(batches)).cast("int")


def mini_batches(df: DataFrame, row_id: str, size: int, epoch: int, n: int | None = None) -> DataFrame:
    """``batch``: rows dealt by a hash of id and epoch into batches of about ``size``."""
    n = df.count() if n is None else n
    return df.withColumn("batch", batch_of(row_id, epoch, max(1, -(-n // size))))


def eligible(df: DataFrame, warm_up: int = 252, least: int = 60, value: str = "ret", s: Series = S) -> DataFrame:
    """Rows with ``warm_up`` rows and ``least`` values before them."""
    before = s.rows(Window.unboundedPreceding, -1)
    return df.withColumn("_i", F.row_number().over(s.all()) - 1).withColumn("n_obs", F.count(value).over(before)).filter((F.col("_i") >= warm_up) & (F.col("n_obs") >= least)).drop("_i")


# -- time series --------------------------------------------------------------------------------


def acf(df: DataFrame, lags: int = 10, value: str = "value", s: Series = Series("series_id", "t")) -> DataFrame:
    """(series_id, lag, acf): biased, about the mean of the whole series; all lags from one sort."""
    whole = Window.partitionBy(s.key)
    z = df.filter(F.col(value).isNotNull()).withColumn("_z", F.col(value) - F.avg(value).over(whole))
    z = z.withColumns({f"_l{k}": F.lag("_z", k).over(s.all()) for k in range(1, lags + 1)})
    wide = z.groupBy(s.key).agg(F.count("*").alias("n"), *[(F.sum(F.col("_z") * F.col(f"_l{k}")) / nonzero(F.sum(F.col("_z") * F.col("_z")))).alias(f"a{k}") for k in range(1, lags + 1)])
    return wide.select(s.key, "n", F.inline(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"a{k}").alias("acf")) for k in range(1, lags + 1)])))


def chi2_tail(x: Column, df: Column, most: int = 64) -> Column:
    """Upper tail for whole degrees of freedom up to ``most``: the recursion Q(a + 1) = Q(a) + x^a e^-x / gamma(a + 1), as one expression for each."""
    h = x / 2
    out = F.lit(None).cast("double")
    even, odd = [F.lit(0.0)], [erfc(F.sqrt(h))]
    term_e, term_o = F.exp(-h), F.exp(-h) * F.sqrt(h) / 0.8862269254527580
    for k in range(1, most + 1):
        a = k // 2
        if k % 2 == 0:
            even.append(even[-1] + term_e)
            term_e = term_e * h / a
            q = even[-1]
        else:
            q = odd[-1]
            odd.append(odd[-1] + term_o)
            term_o = term_o * h / (a + 1.5)
        out = F.when(df == k, q).otherwise(out)
    return out


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0, as a continued-fraction-free Chebyshev fit; relative error under 1.2e-7."""
    # Coefficients of the published fit.
    c = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    t = 1 / (1 + x / 2)
    p = F.lit(c[-1])
    for a in reversed(c[:-1]):
        p = p * t + a
    return t * F.exp(-x * x + p)


def ar1(df: DataFrame, frac: float = 0.7, value: str = "ret", s: Series = S) -> DataFrame:
    """AR(1) fitted on the first part of each series; one-step forecasts on the rest but its first row: mse and directional accuracy."""
    rows = time_split(df.filter(F.col(value).isNotNull()), frac, s).withColumn("_lag", F.lag(value).over(Window.partitionBy(s.key, "split").orderBy(s.order)))
    train = F.col("split") == "train"
    both = train & F.col("_lag").isNotNull()
    y, x = F.when(both, F.col(value)), F.when(both, F.col("_lag"))
    fit = rows.groupBy(s.key).agg(F.regr_slope(y, x).alias("phi"), F.regr_intercept(y, x).alias("const"), F.count(F.when(train, 1)).alias("train_n"))
    test = rows.filter(~train & F.col("_lag").isNotNull()).join(fit, s.key).withColumn("_p", F.col("const") + F.col("phi") * F.col("_lag"))
    return test.groupBy(s.key).agg(F.first("phi").alias("phi"), F.first("const").alias("const"), F.first("train_n").alias("train_n"), F.count("*").alias("test_n"), mse(F.col(value), F.col("_p")).alias("mse"), directional_accuracy(F.col(value), F.col("_p")).alias("diracc"))
