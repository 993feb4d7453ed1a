"""Walk-forward forecasts: ridge on all rows before, out-of-fold predictions, stacks, trees and models of the caller's own.

The rows that a fit may see end before its date; all of a row's training moments are windows over its asset's rows, so a fit costs the same
whatever the length of the history.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelworks.functions.panel import FEATURES, S, Series, forward
from panelworks.functions.scalar import complete, dead_zone, is_rebalance_day
from panelworks.operators.linear import coordinate_descent, ridge_forecast, square
from panelworks.operators.stats import expanding_folds
from panelworks.operators.trees import Sets, Table, bin_edges, binned, boosted, forest
from panelworks.sources.shared import checkpointed, written


def _array(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(float)


def walk_forward_ridge(features: DataFrame, x: Sequence[str] = FEATURES, alpha: float = 5.0, min_train: int = 252, s: Series = S, clip: float | None = None, only_rebalance: bool = False) -> DataFrame:
    """``features`` rows from ``min_train`` on that have a next return, with ``yhat``: the forecast of a ridge on all rows before.

    Means, covariances and their growth down the rows are Spark's own window aggregates; the helper solves one d x d system for each row.
    """
    w = s.rows(Window.unboundedPreceding, -1)
    d = len(x)
    rows = features.withColumn("_y", forward("ret", 1, s))
    rows = rows.withColumns(
        {
            "_i": F.row_number().over(s.all()) - 1,
            "_m": F.array(*[F.avg(c).over(w) for c in x]),
            "_c": F.array(*[F.covar_pop(x[a], x[b]).over(w) for a in range(d) for b in range(a, d)]),
            "_ym": F.avg("_y").over(w),
            "_xy": F.array(*[F.covar_pop(c, "_y").over(w) for c in x]),
        }
    ).filter((F.col("_i") >= min_train) & F.col("_y").isNotNull())
    if only_rebalance:
        rows = rows.filter(is_rebalance_day(F.col(s.order)))
    keep = features.columns
    rows = rows.withColumn("_x", F.array(*[F.col(c).cast("double") for c in x])).select(*keep, "_i", "_m", "_c", "_ym", "_xy", "_x")

    def run(frames):
        for f in frames:
            if len(f):
                f["yhat"] = ridge_forecast(f["_i"].to_numpy(float), _array(f["_m"]), square(_array(f["_c"]), d), f["_ym"].to_numpy(float), _array(f["_xy"]), _array(f["_x"]), alpha)
            else:
                f["yhat"] = pd.Series(dtype=float)
            yield f[[*keep, "yhat"]]

    kinds = dict(features.dtypes)
    out = rows.mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", yhat double")
    return out.withColumn("yhat", dead_zone(F.col("yhat"), clip, 0.0)) if clip else out


# -- stacks of linear models from moments --------------------------------------------------------


def _sums(x: Sequence[str]) -> list:
    d = len(x)
    y = F.coalesce("_y", F.lit(0.0))
    one = F.when(F.col("_y").isNotNull(), 1.0).otherwise(0.0)
    z = [F.col(f"_z{j}") for j in range(d)]
    return [one, *[one * c for c in z], y, *[one * z[a] * z[b] for a in range(d) for b in range(a, d)], *[c * y for c in z], y * y]


def _moments(v: np.ndarray, d: int):
    """n, mean, cov, y mean, xy cov, y variance of sums (.., k)."""
    n = v[..., 0]
    safe = np.maximum(n, 1)
    mean, ym = v[..., 1 : d + 1] / safe[..., None], v[..., d + 1] / safe
    k = d * (d + 1) // 2
    cov = square(v[..., d + 2 : d + 2 + k], d) / safe[..., None, None] - mean[..., :, None] * mean[..., None, :]
    xy = v[..., d + 2 + k : d + 2 + k + d] / safe[..., None] - mean * ym[..., None]
    return n, mean, cov, ym, xy, v[..., -1] / safe - ym**2


def linear_models(m, ridge_alpha: float, lasso_alpha: float, sweeps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(intercepts (N, 2), slopes (N, 2, d)) of a ridge and a lasso on columns scaled by their population deviation."""
    n, mean, cov, ym, xy, _ = m
    d = mean.shape[-1]
    s = np.sqrt(np.maximum(np.diagonal(cov, axis1=-2, axis2=-1), 0))
    s = np.where(s <= 1e-12, 1.0, s)
    r, c = cov / (s[..., :, None] * s[..., None, :]), xy / s
    ridge = np.linalg.solve(r + (ridge_alpha / n)[..., None, None] * np.eye(d), c[..., None])[..., 0]
    lasso = coordinate_descent(r, c, lasso_alpha, sweeps, 1e-14)
    slopes = np.stack([ridge, lasso], -2) / s[..., None, :]
    return ym[..., None] - (slopes * mean[..., None, :]).sum(-1), slopes


def stack(folds: np.ndarray, history: np.ndarray, at: np.ndarray, d: int, ridge_alpha: float, lasso_alpha: float, meta_alpha: float):
    """(forecasts (N,), meta weights (N, 2)). ``folds`` (N, k + 1, m): sums up to each fold's end; ``history`` (N, m): sums of all rows before.

    A fold's predictions are affine in the features, so their moments on the test rows follow from the test rows' moments; so does the meta-ridge.
    """
    n = len(history)
    g, b, sp, sy, total = np.zeros((n, 2, 2)), np.zeros((n, 2)), np.zeros((n, 2)), np.zeros(n), np.zeros(n)
    for k in range(1, folds.shape[1]):
        a, w = linear_models(_moments(folds[:, k - 1], d), ridge_alpha, lasso_alpha)
        m, mean, cov, ym, xy, _ = _moments(folds[:, k] - folds[:, k - 1], d)
        pm = a + (w * mean[:, None, :]).sum(-1)
        g += m[:, None, None] * (np.einsum("nid,nde,nje->nij", w, cov, w) + pm[:, :, None] * pm[:, None, :])
        b += m[:, None] * (np.einsum("nid,nd->ni", w, xy) + pm * ym[:, None])
        sp += m[:, None] * pm
        sy += m * ym
        total += m
    pbar, ybar = sp / total[:, None], sy / total
    gc = g - total[:, None, None] * pbar[:, :, None] * pbar[:, None, :] + meta_alpha * np.eye(2)
    bc = b - total[:, None] * pbar * ybar[:, None]
    meta = np.linalg.solve(gc, bc[..., None])[..., 0]
    a, w = linear_models(_moments(history, d), ridge_alpha, lasso_alpha)
    base = a + (w * at[:, None, :]).sum(-1)
    return ybar + (meta * (base - pbar)).sum(1), meta


#: Rows before a row that make a stack.
SHORT = 120


def stacked(features: DataFrame, x: Sequence[str] = FEATURES, window: int = 252, k: int = 5, min_train: int = 252, ridge_alpha: float = 5.0, lasso_alpha: float = 0.0005, meta_alpha: float = 1.0, bound: float = 0.004, least: float = 0.0005, s: Series = S, only_rebalance: bool = True) -> DataFrame:
    """(key, order, mu, meta_ridge, meta_lasso, raw): a meta-ridge on out-of-fold predictions of the last ``window`` rows blends a ridge and a lasso refit on all rows before.

    Features are taken about the first row's, so sums don't cancel; fold sums are differences of running sums at fixed lags. With ``min_train`` below ``window``,
    rows with fewer rows before them than ``window`` use what there is; ``SHORT`` rows are the least that makes a stack.
    """
    d, test = len(x), window // (k + 1)
    lags = [window - (window - k * test), *[(k - 1 - j) * test for j in range(k)]]  # of the first test row, and of each fold's end
    rows = features.withColumn("_y", forward("ret", 1, s)).withColumn("_i", F.row_number().over(s.all()) - 1)
    first = s.rows(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_z{j}": F.col(c) - F.first(c).over(first) for j, c in enumerate(x)})
    before = s.rows(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_p", F.array(*[F.coalesce(F.sum(v).over(before), F.lit(0.0)) for v in _sums(x)]))
    rows = rows.withColumns({f"_p{j}": F.lag("_p", lag).over(s.all()) for j, lag in enumerate([window, *lags]) if lag})
    names = [f"_p{j}" if lag else "_p" for j, lag in enumerate([window, *lags])]
    ends = [n for n in names if n != "_p"]
    at = F.array(*[F.col(f"_z{j}") for j in range(d)]).alias("_x")
    wanted = F.col("_y").isNotNull() & (is_rebalance_day(F.col(s.order)) if only_rebalance else F.lit(True))
    full = rows.filter((F.col("_i") >= max(min_train, window)) & wanted).select(s.key, s.order, "_p", *ends, at)
    if min_train < window:
        # The first rows of a series: their folds' ends lie at lags of their own, so they look into the list of running sums, ``window`` at most.
        early = rows.filter(F.col("_i") < window).withColumn("_h", F.collect_list("_p").over(first)).filter((F.col("_i") >= max(min_train, SHORT)) & wanted)
        size = F.floor(F.col("_i") / (k + 1)).cast("int")
        picks = [F.lit(0), *[F.col("_i") - (k - j) * size for j in range(k)]]
        full = full.unionByName(early.select(s.key, s.order, "_p", *[F.element_at("_h", (i + 1).cast("int")).alias(n) for n, i in zip(ends, picks, strict=True)], at))
    rows = full

    def run(frames):
        for f in frames:
            out = f[[s.key, s.order]].copy()
            if len(f):
                ends = [_array(f[n]) for n in names]
                folds = np.stack([e - ends[0] for e in ends[1:]], 1)
                raw, meta = stack(folds, _array(f["_p"]), _array(f["_x"]), d, ridge_alpha, lasso_alpha, meta_alpha)
                out["raw"], out["meta_ridge"], out["meta_lasso"] = raw, meta[:, 0], meta[:, 1]
            else:
                out["raw"] = out["meta_ridge"] = out["meta_lasso"] = pd.Series(dtype=float)
            yield out

    kinds = dict(features.dtypes)
    out = rows.mapInPandas(run, f"{s.key} {kinds[s.key]}, {s.order} {kinds[s.order]}, raw double, meta_ridge double, meta_lasso double")
    return out.withColumn("mu", dead_zone(F.col("raw"), bound, least))


def out_of_fold(features: DataFrame, x: Sequence[str] = FEATURES, window: int = 252, k: int = 5, ridge_alpha: float = 5.0, lasso_alpha: float = 0.0005, s: Series = S) -> DataFrame:
    """(key, order, fold, y, p_ridge, p_lasso): out-of-fold predictions of the last ``window`` rows of each series.

    Moments by series and fold come from one aggregation; a fold's training rows are the folds before it.
    """
    d = len(x)
    rows = complete(features.withColumn("_y", forward("ret", 1, s)), [*x, "_y"])
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(s.key).orderBy(F.desc(s.order)))).filter(F.col("_r") <= window)
    rows = expanding_folds(rows, k, s).withColumn("fold", F.coalesce("fold", F.lit(-1)))
    centre = rows.groupBy(s.key).agg(*[F.avg(c).alias(f"_a{j}") for j, c in enumerate(x)])
    rows = rows.join(centre, s.key).withColumns({f"_z{j}": F.col(c) - F.col(f"_a{j}") for j, c in enumerate(x)})
    sums = rows.groupBy(s.key, "fold").agg(F.array(*[F.sum(v) for v in _sums(x)]).alias("_s"))
    one = sums.groupBy(s.key).agg(F.array_sort(F.collect_list(F.struct("fold", "_s"))).alias("_parts"))  # k + 1 parts at most
    kinds = dict(features.dtypes)

    def fit(frames):
        for f in frames:
            out = []
            for key, parts in zip(f[s.key], f["_parts"], strict=True):
                run_sum = np.zeros(len(parts[0]["_s"]))
                for p in parts:
                    if p["fold"] >= 0 and run_sum[0] > 1:
                        a, w = linear_models(_moments(run_sum[None], d), ridge_alpha, lasso_alpha)
                        out.append((key, p["fold"], a[0].tolist(), w[0].reshape(-1).tolist()))
                    run_sum = run_sum + np.array(p["_s"], float)
            yield pd.DataFrame(out, columns=[s.key, "fold", "_i0", "_w"])

    models = one.mapInPandas(fit, f"{s.key} {kinds[s.key]}, fold int, _i0 array<double>, _w array<double>")
    rows = rows.join(models, [s.key, "fold"])
    p = [F.col("_i0")[m] + sum((F.col("_w")[m * d + j] * F.col(f"_z{j}") for j in range(d)), F.lit(0.0)) for m in (0, 1)]
    return rows.select(s.key, s.order, "fold", F.col("_y").alias("y"), p[0].alias("p_ridge"), p[1].alias("p_lasso"))


def tree_out_of_fold(features: DataFrame, x: Sequence[str] = FEATURES, k: int = 5, window: int = 252, forest: dict | None = None, boosting: dict | None = None, seed: int = 0, s: Series = S) -> DataFrame:
    """(key, order, fold, y, p_forest, p_boost): forest and boosted trees fit for each fold on the pooled panel, with the series' number as a feature."""
    rows = complete(features.withColumn("_y", forward("ret", 1, s)), [*x, "_y"])
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(s.key).orderBy(F.desc(s.order)))).filter(F.col("_r") <= window)
    # Written: what is before is computed once, and the many passes of the fits read as few partitions as the rows fill.
    rows = written(expanding_folds(rows, k, s).select(s.key, s.order, "fold", "_y", *x))
    rows = _assembled(rows, x, s).transform(rows).select(s.key, s.order, "fold", F.col("_y").alias("y"), "_f").persist()
    rf, gb = _trees(forest, boosting, seed)
    out = None
    for i in range(k):
        train = rows.filter(F.coalesce("fold", F.lit(-1)) < i)
        got = gb.fit(train).transform(rf.fit(train).transform(rows.filter(F.col("fold") == i))).drop("_f")
        out = got if out is None else out.unionByName(got)
    out = checkpointed(out)
    rows.unpersist()
    return out


def _assembled(rows: DataFrame, x: Sequence[str], s: Series) -> PipelineModel:
    """Features and the series' number, by the order of the names, as one vector ``_f``."""
    number = StringIndexer(inputCol=s.key, outputCol="_key", stringOrderType="alphabetAsc", handleInvalid="keep")
    return Pipeline(stages=[number, VectorAssembler(inputCols=[*x, "_key"], outputCol="_f")]).fit(rows)


def _trees(forest: dict | None, boosting: dict | None, seed: int):
    rf = RandomForestRegressor(featuresCol="_f", labelCol="y", predictionCol="p_forest", seed=seed, **({"maxDepth": 4, "numTrees": 150} | (forest or {})))
    gb = GBTRegressor(featuresCol="_f", labelCol="y", predictionCol="p_boost", seed=seed, **({"maxDepth": 2, "maxIter": 200, "stepSize": 0.05} | (boosting or {})))
    return rf, gb


BASES = ["p_ridge", "p_lasso", "p_forest", "p_boost"]


def stacked_with_trees(features: DataFrame, x: Sequence[str] = FEATURES, window: int = 252, k: int = 5, ridge_alpha: float = 5.0, lasso_alpha: float = 0.0005, meta_alpha: float = 1.0, bound: float = 0.004, least: float = 0.0005, forest: dict | None = None, boosting: dict | None = None, seed: int = 0, s: Series = S) -> DataFrame:
    """(key, mu, raw, n, the four base forecasts): a forecast for the last row of each series.

    A meta-ridge by series on the out-of-fold predictions of ridge, lasso, forest and boosted trees blends their forecasts after a refit: the linear ones on the series' own rows,
    the trees on the pooled panel.
    """
    features = written(features)  # all that follows reads it, and would compute it anew each time
    linear_ = out_of_fold(features, x, window, k, ridge_alpha, lasso_alpha, s)
    both = linear_.join(tree_out_of_fold(features, x, k, window, forest, boosting, seed, s).drop("y", "fold"), [s.key, s.order])
    d, m = len(x), len(BASES)
    cross = [F.covar_pop(a, b) for i, a in enumerate(BASES) for b in BASES[i:]]
    metas = both.groupBy(s.key).agg(F.count("*").alias("_n"), F.array(*[F.avg(b) for b in BASES]).alias("_pm"), F.avg("y").alias("_ym"), F.array(*cross).alias("_pc"), F.array(*[F.covar_pop(b, "y") for b in BASES]).alias("_py"))
    rows = written(complete(features.withColumn("_y", forward("ret", 1, s)), x))
    known = rows.filter(F.col("_y").isNotNull())
    assembled = _assembled(rows, x, s)
    train = assembled.transform(known).select("_f", F.col("_y").alias("y")).persist()
    rf, gb = _trees(forest, boosting, seed)
    now = rows.withColumn("_r", F.row_number().over(Window.partitionBy(s.key).orderBy(F.desc(s.order)))).filter(F.col("_r") == 1)
    now = gb.fit(train).transform(rf.fit(train).transform(assembled.transform(now))).select(s.key, F.array(*[F.col(c).cast("double") for c in x]).alias("_x"), "p_forest", "p_boost")
    train.unpersist()
    centre = known.groupBy(s.key).agg(*[F.avg(c).alias(f"_a{j}") for j, c in enumerate(x)])
    shifted = known.join(centre, s.key).withColumns({f"_z{j}": F.col(c) - F.col(f"_a{j}") for j, c in enumerate(x)})
    sums = shifted.groupBy(s.key).agg(F.array(*[F.sum(v) for v in _sums(x)]).alias("_s"), F.array(*[F.first(f"_a{j}") for j in range(d)]).alias("_a"))
    kinds = dict(features.dtypes)

    def blend(frames):
        for f in frames:
            if not len(f):
                continue
            at, trees = _array(f["_x"]) - _array(f["_a"]), f[["p_forest", "p_boost"]].to_numpy(float)
            a, w = linear_models(_moments(_array(f["_s"]), d), ridge_alpha, lasso_alpha)
            base = np.column_stack([a + (w * at[:, None, :]).sum(-1), trees])
            n = f["_n"].to_numpy(float)
            meta = np.linalg.solve(n[:, None, None] * square(_array(f["_pc"]), m) + meta_alpha * np.eye(m), (n[:, None] * _array(f["_py"]))[..., None])[..., 0]
            raw = f["_ym"].to_numpy(float) + (meta * (base - _array(f["_pm"]))).sum(1)
            yield pd.DataFrame({s.key: f[s.key], "raw": raw, "n": f["_n"], **{b: base[:, j] for j, b in enumerate(BASES)}})

    out = metas.join(now, s.key).join(sums, s.key).mapInPandas(blend, f"{s.key} {kinds[s.key]}, raw double, n long, " + ", ".join(f"{b} double" for b in BASES))
    return out.withColumn("mu", dead_zone(F.col("raw"), bound, least))


def stacked_trees(
    features: DataFrame,
    x: Sequence[str] = FEATURES,
    window: int = 252,
    k: int = 5,
    min_train: int = 252,
    ridge_alpha: float = 5.0,
    lasso_alpha: float = 0.0005,
    meta_alpha: float = 1.0,
    bound: float = 0.004,
    least: float = 0.0005,
    n_trees: int = 150,
    forest_depth: int = 4,
    rounds: int = 200,
    boost_depth: int = 2,
    rate: float = 0.05,
    bins: int = 32,
    quarter: int = 13,
    seed: int = 0,
    s: Series = S,
) -> DataFrame:
    """(key, order, raw, mu, the four base forecasts) on every rebalance day with ``min_train`` rows before it: ridge, lasso, forest and boosted trees of a series' own rows.

    For each day the bases are fitted on ``k`` expanding folds of the last ``window`` rows, a meta-ridge on their predictions of the folds, and the bases again on all rows before.
    A task takes one series and ``quarter`` rebalance days of it with all rows before them, and grows the trees of all its days and folds together. Bins are quantiles of the rows before
    the task's first day, so nothing looks ahead. Series shorter than ``SHORT`` rows give nothing.
    """
    d = len(x)
    rows = complete(features, x).withColumn("_y", forward("ret", 1, s))
    rows = rows.withColumn("_known", F.count("_y").over(s.rows(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_now", is_rebalance_day(F.col(s.order)) & (F.col("_known") >= max(min_train, SHORT)) & F.col("_y").isNotNull())
    days = F.sum(F.col("_now").cast("int"))
    rows = rows.withColumns({"_q": F.coalesce(days.over(s.rows(Window.unboundedPreceding, -1)), F.lit(0)), "_all": days.over(Window.partitionBy(s.key))}).filter(F.col("_q") < F.col("_all"))
    # A row is needed by the quarter of the first rebalance day from it on, and by all later ones.
    rows = rows.withColumn("_part", F.explode(F.sequence(F.floor(F.col("_q") / quarter), F.floor((F.col("_all") - 1) / quarter))))
    rows = rows.select(s.key, s.order, "_part", "_q", "_now", F.col("_y").cast("double").alias("_y"), *[F.col(c).cast("double").alias(f"_x{j}") for j, c in enumerate(x)])
    upper = [(a, b) for a in range(d) for b in range(a, d)]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(s.order, kind="stable")
        part = int(frame["_part"].iloc[0])
        now = np.flatnonzero((frame["_now"] & (frame["_q"] // quarter == part)).to_numpy(bool))
        a, y = frame[[f"_x{j}" for j in range(d)]].to_numpy(float), frame["_y"].to_numpy(float)
        known = np.flatnonzero(~np.isnan(y))
        before = np.searchsorted(known, now)
        # Known rows first, then the rows to forecast: fits are ranges of the former.
        xs, ys = np.vstack([a[known], a[now]]), np.concatenate([y[known], np.zeros(len(now))])
        train, test = [], []
        for i, h in enumerate(before.tolist()):
            w = min(window, h)
            step = w // (k + 1)
            first = h - k * step
            train += [(h - w, first + f * step) for f in range(k)] + [(0, h)]
            test += [(first + f * step, first + (f + 1) * step) for f in range(k)] + [(len(known) + i, len(known) + i + 1)]
        sets = Sets.of(train, test)
        edges = bin_edges(a[known[: before[0]]], bins)
        table = Table(binned(xs, edges), sets, bins)
        z = xs - xs[0]
        sums = np.column_stack([np.ones(len(z)), z, ys, *[z[:, i] * z[:, j] for i, j in upper], z * ys[:, None], ys * ys])
        sums = np.vstack([np.zeros(sums.shape[1]), sums.cumsum(0)])
        at, slopes = linear_models(_moments(sums[[b for _, b in train]] - sums[[a for a, _ in train]], d), ridge_alpha, lasso_alpha)
        f, r = sets.test_fit, sets.test_row
        base = np.column_stack([at[f] + (slopes[f] * z[r][:, None, :]).sum(-1), forest(table, ys, n_trees, forest_depth, seed), boosted(table, ys, rounds, boost_depth, rate)])
        out = []
        day, today = f // (k + 1), f % (k + 1) == k
        for i in range(len(now)):
            fold = (day == i) & ~today
            p, v, last = base[fold], ys[r[fold]], base[(day == i) & today][0]
            mean = p.mean(0)
            meta = np.linalg.solve((p - mean).T @ (p - mean) + meta_alpha * np.eye(len(BASES)), (p - mean).T @ (v - v.mean()))
            out.append((frame[s.key].iloc[0], frame[s.order].iloc[now[i]], float(v.mean() + meta @ (last - mean)), *last.tolist()))
        return pd.DataFrame(out, columns=[s.key, s.order, "raw", *BASES])

    kinds = dict(features.dtypes)
    spark = features.sparkSession
    # Small tables with much work each: more partitions than usual, so that later quarters, which have more rows before them, spread.
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    found = rows.repartition(n, s.key, "_part").groupBy(s.key, "_part").applyInPandas(run, f"{s.key} {kinds[s.key]}, {s.order} {kinds[s.order]}, raw double, " + ", ".join(f"{b} double" for b in BASES))
    return found.withColumn("mu", dead_zone(F.col("raw"), bound, least))


Model = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def custom_models(features: DataFrame, models: dict[str, Model], x: Sequence[str] = FEATURES, window: int = 252, least: int = 60, s: Series = S) -> DataFrame:
    """(key, order, model, mu) on rebalance days, of functions (X, y, X_new) -> predictions; one that fails predicts 0.

    Series stream through their partition in order, and the last ``window`` rows of one are carried along, so that each row is shuffled and read once. Rows without a target
    take their place in the window and are not fitted on.
    """
    kinds = dict(features.dtypes)
    # The window of ``forward`` brings a series together in order; nothing after it moves rows.
    rows = features.withColumn("_y", forward("ret", 1, s)).withColumn("_now", is_rebalance_day(F.col(s.order)))
    rows = rows.select(s.key, s.order, "_now", "_y", *[F.col(c).cast("double").alias(f"_x{j}") for j, c in enumerate(x)])

    def forecasts(past: np.ndarray, now: np.ndarray):
        past = past[~np.isnan(past[:, 0])]
        for name, model in models.items():
            mu = 0.0
            if len(past) >= least:
                try:
                    mu = float(model(past[:, 1:], past[:, 0], now[None, 1:])[0])
                except Exception:  # the caller's model: a failure is a forecast of 0
                    mu = 0.0
            yield name, mu if np.isfinite(mu) else 0.0

    def run(frames):
        last, tail = None, np.zeros((0, len(x) + 1))
        for f in frames:
            out = []
            for key, part in f.groupby(s.key, sort=False, dropna=False):
                ring = np.vstack([tail if key == last else tail[:0], part.iloc[:, 3:].to_numpy(float)])
                first = len(ring) - len(part)
                for k in np.flatnonzero(part["_now"].to_numpy(bool)):
                    now = first + k
                    out += [(key, part[s.order].iloc[k], name, mu) for name, mu in forecasts(ring[max(0, now - window) : now], ring[now])]
                last, tail = key, ring[max(0, len(ring) - window) :]
            yield pd.DataFrame(out, columns=[s.key, s.order, "model", "mu"])

    return rows.mapInPandas(run, f"{s.key} {kinds[s.key]}, {s.order} {kinds[s.order]}, model string, mu double")


def forecast_today(features: DataFrame, x: Sequence[str] = FEATURES, k: int = 3, ridge_alpha: float = 1.0, lasso_alpha: float = 0.001, meta_alpha: float = 5.0, least: int = 60, score_row: str = "last_labeled", s: Series = S) -> DataFrame:
    """(key, mu, n): one forecast for each series, a stack over its whole history; a ridge alone if it is shorter than ``least``.

    ``score_row``: the last row that has a target, or the ``latest`` one.
    """
    d = len(x)
    rows = complete(features.withColumn("_y", forward("ret", 1, s)), x)
    centre = rows.groupBy(s.key).agg(*[F.avg(c).alias(f"_a{j}") for j, c in enumerate(x)])
    rows = rows.join(centre, s.key).withColumns({f"_z{j}": F.col(c) - F.col(f"_a{j}") for j, c in enumerate(x)})
    known = rows.filter(F.col("_y").isNotNull())
    folded = expanding_folds(known, k, s).withColumn("fold", F.coalesce("fold", F.lit(-1)))
    sums = folded.groupBy(s.key, "fold").agg(F.array(*[F.sum(v) for v in _sums(x)]).alias("_s"))
    parts = sums.groupBy(s.key).agg(F.array_sort(F.collect_list(F.struct("fold", "_s"))).alias("_parts"))
    scored = known if score_row == "last_labeled" else rows
    now = scored.groupBy(s.key).agg(F.max_by(F.array(*[F.col(f"_z{j}") for j in range(d)]), s.order).alias("_x"))
    kinds = dict(features.dtypes)

    def run(frames):
        for f in frames:
            out = []
            for key, parts, at in zip(f[s.key], f["_parts"], f["_x"], strict=True):
                ends = np.cumsum([np.array(p["_s"], float) for p in parts], 0)
                n = int(ends[-1][0])
                at = np.array([at], float)
                if n < least or len(parts) < k + 1:
                    a, w = linear_models(_moments(ends[-1:], d), ridge_alpha, lasso_alpha)
                    mu = float(a[0, 0] + w[0, 0] @ at[0])
                else:
                    mu = float(stack(ends[None], ends[-1:], at, d, ridge_alpha, lasso_alpha, meta_alpha)[0][0])
                out.append((key, mu, n))
            yield pd.DataFrame(out, columns=[s.key, "mu", "n"])

    return parts.join(now, s.key).mapInPandas(run, f"{s.key} {kinds[s.key]}, mu double, n long")
