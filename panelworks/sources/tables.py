"""Reading bars and features, writing features, risk tables and daily logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.functions.panel import DAILY, FEATURES, FeatureSpec, features

BARS = "asset string, dt date, close double"


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_bars(spark: SparkSession, path: str, assets: Sequence[str] | None = None, start: str | None = None, end: str | None = None, kind: str = "parquet") -> DataFrame:
    """(asset, dt, close) of a universe and a range of dates; both filters reach the files."""
    reader = spark.read.schema(BARS)
    df = reader.option("header", True).csv(path) if kind == "csv" else reader.parquet(path)
    if assets is not None:
        df = df.filter(F.col("asset").isin(list(assets)))
    if start is not None:
        df = df.filter(F.col("dt") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col("dt") <= F.lit(end).cast("date"))
    return df


def lookback(run_date: str, n_days: int) -> tuple[str, str]:
    """The calendar range that holds about ``n_days`` trading days before a run date."""
    from datetime import date, timedelta

    end = date.fromisoformat(run_date)
    return (end - timedelta(days=int(n_days * 1.7))).isoformat(), run_date


def load_or_build_features(spark: SparkSession, path: str, panel: DataFrame, spec: FeatureSpec = DAILY, required: Sequence[str] = ("asset", "dt", "ret", *FEATURES)) -> DataFrame:
    """The feature table at ``path`` if it is there and has the columns; else built from ``panel``."""
    from pyspark.errors import AnalysisException

    try:
        df = spark.read.parquet(path)
    except AnalysisException:
        return features(panel, spec)
    return df if set(required) <= set(df.columns) else features(panel, spec)


def write_features(df: DataFrame, path: str, kind: str = "parquet", by: str = "asset") -> None:
    if kind == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        df.repartition(by).write.mode("overwrite").partitionBy(by).parquet(path)


def write_layout(df: DataFrame, name: str, path: str, buckets: int = 8, by: str = "asset", dt: str = "dt") -> None:
    """Table ``name`` at ``path``: bucketed by asset, sorted by date within a file, in folders of years.

    Windows and joins by asset read it without an exchange, as each bucket has whole assets; a range of dates reads its years alone.
    """
    rows = df.withColumn("year", F.year(dt)).repartition(buckets, by)
    rows.write.mode("overwrite").option("path", path).partitionBy("year").bucketBy(buckets, by).sortBy(by, dt).saveAsTable(name)


def read_layout(spark: SparkSession, name: str, start: str | None = None, end: str | None = None, dt: str = "dt") -> DataFrame:
    """Rows of ``write_layout``'s table in a range of dates."""
    df = spark.table(name)
    for day, op in ((start, "__ge__"), (end, "__le__")):
        if day is not None:
            day = F.lit(day).cast("date")
            df = df.filter(getattr(F.col("year"), op)(F.year(day)) & getattr(F.col(dt), op)(day))
    return df.drop("year")


def wide(long: DataFrame, assets: Sequence[str], value: str, keys: Sequence[str] = ("book_id", "dt")) -> DataFrame:
    """One column for each asset, missing ones 0. The assets are given, so the pivot needs no pass to find them."""
    return long.groupBy(*keys).pivot("asset", list(assets)).agg(F.sum(value)).fillna(0.0)


def write_risk_tables(folder: str, equity: DataFrame, risk: DataFrame, pnl: DataFrame, exposure: DataFrame, assets: Sequence[str]) -> None:
    tables = {"equity": equity, "risk_timeseries": risk, "pnl_by_asset": wide(pnl, assets, "pnl"), "exposures": wide(exposure, assets, "notional")}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_daily(df: DataFrame, path: str, dt: str = "dt") -> None:
    """Day by day: a run that is repeated replaces its own days alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(dt).parquet(path)


def append_once(df: DataFrame, path: str, key: str = "dt") -> None:
    """Append the rows whose key isn't there yet."""
    from pyspark.errors import AnalysisException

    spark = df.sparkSession
    try:
        df = df.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    except AnalysisException:
        pass  # the first run
    df.write.mode("append").parquet(path)
