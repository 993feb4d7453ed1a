"""The daily run as a stream: new bar files in, the affected tail recomputed by the batch functions, results put down by day."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from panelworks.functions.panel import S, features
from panelworks.sources.tables import BARS, write_daily

#: Rows before a day that its features need: the longest window and one more for a return.
HALO = 64


def feature_tail(history: DataFrame, first_day, halo: int = HALO, make: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Features of the rows from ``first_day`` on, from those rows and the ``halo`` before them."""
    back = Window.partitionBy(S.key).orderBy(F.desc(S.order))
    old = history.filter(F.col("dt") < first_day).withColumn("_rn", F.row_number().over(back)).filter(F.col("_rn") <= halo).drop("_rn")
    rows = old.unionByName(history.filter(F.col("dt") >= first_day))
    return (make or default_features)(rows).filter(F.col("dt") >= first_day)


def default_features(bars: DataFrame) -> DataFrame:
    p = bars.select("asset", "dt", F.col("close").alias("price"))
    p = p.withColumn("ret", F.col("price") / F.lag("price").over(S.all()) - 1)
    return features(p.withColumn("mkt_ret", F.avg("ret").over(Window.partitionBy("dt"))))


def run_available(spark: SparkSession, source: str, store: str, sink: str, checkpoint: str, make: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Takes the bar files that are new since the last run: adds them to ``store`` by day, and writes the features of their days and later ones to ``sink``.

    Both writes replace whole days, so a batch that runs twice changes nothing.
    """

    def batch(new: DataFrame, _: int) -> None:
        days = new.agg(F.min("dt").alias("a")).first()["a"]
        if days is None:
            return
        write_daily(new.dropDuplicates(["asset", "dt"]), store)
        history = new.sparkSession.read.schema(BARS).parquet(store)
        write_daily(feature_tail(history, F.lit(days), make=make), sink)

    query = spark.readStream.schema(BARS).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
