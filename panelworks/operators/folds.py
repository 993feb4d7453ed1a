"""Folds down the days of many books: each day needs what the day before left.

Days stream through their partition in order of (book, day), so a task holds one book's state and one batch of days, never a history. A day's row of the result is
also the state after that day: a later run starts from the last one that was kept and reads new days alone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fold_days(days: DataFrame, fields: str, begin: Callable[[], dict], step: Callable[[dict, dict], dict], state: DataFrame | None = None) -> DataFrame:
    """(book_id, dt, fields..) of ``days`` (book_id, dt, ..), one row for each.

    ``step`` gets the state, a dict of ``fields``, and a day's row, and gives the next state. ``begin`` is the state of a book that has none in ``state``
    (book_id, dt, fields..), of which each book's last row counts; days up to it are left out, as they have been run.
    """
    names = [f.strip().split(" ")[0] for f in fields.split(", ")]
    kinds = dict(days.dtypes)
    own = [c for c in days.columns if c not in ("book_id", "dt")]
    rows = days.withColumn("_state", F.lit(None).cast("struct<" + ",".join(f.strip().replace(" ", ":", 1) for f in fields.split(", ")) + ">"))
    if state is not None:
        last = state.groupBy("book_id").agg(F.max_by(F.struct("dt", *names), "dt").alias("_s"))
        done = last.select("book_id", F.col("_s.dt").alias("_upto"))
        rows = rows.join(done, "book_id", "left").filter(F.col("_upto").isNull() | (F.col("dt") > F.col("_upto"))).drop("_upto")
        old = last.select("book_id", F.col("_s.dt").alias("dt"), *[F.lit(None).cast(kinds[c]).alias(c) for c in own], F.struct(*[F.col(f"_s.{n}").alias(n) for n in names]).alias("_state"))
        rows = rows.unionByName(old)

    def run(frames):
        book, now, n = None, None, 0
        for frame in frames:
            out = []
            for r in frame.to_dict("records"):
                if now is None or r["book_id"] != book:
                    book, now, n = r["book_id"], begin(), 0
                n += 1
                if r["_n"] != n:
                    raise ValueError("a book's days are not in one stream")
                if isinstance(r["_state"], dict):
                    now = {n: _plain(r["_state"][n]) for n in names}
                    continue
                now = step(now, r)
                out.append((book, r["dt"], *[now[n] for n in names]))
            yield pd.DataFrame(out, columns=["book_id", "dt", *names])

    # The window makes Spark bring a book's days together and sort them, whatever it does with the plan below; its number counts on the way that they came so.
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("book_id").orderBy("dt")))
    return rows.mapInPandas(run, f"book_id {kinds['book_id']}, dt {kinds['dt']}, {fields}")


def _plain(value):
    return value.tolist() if hasattr(value, "tolist") else value


def long(days: DataFrame, *values: str) -> DataFrame:
    """(book_id, dt, asset, values..) of rows whose arrays run side by side with ``assets``."""
    return days.select("book_id", "dt", F.explode(F.arrays_zip("assets", *values)).alias("_r")).select("book_id", "dt", F.col("_r.assets").alias("asset"), *[F.col(f"_r.{v}").alias(v) for v in values])


def vector(assets: Sequence[str], known_assets: Sequence[str], known: Sequence[float]) -> list[float]:
    """The known numbers in the order of ``assets``, 0 for others."""
    at = dict(zip(known_assets, known, strict=True))
    return [at.get(a, 0.0) for a in assets]
