"""Queries against their SQL on tables whose sizes part the two, where small ones do not."""

import datetime as dt

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry


def both(spark, folder, name, **tables):
    """Sorted rows of the query and of its SQL."""
    con = duckdb.connect()
    for t, rows in tables.items():
        pq.write_table(rows, folder / f"{t}.parquet")
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, str(folder)).select(*want.columns)
    return sorted(map(tuple, got.collect())), sorted(want.fetchall())


def test_time_split_counts_the_share_as_written(spark, tmp_path):
    lengths = [1, 7, 90, 170, 180, 350, 710]  # 0.7 of most of these is a whole number that a double misses
    users = np.repeat(np.arange(len(lengths)), lengths)
    n = len(users)
    events = pa.table({"event_id": np.arange(n), "user_id": users, "ts": pa.array([dt.datetime(2024, 1, 1)] * n, pa.timestamp("us")), "value": np.ones(n)})
    got, want = both(spark, tmp_path, "d1_time_split", events=events)
    assert got == want and ("2", 63, 27) in got


def test_kmeans_takes_the_steps_of_its_sql(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = np.sort(rng.random((1500, 1)), 0).astype(np.float32)
    label = np.minimum(np.arange(1500) // 4, 9).astype(np.int32)  # all first centres at one end: a long way
    centres, moved = np.array([x[label == k][0] for k in range(10)], float), 0
    for _ in range(61):
        near = ((x[:, None].astype(float) - centres) ** 2).sum(-1).argmin(1)
        new = np.array([x[near == k].astype(float).mean(0) for k in range(10)])
        moved, centres = np.abs(new - centres).max(), new
    assert moved > 1e-4
    rows = pa.table({"vec_id": np.arange(1500), "embedding": pa.array(x.tolist(), pa.list_(pa.float32())), "label": label})
    got, want = both(spark, tmp_path, "m10_kmeans", embeddings=rows)
    assert [r[:2] for r in got] == [r[:2] for r in want] and [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=2e-5)
