"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: bytes.translate table that lower-cases A-Z and nothing else.
LOWER_TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share.

    On one machine, as in tests, a temporary folder takes the place of a missing setting; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/panelworks-{spark.sparkContext.applicationId}"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: Where ``recorded`` puts down what is sent to all tasks and written to the shared folder.
_record: ContextVar[list | None] = ContextVar("record", default=None)


@contextmanager
def recorded(into: list):
    """Within it, ``into`` gets the broadcast variables that operators send and the folders that they store tables in, for ``take_back``."""
    token = _record.set(into)
    try:
        yield
    finally:
        _record.reset(token)


def take_back(spark: SparkSession, record: list) -> None:
    """Destroys the broadcast variables and deletes the folders of a record. Frames that read them can't be used any more, so their results must stand in tables of their own."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while record:
        x = record.pop()
        if isinstance(x, Broadcast):
            x.destroy()
        else:
            place = jvm.org.apache.hadoop.fs.Path(x)
            place.getFileSystem(conf).delete(place, True)


def send(spark: SparkSession, value) -> Broadcast:
    """A broadcast variable, put down in the record if there is one."""
    shared = spark.sparkContext.broadcast(value)
    if (record := _record.get()) is not None:
        record.append(shared)
    return shared


def stored(df: DataFrame, **options: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: it cuts the lineage and survives lost executors."""
    path = shared_dir(df.sparkSession)
    if (record := _record.get()) is not None:
        record.append(path)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Give memory that isn't needed any more back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        pass


def released(run):
    """``run`` over Arrow batches; when it ends, its worker, which Spark uses again, gives memory back."""

    def call(batches):
        yield from run(batches)
        release()

    return call


def remainder(col: Column | str, n: int) -> Column:
    """crc32 of the value as text, modulo ``n`` (NULL for NULL)."""
    col = F.col(col) if isinstance(col, str) else col
    return F.crc32(col.cast("string").cast("binary")) % n


def held_out(col: str, n: int, rest: int) -> Column:
    return F.coalesce(remainder(col, n) == rest, F.lit(False))


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z only. All-ASCII values take the quick way; it gives the same."""
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def bottom_k(df: DataFrame, k: int, *keys: str) -> DataFrame:
    """At most ``k`` rows, those with the smallest hash of ``keys``; of rows with equal keys one. The sample is the same in each run."""
    name = fresh("h", df)
    df = df.withColumn(name, F.xxhash64(*keys))
    top = df.select(name).distinct().orderBy(name).limit(k).agg(F.max(name)).first()[0]
    return df.filter(F.col(name) <= F.lit(top)).dropDuplicates([name]).drop(name) if top is not None else df.limit(0).drop(name)


def fresh(name: str, *tables: DataFrame) -> str:
    """A column name that no table has, whatever the case of its letters."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name
