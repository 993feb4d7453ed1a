"""Phrases that stand together more often than their parts would: counts of word windows, and their cohesion.

Each word opens one window of ``size`` words, the ``size - 1`` next as lead columns, padded where its piece of text ends. Windows are the only n-grams
that are counted: a shorter phrase occurs as often as windows begin with it, so Spark's ROLLUP over the columns gives all counts, and the count of all words.

A task counts its windows in lots and sends each lot's distinct ones, packed by bucket, to the tasks that own the buckets. A bucket knows all windows that begin with
a given pair of words; there windows too rare to be a phrase are padded, which leaves the counts of their beginnings as they are and few rows for the rollup. A first
word is spread over many buckets, so a very common one makes none large, and a common pair has at most one entry of each distinct window from each lot.

NULL texts are empty, NULL groups ``UND``; texts without words add nothing. Ties go as the functions say. An empty table gives no rows. Columns but text and group are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelworks.llm.common import LOWER_TABLE, released, stored

UND = "und"
#: Bytes of text whose windows are counted together, and bytes of text for each bucket.
LOT, BUCKET = 8_000_000, 8_000_000
#: Parts of a group that each give their best, so that no task ranks a whole group.
PARTS = 64

_ENDS, _BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: A-Z lower-cased, ends of pieces as line feeds, blanks as blanks.
TABLE = bytes(10 if b in _ENDS else 32 if b in _BLANKS else LOWER_TABLE[b] for b in range(256))
_END = b"\n"


# -- windows of a lot ---------------------------------------------------------------------------


def _sums(columns: Sequence[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the columns in ascending order, and the sums of their counts."""
    ids = columns[0].astype(np.int64)
    for c in columns[1:]:
        ids = np.unique(ids, return_inverse=True)[1] * (int(c.max(initial=0)) + 1) + c
    order = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.diff(ids[order], prepend=-1))
    return [c[order[first]] for c in columns], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def windows(texts: Sequence[bytes], size: int) -> tuple[pa.Array, list[np.ndarray], np.ndarray, int]:
    """Distinct windows of the texts: words, columns of codes into them, counts, and the code that pads."""
    data = _END.join([*texts, b""]).translate(TABLE).replace(_END, b" \n ")
    words = pc.split_pattern(pa.array([data], pa.large_binary()), b" ").flatten()
    coded = words.filter(pc.greater(pc.binary_length(words), 0)).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    pad = pc.index(coded.dictionary, pa.scalar(_END, pa.large_binary())).as_py()
    codes = np.append(codes, np.full(size - 1, pad, codes.dtype))
    at = np.flatnonzero(codes != pad)
    columns, alive = [codes[at]], np.ones(len(at), bool)
    for k in range(1, size):
        alive &= codes[at + k] != pad
        columns.append(np.where(alive, codes[at + k], pad))
    columns, counts = _sums(columns, np.ones(len(at), np.int64))
    return coded.dictionary, columns, counts, pad


def _planes(a: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones, ..: they pack better so."""
    a = a.astype("<u4")
    return a.view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplanes(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(-1).astype(np.int64)


def pack(words: pa.Array, columns: Sequence[np.ndarray], counts: np.ndarray) -> bytes:
    """Some windows with the words they use."""
    used, codes = np.unique(np.concatenate(columns), return_inverse=True)
    own = words.take(pa.array(used))
    text = b"".join(own.to_pylist())
    head = np.array([len(own), len(counts), len(columns)], "<u4").tobytes()
    lengths = pc.binary_length(own).to_numpy(zero_copy_only=False)
    return zstandard.ZstdCompressor(level=1).compress(head + _planes(lengths) + _planes(codes) + _planes(counts) + text)


def unpack(blob: bytes) -> tuple[pa.Array, list[np.ndarray], np.ndarray]:
    b = zstandard.ZstdDecompressor().decompress(blob)
    n, m, size = np.frombuffer(b[:12], "<u4").tolist()
    lengths, codes, counts = _unplanes(b[12 : 12 + 4 * n]), _unplanes(b[12 + 4 * n : 12 + 4 * n + 4 * m * size]), _unplanes(b[12 + 4 * (n + m * size) : 12 + 4 * (n + m * size + m)])
    text = b[12 + 4 * (n + m * size + m) :]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.append(0, np.cumsum(lengths)).tobytes()), pa.py_buffer(text)])
    return words, np.split(codes, size), counts


def lots(df: DataFrame, text: Column, group: Column, size: int, buckets: int) -> DataFrame:
    """(grp, bucket, blob): the windows of each lot of texts by bucket. The first word gives a range of about sqrt(buckets) buckets, the second the bucket in it."""
    spread = max(1, math.isqrt(buckets))

    def sent(grp: str, texts: list[bytes]):
        words, columns, counts, pad = windows(texts, size)
        if not len(counts):
            return
        hashes = pd.util.hash_array(np.array(words.to_pylist(), dtype=object), categorize=False)
        bucket = (hashes[columns[0]] % buckets + (hashes[columns[1]] >> np.uint64(32)) % spread) % buckets if size > 1 else hashes[columns[0]] % buckets
        names = words.to_pylist()
        names[pad] = b""
        words = pa.array(names, pa.large_binary())
        order = np.argsort(bucket, kind="stable")
        ends = np.flatnonzero(np.diff(bucket[order], append=buckets + 1)) + 1
        owner, blobs = [], []
        for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            rows = order[lo:hi]
            owner.append(int(bucket[rows[0]]))
            blobs.append(pack(words, [c[rows] for c in columns], counts[rows]))
        yield pa.RecordBatch.from_pydict({"grp": [grp] * len(owner), "bucket": owner, "blob": blobs}, schema=pa.schema([("grp", pa.string()), ("bucket", pa.int64()), ("blob", pa.binary())]))

    def run(batches):
        held: dict[str, list[bytes]] = {}
        total = 0
        for b in batches:
            for grp, value in zip(b.column("grp").to_pylist(), b.column("text"), strict=True):
                t = value.as_buffer()
                if t is None or not t.size:
                    continue
                held.setdefault(grp, []).append(t.to_pybytes())
                total += t.size
                if total >= LOT:
                    for g, texts in held.items():
                        yield from sent(g, texts)
                    held, total = {}, 0
        for g, texts in held.items():
            yield from sent(g, texts)

    rows = df.select(F.coalesce(group.cast("string"), F.lit(UND)).alias("grp"), text.cast("string").alias("text"))
    return rows.mapInArrow(released(run), "grp string, bucket long, blob binary")


def merged(blobs: Sequence[bytes], least: int) -> tuple[list[pa.Array], np.ndarray]:
    """Columns of words and counts of a bucket's windows. A window is padded from its first word on with which its beginning, of two words or more, is rarer than ``least``."""
    parts = [unpack(b) for b in blobs]
    coded = pa.concat_arrays([*[p[0] for p in parts], pa.array([b""], pa.large_binary())]).dictionary_encode()
    codes, shift, found = coded.indices.to_numpy(zero_copy_only=False), 0, []
    for words, columns, counts in parts:
        found.append(([codes[shift + c] for c in columns], counts))
        shift += len(words)
    size = len(found[0][0])
    columns, counts = _sums([np.concatenate([f[0][k] for f in found]) for k in range(size)], np.concatenate([f[1] for f in found]))
    pad = pc.index(coded.dictionary, pa.scalar(b"", pa.large_binary())).as_py()
    rare = np.zeros(len(counts), bool)
    new = np.zeros(len(counts), bool)
    new[:1] = True
    new[1:] |= columns[0][1:] != columns[0][:-1]
    for k in range(1, size):
        new[1:] |= columns[k][1:] != columns[k][:-1]
        of = np.cumsum(new) - 1
        rare |= (np.bincount(of, counts)[of] < least) if len(of) else rare
        columns[k] = np.where(rare, pad, columns[k])
    columns, counts = _sums(columns, counts)
    return [coded.dictionary.take(pa.array(c)) for c in columns], counts


def frequent(df: DataFrame, text: Column, group: Column, size: int = 3, least: int = 10, buckets: int | None = None) -> DataFrame:
    """(grp, k, phrase, f): phrases of k words that occur ``least`` times in their group; the row of k = 0 and an empty phrase has the number of all its words."""
    if buckets is None:
        total = df.agg(F.sum(F.octet_length(text.cast("string")))).first()[0] or 0
        buckets = max(1, -(-total // BUCKET))
    names = [f"w{k + 1}" for k in range(size)]
    schema = pa.schema([("grp", pa.string()), *[(c, pa.string()) for c in names], ("c", pa.int64())])

    def count(table: pa.Table) -> pa.Table:
        columns, counts = merged(table.column("blob").to_pylist(), least)
        grp = pa.array([table.column("grp")[0].as_py()] * len(counts), pa.string())
        return pa.Table.from_arrays([grp, *[c.cast(pa.binary()).cast(pa.string()) for c in columns], pa.array(counts)], schema=schema)

    counted = lots(df, text, group, size, buckets).groupBy("grp", "bucket").applyInArrow(count, ", ".join(["grp string", *[f"{c} string" for c in names], "c long"]))
    sums = counted.rollup("grp", *names).agg(F.sum("c").alias("f"), F.grouping_id().alias("gid"))
    # Of the levels, that of k words has the last size - k columns rolled up; in a padded one no phrase of k words ends.
    level = F.lit(None)
    for k in range(size + 1):
        level = F.when(F.col("gid") == 2 ** (size - k) - 1, F.lit(k)).otherwise(level)
    last = F.element_at(F.array(F.lit("x"), *names), (F.col("k") + 1).cast("int"))
    sums = sums.withColumn("k", level).filter("k is not null").filter((F.col("k") == 0) | ((F.col("f") >= least) & (last != "")))
    return stored(sums.select("grp", "k", F.concat_ws(" ", *names).alias("phrase"), "f"))


# -- cohesion -----------------------------------------------------------------------------------


def _part(first: Column | int, n: Column) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), first, n), " ")


def collocations(df: DataFrame, text: str = "text", group: str = "lang", size: int = 3, least: int = 10, inside: int = 50, top: int = 2000) -> DataFrame:
    """(grp, rank, phrase, a, l, r, n, score): each group's ``top`` phrases of 2 to ``size`` words that occur ``least`` times.

    A phrase's score is the lowest over its cuts in two of floor(1000000 a a / (l r)), a, l and r the counts of phrase and parts, exact in 38 digits; of equal
    cuts the first. A phrase within a longer one of ``size`` words at most that occurs ``inside`` percent as often goes. Equal scores are ordered by a, then by the phrase's bytes.
    """
    found = frequent(df, F.col(text), F.col(group), size, least)
    phrases = found.filter("k >= 2").select("grp", "phrase", "k", F.col("f").alias("a"))
    of = lambda name: found.filter("k >= 1").select("grp", F.col("phrase").alias(name), F.col("f").alias(f"f_{name}"))
    cuts = phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.withColumns({"head": _part(1, F.col("cut")), "tail": _part(F.col("cut") + 1, F.col("k") - F.col("cut"))})
    cuts = cuts.join(of("head"), ["grp", "head"]).join(of("tail"), ["grp", "tail"])
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    cuts = cuts.withColumns({"aa": (wide("a") * wide("a") * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)"), "lr": (wide("f_head") * wide("f_tail")).cast("decimal(38,0)")})
    best = cuts.withColumn("score", F.expr("aa div lr").cast("long")).groupBy("grp", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", F.col("f_head").alias("l"), F.col("f_tail").alias("r"))).alias("b"))

    longer = phrases.filter("k >= 3").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
    longer = longer.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("m") + 1)))
    longer = longer.select("grp", _part(F.col("at"), F.col("m")).alias("phrase"), "a").groupBy("grp", "phrase").agg(F.max("a").alias("longest"))
    kept = best.join(longer, ["grp", "phrase"], "left").filter(F.col("longest").isNull() | (100 * F.col("longest") < inside * F.col("a")))

    rows = kept.select("grp", "phrase", "a", "b.l", "b.r", "b.score").withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best_of_part = rows.withColumn("rank", F.row_number().over(Window.partitionBy("grp", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = best_of_part.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(found.filter("k = 0").select("grp", F.col("f").alias("n")), "grp").select("grp", "rank", "phrase", "a", "l", "r", "n", "score")
