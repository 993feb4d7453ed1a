"""Line dedup: which lines of a corpus to keep, as compressed bitmaps by document.

A line's key is the line without white space at both ends, A-Z lower-cased. Each line of a document gives one row of hashes and a
position. The hashes of the keys are range-partitioned and
sorted within partitions by document and position, so that the rows of a key stand in order of occurrence. A key that may have more rows
than a task should hold at once, ``group_rows``, is dealt over as many parts as it needs, by document, and its parts are summed.

``keep="first"`` keeps the first occurrence of a key that is found in ``min_docs`` documents or more;
``keep="none"`` keeps no occurrence of it. With ``long_docs``, lines of ``LONG_WORDS`` words or ``LONG_CHARS`` code points are
measured by that number of documents instead.

Defined results: a NULL text is one empty line; keys shorter than ``min_chars`` code points stay; a repeated row
(same id and text) counts as one document and gets the same bitmap; lines of one id in several rows with other texts
count as one document; rows with NULL id have no document to count and stay whole; very long texts are split whole. Other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelworks.llm.common import fresh, lower_ascii, stored

SPACE = " \t\n\x0b\f\r"
#: A key is long from this many words on, or (scripts without blanks) this many code points.
LONG_WORDS, LONG_CHARS = 10, 50


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACE)))


def is_long(key: Column) -> Column:
    return (F.length(key) >= LONG_CHARS) | (F.size(F.split(key, f"[{SPACE}]+")) >= LONG_WORDS)


def _rows(docs: DataFrame, min_chars: int, long: bool) -> DataFrame:
    """One row for each line of ``docs`` with a key: document, hash of its text, position, two hashes of the key; whether the key is long, if asked."""
    key = line_key(F.col("line"))
    lines = (
        docs.filter("doc_id is not null")
        .select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
        .select("doc_id", "text_hash", "pos", key.alias("key"))
        .filter(F.length("key") >= min_chars)
        .select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), *([is_long(F.col("key")).alias("long")] if long else []))
    )
    return lines


#: Buckets by which hot keys are found.
BUCKETS = 1 << 20


def _in_order(rows: DataFrame, *key: str) -> DataFrame:
    """``rows`` range-partitioned by key with a second sort by document and position; ``docs``: documents of the key, ``head``: whether it is the key's first row."""
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(n, *key).sortWithinPartitions(*key, "doc_id", "text_hash", "pos")
    part = Window.partitionBy(*key)
    ordered = part.orderBy("doc_id", "text_hash", "pos")
    new = F.coalesce(F.lag("doc_id").over(ordered) != F.col("doc_id"), F.lit(True)).cast("int")
    return dealt.withColumn("new", new).withColumn("docs", F.sum("new").over(part)).withColumn("head", F.row_number().over(ordered) == 1).drop("new")


def bitmaps(docs: DataFrame, min_docs: int = 2, min_chars: int = 1, keep: str = "first", long_docs: int | None = None, group_rows: int = 20_000) -> DataFrame:
    """(doc_id, text_hash, dropped): by word of 64 lines, the bits of the lines to drop. Words and documents without any are left out.

    A key is hot if its bucket of ``BUCKETS`` has ``group_rows`` rows more than four times the mean; it goes in parts of about ``group_rows`` rows.
    """
    if keep not in ("first", "none"):
        raise ValueError("keep is 'first' or 'none'")
    rows = stored(_rows(docs, min_chars, long_docs is not None))
    counts = rows.groupBy(F.pmod("h1", F.lit(BUCKETS)).alias("bucket")).agg(F.count("*").alias("n"))
    hot = stored(counts.filter(F.col("n") > 4 * rows.count() / BUCKETS + group_rows).select("bucket", F.ceil(F.col("n") / group_rows).alias("parts")))  # a quarter of the buckets at most
    names = ["doc_id", "text_hash", "pos", "h1", "h2", *(["long"] if long_docs is not None else [])]
    if hot.limit(1).count():
        tagged = rows.join(F.broadcast(hot), F.pmod("h1", F.lit(BUCKETS)) == F.col("bucket"), "left")
        cold = _in_order(tagged.filter("parts is null").select(*names), "h1", "h2").select(*names, "docs", "head")
        some = _in_order(tagged.filter("parts is not null").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")).select(*names, "part"), "h1", "h2", "part")
        # One row a part; its key's sums come back to the parts, so no join has a key with more rows than a part.
        firsts = some.filter("head").select("h1", "h2", "part", "docs", F.struct("doc_id", "text_hash", "pos").alias("f"))
        whole = firsts.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.min("f").alias("f"))
        parts = firsts.select("h1", "h2", "part").join(whole, ["h1", "h2"])
        some = some.drop("docs", "head").join(parts, ["h1", "h2", "part"]).withColumn("head", F.struct("doc_id", "text_hash", "pos") == F.col("f"))
        seen = cold.unionByName(some.select(*names, "docs", "head"))
    else:
        seen = _in_order(rows, "h1", "h2")
    drop = F.col("docs") >= (min_docs if long_docs is None else F.when(F.col("long"), long_docs).otherwise(min_docs))
    if keep == "first":
        drop = drop & ~F.col("head")
    bits = seen.filter(drop).groupBy("doc_id", "text_hash", F.shiftright("pos", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("bits"))
    return bits.groupBy("doc_id", "text_hash").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def kept_lines(text: Column, dropped: Column) -> Column:
    """The lines of ``text`` whose bit in ``dropped`` (or NULL) isn't set."""
    bit = lambda i: F.call_function("shiftright", F.element_at(dropped, F.shiftright(i, 6)), i.bitwiseAND(F.lit(63)))
    stays = lambda _, i: F.coalesce(bit(i), F.lit(0).cast("long")).bitwiseAND(F.lit(1)) == 0
    return F.when(dropped.isNull(), lines_of(text)).otherwise(F.filter(lines_of(text), stays))


def with_bitmaps(docs: DataFrame, maps: DataFrame, name: str = "dropped") -> DataFrame:
    """``docs`` with its rows' bitmaps as a column, in place of one of that name; every row stays, also one with a NULL id."""
    docs = docs.drop(name)
    id_, hash_ = fresh("map_id", docs), fresh("map_hash", docs)
    maps = maps.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.col("dropped").alias(name))
    return docs.join(maps, (F.col("doc_id") == F.col(id_)) & (F.xxhash64("text") == F.col(hash_)), "left").drop(id_, hash_)
