"""Benchmark decontamination with a positional inverted index.

Training texts are indexed in shards, all their words: for each term of a shard the sorted positions where it stands. The index is
stored, one row for each shard. A test item is cut into windows of consecutive words. In each shard the windows of which it has all terms start at the
postings of their rarest term there; the lists of the next rarest terms, moved by their offset in the window, are
intersected with what is left, so most windows end at an empty list. What is left are exact phrases. With a
slack, the postings of the window's rarest terms need only be within that many words of their place: proximity.

Items are turned into term sequences by Spark, long ones in pieces that overlap by a window, and go out in blocks of bounded size,
eight bytes a word; the index is read once for each block.

Defined results: NULL and empty texts have no words and no matches; an item without words matches nothing; an item with fewer words
than a window is one window; very long texts are indexed whole, in one shard; repeated rows each get a result; equal items with other ids each match, rows that share an item's id count as
one item. Other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.llm.common import released, send, stored

#: bytes.translate table: A-Z lower-cased, digits, a-z and bytes above 127 kept, all else a blank.
TOKEN_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: A shard's number comes from the row of the written index, so equal shards stay apart.
INDEX = "row_ids array<long>, lengths array<int>, terms binary, ends binary, positions binary"
SPAN = "struct<item_id: string, start: int, end: int>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TOKEN_TABLE).split() if text else []


class TermIds(dict):
    """64-bit hash of a word; what it holds is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word) >> 1
        return h


def _shard(ids: list, words: list[np.ndarray]) -> dict:
    lengths = np.array([len(w) for w in words], np.int64)
    # A gap of one between texts keeps phrases from running over their ends.
    start = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    term = np.concatenate(words) if len(words) else np.zeros(0, np.int64)
    at = np.arange(len(term)) + np.repeat(np.arange(len(lengths)), lengths)
    order = np.argsort(term, kind="stable")
    terms, first = np.unique(term[order], return_index=True)
    ends = np.append(first[1:], len(term)).astype(np.int32) if len(terms) else np.zeros(0, np.int32)
    assert len(start) == 0 or start[-1] < 2**31
    return {"row_ids": ids, "lengths": lengths.tolist(), "terms": terms.astype(np.int64).tobytes(), "ends": ends.tobytes(), "positions": at[order].astype(np.int32).tobytes()}


def build_index(docs: DataFrame, shard_words: int = 500_000) -> DataFrame:
    """The stored index of ``docs`` (doc_id, text): a row for each shard of about ``shard_words`` words."""
    kinds = pa.schema([("row_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("terms", pa.binary()), ("ends", pa.binary()), ("positions", pa.binary())])

    def run(batches):
        known = TermIds()
        ids, words, size = [], [], 0

        def out():
            return pa.RecordBatch.from_pylist([_shard(ids, words)], kinds)

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                w = words_of(text.as_py())
                ids.append(i)
                words.append(np.fromiter(map(known.__getitem__, w), np.int64, len(w)))
                size += len(w) + 1
                if size >= shard_words:
                    yield out()
                    ids, words, size = [], [], 0
        if ids:
            yield out()

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(run), INDEX)
    return stored(found.withColumn("shard", F.monotonically_increasing_id()), compression="zstd")


@dataclass(frozen=True)
class Windows:
    """Windows of a block of items: their terms (padded with -1), lengths, and the items' numbers."""

    terms: np.ndarray
    sizes: np.ndarray
    item: np.ndarray
    names: list[str]


@dataclass(frozen=True)
class Sequences:
    """Term sequences of a block of items, one after another: eight bytes a word."""

    terms: np.ndarray
    starts: np.ndarray
    item: np.ndarray
    names: list[str]
    window: int

    def windows(self, known: np.ndarray, lot: int = 100_000):
        """Windows of which ``known``, the sorted terms of a shard, has every term, in lots of bounded size."""
        if not len(self.terms) or not len(known):
            return
        there = known[np.minimum(np.searchsorted(known, self.terms), len(known) - 1)] == self.terms
        missing = np.concatenate([[0], np.cumsum(~there)])
        ends = np.append(self.starts[1:], len(self.terms))
        size = np.minimum(self.window, ends - self.starts)  # of the windows of a sequence
        many = ends - self.starts - size + 1
        for x in range(0, len(many), lot):
            seq = np.repeat(np.arange(x, min(x + lot, len(many))), many[x : x + lot])
            at = self.starts[seq] + np.arange(len(seq)) - np.repeat(np.cumsum(many[x : x + lot]) - many[x : x + lot], many[x : x + lot])
            full = missing[at + size[seq]] == missing[at]
            seq, at = seq[full], at[full]
            for y in range(0, len(at), lot):
                s, a = seq[y : y + lot], at[y : y + lot]
                step = np.arange(self.window)
                rows = np.where(step < size[s, None], self.terms[np.minimum(a[:, None] + step, len(self.terms) - 1)], -1)
                yield Windows(rows, size[s], self.item[s], self.names)


def sequences(items: DataFrame, window: int, piece: int = 50_000) -> DataFrame:
    """(item_id, seq): the items' term sequences, in pieces of ``piece`` words that overlap, so that each window stands whole in one of them."""

    def run(batches):
        known = TermIds()
        for b in batches:
            names, seqs = [], []
            for name, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                w = words_of(text.as_py())
                h = np.fromiter(map(known.__getitem__, w), np.int64, len(w))
                for x in range(0, max(1, len(h) - window + 1) if len(h) else 0, piece):
                    names.append(name)
                    seqs.append(h[x : x + piece + window - 1].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(seqs, pa.binary())], ["item_id", "seq"])

    return stored(items.mapInArrow(released(run), "item_id string, seq binary").distinct())


def _block(pieces: DataFrame, window: int) -> Sequences:
    got = pieces.toArrow().to_pydict()
    names = sorted(set(got["item_id"]))
    number = {x: i for i, x in enumerate(names)}
    rows = sorted(zip(got["item_id"], got["seq"], strict=True))
    size = np.array([len(q) // 8 for _, q in rows], np.int64)
    return Sequences(np.frombuffer(b"".join(q for _, q in rows), np.int64), np.cumsum(size) - size, np.array([number[i] for i, _ in rows], np.int64), names, window)


def _near(positions: np.ndarray, lo: np.ndarray, hi: np.ndarray, want: np.ndarray, slack: int) -> np.ndarray:
    """Whether each list positions[lo:hi] has an entry within ``slack`` of ``want``. All lists are searched in step."""
    a, b, target = lo.copy(), hi.copy(), want - slack
    while (open_ := a < b).any():
        mid = (a + b) // 2
        less = open_ & (positions[np.minimum(mid, len(positions) - 1)] < target)
        a, b = np.where(less, mid + 1, a), np.where(open_ & ~less, mid, b)
    ok = a < hi
    return ok & (positions[np.minimum(a, len(positions) - 1)] <= want + slack)


def search(shard: dict, win: Windows, slack: int = 0, rarest: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(window, position) of all occurrences in a shard."""
    terms, ends, positions = (np.frombuffer(shard[k], t) for k, t in (("terms", np.int64), ("ends", np.int32), ("positions", np.int32)))
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(terms) or not len(win.terms):
        return none
    ends = ends.astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    i = np.minimum(np.searchsorted(terms, win.terms), len(terms) - 1)
    found, pad = terms[i] == win.terms, win.terms < 0
    length = np.where(pad, np.iinfo(np.int64).max, np.where(found, (ends - starts)[i], 0))
    live = np.flatnonzero(length.min(1) > 0)
    if not len(live):
        return none
    order = np.argsort(length[live], axis=1, kind="stable")  # rarest term first, padding last
    i, sizes = i[live], win.sizes[live]
    steps = order.shape[1] if rarest is None else min(rarest, order.shape[1])
    out_w, out_p = [], []
    count = np.take_along_axis(length[live], order[:, :1], 1)[:, 0]
    for lot in np.split(np.arange(len(live)), np.flatnonzero(np.diff(np.cumsum(count) // 2_000_000)) + 1):  # bounded memory
        w = np.repeat(lot, count[lot])
        off = order[w, 0]
        t = i[w, off]
        nth = np.arange(len(w)) - np.repeat(np.concatenate([[0], np.cumsum(count[lot])[:-1]]), count[lot])
        p = positions[starts[t] + nth].astype(np.int64) - off
        for k in range(1, steps):
            off = order[w, k]
            t = i[w, off]
            ok = (k >= sizes[w]) | _near(positions, starts[t], ends[t], p + off, slack)
            w, p = w[ok], p[ok]
            if not len(w):
                break
        out_w.append(live[w])
        out_p.append(p)
    return np.concatenate(out_w), np.concatenate(out_p)


def _spans(shard: dict, block: Sequences, slack: int, rarest: int | None) -> list[list[dict]]:
    """For each text of the shard its spans by item; touching ones of an item are one."""
    lengths = np.array(shard["lengths"], np.int64)
    start = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    out: list[list[dict]] = [[] for _ in lengths]
    found = []
    for win in block.windows(np.frombuffer(shard["terms"], np.int64)):
        w, p = search(shard, win, slack, rarest)
        found.append((p, win.sizes[w], win.item[w]))
    p, size, item = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    if len(p):
        row = np.searchsorted(start, np.maximum(p, 0), "right") - 1
        a = np.maximum(p - start[row], 0)
        b = np.minimum(p - start[row] + size, lengths[row])
        o = np.lexsort((b, a, item, row))
        row, item, a, b = row[o], item[o], a[o], b[o]
        last = None
        for r, k, x, y in zip(row.tolist(), item.tolist(), a.tolist(), b.tolist(), strict=True):
            if last and last[0] == (r, k) and x <= last[1]["end"]:
                last[1]["end"] = max(last[1]["end"], y)
            else:
                last = ((r, k), {"item_id": block.names[k], "start": x, "end": y})
                out[r].append(last[1])
    return out


def matches(docs: DataFrame, items: DataFrame, window: int = 10, slack: int = 0, rarest: int | None = None, block_chars: int = 20_000_000, shard_words: int = 500_000) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_words and the spans of words that windows of ``items`` (item_id, text) match.

    ``slack`` 0 gives exact phrases; more gives proximity, of the ``rarest`` terms of a window if set.
    Items go out in blocks of about ``block_chars`` characters, pieces of long items dealt by a hash of their terms, so what is collected and broadcast is bounded.
    """
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("item_id is not null and text is not null")
    pieces = sequences(items, window)
    blocks = max(1, -(-int(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    part = lambda k: _block(pieces.filter(F.pmod(F.xxhash64("seq", "item_id"), F.lit(blocks)) == k), window)
    index = build_index(docs, shard_words)
    kinds = pa.schema([("shard", pa.int64()), ("row", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))])

    def searched(block: Sequences) -> DataFrame:
        shared = send(spark, block)

        def run(batches):
            for b in batches:
                for k in range(b.num_rows):
                    s = {n: b.column(n)[k].as_py() for n in b.schema.names}
                    spans = _spans(s, shared.value, slack, rarest)
                    yield pa.RecordBatch.from_arrays([pa.array([s["shard"]] * len(spans), pa.int64()), pa.array(range(len(spans)), pa.int32()), pa.array(s["row_ids"], pa.int64()), pa.array(s["lengths"], pa.int64()), pa.array(spans, kinds.field("spans").type)], schema=kinds)

        return index.mapInArrow(released(run), f"shard long, row int, doc_id long, n_words long, spans array<{SPAN}>")

    out = searched(part(0))
    if blocks > 1:
        for k in range(1, blocks):
            out = out.unionByName(searched(part(k)))
        out = out.groupBy("shard", "row", "doc_id", "n_words").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return out.select("doc_id", "n_words", "spans")


def n_hit(spans):
    """Words that at least one span covers."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["upto"]))).alias("n"), F.greatest(acc["upto"], s["end"]).alias("upto"))
    return F.aggregate(ordered, zero, step, lambda acc: acc["n"])


def summary(found: DataFrame) -> DataFrame:
    """The digest of ``matches`` by row."""
    ids = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["item_id"])))
    return found.select(
        "doc_id",
        "n_words",
        n_hit(F.col("spans")).alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
