"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is its set of distinct k-word shingles. All sets are sorted by one order, rare shingles first. Two sets with
the wanted Jaccard similarity share at least L shingles among the first n - a + L of each, where a bounds their overlap from below; this
holds for each L. A document whose first shingles others hold too takes a larger L: a longer prefix, but a partner must share L
shingles of it before the pair is verified. L minimises the cost of reading lists and verifying candidates, estimated from the lists' lengths.

The order is by the number of sets that hold a shingle. Texts are read in lots; a lot sends its shingles, packed, to buckets by hash; a bucket counts the sets of each and answers
the lots with the counts of those that several sets hold; a lot then sorts its sets' shingles. A set of which fewer than a shingles are held by others has no partner and goes. Shingles so
common that their list would be too much for a task (by counts of all shingles under a hash of 20 bits) are not sent to be counted; they stand last in the order, by that count. A set
that a task has met is not sent again; copies that several tasks sent only make a count larger. Candidates are found by the first 48 bits of a shingle's hash, so that some pairs too
many are verified, and none too few.

Equal sets are one class from the start. Of the classes that share a prefix shingle the first is its leader; classes are verified
against their leaders first, where lists are long against some more leaders, and what is connected then needs no further pair. For all
other pairs of a list, in tiles of bounded size, what both prefixes share and what can follow bounds the overlap; so do
sketches of 512 bits, the parities of how many shingles fall into each, which bound the shingles that only one of two sets has. Those that the bounds leave are verified on
whole texts; so no link between components is lost, and a group of near copies gives pairs in proportion to its size, not to its square.

Defined results: texts that are NULL, empty or without words have an empty set and are linked with nothing; fewer words than k are
one shingle; very long texts are whole sets like others; rows with NULL id keep their own row with a NULL component; rows that share an id are one node. Ties in the order go by the
shingle's hash, ties between leaders by id. Other columns are never read.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelworks.llm.common import LOWER_TABLE, release, released, send, stored
from panelworks.llm.graph import components

BITS = 20
#: Bits of a shingle's hash by which candidates are found.
KEY_BITS = 48
#: Shingles that a bucket counts at once; where that makes more than ``MANY`` buckets, up to ``LARGE``, so that a lot's row for a bucket stays worth its while. Partitions of a shuffle at most.
BUCKET, MANY, LARGE, TASKS = 1_500_000, 4096, 32_000_000, 10_000
#: A shingle is common if its bucket of the 2**BITS has more rows than this, and than so many times the mean.
COMMON, TIMES = 2_000, 4
#: Bits of the parity sketch of a set.
ODD = 512
TILE = 2048
#: Rows that are verified against one leader in a task.
GROUP = 512
#: Lists longer than this get more leaders before their pairs are looked at: so many a round, on so many lists of a document.
LONG, LEADERS, LISTS, ROUNDS = 64, 8, 3, 1
#: Ids that are sent to all executors at most.
SENT_IDS = 200_000
#: Entries of lists that a tile expands at once.
STEP = 4_000_000


class WordIds(dict):
    """64-bit hash of a word; what it holds is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, k: int, ids: WordIds) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text; A-Z lower-cased, words split at white space."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER_TABLE).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))
    m = min(k, len(h))
    out = np.full(len(h) - m + 1, m * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    for j in range(m):
        out = (out ^ h[j : len(h) - m + 1 + j]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def batch_sets(texts: list[str | None], k: int, ids: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """The sets of some texts one after another, and where each ends; the same hashes as ``shingles``."""
    words = [t.encode("utf-8", "surrogatepass").translate(LOWER_TABLE).split() if t else [] for t in texts]
    size = np.array([len(w) for w in words], np.int64)
    h = np.fromiter(map(ids.__getitem__, chain.from_iterable(words)), np.uint64, int(size.sum()))
    n = np.where(size >= k, size - k + 1, 0)
    start = np.cumsum(size) - size
    at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
    out = np.full(len(at), k * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    for j in range(k):
        out = (out ^ h[at + j]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    ends = np.cumsum(n)
    for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True):
        out[a:b].sort()
    first = np.ones(len(out), bool)
    first[1:] = out[1:] != out[:-1]
    first[(ends - n)[n > 0]] = True
    total = np.concatenate([[0], np.cumsum(first)])[ends]
    out = out[first]
    short = np.flatnonzero((size > 0) & (size < k))
    if len(short):  # few words: one shingle, put in its place
        one = np.concatenate([shingles(texts[i], k, ids) for i in short.tolist()])
        out = np.insert(out, total[short], one)
        total = total + np.cumsum((size > 0) & (size < k))
    return out, total


def lots(batch: pa.RecordBatch, column: int, chars: int = 2_000_000):
    """(first row, texts) of parts of a batch of bounded size."""
    texts, size, start = [], 0, 0
    for i, t in enumerate(batch.column(column)):
        texts.append(t.as_py())
        size += len(texts[-1] or "")
        if size > chars:
            yield start, texts
            texts, size, start = [], 0, i + 1
    if texts:
        yield start, texts


def least_overlap(n, percent: int):
    """Of a set of n with any partner that is not larger."""
    return -(-percent * n // 100)


def least_overlap_as_smaller(n, percent: int):
    """Of a set of n with any partner that is not smaller."""
    return -(-2 * percent * n // (100 + percent))


def pack(a: np.ndarray) -> bytes:
    """Eight-byte numbers, bytes of a weight together, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a, np.int64).view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).reshape(-1).view(np.int64)


def _hashes(flat: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Rows of ``size`` numbers: a hash of each set."""
    raw, starts = flat.tobytes(), np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    digests = (hashlib.blake2b(raw[8 * x : 8 * z], digest_size=16).digest() for x, z in zip(starts.tolist(), ends.tolist(), strict=True))
    return np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)[:, :size].copy()


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """For each row: n, a 128-bit hash of its set and its parity sketch; and for each task, in rows with a ``part``, counts of all its shingles by the first bits of their hash."""
    kinds = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("odd", pa.list_(pa.int64())), ("part", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        ids, total = WordIds(), np.zeros(1 << BITS, np.int64)
        for b in batches:
            for row, texts in lots(b, 1):
                flat, ends = batch_sets(texts, k, ids)
                n = np.diff(ends, prepend=0)
                doc = np.repeat(np.arange(len(n)), n)
                total += np.bincount((flat >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
                odd = np.bincount(doc * ODD + (flat % np.uint64(ODD)).astype(np.int64), minlength=len(n) * ODD).astype(np.uint8) & 1
                odd = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * (ODD // 64), pa.int32()), pa.array(np.packbits(odd).view(np.int64)))
                both = _hashes(flat, ends, 2)
                none = [pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, len(n)), pa.array(n, pa.int64()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), odd, *none], schema=kinds)
        rows = total.reshape(PARTS, -1)
        yield pa.RecordBatch.from_pydict({c: [None] * PARTS for c in kinds.names[:5]} | {"part": list(range(PARTS)), "counts": [pack(r) for r in rows]}, kinds)

    return docs.mapInArrow(released(run), "doc_id long, n long, s1 long, s2 long, odd array<long>, part int, counts binary")


#: Rows in which counts of shingles are sent.
PARTS = 64


def _sketch(sets: DataFrame) -> np.ndarray:
    """Counts of all shingles by the first bits of their hash: an array of fixed size."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, c in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                c = unpack(c.as_py())
                sums[i] = sums[i] + c if i in sums else c
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([pack(s) for s in sums.values()], pa.binary())], ["part", "counts"])

    rows = sets.filter("part is not null").select("part", "counts").repartition("part").mapInArrow(add, "part int, counts binary").collect()  # PARTS rows of 128 KB at most
    out = np.zeros((PARTS, (1 << BITS) // PARTS), np.int64)
    for r in rows:
        out[r["part"]] += unpack(r["counts"])
    del rows
    release()
    return out.reshape(-1)


#: Kinds of packed rows of a lot: its sets (hash, size, number of shingles that are not common); shingles to be counted; common ones with counts of their bucket; counted ones.
OWN, OPEN, COMMON_ROW, COUNTED = 0, 1, 2, 3
_ROW = pa.schema([("bucket", pa.int32()), ("lot", pa.int64()), ("kind", pa.int32()), ("docs", pa.binary()), ("toks", pa.binary()), ("vals", pa.binary())])
ROW = "bucket int, lot long, kind int, docs binary, toks binary, vals binary"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*cols[:3], *([pack(x) for x in c] for c in cols[3:])], _ROW, strict=True)], schema=_ROW)


def _entries(docs: DataFrame, k: int, percent: int, most: int, counts: np.ndarray, buckets: int) -> DataFrame:
    """The packed rows of each lot of ``docs`` (doc_id, text). A set that the task has met before is left out."""
    top = max(COMMON, TIMES * int(counts.mean()))
    shared = send(docs.sparkSession, counts)
    # Lots grow with the number of buckets, so that what a lot sends to one stays worth a row.
    chars = int(min(128_000_000, max(2_000_000, 600 * buckets)))

    def run(batches):
        ids, seen, task, made = WordIds(), set(), TaskContext.get().partitionId(), 0
        for b in batches:
            if len(seen) > 1_000_000:
                seen.clear()
            for _, texts in lots(b, 0, chars):
                flat, ends = batch_sets(texts, k, ids)
                sid, n = _hashes(flat, ends, 1)[:, 0], np.diff(ends, prepend=0)
                new = np.zeros(len(n), bool)
                for i, x in enumerate(sid.tolist()):
                    if x not in seen and n[i]:
                        seen.add(x)
                        new[i] = True
                flat = flat[np.repeat(new, n)]
                sid, n = sid[new], n[new]
                if not len(n):
                    continue
                doc = np.repeat(np.arange(len(n)), n)
                rank = shared.value[(flat >> np.uint64(64 - BITS)).astype(np.int64)]
                key = (flat >> np.uint64(64 - KEY_BITS)).astype(np.int64)
                common = rank > top
                rare = np.bincount(doc, ~common, len(n)).astype(np.int64)
                # The same lot if the task runs again: by its place and by what it holds.
                lot = xxhash.xxh3_64_intdigest(sid.tobytes(), seed=(task << 24) + made) >> 1
                made += 1
                yield _packed([(lot % buckets, lot, OWN, sid, n, rare)])
                room = np.maximum(0, np.minimum(n, n - least_overlap(n, percent) + most) - rare)
                at = np.flatnonzero(common & (room[doc] > 0))
                if len(at):
                    at = at[np.lexsort((key[at], rank[at], doc[at]))]
                    d = doc[at]
                    at = at[np.arange(len(at)) - np.searchsorted(d, d) < room[d]]
                    yield _packed([(lot % buckets, lot, COMMON_ROW, doc[at], key[at], rank[at])])
                key, doc = key[~common], doc[~common]
                bucket = ((key >> (KEY_BITS - 32)) * buckets) >> 32  # a range of hashes, so their first bits are the bucket's
                order = np.argsort(bucket, kind="stable")  # within a bucket by set, then hash
                key, doc = key[order], doc[order]
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1)) if buckets < len(key) else None
                if cuts is None:
                    some, cuts = np.unique(bucket[order], return_index=True)
                    cuts = np.append(cuts, len(key))
                else:
                    some = np.arange(buckets)
                none = np.zeros(0, np.int64)
                rows = [(int(x), lot, OPEN, doc[y:z], key[y:z], none) for x, y, z in zip(some.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if z > y]
                for x in range(0, len(rows), 1000):
                    yield _packed(rows[x : x + 1000])

    return docs.select("text").mapInArrow(released(run), ROW)


def _counted(entries: DataFrame, buckets: int) -> DataFrame:
    """The rows of ``entries`` with, in place of shingles to be counted, those that several sets hold and their number. A task holds one bucket at a time."""

    def count(rows: list[dict]):
        tok = np.concatenate([unpack(r["toks"]) for r in rows])
        order = np.argsort(tok)
        first = np.flatnonzero(np.diff(tok[order], prepend=-1))
        size = np.diff(np.append(first, len(tok))).astype(np.int32)
        many = np.empty(len(tok), np.int32)
        many[order] = np.repeat(size, size)
        del order, first, size
        out, x = [], 0
        for r in rows:
            d = unpack(r["docs"])
            m, t = many[x : x + len(d)], tok[x : x + len(d)]
            x += len(d)
            if (use := m > 1).any():
                out.append((r["bucket"], r["lot"], COUNTED, d[use], t[use], m[use].astype(np.int64)))
        return _packed(out)

    def run(batches):
        now, held = None, []
        for b in batches:
            for r in b.to_pylist():
                if r["bucket"] != now:
                    if held:
                        yield count(held)
                    now, held = r["bucket"], []
                if r["kind"] == OPEN:
                    held.append(r)
                else:
                    yield pa.RecordBatch.from_pylist([r], _ROW)
        if held:
            yield count(held)

    return entries.repartitionById(min(buckets, TASKS), F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(released(run), ROW)


def choose_length(n: np.ndarray, a: np.ndarray, doc: np.ndarray, pos: np.ndarray, lists: np.ndarray, most: int) -> np.ndarray:
    """L of least estimated cost, of sets of n with overlaps of a or more whose shared shingles (of ``doc``) stand at ``pos`` in the order. Each other entry of the prefix's lists is
    read once; what is left for verification, on n shingles each, is at most an L-th of them."""
    costs = []
    for ell in range(1, most + 1):
        size = np.minimum(n, n - a + ell)
        read = np.bincount(doc, np.where(pos < size[doc], lists - 1, 0), len(n))
        costs.append(np.where(ell <= np.maximum(a, 1), size + read + 0.1 * n * read / ell, np.inf))
    return np.argmin(costs, axis=0) + 1


def _prefixes(counted: DataFrame, percent: int, most: int) -> DataFrame:
    """(s1, n, ell, toks): of each set that can have a partner, L and the shingles of its prefix that others hold. A task holds one lot at a time."""
    parts = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = pa.schema([("s1", pa.int64()), ("n", pa.int64()), ("ell", pa.int32()), ("toks", pa.list_(pa.int64()))])

    def lot_of(rows: list[dict]):
        sid, n, rare = next((unpack(r["docs"]), unpack(r["toks"]), unpack(r["vals"])) for r in rows if r["kind"] == OWN)
        got = [r for r in rows if r["kind"] != OWN]
        if not got:
            return None
        doc, tok, val = (np.concatenate([unpack(r[c]) for r in got]) for c in ("docs", "toks", "vals"))
        last = np.repeat([r["kind"] == COMMON_ROW for r in got], [len(unpack(r["docs"])) for r in got])
        a = np.maximum(1, least_overlap(n, percent))
        known = np.bincount(doc, ~last, len(n)).astype(np.int64)
        keep = (known + n - rare >= a)[doc]
        doc, tok, val, last = doc[keep], tok[keep], val[keep], last[keep]
        o = np.lexsort((tok, val, last, doc))
        doc, tok, val = doc[o], tok[o], val[o]
        pos = np.arange(len(doc)) - np.searchsorted(doc, doc) + (rare - known)[doc]
        ell = choose_length(n, a, doc, pos, val, most)
        use = pos < np.minimum(n, n - a + ell)[doc]
        doc, tok = doc[use], tok[use]
        some, cuts = np.unique(doc, return_index=True)
        lists = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(doc)), pa.int32()), pa.array(tok))
        return pa.RecordBatch.from_arrays([pa.array(sid[some]), pa.array(n[some]), pa.array(ell[some], pa.int32()), lists], schema=kinds)

    def run(batches):
        now, held = None, []
        for b in batches:
            for r in b.to_pylist():
                if r["lot"] != now:
                    if held and (out := lot_of(held)) is not None:
                        yield out
                    now, held = r["lot"], []
                held.append(r)
        if held and (out := lot_of(held)) is not None:
            yield out

    return counted.repartition(parts, "lot").sortWithinPartitions("lot").mapInArrow(released(run), "s1 long, n long, ell int, toks array<long>")


def _may_link(x: str, y: str, percent: int) -> Column:
    """Whether the sets of two rows can have the similarity, by size and by their sketches: where the parities of two sets' counts differ, the sets do, so the number
    of such places is at most the number of shingles that only one has."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    differ = F.lit(0)
    for j in range(ODD // 64):
        differ = differ + F.bit_count(F.col(f"{x}.odd")[j].bitwiseXOR(F.col(f"{y}.odd")[j]))
    return (F.least(nx, ny) * 100 >= F.greatest(nx, ny) * percent) & (differ <= F.floor((nx + ny) * (100 - percent) / (100 + percent)))


def _linked(pairs: DataFrame, reps: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) of ids whose texts have the similarity. ``b`` is what many pairs share: its text goes once to each group of ``GROUP`` rows or so."""
    x, y = reps.alias("x"), reps.alias("y")
    near = pairs.join(x, F.col("a") == F.col("x.v")).join(y, F.col("b") == F.col("y.v"))
    pairs = stored(near.filter(_may_link("x", "y", percent)).select("a", "b").distinct())
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = pairs.groupBy("b").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    ids = stored(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    # A list of ids of a checked size goes out to all, so that other texts are not shuffled; a longer one is joined by a shuffle.
    docs = docs.join(F.broadcast(ids) if ids.count() <= SENT_IDS else ids, "doc_id", "left_semi")
    rows = pairs.join(groups, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("groups")).cast("int").alias("part")).join(docs, F.col("a") == F.col("doc_id")).select("b", "part", "a", "text")
    heads = groups.join(docs, F.col("b") == F.col("doc_id")).select("b", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), F.lit(None).cast("long").alias("a"), "text")

    def run(batches):
        ids, key, leaders = WordIds(), None, []
        for batch in batches:
            for first, texts in lots(batch, 3):
                b, part, a = (batch.column(j).slice(first, len(texts)).to_pylist() for j in range(3))
                flat, ends = batch_sets(texts, k, ids)
                n = np.diff(ends, prepend=0)
                out: list[tuple] = []
                x = 0
                while x < len(b):
                    if (b[x], part[x]) != key:
                        key, leaders = (b[x], part[x]), []
                    z = x + 1
                    while z < len(b) and (b[z], part[z]) == key and (a[z] is None) == (a[x] is None):
                        z += 1
                    if a[x] is None:  # several if rows share the id
                        leaders += [flat[ends[j] - n[j] : ends[j]] for j in range(x, z) if n[j]]
                    else:
                        own, ok = flat[ends[x] - n[x] : ends[z - 1]], np.zeros(z - x, bool)
                        doc = np.repeat(np.arange(z - x), n[x:z])
                        for lead in leaders:
                            at = np.minimum(np.searchsorted(lead, own), len(lead) - 1)
                            both = np.bincount(doc, lead[at] == own, z - x).astype(np.int64)
                            ok |= (100 * both >= percent * (n[x:z] + len(lead) - both)) & (both > 0)
                        out += [(a[x + j], key[0]) for j in np.flatnonzero(ok).tolist()]
                    x = z
                yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], pa.int64()) for j in (0, 1)], ["a", "b"])

    both = rows.unionByName(heads).repartition(parts, "b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())
    return both.mapInArrow(released(run), "a long, b long").distinct()


def _mixed(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries of lists with more than one label, with ``minor``: another label than the list's first entry has."""
    tagged = rows.join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))
    lists = tagged.groupBy("tok").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(F.struct("v", "label")).alias("m")).filter("lo <> hi").select("tok", F.col("m.label").alias("major"))
    return tagged.join(lists, "tok").withColumn("minor", F.col("label") != F.col("major")).drop("major")


def _more_leaders(posts: DataFrame, labels: DataFrame, percent: int, seed: int) -> DataFrame:
    """Pairs (a > b) of entries of long lists of several labels with some of each list's entries, chosen by a hash."""
    rows = _mixed(posts.select("tok", "v", "n", "pos"), labels)
    by_hash = Window.partitionBy("tok").orderBy(F.xxhash64("v", F.lit(seed)), "v")
    leaders = rows.withColumn("_r", F.row_number().over(by_hash)).filter(F.col("_r") <= LEADERS).select("tok", F.col("v").alias("u"), F.col("n").alias("un"), F.col("label").alias("ul"))
    few = rows.withColumn("_r", F.row_number().over(Window.partitionBy("v").orderBy("pos"))).filter(F.col("_r") <= LISTS)
    near = F.least("n", "un") * 100 >= F.greatest("n", "un") * percent
    pairs = few.join(leaders, "tok").filter((F.col("label") != F.col("ul")) & (F.col("v") != F.col("u")) & near)
    return pairs.select(F.greatest("v", "u").alias("a"), F.least("v", "u").alias("b")).distinct()


def _need(n, m, percent: int) -> Column:
    return F.ceil((F.col(n) + F.col(m)) * percent / (100 + percent))


def _short_lists(rows: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a > b) that share enough of their prefixes in lists that are not long. A pair that also shares a long one is met there."""
    x, y = rows.filter("minor").alias("x"), rows.alias("y")
    near = _may_link("x", "y", percent)
    met = x.join(y, (F.col("x.tok") == F.col("y.tok")) & (F.col("x.label") != F.col("y.label")) & (~F.col("y.minor") | (F.col("x.v") < F.col("y.v"))) & near)
    rest = F.greatest(*[F.ceil(F.col(f"{s}.n") * percent / 100) - F.col(f"{s}.ell") for s in ("x", "y")])
    met = met.groupBy(F.greatest("x.v", "y.v").alias("a"), F.least("x.v", "y.v").alias("b")).agg(F.count("*").alias("shared"), F.max(_need("x.n", "y.n", percent) - rest).alias("least"))
    return met.filter(F.col("shared") >= F.col("least")).select("a", "b")


def _tiles(rows: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a > b) of the lists in ``rows``; a list is cut into tiles, and each pair of tiles is a unit of work of bounded size."""
    parts = F.ceil(F.col("lists") / TILE).cast("int")
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("v"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = rows.select("tok", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "tile", "v", "n", "ell", "label", "minor", "prefix", "long", "odd")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pairs(tok: int, lo: int, hi: int, unit: list[dict]):
        n, label, ell, tile = (np.array([r[x] for r in unit], np.int64) for x in ("n", "label", "ell", "tile"))
        minor = np.array([r["minor"] for r in unit])
        odd = np.array([r["odd"] for r in unit], np.int64).view(np.uint64)
        size, rest = len(unit), np.maximum(0, least_overlap(n, percent) - ell)
        at = np.repeat(np.arange(size), [len(r["prefix"]) for r in unit])
        tokens, inv = np.unique(np.concatenate([np.array(r["prefix"], np.int64) for r in unit]), return_inverse=True)
        earlier = np.isin(tokens, np.unique(np.concatenate([np.array(r["long"], np.int64) for r in unit]))) & (tokens < tok)
        order = np.argsort(inv, kind="stable")
        members, starts = at[order], np.searchsorted(inv[order], np.arange(len(tokens) + 1))
        many = np.diff(starts)
        use = many[inv] > 1
        at, inv = at[use], inv[use]  # by row
        row = np.searchsorted(at, np.arange(size + 1))
        for x in range(0, size, 64):
            i = np.arange(x, min(x + 64, size))
            # What both prefixes share, and how much of it are other long lists before this one, counted over the lists of the rows' shingles.
            shared, before = np.zeros(len(i) * size, np.int64), np.zeros(len(i) * size, np.int64)
            rows, toks = at[row[x] : row[i[-1] + 1]] - x, inv[row[x] : row[i[-1] + 1]]
            lots = np.cumsum(many[toks]) // STEP
            for lot in np.split(np.arange(len(toks)), np.flatnonzero(np.diff(lots)) + 1) if len(toks) else []:
                t = toks[lot]
                each = np.arange(many[t].sum()) - np.repeat(np.cumsum(many[t]) - many[t], many[t])
                cell = np.repeat(rows[lot], many[t]) * size + members[np.repeat(starts[t], many[t]) + each]
                shared += np.bincount(cell, minlength=len(shared))
                before += np.bincount(cell[np.repeat(earlier[t], many[t])], minlength=len(before))
            shared, before = shared.reshape(-1, size), before.reshape(-1, size)
            need = -(-percent * (n[i, None] + n) // (100 + percent))
            ok = (i[:, None] < np.arange(size)) & (label[i, None] != label) & (minor[i, None] | minor) & (100 * np.minimum(n[i, None], n) >= percent * np.maximum(n[i, None], n))
            ok &= (shared + np.maximum(rest[i, None], rest) >= need) & (before == 0)  # each pair once: at the first of the long lists that it shares
            if lo != hi:
                ok &= tile[i, None] != tile
            a, b = np.nonzero(ok)
            for y in range(0, len(a), 20_000):
                p, q = i[a[y : y + 20_000]], b[y : y + 20_000]
                good = np.bitwise_count(odd[p] ^ odd[q]).sum(1, dtype=np.int64) <= (n[p] + n[q]) * (100 - percent) // (100 + percent)
                yield from ((max(unit[j]["v"], unit[k]["v"]), min(unit[j]["v"], unit[k]["v"])) for j, k in zip(p[good].tolist(), q[good].tolist(), strict=True))

    def run(batches):
        now, unit, out = None, [], []
        for batch in batches:
            for r in batch.to_pylist():
                if now != (key := (r["tok"], r["lo"], r["hi"])):
                    if len(unit) > 1:
                        out += pairs(*now, unit)
                    now, unit = key, []
                unit.append(r)
            yield pa.RecordBatch.from_arrays([pa.array([p[j] for p in out], pa.int64()) for j in (0, 1)], ["a", "b"])
            out = []
        if len(unit) > 1:
            out = list(pairs(*now, unit))
            yield pa.RecordBatch.from_arrays([pa.array([p[j] for p in out], pa.int64()) for j in (0, 1)], ["a", "b"])

    return rows.repartition(n, "tok", "lo", "hi").sortWithinPartitions("tok", "lo", "hi").mapInArrow(released(run), "a long, b long")


def classes(docs: DataFrame, k: int = 5, percent: int = 80, most: int = 6) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id (the smallest id that links reach).

    Two rows link when 100 * intersection >= ``percent`` * union of their shingle sets. ``most``: the largest L.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = stored(_sets(docs, k))
    sets, counts = made.filter("part is null").drop("part", "counts"), _sketch(made)
    full = sets.filter("n > 0 and doc_id is not null")
    reps = stored(full.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "n", "odd")).alias("r")).select("s1", "s2", F.col("r.doc_id").alias("v"), "r.n", "r.odd"))
    size = int(counts.sum())
    buckets = max(16, min(-(-size // BUCKET), max(MANY, -(-size // LARGE))))
    prefixes = stored(_prefixes(_counted(_entries(docs.filter("doc_id is not null"), k, percent, most, counts, buckets), buckets), percent, most))
    used = reps.select("s1", "v").join(prefixes.dropDuplicates(["s1"]), "s1").select("v", "n", "ell", "toks")
    rows = used.select("v", "n", "ell", F.posexplode("toks").alias("pos", "tok"))
    lists = rows.groupBy("tok").agg(F.count("*").alias("lists"), F.min(F.struct("v", "n")).alias("r")).filter("lists > 1").select("tok", "lists", F.col("r.v").alias("lead"), F.col("r.n").alias("lead_n"))
    posts = stored(rows.join(lists, "tok"))

    near = (F.least("n", "lead_n") * 100) >= (F.greatest("n", "lead_n") * percent)
    first = posts.filter((F.col("v") != F.col("lead")) & near).groupBy(F.col("v").alias("a"), F.col("lead").alias("b")).agg(F.count("*").alias("shared")).filter("shared >= 2").select("a", "b")
    first = stored(first)
    star = stored(_linked(first, reps, docs, k, percent))
    one = star.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("label"))
    up = one.select(F.col("v").alias("label"), F.col("label").alias("up"))
    labels = stored(one.join(up, "label", "left").select("v", F.coalesce("up", "label").alias("label")))
    done = first.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    for k_round in range(ROUNDS):
        pairs = _more_leaders(posts.filter(F.col("lists") > LONG), labels, percent, k_round)
        pairs = stored(pairs.join(done, ["a", "b"], "left_anti"))
        new = stored(_linked(pairs, reps, docs, k, percent))
        if not new.limit(1).count():
            break
        star, done = star.unionByName(new), done.unionByName(pairs)
        labels = components(star).select("v", F.col("c").alias("label"))

    sketches = reps.select("v", "odd")
    posts = posts.select("tok", "v", "n", "ell", "lists")
    short = _mixed(posts.filter(F.col("lists") <= LONG), labels)
    long = _mixed(posts.filter(F.col("lists") > LONG), labels)
    arrays = posts.groupBy("v").agg(F.collect_list("tok").alias("prefix"), F.collect_list(F.when(F.col("lists") > LONG, F.col("tok"))).alias("long"))
    met = _short_lists(short.join(sketches, "v"), percent).unionByName(_tiles(long.join(sketches, "v").join(arrays, "v"), percent)).distinct()
    late = stored(_linked(met.join(done, ["a", "b"], "left_anti"), reps, docs, k, percent))

    # The graph of labels: all links of both kinds with each end moved to its label.
    of = lambda x: labels.select(F.col("v").alias(x), F.col("label").alias(f"l{x}"))
    links = star.unionByName(late).unionByName(_shared_ids(full)).join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).filter("a <> b").distinct()
    comp = components(links)
    node = reps.select("s1", "s2", "v").join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))
    keyed = node.join(comp.select(F.col("v").alias("label"), "c"), "label", "left").select("s1", "s2", F.coalesce("c", "label").alias("c"))
    # Sets without a shingle are alone, and are not dealt by their one hash.
    found = sets.filter("n > 0").select("doc_id", "n", "s1", "s2").join(keyed, ["s1", "s2"], "left").unionByName(sets.filter("n = 0").select("doc_id", "n", "s1", "s2", F.lit(None).cast("long").alias("c")))
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")).alias("component_id"))


def _shared_ids(full: DataFrame) -> DataFrame:
    """Links between the classes of rows that share an id."""
    many = full.groupBy("doc_id").agg(F.countDistinct("s1", "s2").alias("n")).filter("n > 1").select("doc_id")
    rep = full.groupBy("s1", "s2").agg(F.min("doc_id").alias("v"))
    return full.join(many, "doc_id", "left_semi").join(rep, ["s1", "s2"]).filter("v <> doc_id").select(F.col("doc_id").alias("a"), F.col("v").alias("b")).distinct()
