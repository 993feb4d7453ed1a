"""Language-model scoring by context-tree weighting over bytes.

A text is its words, A-Z lower-cased, with one blank between them, and an end byte. Each byte is eight binary decisions;
each decision has a tree of contexts, the last 0 to ``depth`` bytes. A node's Krichevsky-Trofimov estimate depends only on its
counts of zeros and ones, so counts of (depth + 1)-byte grams from the whole corpus give all nodes, and the weighted probability of a node,
half its own estimate and half its children's, follows from the leaves up. A decision's probability mixes the estimates of all
depths with the weights that these leave.

Documents are dealt into blocks by a hash of their id. A block sends its distinct grams and words, with counts, to buckets
(grams by their last three context bytes, so a bucket holds whole subtrees); a bucket sums the counts of all blocks, computes the
probabilities of its grams, and answers each block with the values of what it holds. Nothing that grows with the corpus is
broadcast or sent to the driver: only the nodes of depths 0 to 2, by two bytes and a node of the symbol's tree at most 2**24 rows, for
UTF-8 text far fewer, go out to all. Blocks and buckets have their own partition each, up to ``TASKS``, then share them evenly; all streams are sorted, so that
a task keeps one bucket's or one block's table at a time.

Defined results: NULL and empty texts are the end alone; very long texts are scored whole; rows with NULL id are scored and learned from; repeated rows count
as often as they stand there and get equal scores; an empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.llm.common import LOWER_TABLE, released, send, stored

END = 0xFF  # in no UTF-8 text; also what stands before a text
END_KEY = 2**64 - 1
LN10 = float(np.log(10.0))
GRAM, WORD = 0, 1
#: Partitions of a shuffle at most. Context bytes by which grams are dealt.
TASKS, CUT = 10_000, 3
#: Bytes and texts that are read at once.
LOT_CHARS, LOT_TEXTS = 3_000_000, 60_000
PART = "block long, bucket int, kind int, keys binary, vals binary"


# -- packed arrays ------------------------------------------------------------------------------


def pack(a: np.ndarray) -> bytes:
    """Eight-byte numbers, bytes of a weight together, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(b: bytes, kind=np.uint64) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).reshape(-1).view(kind)


def pack_keys(sorted_keys: np.ndarray) -> bytes:
    return pack(np.diff(sorted_keys, prepend=np.uint64(0)))


def unpack_keys(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b), dtype=np.uint64)


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(parts) == 1:
        return parts[0]
    k, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    o = np.argsort(k, kind="stable")
    k, n = k[o], n[o]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(n, first) if len(k) else n


# -- texts --------------------------------------------------------------------------------------


class WordKeys(dict):
    """64-bit hash of a word; what it holds is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = min(xxhash.xxh3_64_intdigest(word), END_KEY - 1)
        return h


def read(texts: list[str | None], depth: int, ids: WordKeys) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gram keys and word keys of some texts one after another, with each text's number of both."""
    joined, words, n_words = [], [], []
    lead = bytes([END]) * depth
    for t in texts:
        w = t.encode("utf-8", "surrogatepass").translate(LOWER_TABLE).split() if t else []
        joined.append(lead + b" ".join(w) + bytes([END]))
        words += [ids[x] for x in w]
        words.append(END_KEY)
        n_words.append(len(w) + 1)
    n_bytes = np.array([len(x) - depth for x in joined], np.int64)
    a = np.frombuffer(b"".join(joined), np.uint8).astype(np.uint64)
    code = a.copy()
    for d in range(1, depth + 1):
        code[d:] |= a[:-d] << np.uint64(8 * (depth + 1 - d))
    keep = np.ones(len(a), bool)
    starts = np.cumsum(n_bytes + depth) - n_bytes - depth
    keep[(starts[:, None] + np.arange(depth)).reshape(-1)] = False
    return code[keep], n_bytes, np.array(words, np.uint64), np.array(n_words, np.int64)


def bucket_of(keys: np.ndarray, kind: int, depth: int, buckets: int) -> np.ndarray:
    top = keys >> np.uint64(8 * (depth + 1 - min(CUT, depth))) if kind == GRAM else keys
    top = (top + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return ((top >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


# -- the tree -----------------------------------------------------------------------------------

_SMALL = np.concatenate([[0.0], np.cumsum(np.log(np.arange(0, 4095) + 0.5))])  # log of gamma(n + 1/2) / gamma(1/2)
_FACT = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 4096)))])


def _stirling(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    half = lambda n: np.where(n < 4096, _SMALL[np.minimum(n, 4095)], _stirling(n + 0.5) - 0.5723649429247001)
    fact = lambda n: np.where(n < 4096, _FACT[np.minimum(n, 4095)], _stirling(n + 1.0))
    return half(a) + half(b) - fact(a + b)


def nodes_of(keys: np.ndarray, bit: int) -> np.ndarray:
    """The node of the symbol's binary tree that a gram passes at a bit: 1, 2-3, 4-7, ..."""
    return np.uint64(1 << bit) | ((keys & np.uint64(255)) >> np.uint64(8 - bit))


def subtree(keys: np.ndarray, counts: np.ndarray, depth: int, top: int, bit: int):
    """Levels of depths ``depth`` to ``top`` for one bit: (node keys, row or child -> node, zeros, ones, log weighted, own weight), deepest first."""
    node = nodes_of(keys, bit)
    one = ((keys >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
    at = (keys >> np.uint64(8) << np.uint64(8)) | node
    uniq, inv = np.unique(at, return_inverse=True)
    zeros = np.bincount(inv, np.where(one, 0, counts), len(uniq)).astype(np.int64)
    ones = np.bincount(inv, np.where(one, counts, 0), len(uniq)).astype(np.int64)
    weighted = log_kt(zeros, ones)
    out = [(uniq, inv, zeros, ones, weighted, np.ones(len(uniq)))]
    for d in range(depth - 1, top - 1, -1):
        shift = np.uint64(8 * (depth - d + 1))
        up = (uniq >> shift << shift) | (uniq & np.uint64(255))
        new, inv = np.unique(up, return_inverse=True)
        zeros = np.bincount(inv, zeros, len(new)).astype(np.int64)
        ones = np.bincount(inv, ones, len(new)).astype(np.int64)
        below = np.bincount(inv, weighted, len(new))
        own = log_kt(zeros, ones)
        weighted = np.logaddexp(own, below) - np.log(2.0)
        out.append((new, inv, zeros, ones, weighted, 1 / (1 + np.exp(np.clip(below - own, -700, 700)))))
        uniq = new
    return out


def kt(zeros, ones, one):
    return (np.where(one, ones, zeros) + 0.5) / (zeros + ones + 1.0)


def top_levels(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray, cut: int) -> list[tuple]:
    """(keys, zeros, ones, own weight) of depths ``cut`` - 1 to 0. ``keys``: context bytes and node of depth ``cut`` - 1, sorted; ``below``: the children's log weighted probability."""
    out = []
    for d in range(cut - 1, -1, -1):
        own = log_kt(zeros.astype(np.int64), ones.astype(np.int64))
        out.append((keys, zeros, ones, 1 / (1 + np.exp(np.clip(below - own, -700, 700)))))
        if d:
            weighted = np.logaddexp(own, below) - np.log(2.0)
            keys, inv = np.unique((keys >> np.uint64(16) << np.uint64(8)) | (keys & np.uint64(255)), return_inverse=True)
            zeros, ones, below = (np.bincount(inv, x, len(keys)) for x in (zeros, ones, weighted))
    return out


def log_probs(keys: np.ndarray, counts: np.ndarray, depth: int, top: list[tuple]) -> np.ndarray:
    """log10 probability of the last byte of each gram after its context. ``keys`` hold whole subtrees of depth ``len(top)``."""
    total, cut = np.zeros(len(keys)), len(top)
    for bit in range(8):
        one = ((keys >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
        levels = subtree(keys, counts, depth, cut, bit)
        path, i = [], np.arange(len(keys))
        for _, inv, zeros, ones, _, own in levels:
            i = inv[i]
            path.append((own[i], kt(zeros[i], ones[i], one)))
        p = path[0][1]
        for own, here in path[1:]:
            p = own * here + (1 - own) * p
        at = levels[-1][0]
        for d, (nodes, zeros, ones, own) in zip(range(cut - 1, -1, -1), top, strict=True):
            j = np.searchsorted(nodes, (at >> np.uint64(8 * (depth - d + 1)) << np.uint64(8)) | (at & np.uint64(255)))[i]
            p = own[j] * kt(zeros[j], ones[j], one) + (1 - own[j]) * p
        total += np.log(p)
    return total / LN10


def sums_of(grams: np.ndarray, n_bytes: np.ndarray, keys: np.ndarray, vals: np.ndarray, depth: int) -> np.ndarray:
    """Sum of the values of each text's grams. Grams are looked up in sorted order, each once: tables are larger than caches."""
    doc = np.repeat(np.arange(len(n_bytes), dtype=np.uint64), n_bytes)
    if depth <= 5 and len(n_bytes) <= 1 << 16:  # gram and text fit one number
        both = np.sort(grams << np.uint64(16) | doc)
        grams, doc = both >> np.uint64(16), both & np.uint64(0xFFFF)
    else:
        order = np.argsort(grams, kind="stable")
        grams, doc = grams[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    found = vals[np.searchsorted(keys, grams[first])]
    return np.bincount(doc.astype(np.int64), np.repeat(found, np.diff(np.append(first, len(grams)))), len(n_bytes))


# -- Spark --------------------------------------------------------------------------------------


def _rows(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns, schema)


_PART = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("vals", pa.binary())])


def _requests(docs: DataFrame, depth: int, buckets: int) -> DataFrame:
    """Each block's distinct grams and words with their training counts, by bucket. ``docs``: (block, doc_id, text, train) in blocks."""

    def run(batches):
        ids, block, parts = WordKeys(), None, {GRAM: [], WORD: []}

        def flush():
            for kind, found in parts.items():
                keys, counts = merge(found)
                b = bucket_of(keys, kind, depth, buckets)
                o = np.argsort(b, kind="stable")
                edges = np.searchsorted(b[o], np.arange(buckets + 1))
                cols: dict = {"block": [], "bucket": [], "kind": [], "keys": [], "vals": []}
                for x in np.flatnonzero(np.diff(edges)).tolist():
                    part = o[edges[x] : edges[x + 1]]
                    for name, v in (("block", block), ("bucket", x), ("kind", kind), ("keys", pack_keys(keys[part])), ("vals", pack(counts[part]))):
                        cols[name].append(v)
                found.clear()
                yield _rows(cols, _PART)

        def add(texts, train):
            for use in (True, False):
                some = [t for t, x in zip(texts, train, strict=True) if x is use]
                if some:
                    grams, _, words, _ = read(some, depth, ids)
                    for kind, keys in ((GRAM, grams), (WORD, words)):
                        u, n = np.unique(keys, return_counts=True)
                        parts[kind].append((u, n if use else np.zeros(len(u), np.int64)))
                        if len(parts[kind]) > 16:
                            parts[kind][:] = [merge(parts[kind])]

        for b in batches:
            texts, train, size = [], [], 0
            for k, t, x in zip(b.column(0).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                if k != block and block is not None:
                    add(texts, train)
                    yield from flush()
                    texts, train, size = [], [], 0
                block = k
                texts.append(t.as_py())
                train.append(x)
                size += len(texts[-1] or "")
                if size > LOT_CHARS or len(texts) > LOT_TEXTS:
                    add(texts, train)
                    texts, train, size = [], [], 0
            add(texts, train)
        if block is not None:
            yield from flush()

    return docs.mapInArrow(released(run), PART)


def _by_bucket(batches):
    """(bucket, kind, [rows]) streams of sorted rows, in lots."""
    now, lot = None, []
    for b in batches:
        for r in b.to_pylist():
            if (r["bucket"], r["kind"]) != now or len(lot) >= 64:
                if lot:
                    yield now, lot
                now, lot = (r["bucket"], r["kind"]), []
            lot.append(r)
    if lot:
        yield now, lot


def _totals(requests: DataFrame, buckets: int) -> DataFrame:
    """One row for each bucket and kind: its keys with the counts of all blocks."""

    def run(batches):
        now, sums, late, size = None, [], [], 0

        def out():
            keys, counts = merge(sums + late)
            return _rows({"block": [-1], "bucket": [now[0]], "kind": [now[1]], "keys": [pack_keys(keys)], "vals": [pack(counts)]}, _PART)

        for key, lot in _by_bucket(batches):
            if key != now:
                if now is not None:
                    yield out()
                now, sums, late, size = key, [], [], 0
            for r in lot:
                late.append((unpack_keys(r["keys"]), unpack(r["vals"], np.int64)))
                size += len(late[-1][0])
            if size > 1_000_000 + (len(sums[0][0]) if sums else 0):  # as much as there is: no key is merged more often than the table doubles
                sums, late, size = [merge(sums + late)], [], 0
        if now is not None:
            yield out()

    return requests.repartitionById(min(buckets, TASKS), F.col("bucket")).sortWithinPartitions("bucket", "kind").mapInArrow(released(run), PART)


def _summaries(totals: DataFrame, depth: int) -> DataFrame:
    """Of each bucket's words: their number of tokens and types; of its grams: nodes of depth ``CUT`` summed by their parent."""
    cut = min(CUT, depth)
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("zeros", pa.float64()), ("ones", pa.float64()), ("weighted", pa.float64())])

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                keys, counts = unpack_keys(r["keys"]), unpack(r["vals"], np.int64)
                if r["kind"] == WORD:
                    yield _rows({"kind": [WORD], "key": [0], "zeros": [float(counts.sum())], "ones": [float((counts > 0).sum())], "weighted": [0.0]}, schema)
                    continue
                for bit in range(8):
                    at, _, zeros, ones, weighted, _ = subtree(keys, counts, depth, cut, bit)[-1]
                    up, inv = np.unique((at >> np.uint64(8 * (depth - cut + 2)) << np.uint64(8)) | (at & np.uint64(255)), return_inverse=True)
                    yield _rows({"kind": np.full(len(up), GRAM, np.int32), "key": up.astype(np.int64)} | {n: np.bincount(inv, x, len(up)) for n, x in (("zeros", zeros), ("ones", ones), ("weighted", weighted))}, schema)

    rows = totals.mapInArrow(released(run), "kind int, key long, zeros double, ones double, weighted double")
    return rows.groupBy("kind", "key").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("weighted"))


def _answers(requests: DataFrame, totals: DataFrame, buckets: int, depth: int, top) -> DataFrame:
    """``requests`` with values in place of counts: log10 probabilities of grams, corpus counts of words."""

    def run(batches):
        now, keys, vals = None, None, None
        for key, lot in _by_bucket(batches):
            cols: dict = {n: [] for n in _PART.names}
            for r in lot:
                if r["block"] < 0:  # the bucket's totals stand first
                    now, keys = key, unpack_keys(r["keys"])
                    vals = unpack(r["vals"], np.int64)
                    vals = log_probs(keys, vals, depth, top.value) if key[1] == GRAM else vals.astype(float)
                    continue
                assert key == now
                got = vals[np.searchsorted(keys, unpack_keys(r["keys"]))]
                for n, v in (("block", r["block"]), ("bucket", r["bucket"]), ("kind", r["kind"]), ("keys", r["keys"]), ("vals", pack(got))):
                    cols[n].append(v)
            if cols["block"]:
                yield _rows(cols, _PART)

    both = totals.unionByName(requests.withColumn("vals", F.lit(b"")))
    return both.repartitionById(min(buckets, TASKS), F.col("bucket")).sortWithinPartitions("bucket", "kind", "block").mapInArrow(released(run), PART)


def scores(docs: DataFrame, train, depth: int = 4, block_chars: int = 24_000_000) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs`` (doc_id, text).

    ``train``: a column that says which rows to learn from. ``score``: the model's log10 probability of the text;
    ``base_score``: that of its words by their add-0.1 smoothed corpus frequency.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(train, F.lit(True)).alias("train"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-int(size) // block_chars))
    buckets = int(min(4096, max(16, blocks)))
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(blocks)).cast("long").alias("block"), "doc_id", "text", "train")
    by_block = lambda df: df.repartitionById(min(blocks, TASKS), F.col("block").cast("int"))
    requests = stored(_requests(by_block(dealt).sortWithinPartitions("block"), depth, buckets))
    totals = stored(_totals(requests, buckets))
    found = _summaries(totals, depth).toArrow().sort_by([("kind", "ascending"), ("key", "ascending")])  # columns of at most 2**24 + 1 rows
    kind, key, zeros, ones, below = (found.column(n).to_numpy() for n in ("kind", "key", "zeros", "ones", "weighted"))
    tokens, types = float(zeros[kind == WORD].sum()), float(ones[kind == WORD].sum())
    gram = kind == GRAM
    top = send(spark, top_levels(key[gram].astype(np.uint64), zeros[gram], ones[gram], below[gram], min(CUT, depth)))
    answers = _answers(requests, totals, buckets, depth, top)
    kinds = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    norm = tokens + 0.1 * (types + 1)

    def run(batches):
        ids, block, parts, table = WordKeys(), None, {GRAM: [], WORD: []}, {}

        def score(rows, texts):
            for kind in (GRAM, WORD):
                if kind not in table:
                    k, v = (np.concatenate(x) for x in zip(*parts[kind], strict=True))
                    o = np.argsort(k)
                    table[kind] = k[o], v[o]
            grams, n_bytes, words, n_words = read(texts, depth, ids)
            by = lambda n: np.concatenate([[0], np.cumsum(n)[:-1]])
            p = sums_of(grams, n_bytes, *table[GRAM], depth)
            some, inv = np.unique(words, return_inverse=True)
            c = table[WORD][1][np.searchsorted(table[WORD][0], some)][inv]
            base = np.add.reduceat(np.log10((c + 0.1) / norm), by(n_words))
            known = np.add.reduceat((c > 0).astype(np.int64), by(n_words))
            return _rows({"doc_id": rows, "n_bytes": n_bytes - 1, "n_tokens": n_words, "n_known": known, "base_score": base, "score": p}, kinds)

        for b in batches:
            rows, texts, size = [], [], 0
            for j, (k, first) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if k != block:
                    if rows:
                        yield score(rows, texts)
                        rows, texts, size = [], [], 0
                    block, parts, table = k, {GRAM: [], WORD: []}, {}
                if first:
                    parts[b.column(2)[j].as_py()].append((unpack_keys(b.column(3)[j].as_py()), unpack(b.column(4)[j].as_py(), np.float64)))
                    continue
                rows.append(b.column(5)[j].as_py())
                texts.append(b.column(6)[j].as_py())
                size += len(texts[-1] or "")
                if size > LOT_CHARS or len(texts) > LOT_TEXTS:
                    yield score(rows, texts)
                    rows, texts, size = [], [], 0
            if rows:
                yield score(rows, texts)

    none = lambda kind: F.lit(None).cast(kind)
    left = answers.select("block", F.lit(True).alias("first"), "kind", "keys", "vals", none("long").alias("doc_id"), none("string").alias("text"))
    right = dealt.select("block", F.lit(False).alias("first"), none("int").alias("kind"), none("binary").alias("keys"), none("binary").alias("vals"), "doc_id", "text")
    both = by_block(left.unionByName(right)).sortWithinPartitions("block", F.desc("first"))
    out = both.mapInArrow(released(run), "doc_id long, n_bytes long, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(int(tokens)).cast("long"))
