"""Documents as tokens, packed into sequences of a fixed size by the sum-of-squares rule.

``pieces`` tokenizes whole texts, appends an end id and cuts documents longer than a sequence. ``pack`` places pieces: where a piece may go, it goes where the sum,
over all residual gaps, of the squared number of open sequences with that gap becomes smallest; equal choices take the smallest gap. Longest pieces come first.
Pieces are dealt to shards of bounded size, which tasks pack side by side; a piece as long as a sequence is one. Sequences that a shard leaves with a gap are dealt
again, whole, to fewer shards, and a shard's new packing is taken if it needs fewer sequences, until one shard packs all that is left open.

NULL and empty texts are one piece of the end id. A text of any length is tokenized whole. Rows may share an id or have none: a piece is known by ``uid``. Documents of
one length tie; the smaller ``uid`` comes first. An empty table gives an empty one. Other columns than key and text are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from panelworks.llm.common import released, stored

#: Pieces of a shard: what one task packs at a time.
SHARD = 16_384
#: Bytes of text tokenized at a time, words that a worker keeps the tokens of, and words that are tokenized in one go.
LOT, KNOWN, GO = 12_000_000, 600_000, 5_000

#: ASCII white space becomes a blank, at which texts are split: no token of the vocabularies read here crosses it.
BLANKS = bytes(32 if b in (9, 10, 11, 12, 13) else b for b in range(256))
#: Signs that end a word are tokens of their own, so they are split off, and a word with and without them is one.
SIGNS = "([A-Za-z0-9À-ÖØ-öø-ÿ])([!-&(-;=?@\\[-`{}~]+)( |$)"
#: Words of letters that the normalizations below only lower-case.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Steps of a tokenizer for which such a word, lower-cased, reaches the merges as it is.
STEPS = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: How byte-level models write bytes: printable ones as they are, the others from 256 on.
BYTE_CHARS = {b: b for b in _PRINTED} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class Words:
    """Tokens of words between blanks, one array for all; each distinct word is tokenized once while it is kept.

    Words of plain letters go to the tokenizer's merges at once where its other steps (``STEPS``) leave them as they are. The others are tokenized whole, many at a time, with a
    special token between them, at which the tokenizer parts a text before all else; those that might hold a special token go alone.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        steps = tuple([x["type"] for x in (spec[k] or {}).get(each, [])] for k, each in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
        self.plain = steps == STEPS and r"[\p{L}]+" in str(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"].get("Regex"))
        if not self.plain and self._ids(" a  b\n").tolist() != [*self._ids("a").tolist(), *self._ids("b").tolist()]:
            raise ValueError("a vocabulary whose tokens hold white space can't be read word by word")
        self.model = self.tokenizer.model
        self.mark, self.between = next((t["id"], t["content"]) for t in spec["added_tokens"] if t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]))
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.firsts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, plain: list[str], rest: list[str]) -> None:
        joint, alone = [w for w in rest if "<|" not in w and self.between not in w], [w for w in rest if "<|" in w or self.between in w]
        found = [[t.id for t in self.model.tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(BYTE_CHARS))] for w in plain]
        ids, sizes = [self.ids, np.fromiter(chain.from_iterable(found), np.uint32)], [self.sizes, np.fromiter(map(len, found), np.int64, len(found))]
        for k in range(0, len(joint), GO):
            got = self._ids(self.between.join(joint[k : k + GO]))
            cuts = np.flatnonzero(got == self.mark)
            sizes.append(np.diff(np.concatenate([[-1], cuts, [len(got)]])) - 1)
            ids.append(got[got != self.mark])
        for w in alone:
            ids.append(self._ids(w))
            sizes.append(np.array([len(ids[-1])]))
        for w in chain(plain, joint, alone):
            self.known[w] = len(self.known)
        self.ids, self.sizes = np.concatenate(ids), np.concatenate(sizes)
        self.firsts = np.cumsum(self.sizes) - self.sizes

    def numbers(self, words: list[str]) -> np.ndarray:
        """Each word's place in ``firsts`` and ``sizes``, which say where in ``ids`` its tokens stand."""
        if len(self.known) > KNOWN:
            self.forget()
        plain: dict[str, None] = {}
        rest: dict[str, None] = {}
        keys, letters, known = [], LETTERS.fullmatch, self.known
        for w in words:
            if self.plain and letters(w):
                w = w.lower()
                if w not in known:
                    plain[w] = None
            elif w not in known:
                rest[w] = None
            keys.append(w)
        if plain or rest:
            self._learn(list(plain), list(rest))
        return np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))


_words: dict[str, Words] = {}


def _known(path: str) -> Words:
    """A Python worker, which Spark uses for many tasks, keeps one."""
    if path not in _words:
        _words[path] = Words(path)
    return _words[path]


def _lots(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``LOT`` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(texts):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + LOT, "right")))
        yield first, last
        first = last


def tokenized(texts: pa.Array, words: Words, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The token ids of all texts in a row, each ended by ``end``, and where each begins (one more entry than texts)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, "<i8")[texts.offset : texts.offset + len(texts) + 1]
    data = memoryview(data)[ends[0] : ends[-1]].tobytes().translate(BLANKS) if data else b""
    rows = pc.split_pattern(pc.replace_substring_regex(pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((ends - ends[0]).tobytes()), pa.py_buffer(data)), SIGNS, r"\1 \2\3"), " ")
    distinct = rows.flatten().dictionary_encode()
    found = words.numbers(distinct.dictionary.to_pylist())
    sizes, firsts, ids = words.sizes[found], words.firsts[found], words.ids
    codes = distinct.indices.to_numpy(zero_copy_only=False)
    each = sizes[codes]
    after = np.cumsum(each)
    flat = ids[np.repeat(firsts[codes] - (after - each), each) + np.arange(after[-1] if len(after) else 0)]
    bounds = np.concatenate([[0], after])[np.asarray(rows.offsets.to_numpy()) - rows.offsets[0].as_py()]
    places = bounds[1:]
    return np.insert(flat, places, np.uint32(end)), bounds + np.arange(len(bounds))


def pieces(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", size: int = 4096, end: int = 1, ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32, uid) and, if asked for, ``ids``: a row for each piece of at most ``size`` tokens. ``ids_crc32`` is over the ids as little-endian 32-bit numbers."""
    kind = to_arrow_type(df.schema[key].dataType)
    schema = pa.schema([("key", kind), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int32()))] if ids else [])])

    def run(batches):
        words = _known(path)
        for b in batches:
            for first, last in _lots(b.column("text")):
                flat, bounds = tokenized(b.column("text").slice(first, last - first), words, end)
                flat = flat.astype("<u4")
                # A row for each piece: which text, and from where to where.
                counts = -(-np.diff(bounds) // size)
                row = np.repeat(np.arange(last - first), counts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                lo = bounds[row] + piece * size
                hi = np.minimum(lo + size, bounds[row + 1])
                crc = [zlib.crc32(flat[i:j]) for i, j in zip(lo.tolist(), hi.tolist(), strict=True)]
                out = [b.column("key").take(pa.array(row + first)), piece.astype(np.int32), piece * size, hi - lo, np.array(crc, np.int64)]
                if ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(lo, hi[-1:]), pa.int32()), pa.array(flat.astype(np.int32))))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) if isinstance(c, np.ndarray) else c for c, k in zip(out, schema.types, strict=True)], schema=schema)

    fields = f"key {df.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if ids else "")
    found = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(released(run), fields)
    return stored(found.withColumn("uid", F.monotonically_increasing_id()).withColumnRenamed("key", key))


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence (numbered from 0) and offset of each piece, placed in the order given, and how many sequences there are."""
    counts = np.zeros(size + 1, np.int64)  # open sequences by gap
    open_: dict[int, list[int]] = {}
    sequence, offset, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for k, s in enumerate(lengths.tolist()):
        if s >= size:
            sequence[k], offset[k] = used, 0
            used += 1
            continue
        # What the sum grows by if a sequence of gap s, s + 1, .. takes the piece; one that it fills leaves the sum.
        gaps = counts[s:size]
        grows = 2 * (counts[: size - s] - gaps) + 2
        grows[0] = 1 - 2 * gaps[0]
        grows[gaps == 0] = np.iinfo(np.int64).max
        best = int(grows.argmin())
        if grows[best] <= 2 * counts[size - s] + 1:
            at, gap = open_[s + best].pop(), s + best
            counts[gap] -= 1
        else:
            at, gap = used, size
            used += 1
        sequence[k], offset[k] = at, size - gap
        if gap > s:
            counts[gap - s] += 1
            open_.setdefault(gap - s, []).append(at)
    return sequence, offset, used


def _packed(table: pa.Table, size: int) -> pa.Table:
    """A shard's pieces with ``sequence_id``, the uid of a sequence's first piece, ``offset`` and ``gap``; an older packing stays unless this one needs fewer sequences."""
    uid, length = (table.column(c).to_numpy() for c in ("uid", "length"))
    order = np.lexsort((uid, -length))
    sequence, offset, used = sum_of_squares(length[order], size)
    back = np.argsort(order)
    sequence, offset = sequence[back], offset[back]
    old = table.column("sequence_id")
    if old.null_count or used < len(pc.unique(old)):
        names = np.empty(used, np.int64)
        names[sequence[offset == 0]] = uid[offset == 0]
        table = table.set_column(table.schema.names.index("sequence_id"), "sequence_id", pa.array(names[sequence]))
        table = table.set_column(table.schema.names.index("offset"), "offset", pa.array(offset))
    _, place = np.unique(table.column("sequence_id").to_numpy(), return_inverse=True)
    gap = size - np.bincount(place, length).astype(np.int64)[place]
    return table.set_column(table.schema.names.index("gap"), "gap", pa.array(gap))


def pack(rows: DataFrame, size: int = 4096, shard: int = SHARD) -> DataFrame:
    """``rows`` (uid, length, ..), pieces of at most ``size`` tokens, with ``sequence_id`` and ``offset``: a sequence's pieces follow one another from 0 without a gap between them."""
    none = F.lit(None).cast("long")
    whole = rows.filter(F.col("length") >= size).withColumns({"sequence_id": F.col("uid"), "offset": F.lit(0).cast("long")})
    left, done = rows.filter(F.col("length") < size).withColumns({"sequence_id": none, "offset": none, "gap": none}), whole
    n = left.count()
    turn = 0
    while n:
        shards = max(1, -(-n // shard))
        # Pieces of one sequence stay together; at first each is on its own.
        dealt = left.withColumn("_shard", F.pmod(F.xxhash64(F.coalesce("sequence_id", "uid"), F.lit(turn)), F.lit(shards)))
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in left.schema)
        packed = stored(dealt.groupBy("_shard").applyInArrow(lambda table: _packed(table.drop_columns(["_shard"]), size), kinds))
        if shards == 1:
            return done.unionByName(packed.drop("gap"))
        done = done.unionByName(packed.filter("gap = 0").drop("gap"))
        left = packed.filter("gap > 0")
        before, n, turn = n, left.count(), turn + 1
        if n == before:
            return done.unionByName(left.drop("gap"))
    return done


def sequences(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, from ``pieces`` with ids and what ``pack`` says of them. A sequence has at most ``size`` tokens."""
    both = rows.select("uid", "ids").join(placed.select("uid", "sequence_id", "offset"), "uid")
    return both.groupBy("sequence_id").agg(F.flatten(F.sort_array(F.collect_list(F.struct("offset", "ids"))).getField("ids")).alias("ids"))
