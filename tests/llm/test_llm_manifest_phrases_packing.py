"""Operators 11 to 13 against brute force, and their edges."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelworks.llm import merkle, packing, phrases

# -- manifest -----------------------------------------------------------------------------------


def levels_of(leaves, top):
    out = [leaves]
    for _ in range(top):
        out.append([merkle.parent(*out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


@pytest.mark.parametrize("n", [*range(1, 35), 1000, 1024, 1025])
def test_places_in_postorder(n):
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    for top in (merkle.top_height(n, True), 11):
        levels, log = levels_of(leaves, top), merkle.build(leaves, top)
        assert len(log) == sum(map(len, levels)) == merkle.size(n, top)
        for h, level in enumerate(levels):
            for j, x in enumerate(level):
                assert log[merkle.position(h, j, n)] == x
                if h < top:
                    other = merkle.sibling(h, j, n)
                    assert (other is None) == ((j ^ 1) >= len(level))
                    assert other is None or log[other] == level[j ^ 1]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows, fields, altered):
    """Row by row, level by level."""

    def leaf(r):
        return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[f] for f in fields)))

    def tree(xs):
        out = [xs]
        while len(out[-1]) > 1:
            out.append([H(*out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
        return out

    def climb(x, i, levels):
        seen = []
        for level in levels[:-1]:
            other = level[i ^ 1] if (i ^ 1) < len(level) else None
            seen += [other] if other else []
            x = H(x) if other is None else H(other, x) if i & 1 else H(x, other)
            i //= 2
        return x, seen

    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[g] = tree([leaf(r) for r in groups[g]])
    head = tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            x, seen = climb(leaf(altered(r) or r), i, trees[g])
            x, more = climb(x, k, head)
            out.append((r["doc_id"], leaf(r), trees[g][-1][0], head[-1][0], H(*seen, *more), x, x == head[-1][0]))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, i int, digest string"


@pytest.mark.parametrize("height", [1, 2, 10])
def test_manifest_against_plain_trees(spark, height):
    rows = [(i, f"s{i % 3}", ["en", "de", "é", "", None][i % 5 if i % 4 else 0], None if i % 6 == 0 else i, ["a b", "", None, "x" * 50_000, "ä\n"][i % 5], "x", 1, "y") for i in range(37)]
    rows += [rows[3]] * 3 + [(None, None, None, None, None, None, None, None)] * 2 + [(3, "s", "en", 1, "other", "", 0, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    got = merkle.manifest(docs, fields, "lang", "doc_id", lambda d: F.when(F.col("doc_id") % 7 == 0, merkle.digest([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in fields])), height)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    plain = [dict(zip(("doc_id", "source", "lang", "n_chars", "text"), r, strict=False)) for r in rows]
    want = plain_manifest(plain, fields, lambda r: {**r, "n_chars": r["n_chars"] + 1} if r["doc_id"] is not None and r["doc_id"] % 7 == 0 and r["n_chars"] is not None else None)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert 0 < sum(not r[-1] for r in want) < 10


def test_manifest_of_nothing_and_of_one(spark):
    docs = spark.createDataFrame([(1, "s", "en", 1, "t", "", 0, "")], SCHEMA)
    assert merkle.manifest(docs.limit(0), ("doc_id", "text"), "lang", "doc_id").collect() == []
    (one,) = merkle.manifest(docs, ("doc_id", "text"), "lang", "doc_id").collect()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] == H("1:11:t") and one["verified"] and one["proof_sha256"] == H("")


def test_log_of_a_tree_in_blocks_is_that_of_the_whole_tree(spark):
    rows = spark.range(11).select(F.lit("t").alias("tree"), F.col("id").alias("key"), F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256)).alias("digest"))
    forest = merkle.forest(merkle.numbered(rows, ["key"]), ("key",), 2)
    assert len(forest.tiers) == 2
    got = {r["position"]: bytes(r["digest"]) for r in merkle.nodes(forest).collect()}
    whole = merkle.build([hashlib.sha256(str(i).encode()).digest() for i in range(11)], 4)
    assert [got[k] for k in sorted(got)] == whole and sorted(got) == list(range(len(whole)))


# -- phrases ------------------------------------------------------------------------------------


def plain_phrases(rows, size, least, inside, top):
    import re

    f = defaultdict(Counter)
    for lang, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            for i in range(len(w)):
                for m in range(1, size + 1):
                    if i + m <= len(w):
                        f[lang or "und"][tuple(w[i : i + m])] += 1
    out = []
    for lang, c in f.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        got = []
        for p, a in cand.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= inside * a for q, b in cand.items()):
                continue
            score, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            got.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(got)[:top], 1)]
    return sorted(out)


def phrase_rows():
    rng = np.random.default_rng(5)
    words = ["The", "cat", "sat", "ö", "on", "a", "mat", "x", "New", "York", "City"]
    rows = [(["en", "de", None, "und"][k % 4], "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ", ", ".", "\n", "\x0b ", "  "]) for _ in range(60))) for k in range(60)]
    return rows + [("en", "new york city hall. " * 30)] * 2 + [("en", None), ("en", ""), (None, " ,.\n"), ("fr", "solo"), ("de", "wort " * 3000)]


@pytest.mark.parametrize(("size", "least", "top", "buckets"), [(3, 5, 50, None), (3, 3, 2000, 7), (2, 2, 10, 3), (4, 4, 2000, 5)])
def test_phrases_against_plain_counts(spark, monkeypatch, size, least, top, buckets):
    rows = phrase_rows()
    docs = spark.createDataFrame([(t, g, 1, "z") for g, t in rows], "text string, lang string, k int, phrase string").repartition(5)
    if buckets:
        monkeypatch.setattr(phrases, "frequent", lambda *a, f=phrases.frequent: f(*a, buckets=buckets))
        monkeypatch.setattr(phrases, "LOT", 1500)
    got = phrases.collocations(docs, size=size, least=least, inside=50, top=top)
    assert sorted(map(tuple, got.collect())) == plain_phrases(rows, size, least, 50, top)


def test_phrases_of_nothing(spark):
    docs = spark.createDataFrame([(None, "en")], "text string, lang string")
    assert phrases.collocations(docs).collect() == [] and phrases.collocations(docs.limit(0)).collect() == []


def test_counts_beyond_64_bits(spark):
    rows = spark.range(1).select(F.lit(4_000_000_000_000).cast("decimal(18,0)").alias("a"))
    aa = rows.select((F.col("a") * F.col("a") * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)").alias("aa"), (F.col("a") * (F.col("a") + 3)).cast("decimal(38,0)").alias("lr"))
    assert aa.select(F.expr("aa div lr")).first()[0] == 1_000_000 * 4_000_000_000_000**2 // (4_000_000_000_000 * 4_000_000_000_003)


# -- packing ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


TEXTS = [None, "", "   ", "Hello, World", "a\tb\nc\r\nd", "ΣΑΣ ΟΔΟΣ ς", "é é ́x  y z", "it's we'll I'D", "<|endoftext|> in<|startoftext|>side <|endof text|>", "12 34x 5", "日本語 テキスト", "x" * 9000, "word " * 5000, "\x00\x01 \x1c\x1d\x85 end", "Ǆ ﬁ ß İ", "Éqûe, déjà!! naïve.) ÀÉÎÕÜ ñ. x÷y a×b éß", "J\u030c h\u0331. t\u0308 a\u0301. E\u0301,", "don't. I'LL, x's!? 'tis", "end.<|endoftext|>. a.b.c ... ,,a,, word%%% w### &&&", "ª º µ ſ K Å", "<|STARTOFTEXT|> <| |> a|b>."]


def test_tokens_are_those_of_whole_texts(vocabulary):
    from tokenizers import Tokenizer

    whole, words = Tokenizer.from_file(vocabulary), packing.Words(vocabulary)
    flat, bounds = packing.tokenized(pa.array(TEXTS).slice(1), words, 1)
    for k, t in enumerate(TEXTS[1:]):
        assert flat[bounds[k] : bounds[k + 1]].tolist() == [*whole.encode(t, add_special_tokens=False).ids, 1], repr(t[:40])


def test_tokens_of_real_texts_and_other_vocabularies(spark, vocabulary):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    whole, words = Tokenizer.from_file(vocabulary), packing.Words(vocabulary)
    assert words.plain
    for words.plain in (True, False):  # with and without the short way of plain words
        words.forget()
        flat, bounds = packing.tokenized(pa.array(texts), words, 1)
        for k, t in enumerate(texts):
            assert flat[bounds[k] : bounds[k + 1]].tolist() == [*whole.encode(t or "", add_special_tokens=False).ids, 1]
    with pytest.raises(ValueError, match="white space"):
        packing.Words(public_tokenizers.path("byte_bpe_50k.json"))


def test_pieces_and_sequences(spark, vocabulary, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "LOT", 100)
    docs = spark.createDataFrame([(k % 7 if k % 5 else None, t, 1, "x") for k, t in enumerate(TEXTS * 3)], "doc_id long, text string, uid int, piece string").repartition(3)
    rows = packing.pieces(docs, vocabulary, size=64, ids=True)
    placed = packing.pack(rows.drop("ids"), 64, shard=40).collect()
    whole = Tokenizer.from_file(vocabulary)
    want = Counter()
    for k, t in enumerate(TEXTS * 3):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        for i in range(0, len(ids), 64):
            want[(k % 7 if k % 5 else None, i // 64, i, len(ids[i : i + 64]), zlib.crc32(np.array(ids[i : i + 64], "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in placed) == want
    by = defaultdict(list)
    for r in placed:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) <= -(-sum(r["length"] for r in placed) // 64) + 3
    ids = {r["uid"]: r["ids"] for r in rows.collect()}
    found = {r["sequence_id"]: r["ids"] for r in packing.sequences(rows, packing.pack(rows.drop("ids"), 64, shard=40)).collect()}
    again = defaultdict(list)
    for r in sorted(placed, key=lambda r: r["offset"]):
        again[r["sequence_id"]] += ids[r["uid"]]
    assert found == again


def test_pack_nothing(spark, vocabulary):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.pieces(docs, vocabulary)).collect() == []


def plain_sum_of_squares(lengths, size):
    """Tries every choice and adds up the squares anew."""
    gaps, out = [], []
    for s in lengths:
        best = None
        for k in [*range(len(gaps)), None]:
            if k is not None and gaps[k] < s:
                continue
            after = [*gaps, size - s] if k is None else [*gaps[:k], gaps[k] - s, *gaps[k + 1 :]]
            total = sum(v * v for g, v in Counter(after).items() if g > 0)
            key = (total, k is None, gaps[k] if k is not None else 0)
            if best is None or key < best[0]:
                best = (key, after, k is None)
        gaps = best[1]
        out.append(sum(v * v for g, v in Counter(gaps).items() if g > 0))
    return out, len(gaps)


def test_sum_of_squares_takes_the_least(spark):
    rng = np.random.default_rng(3)
    for size in (7, 20):
        lengths = rng.integers(1, size + 1, 80)
        sequence, offset, used = packing.sum_of_squares(lengths, size)
        sums, gaps = [], Counter()
        for s, at in zip(lengths, sequence, strict=True):
            gaps[int(at)] += int(s)
            sums.append(sum(v * v for g, v in Counter(size - v for v in gaps.values()).items() if g > 0))
        want, _ = plain_sum_of_squares(lengths.tolist(), size)
        assert sums == want and used == len(gaps) and max(gaps.values()) <= size


def test_many_shards_stay_near_the_bound(spark):
    rng = np.random.default_rng(4)
    lengths = np.minimum(rng.lognormal(3, 1, 6000).astype(int) + 1, 256)
    rows = spark.createDataFrame([(k, int(v)) for k, v in enumerate(lengths)], "uid long, length long")
    placed = packing.pack(rows, 256, shard=1000).toPandas()
    assert sorted(placed.uid) == list(range(6000)) and placed.groupby("sequence_id").length.sum().max() <= 256
    assert placed.sequence_id.nunique() <= 1.01 * -(-lengths.sum() // 256)
