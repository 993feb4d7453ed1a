"""Language ID by word-first backoff.

A word known from training adds its log frequency in each language. A word that is not known is
scored by its longest character n-grams that are; only where none of a length is known, shorter
ones are looked up. The sums of all words, as a mean, decide the language.

Defined results: NULL, empty or letterless text is ``und`` with score 0.0; ties between languages go to
the first in sorted order; if nothing can be learned (no labelled text) every text is ``und``. Very long texts are read whole. Repeated
rows get equal results; other columns of the input are never read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelworks.llm.common import bottom_k, release, released, send, stored

UND = "und"
WORD = re.compile(r"[^\W\d_]+")


class LogTable:
    """Log frequencies by language of hashed strings: sorted keys and a matrix, eight bytes and four a language for each."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray):
        self.keys, self.logs = keys, logs

    @classmethod
    def of(cls, values: dict[str, tuple[float, ...]], n_langs: int) -> LogTable:
        keys = np.array([key_of(x) for x in values], np.int64)
        order = np.argsort(keys)
        return cls(keys[order], np.array(list(values.values()), np.float32).reshape(len(values), n_langs)[order] if values else np.zeros((0, n_langs), np.float32))

    def find(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Row of each string, and whether it is there."""
        if not len(self.keys):
            return np.zeros(len(strings), np.int64), np.zeros(len(strings), bool)
        keys = np.array([key_of(x) for x in strings], np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys


def key_of(x: str) -> int:
    """What ``xxhash64`` of Spark gives for a string."""
    h = xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 42)
    return h - 2**64 if h >= 2**63 else h


@dataclass(frozen=True)
class LangModel:
    langs: list[str]
    words: LogTable  # these two also as dict[str, tuple[float, ...]]
    grams: LogTable  # of "^word$" pieces, lengths 1..max_n
    max_n: int

    def __post_init__(self):
        for name in ("words", "grams"):
            if isinstance(table := getattr(self, name), dict):
                object.__setattr__(self, name, LogTable.of(table, len(self.langs)))


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def pieces(word: str, n: int) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + n] for i in range(len(w) - n + 1)] if n > 1 else list(word)


def _word_counts(batches):
    for b in batches:
        counts: Counter = Counter()
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            counts.update((lang, w) for w in words_of(text))
        keys = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())],
            ["lang", "word", "n"],
        )


def _gram_counts(max_n: int):
    def run(batches):
        for b in batches:
            counts: Counter = Counter()
            for lang, word, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for k in range(1, max_n + 1):
                    for g in pieces(word, k):
                        counts[lang, g] += n
            keys = list(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())],
                ["lang", "word", "n"],
            )

    return run


def _log_table(counts: DataFrame, langs: list[str], smoothing: float) -> LogTable:
    """Each entry's log frequency by language. What comes to the driver is packed columns: a key and a count a language for each entry."""
    wide = counts.groupBy(F.xxhash64("word").alias("key")).agg(*[F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).cast("float").alias(f"c{i}") for i, x in enumerate(langs)])
    got = wide.toArrow()
    keys = got.column("key").to_numpy()
    order = np.argsort(keys)
    size = np.zeros((len(keys), len(langs)), np.float32)
    for i in range(len(langs)):
        size[:, i] = got.column(f"c{i}").to_numpy()[order]
    total = size.sum(0, dtype=np.float64)
    return LogTable(keys[order], np.log(size + np.float32(smoothing)) - np.log(total + smoothing * max(1, len(keys))).astype(np.float32))


def fit(train: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", max_rows: int = 20_000, max_n: int = 4, smoothing: float = 0.5) -> LangModel:
    """Learn from at most ``max_rows`` labelled rows (those with the smallest hash of key and text), counted on Spark.

    All words and n-grams of these rows are kept: ``max_rows`` is what bounds the model and its broadcast.
    """
    rows = bottom_k(train.select(F.col(key).alias("k"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text is not null and lang is not null"), max_rows, "k", "text")
    counts = stored(rows.select("text", "lang").mapInArrow(released(_word_counts), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not langs:
        return LangModel([], {}, {}, max_n)
    words = _log_table(counts, langs, smoothing)
    grams = _log_table(counts.mapInArrow(released(_gram_counts(max_n)), "lang string, word string, n long"), langs, smoothing)
    release()
    return LangModel(langs, words, grams, max_n)


class Scorer:
    """Looks words up in a model; word vectors are kept in a table of bounded size."""

    def __init__(self, model: LangModel, memory: int = 300_000):
        self.model, self.memory = model, memory
        self.index: dict[str, int] = {}
        self.table = np.zeros((1024, max(1, len(model.langs))))

    def vector(self, word: str) -> np.ndarray:
        m = self.model
        at, known = m.words.find([word])
        if known[0]:
            return m.words.logs[at[0]].astype(np.float64)
        for n in range(m.max_n, 0, -1):
            at, known = m.grams.find(pieces(word, n))
            if known.any():
                return m.grams.logs[at[known]].mean(0, dtype=np.float64)
        return np.zeros(self.table.shape[1])

    def rows(self, words: list[str]) -> np.ndarray:
        index, out = self.index, []
        if len(index) > self.memory:
            index.clear()
        for w in words:
            i = index.get(w)
            if i is None:
                i = index[w] = len(index)
                if i >= len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.table[i] = self.vector(w)
            out.append(i)
        return self.table[out]

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.model.langs or not any(c.isalpha() for w in words for c in w):
            return UND, 0.0
        mean = self.rows(words).mean(0)
        z = (mean - mean.max()) * min(len(words), 30)
        p = np.exp(z) / np.exp(z).sum()
        best = int(np.argmax(mean))
        return self.model.langs[best], float(p[best])


def predict(model: LangModel, spark, text: Column) -> Column:
    """struct(lang, score) of each text; the model goes out as one bounded broadcast."""
    shared = send(spark, model)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])
    state: dict = {}

    def run(texts: pa.Array) -> pa.Array:
        if "s" not in state:
            state["s"] = Scorer(shared.value)
        out = [state["s"].predict(t.as_py()) for t in texts]
        return pa.array([{"lang": a, "score": b} for a, b in out], kind)

    return F.arrow_udf(run, "lang string, score double")(text)
