"""Toxicity by a weighted lexicon.

Texts and lexicon are folded alike: compatibility forms and accents go, look-alike letters of other
scripts become Latin ones, digits and signs inside words become the letters they stand for. One
Aho-Corasick automaton then finds all terms and exception phrases; a term inside an exception phrase
does not count. Terms are whole words, and stems: beginnings that words of many endings share. The sum of the weights,
as such and for the length of the text, gives the score.

Terms, weights, exception phrases and the scale of the score are learned from labelled rows. A term's weight is the lower confidence
bound of its log odds, so that chance finds among rare words get no weight, however many words there are.

Defined results: NULL and empty texts have no hits and get the score of a text without hits; without labelled
rows of both classes every score is 0.0. Very long texts are folded and matched whole; sorting
what is found is the only step that takes more than their length. Of terms that
start at one place the whole word counts, else the longest stem. Repeated rows get equal scores. Other columns are never read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelworks.llm.common import bottom_k, send, stored

# Letters of other scripts that look like Latin ones, and the letters that digits and signs stand for.
HOMOGLYPHS = dict(
    zip(
        "авеёкмнорстухісјѕһԁԛԝӏαβεηικνορτυχγωϲϳıłøđħŧ",
        "abeekmhopctyxicjshdqwlabenikvoptuxywcjilodht",
        strict=True,
    )
)
LEET = dict(zip("0134578@$!|+", "oieastbasiit", strict=True))
MERGED = {"l": "i"}  # 1, !, | stand for either

_LOOK = str.maketrans(HOMOGLYPHS)
_LEET = str.maketrans(LEET)
_MERGE = str.maketrans(MERGED)
_MIXED = re.compile(r"[a-z]+[0-9@$!|+]+[a-z0-9@$!|+]*[a-z0-9]|[0-9@$]+[a-z][a-z0-9@$!|+]*[a-z0-9]|[a-z]+[0-9]+")
_SIGN = re.compile(r"[0-9@$!|+]")
_WORD = re.compile(r"[^\W_]+")
#: Marks a stem among terms; in no word. Shortest and longest stem.
STEM, STEM_CHARS = "~", (3, 8)


def fold(text: str) -> str:
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = "".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) != "Cf").lower().translate(_LOOK)
    if _SIGN.search(text):
        text = _MIXED.sub(lambda m: m.group().translate(_LEET), text)
    return text.translate(_MERGE)


@dataclass(frozen=True)
class ToxModel:
    terms: dict[str, float]  # folded word or phrase: weight
    exceptions: list[str] = field(default_factory=list)  # folded phrases
    coef: tuple[float, float, float] = (-30.0, 0.0, 0.0)  # bias, of the sum, of the sum by length
    stems: dict[str, float] = field(default_factory=dict)  # folded beginning of longer words: weight


class Matcher:
    def __init__(self, model: ToxModel):
        self.model, self.auto = model, ahocorasick.Automaton()
        spared = frozenset(model.exceptions)
        # A string can be a word, a stem and an exception at once: its length and its weight as each of them.
        for t in {*model.terms, *model.stems, *spared}:
            self.auto.add_word(t, (len(t), model.terms.get(t, 0.0), model.stems.get(t, 0.0), t in spared))
        self.empty = not (model.terms or model.stems or model.exceptions)
        if not self.empty:
            self.auto.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """Terms as (start, end, weight) that no exception phrase covers."""
        if self.empty:
            return []
        found: dict[int, tuple[int, int, float]] = {}
        spared, n = [], len(folded)
        for end, (size, word, stem, spares) in self.auto.iter(folded):
            a, b = end + 1 - size, end + 1
            if a and folded[a - 1].isalnum():
                continue
            if b == n or not folded[b].isalnum():
                if word:
                    found[a] = (a, b, word)
                if spares:
                    spared.append((a, b))
            elif stem:  # longer ones come later and replace it
                found[a] = (a, b, stem)
        hits = sorted(found.values())
        if not spared:
            return hits
        # Of the exception phrases that begin at or before a hit the one that reaches furthest decides.
        spared.sort()
        kept, k, reach = [], 0, 0
        for h in hits:
            while k < len(spared) and spared[k][0] <= h[0]:
                reach = max(reach, spared[k][1])
                k += 1
            if h[1] > reach:
                kept.append(h)
        return kept

    def features(self, text: str | None) -> tuple[int, float, float]:
        """Hits, log of their weight, log of their weight in a thousand words."""
        return self.of_folded(fold(text) if text else "")

    def of_folded(self, folded: str) -> tuple[int, float, float]:
        hits = self.hits(folded)
        total = sum(h[2] for h in hits)
        n_words = folded.count(" ") + folded.count("\n") + 1
        return len(hits), float(np.log1p(total)), float(np.log1p(1000 * total / (n_words + 100)))

    def score(self, text: str | None) -> tuple[int, float]:
        n, a, b = self.features(text)
        z = self.model.coef[0] + self.model.coef[1] * a + self.model.coef[2] * b
        return n, float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _folded(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([fold(t) for t in b.column(0).to_pylist()], pa.string()), b.column(1)], ["folded", "toxic"])


def _pairs(rows: Counter) -> pa.RecordBatch:
    keys = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([rows[k] for k in keys], pa.int64())], ["term", "toxic", "n"])


def words_in(folded: str) -> set[str]:
    return {w for w in _WORD.findall(folded) if not w.isdigit()}


def stems_in(words: set[str]) -> set[str]:
    """Beginnings, each with a ``STEM`` mark, that two of the words share at least."""
    seen = Counter(w[:k] for w in words for k in range(STEM_CHARS[0], min(len(w), STEM_CHARS[1] + 1)))
    return {s + STEM for s, n in seen.items() if n > 1}


def _word_docs(batches):
    for b in batches:
        seen: Counter = Counter()
        for folded, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = words_in(folded)
            seen.update((w, toxic) for w in words | stems_in(words))
        yield _pairs(seen)


def stem_of(word: str, stems) -> str | None:
    """The longest of ``stems`` that the word goes on from."""
    return next((word[:k] for k in range(min(STEM_CHARS[1], len(word) - 1), STEM_CHARS[0] - 1, -1) if word[:k] in stems), None)


def chosen(weights: dict[str, float], counts: dict[str, int]) -> tuple[dict[str, float], dict[str, float]]:
    """(words, stems) of the candidates without needless ones: a stem goes if one longer candidate is in nearly all its toxic texts; what begins with a stem about as sure goes too."""
    most: Counter = Counter()
    for w in weights:
        s = w.removesuffix(STEM)
        for k in range(STEM_CHARS[0], len(s)):
            most[s[:k]] = max(most[s[:k]], counts[w])
    stems = {s: x for w, x in weights.items() if w.endswith(STEM) and most[s := w.removesuffix(STEM)] < 0.9 * counts[w]}
    needed = {w: x for w, x in weights.items() if not any(stems.get(w.removesuffix(STEM)[:k], -1.0) >= x - 0.5 for k in range(STEM_CHARS[0], len(w.removesuffix(STEM))))}
    return {w: x for w, x in needed.items() if not w.endswith(STEM)}, {s: x for s, x in stems.items() if s + STEM in needed}


def _phrase_docs(terms: frozenset, stems: frozenset):
    def run(batches):
        for b in batches:
            seen: Counter = Counter()
            for folded, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = folded.split()
                seen.update((x, toxic) for x in {f"{w[j]} {w[j + 1]}" for i, x in enumerate(w) if x in terms or stem_of(x, stems) for j in (i - 1, i) if 0 <= j < len(w) - 1})
            yield _pairs(seen)

    return run


def _both(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.sum(F.col("n") * F.col("toxic")).alias("t"), F.sum(F.col("n") * (1 - F.col("toxic"))).alias("c"))


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0) -> np.ndarray:
    """Newton steps on a few columns; ``l2`` keeps separable data finite."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + l2 * w * (np.arange(len(w)) > 0)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w)) * 0.1 + np.diag(l2 * (np.arange(len(w)) > 0)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(labelled: DataFrame, max_rows: int = 20_000, least_docs: int = 5, least_weight: float = 1.3, exceptions: tuple[str, ...] = ()) -> ToxModel:
    """Learn from ``labelled`` (doc_id, text, toxic 0/1): at most ``max_rows`` rows, those with the smallest hash of id and text.

    Exact copies count once. A term is in ``least_docs`` toxic texts at least, a stem with two endings in each, and the lower bound (one-sided, 95 %)
    of its log odds is ``least_weight`` or more; of a phrase that holds a term and is mostly in texts that are not toxic, an exception is made.
    How many terms there can be follows from ``max_rows``.
    """
    spark = labelled.sparkSession
    rows = bottom_k(labelled.filter("text is not null and toxic is not null").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")), max_rows, "doc_id", "text")
    rows = stored(rows.withColumn("h", F.xxhash64("text")).groupBy("h").agg(F.max(F.struct("toxic", "text")).alias("r")).select("r.text", "r.toxic").mapInArrow(_folded, "folded string, toxic int"))
    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    nt, nc = size.get(1, 0), size.get(0, 0)
    if not nt or not nc:
        return ToxModel({})
    odds = F.log((F.col("t") + 0.5) / (nt + 1.0)) - F.log((F.col("c") + 0.5) / (nc + 1.0))
    bound = odds - 1.64 * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    found = _both(rows.mapInArrow(_word_docs, "term string, toxic int, n long")).withColumn("w", bound).filter((F.col("t") >= least_docs) & (F.col("w") >= least_weight)).collect()
    terms, stems = chosen({r["term"]: r["w"] for r in found}, {r["term"]: r["t"] for r in found})
    spared = _both(rows.mapInArrow(_phrase_docs(frozenset(terms), frozenset(stems)), "term string, toxic int, n long")).filter("c >= 3 and c > t").collect()
    model = ToxModel(terms, sorted({r["term"] for r in spared} | {fold(e) for e in exceptions}), stems=stems)
    made = rows.select(_udf(model, spark, Matcher.of_folded, ("n", "a", "b"), (pa.int32(), pa.float64(), pa.float64()))(F.col("folded")).alias("f"), "toxic").select("f.a", "f.b", "toxic").collect()  # at most max_rows rows of three numbers
    x = np.array([[1.0, r["a"], r["b"]] for r in made])
    w = _logistic(x, np.array([float(r["toxic"]) for r in made]))
    return ToxModel(model.terms, model.exceptions, tuple(w.tolist()), model.stems)


def fit_on(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, **more) -> ToxModel:
    """Learn from the texts of ``docs`` that ``labels`` (doc_id, toxic; one row for an id) names: at most ``max_rows`` labels go out as a broadcast."""
    some = bottom_k(labels.filter("toxic is not null").select("doc_id", "toxic"), max_rows, "doc_id")
    return fit(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id"), max_rows, **more)


def _udf(model: ToxModel, spark, call, names: tuple[str, ...], kinds: tuple):
    shared = send(spark, model)
    kind = pa.struct(list(zip(names, kinds, strict=True)))
    state: dict = {}

    def run(texts: pa.Array) -> pa.Array:
        if "m" not in state:
            state["m"] = Matcher(shared.value)
        return pa.array([dict(zip(names, call(state["m"], t.as_py()), strict=True)) for t in texts], kind)

    return F.arrow_udf(run, ", ".join(f"{n} {'int' if k == pa.int32() else 'double'}" for n, k in zip(names, kinds, strict=True)))


def score(model: ToxModel, spark, text: Column) -> Column:
    """struct(n_hits, score) of each text."""
    return _udf(model, spark, Matcher.score, ("n_hits", "score"), (pa.int32(), pa.float64()))(text)
