"""Mixing sources to target weights with soft membership.

A classifier learned from a labelled table gives each document a probability for each domain. Rates r >= 0 are then
fitted so that the expected tokens of each domain, sum of r * tokens * probability, meet a target: projected-gradient
least squares, where each step is one aggregation of as many sums as there are domains. In the metric of the
documents' lengths, with the inverse of the domains' Gram matrix as weights, the largest eigenvalue is 1, so steps of 1 converge.
A document's rate is one fold of its probabilities over a constant array of the steps so far: nothing is joined, no lineage grows, and all
steps have one plan and one generated code, so that the driver holds no more after many steps than after one.

Defined results: NULL and empty texts have 0 tokens and get the rate of their probabilities, which adds no tokens; without labelled rows all
belong to the first domain; a domain without any probability keeps its target unmet, and targets that no rates reach end at the least squares; a fit that has not
settled after the steps allowed is an error; very long texts count whole; an empty table gives an empty result; repeated
rows each get the same rate. Other columns are never read.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelworks.llm.common import bottom_k, fresh, stored

WORDS = "mix_words"
FEATURES = "mix_features"


@dataclass(frozen=True)
class Domains:
    """A fitted classifier. ``known``: the domains that it has seen, in the order of its classes."""

    names: list[str]
    known: list[str]
    model: LogisticRegressionModel | None
    features: int

    def with_posteriors(self, df: DataFrame, text: str = "text", n: str = "n_tokens", p: str = "posterior") -> DataFrame:
        """``df`` with its texts' word counts and an array of probabilities by domain."""
        words, features, prob, raw = (fresh(x, df) for x in (WORDS, FEATURES, "mix_p", "mix_raw"))
        df = _words(df, text, words).withColumn(n, F.size(words).cast("long"))
        if self.model is None:
            one = self.known[0] if self.known else self.names[0]
            return df.withColumn(p, F.array(*[F.lit(float(x == one)) for x in self.names])).drop(words)
        out = HashingTF(numFeatures=self.features, binary=True, inputCol=words, outputCol=features).transform(df)
        model = self.model.setFeaturesCol(features).setProbabilityCol(prob).setRawPredictionCol(raw).setPredictionCol("")
        out = model.transform(out).withColumn(prob, vector_to_array(prob))
        return out.withColumn(p, F.array(*[F.col(prob)[self.known.index(x)] if x in self.known else F.lit(0.0) for x in self.names])).drop(words, features, prob, raw)


def _words(df: DataFrame, text: str, words: str = WORDS) -> DataFrame:
    return df.withColumn(words, F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def fit_domains(docs: DataFrame, labels: DataFrame, names: Sequence[str], max_rows: int = 20_000, features: int = 1 << 15, steps: int = 25, l2: float = 0.002) -> Domains:
    """Learn from the texts of ``docs`` (doc_id, text) that ``labels`` (doc_id, domain) names: at most ``max_rows`` ids, sent out as a broadcast."""
    known = labels.filter(F.col("domain").isin(list(names)) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    some = F.broadcast(bottom_k(known, max_rows, "doc_id"))
    rows = docs.select("doc_id", "text").join(some, "doc_id").select("text", "domain")
    rows = stored(HashingTF(numFeatures=features, binary=True, inputCol=WORDS, outputCol=FEATURES).transform(_words(rows, "text")).select("domain", FEATURES))
    found = {r["domain"] for r in rows.select("domain").distinct().collect()}
    seen = [x for x in names if x in found]
    if len(seen) < 2:
        return Domains(list(names), seen, None, features)
    label = F.lit(None).cast("double")
    for i, x in enumerate(seen):
        label = F.when(F.col("domain") == x, float(i)).otherwise(label)
    model = LogisticRegression(featuresCol=FEATURES, labelCol="label", family="multinomial", maxIter=steps, regParam=l2, standardization=False).fit(rows.withColumn("label", label))
    return Domains(list(names), seen, model, features)


@dataclass(frozen=True)
class Rates:
    names: list[str]
    targets: list[float]
    totals: list[float]  # expected tokens under the fitted rates
    steps: list[list[float]] = field(default_factory=list)  # what each step takes off, by domain

    def rate(self, p: str = "posterior") -> Column:
        """Start from 1; each step moves along the gradient, and negative rates go back to 0."""
        return _rate(self.steps, p)


def _rate(steps: list[list[float]], p: str) -> Column:
    if not steps:
        return F.lit(1.0)

    def after(r: Column, step: Column) -> Column:
        down = F.lit(0.0)
        for d in range(len(steps[0])):
            down = down + F.col(p)[d] * step[d]
        return F.greatest(F.lit(0.0), r - down)

    return F.aggregate(F.from_json(F.lit(json.dumps(steps)), "array<array<double>>"), F.lit(1.0), after)


def fit_rates(rows: DataFrame, names: Sequence[str], shares: dict[str, float], total: float = 1.0, n: str = "n_tokens", p: str = "posterior", most: int = 100, tolerance: float = 1e-6) -> Rates:
    """Fit rates to ``rows`` (tokens, probabilities). Targets: ``shares`` of ``total`` times the tokens of all rows.

    The fit has settled when the targets are met to ``tolerance`` of all tokens, or the sums of a step are those of the one before to a hundredth of that.
    A fit that hasn't after ``most`` steps raises an error.
    """
    k = len(names)
    at = [F.col(p)[d] for d in range(k)]
    first = rows.agg(F.sum(n).alias("all"), *[F.sum(F.col(n) * at[a] * at[b]).alias(f"g{a}_{b}") for a in range(k) for b in range(a, k)]).first()
    size = float(first["all"] or 0)
    gram = np.array([[float(first[f"g{min(a, b)}_{max(a, b)}"] or 0) for b in range(k)] for a in range(k)])
    weight = sum(shares.get(x, 0.0) for x in names) or 1.0
    targets = np.array([shares.get(x, 0.0) / weight * total * size for x in names])
    inverse = np.linalg.pinv(gram + np.eye(k) * 1e-9 * max(size, 1.0))
    steps: list[list[float]] = []
    before, name = None, fresh("r", rows)
    while True:
        got = rows.withColumn(name, _rate(steps, p)).agg(*[F.sum(F.col(n) * at[d] * F.col(name)).alias(f"s{d}") for d in range(k)]).first()
        sums = np.array([float(x or 0) for x in got])
        move = inverse @ (sums - targets)
        settled = before is not None and np.abs(sums - before).max() <= 0.01 * tolerance * size
        if size == 0 or settled or np.abs(sums - targets).max() <= tolerance * size or np.abs(move).max() < 1e-9:
            return Rates(list(names), targets.tolist(), sums.tolist(), steps)
        if len(steps) >= most:
            raise RuntimeError(f"rates have not settled after {most} steps: {dict(zip(names, sums.tolist(), strict=True))} tokens for {dict(zip(names, targets.tolist(), strict=True))}")
        before = sums
        steps.append(move.tolist())


def copies(rate: Column, key: Column, seed: int = 7) -> Column:
    """Whole copies whose mean over documents is the rate: its floor, and one more with the chance of the rest, by the key's hash."""
    u = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("long")).cast("long")


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of a table of quality and toxic marks: toxic, high or low; of several rows for an id the worse counts."""
    one = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    return one.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").otherwise("low").alias("domain"))


def mix(docs: DataFrame, labels: DataFrame, shares: dict[str, float], total: float = 1.0) -> tuple[DataFrame, Domains, Rates]:
    """(doc_id, n_tokens, posterior, rate) of each row of ``docs`` (doc_id, text); and the two models, to apply them to other columns."""
    names = list(shares)
    domains = fit_domains(docs, labels, names)
    rows = stored(domains.with_posteriors(docs.select("doc_id", "text")).select("doc_id", "n_tokens", "posterior"))
    rates = fit_rates(rows, names, shares, total)
    return rows.withColumn("rate", rates.rate()), domains, rates
