"""A quality classifier: a sparse ensemble of rules over text statistics.

Small trees are grown on random draws of the sample; every path from a root is a rule, a conjunction
of bounds on statistics. A logistic model with a lasso penalty weighs the rules and drops most, and
what is left is compiled into one Spark expression, so scoring is a projection without user functions.

The model is fitted on the driver on at most ``SAMPLE`` labelled rows, those with the smallest hash
of their number, which bounds its memory at any size of the corpus.

Defined results: null, empty and blank texts get the score of their statistics, all zero; without
labels, with one label only, or with too few to split, the score is the share of 1 among labels, one of each added; rows with null numbers
are scored and not held out; documents with several labels count with each; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkframe.llm.quality_rules import statistics

SAMPLE, TREES, DEPTH, SEED, PENALTY, CUT = 20_000, 30, 3, 11, 2e-3, 0.3
#: Statistics that rules look at; lengths as counts, all others as ratios.
FEATURES = ("n_words", "n_lines", "mean_word_chars", "symbols_per_word", "upper_share", "stop_share", "dup_line_share", "repeat_share")


@dataclass(frozen=True)
class Model:
    intercept: float
    #: Each rule: bounds as (feature, above, value), and its weight.
    rules: tuple[tuple[tuple[tuple[int, bool, float], ...], float], ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for bounds, weight in self.rules:
            total += weight * _holds(x, bounds)
        return 1 / (1 + np.exp(-total))

    def column(self, stats: Column) -> Column:
        """The score as a Spark expression over a struct of statistics."""
        total = F.lit(self.intercept)
        for bounds, weight in self.rules:
            test = F.lit(True)
            for f, above, value in bounds:
                x = stats[FEATURES[f]].cast("double")
                test = test & (x > value if above else x <= value)
            total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _holds(x: np.ndarray, bounds) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, value in bounds:
        out &= x[:, f] > value if above else x[:, f] <= value
    return out


def _grow(x: np.ndarray, y: np.ndarray, rng, depth: int, path: tuple, out: set) -> None:
    """Split where Gini impurity falls most, among a random part of the features, and keep every path."""
    if path:
        out.add(tuple(sorted(path)))
    if depth == 0 or len(y) < 20 or y.min() == y.max():
        return
    best = (1e-9, None)
    whole = y.mean() * (1 - y.mean()) * len(y)
    for f in rng.choice(x.shape[1], max(2, x.shape[1] * 2 // 3), replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        at = np.flatnonzero(v[1:] > v[:-1]) + 1
        if not len(at):
            continue
        left, n = ones[at - 1], len(y)
        gini = left * (1 - left / at) + (ones[-1] - left) * (1 - (ones[-1] - left) / (n - at))
        k = int(np.argmin(gini))
        if whole - gini[k] > best[0]:
            best = (whole - gini[k], (int(f), float((v[at[k]] + v[at[k] - 1]) / 2)))
    if best[1] is None:
        return
    f, value = best[1]
    low = x[:, f] <= value
    _grow(x[low], y[low], rng, depth - 1, (*path, (f, False, value)), out)
    _grow(x[~low], y[~low], rng, depth - 1, (*path, (f, True, value)), out)


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY, seed: int = SEED) -> Model:
    """Rules from trees, weighed by lasso logistic regression (accelerated proximal gradient)."""
    prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))) if len(y) else 0.0
    if len(y) == 0 or y.min() == y.max():
        return Model(prior, ())
    rng, found = np.random.Generator(np.random.PCG64(seed)), set()
    for _ in range(trees):
        draw = rng.integers(0, len(y), min(len(y), 4000))
        _grow(x[draw], y[draw], rng, depth, (), found)
    rules = sorted(found)
    if not rules:  # too few rows to split
        return Model(prior, ())
    held = np.stack([_holds(x, r) for r in rules], axis=1).astype(float)
    # Rows that satisfy the same rules are one row with a weight.
    rows, back = np.unique(held, axis=0, return_inverse=True)
    back = back.ravel()
    n, ones = np.bincount(back).astype(float), np.bincount(back, weights=y)
    a = np.hstack([np.ones((len(rows), 1)), rows])
    step = 4 * len(y) / np.linalg.norm(a * np.sqrt(n)[:, None], 2) ** 2
    w = z = np.append(prior, np.zeros(len(rules)))
    t = 1.0
    for _ in range(800):
        p = 1 / (1 + np.exp(-np.clip(a @ z, -40, 40)))
        new = z - step * (a.T @ (n * p - ones)) / len(y)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return Model(float(w[0]), tuple((r, float(c)) for r, c in zip(rules, w[1:], strict=True) if c))


def remainder(number: Column) -> Column:
    return F.pmod(F.crc32(number.cast("long").cast("string").cast("binary")), F.lit(5))


def train(docs: DataFrame, labels: DataFrame, number: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """A model from labelled documents outside the held-out fifth."""
    known = labels.select(F.col(f"`{number}`").cast("long").alias("id"), F.col(f"`{label}`").cast("double").alias("y")).filter(F.col("id").isNotNull() & F.col("y").isin(0.0, 1.0) & (remainder(F.col("id")) != 0))
    chosen = known.orderBy(F.xxhash64(F.lit(SEED), "id"), "id", "y").limit(sample)
    texts = docs.select(F.col(f"`{number}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    # One text of a number, so that the sample bounds what reaches the driver.
    once = texts.join(F.broadcast(chosen.select("id").distinct()), "id", "left_semi").groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    stats = once.join(F.broadcast(chosen), "id").select("id", statistics(F.col("text")).alias("s"), "y")  # at most ``sample`` rows of two numbers
    rows = stats.select("id", *[F.col(f"s.{f}").cast("double").alias(f) for f in FEATURES], "y").toPandas().sort_values(["id", "y", *FEATURES]).drop(columns="id").to_numpy(float)
    return fit(rows[:, :-1], rows[:, -1])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs``) and ``score``."""
    from sparkframe.llm.columns import carried

    return carried(docs, s=statistics(F.col(f"`{text}`"))).select("row", model.column(F.col("s")).alias("score"))


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    scored = score(docs, train(docs, labels))
    held = F.coalesce(remainder(F.col("row.doc_id")) == 0, F.lit(False))
    return scored.select("row.doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
