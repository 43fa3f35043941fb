"""Toxicity categories by a classifier chain.

The categories are judged one after the other by logistic models on the presence of words and two plain measures of the
text; each model also gets the probabilities of the categories before it. For the training of the later models these
are out-of-fold predictions, so that they are as uncertain as they will be on new documents.

The models are fitted on the driver from at most `sample` labelled documents, those with the smallest hash of their id;
everything else covers all documents.

Defined results: a null text is judged as the empty one. Label rows with a null id or a null category aren't used; of
repeated ones with one id the largest values count. Where no labelled document is left, or a category has one value
only, its probability is that constant (0 without any). Rows and other columns pass through one for one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written
from .decontamination import words_of

SAMPLE, FEATURES, LEAST, FOLDS, DENSE = 6_000, 2_048, 3, 5, 2
#: Standard deviations by which a word's rate must differ for a category's model to use it.
TOLD = 4.5
CATEGORIES = ("quality", "toxic")


def _dense(text: bytes, words: list[bytes]) -> tuple[float, float]:
    """Length, and the part of the text that isn't words; both about 0 to 1."""
    return math.log1p(len(words)) / 10, 1 - sum(map(len, words)) / max(len(text), 1)


class Chain:
    def __init__(self, categories: tuple[str, ...], words: list[str], told: list[list[bool]] | None = None):
        """told: for each word, the categories whose models use it; all by default."""
        self.categories = categories
        self.told = np.array(told or [[True] * len(categories)] * len(words), bool).reshape(len(words), len(categories))
        self.index = {w.encode(): k for k, w in enumerate(words)}
        self.size = len(words) + DENSE
        self.models: list[np.ndarray] = []

    def features(self, text: bytes | None) -> tuple[list[int], tuple[float, float]]:
        text = text or b""
        words = words_of(text)
        return [self.index[w] for w in self.index.keys() & set(words)], _dense(text, words)

    def predict(self, text: bytes | None) -> list[float]:
        where, dense = self.features(text)
        known: list[float] = []
        for w in self.models:
            z = w[-1] + w[where].sum() + float(np.dot(w[self.size - DENSE : self.size], dense)) + float(np.dot(w[self.size : -1], known))
            known.append(float(_sigmoid(z)))
        return known

    def fit(self, texts: list[tuple[list[int], tuple[float, float]]], labels: np.ndarray) -> None:
        """labels: a row for each document, a column for each category."""
        n = len(texts)
        rows = np.repeat(np.arange(n), [len(x[0]) for x in texts])
        cols = np.array([c for x in texts for c in x[0]], np.int64)
        dense = np.array([x[1] for x in texts], float).reshape(n, DENSE)
        fold = np.arange(n) % FOLDS
        for k in range(len(self.categories)):
            y = labels[:, k].astype(float)
            self.models.append(self._model(rows, cols, dense, y, np.ones(n, bool), self.told[:, k]))
            if k + 1 < len(self.categories):
                guess = np.zeros(n)
                for f in range(FOLDS):
                    if (fold == f).any():
                        w = self._model(rows, cols, dense, y, fold != f, self.told[:, k])
                        guess[fold == f] = _sigmoid(_scores(w, rows, cols, dense, self.size, n))[fold == f]
                dense = np.column_stack([dense, guess])

    def _model(self, rows, cols, dense, y, use, told, steps: int = 200, rate: float = 0.1, ridge: float = 0.3) -> np.ndarray:
        """Weights of words, then of dense columns, then the intercept; by Adam on the mean loss of both classes alike."""
        n, extra = len(y), dense.shape[1] - DENSE
        w = np.zeros(self.size + extra + 1)
        positive, negative = float(y[use].sum()), float((1 - y[use]).sum())
        if not positive or not negative:
            w[-1] = 50.0 if positive else -50.0
            return w
        weight = np.where(y > 0, math.sqrt(negative / positive), 1.0) * use
        m, v = np.zeros_like(w), np.zeros_like(w)
        keep = told[cols]
        rows, cols = rows[keep], cols[keep]
        at = slice(self.size - DENSE, self.size + extra)
        for t in range(1, steps + 1):
            error = weight * (_sigmoid(_scores(w, rows, cols, dense, self.size, n)) - y)
            g = ridge * w
            g[-1] = error.sum()
            g[: self.size - DENSE] += np.bincount(cols, error[rows], self.size - DENSE)[: self.size - DENSE]
            g[at] += dense.T @ error
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        return w


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _scores(w, rows, cols, dense, size, n) -> np.ndarray:
    return np.bincount(rows, w[cols], n) + dense @ w[size - DENSE : size - DENSE + dense.shape[1]] + w[-1]


def fit(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, features: int = FEATURES) -> Chain:
    """The chain, learned from at most `sample` labelled documents and at most `features` words that tell most."""
    chosen = labels.select(F.col(doc_id).alias("id"), *[F.col(c).cast("double").alias(f"y{k}") for k, c in enumerate(categories)]).dropna()
    chosen = chosen.groupBy("id").agg(*[F.max(f"y{k}").alias(f"y{k}") for k in range(len(categories))])
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(doc_id).alias("id"), F.encode(F.col(text), "utf-8").alias("text"))
    known = written(texts.join(F.broadcast(chosen), "id").groupBy("id", *chosen.columns[1:]).agg(F.max("text").alias("text")), "labelled")
    totals = known.agg(F.count("*").alias("n"), *[F.sum(f"y{k}").alias(f"y{k}") for k in range(len(categories))]).first()
    n = totals["n"]
    if not n:
        chain = Chain(categories, [])
        chain.models = [np.array([0.0] * (DENSE + k) + [-50.0]) for k in range(len(categories))]
        return chain

    @F.arrow_udf("array<string>")
    def distinct_words(texts: pa.Array) -> pa.Array:
        return pa.array([sorted({w.decode("utf-8", "replace") for w in words_of(x.as_py())}) for x in texts], pa.list_(pa.string()))

    rates = [totals[f"y{k}"] / n for k in range(len(categories))]
    told = F.array(*[F.abs(F.col(f"s{k}") - F.col("df") * r) / F.sqrt(F.col("df") * r * (1 - r) + 1) for k, r in enumerate(rates)])
    seen = known.select(F.explode(distinct_words("text")).alias("w"), *chosen.columns[1:]).groupBy("w")
    best = seen.agg(F.count("*").alias("df"), *[F.sum(f"y{k}").alias(f"s{k}") for k in range(len(categories))]).where(F.col("df") >= LEAST)
    best = best.select("w", told.alias("told")).where(F.array_max("told") >= TOLD).orderBy(F.desc(F.array_max("told")), "w").limit(features).collect()
    chain = Chain(categories, [r["w"] for r in best], [[x >= TOLD for x in r["told"]] for r in best])

    @F.arrow_udf("struct<at: array<int>, dense: array<double>>")
    def extract(texts: pa.Array) -> pa.Array:
        got = [chain.features(x.as_py()) for x in texts]
        return pa.array([{"at": sorted(a), "dense": list(d)} for a, d in got], pa.struct([("at", pa.list_(pa.int32())), ("dense", pa.list_(pa.float64()))]))

    rows = known.select("id", extract("text").alias("x"), *chosen.columns[1:]).collect()
    rows.sort(key=lambda r: r["id"])
    chain.fit([(r["x"]["at"], tuple(r["x"]["dense"])) for r in rows], np.array([[r[f"y{k}"] for k in range(len(categories))] for r in rows]))
    return chain


def scored(docs: DataFrame, chain: Chain, into: str, text: str = "text") -> DataFrame:
    """docs with an array column named into: the probability of each category, in the chain's order."""

    @F.arrow_udf("array<double>")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([chain.predict(x.as_py()) for x in texts], pa.list_(pa.float64()))

    return docs.withColumn(into, score(F.encode(F.col(text), "utf-8")))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = fit(docs, table(spark, sf_dir, "labels"))
    out = scored(docs, chain, "p")
    return out.select("doc_id", *[F.col("p")[k].alias(f"p_{c}") for k, c in enumerate(chain.categories)], (F.col("p")[len(chain.categories) - 1] >= 0.5).alias("is_toxic"))
