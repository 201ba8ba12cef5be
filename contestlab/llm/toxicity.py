"""Toxicity by multiple-instance learning (operator 6).

Only documents carry labels. Each sentence gets the probability sigmoid(bias + sum of the weights of its features), and a document is
toxic if any sentence is: 1 - prod(1 - p), the noisy-or. The weights are fitted to the documents' labels through the noisy-or,
so they tell which sentences offend. Features are lower-cased words and the beginnings of words.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import private_name, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The fit reads about this many labelled documents of each class (all, if there are fewer), picked by a hash of the id.
SAMPLE_PER_CLASS = 6000
#: Most features in the model; documents that a feature must occur in; how much more often it must occur in toxic ones.
FEATURES, LEAST_DOCS, LEAST_RATIO = 2000, 4, 2.5
PREFIXES = (4, 5, 6, 7)
THRESHOLD = 0.7
WORDS = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n\r]+")


def features_of(word: str) -> list[str]:
    return [word, *[word[:n] + "*" for n in PREFIXES if len(word) > n]]


def _document_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        found = (Counter(), Counter())
        for text, y in zip(frame["text"], frame["y"]):
            found[y].update({f for w in set(WORDS.findall(text.lower())) for f in features_of(w)})
        for y in (0, 1):
            yield pd.DataFrame({"feature": list(found[y]), "y": y, "n": list(found[y].values())}).astype({"y": "int32", "n": "int64"})


class ToxicityModel:
    """shift: added to the score's log-odds, so that the best cut comes to stand at THRESHOLD."""

    def __init__(self, weights: dict[str, float], bias: float, shift: float = 0.0):
        self.weights, self.bias, self.shift = weights, bias, shift
        self.starts = {f.rstrip("*")[:PREFIXES[0]] for f in weights}

    def sentence_features(self, text: str) -> tuple[int, list[tuple[str, list[str]]]]:
        """The number of sentences with words, and (sentence, known features) of those that have any."""
        n, found, starts, size, known = 0, [], self.starts, PREFIXES[0], self.weights
        for sentence in SENTENCE.split(text):
            words = WORDS.findall(sentence.lower())
            if words:
                n += 1
                own = [f for w in words if w[:size] in starts for f in features_of(w) if f in known]
                if own:
                    found.append((sentence, own))
        return n, found

    def sentences(self, text: str | None) -> tuple[float, list[tuple[str, float]]]:
        """(document's score, [(sentence, its probability)] of sentences with known features)."""
        n, found = self.sentence_features(text or "")
        z = np.array([self.bias + sum(self.weights[f] for f in set(own)) for _, own in found])
        left = (n - len(found)) * np.log1p(np.exp(self.bias)) + np.logaddexp(0, z).sum()
        p = -np.expm1(-left)
        score = p / (p + (1 - p) * np.exp(-self.shift)) if p > 0 else 0.0
        return float(score), [(s, float(x)) for (s, _), x in zip(found, 1 / (1 + np.exp(-z)))]


def _bags(vocabulary: list[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = ToxicityModel(dict.fromkeys(vocabulary, 0.0), 0.0)
        place = {f: k for k, f in enumerate(vocabulary)}
        for frame in frames:
            rows = []
            for text, y, weight in zip(frame["text"], frame["y"], frame["weight"]):
                n, found = model.sentence_features(text)
                rows.append((y, weight, n - len(found), [[place[f] for f in sorted(set(own))] for _, own in found]))
            yield pd.DataFrame(rows, columns=["y", "weight", "plain", "bags"])

    return run


def fit_noisy_or(y, weight, plain, bags, n_features: int, steps: int = 600, ridge: float = 2e-5) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the documents' log-loss through the noisy-or (Adam on the whole sample)."""
    y, weight, plain = (np.asarray(x, float) for x in (y, weight, plain))
    doc = np.array([d for d, own in enumerate(bags) for _ in own], np.int64)
    sentence = np.array([s for s, bag in enumerate(b for own in bags for b in own) for _ in bag], np.int64)
    feature = np.array([f for own in bags for bag in own for f in bag], np.int64)
    weight = weight / max(weight.sum(), 1e-9)
    theta = np.append(np.full(n_features, 0.5), -5.0)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        z = theta[-1] + np.bincount(sentence, theta[feature], len(doc))
        total = plain * np.logaddexp(0, theta[-1]) + np.bincount(doc, np.logaddexp(0, z), len(y))
        total = np.clip(total, 1e-9, 500)
        slope = weight * np.where(y > 0.5, -1 / np.expm1(total), 1.0)
        dz = slope[doc] / (1 + np.exp(-z))
        grad = np.append(np.bincount(feature, dz[sentence], n_features), dz.sum() + (slope * plain).sum() / (1 + np.exp(-theta[-1])))
        grad[:-1] += ridge * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def noisy_or(plain, bags, weights: np.ndarray, bias: float) -> np.ndarray:
    return np.array([-np.expm1(-(n * np.logaddexp(0, bias) + sum(np.logaddexp(0, bias + weights[bag].sum()) for bag in own))) for n, own in zip(plain, bags)])


def best_cut(y, weight, score) -> float:
    """The cut of the score that gives the best F1, midway between the two scores around it."""
    order = np.argsort(-score, kind="stable")
    y, weight, score = np.asarray(y)[order], np.asarray(weight)[order], score[order]
    hits, taken, all_hits = np.cumsum(weight * y), np.cumsum(weight), (weight * y).sum()
    f1 = np.where(np.append(score[1:], -1) < score, 2 * hits / (taken + all_hits), 0)
    k = int(f1.argmax())
    return float(np.clip((score[k] + (score[k + 1] if k + 1 < len(score) else 0)) / 2, 1e-4, 0.9999))


def fit(docs: DataFrame, labels: DataFrame | None = None, text: str = "text", label: str = "toxic", doc_id: str = "doc_id", per_class: int = SAMPLE_PER_CLASS) -> ToxicityModel:
    """A model from documents and labels (0 or 1); without `labels` the label is a column of `docs`.

    Rows without text or label are left out; a document labelled more than once takes its largest label. Without both classes every
    score is near 0. Only ids meet the labels in a shuffle; the texts of the picked ones, a sample of bounded size, are then read by
    a broadcast of their ids. What reaches the driver is bounded by the sample's size and the number of features.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), *([] if labels is not None else [F.col(label).cast("int").alias("y")])).where("text is not null")
    if labels is None:
        known = rows.select("id", "y")
    else:
        known = rows.select("id").join(labels.groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("int").alias("y")), "id")
    known = written(known.where("y in (0, 1)"))
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return ToxicityModel({}, -20.0)
    share = {y: min(1.0, per_class / n) for y, n in sizes.items()}
    mark = F.conv(F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    of: Column = F.when(F.col("y") == 1, share[1]).otherwise(share[0])
    if labels is None:
        sample = rows.where("y in (0, 1)").where(mark < of)
    else:
        sample = rows.join(F.broadcast(known.where(mark < of).distinct()), "id")
    sample = written(sample.select("text", "y", (1 / of).alias("weight")))
    n = {y: max(1.0, sizes[y] * share[y]) for y in (0, 1)}
    counts = sample.select("text", "y").mapInPandas(_document_counts, "feature string, y int, n long").groupBy("feature").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("clean"))
    ratio = ((F.col("toxic") + 0.5) / n[1]) / ((F.col("clean") + 0.5) / n[0])
    chosen = counts.where((F.col("toxic") >= LEAST_DOCS) & (ratio >= LEAST_RATIO)).orderBy(F.desc(F.col("toxic") * F.log(ratio)), "feature").limit(FEATURES)
    vocabulary = sorted(r.feature for r in chosen.select("feature").collect())
    bags = sample.mapInPandas(_bags(vocabulary), "y int, weight double, plain int, bags array<array<int>>").collect()
    bags.sort(key=lambda r: (r.y, r.weight, r.plain, r.bags))  # sums don't depend on the order in which tasks end
    y, weight, plain, own = ([r[k] for r in bags] for k in range(4))
    weights, bias = fit_noisy_or(y, weight, plain, own, len(vocabulary))
    # where to cut is told by documents that the weights were not fitted to
    unseen = np.zeros(len(bags))
    for part in range(3):
        here, rest = [k for k in range(len(bags)) if k % 3 == part], [k for k in range(len(bags)) if k % 3 != part]
        w, b = fit_noisy_or(*([x[k] for k in rest] for x in (y, weight, plain, own)), len(vocabulary), steps=300)
        unseen[here] = noisy_or([plain[k] for k in here], [own[k] for k in here], w, b)
    cut = best_cut(y, weight, unseen)
    return ToxicityModel(dict(zip(vocabulary, weights.tolist())), bias, float(np.log(THRESHOLD / (1 - THRESHOLD)) - np.log(cut / (1 - cut))))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with score, predicted (1 from `threshold` on) and offending: the sentences of probability 0.5 or more, worst first.

    Columns of these names are replaced. Null and empty texts have no sentences: score 0, predicted 0. Sentences of equal probability
    stay in the text's order. Repeated rows come back repeated, an empty table gives an empty result.
    """
    held, made = docs.sparkSession.sparkContext.broadcast(vars(model)), private_name("toxic")

    def batch(texts: pd.Series) -> pd.DataFrame:
        own, rows = object.__new__(ToxicityModel), []
        vars(own).update(held.value)
        for x in texts:
            score, found = own.sentences(x)
            rows.append((score, [{"sentence": s.strip(), "p": p} for s, p in sorted(found, key=lambda f: -f[1]) if p >= 0.5]))
        return pd.DataFrame(rows, columns=["score", "offending"])

    out = docs.withColumn(made, F.pandas_udf(batch, "score double, offending array<struct<sentence:string,p:double>>")(F.col(text)))
    out = out.withColumn("score", F.col(f"{made}.score")).withColumn("offending", F.col(f"{made}.offending")).drop(made)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
