"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text is the set of its hashed character n-grams (lower case, white space as one blank). Each
feature is scaled by its log-count ratio

    r = ln((p + alpha) / |p + alpha|) - ln((q + alpha) / |q + alpha|)

where p and q count the toxic and the other training documents that have the feature, over
*all* labelled training rows, summed by Spark, and |.| stands for the documents of the class.
alpha is shared out by the classes' sizes, so that an unseen feature has a ratio of 0, and each
ratio is moved towards 0 by DOUBT times its standard error: most n-grams of rare words end there.
Logistic regression on the scaled features then learns one weight per feature from a bounded
sample of those rows (FIT_ROWS).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, held_out, small_batches

#: Lengths of the n-grams, bits of their hash, smoothing of the counts.
NGRAMS, BITS, ALPHA = (3, 4, 5), 18, 1.0
#: Standard errors that a ratio must exceed.
DOUBT = 1.5
#: Most training rows of each label that the weights are fitted on (the least by hash of the id).
FIT_ROWS = 1000
#: Bytes of text hashed at once: very long texts go through in overlapping pieces.
PIECE = 1 << 20


def features(text: str | None) -> np.ndarray:
    """The distinct hashed n-grams of a whole text, sorted."""
    clean = " " + " ".join((text or "").lower().split()) + " "
    seen = np.zeros(1 << BITS, dtype=bool)
    for at in range(0, len(clean), PIECE):
        x = np.frombuffer(clean[at : at + PIECE + max(NGRAMS) - 1].encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        h = np.zeros(len(x), dtype=np.uint64)
        for n in range(1, max(NGRAMS) + 1):
            if len(x) < n:
                break
            h = (h[: len(x) - n + 1] + x[n - 1 :] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            if n in NGRAMS:
                seen[h >> np.uint64(64 - BITS)] = True
    return np.flatnonzero(seen)


@dataclass(frozen=True)
class Model:
    """score = sigmoid(bias + the sum of the weights of a text's features)."""

    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        z = self.bias + float(self.weights[features(text)].sum())
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))))


def _training(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic, rank: labelled documents outside the held-out fold.

    Null ids and labels teach nothing; of labels of one doc_id that contradict each other the
    greatest holds. Texts and labels meet in a sort-merge join at every size.
    """
    known = labels.select("doc_id", "toxic").filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(~held_out(F.col("doc_id"))).hint("merge")
    own = docs.select("doc_id", "text").filter(~held_out(F.col("doc_id")))
    return own.join(known, "doc_id").select("text", "toxic", F.xxhash64("doc_id").alias("rank"))


def log_count_ratios(training: DataFrame) -> np.ndarray:
    """Log-count ratio of every feature, from the document counts of all training rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros((2, 1 << BITS), dtype=np.int64)
        for b in batches:
            for text, toxic in zip(b["text"], b["toxic"], strict=True):
                n[int(toxic > 0), features(text)] += 1
        hit = np.flatnonzero(n.sum(axis=0))
        yield pd.DataFrame({"feature": hit, "p": n[1, hit], "q": n[0, hit]})

    counts = training.select("text", "toxic").mapInPandas(count, "feature long, p long, q long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    got = counts.toPandas()  # 2**BITS rows at most
    toxic, other = training.agg(F.count_if(F.col("toxic") > 0), F.count_if(F.col("toxic") <= 0)).first()
    if not toxic or not other:
        return np.zeros(1 << BITS)
    alpha = 2 * ALPHA * np.array([toxic, other]) / (toxic + other)
    p, q = np.full(1 << BITS, alpha[0]), np.full(1 << BITS, alpha[1])
    p[got["feature"]] += got["p"]
    q[got["feature"]] += got["q"]
    r = np.log(p / (toxic + 2 * alpha[0])) - np.log(q / (other + 2 * alpha[1]))
    return np.sign(r) * np.maximum(0.0, np.abs(r) - DOUBT * np.sqrt(1 / p + 1 / q))


def _sample_rows(training: DataFrame) -> list[tuple[np.ndarray, int, float]]:
    """Features of at most FIT_ROWS training rows of each label, the label, and how many rows each stands for."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"features": [features(t).astype(np.int32).tobytes() for t in b["text"]]})

    out = []
    for toxic in (True, False):
        own = training.filter((F.col("toxic") > 0) == toxic)
        # the ranks alone are sorted: texts of other rows don't meet anywhere
        edge = own.select("rank").orderBy("rank").limit(FIT_ROWS).agg(F.max("rank")).first()[0]
        some = own.filter(F.col("rank") <= F.lit(edge)).limit(FIT_ROWS).select("text")
        rows = [np.frombuffer(r["features"], dtype=np.int32) for r in some.mapInPandas(read, "features binary").toLocalIterator()]
        every = own.count()
        out += [(f, int(toxic), every / len(rows)) for f in rows]
    return out


def fit(docs: DataFrame, labels: DataFrame, rounds: int = 300, rate: float = 1.0, decay: float = 1e-6) -> Model:
    """Learn from the labelled documents outside the held-out fold.

    Sampled rows weigh as many rows as they stand for, so that a score of 0.5 means the same
    whatever the sample. Without training rows of both labels, as of empty tables, every text scores 0 (none is known
    to be toxic). Repeated rows count as often as they stand, texts are read whole, and columns other than doc_id,
    text and toxic are not looked at.
    """
    small_batches(docs.sparkSession)
    training = cut(_training(docs, labels))  # texts meet their labels once
    ratios = log_count_ratios(training)
    sampled = _sample_rows(training)
    y, weight = np.array([t for _, t, _ in sampled], dtype=np.float64), np.array([w for *_, w in sampled])
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << BITS, dtype=np.float32), -500.0)
    weight /= weight.sum()
    # compressed sparse rows of the features that tell anything, scaled so that rows have a norm near 1
    rows = [f[ratios[f] != 0] for f, *_ in sampled]
    index, owner = np.concatenate(rows), np.repeat(np.arange(len(rows), dtype=np.int32), [len(f) for f in rows])
    norms = np.bincount(owner, ratios[index] ** 2, len(rows))
    scale = 1.0 / np.sqrt(max(1e-9, float(norms.mean())))
    value = ratios[index] * scale
    w, b, gw, gb = np.zeros(1 << BITS), 0.0, np.full(1 << BITS, 1e-12), 1e-12
    for _ in range(rounds):  # AdaGrad on the whole sample
        z = np.bincount(owner, value * w[index], len(rows)) + b
        err = (1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))) - y) * weight
        g = np.bincount(index, value * err[owner], 1 << BITS) + decay * w
        gw += g * g
        gb += err.sum() ** 2
        w -= rate * g / np.sqrt(gw)
        b -= rate * err.sum() / np.sqrt(gb)
    return Model((w * ratios * scale).astype(np.float32), float(b))


def scorer(spark: SparkSession, model: Model) -> Callable[[str], Column]:
    """The model as a column function of a text column (0 to 1)."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # 2**BITS floats

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in texts], dtype=np.float64)

    return score


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, a row per row of ``docs``; null and empty texts score as empty ones.

    Texts of any length are scored whole and equal ones alike; an empty table gives no rows.
    """
    return docs.select("doc_id", scorer(docs.sparkSession, model)("text").alias("score"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    return docs.filter(scorer(docs.sparkSession, model)("text") < threshold)
