"""Language identification by rank-order profiles of character n-grams.

A profile lists the TOP most frequent n-grams of 1 to 3 characters, most frequent first (equal
counts: by code). A document's own profile is held against each language's: every n-gram adds
its out-of-place distance, how far its ranks lie apart, or TOP where the language lacks it.
The language with the least sum wins (ties: the first by name).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import held_out, small_batches

#: N-grams in a profile, longest n-gram, characters counted at once.
TOP, LONGEST, PIECE = 300, 3, 1 << 20
UNKNOWN = "und"
#: Distinct n-grams that a task holds before it hands its counts on.
HELD = 1_000_000


def _letters() -> np.ndarray:
    """For each code point its lower-case form if it is a letter, else 0."""
    out = np.zeros(0x110000, dtype=np.int64)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_TABLE: list[np.ndarray] = []


def _codes(text: str) -> np.ndarray:
    """Code points of ``text``, letters in lower case, 0 for anything else."""
    if not _TABLE:
        _TABLE.append(_letters())
    return _TABLE[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]


def ngram_counts(text: str | None, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a whole text (three code points of 21 bits in a code) and their counts.

    Words stand between single zeros, which n-grams of two and three may take in. Long texts
    go through in pieces, and each piece begins with the last two codes of the one before: no
    n-gram is lost or made up at its edge.
    """
    codes, counts = [], []
    tail, text = np.zeros(1, dtype=np.int64), text or ""
    for at in range(0, len(text), piece):
        y = _codes(text[at : at + piece])
        y = np.concatenate((y, [0])) if at + piece >= len(text) else y
        y = y[(y != 0) | (np.concatenate((tail[-1:], y[:-1])) != 0)]  # one 0 between words
        x, n = np.concatenate((tail, y)), len(tail)
        two = ((x[:-1] << 21) | x[1:])[n - 1 :]  # those that end in the new part
        two = two[(x[n - 1 : -1] != 0) | (x[n:] != 0)]
        a, b, c = x[max(0, n - 2) : -2], x[max(1, n - 1) : -1], x[max(2, n) :]
        three = ((a << 42) | (b << 21) | c)[b != 0]
        got, times = np.unique(np.concatenate((y[y != 0], two | (1 << 62), three)), return_counts=True)
        codes.append(got)
        counts.append(times)
        tail = x[-2:]
    if len(codes) < 2:
        return (codes[0], counts[0]) if codes else (np.empty(0, np.int64), np.empty(0, np.int64))
    c, where = np.unique(np.concatenate(codes), return_inverse=True)
    return c, np.bincount(where, np.concatenate(counts)).astype(np.int64)


def profile(text: str | None) -> np.ndarray:
    """The TOP n-grams of a text, most frequent first; empty without letters."""
    codes, counts = ngram_counts(text)
    return codes[np.lexsort((codes, -counts))[:TOP]]


def learn_profiles(docs: DataFrame) -> dict[str, np.ndarray]:
    """Profile of each language, from all documents outside the held-out fold with a language.

    Counts are summed by Spark; TOP rows per language reach the driver. Repeated rows count as often
    as they stand, grams of equal counts go by their code, an empty table gives no profile, and columns other than
    doc_id, text and lang are not looked at.
    """
    small_batches(docs.sparkSession)
    training = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("text", "lang")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, dict[int, int]] = {}

        def flush() -> Iterator[pd.DataFrame]:
            for lang, grams in held.items():
                yield pd.DataFrame({"lang": lang, "gram": np.fromiter(grams, np.int64, len(grams)), "n": np.fromiter(grams.values(), np.int64, len(grams))})
            held.clear()

        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                parts = [ngram_counts(t) for t in texts]
                codes, where = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                sums = np.bincount(where, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)
                own = held.setdefault(lang, {})
                for c, n in zip(codes.tolist(), sums.tolist(), strict=True):
                    own[c] = own.get(c, 0) + n
            if sum(map(len, held.values())) > HELD:
                yield from flush()
        yield from flush()

    counts = training.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("rank", rank).filter(F.col("rank") <= TOP).orderBy("lang", "rank").toPandas()
    return {lang: g["gram"].to_numpy() for lang, g in top.groupby("lang", sort=True)}


def by_gram(profiles: dict[str, np.ndarray]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Each profile as its n-grams in ascending order and their ranks."""
    return {lang: (np.sort(grams), np.argsort(grams)) for lang, grams in sorted(profiles.items())}


def distances(own: np.ndarray, ranked: dict[str, tuple[np.ndarray, np.ndarray]]) -> dict[str, float]:
    """Mean out-of-place distance to each language, as a share of the greatest possible (0 to 1)."""
    ranks, out = np.arange(len(own)), {}
    for lang, (grams, order) in ranked.items():
        at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
        same = grams[at] == own
        out[lang] = float(np.where(same, np.abs(order[at] - ranks), TOP).mean() / TOP)
    return out


def identify(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score: a row per row of ``docs``.

    ``score`` is 1 less the mean out-of-place distance to the language named. A text that is
    null or has no letter is ``und`` with score 0, as is every text if no profile was learned.
    Texts of any length are counted whole, equal texts have equal rows (of languages equally near the first by name is
    named), an empty table gives no rows, and other columns are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(by_gram(profiles))  # TOP numbers per language

    def one(text: str | None) -> tuple[str, float]:
        own = profile(text)
        far = distances(own, shared.value) if len(own) else {}
        best = min(far, key=far.__getitem__, default=None)  # in order of names
        return (UNKNOWN, 0.0) if best is None else (best, 1.0 - far[best])

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        got = [one(t) for t in texts]
        return pd.DataFrame({"lang_pred": pd.Series([g[0] for g in got], dtype=object), "score": np.array([g[1] for g in got], dtype=np.float64)})

    return docs.select("doc_id", predict("text").alias("x")).select("doc_id", "x.lang_pred", "x.score")
