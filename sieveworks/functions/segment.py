"""Dictionary segmentation of Han text: the best path through the lattice of words.

A run of Han characters is a lattice whose edges are the lexicon's words and, where a character is no
word, that character alone. A word's cost falls with its frequency, and the cheapest path, found
from right to left, is the segmentation; of equally cheap ones that with the longer word first.
Costs are whole numbers, so that every engine breaks ties alike.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import small_batches

#: Words that a lexicon may have, for each worker holds it whole.
LIMIT = 1 << 20
#: Costs are millionths of the negative log probability.
SCALE = 1_000_000
#: Runs whose segmentation a task remembers, and the longest of them.
_REMEMBERED, _SHORT = 1 << 16, 64
_PARTS = re.compile(r"[一-鿿]+|[^\W_一-鿿]+")
_HAN = re.compile(r"[一-鿿]")


def word_costs(frequencies: dict[str, int]) -> tuple[dict[str, int], int]:
    """The cost of each word, and that of a character that is none (as if it stood once)."""
    total = math.log(sum(frequencies.values()) or 1)
    return {w: round(SCALE * (total - math.log(n))) for w, n in frequencies.items() if w and n > 0}, round(SCALE * total)


def best_path(run: str, costs: dict[str, int], unknown: int, longest: int) -> list[str]:
    """The words of the cheapest path through a run."""
    n = len(run)
    best, step = [0] * (n + 1), [1] * (n + 1)
    for i in range(n - 1, -1, -1):
        best[i] = costs.get(run[i], unknown) + best[i + 1]
        for j in range(i + 2, min(n, i + longest) + 1):
            cost = costs.get(run[i:j])
            if cost is not None and cost + best[j] <= best[i]:
                best[i], step[i] = cost + best[j], j - i
    out, i = [], 0
    while i < n:
        out.append(run[i : i + step[i]])
        i += step[i]
    return out


def dictionary_tokenizer(lexicon: DataFrame, limit: int = LIMIT) -> Callable[[Column], Column]:
    """A tokenizer for `sparse.build` and `sparse.search`: text -> words of two characters or more, in order, repeats kept.

    ``lexicon``: word, freq (words that stand twice in it count together; null or empty words and
    frequencies below 1 are left out). A lexicon of more than ``limit`` words is an error. Runs of other
    letters and digits are words as they are. A null or empty text has none; runs of any length are cut whole.
    """
    known = lexicon.filter("word <> '' and freq > 0").groupBy("word").agg(F.sum("freq").cast("long").alias("freq"))
    rows = known.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"the lexicon has more than {limit} words")
    held = lexicon.sparkSession.sparkContext.broadcast(word_costs({r["word"]: r["freq"] for r in rows}))

    small_batches(lexicon.sparkSession)

    @F.pandas_udf("array<string>")
    def cut_words(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        costs, unknown = held.value
        longest = max(map(len, costs), default=1)
        known = lru_cache(_REMEMBERED)(lambda run: best_path(run, costs, unknown, longest))
        path = lambda run: known(run) if len(run) <= _SHORT else best_path(run, costs, unknown, longest)

        def words(text: str | None) -> list[str]:
            parts = _PARTS.findall(text or "")
            every = [w for p in parts for w in (path(p) if _HAN.match(p) else (p,))]
            return [w for w in every if len(w) > 1]

        for texts in series:
            yield pd.Series([words(t) for t in texts], dtype=object)

    return lambda c: cut_words(c)
