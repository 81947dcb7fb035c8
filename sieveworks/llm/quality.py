"""Quality rules: decision lists learned from labelled statistics (DataFrame functions only).

`text_statistics` counts what rules look at, in one scan and without a shuffle. `learn_rules`
covers the labelled low-quality documents rule by rule. A rule grows on one part of the labelled
rows, condition by condition (statistic above or up to a threshold, by information gain), is
pruned back to the prefix that does best on the other part, and the rows it covers leave before the
next one is grown, until no rule is precise enough there. All counts come from histograms that
Spark makes of all labelled rows; the driver sees a histogram, never a row. `verdict` writes
the list as one ordered conditional expression.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Words of a window; a document's least words, and the most of its words (in percent) in windows that recur.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Thresholds tried for a statistic at most, conditions of a rule, rules of a list.
THRESHOLDS, CONDITIONS, RULES = 64, 3, 16
#: What a rule must reach on the rows it is pruned on: documents covered, and the share of them that are of low quality.
COVERED, PRECISION = 2, 0.95
#: One labelled document in so many is kept for pruning.
PRUNE_ONE_IN = 3
_SPACES = " \t\n\x0b\x0c\r"
_SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS, MARKS, CAPITALS = "#*$%&|<>", "!?", "A-Z"

#: The statistics that rules look at, as shares of counts of `text_statistics`.
FEATURES = {
    "words": "n_words",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "repeated_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "distinct_words": "n_distinct / greatest(n_words, 1)",
}


class Condition(NamedTuple):
    feature: str
    above: bool
    threshold: float

    def sql(self) -> str:
        return f"{FEATURES[self.feature]} {'>' if self.above else '<='} {self.threshold!r}D"

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _number_of(characters: str, text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[^{characters}]+", ""))


def _neighbours(hashes: str, apart: int) -> Column:
    """Hashes of twice the words, from hashes of ``apart`` words each."""
    a = F.col(hashes)
    left = F.greatest(F.size(a) - apart, F.lit(0))
    return F.zip_with(F.slice(a, 1, left), F.slice(a, apart + 1, left), lambda x, y: F.xxhash64(x, y))


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and counts, a row per row of ``docs``, all of type long.

    n_words; word_chars, the code points in words; n_symbols, n_marks, n_capitals (A-Z); n_lines, the
    lines with a word, and n_dup_lines, those equal to an earlier one; n_distinct words;
    n_repeat_words, the words in windows of WINDOW words that the text holds twice or more. Windows are
    compared by 64-bit hashes. Null, empty and blank texts have zeros. Whole texts are counted
    within their row, in time that grows with the text (and its logarithm); equal rows
    have equal counts, an empty table gives no rows, and other columns are not looked at.
    """
    text = F.coalesce("text", F.lit(""))
    bare = F.btrim(text, F.lit(_SPACES))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(_SPACES))) > 0)
    first = docs.select("doc_id", F.regexp_replace(text, f"[^{SYMBOLS}{MARKS}{CAPITALS}]+", "").alias("x"), F.when(F.length(bare) > 0, F.split(bare, _SPLIT)).otherwise(F.array()).alias("w"), lines.alias("l"))
    counts = {"word_chars": F.length(F.array_join("w", ""))} | {f"n_{k}": _number_of(c, F.col("x")) for k, c in (("symbols", SYMBOLS), ("marks", MARKS), ("capitals", CAPITALS))}
    held = ["doc_id", *counts, "n_words", "n_distinct", "n_lines", "n_dup_lines"]
    one = first.withColumns(counts | {"n_words": F.size("w"), "n_distinct": F.size(F.array_distinct("w")), "n_lines": F.size("l"), "n_dup_lines": F.size("l") - F.size(F.array_distinct("l"))})
    one = one.select(*held, F.transform("w", lambda w: F.xxhash64(w)).alias("h"))
    two = one.select(*held, _neighbours("h", 1).alias("h"))
    four = two.select(*held, _neighbours("h", 2).alias("h"))
    windows = four.select(*held, _neighbours("h", 4).alias("h"))
    # of texts in which a window recurs, the windows by hash, then those with an equal neighbour, by place
    sorted_ = windows.select(*held, F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("s"))
    s = F.col("s")
    again = F.filter(s, lambda x, k: x["h"].eqNullSafe(F.get(s, k - 1)["h"]) | x["h"].eqNullSafe(F.get(s, k + 1)["h"]))
    places = sorted_.select(*held, F.sort_array(F.transform(again, lambda x: x["i"])).alias("p"))
    steps = F.zip_with("p", F.slice("p", 2, F.greatest(F.size("p"), F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0))
    return places.select("doc_id", *[F.col(c).cast("long").alias(c) for c in held[1:]], covered.cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    """Whether a row of `text_statistics` has too few words, or too many in windows that recur."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def learn_rules(stats: DataFrame, labels: DataFrame, label: str = "quality") -> list[Rule]:
    """Rules for documents whose ``label`` is 0, in the order in which they are to be tried.

    ``stats`` is that of `text_statistics`; ``labels`` has doc_id and the label. All labelled rows
    of ``stats`` that pass the base check are learned from; documents that labels
    contradict each other on, and null ids and labels, are not. Without labelled rows of both kinds there are no rules.
    """
    judged = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("low"), F.max(label).alias("high"))
    judged = judged.filter("low = high").select("doc_id", (F.col("low") == 0).alias("bad"))
    features = [F.expr(x).cast("double").alias(f) for f, x in FEATURES.items()]
    prune = F.crc32(F.col("doc_id").cast("string").cast("binary")) % PRUNE_ONE_IN == 0
    rows = cut(stats.filter(~base_failed()).join(judged, "doc_id").select("bad", prune.alias("prune"), *features))
    thresholds = _thresholds(rows)
    binned = cut(rows.select("bad", "prune", F.array(*[_bin(F.col(f), thresholds[f]) for f in FEATURES]).alias("bins")))

    rules: list[Rule] = []
    left = F.lit(True)
    while len(rules) < RULES:
        places = _grow(binned.filter(left), thresholds)
        if not places:
            break
        rules.append(tuple(Condition(f, above, thresholds[f][i]) for f, above, i in places))
        left = left & ~_met(places)
    return rules


def _thresholds(rows: DataFrame) -> dict[str, list[float]]:
    """For each statistic the middles between quantiles of either kind of documents."""
    share = [i / (THRESHOLDS // 2) for i in range(THRESHOLDS // 2 + 1)]
    kinds = {"bad": F.col("bad"), "good": ~F.col("bad")}
    found = rows.agg(*[F.percentile_approx(F.when(c, F.col(f)), share, 10_000).alias(f"{f}_{k}") for f in FEATURES for k, c in kinds.items()]).first()
    out = {}
    for f in FEATURES:
        values = sorted({v for k in kinds for v in found[f"{f}_{k}"] or []})
        out[f] = [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]
    return out


def _bin(value: Column, thresholds: list[float]) -> Column:
    """How many of the thresholds lie below a value."""
    return F.size(F.filter(F.array(*map(F.lit, thresholds)), lambda t: t < value)) if thresholds else F.lit(0)


def _met(places: list[tuple[str, bool, int]]) -> Column:
    names, out = list(FEATURES), F.lit(True)
    for f, above, i in places:
        at = F.col("bins")[names.index(f)]
        out = out & (at > i if above else at <= i)
    return out


def _histogram(rows: DataFrame) -> tuple[dict, dict]:
    """For both parts (growing, pruning): of each statistic's bins the documents of low quality and others, and their totals."""
    names = list(FEATURES)
    each = rows.select("bad", "prune", F.posexplode("bins").alias("f", "bin"))
    counted = each.groupBy("prune", "f", "bin").agg(F.sum(F.col("bad").cast("long")).alias("bad"), F.count("*").alias("n")).collect()  # statistics x thresholds
    bins: dict = {False: {f: {} for f in names}, True: {f: {} for f in names}}
    for r in counted:
        bins[r["prune"]][names[r["f"]]][r["bin"]] = (r["bad"], r["n"] - r["bad"])
    totals = {part: tuple(map(sum, zip(*b[names[0]].values(), strict=True))) if b[names[0]] else (0, 0) for part, b in bins.items()}
    return bins, totals


def _counts(bins: dict[int, tuple[int, int]], above: bool, i: int) -> tuple[int, int]:
    some = [c for k, c in bins.items() if (k > i) == above]
    return sum(c[0] for c in some), sum(c[1] for c in some)


def _grow(rows: DataFrame, thresholds: dict[str, list[float]]) -> list[tuple[str, bool, int]]:
    """The conditions (statistic, above, threshold's index) of the next rule, pruned; none if it isn't good enough."""
    places: list[tuple[str, bool, int]] = []
    worth: list[tuple[float, int]] = []  # of each prefix, on the rows for pruning
    while len(places) < CONDITIONS:
        bins, totals = _histogram(rows.filter(_met(places)))
        bad, good = totals[False]
        if not bad or not good:
            break
        gains: dict[float, list[tuple[str, bool, int]]] = {}
        for f, some in thresholds.items():
            for above in (True, False):
                for i in range(len(some)):
                    p, n = _counts(bins[False][f], above, i)
                    if p:
                        gains.setdefault(round(p * (math.log2(p / (p + n)) - math.log2(bad / (bad + good))), 9), []).append((f, above, i))
        if not gains or (best := max(gains)) <= 0:
            break
        alike = [x for x in gains[best] if x[:2] == gains[best][0][:2]]
        places.append(alike[len(alike) // 2])  # of thresholds that do equally well that in the middle
        p, n = _counts(bins[True][places[-1][0]], *places[-1][1:])
        worth.append(((p - n) / (p + n) if p + n else -1.0, p))
    if not worth:
        return []
    keep = max(range(len(worth)), key=lambda k: (worth[k], -k))
    value, covered = worth[keep]
    return places[: keep + 1] if covered >= COVERED and (value + 1) / 2 >= PRECISION else []


def verdict(rules: list[Rule]) -> Column:
    """The rule that rejects a row of `text_statistics`, as text: the first that fits, null if none does."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        fits = F.expr(" AND ".join(f"({c.sql()})" for c in rule))
        out = F.when(fits, F.lit(" and ".join(map(str, rule)))).otherwise(out)
    return out


def judge_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of `text_statistics`, base_failed, kept, rejected_by (``base``, a learned rule, or null): a row per row of ``docs``."""
    stats = cut(text_statistics(docs))
    rule = verdict(learn_rules(stats, labels))
    judged = stats.withColumns({"base_failed": base_failed(), "rejected_by": F.when(base_failed(), "base").otherwise(rule)})
    return judged.withColumn("kept", F.col("rejected_by").isNull())
