"""Periodic runs of words by block convolution.

A run is a stretch of words that repeats with a smallest period q, at least EXPONENT times and
over LEAST words, and that no neighbouring word extends. At each scale b = 8, 16, 32, ... the
text is cut into blocks of b words. A run of a period q in [b, 2b) is at least 3q long, so it holds a whole
block within its first 2b words and that block's next occurrence q words later. Where a block B occurs
in the window W that follows it is where its squared differences

    sum (B[i] - W[i + j])^2  =  sum B^2  +  sum W[j : j + b]^2  -  2 sum B[i] W[i + j]

are zero. The last sum is a convolution, done for all blocks of a scale at once by a number
theoretic transform, which is exact modulo a prime: a sum that is zero is zero modulo the prime, so no
occurrence is missed, and one that is zero by chance is no more than a seed that leads nowhere.

Each zero gives a seed (block, distance q). It is extended to both sides as far as words q apart agree, by
a binary search over prefix hashes, and the run found is compared word by word. Seeds inside a run that is known
already are multiples of its period and are skipped, so a text of one word costs as much as any.
(Work and memory grow with the words times their logarithm.)
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from functools import cache
from itertools import chain, count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: The least length of a run in words, and in periods.
LEAST, EXPONENT = 24, 3
#: Words of the least blocks, which serve all distances below twice as many.
BASE = 8
#: A prime with roots of unity of all orders up to 2^30, and a generator of its group.
PRIME, ROOT = 3 * 2**30 + 1, 5
#: Words of texts that are searched together, and numbers transformed at once.
TOGETHER, AT_ONCE = 1 << 17, 1 << 19
_P = np.uint64(PRIME)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)

Run = tuple[int, int, int]


def _less(x: np.ndarray) -> np.ndarray:
    """``x`` below twice the prime, modulo the prime: the difference wraps to a greater number if it is negative."""
    return np.minimum(x, x - _P)


@cache
def _powers(order: int, inverse: bool) -> np.ndarray:
    """The powers of a root of unity of this order, half of them."""
    root = pow(ROOT, (PRIME - 1) // order, PRIME)
    root = pow(root, -1, PRIME) if inverse else root
    out = np.ones(max(order // 2, 1), dtype=np.uint64)
    filled = 1
    while filled < len(out):
        step = np.uint64(pow(root, filled, PRIME))
        out[filled : 2 * filled] = out[:filled] * step % _P
        filled *= 2
    return out


def transform(rows: np.ndarray) -> np.ndarray:
    """The number theoretic transform of each row, in bit-reversed order."""
    a, n = rows, rows.shape[1]
    half = n // 2
    while half:
        a = a.reshape(-1, n // (2 * half), 2, half)
        u, v = a[:, :, 0], a[:, :, 1]
        a = np.stack([_less(u + v), _less(u + _P - v) * _powers(2 * half, False) % _P], axis=2)
        half //= 2
    return a.reshape(rows.shape)


def transform_back(rows: np.ndarray) -> np.ndarray:
    """The inverse of `transform`."""
    a, n = rows, rows.shape[1]
    half = 1
    while half < n:
        a = a.reshape(-1, n // (2 * half), 2, half)
        u, v = a[:, :, 0], a[:, :, 1] * _powers(2 * half, True) % _P
        a = np.stack([_less(u + v), _less(u + _P - v)], axis=2)
        half *= 2
    return a.reshape(rows.shape) * np.uint64(pow(n, -1, PRIME)) % _P


def zero_mismatches(values: np.ndarray, squares: np.ndarray, blocks: np.ndarray, b: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, distance) where the squared differences of ``values[block : block + b]`` and what stands at the distance are zero.

    Distances are low..high-1. ``values`` are below the prime and padded; ``squares`` are prefix sums of their squares.
    """
    size = 1 << (high - low + b - 2).bit_length()
    at, distance = [], []
    for i in range(0, len(blocks), step := max(1, AT_ONCE // size)):
        some = blocks[i : i + step, None]
        block = np.zeros((len(some), size), dtype=np.uint64)
        block[:, :b] = values[some + np.arange(b - 1, -1, -1)]
        window = np.zeros((len(some), size), dtype=np.uint64)
        window[:, : high - low + b - 1] = values[some + np.arange(low, high + b - 1)]
        product = transform_back(transform(block) * transform(window) % _P)[:, b - 1 : b - 1 + high - low]
        from_ = some + np.arange(low, high)
        own = (squares[some + b] - squares[some]) % _P
        theirs = (squares[from_ + b] - squares[from_]) % _P
        k, j = np.nonzero(_less(own + theirs) == _less(product + product))
        at.append(some[k, 0])
        distance.append(j + low)
    return (np.concatenate(at), np.concatenate(distance)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class _Words:
    """Texts side by side, as numbers, and what is asked of them again and again."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.ids, n = ids, len(ids)
        self.first = np.concatenate([[0], np.cumsum(lengths)])
        self.lengths = lengths
        hashed = (ids.astype(np.uint64) + np.uint64(1)) * _FACTOR
        hashed = (hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        hashed ^= hashed >> np.uint64(32)
        self.pad = 4 * max(int(lengths.max(initial=0)), BASE)
        self.values = np.concatenate([hashed % _P, np.zeros(self.pad, np.uint64)])
        self.squares = np.concatenate([[np.uint64(0)], np.cumsum(self.values * self.values % _P, dtype=np.uint64)])
        self.power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _FACTOR), dtype=np.uint64)])
        self.prefix = np.concatenate([[np.uint64(0)], np.cumsum(hashed * self.power[:n], dtype=np.uint64)])
        # every word's places: by word, then place
        self.places = np.sort(ids.astype(np.int64) << 32 | np.arange(n))

    def recurs(self, at: np.ndarray, low: int, high: int) -> np.ndarray:
        """Whether the word at each place stands again at a distance of low..high-1."""
        key = (self.ids[at].astype(np.int64) << 32) + at
        found = np.searchsorted(self.places, key + low)
        return (found < len(self.places)) & (self.places[np.minimum(found, len(self.places) - 1)] < key + high)

    def agree(self, a: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from a on equal those q later, by their hashes."""
        return (self.prefix[a + n] - self.prefix[a]) * self.power[q] == self.prefix[a + q + n] - self.prefix[a + q]

    def extended(self, at: np.ndarray, q: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[from, to) of the longest stretches around ``at`` in which words q apart agree."""
        out = []
        for most, back in ((end - at - q, False), (at - start, True)):
            low, high = np.zeros_like(at), most
            while (low < high).any():
                mid = (low + high + 1) >> 1
                fits = self.agree(at - mid if back else at, q, mid)
                low, high = np.where(fits, mid, low), np.where(fits, high, mid - 1)
            out.append(low)
        return at - out[1], at + q + out[0]


def plain_runs(ids: np.ndarray) -> list[Run]:
    """The runs (start, length, period) of a text, distance by distance: for texts that deceive the hashes, and for tests."""
    ids, best = np.asarray(ids), {}
    for q in range(1, len(ids) // EXPONENT + 1):
        same = np.concatenate([[False], ids[q:] == ids[:-q], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
        for s, e in (edges + [0, q])[edges[:, 1] - edges[:, 0] + q >= max(LEAST, EXPONENT * q)].tolist():
            best.setdefault((s, e), q)
    return sorted((s, e - s, q) for (s, e), q in best.items())


def runs_of(ids: np.ndarray, lengths: np.ndarray) -> list[list[Run]]:
    """For each of the texts that lie side by side in ``ids``, its runs (start, length, period) by start, then period."""
    words, found, deceived = _Words(ids, lengths), {}, set()
    reach = np.zeros(len(ids) + 1, dtype=np.int64)  # how far a run reaches that begins at a place or before it
    b = BASE
    while (large := np.flatnonzero(lengths >= max(LEAST, EXPONENT * b))).size:
        low, high = (1, 2 * b) if b == BASE else (b, 2 * b)
        many = lengths[large] // b
        doc = np.repeat(large, many)
        blocks = words.first[doc] + b * (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many))
        end = words.first[doc + 1]
        open_ = (blocks + low + b <= end) & (reach[blocks] < np.minimum(blocks + high - 1 + b, end))
        blocks, doc = blocks[open_], doc[open_]
        for offset in dict.fromkeys([0, b - 1, b // 2, b // 4, 3 * b // 4, b // 8, 5 * b // 8, 7 * b // 8]):
            # no occurrence without each of the block's words
            again = words.recurs(blocks + offset, low, high)
            blocks, doc = blocks[again], doc[again]
        at, q = zero_mismatches(words.values, words.squares, blocks, b, low, high)
        doc = doc[np.searchsorted(blocks, at)]
        seed = (at + q + b <= words.first[doc + 1]) & (reach[at] < at + q + b)
        at, q, doc = at[seed], q[seed], doc[seed]
        start, end = words.extended(at, q, words.first[doc], words.first[doc + 1])
        long = end - start >= np.maximum(LEAST, EXPONENT * q)
        for d, s, e, p in sorted(set(zip(doc[long].tolist(), start[long].tolist(), end[long].tolist(), q[long].tolist(), strict=True))):
            if (s, e) not in found:  # else by a smaller period
                if np.array_equal(ids[s : e - p], ids[s + p : e]):
                    found[s, e] = (d, p)
                    reach[s] = max(reach[s], e)
                else:
                    deceived.add(d)
        reach = np.maximum.accumulate(reach)
        b *= 2
    out = [[] for _ in lengths]
    for (s, e), (d, p) in found.items():
        out[d].append((s - int(words.first[d]), e - s, p))
    for d in deceived:
        out[d] = plain_runs(ids[words.first[d] : words.first[d + 1]])
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def texts_runs(texts: Sequence[str | None]) -> list[tuple[list[Run], str]]:
    """For each text its runs, and the kept words joined by one space."""
    out, some, size = [], [], 0

    def search() -> None:
        number = defaultdict(count().__next__)
        ids = np.fromiter(map(number.__getitem__, chain.from_iterable(some)), dtype=np.int64, count=size)
        for words, found in zip(some, runs_of(ids, np.array([len(w) for w in some], dtype=np.int64)), strict=True):
            if found:
                gone = np.zeros(len(words) + 1, dtype=np.int64)
                for start, length, period in found:
                    gone[start + period] += 1
                    gone[start + length] -= 1
                words = [w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g]
            out.append((found, b" ".join(words).decode("utf-8", "surrogatepass")))

    for text in texts:
        some.append(words_of(text))
        size += len(some[-1])
        if size >= TOGETHER:
            search()
            some, size = [], 0
    search()
    return out


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period: in words, by start, then period), collapsed: a row per row of ``docs``.

    ``collapsed`` are the words that no run contains after its first period, joined by one space. A
    null, empty or blank text has no words and no runs. Texts of any length are searched whole;
    each is one row's work, nothing is shuffled, and equal rows have equal results. Two runs may overlap, and a
    stretch is one run only, by its smallest period. An empty table gives no rows; other columns
    than doc_id and text are not looked at.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    def search(texts: pd.Series) -> pd.DataFrame:
        found = texts_runs(texts.tolist())
        runs = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r, _ in found]
        return pd.DataFrame({"n_words": [len(words_of(t)) for t in texts], "runs": runs, "collapsed": [c for _, c in found]})

    return docs.select("doc_id", search("text").alias("f")).select("doc_id", "f.*")


def most_repeated(runs: Column) -> Column:
    """The run of the greatest length / period (compared exactly; ties: smallest start, then period), null without runs."""
    better = lambda a, b: F.when(a["length"] * b["period"] != b["length"] * a["period"], b["length"] * a["period"] - a["length"] * b["period"]).when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["period"] - b["period"])
    return F.get(F.array_sort(runs, lambda a, b: F.signum(better(a, b)).cast("int")), F.lit(0))


def runs_text(runs: Column) -> Column:
    """A line ``start,length,period`` for each run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")


def plant_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, with a run to the end of every tenth text, as the op13 query plants it.

    Of h = crc32 of the decimal doc_id: if h % 10 = 0, the n words from a = g % n on, where g = h / 10,
    repeat the first p = 1 + (n - a) / (3 + g % 8) of them. Null ids and texts without words stay.
    """
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).alias("g"))
    n = F.size("w").cast("long")
    placed = chosen.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("long"))
    a, p = F.col("a").cast("int"), F.col("p").cast("int")
    rest = F.size("w") - a
    again = F.slice(F.flatten(F.array_repeat(F.slice("w", a + 1, p), F.ceil(rest / p).cast("int"))), 1, rest)
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(F.concat(F.slice("w", 1, a), again), " ")).otherwise(F.col("text")).alias("text"))
