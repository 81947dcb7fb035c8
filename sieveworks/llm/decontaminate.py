"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

Texts are sequences of words (letters and digits, lower case), which 63-bit hashes stand for. A document is contaminated if
one of its windows lies within an edit distance of (1 - SIMILARITY) times the item's length.

1. *Windows.* An item that allows ``d`` edits is cut into ``d + 1`` segments. Each edit touches
   one of them at most, so a match holds some segment word for word (pigeonhole). Two filters of
   2**FILTER_BITS bits hold the segments, and the segments with the item's length and their place in it:
   where a document's run of words passes the second for some length and place, an item-sized window
   has its first word. No match is passed over, and however many items share a segment, it
   makes one window for each length and place.
2. *CGK.* A random walk copies a sequence into three times its length: each step writes the
   word at hand and, by a random bit of step and word, stays or moves on. Sequences at edit
   distance ``d`` come out at a Hamming distance of the order of ``d * d`` at most.
3. *LSH.* Each of REPEATS walks samples BITS steps of the embedding, which with the item's length and the
   walk are a key. Windows and items are joined on their keys, hot ones apart. Walks drift apart with the
   number of edits, so items are walked in blocks of at most WALK words, each from its own start, and one agreeing block is
   enough: the edits of one block are no more than its share.
4. *Verification.* The edit distance of each candidate, over windows that may begin and end
   anywhere near the place found, decides.

Documents are scanned once, whatever the benchmark's size, and what a task holds of the benchmark is
the two filters and the items of the documents at hand.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import body_of, cut, hot_join, named_rows, same_row, small_batches, unpacked

#: Least similarity (1 - edits / words of the item). Items under five words allow no edit: they are found word for word.
SIMILARITY = 0.8
#: Walks and sampled steps of each; recall at every length is measured in the tests.
REPEATS, BITS = 48, 3
#: Most words of a block that is walked by itself.
WALK = 64
#: Size of the filter for runs of words; the longest segment (of items of any length).
FILTER_BITS, LONGEST = 24, 4
#: Windows embedded at a time, and hashes looked up at a time.
WINDOWS, AT_ONCE = 4096, 1 << 20
_WORD = re.compile(r"[^\W_]+")
_PRIME = np.uint64(0x100000001B3)
_BASE = 0xD6E8FEB86659FD93
_HELD: list[np.ndarray] = []


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Which code points are letters or digits; powers of a prime, as many as the longest word so far has characters."""
    if not _HELD:
        _HELD.append(np.fromiter((chr(c).isalnum() for c in range(0x110000)), dtype=bool, count=0x110000))
        _HELD.append(np.ones(1, dtype=np.uint64))
    return _HELD[0], _HELD[1]


def hashed(text: str | None) -> np.ndarray:
    """A 63-bit hash for each of `words_of`, at least 0, computed over the whole text's characters at once."""
    known, powers = _tables()
    x = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = known[x]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    sizes = edge[1::2] - edge[::2]
    if not len(sizes):
        return np.zeros(0, dtype=np.int64)
    if int(sizes.max()) > len(powers):
        _HELD[1] = powers = np.cumprod(np.concatenate(([1], np.full(2 * int(sizes.max()), _BASE, dtype=np.uint64))), dtype=np.uint64)
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    h = np.add.reduceat((x[inside].astype(np.uint64) + np.uint64(1)) * powers[place], first)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(1)).view(np.int64)


def edits_allowed(n: int) -> int:
    return int((1 - SIMILARITY) * n + 1e-9)


def runs(words: np.ndarray, length: int) -> np.ndarray:
    """A hash for every run of ``length`` words."""
    n = len(words) - length + 1
    if n < 1:
        return np.zeros(0, dtype=np.int64)
    w = words.view(np.uint64)
    h = np.full(n, length, dtype=np.uint64)
    for i in range(length):
        h = (h ^ (h >> np.uint64(31))) * _PRIME + w[i : n + i] * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def segment_length(n: int) -> int:
    """Words of a segment of an item of ``n`` words, at most LONGEST."""
    return n // (edits_allowed(n) + 1)


def segments(words: np.ndarray) -> list[tuple[int, int]]:
    """(hash, place) of the segments of an item, one more than the edits it allows."""
    n = len(words)
    length = segment_length(n)
    h = runs(words, length) if n else ()
    return [(int(h[i * length]), i * length) for i in range(edits_allowed(n) + 1)] if n else []


def edit_distance(item: np.ndarray, window: np.ndarray) -> int:
    """Least edits that turn ``item`` into any run of words inside ``window``."""
    row = np.zeros(len(window) + 1, dtype=np.int64)  # a match may begin anywhere
    steps = np.arange(len(window) + 1)
    for i, word in enumerate(item, 1):
        best = np.minimum(row[:-1] + (window != word), row[1:] + 1)
        new = np.concatenate(([i], best))
        row = np.minimum.accumulate(new - steps) + steps  # words of the window left out
    return int(row.min())  # and end anywhere


class Walks:
    """REPEATS random walks over hashed words, and the steps they sample."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.bits = rng.integers(0, 2, (REPEATS, 3 * WALK, 64), dtype=np.int64)  # words share 64 coins a step
        self.share = rng.random((REPEATS, BITS))

    def keys(self, windows: np.ndarray) -> np.ndarray:
        """For each row of words (-1 for none) a key per walk."""
        m, n = windows.shape
        padded = np.concatenate((windows, np.full((m, 1), -1)), axis=1)
        walk, rows = np.arange(REPEATS), np.arange(m)[:, None]
        sampled = (self.share * 2 * n).astype(np.int64)  # past twice the length most walks are done
        at = np.zeros((m, REPEATS), dtype=np.int64)
        key = np.tile(walk * 1_000_003 + n, (m, 1))
        for j in range(int(sampled.max()) + 1):
            word = padded[rows, at]
            hit = np.flatnonzero((sampled == j).any(axis=1))
            key[:, hit] = (key[:, hit] * 0x100000001B3 + word[:, hit] + 2) & 0x7FFFFFFFFFFFFFF
            at = np.minimum(at + np.where(word < 0, 0, self.bits[walk, j, word & 63]), n)
        return key

    def block_keys(self, windows: np.ndarray) -> np.ndarray:
        """For each row of words the keys of all its blocks, which hold the block's place."""
        n = windows.shape[1]
        edges = np.linspace(0, n, -(-n // WALK) + 1).astype(np.int64)
        keys = [self.keys(windows[:, a:b]) ^ (int(a) << 40) for a, b in zip(edges, edges[1:], strict=False)]
        return np.concatenate(keys, axis=1)


_WALKS: list[Walks] = []


def window_keys(windows: np.ndarray) -> np.ndarray:
    """The keys of windows of one length, or of items: a row each, one for every walk of every block."""
    if not _WALKS:
        _WALKS.append(Walks())
    return placed(_WALKS[0].block_keys(windows), windows.shape[1], 0)


def placed(h: np.ndarray, n: np.ndarray | int, at: np.ndarray | int) -> np.ndarray:
    """Hashes mixed with an item's length and a place in it."""
    where = np.atleast_1d(np.asarray(n, dtype=np.uint64)) * np.uint64(1 << 32) + np.asarray(at, dtype=np.uint64)
    x = (h.view(np.uint64) ^ where * np.uint64(0x9E3779B97F4A7C15)) * _PRIME
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h & ((1 << FILTER_BITS) - 1)
    return (bits[place >> 6] >> (place & 63) & 1).astype(bool)


def windows_of(doc: np.ndarray, lengths: dict[int, tuple[np.ndarray, np.ndarray]], first: np.ndarray, second: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(item's words, starts) of a document's windows. ``lengths``: of each length of segments the items' lengths and the places they may have."""
    found: dict[int, list[np.ndarray]] = {}
    for length, (ns, ats) in lengths.items():
        h = runs(doc, length)
        at = np.flatnonzero(_has(first, h))
        step = max(1, AT_ONCE // len(ns))
        for k in range(0, len(at), step):
            some = at[k : k + step]
            i, j = np.nonzero(_has(second, placed(h[some][:, None], ns[None], ats[None])))
            for n in np.unique(ns[j]).tolist():
                mine = ns[j] == n
                found.setdefault(n, []).append(np.clip(some[i[mine]] - ats[j[mine]], 0, max(0, len(doc) - n)))
    return [(n, np.unique(np.concatenate(x))) for n, x in sorted(found.items())]


def cut_windows(doc: np.ndarray, n: int, starts: np.ndarray) -> np.ndarray:
    """The windows of ``n`` words at ``starts``; a document that is too short is filled up with -1."""
    filled = np.concatenate([doc, np.full(max(0, n - len(doc)), -1, dtype=np.int64)])
    return filled[starts[:, None] + np.arange(n)]


def verified(texts: Iterable[str | None], asked: Iterable[list[tuple[object, str, list[int]]]]) -> list[list[tuple]]:
    """For each text and its (item, item's text, starts): (item, start, words, edits) of the items found in it."""
    out = []
    for text, some in zip(texts, asked, strict=True):
        doc, best = hashed(text), {}
        for item_id, item_text, starts in some:
            item = hashed(item_text)
            d = edits_allowed(len(item))
            for start in sorted(starts):
                known = best.get((item_id, len(item)), (0, d + 1))[1]
                if not known:
                    break
                e = edit_distance(item, doc[max(0, start - d) : start + len(item) + d])
                if e < known:
                    best[item_id, len(item)] = (start, e)
        out.append([(i, start, n, e) for (i, n), (start, e) in sorted(best.items(), key=str)])
    return out


def _filter(hashes: DataFrame) -> np.ndarray:
    """2**FILTER_BITS bits, 64 to a number, of which those of the column ``h`` are set: at most a row for 64 of them reaches the driver."""
    place = F.col("h").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = hashes.select(F.shiftright(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast((h & {(1 << FILTER_BITS) - 1}) & 63 as int))").alias("b"))
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    out[got["w"].to_numpy(dtype=np.int64)] = got["b"].to_numpy(dtype=np.int64)
    return out


def _leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, body (a hash of the text) and a leak: see `find_leaks`."""
    spark = docs.sparkSession
    small_batches(spark)
    leak = T.StructType([T.StructField("item", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("words", T.IntegerType()), T.StructField("edits", T.IntegerType())])

    @F.pandas_udf("array<struct<h:bigint,at:int,length:int,n:int,h2:bigint>>")
    def cut_up(texts: pd.Series) -> pd.Series:
        out = []
        for w in map(hashed, texts):
            some = segments(w)
            second = placed(np.array([h for h, _ in some], dtype=np.int64), len(w), np.array([at for _, at in some], dtype=np.int64))
            out.append([{"h": h, "at": at, "length": segment_length(len(w)), "n": len(w), "h2": int(h2)} for (h, at), h2 in zip(some, second, strict=True)])
        return pd.Series(out, dtype=object)

    @F.pandas_udf("array<bigint>")
    def item_keys(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(window_keys(w[None])) if len(w := hashed(t)) else [] for t in texts], dtype=object)

    # texts are looked for once, whatever the number of items that have them
    named = benchmark.select("item_id", F.col("text").alias("item_text")).filter("item_text is not null").distinct()
    items = cut(named.select("item_text").distinct().select(F.monotonically_increasing_id().alias("item"), "item_text"))
    parts = cut(items.select(F.explode(cut_up("item_text")).alias("s")).select("s.*"))
    shared = spark.sparkContext.broadcast((_filter(parts), _filter(parts.select(F.col("h2").alias("h")))))  # 2**FILTER_BITS bits each
    lengths: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    places = parts.select("length", "n", "at").distinct().toPandas()  # as many as the different lengths of items have segments
    for length, rows in places.groupby("length"):
        lengths[int(length)] = (rows["n"].to_numpy(dtype=np.int64), rows["at"].to_numpy(dtype=np.int64))

    @F.pandas_udf("keys array<bigint>, starts array<int>")
    def look(texts: pd.Series) -> pd.DataFrame:
        keys, starts = [], []
        for t in texts:
            doc, own, where = hashed(t), [], []
            for n, some in windows_of(doc, lengths, *shared.value):
                for k in range(0, len(some), WINDOWS):
                    found = window_keys(cut_windows(doc, n, some[k : k + WINDOWS]))
                    own.append(found.ravel())
                    where.append(np.repeat(some[k : k + WINDOWS], found.shape[1]))
            keys.append(np.concatenate(own) if own else [])
            starts.append(np.concatenate(where) if where else [])
        return pd.DataFrame({"keys": keys, "starts": starts})

    @F.pandas_udf(T.ArrayType(leak))
    def verify(texts: pd.Series, asked: pd.Series) -> pd.Series:
        some = [[(x["item"], x["item_text"], list(x["starts"])) for x in a] for a in asked]
        return pd.Series([[dict(zip(leak.names, m, strict=True)) for m in found] for found in verified(texts, some)], dtype=object)

    own = docs.select("doc_id", body_of(F.col("text")).alias("body"), "text").filter("text is not null")
    windows = own.select("doc_id", "body", look("text").alias("x")).select("doc_id", "body", F.explode(F.arrays_zip("x.keys", "x.starts")).alias("x"))
    asking = cut(items.select("item", F.explode(item_keys("item_text")).alias("key")).groupBy("key").agg(F.collect_list("item").alias("items")))
    windows = cut(windows.select("doc_id", "body", F.col("x.keys").alias("key"), F.col("x.starts").alias("start")))
    shared_keys = cut(windows.groupBy("key").agg(F.count("*").alias("n")).join(asking, "key"))
    near = hot_join(windows, shared_keys, "key").select("doc_id", "body", "start", F.explode("items").alias("item"))
    near = near.groupBy("doc_id", "body", "item").agg(F.collect_set("start").alias("starts"))  # at most a document's own words
    asked = cut(near.join(items, "item").groupBy("doc_id", "body").agg(F.collect_list(F.struct("item", "item_text", "starts")).alias("asked")))
    # Spark sends the found few to the documents if they are small, and else deals both by key
    both = own.join(asked, same_row(own, asked)).select(own["doc_id"], own["body"], F.explode(verify("text", "asked")).alias("x"))
    found = cut(both.select("doc_id", "body", "x.*"))
    return found.join(items, "item").join(named, "item_text").select("doc_id", "body", "item_id", "start", "words", "edits")


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, words, edits: each benchmark item found in each document, once.

    ``start`` and ``words`` place the window by words. Null and empty texts, and items without a
    word, match nothing; items of fewer than five words match word for word; an empty benchmark
    gives no rows. Rows that share a doc_id are looked at one by one and may repeat a leak. Other
    columns are not looked at.
    """
    return _leaks(docs, benchmark).drop("body")


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item is found.

    Rows are told apart by doc_id and text: of rows that share a doc_id, or have none, only
    those with a leak go.
    """
    leaked = cut(_leaks(docs, benchmark).select("doc_id", "body").distinct())
    rows = named_rows(docs)
    return unpacked(rows.join(leaked, same_row(rows, leaked), "left_anti"), docs.columns)
