"""Line dedup by content-defined chunks of lines.

Every line that isn't blank has a hash, and a rolling hash over LINES of them stands at each line. A
chunk may begin at a line where it is 0 modulo EVERY, and end after a line at whose last LINES lines
it is (by another mix of the same hash); chunks go from each beginning to the next end, and from the last beginning to each end. So a chunk is chosen by nothing but its own lines, and
wherever a passage stands, whatever comes before it, it is cut alike. A text's own start
and end are boundaries too. One such chunking leaves short passages whole and cuts off the edges of long
ones, so there are CHUNKINGS of them, each with mixes of its own. The chunks have all lengths from two lines on, three on average.

A chunk that has occurred before, in order of doc_id and place, is a repeat. Of a document's repeats by
hash the fewest that cover the same lines are read and compared with the earlier chunk byte by
byte; those that are equal leave the text, with up to EDGE lines at either side that are equal as
well. Each line removed stays where the chunk that it
belongs to occurred first or, if it is itself in a repeat there, still earlier.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_join, named_rows, order_of, same_row, small_batches, unpacked

#: Lines that a boundary depends on (the least chunk), one boundary in so many lines, and chunkings.
LINES, EVERY, CHUNKINGS = 2, 2, 8
#: Lines beside a repeat that are compared too.
EDGE = 2
_PRIME = np.uint64(0x100000001B3)
_rng = np.random.default_rng(7)
#: The mixes of the rolling hash for starts and for ends.
MIX = _rng.integers(0, 1 << 63, (2, CHUNKINGS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _lines(text: str | None) -> tuple[list[str], list[int]]:
    """The lines of a text (only a line feed ends one), and which of them aren't blank."""
    every = (text or "").removesuffix("\n").split("\n")
    return every, [i for i, x in enumerate(every) if x.strip()]


def _rolled(h: np.ndarray) -> np.ndarray:
    """The rolling hash at each line of which LINES - 1 lines follow."""
    n = len(h) - LINES + 1
    rolled = np.zeros(n, dtype=np.uint64)
    for i in range(LINES):
        rolled = (rolled ^ (rolled >> np.uint64(29))) * _PRIME + h[i : n + i]
    return rolled ^ (rolled >> np.uint64(31))


def chunks_of(text: str | None, every: int = EVERY, chunkings: int = CHUNKINGS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chunks of a text: first line, lines (both among those not blank) and hash, each once."""
    rows, full = _lines(text)
    if len(full) < LINES:
        return (np.zeros(0, dtype=np.int64),) * 3
    h = np.fromiter((xxhash.xxh3_64_intdigest(rows[i].encode("utf-8", "surrogatepass")) for i in full), dtype=np.uint64, count=len(full))
    rolled = _rolled(h)
    n, place = len(rolled), np.arange(len(rolled))
    chosen = (rolled * MIX[:, :chunkings, None] >> np.uint64(33)) % np.uint64(every) == 0  # starts and ends, chunkings, lines
    chosen[0, :, 0] = chosen[1, :, -1] = True
    last_start = np.maximum.accumulate(np.where(chosen[0], place, 0), axis=1)
    next_end = np.minimum.accumulate(np.where(chosen[1], place, n)[:, ::-1], axis=1)[:, ::-1]
    first, last = np.divmod(np.unique(np.concatenate([(place * n + next_end)[chosen[0]], (last_start * n + place)[chosen[1]]])), n)
    last += LINES - 1
    powers = _powers(len(h))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(h * powers[0, : len(h)])])
    hashes = (sums[last + 1] - sums[first]) * powers[1, first]
    return first, last - first + 1, (hashes ^ (hashes >> np.uint64(32))).view(np.int64)


_POWERS = np.ones((2, 1), dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    """The powers 0..n of an odd number modulo 2^64, and of its inverse."""
    global _POWERS
    if _POWERS.shape[1] < n:
        base = [int(_PRIME), pow(int(_PRIME), -1, 1 << 64)]
        grown = np.array(base, dtype=np.uint64)[:, None].repeat(2 * n, axis=1)
        grown[:, 0] = 1
        _POWERS = np.cumprod(grown, axis=1, dtype=np.uint64)
    return _POWERS


def fewest(chunks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of chunks (first line, lines) the fewest that cover the same lines: from left to right that which reaches farthest."""
    out, some, i, reached = [], sorted(chunks), 0, 0
    while i < len(some):
        reached = max(reached, some[i][0])
        best = None
        while i < len(some) and some[i][0] <= reached:
            best = max(best or some[i], some[i], key=sum)
            i += 1
        if sum(best) > reached:
            out.append(best)
            reached = sum(best)
    return out


def chunk_bodies(text: str | None, chunks: list[tuple[int, int]]) -> list[dict]:
    """Of each chunk its lines, and up to EDGE lines before it (the nearest first) and after it; blank lines don't count."""
    every, full = _lines(text)
    lines = [every[i] for i in full]
    return [{"lines": "\n".join(lines[k : k + n]), "before": lines[max(k - EDGE, 0) : k][::-1], "after": lines[k + n : k + n + EDGE]} for k, n in chunks]


def strip_runs(text: str, chunks: list[tuple[int, int]]) -> str:
    """``text`` without these chunks, and blank lines between them or an edge."""
    every, full = _lines(text)
    gone = {k + i for k, n in chunks for i in range(n)}
    out, before = [], -1
    for k in range(len(full) + 1):
        here = full[k] if k < len(full) else len(every)
        inside = (k == 0 or k - 1 in gone) and (k == len(full) or k in gone)
        out += [] if inside else every[before + 1 : here]
        if k < len(full) and k not in gone:
            out.append(every[here])
        before = here
    left = "\n".join(out)
    return left + "\n" if left and text.endswith("\n") else left


def _chunks(x: object) -> list[tuple[int, int]]:
    return sorted((int(c["k"]), int(c["n"])) for c in x)


def dedup_lines(docs: DataFrame, every: int = EVERY, chunkings: int = CHUNKINGS, keep_emptied: bool = True) -> DataFrame:
    """``docs`` with the lines of repeated chunks taken out of ``text``; all columns and rows stay.

    The first occurrence, by doc_id (null ones last), hash of the text and place in it, stays; a
    chunk that overlaps it is no repeat. Rows are told apart by doc_id and text, so rows of one
    doc_id with different texts are different documents; those equal in both count as one and
    don't strip each other. Null, empty and one-line texts stay as they are. ``n_chars``, if
    there, follows a changed text. A text may become empty; ``keep_emptied=False`` drops such
    rows (all their lines stand elsewhere), but none that was null, empty or blank before. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    chunk = "struct<k:bigint,n:bigint>"

    @F.pandas_udf("k array<bigint>, n array<bigint>, h array<bigint>")
    def chunk_hashes(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([chunks_of(t, every, chunkings) for t in texts], columns=["k", "n", "h"])

    @F.pandas_udf(f"array<{chunk}>")
    def covering(groups: pd.Series) -> pd.Series:
        return pd.Series([[{"k": k, "n": n} for k, n in fewest(_chunks(g))] for g in groups], dtype=object)

    @F.pandas_udf("array<struct<lines:string,before:array<string>,after:array<string>>>")
    def bodies_at(texts: pd.Series, chunks: pd.Series) -> pd.Series:
        return pd.Series([chunk_bodies(t, _chunks(c)) for t, c in zip(texts, chunks, strict=True)], dtype=object)

    @F.pandas_udf("string")
    def strip(texts: pd.Series, chunks: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else strip_runs(t, _chunks(c)) for t, c in zip(texts, chunks, strict=True)], dtype=object)

    rows = named_rows(docs)
    known = rows.select("doc_id", "body", "text").filter("text is not null")
    found = cut(known.select("doc_id", "body", chunk_hashes("text").alias("c")).select("doc_id", "body", F.explode(F.arrays_zip("c.k", "c.n", "c.h")).alias("c")).select(order_of().alias("of"), F.col("c.k").alias("k"), F.col("c.n").alias("lines"), F.col("c.h").alias("h")))
    place = F.struct("of", "k").alias("first")
    shared = cut(found.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1"))
    later = hot_join(found, shared, "h").filter((F.col("of") > F.col("first.of")) | (F.col("of") == F.col("first.of")) & (F.col("k") >= F.col("first.k") + F.col("lines")))
    one = lambda k, n: F.struct(F.col(k).alias("k"), F.col(n).alias("n"))
    cover = later.groupBy("of").agg(F.collect_set(one("k", "lines")).alias("c")).select("of", F.explode(covering("c")).alias("c"))  # of one text
    chosen = cut(cover.select("of", F.col("c.k").alias("k"), F.col("c.n").alias("lines")).join(found, ["of", "k", "lines"]))
    # what is read: the repeats and, once each, the chunks that they repeat
    firsts = shared.join(chosen.select("h", "lines").distinct(), "h").select("first.of", "first.k", "lines", "h")
    wanted = chosen.select("of", "k", "lines").union(firsts.select("of", "k", "lines")).groupBy("of").agg(F.collect_set(one("k", "lines")).alias("c"))
    wanted = cut(wanted.select("of.doc_id", "of.body", F.array_sort("c").alias("c")))
    # sort-merge joins where texts move: the plan is the same at every size
    read = known.join(wanted.hint("merge"), same_row(known, wanted)).select(known["doc_id"], known["body"], "c", bodies_at("text", "c").alias("b"))
    chunks = read.select("doc_id", "body", F.explode(F.arrays_zip("c", "b")).alias("x")).select(order_of().alias("of"), F.col("x.c.k").alias("k"), F.col("x.c.n").alias("n_lines"), "x.b.*")
    chunks = cut(chunks.withColumn("h", F.xxhash64("lines")))
    # grouping by the text itself compares bytes
    first = chunks.groupBy("h", "lines").agg(F.min(F.struct("of", "k", "before", "after")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = cut(first.select("h", F.col("lines").alias("same"), "first", "n"))
    elsewhere = F.col("of") > F.col("first.of")
    repeats = hot_join(chunks, first, "h").filter("lines = same").filter(elsewhere | (F.col("k") >= F.col("first.k") + F.col("n_lines")))
    alike = lambda side, i: F.coalesce(F.get(side, F.lit(i)) == F.get(f"first.{side}", F.lit(i)), F.lit(False))
    more = {side: reduce(lambda rest, i: F.when(alike(side, i), 1 + rest).otherwise(0), reversed(range(EDGE)), F.lit(0)) for side in ("before", "after")}
    more = {side: F.when(elsewhere, n).otherwise(0) for side, n in more.items()}
    wider = F.struct((F.col("k") - more["before"]).alias("k"), (F.col("n_lines") + more["before"] + more["after"]).alias("n"))
    gone = cut(repeats.groupBy("of").agg(F.collect_set(wider).alias("gone")).select("of.doc_id", "of.body", "gone"))

    joined = rows.join(gone.hint("merge"), same_row(rows, gone), "left").select("row", "text", "gone")
    changed = F.col("gone").isNotNull()
    joined = joined.withColumn("left", strip(F.when(changed, F.col("text")), F.coalesce("gone", F.array().cast(f"array<{chunk}>"))))
    joined = joined if keep_emptied else joined.filter(~changed | (F.col("left") != ""))
    new = {"text": F.when(changed, F.col("left")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("left").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return unpacked(joined, docs.columns, **new)
