"""Substring dedup over sliding sentence spans.

Every run of SENTENCES consecutive sentences is hashed, from every sentence on; a longer run
repeats only if all of these do, so they stand for every run of several sentences, however few
words it has. Runs of fewer sentences are spans too if they have at least WORDS words: a long passage may hold one or
two whole sentences. All hashes are joined globally. A span is *first* where the least document has it first; sentences
that any other occurrence covers are removed.

Only narrow rows of a document's key and a hash cross the network for the counting, at most one
per hash and document; texts move once, to meet the hashes that hit them.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_join, named_rows, order_of, same_row, small_batches

#: Sentences in a span: "several" are three. Of 8,800 documents of sf0.1 without any repeated stretch of over 50 words, spans
#: of two touch 2,993 by short sentences that recur by chance, spans of three 1,039; of 1,200 with one they touch 1,152 and 1,137.
SENTENCES = 3
#: Words that make a span of fewer sentences. (Words are what white space parts: text without it has no such spans.)
WORDS = 40
#: The end of a sentence, with the white space after it: full stops, question or exclamation marks before white space, or a line end.
#: A run of marks is looked at from its first one alone, so the time is linear in the text.
_END = re.compile(r"(?<![.!?。！？])[.!?。！？]++(?=\s|\Z)\s*+|\n\s*+")
_PRIME = np.uint64(0x100000001B3)


def sentences(text: str) -> list[str]:
    """The sentences of ``text``; joined they give the text back."""
    edges = [0, *(m.end() for m in _END.finditer(text))]
    edges += [len(text)] * (edges[-1] < len(text))
    return [text[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def spans(text: str | None) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sentences of a text, the places of those that aren't blank, and hash, first sentence (among those) and number of sentences of every span.

    White space within a sentence counts as one blank.
    """
    parts = sentences(text or "")
    words = [s.split() for s in parts]
    full = np.array([i for i, w in enumerate(words) if w], dtype=np.int64)
    h = np.fromiter((xxhash.xxh3_64_intdigest(" ".join(words[i]).encode("utf-8", "surrogatepass")) for i in full), dtype=np.uint64, count=len(full))
    before = np.cumsum([0, *(len(words[i]) for i in full)])
    rolled = np.zeros(len(full), dtype=np.uint64)
    hashes, starts, sizes = [], [], []
    for size in range(1, min(SENTENCES, len(full)) + 1):
        n = len(full) - size + 1
        rolled = (rolled[:n] ^ (rolled[:n] >> np.uint64(29))) * _PRIME + h[size - 1 :]
        at = np.arange(n) if size == SENTENCES else np.flatnonzero(before[size:] - before[:n] >= WORDS)
        hashes.append(rolled[at])
        starts.append(at)
        sizes.append(np.full(len(at), size))
    if not hashes:
        return parts, full, *(np.zeros(0, dtype=np.int64) for _ in range(3))
    return parts, full, np.concatenate(hashes).view(np.int64), np.concatenate(starts), np.concatenate(sizes)


def drop_repeated(text: str, hit: set[int]) -> tuple[str, int]:
    """``text`` without the sentences of spans whose hash is in ``hit`` or came before in the text; how many went."""
    parts, full, *found = spans(text)
    gone, seen = np.zeros(len(parts), dtype=bool), {}
    for h, k, size in zip(*(x.tolist() for x in found), strict=True):
        # a span that overlaps its own first occurrence would eat that occurrence
        if h in hit or (h in seen and k >= seen[h] + size):
            gone[full[k : k + size]] = True
        seen.setdefault(h, k)
    return ("".join(s for s, g in zip(parts, gone, strict=True) if not g).rstrip() if gone.any() else text), int(gone.sum())


def dedup_sentences(docs: DataFrame) -> DataFrame:
    """doc_id, text (what is left), removed (number of sentences): a row per row of ``docs``.

    Documents are taken in order of doc_id (null ones last), then of the text's hash. Rows of one
    doc_id with different texts are different documents; those equal in both count as one and
    don't strip each other. Null and empty texts, and those of fewer than SENTENCES sentences and
    WORDS words, have no span and stay as they are. An empty table gives no rows; other columns are not looked at.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("array<bigint>")
    def hashes(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(spans(t)[2]) for t in texts], dtype=object)

    @F.pandas_udf("text string, removed int")
    def strip(texts: pd.Series, all_hits: pd.Series) -> pd.DataFrame:
        got = [(None, 0) if t is None else drop_repeated(t, set() if h is None else set(np.asarray(h).tolist())) for t, h in zip(texts, all_hits, strict=True)]
        return pd.DataFrame({"text": pd.Series([g[0] for g in got], dtype=object), "removed": np.array([g[1] for g in got], dtype=np.int32)})

    rows = named_rows(docs.select("doc_id", "text")).select("doc_id", "body", "text")
    found = cut(rows.filter("text is not null").select("doc_id", "body", F.explode(hashes("text")).alias("h")))
    shared = cut(found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"))
    again = cut(hot_join(found, shared, "h").select("h", order_of().alias("of")))
    first = cut(again.groupBy("h").agg(F.min("of").alias("first"), F.count("*").alias("n")))
    hits = hot_join(again, first, "h").filter(F.col("of") > F.col("first"))
    hits = cut(hits.groupBy("of").agg(F.collect_set("h").alias("hits")).select("of.doc_id", "of.body", "hits"))  # at most a document's own spans
    both = rows.join(hits.hint("merge"), same_row(rows, hits), "left").select(rows["doc_id"], "text", "hits")
    return both.select("doc_id", strip("text", "hits").alias("x")).select("doc_id", "x.text", "x.removed")
