"""Best-two-fit packing of tokenised documents into fixed-length sequences.

A bin is filled greedily with the longest piece that fits. If a gap is left, its smallest piece
is taken out again and replaced by the two unpacked pieces that together fit the expanded gap
most tightly, if they fill more of it than the one did.

Only lengths matter for this, so the pieces are dealt at random, by their own places in the
table that holds them, into groups of about GROUP pieces, each packed by itself: a group wastes part of one bin in thousands, and groups
grow in number, not in size, with the corpus.
"""

from __future__ import annotations

import base64
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, small_batches

#: Tokens of a sequence, id that ends a document, pieces packed together.
LENGTH, END, GROUP = 2048, 0, 16_384
#: Texts of Latin letters, which both tokenizer libraries split alike; others take the slower one.
_OTHER = "[^\t-\r -~\u00a1-\u024f]"
_ENCODERS: dict[tuple, Callable[[str], list[int]]] = {}


def encoder(vocabulary: str, ranks: str | None = None, pattern: str = "") -> Callable[[str], list[int]]:
    """text -> ids of the byte-level BPE in the file ``vocabulary`` (tokenizers library).

    The ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``, which reads the
    string of a special token as that token. With ``ranks`` and ``pattern``, the same vocabulary
    as a rank file, texts of Latin letters without such strings take the faster library, which
    gives the same ids.
    """
    key = (vocabulary, ranks, pattern)
    if key not in _ENCODERS:
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(vocabulary)
        encode = lambda text: slow.encode(text, add_special_tokens=False).ids
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
            special = "|".join(re.escape(t.content) for t in slow.get_added_tokens_decoder().values())
            other = re.compile(f"{_OTHER}|{special}" if special else _OTHER)
            _ENCODERS[key] = lambda text: encode(text) if other.search(text) else fast.encode_ordinary(text)
        else:
            _ENCODERS[key] = encode
    return _ENCODERS[key]


def cut_lengths(n: int, length: int = LENGTH) -> list[int]:
    """Lengths of the pieces of ``n`` ids: all full but the first."""
    first = n % length
    return [first] * (first > 0) + [length] * (n // length)


def tokenize(docs: DataFrame, encode: tuple, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit): the pieces of every document.

    A document is its text's ids (none if null) and END; longer ones than ``length`` are cut,
    the first piece being the shorter. A row per piece of each row of ``docs``.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to_ids = encoder(*encode)
        for b in batches:
            ids_of, places = [], []
            for row, text in enumerate(b["text"]):
                ids = np.array([*to_ids(text), END] if text else [END], dtype="<u4")
                start = 0
                for piece, n in enumerate(cut_lengths(len(ids), length)):
                    places.append((row, piece, start))
                    ids_of.append(ids[start : start + n].tobytes())
                    start += n
            rows, pieces, starts = np.array(places, dtype=np.int64).reshape(-1, 3).T
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[rows], "piece": pieces, "start": starts, "length": [len(x) // 4 for x in ids_of], "ids": ids_of})

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])
    return docs.select("doc_id", "text").mapInPandas(run, schema)


def best_two_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins, each a list of indices into ``lengths`` (all from 1 to ``capacity``)."""
    stacks: dict[int, list[int]] = defaultdict(list)
    for i in range(len(lengths) - 1, -1, -1):
        stacks[lengths[i]].append(i)
    free = 0  # bit n: a piece of length n is unpacked
    back = 0  # bit capacity - n: the same, reversed
    for n in stacks:
        free |= 1 << n
        back |= 1 << (capacity - n)

    def take(n: int) -> int:
        nonlocal free, back
        i = stacks[n].pop()
        if not stacks[n]:
            free &= ~(1 << n)
            back &= ~(1 << (capacity - n))
        return i

    def put(n: int, i: int) -> None:
        nonlocal free, back
        stacks[n].append(i)
        free |= 1 << n
        back |= 1 << (capacity - n)

    def two(most: int, least: int) -> tuple[int, int] | None:
        """Two unpacked lengths with the greatest sum in (least, most]."""
        for total in range(most, least, -1):
            pairs = free & (back >> (capacity - total) if total <= capacity else 0) & ((1 << (total // 2 + 1)) - 1)
            while pairs:
                a = pairs.bit_length() - 1
                if 2 * a != total or len(stacks[a]) > 1:
                    return a, total - a
                pairs &= ~(1 << a)
        return None

    bins = []
    while free:
        own, gap = [], capacity
        while fit := free & ((1 << (gap + 1)) - 1):
            n = fit.bit_length() - 1
            own.append((n, take(n)))
            gap -= n
        if gap and free:
            n, i = own[-1]  # the smallest, as each is at most the one before
            put(n, i)
            if pair := two(gap + n, n):
                own[-1:] = [(m, take(m)) for m in pair]
            else:
                own[-1] = (n, take(n))
        bins.append([i for _, i in own])
    return bins


def place(pieces: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """``pieces`` (doc_id, piece, place, length and any others) with sequence_id and offset in place of ``place``.

    ``place`` is a number of the row's own, whatever its doc_id. ``sequence_id`` is made of a
    group's number and a bin's; offsets are gapless from 0. Every row is kept.
    """
    groups = max(1, -(-pieces.count() // group))
    dealt = pieces.withColumn("_g", F.pmod(F.xxhash64("place"), F.lit(groups)))
    kept = [f for f in pieces.schema.fields if f.name != "place"]

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "place"], ascending=[False, True], ignore_index=True)
        bins = best_two_fit(rows["length"].tolist(), length)
        number = np.repeat(np.arange(len(bins), dtype=np.int64), [len(b) for b in bins])
        out = rows.drop(columns=["_g", "place"]).iloc[np.array([i for b in bins for i in b], dtype=np.int64)].reset_index(drop=True)
        before = out["length"].cumsum() - out["length"]
        return out.assign(sequence_id=(int(key[0]) << 32) + number, offset=before - before.groupby(number).transform("min"))

    schema = T.StructType([*kept, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return dealt.groupBy("_g").applyInPandas(pack, schema)


def stored(pieces: DataFrame, with_ids: bool) -> DataFrame:
    """`tokenize`'s pieces, with their ids or ids_crc32, written once, each with a ``place`` of its own."""
    ids = F.col("ids") if with_ids else F.crc32("ids").alias("ids_crc32")
    return cut(pieces.select("doc_id", "piece", "start", "length", ids, F.monotonically_increasing_id().alias("place")))


def pack_documents(docs: DataFrame, encode: tuple, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """Placed pieces: doc_id, piece, start, length, ids (or their ids_crc32), sequence_id, offset.

    ``encode``: the arguments of `encoder`. Null and empty texts are a document of END alone.
    Rows that share a doc_id are documents of their own. An empty table gives no rows; other
    columns are not looked at.
    """
    pieces = tokenize(docs, encode, length)
    return place(stored(pieces, with_ids), length)
