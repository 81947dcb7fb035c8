"""Which texts contain which strings: a join on minimizers, verified.

Strings of at least 2^t characters are looked for by grams of 2^(t-1) characters: of every 2^(t-1) + 1
grams in a row, which is a window of 2^t characters, a text keeps the one with the least hash. A
string has such a window, so each gram it keeps of its whole windows is kept by every text that contains it, wherever
it stands; the texts' rows are a fraction of their characters, none is a pair, and no match is
missed. Each string is joined by one of its grams, the one that the fewest strings keep, and what meets is compared as text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut, small_batches

#: Strings of 2^TIERS characters and more share one gram length.
TIERS = 6
#: The filter of the grams that strings ask for has 2^FILTER_BITS bits (2 MB), PLACES of them for each gram.
FILTER_BITS, PLACES = 24, 4
#: Bytes of strings and their texts' hashes up to which Spark may send them to all tasks, by its own limit, in place of moving texts (it knows their
#: table, in which a repeated string takes little room); and the parts that the texts of a string are dealt into.
SMALL, DEALT = 16 << 20, 16
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _first(codes: np.ndarray) -> np.ndarray:
    return (codes.astype(np.uint64) + np.uint64(1)) * _FACTOR


def _doubled(h: np.ndarray, step: int, size: int) -> np.ndarray:
    """Of the hashes of ``step`` characters in a row those of ``size`` (both powers of two)."""
    while step < size:
        h = (h[:-step] ^ (h[:-step] >> np.uint64(31))) * _FACTOR + h[step:]
        step *= 2
    return h


def _mixed(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(29))) * _FACTOR


def _size(tier: int) -> int:
    """The characters of a tier's grams."""
    return 1 << (tier - 1) if tier else 1


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` hashes in a row."""
    least, step = h, 1
    while step < width:  # the least of ``step`` grams in a row, until it is that of ``width``
        more = min(step, width - step)
        least = np.minimum(least[: len(least) - more], least[more:])
        step += more
    return least


def minimizers(text: str, tier: int) -> np.ndarray:
    """The kept grams of a text, as hashes, each once; none if it is shorter than 2^tier."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(codes) < 1 << tier:
        return np.zeros(0, dtype=np.int64)
    h = _mixed(_doubled(_first(codes), 1, _size(tier)))
    return np.unique(_least(h, (1 << tier) - _size(tier) + 1)).view(np.int64)


def _kept(text: str, tiers: list[int]) -> np.ndarray:
    """The kept grams of a text for several ascending tiers: `minimizers` of each, but some may come twice. Longer grams are hashed from shorter ones."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    h, size, found = _first(codes), 1, [np.zeros(0, dtype=np.uint64)]
    for tier in tiers:
        if len(codes) < 1 << tier:
            break
        h, size = _doubled(h, size, _size(tier)), _size(tier)
        least = _least(_mixed(h), (1 << tier) - size + 1)
        found.append(least[np.append(True, least[1:] != least[:-1])])
    return np.concatenate(found)


def _place(grams: np.ndarray, i: int) -> np.ndarray:
    """The ``i``-th bit of each gram (uint64) in the filter; kept grams are the least of their windows, so they are hashed anew."""
    x = grams * _FACTOR
    if i > 1:
        x = (grams ^ (x >> np.uint64(32))) * _FACTOR
    return (x >> np.uint64(64 - FILTER_BITS * (1 + i % 2)) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)


def _asked(grams: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Those of ``grams`` that have all their bits, each once; the others are asked for by none."""
    for i in range(PLACES):
        at = _place(grams, i)
        grams = grams[(known[at >> 3] >> (at & 7)) & 1 > 0]
    return np.unique(grams)


def _filter(chosen: DataFrame) -> np.ndarray:
    """PLACES bits for every gram that strings ask for, of 2^FILTER_BITS, however many they are. A gram that lacks one is asked for by none."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, dtype=bool)
        for batch in batches:
            grams = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(PLACES):
                bits[_place(grams, i)] = True
        packed = np.packbits(bits, bitorder="little").reshape(-1, 1 << 12)
        rows = np.flatnonzero(packed.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array([packed[r].tobytes() for r in rows], pa.binary())], ["row", "bits"])

    @F.pandas_udf("binary")
    def either(some: pd.Series) -> bytes:
        return np.bitwise_or.reduce([np.frombuffer(x, dtype=np.uint8) for x in some]).tobytes()

    parts = chosen.select("gram").mapInArrow(fold, "row long, bits binary").groupBy("row").agg(either("bits").alias("bits")).collect()  # 2 MB at most
    out = np.zeros((1 << (FILTER_BITS - 15), 1 << 12), dtype=np.uint8)
    for r in parts:
        out[r["row"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out.ravel()


def tier_of(text: Column) -> Column:
    """The tier whose windows a string has."""
    return F.least(F.floor(F.log2(F.length(text)) + 1e-9), F.lit(TIERS)).cast("int")


def containing(strings: DataFrame, texts: DataFrame) -> DataFrame:
    """string_id, text_id: every pair of ``strings`` (string_id, string) and ``texts`` (text_id, text) whose text contains the string.

    Null and empty strings are in no pair, null texts contain nothing. Ids needn't be unique: equal
    pairs come as often as their rows are. Empty tables give no rows.
    """
    small_batches(texts.sparkSession)
    # a string's number is written with it, so that it stays
    wanted = cut(strings.filter("string <> ''").groupBy("string").agg(F.collect_list(F.struct("string_id")).alias("ids")).withColumns({"s": F.monotonically_increasing_id(), "tier": tier_of(F.col("string"))}))
    tiers = sorted(r["tier"] for r in wanted.select("tier").distinct().collect())  # TIERS + 1 at most

    @F.pandas_udf("array<bigint>")
    def own_grams(some: pd.Series, tier: pd.Series) -> pd.Series:
        return pd.Series([minimizers(x, int(t)) for x, t in zip(some, tier, strict=True)], dtype=object)

    @F.pandas_udf("array<bigint>")
    def every_gram(some: pd.Series) -> pd.Series:
        return pd.Series([np.unique(_kept(x, tiers)).view(np.int64) for x in some], dtype=object)

    @F.pandas_udf("array<bigint>")
    def asked_grams(some: pd.Series) -> pd.Series:
        return pd.Series([_asked(_kept(x, tiers), known.value).view(np.int64) if x else [] for x in some], dtype=object)

    # any gram of a string finds all texts that contain it; the one that the fewest strings keep is in few texts
    often = wanted.select(F.explode(every_gram("string")).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    keyed = wanted.select("s", F.explode(own_grams("string", "tier")).alias("gram"))
    chosen = cut(keyed.join(often, "gram").groupBy("s").agg(F.min(F.struct("n", "gram")).alias("r")).select("s", "r.gram"))
    known = texts.sparkSession.sparkContext.broadcast(_filter(chosen))
    # equal texts stand for each other; for the grams no text is moved
    named = texts.filter("text is not null").select("text_id", F.xxhash64("text").alias("body"), "text")
    met = named.select("body", F.explode(asked_grams("text")).alias("gram")).distinct()
    # a string goes to the texts that may contain it, and each text is moved once at most, however many strings may be in it
    pairs = cut(met.join(chosen.join(wanted.select("s", "string"), "s"), "gram").select("body", "s", "string"))
    size = pairs.agg(F.sum(F.octet_length("string") + 16).alias("bytes")).first()["bytes"] or 0  # one row
    verified = named.join(pairs if size <= SMALL else pairs.hint("merge"), "body").filter(F.contains("text", "string")).select("text_id", "s")
    # the ids come last, so that no row of the result is moved; those of a string that is in many texts are dealt out
    dealt = wanted.select("s", "ids", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("part"))
    every = verified.withColumn("part", F.pmod(F.xxhash64("text_id", F.lit("part")), F.lit(DEALT)).cast("int")).join(dealt, ["s", "part"])
    return every.select(F.explode("ids").alias("id"), "text_id").select("id.string_id", "text_id")
