"""SimHash near-duplicates found by Golay-code fuzzy hashing.

The 64 bits of a fingerprint are cut into segments of 22, 21 and 21 bits, each padded to 23.
The binary Golay code of length 23 is perfect: every 23-bit word lies within 3 bits of exactly
one codeword. A segment's *indices* are those of the codewords nearest to the word itself and
to its 23 one-bit neighbours: one index or six. Two words that differ in at most two bits have
a word within one bit of both, so they share an index.

Two differing bits leave at least one of three segments without any (pigeonhole), and at most
two in the next. So a key is a whole segment plus an index of the next segment: 3 to 18 keys a
fingerprint, and any two fingerprints within two bits share one. Rows that share a key are
joined and verified bit by bit.

Only distinct fingerprints are joined. Keys with up to ``SMALL`` fingerprints are compared in
place. Fingerprints of fuller keys are linked exactly through the words within one bit of
them, which two fingerprints share iff they are within two bits: such a word has at most 65
fingerprints, however many copies there are, so no group emits all of its pairs.

Texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 differ in about 10 of 64
bits, which no affordable number of segments bridges. For these, ``near_duplicates`` takes the keys
above and minima of BANDS groups of ROWS random orders of the shingles, of which two such texts
share one with a chance of 0.998, and links the candidates whose exact similarity suffices. Texts that
share a key with very many others (a template's, say) are joined on the rare ends of their sets, which
misses no pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body_of, cut, hot_join, named_rows, order_of, same_row, settle, small_batches, unpacked

#: The generator polynomial of the binary Golay code, and the segments (shift, bits).
GENERATOR = 0b101011100011
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Most differing bits between linked fingerprints.
DISTANCE = 2
#: Fingerprints or sets that a key may have to be compared pair by pair.
SMALL = 48
#: Groups of minima, and minima in each.
BANDS, ROWS = 16, 5
#: Size of the sketch that says which shingles are common in crowds.
SKETCH_BITS = 20
_rng = np.random.default_rng(11)
#: Random orders of shingles: a hash is mixed by a XOR and an odd factor.
MIX, FACTOR = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64), _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@cache
def golay_indices() -> np.ndarray:
    """For every 23-bit word the index (12 bits) of the codeword within 3 bits of it."""
    data = np.arange(1 << 12, dtype=np.int64)
    code = np.zeros(1 << 12, dtype=np.int64)
    for bit in range(12):
        code ^= np.where(data >> bit & 1, GENERATOR << bit, 0)
    nearest = np.empty(1 << 23, dtype=np.int16)
    flips = [0] + [1 << a for a in range(23)] + [1 << a | 1 << b for a in range(23) for b in range(a)]
    flips += [1 << a | 1 << b | 1 << c for a in range(23) for b in range(a) for c in range(b)]
    for flip in flips:
        nearest[code ^ flip] = data
    return nearest


def fuzzy_keys(fps: np.ndarray) -> list[np.ndarray]:
    """The keys of each fingerprint (uint64 in, int64 out)."""
    table = golay_indices()
    flips = np.array([0] + [1 << b for b in range(23)], dtype=np.int64)
    words = [(fps >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.int64) for shift, bits in SEGMENTS]
    near = [table[w[:, None] ^ flips[None, :]].astype(np.int64) for w in words]
    keys = [(w[:, None] << 14 | near[(i + 1) % 3] << 2 | i) for i, w in enumerate(words)]
    return [np.unique(row) for row in np.concatenate(keys, axis=1)]


def simhash(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of ``text``, repeats included, unsigned."""
    return _bits(shingle_hashes(text, words, seed))


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """Hashes of the word shingles of ``text``, repeats included; a text of fewer words is one shingle."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    shingles = [b" ".join(x) for x in zip(*(tokens[i:] for i in range(words)), strict=False)] if len(tokens) >= words else [b" ".join(tokens)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, seed) for s in shingles), dtype=np.uint64, count=len(shingles))


def _bits(h: np.ndarray) -> int:
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 8192):
        ones += np.unpackbits(h[i : i + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def band_keys(h: np.ndarray) -> list[int]:
    """A signed key for each band of a set of shingle hashes; none for an empty set."""
    if not len(h):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(h), 4096):
        least = np.minimum(least, ((h[i : i + 4096, None] ^ MIX) * FACTOR).min(axis=0))
    return [_signed(xxhash.xxh64_intdigest(b.tobytes(), k)) for k, b in enumerate(least.reshape(BANDS, ROWS))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_documents(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, body (a hash of the text) and fp (the fingerprint's bits as a signed bigint), a row per row of ``docs``."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("bigint")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([_signed(simhash(t, words)) for t in texts], dtype=np.int64)

    return docs.select("doc_id", body_of(F.col("text")).alias("body"), fp("text").alias("fp"))


def near_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect all distinct ``fp`` within DISTANCE bits of each other.

    Every pair within DISTANCE is linked directly or, among fingerprints of full keys, over a
    third fingerprint that is linked to both.
    """

    @F.pandas_udf("array<bigint>")
    def keys_of(fp: pd.Series) -> pd.Series:
        return pd.Series(fuzzy_keys(fp.to_numpy().astype(np.int64).view(np.uint64)))

    keyed = cut(fps.select("fp").select("fp", F.explode(keys_of("fp")).alias("key")))
    shared = cut(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    cand = cut(hot_join(keyed, shared, "key"))
    few = cand.filter(F.col("n") <= SMALL).groupBy("key").agg(F.collect_list("fp").alias("fps"))  # at most SMALL in a list
    left = few.select("fps", F.explode("fps").alias("a"))
    pairs = left.select("a", F.explode("fps").alias("b")).filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE))
    many = cand.filter(F.col("n") > SMALL).select("fp").distinct()
    middles = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << b)).cast("bigint")) for b in range(64)])
    spread = many.select("fp", F.explode(middles).alias("middle"))
    stars = spread.groupBy("middle").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)  # at most 65 in a list
    stars = stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b")
    return pairs.union(stars).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of ``links`` (a, b): root is the least node of its component.

    Alternates two steps until nothing changes: hang the greater neighbours of each node on its
    least neighbour, then hang each node's lesser neighbours on the least. Rounds grow with the
    logarithm of the largest component. Every round is cut; nothing is gathered on the driver, and
    nodes with very many links (the least of a large component) are joined apart.
    """
    spark = links.sparkSession

    def large(e: DataFrame, count: int) -> DataFrame:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        return hot_join(both, least, "u", total=2 * count).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()

    def small(e: DataFrame, count: int) -> DataFrame:
        least = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        joined = hot_join(e, least, "u", total=count)
        return joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def contracted() -> DataFrame:
        edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
        before = state(edges)
        while before[0]:
            hung = large(edges, before[0])  # as many at most as there were
            edges = cut(small(hung, before[0]))
            after = state(edges)
            if after == before:
                break
            before = after
        return edges

    edges = settle(spark, contracted)  # the rounds' own tables go
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def _classes(docs: DataFrame, words: int, similarity: float | None) -> tuple[DataFrame, DataFrame]:
    """doc_id, body and fp of every row; fp, n (its rows) and first, the least row (by `order_of`) of its class."""
    if similarity is None:
        prints = cut(fingerprint_documents(docs, words))
        distinct = cut(prints.groupBy("fp").agg(F.min(order_of()).alias("least"), F.count("*").alias("n")))
        links = near_links(distinct)
    else:
        prints, distinct, links = _near_copies(docs, words, similarity)
    roots = components(links)
    # fingerprints without any link keep to themselves
    of = cut(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    ids = cut(of.groupBy("root").agg(F.min("least").alias("first"), F.count("*").alias("prints")))
    return prints, cut(hot_join(of.withColumnRenamed("n", "copies"), ids.withColumnRenamed("prints", "n"), "root").select("fp", F.col("copies").alias("n"), "first"))


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float | None = 0.8) -> DataFrame:
    """doc_id, fp and component_id: the least doc_id of the documents reachable over links.

    Documents are linked if their sets of word shingles have at least this Jaccard similarity
    (``fp`` is a hash of the set), or, without ``similarity``, if their fingerprints ``fp``
    differ in at most DISTANCE bits. A null, empty or blank text has fingerprint 0 and is
    linked with the other ones. A row per row of ``docs``; a null doc_id is never the least
    unless all ids of its component are null. An empty table gives no rows; other columns are
    not looked at.
    """
    prints, named = _classes(docs, words, similarity)
    return hot_join(prints, named, "fp").select("doc_id", "fp", F.col("first.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, similarity: float | None = 0.8) -> DataFrame:
    """One row of every class of `near_duplicates`, with all its columns.

    It is the one with the least doc_id (null ones last), then the least hash of the text. Rows
    of one doc_id with different texts are different documents; of rows equal in both any one stays.
    """
    _, named = _classes(docs, words, similarity)
    first = cut(named.select("first.doc_id", "first.body").distinct())
    rows = named_rows(docs)
    kept = rows.join(first.hint("merge"), same_row(rows, first), "left_semi")
    # the join has dealt the rows by these two already
    return unpacked(kept.groupBy("doc_id", "body").agg(F.first("row").alias("row")), docs.columns)


def _near_copies(docs: DataFrame, words: int, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """doc_id and fp of every row; every fp and its least doc_id; links (a, b) of similar fp.

    Candidates share a band or a key of the SimHash; each is verified on the sets themselves.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("fp bigint, keys array<bigint>")
    def look(texts: pd.Series) -> pd.DataFrame:
        every = [shingle_hashes(t, words) for t in texts]
        sets = [np.unique(h) for h in every]
        fuzzy = fuzzy_keys(np.array([_bits(h) for h in every], dtype=np.uint64)) if every else []
        keys = [band_keys(s) + k.tolist() if len(s) else [] for s, k in zip(sets, fuzzy, strict=True)]
        fps = [_signed(xxhash.xxh64_intdigest(s.tobytes())) if len(s) else 0 for s in sets]
        return pd.DataFrame({"fp": np.array(fps, dtype=np.int64), "keys": keys})

    @F.pandas_udf("array<bigint>")
    def shingles(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, words)).view(np.int64) for t in texts])

    body = body_of(F.col("text")).alias("body")
    prints = cut(docs.select("doc_id", body, look("text").alias("_l")).select("doc_id", "body", "_l.fp", "_l.keys"))
    distinct = cut(prints.groupBy("fp").agg(F.min(order_of()).alias("least"), F.count("*").alias("n"), F.min("body").alias("body"), F.first("keys").alias("keys")))
    pairs, crowds = _pairs(distinct.select("fp", F.explode("keys").alias("key")))
    asked = cut(pairs.select(F.explode(F.array("a", "b")).alias("fp")).union(crowds.select("fp")).distinct().join(distinct.select("fp", "body"), "fp"))
    # one text of each set that is a candidate
    texts = docs.select("text", body).join(asked.select("body"), "body", "left_semi").groupBy("body").agg(F.first("text").alias("text"))
    sets = cut(texts.join(asked, "body").select("fp", shingles("text").alias("s")))
    links = cut(_verified(pairs, sets, similarity))
    if crowds.head(1):
        roots = cut(components(links))
        # a crowd that the links have made one class has nothing left to be found
        placed = cut(crowds.join(roots, F.col("fp") == F.col("node"), "left").select("key", "fp", F.coalesce("root", "fp").alias("root")))
        mixed = placed.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("n")).filter("least <> most")
        apart = cut(hot_join(placed, cut(mixed), "key").select("fp").distinct())
        links = links.union(_verified(_prefix_pairs(sets.join(apart, "fp", "left_semi"), roots, similarity), sets, similarity))
    return prints, distinct, links


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) whose sets (fp, s) are similar."""
    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("fp").alias("b"), F.col("s").alias("sb")), "b")
    both = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("m"), (F.size("sa") + F.size("sb")).alias("n"))
    return both.filter(F.col("m") >= similarity * (F.col("n") - F.col("m")) - 1e-9).select("a", "b")


def _pairs(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs a < b of ``fp`` that share a ``key``; and (key, fp) of crowded keys, whose pairs aren't all among them.

    All pairs of a key with up to SMALL; in a crowded one each is paired with two that a hash
    picks, other ones for every key, which joins most of a class of very many near copies; what
    they leave apart is for `_prefix_pairs`.
    """
    order = F.xxhash64("fp", "key")
    shared = cut(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min_by("fp", order).alias("one"), F.max_by("fp", order).alias("two")).filter("n > 1"))
    cand = cut(hot_join(keyed, shared, "key"))
    few = cand.filter(F.col("n") <= SMALL).groupBy("key").agg(F.collect_list("fp").alias("fps"))  # at most SMALL in a list
    pairs = few.select("fps", F.explode("fps").alias("a")).select("a", F.explode("fps").alias("b"))
    many = cand.filter(F.col("n") > SMALL)
    picked = many.select(F.col("fp").alias("a"), F.explode(F.array("one", "two")).alias("b"))
    return cut(pairs.filter("a < b").union(picked.filter("a <> b").select(F.least("a", "b"), F.greatest("a", "b"))).distinct()), cut(many.select("key", "fp"))


def _prefix_pairs(sets: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of ``sets`` (fp, s) with different ``roots`` (node, root) that may be similar; no similar pair is missing.

    The shingles of a set are put in one order, rare ones first (by a sketch of 2**SKETCH_BITS counts; any order is exact). Of two similar sets of n >= m
    shingles, which share at least t / (1 + t) (n + m), the first n - ceil(t n) + 1 of the larger and
    the first m - ceil(2 t / (1 + t) m) + 1 of the smaller have one in common. What a crowd of texts
    shares comes late in that order. Sets of one root are linked already, so the sets of a shingle's most
    frequent root meet those of other roots only.
    """
    t, spark = similarity, sets.sparkSession
    held = sets.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "s", F.coalesce("root", "fp").alias("root"))
    held = cut(held)
    mask = (1 << SKETCH_BITS) - 1

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for b in batches:
            for s in b["s"]:
                np.add.at(n, s & mask, 1)
        some = np.flatnonzero(n)
        yield pd.DataFrame({"bucket": some, "n": n[some]})

    got = held.select("s").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # 2**SKETCH_BITS rows at most
    often = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    often[got["bucket"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=np.int64)
    shared = spark.sparkContext.broadcast(often)

    @F.pandas_udf("first array<bigint>, size int, upto int")
    def ends(series: pd.Series) -> pd.DataFrame:
        out = []
        for s in series:
            upto = [len(s) - math.ceil(len(s) * x - 1e-9) + 1 for x in (t, 2 * t / (1 + t))]
            out.append((s[np.lexsort((s, shared.value[s & mask]))][: upto[0]], len(s), upto[1]))
        return pd.DataFrame(out, columns=["first", "size", "upto"])

    first = held.select("fp", "root", ends("s").alias("e")).select("fp", "root", "e.size", "e.upto", F.posexplode("e.first").alias("place", "shingle"))
    rows = cut(first.select("shingle", "fp", "root", "size", "place", (F.col("place") < F.col("upto")).alias("early")))
    by_root = rows.groupBy("shingle", "root").agg(F.count("*").alias("of_root"))
    counts = by_root.groupBy("shingle").agg(F.max_by("root", F.struct("of_root", "root")).alias("most"), F.count("*").alias("roots"), F.sum("of_root").alias("n"))
    some = cut(hot_join(rows, cut(counts.filter("roots > 1")), "shingle").select(*rows.columns, "most"))
    side = lambda x: some.select("shingle", *[F.col(c).alias(f"{c}_{x}") for c in ("fp", "root", "size", "place", "early", "most")])
    a, b = side("a").filter("root_a <> most_a"), side("b")
    enough = F.col("size_a") + F.col("size_b")
    fits = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b")) >= enough * (t / (1 + t)) - 1e-9
    alike = F.expr("(size_a >= size_b AND early_b) OR (size_b >= size_a AND early_a)") & (F.least("size_a", "size_b") >= t * F.greatest("size_a", "size_b") - 1e-9)
    met = a.join(b, "shingle").filter((F.col("root_a") != F.col("root_b")) & alike & fits)
    return cut(met.select(F.least("fp_a", "fp_b").alias("a"), F.greatest("fp_a", "fp_b").alias("b")).distinct())
