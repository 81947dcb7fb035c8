"""Document fingerprints by consistent weighted sampling (DataFrame functions only).

Every distinct word of a text is a term weighted by its number of occurrences. For sample
``s`` a term ``k`` of weight ``S`` draws, from hashes of ``(k, s)`` alone,

    r ~ Gamma(2, 1),  c ~ Gamma(2, 1),  b ~ Uniform(0, 1)
    t = floor(ln S / r + b),   ln a = ln c - r (t - b + 1)

and the term with the least ``a`` wins. Two texts agree on the winning ``(k, t)`` with a
probability equal to their generalised Jaccard similarity sum(min) / sum(max), so the share
of equal samples estimates it.

Words are not exploded per sample: one pass turns the texts of a row into (term, weight) rows,
each marked with the texts that have the term with that weight, whose draws are the same; one
aggregation keeps the least ``a`` of each sample and mark. All of it groups by the row's key, by
which the rows are dealt once, so no exchange carries terms, and no group is larger than one row's texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import body_of, cut, partitions, repeated

#: Samples in a fingerprint; the likeness of two has a standard error of at most 0.073.
SAMPLES = 48
#: Bits kept of a winner's identity (term, t): two different winners look equal once in 65,536.
ID_BITS = 16
_UNIT = 1.0 / (1 << 20)


def _uniform(bits: Column, shift: int) -> Column:
    """20 bits of a hash as a number in (0, 1)."""
    return (F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << 20) - 1)).cast("double") + 0.5) * _UNIT


def _sample(term: Column, weight: Column, s: int) -> Column:
    """The rank of a term of log weight ``weight`` in sample ``s`` (high bits: ln a, low bits: identity); the least wins."""
    u, v = F.xxhash64(term, F.lit(2 * s)), F.xxhash64(term, F.lit(2 * s + 1))
    r = -F.log(_uniform(u, 44) * _uniform(u, 24))
    ln_c = F.log(-F.log(_uniform(v, 44) * _uniform(v, 24)))
    b = _uniform(u, 4)
    t = F.floor(weight / r + b)
    ln_a = ln_c - r * (t - b + 1.0)
    rank = F.shiftleft(((ln_a + 512.0) * 4194304.0).cast("bigint"), ID_BITS)
    # the low bits of v, which no draw uses, tell terms apart, and the odd factor tells t apart
    return rank.bitwiseOR((v.bitwiseAND(F.lit((1 << ID_BITS) - 1)) + t * 40503).bitwiseAND(F.lit((1 << ID_BITS) - 1)))


def _terms(text: Column) -> Column:
    return F.split(F.lower(text), r"\s+")


def fingerprints(texts: DataFrame, keys: list[str], columns: list[str], carry: tuple[str, ...] = (), samples: int = SAMPLES, dealt: bool = False) -> DataFrame:
    """One row per key of ``texts``: the keys, ``c_fp`` (array<int>) for each text column ``c``, ``carry``.

    ``keys`` together must be unique and not null. ``dealt``: ``texts`` is hash-partitioned by
    the keys already, as after a join on them. All text columns of a row share the draws of a
    term. ``carry`` names bigint columns that come along unchanged. A null, empty or blank
    text has no term: its fingerprint is ``samples`` times -1, equal to that of any such text.
    """
    rows = texts.select(*keys, *columns, *carry)
    rows = rows if dealt else rows.repartition(partitions(texts.sparkSession), *keys)
    every, least = range(len(columns)), [F.max(c).alias(c) for c in carry]
    which = F.array(*[F.struct(F.lit(i).alias("i"), _terms(F.coalesce(F.col(c), F.lit(""))).alias("terms")) for i, c in enumerate(columns)])
    words = rows.select(*keys, *carry, F.explode(which).alias("x")).select(*keys, *carry, F.col("x.i").alias("i"), F.posexplode("x.terms").alias("p", "term"))
    first = (F.col("i") == 0) & (F.col("p") == 0)  # one row of each text brings what it carries
    counted = words.select(*keys, "i", F.when(F.col("term") != "", F.xxhash64("term")).alias("term"), *[F.when(first, F.col(c)).alias(c) for c in carry]).groupBy(*keys, "term").agg(
        *[F.sum(F.when(F.col("i") == i, 1).otherwise(0)).alias(f"n{i}") for i in every], *least
    )
    of = lambda n: F.when(F.col("term").isNotNull() & (F.col(n) > 0), F.col(n))
    # a row for each weight that a term has: texts with the same one share its draws
    weighed = counted.select(*keys, "term", *carry, *[f"n{i}" for i in every], F.explode_outer(F.array_compact(F.array_distinct(F.array(*[of(f"n{i}") for i in every])))).alias("n"))
    mark = sum((F.when(F.col(f"n{i}") == F.col("n"), 1 << i).otherwise(0) for i in every), F.lit(0))
    logs = weighed.select(*keys, "term", *carry, mark.alias("mark"), F.when(F.col("n") == 1, F.lit(0.0)).otherwise(F.log("n")).alias("w"))
    of_mark = logs.groupBy(*keys, "mark").agg(*[F.min(_sample(F.col("term"), F.col("w"), s)).alias(f"m{s}") for s in range(samples)], *least)
    low = F.lit((1 << ID_BITS) - 1)
    own = lambda i, s: F.min(F.when(F.col("mark").bitwiseAND(F.lit(1 << i)) > 0, F.col(f"m{s}")))
    prints = [F.array(*[F.coalesce(own(i, s).bitwiseAND(low), F.lit(-1)).cast("int") for s in range(samples)]).alias(f"{c}_fp") for i, c in enumerate(columns)]
    return of_mark.groupBy(*keys).agg(*prints, *least)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples of two fingerprints: their estimated generalised Jaccard similarity."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return equal / F.size(a)


def as_text(fp: Column) -> Column:
    """A fingerprint as fixed-width lowercase hex."""
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit((1 << ID_BITS) - 1)))), ID_BITS // 4, "0")), "")


def with_next(ids: DataFrame, order: list[str]) -> DataFrame:
    """``ids`` with ``next_<column>`` for each order column: the next row's, after the last the first's.

    Rows are range-partitioned and written once with the number of their range, so that each
    range is a window of its own; only the first row of each range crosses to the one before.
    """
    spark = ids.sparkSession
    ranged = cut(ids.repartitionByRange(partitions(spark), *order).withColumn("_range", F.spark_partition_id()))
    row = F.struct(*[F.col(c) for c in order])
    heads = ranged.groupBy("_range").agg(F.min(row).alias("_head"))  # a row per range
    by = W.orderBy("_range")  # at most as many rows as there are shuffle partitions
    heads = heads.select("_range", F.coalesce(F.lead("_head").over(by), F.first("_head").over(by)).alias("_after"))
    inner = ranged.withColumn("_lead", F.lead(row).over(W.partitionBy("_range").orderBy(*order)))
    out = inner.join(F.broadcast(heads), "_range")
    nxt = F.coalesce(F.col("_lead"), F.col("_after"))
    return out.select(*ids.columns, *[nxt[c].alias(f"next_{c}") for c in order])


#: What tells documents apart, in their order: null ids first, the id, a hash of the text.
KEYS = ["_known", "_id", "_body"]


def keyed_documents(docs: DataFrame) -> DataFrame:
    """KEYS, text, n_chars and copies (rows equal in doc_id and text): a row per document."""
    text = F.coalesce("text", F.lit(""))
    known, zero = F.col("doc_id").isNotNull().cast("int"), F.lit("0").cast(docs.schema["doc_id"].dataType)
    keyed = docs.select(known.alias("_known"), F.coalesce("doc_id", zero).alias("_id"), body_of(text).alias("_body"), text.alias("text"))
    return keyed.groupBy(*KEYS).agg(F.first("text").alias("text"), F.count("*").alias("copies")).withColumn("n_chars", F.length("text").cast("long"))


def edited_documents(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """KEYS, again, text and edited; ``ids``: what `with_next` gives for the keys, n_chars and copies of ``docs``.

    The last of a document's copies (again = 0) is followed by the next document, each of the
    others (again = 1, a single row for them all) by another copy.
    """
    to = [F.col(c).alias(f"to{c}") for c in KEYS]
    want = F.floor(F.col("n_chars") / 4).cast("int").alias("want")
    asked = ids.select(*[F.col(f"next_{c}").alias(c) for c in KEYS], *to, F.lit(0).alias("again"), want)
    asked = asked.unionByName(ids.filter("copies > 1").select(*KEYS, *to, F.lit(1).alias("again"), want))
    heads = docs.join(asked, KEYS).select(*[F.col(f"to{c}").alias(c) for c in KEYS], "again", F.expr("substring(text, 1, want)").alias("head"))
    return docs.join(heads, KEYS).select(*KEYS, "again", "text", F.expr("concat(substring(text, 1, int(n_chars - floor(n_chars / 4))), head)").alias("edited"))


def document_fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprint each document and its edited text; liken it to that text and to its successor.

    The edited text: the last floor(n_chars / 4) code points give way to as many first ones
    of the next document by ascending doc_id (after the last comes the first). Returns doc_id,
    n_chars, edited_sha256, fingerprint and edited_fingerprint (arrays), near_edited and
    near_next, a row per row of ``docs``. A null text counts as empty. Null ids come first; rows of
    one doc_id follow each other by a hash of their texts, and of rows equal in both each but the
    last is followed by another. An empty table gives no rows; other columns are not looked at.
    """
    one = keyed_documents(docs)
    ids = cut(with_next(one.select(*KEYS, "n_chars", "copies"), KEYS))
    pairs = edited_documents(one, ids)
    sha = F.sha2(F.encode("edited", "UTF-8"), 256)
    parts = [f"_sha{i}" for i in range(4)]  # a digest as four longs, which stay in the aggregation's fixed-width rows
    pairs = pairs.withColumns({c: F.conv(F.substring(sha, 16 * i + 1, 16), 16, -10).cast("bigint") for i, c in enumerate(parts)})
    prints = cut(fingerprints(pairs, [*KEYS, "again"], ["text", "edited"], tuple(parts), samples, dealt=True))
    after = prints.filter("again = 0").select(*[F.col(c).alias(f"next_{c}") for c in KEYS], F.col("text_fp").alias("next_fp"))
    out = ids.join(prints, KEYS).join(after, [f"next_{c}" for c in KEYS])
    near_next = F.when(F.col("again") == 1, F.lit(1.0)).otherwise(likeness(F.col("text_fp"), F.col("next_fp")))
    out = out.withColumn("times", F.when(F.col("again") == 1, F.col("copies") - 1).otherwise(F.lit(1).cast("long"))).select(
        F.when(F.col("_known") == 1, F.col("_id")).alias("doc_id"), "n_chars", F.concat(*[F.lower(F.lpad(F.hex(c), 16, "0")) for c in parts]).alias("edited_sha256"),
        F.col("text_fp").alias("fingerprint"), F.col("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("text_fp"), F.col("edited_fp")).alias("near_edited"), near_next.alias("near_next"), "times",
    )
    return repeated(out, "times")
