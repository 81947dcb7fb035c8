"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut, settle, shared_folder, small_batches

#: A key with more rows than this share of all, and than this many, is joined apart from the others.
HOT_SHARE, HOT_ROWS = 1e-4, 100_000

__all__ = ["body_of", "cut", "held_out", "hot_join", "named_rows", "order_of", "partitions", "repeated", "same_row", "settle", "shared_folder", "small_batches", "table", "unpacked"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the documents that no model here learns from: crc32 of the id as text, mod 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def named_rows(docs: DataFrame) -> DataFrame:
    """row (all columns of ``docs``), doc_id, text, body: rows under a name, whatever their columns are called.

    (doc_id, body) tells rows of one doc_id with different texts apart: ``body`` is a hash of the
    text. Rows equal in both have the same text.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, F.col("doc_id"), F.col("text"), body_of(F.col("text")).alias("body"))


def body_of(text: Column) -> Column:
    return F.xxhash64(text)


def order_of(doc_id: str = "doc_id", body: str = "body", *more: str) -> Column:
    """What documents are ordered by: doc_id (null ones last), then the text's hash."""
    return F.struct(F.col(doc_id).isNull().alias("unknown"), F.col(doc_id).alias("doc_id"), F.col(body).alias("body"), *more)


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["body"] == b["body"])


def unpacked(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of ``row``, with some of them replaced."""
    return rows.select(*[changed[c].alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in columns])


def hot_join(rows: DataFrame, counted: DataFrame, key: str, least: int = HOT_ROWS, total: int | None = None) -> DataFrame:
    """``rows`` inner-joined to ``counted`` on ``key``; ``counted`` has ``n``, the rows of the key, and keys once each.

    ``total`` is the sum of ``n``, where it is known.

    Keys with more than HOT_SHARE of all rows (and more than ``least``) are so few, 10,000 at
    most, that they are broadcast: no task of the shuffle gets a hot key's rows.
    """
    total = (counted.agg(F.sum("n")).first()[0] or 0) if total is None else total
    edge = max(least, int(total * HOT_SHARE))
    if total <= edge:  # no key can be hot
        return rows.join(counted, key)
    hot = F.broadcast(counted.filter(F.col("n") > edge))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(counted.filter(F.col("n") <= edge), key))


def repeated(rows: DataFrame, times: str) -> DataFrame:
    """Each row ``times`` times (a column that goes); no array grows beyond a root of the number."""
    step = 1 << 14
    blocks = rows.filter(F.col(times) > 0).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1, F.lit(step).cast("long"))))
    some = F.sequence(F.lit(1).cast("long"), F.least(F.col(times) - F.col("_from"), F.lit(step).cast("long")))
    return blocks.withColumn("_each", F.explode(some)).drop("_from", "_each", times)
