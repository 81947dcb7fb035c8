"""Incremental ingest (an extension): documents arriving as files become chunks and vectors once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions import text as X


def chunk_and_encode(docs: DataFrame, encode: Callable[[Column], Column], limit: int = X.CHUNK_CHARS) -> DataFrame:
    """doc_id, chunk_no, text, embedding of documents (doc_id, text): no shuffle, so it runs on a stream as it is."""
    pieces = docs.select("doc_id", F.posexplode(X.split_by_sentences(F.col("text"), limit, "。；.;")).alias("chunk_no", "text"))
    return pieces.withColumn("embedding", encode(F.col("text")))


def ingest(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, encode: Callable[[Column], Column], once: bool = True) -> StreamingQuery:
    """Read new Parquet files of ``source``, append their chunks to ``target``; progress is kept in ``checkpoint``.

    Rows of a micro-batch that repeat both doc_id and text are dropped, and batches are written by batch id,
    so a batch that runs twice after a failure leaves one copy.
    """

    def write(batch: DataFrame, number: int) -> None:
        chunk_and_encode(batch.dropDuplicates(["doc_id", "text"]), encode).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
