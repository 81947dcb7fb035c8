"""Fusion of a dense and a sparse result list, and reranking. Ranks count from 1."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _legs(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """query_id, chunk_id, d, ds, s, ss: the rank and score of each hit in either leg.

    A join, not a union that is grouped: both legs come partitioned by query_id, and Spark 4.1 takes
    their union to be so too though it may have coalesced the legs' partitions differently.
    """
    a = dense.select("query_id", "chunk_id", F.col("rank").alias("d"), F.col("score").alias("ds"))
    b = sparse.select("query_id", "chunk_id", F.col("rank").alias("s"), F.col("score").alias("ss"))
    return a.join(b, ["query_id", "chunk_id"], "full_outer")


def union_merge(dense: DataFrame, sparse: DataFrame, k: int = 20) -> DataFrame:
    """Dense hits in their order, then the sparse hits that dense lacks; the dense copy of a hit stays."""
    sizes = dense.groupBy("query_id").agg(F.count("*").alias("_n"))
    every = _legs(dense, sparse).join(sizes, "query_id", "left")
    order = F.coalesce(F.col("d"), F.col("s") + F.coalesce("_n", F.lit(0)))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(order))
    retriever = F.when(F.col("d").isNotNull(), "dense").otherwise("sparse")
    ranked = every.withColumn("rank", rank).filter(F.col("rank") <= k)
    return ranked.select("query_id", "chunk_id", "rank", F.coalesce("ds", "ss").alias("score"), retriever.alias("retriever"))


def weighted_fusion(dense: DataFrame, sparse: DataFrame, k: int = 20, rrf_k: int = 60, dense_weight: float = 0.5, sparse_weight: float = 0.5) -> DataFrame:
    """Reciprocal rank fusion: score = sum of weight / (rrf_k + rank); ties by dense, then sparse rank."""
    part = lambda w, r: F.coalesce(F.lit(float(w)) / (rrf_k + F.col(r)), F.lit(0.0))
    scored = _legs(dense, sparse).withColumn("score", F.round(part(dense_weight, "d") + part(sparse_weight, "s"), 9))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("d"), F.asc_nulls_last("s")))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "chunk_id", "rank", "score", F.lit("fusion").alias("retriever"))


def rerank(queries: DataFrame, candidates: DataFrame, texts: DataFrame, scorer: Callable[[Column, Column], Column], k: int = 10) -> DataFrame:
    """The ``k`` best candidates by ``scorer(query, text)``; the former score and rank stay as prior ones.

    Texts are joined only to the candidates, after all pruning.
    """
    pairs = candidates.join(texts.select("chunk_id", "text"), "chunk_id").join(queries.select("query_id", "query"), "query_id")
    scored = pairs.withColumn("rerank_score", F.round(scorer(F.col("query"), F.col("text")), 6)).withColumnRenamed("rank", "prior_rank")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("rerank_score"), "prior_rank"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "chunk_id", "rank", "score", "rerank_score", "prior_rank")


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by ``order``, all columns."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(order))
    return df.withColumn("_r", rank).filter("_r = 1").drop("_r")


def top_with_ties(df: DataFrame, score: str, n: int) -> DataFrame:
    """All rows whose score is at least the n-th best one; fewer than n rows stay as they are.

    The n-th best score is found first (n rows per task meet), so no window holds the table.
    """
    edge = df.select(F.col(score).alias("_edge")).orderBy(F.desc("_edge")).limit(n).agg(F.min("_edge").alias("_edge"))
    return df.crossJoin(F.broadcast(edge)).filter(F.col(score) >= F.col("_edge")).drop("_edge")


def sample_by_hash(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows, the same ones every time: the least by md5 of key and seed."""
    return df.withColumn("_h", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))).orderBy("_h", key).limit(n).drop("_h")
