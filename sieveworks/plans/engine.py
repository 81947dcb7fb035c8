"""The search engine: one plan for one query or many."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from enum import StrEnum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompts
from ..operators import dense, fusion, sparse
from ..operators.providers import overlap_score


class Method(StrEnum):
    DENSE = "Dense"
    SPARSE = "BM25"
    UNION = "Union"
    RRF = "RRF"
    RERANKED = "RRF+Rerank"


#: Candidates of each leg, and of the fusion, before the reranker.
STAGE_K = 20


@dataclass
class Engine:
    """chunks (chunk_id, text, source, section), vectors (chunk_id, embedding), a sparse index, providers."""

    chunks: DataFrame
    vectors: DataFrame
    index: sparse.SparseIndex
    encode: Callable[[Column], Column]
    scorer: Callable[[Column, Column], Column] | None = overlap_score
    tokenizer: Callable[[Column], Column] = field(default=sparse.tokens)

    @property
    def spark(self) -> SparkSession:
        return self.chunks.sparkSession

    def queries(self, texts: list[str]) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")

    def dense(self, queries: DataFrame, k: int) -> DataFrame:
        q = queries if "embedding" in queries.columns else queries.withColumn("embedding", self.encode(F.col("query")))
        return dense.search(self.vectors, q, k)

    def sparse(self, queries: DataFrame, k: int) -> DataFrame:
        return sparse.search(self.index, queries, k, self.tokenizer)

    def retrieve(self, queries: DataFrame, k: int = 10, method: str | Method = Method.RRF) -> DataFrame:
        """query_id, chunk_id, rank, score (and more by method). An unknown method is an error, as is reranking without a scorer."""
        method = Method(method)
        if method is Method.RERANKED:
            if self.scorer is None:
                raise ValueError("RRF+Rerank needs a scorer")
            fused = fusion.weighted_fusion(self.dense(queries, STAGE_K), self.sparse(queries, STAGE_K), STAGE_K)
            return fusion.rerank(queries, fused, self.chunks, self.scorer, k)
        if method is Method.DENSE:
            return self.dense(queries, k)
        if method is Method.SPARSE:
            return self.sparse(queries, k)
        merge = fusion.union_merge if method is Method.UNION else fusion.weighted_fusion
        return merge(self.dense(queries, k), self.sparse(queries, k), k)

    def search(self, queries: DataFrame, k: int = 5, use_reranker: bool = True) -> DataFrame:
        """query_id, rank, text, source, section, score: the service's answer, texts joined last.

        Without a scorer the fused score stands in.
        """
        rerank = use_reranker and self.scorer is not None
        hits = self.retrieve(queries, k, Method.RERANKED if rerank else Method.RRF)
        score = F.col("rerank_score" if rerank else "score")
        out = hits.select("query_id", "chunk_id", "rank", score.alias("score")).join(self.chunks, "chunk_id")
        return out.select("query_id", "rank", "chunk_id", "text", F.coalesce("source", F.lit("未知来源")).alias("source"), "section", "score")

    def reply(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """query_id, reply: formatted hits; several queries are one plan."""
        return prompts.format_hits(self.search(queries, k).withColumnRenamed("score", "rerank_score"), queries)

    def prompts(self, queries: DataFrame, k: int = 5, method: str | Method = Method.RERANKED) -> DataFrame:
        """query_id, prompt: questions with their contexts, ready for a generator."""
        hits = self.retrieve(queries, k, method).select("query_id", "chunk_id", "rank").join(self.chunks.select("chunk_id", "text"), "chunk_id")
        listed = hits.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("contexts"))
        return queries.join(listed, "query_id", "left").select("query_id", prompts.build_prompt(F.col("query"), F.col("contexts")).alias("prompt"), "contexts")

    def status(self) -> dict:
        return {"chunks": self.chunks.count(), "vectors": self.vectors.count(), "reranker": self.scorer is not None}
