"""Experiment plans: distinct (method, model, reranker) in order of first mention, and a run over all of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fusion
from ..operators.evaluation import KS, means
from ..operators.fusion import keep_first
from ..storage import cut


def expand(spark: SparkSession, plan: str, models: list[str], rerankers: list[str]) -> DataFrame:
    """ord, method, model, reranker, tag of plan base, models, reranker or full; models[0] is the base model."""
    groups = {
        "base": [(m, models[0], "") for m in ("Dense", "BM25", "Union", "RRF")],
        "models": [("Dense", m, "") for m in models],
        "reranker": [("RRF", models[0], ""), *[("RRF+Rerank", models[0], r) for r in rerankers]],
    }
    if plan not in (*groups, "full"):
        raise ValueError(f"unknown plan: {plan}")
    rows = [r for name, g in groups.items() if plan in (name, "full") for r in g]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord int, method string, model string, reranker string")
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    tag = F.concat_ws("_", "method", name("model"), F.when(F.col("reranker") != "", name("reranker")))
    return keep_first(df, ["method", "model", "reranker"], "ord").withColumn("tag", tag)


def run(plan: DataFrame, dense: Callable[[str, int], DataFrame], sparse: Callable[[int], DataFrame], score: Callable[[str], Callable[[Column, Column], Column]], queries: DataFrame, chunks: DataFrame, measure: Callable[[DataFrame], DataFrame], k: int = 10, stage_k: int = 20, ks: list[int] = KS) -> DataFrame:
    """A row of means per experiment of ``plan`` (that of `expand`): ord, tag, method, model, reranker, hit_k, recall_k, mrr, n_queries.

    ``dense(model, k)`` and ``sparse(k)`` retrieve, ``score(reranker)`` scores a pair, ``measure`` judges
    hits. A leg or a fusion that several experiments share is computed once, written, and read by all of them.
    """
    held: dict[tuple, DataFrame] = {}

    def once(key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
        if key not in held:
            held[key] = cut(make())
        return held[key]

    def hits(method: str, model: str, reranker: str, n: int) -> DataFrame:
        if method == "Dense":
            return once(("Dense", model, n), lambda: dense(model, n))
        if method == "BM25":
            return once(("BM25", n), lambda: sparse(n))
        if method == "RRF+Rerank":
            return fusion.rerank(queries, hits("RRF", model, "", stage_k), chunks, score(reranker), n)
        merge = {"Union": fusion.union_merge, "RRF": fusion.weighted_fusion}[method]
        return once((method, model, n), lambda: merge(hits("Dense", model, "", n), hits("BM25", model, "", n), n))

    rows = None
    experiments = plan.orderBy("ord").collect()  # as many as the plan names
    for e in experiments:
        named = {c: F.lit(e[c]) for c in ("ord", "tag", "method", "model", "reranker")}
        row = measure(hits(e["method"], e["model"], e["reranker"], k)).withColumns(named)
        rows = row if rows is None else rows.unionByName(row)
    return means(rows, "ord", "tag", "method", "model", "reranker", ks=ks)
