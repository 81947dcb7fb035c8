"""Retrieval metrics: hit and recall at k, reciprocal rank; per query and per method."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .containment import containing

KS = [1, 5, 10, 20]


def build_test_set(chunks: DataFrame, source: str, n: int = 200, min_title: int = 10, seed: int = 42) -> DataFrame:
    """query, relevant_ids: titles of a source's chunks with all chunks that bear them, sampled by hash."""
    from .fusion import sample_by_hash

    titled = chunks.filter((F.col("source") == source) & (F.length("title") >= min_title))
    grouped = titled.groupBy(F.col("title").alias("query")).agg(F.sort_array(F.collect_list("chunk_id")).alias("relevant_ids"))
    return sample_by_hash(grouped, "query", n, seed)


def judged(hits: DataFrame, relevant: DataFrame) -> DataFrame:
    """hits (query_id, chunk_id, rank) with rel 1 or 0; relevant: query_id, chunk_id."""
    return hits.join(relevant.select("query_id", "chunk_id").distinct().withColumn("rel", F.lit(1)), ["query_id", "chunk_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def sizes_of(relevant: DataFrame) -> DataFrame:
    """query_id, n_rel: how many chunks are relevant to each query."""
    return relevant.select("query_id", "chunk_id").distinct().groupBy("query_id").agg(F.count("*").alias("n_rel"))


def judged_by_label(hits: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits with rel: a hit is relevant if its label is the query's; no pair of a label but the hits is looked at."""
    own = queries.select("query_id", F.col("label").alias("_q")).join(hits, "query_id")
    both = own.join(chunks.select("chunk_id", F.col("label").alias("_c")), "chunk_id")
    return both.withColumn("rel", F.coalesce((F.col("_q") == F.col("_c")).cast("int"), F.lit(0))).drop("_q", "_c")


def sizes_by_label(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, n_rel: how many chunks bear the query's label."""
    return queries.select("query_id", "label").join(chunks.groupBy("label").agg(F.count("*").alias("n_rel")), "label").select("query_id", "n_rel")


def judged_by_title(hits: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits with rel: the variant in which a chunk is relevant if its text contains the query's title.

    The containment is tested for hits only, after the equi-joins that bring both texts.
    """
    both = hits.join(queries.select("query_id", "query"), "query_id").join(chunks.select("chunk_id", "text"), "chunk_id")
    return both.withColumn("rel", F.coalesce(F.contains("text", "query").cast("int"), F.lit(0))).drop("query", "text")


def relevant_by_title(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, chunk_id: the chunks whose text contains a query's title, found by a join on parts of both."""
    found = containing(queries.select(F.col("query_id").alias("string_id"), F.col("query").alias("string")), chunks.select(F.col("chunk_id").alias("text_id"), "text"))
    return found.select(F.col("string_id").alias("query_id"), F.col("text_id").alias("chunk_id"))


def per_query(hits: DataFrame, relevant: DataFrame, queries: DataFrame, ks: list[int] = KS) -> DataFrame:
    """`measured` for relevant pairs (query_id, chunk_id)."""
    return measured(judged(hits, relevant), sizes_of(relevant), queries, ks)


def measured(judged_hits: DataFrame, sizes: DataFrame, queries: DataFrame, ks: list[int] = KS) -> DataFrame:
    """query_id, hit_k, recall_k for each k, rr; queries without a hit count 0."""
    found = judged_hits.filter("rel = 1").groupBy("query_id").agg(
        *[F.sum((F.col("rank") <= k).cast("int")).alias(f"n_{k}") for k in ks], (1.0 / F.min("rank")).alias("rr")
    )
    every = queries.select("query_id").join(sizes, "query_id", "left").join(found, "query_id", "left")
    n = lambda k: F.coalesce(F.col(f"n_{k}"), F.lit(0))
    return every.select(
        "query_id", *[(n(k) > 0).cast("double").alias(f"hit_{k}") for k in ks], *[F.coalesce(F.try_divide(n(k), F.col("n_rel")), F.lit(0.0)).cast("double").alias(f"recall_{k}") for k in ks],
        F.coalesce("rr", F.lit(0.0)).alias("rr"),
    )


def means(q: DataFrame, *by: str, ks: list[int] = KS) -> DataFrame:
    """The means of `measured` rows, and how many there are."""
    return q.groupBy(*by).agg(*[F.round(F.avg(f"hit_{k}"), 6).alias(f"hit_{k}") for k in ks], *[F.round(F.avg(f"recall_{k}"), 6).alias(f"recall_{k}") for k in ks], F.round(F.avg("rr"), 6).alias("mrr"), F.count("*").alias("n_queries"))


def evaluate(hits: DataFrame, relevant: DataFrame, queries: DataFrame, ks: list[int] = KS) -> DataFrame:
    """One row: the means over all queries, and how many there are."""
    return means(per_query(hits, relevant, queries, ks), ks=ks)


def compare(methods: dict[str, DataFrame], measure: Callable[[DataFrame], DataFrame], ks: list[int] = KS) -> DataFrame:
    """A row of means for each method's hits; ``measure`` makes `measured` rows of hits."""
    out = None
    for name, hits in methods.items():
        row = measure(hits).withColumn("method", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return means(out, "method", ks=ks)


def report(comparison: DataFrame) -> DataFrame:
    """The comparison as text, four decimals, absent values blank."""
    return comparison.select("method", *[F.coalesce(F.format_number(c, 4), F.lit("")).alias(c) for c in comparison.columns if c not in ("method", "n_queries")])


def context_precision(verdicts: DataFrame) -> DataFrame:
    """query_id, value for (query_id, k, verdict): mean of precision at the places of useful contexts."""
    from pyspark.sql import Window as W

    upto = W.partitionBy("query_id").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    at = verdicts.withColumn("_p", F.sum("verdict").over(upto) / F.count("*").over(upto))
    return at.groupBy("query_id").agg(F.coalesce(F.try_divide(F.sum(F.col("_p") * F.col("verdict")), F.sum("verdict")), F.lit(0.0)).alias("value"))


def supported_ratio(statements: DataFrame) -> DataFrame:
    """query_id, value for (query_id, verdict): share of supported statements (context recall, faithfulness)."""
    return statements.groupBy("query_id").agg(F.coalesce(F.avg(F.col("verdict").cast("double")), F.lit(0.0)).alias("value"))
