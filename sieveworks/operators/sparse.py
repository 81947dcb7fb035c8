"""BM25 as tables, and an exact top-k search that adds up a part of the postings only.

Terms are counted within each document's row, so a document's counts are a row and no shuffle
is needed for the postings. A posting's *weight* is its BM25 factor, all but the idf.

A search deals documents into shards and queries into blocks; a shard and a block are a task,
which keeps its best k of each query. There the postings of a term in a shard are one list
with its greatest weight, so the most that a term can add to a score is known. A query's lists are
added up from the one that can add most; once all that is left can't lift a document that isn't met yet
to the k-th best partial score, no list is read through any more: what is left is looked up for
the documents that can still get there, list by list, fewer each time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..storage import cut, small_batches

#: The parameters of Okapi BM25 as the results assume them.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Documents of a shard and queries of a block.
SHARD, BLOCK = 8_192, 4_096
#: What rounding to six places can add.
_SLACK = 1e-6


@dataclass(frozen=True)
class SparseIndex:
    """postings (term, chunk_id, tf, dl), idf (term, df, idf), stats (n, avgdl): one row."""

    postings: DataFrame
    idf: DataFrame
    stats: DataFrame

    def save(self, path: str, buckets: int = 64) -> None:
        """Postings lie in ``buckets`` folders by a hash of the term, in each task's file in the order of its documents.

        Every task writes a file to each folder: no posting is shuffled, and what a task reads and sorts (by the folder's number alone, which
        takes a few passes and no comparisons) is its part of the documents, however few the folders.
        """
        self.postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings")
        for name in ("idf", "stats"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> SparseIndex:
        return SparseIndex(spark.read.parquet(f"{path}/postings").drop("bucket"), *[spark.read.parquet(f"{path}/{n}") for n in ("idf", "stats")])


def terms(docs: DataFrame, key: str, text: str = "text", tokenizer=tokens) -> DataFrame:
    return docs.select(F.col(key), F.explode(tokenizer(F.col(text))).alias("term"))


def _counts(lists: pa.Array) -> pa.Array:
    """The distinct strings of each list in the order in which they come, and how often each comes; none of a null."""
    named = pc.dictionary_encode(lists.flatten(), null_encoding="encode")
    n, every = len(lists), max(1, len(named.dictionary))
    row = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    both, first, counts = np.unique(row * every + named.indices.to_numpy(zero_copy_only=False), return_index=True, return_counts=True)
    order = np.argsort(first)
    both, counts = both[order], counts[order]
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(both // every, minlength=n))]).astype(np.int32))
    terms = pa.ListArray.from_arrays(offsets, named.dictionary.take(pa.array(both % every)))
    return pa.StructArray.from_arrays([terms, pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int64)))], ["terms", "tfs"])


def token_lists(docs: DataFrame, tokenizer=tokens) -> DataFrame:
    """chunk_id, dl (tokens), terms, tfs (each distinct term and how often it stands) for documents (chunk_id, text)."""
    small_batches(docs.sparkSession)
    counted = F.arrow_udf(_counts, "terms array<string>, tfs array<bigint>")
    listed = docs.select("chunk_id", tokenizer(F.col("text")).alias("t"))
    return listed.select("chunk_id", F.coalesce(F.size("t"), F.lit(0)).cast("long").alias("dl"), counted("t").alias("c")).select("chunk_id", "dl", "c.terms", "c.tfs")


def postings(lists: DataFrame) -> DataFrame:
    """term, chunk_id, tf, dl of `token_lists`, without a shuffle."""
    return lists.select("chunk_id", "dl", F.inline(F.arrays_zip("terms", "tfs")).alias("term", "tf")).select("term", "chunk_id", "tf", "dl")


def weight(tf: Column, dl: Column, avgdl: Column) -> Column:
    """A posting's part of a score, all but the idf: between 0 and K1 + 1."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def corpus_stats(lists: DataFrame) -> DataFrame:
    """n documents and their mean length in tokens: one row."""
    return lists.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def idf(lists: DataFrame, stats: DataFrame) -> DataFrame:
    """term, df, idf; negative ones become EPSILON times the mean over all terms."""
    df = lists.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    raw = df.crossJoin(F.broadcast(stats.select("n"))).select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    raw = cut(raw)  # for the mean and for the terms
    mean = raw.agg(F.avg("raw").alias("mean"))  # one row
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def build(docs: DataFrame, tokenizer=tokens) -> SparseIndex:
    lists = cut(token_lists(docs, tokenizer))
    stats = cut(corpus_stats(lists))
    return SparseIndex(postings(lists), idf(lists, stats), stats)


def asked_terms(queries: DataFrame, tokenizer=tokens) -> DataFrame:
    """query_id, term, qf: how often a query has each of its terms."""
    return terms(queries, "query_id", "query", tokenizer).groupBy("query_id", "term").agg(F.count("*").alias("qf"))


def best_of_shard(asked: pd.DataFrame, held: pd.DataFrame, k: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The best ``k`` of a shard's postings (t, chunk_id, weight) for queries (query_id, t, times); and query_id, postings, read."""
    docs, ids = pd.factorize(held["chunk_id"], sort=True)
    order = np.lexsort((docs, held["t"].to_numpy()))
    docs, weights, t = docs[order], held["weight"].to_numpy()[order], held["t"].to_numpy()[order]
    of, starts = np.unique(t, return_index=True)
    ends = np.append(starts[1:], len(t))
    most = np.maximum.reduceat(weights, starts) if len(t) else weights
    found, costs = [], []
    for query, own in asked.groupby("query_id", sort=False, dropna=False):
        at = np.searchsorted(of, own["t"].to_numpy())
        there = (at < len(of)) & (of[np.minimum(at, len(of) - 1)] == own["t"].to_numpy()) if len(of) else np.zeros(len(own), bool)
        at, times = at[there], own["times"].to_numpy()[there]
        bound = np.maximum(times, 0.0) * most[at]
        lists = np.argsort(-bound, kind="stable")
        left = bound.sum() - np.cumsum(bound[lists])  # after each list
        prune = not (times < 0).any()  # what is found so far may only grow
        score, n, theta, read = np.zeros(len(ids)), 0, 0.0, 0
        for i in lists:
            s, e = starts[at[i]], ends[at[i]]
            score[docs[s:e]] += times[i] * weights[s:e]
            read += e - s
            n += 1
            if prune and len(ids) > k:
                theta = np.partition(score, len(ids) - k)[len(ids) - k]
                if left[n - 1] + _SLACK < theta:
                    break
        able = np.flatnonzero(score + (left[n - 1] if n else 0.0) + _SLACK >= theta)
        for m in range(n, len(lists)):
            i = lists[m]
            s, e = starts[at[i]], ends[at[i]]
            if e - s <= len(able):  # shorter than the documents to look up
                score[docs[s:e]] += times[i] * weights[s:e]
                read += e - s
                able = able[score[able] + left[m] + _SLACK >= theta]
                continue
            place = np.minimum(np.searchsorted(docs[s:e], able), e - s - 1)
            hit = docs[s:e][place] == able
            score[able[hit]] += times[i] * weights[s:e][place[hit]]
            read += len(able)
            able = able[score[able] + left[m] + _SLACK >= theta]
        final = np.round(score[able], 6)
        able, final = able[final > 0], final[final > 0]
        top = np.argsort(-final, kind="stable")[:k]  # documents are in order of id
        found.append(pd.DataFrame({"query_id": [query] * len(top), "chunk_id": ids[able[top]], "score": final[top]}))
        costs.append((query, int((ends - starts)[at].sum()), int(read)))
    every = pd.concat(found) if found else pd.DataFrame({"query_id": [], "chunk_id": [], "score": []})
    return every, pd.DataFrame(costs, columns=["query_id", "postings", "read"])


def _sharded(index: SparseIndex, queries: DataFrame, k: int, tokenizer, shard: int, costs: bool) -> DataFrame:
    spark = queries.sparkSession
    asked = cut(asked_terms(queries, tokenizer).join(index.idf.select("term", "idf"), "term").select("query_id", "term", F.xxhash64("term").alias("t"), (F.col("qf") * F.col("idf")).alias("times")))
    stats = index.stats.first()  # one row
    docs, n = stats["n"], asked.select("query_id").distinct().count()
    n_v, n_q = max(1, -(-docs // shard), min(spark.sparkContext.defaultParallelism, docs // 512)), max(1, -(-n // BLOCK))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    dealt = lambda m, c: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    held = index.postings.join(asked.select("term", F.col("t").alias("named")).distinct(), "term")
    held = held.select(F.col("named").alias("t"), "chunk_id", weight(F.col("tf"), F.col("dl"), F.lit(stats["avgdl"] or 0.0)).alias("weight"), dealt(n_v, "chunk_id").alias("shard"), every(n_q).alias("block"))
    some = asked.select("query_id", "t", "times", dealt(n_q, "query_id").alias("block"), every(n_v).alias("shard"))
    types = {"query_id": some.schema["query_id"].dataType.simpleString(), "chunk_id": held.schema["chunk_id"].dataType.simpleString()}
    schema = f"query_id {types['query_id']}, postings bigint, read bigint" if costs else f"query_id {types['query_id']}, chunk_id {types['chunk_id']}, score double"
    by = ["block", "shard"]
    return some.groupBy(*by).cogroup(held.groupBy(*by)).applyInPandas(lambda q, v: best_of_shard(q, v, k)[costs], schema)


def search(index: SparseIndex, queries: DataFrame, k: int = 10, tokenizer=tokens, shard: int = SHARD) -> DataFrame:
    """query_id, chunk_id, rank, score: the ``k`` best documents above 0 of each query, exactly.

    Repeated query terms count as often as they occur. Equal scores (to six places) go by
    chunk_id. The queries' terms are written first, so that Spark knows their size and broadcasts
    them while they are small: then no posting that they lack is shuffled. What a task holds is bounded: the
    asked postings of ``shard`` documents on average, and the terms of BLOCK queries.
    """
    return top_k(_sharded(index, queries, k, tokenizer, shard, costs=False), k)


def reading_share(index: SparseIndex, queries: DataFrame, k: int = 10, tokenizer=tokens, shard: int = SHARD) -> DataFrame:
    """query_id, postings, read: how many postings a query's terms have, and how many a search adds up or looks up."""
    return _sharded(index, queries, k, tokenizer, shard, costs=True).groupBy("query_id").agg(F.sum("postings").alias("postings"), F.sum("read").alias("read"))


def top_k(scored: DataFrame, k: int, score: str = "score", tie: str = "chunk_id") -> DataFrame:
    """The ``k`` best rows of each query; Spark keeps k of each task before the exchange."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(score), tie))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "chunk_id", "rank", F.col(score).alias("score"))
