"""Exact dense search by inner product: a scan in blocks, or an index that skips what can't be near.

The index puts every vector into the group of its nearest pivot (a sample of the vectors) and into a ring of
that group by its distance to the pivot; such a cell keeps its size, its least and greatest distance and its
greatest norm. With q v = q p + q (v - p) <= q p + |q| radius, and with 2 q v = |q|^2 + |v|^2 - |q - v|^2, where |q - v|
is at least what |q - p| and the ring are apart, no vector of a cell is better than the lesser of two bounds. A search scans the cells nearest to a query until
they hold k vectors, takes the k-th best score, and then scans only the cells whose bound reaches it. Results are those of the scan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import LETTERS, letter_counts, once
from ..storage import cut, small_batches
from .sparse import top_k

#: Vectors of a block of either side, and queries multiplied at a time within it.
BLOCK, ROWS = 32_768, 64
#: Pivots of an index at most, and rings about each.
PIVOTS, RINGS = 1024, 8
_SLACK = 1e-6


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalise(v: Column) -> Column:
    """Unit vector in doubles; the null vector stays."""
    scaled = lambda w: once(norm(w), lambda n: F.transform(w, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0))))
    return once(v, scaled)


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(inner_product(a, b), norm(a) * norm(b))


def letter_encoder(text: Column, letters: str = LETTERS) -> Column:
    """A stand-in encoder in built-in functions: how often a text has each of some letters, as a unit vector."""
    return l2_normalise(letter_counts(text, letters))


@dataclass(frozen=True)
class DenseIndex:
    """vectors (chunk_id, embedding) beside a row of what they are: model, dimension, num_chunks."""

    vectors: DataFrame
    config: DataFrame
    model: str | None = None

    @staticmethod
    def build(chunks: DataFrame, encode: Callable[[Column], Column], model: str) -> DenseIndex:
        small_batches(chunks.sparkSession)
        vectors = chunks.select("chunk_id", encode(F.col("text")).alias("embedding"))
        return DenseIndex(vectors, DenseIndex.describe(vectors, model), model)

    @staticmethod
    def describe(vectors: DataFrame, model: str) -> DataFrame:
        return vectors.agg(F.lit(model).alias("model"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dimension"), F.count("*").alias("num_chunks"))

    def save(self, path: str) -> DenseIndex:
        """Write both tables and read them again; the description is taken from what was written."""
        spark = self.vectors.sparkSession
        self.vectors.write.mode("overwrite").parquet(f"{path}/vectors")
        model = self.model or self.config.first()["model"]  # asking the description would encode all texts again
        DenseIndex.describe(spark.read.parquet(f"{path}/vectors"), model).write.mode("overwrite").parquet(f"{path}/config")
        return DenseIndex.load(spark, path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> DenseIndex:
        return DenseIndex(spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/config"))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """query_id, chunk_id, rank, score: exact top ``k`` of vectors (chunk_id, embedding) per query.

    Both sides are dealt into blocks, and each pair of a block of queries (query_id, embedding)
    with a block of vectors is a task of its own, which keeps its best ``k`` per query: what a
    task holds is bounded on either side, and nothing passes through the driver. Scores are
    rounded to six places; equal ones go by chunk_id.
    """
    spark = vectors.sparkSession
    v = vectors.select("chunk_id", "embedding").filter("embedding is not null")
    q = queries.select("query_id", "embedding").filter("embedding is not null")
    n_q = max(1, -(-q.count() // block))
    n = v.count()
    n_v = max(1, -(-n // block), min(spark.sparkContext.defaultParallelism, n // 512))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    dealt = lambda m, *c: F.pmod(F.xxhash64(*c), F.lit(m)).cast("int")
    q = q.select("query_id", "embedding", dealt(n_q, "query_id").alias("q_block"), every(n_v).alias("v_block"))
    v = v.select("chunk_id", "embedding", dealt(n_v, "chunk_id", "embedding").alias("v_block"), every(n_q).alias("q_block"))
    schema = _schema(q, v)
    by = ["q_block", "v_block"]
    return top_k(q.groupBy(*by).cogroup(v.groupBy(*by)).applyInPandas(lambda a, b: _best_of(a, b, k), schema), k)


def _schema(queries: DataFrame, vectors: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("chunk_id", vectors.schema["chunk_id"].dataType), T.StructField("score", T.DoubleType())])


def _best_of(asked: pd.DataFrame, held: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best ``k`` of a block's vectors for each query of a block, by a product of matrices."""
    found = []
    if len(asked) and len(held):
        held = held.sort_values("chunk_id", kind="stable")  # so that a stable sort by score breaks ties by id
        matrix, ids = np.stack(held["embedding"].to_numpy()).astype(np.float64).T, held["chunk_id"].to_numpy()
        for at in range(0, len(asked), ROWS):
            some = asked.iloc[at : at + ROWS]
            s = np.round(np.stack(some["embedding"].to_numpy()).astype(np.float64) @ matrix, 6)
            order = np.argsort(-s, axis=1, kind="stable")[:, :k]
            found.append(pd.DataFrame({"query_id": np.repeat(some["query_id"].to_numpy(), order.shape[1]), "chunk_id": ids[order].ravel(), "score": np.take_along_axis(s, order, 1).ravel()}))
    return pd.concat(found) if found else pd.DataFrame({"query_id": [], "chunk_id": [], "score": []})


@dataclass(frozen=True)
class CellIndex:
    """vectors (chunk_id, embedding, cell), cells (cell, pivot, inner, radius, norm, n): a row a cell, PIVOTS x (RINGS + 1) at most; pivots (pivot, embedding)."""

    vectors: DataFrame
    cells: DataFrame
    pivots: DataFrame

    @staticmethod
    def build(vectors: DataFrame, pivots: int | None = None) -> CellIndex:
        """``vectors``: chunk_id, embedding; null embeddings are left out. Pivots are about the root of the vectors, PIVOTS at most, chosen by a hash."""
        spark = vectors.sparkSession
        held = vectors.select("chunk_id", "embedding").filter("embedding is not null")
        n = pivots or min(PIVOTS, max(1, int(held.count() ** 0.5)))
        some = held.select("embedding").distinct().orderBy(F.xxhash64("embedding"), "embedding").limit(n).collect()  # PIVOTS rows at most
        chosen = np.array([r["embedding"] for r in some], dtype=np.float64)

        @F.pandas_udf("pivot int, distance double, norm double")
        def nearest(series: pd.Series) -> pd.DataFrame:
            v = np.stack(series.to_numpy()).astype(np.float64)
            apart = np.linalg.norm(v, axis=1)[:, None] ** 2 + (chosen**2).sum(1)[None] - 2 * v @ chosen.T
            at = apart.argmin(axis=1)
            return pd.DataFrame({"pivot": at.astype(np.int32), "distance": np.linalg.norm(v - chosen[at], axis=1), "norm": np.linalg.norm(v, axis=1)})

        placed = cut(held.withColumn("p", nearest("embedding")).select("chunk_id", "embedding", "p.*"))
        widest = placed.agg(F.max("distance").alias("d")).first()["d"] or 1.0
        cell = (F.col("pivot") * (RINGS + 1) + F.floor(F.col("distance") / widest * RINGS)).cast("int").alias("cell")
        placed = placed.select("chunk_id", "embedding", cell, "pivot", "distance", "norm")
        cells = placed.groupBy("cell").agg(F.first("pivot").alias("pivot"), F.min("distance").alias("inner"), F.max("distance").alias("radius"), F.max("norm").alias("norm"), F.count("*").alias("n"))
        return CellIndex(placed.drop("pivot", "distance", "norm"), cut(cells), spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(chosen)], "pivot int, embedding array<double>"))

    def save(self, path: str) -> CellIndex:
        """Vectors lie sorted by cell, so that a search reads few row groups."""
        self.vectors.repartitionByRange("cell").sortWithinPartitions("cell").write.mode("overwrite").parquet(f"{path}/vectors")
        self.cells.write.mode("overwrite").parquet(f"{path}/cells")
        self.pivots.write.mode("overwrite").parquet(f"{path}/pivots")
        return CellIndex.load(self.vectors.sparkSession, path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> CellIndex:
        return CellIndex(*[spark.read.parquet(f"{path}/{n}") for n in ("vectors", "cells", "pivots")])

    def search(self, queries: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
        """query_id, chunk_id, rank, score: what `search` gives for the same vectors."""
        found, _ = self._found(queries, k, block)
        return top_k(found, k)

    def touched(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """query_id, vectors, scanned: how many vectors there are, and how many a search scans."""
        _, cells = self._found(queries, k, BLOCK)
        total = self.cells.agg(F.sum("n").alias("vectors"))
        return cells.join(self.cells.select("cell", "n"), "cell").groupBy("query_id").agg(F.sum("n").alias("scanned")).crossJoin(F.broadcast(total)).select("query_id", "vectors", "scanned")

    def _found(self, queries: DataFrame, k: int, block: int) -> tuple[DataFrame, DataFrame]:
        """Scores of the vectors in all cells that matter, and these cells (query_id, cell)."""
        cells = self.cells.orderBy("cell").collect()  # PIVOTS x (RINGS + 1) rows at most
        numbers, sizes = np.array([c["cell"] for c in cells], dtype=np.int32), np.array([c["n"] for c in cells], dtype=np.int64)
        inner, radius, norm = (np.array([c[x] for c in cells]) for x in ("inner", "radius", "norm"))
        at = np.array([c["pivot"] for c in cells], dtype=np.int64)
        centres = np.array([r["embedding"] for r in self.pivots.orderBy("pivot").collect()], dtype=np.float64)
        parts = {int(c): -(-int(n) // block) for c, n in zip(numbers, sizes, strict=True)}

        def bounds(series: pd.Series) -> np.ndarray:
            q = np.stack(series.to_numpy()).astype(np.float64)
            own, product = np.linalg.norm(q, axis=1)[:, None], q @ centres.T
            apart = np.sqrt(np.maximum(own**2 + (centres**2).sum(1)[None] - 2 * product, 0))[:, at]
            gap = np.maximum(np.maximum(apart - radius[None], inner[None] - apart) - _SLACK, 0)  # less what rounding can do
            return np.minimum(product[:, at] + own * radius[None], (own**2 + norm[None] ** 2 - gap**2) / 2)

        @F.pandas_udf("array<int>")
        def nearest(series: pd.Series) -> pd.Series:
            out = []
            for row in bounds(series) if len(cells) else [()] * len(series):
                order = np.argsort(-np.asarray(row), kind="stable")
                enough = int(np.searchsorted(np.cumsum(sizes[order]), k)) + 1 if len(cells) else 0
                out.append(numbers[order[:enough]].tolist() if len(cells) else [])
            return pd.Series(out, dtype=object)

        @F.pandas_udf("array<int>")
        def others(series: pd.Series, done: pd.Series, theta: pd.Series) -> pd.Series:
            rows = bounds(series) if len(cells) else [()] * len(series)
            return pd.Series([[int(c) for c in numbers[np.asarray(row) + _SLACK >= t] if c not in set(d)] if len(cells) else [] for row, d, t in zip(rows, done, theta, strict=True)], dtype=object)

        q = cut(queries.select("query_id", "embedding").filter("embedding is not null").withColumn("first", nearest("embedding")))
        n_q = max(1, -(-q.count() // block))
        in_parts = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair]) if parts else F.create_map(F.lit(0), F.lit(1))
        dealt = lambda m, *c: F.pmod(F.xxhash64(*c), m).cast("int")
        every = lambda m: F.explode(F.sequence(F.lit(0), m - 1))
        v = self.vectors.withColumn("part", dealt(in_parts[F.col("cell")], "chunk_id")).withColumn("q_block", every(F.lit(n_q)))
        by = ["cell", "part", "q_block"]

        def scored(pairs: DataFrame) -> DataFrame:
            asked = pairs.withColumn("part", every(in_parts[F.col("cell")])).withColumn("q_block", dealt(F.lit(n_q), "query_id"))
            some = v.join(asked.select(*by).distinct(), by, "left_semi")
            return asked.groupBy(*by).cogroup(some.groupBy(*by)).applyInPandas(lambda a, b: _best_of(a, b, k), _schema(queries, self.vectors))

        first = q.select("query_id", "embedding", F.explode("first").alias("cell"))
        near = cut(scored(first))
        theta = top_k(near, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("theta"))
        least = F.coalesce("theta", F.lit(float("-inf")))
        more = q.join(theta, "query_id", "left").select("query_id", "embedding", F.explode(others("embedding", "first", least)).alias("cell"))
        more = cut(more)
        return near.union(scored(more)), first.select("query_id", "cell").union(more.select("query_id", "cell"))
