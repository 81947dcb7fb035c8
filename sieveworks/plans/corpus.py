"""The whole way from source files to an index that answers: read, chunk, number, write, index; load, search, evaluate.

A built folder holds ``chunks`` (compressed JSON lines), ``dense`` and ``sparse``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, dense, evaluation, providers, sparse
from ..sources import readers
from ..storage import cut, passing, settle
from .engine import Engine, Method

#: The kinds of sources in the order in which their chunks are numbered, and what cuts them up.
CHUNKERS = {"statutes": chunking.statute_chunks, "textbooks": chunking.book_chunks, "articles": chunking.article_chunks, "forum": chunking.qa_chunks}
#: Methods that `evaluate` compares.
METHODS = (Method.DENSE, Method.SPARSE, Method.UNION, Method.RRF)
#: Shortest title that is asked for.
MIN_TITLE = 10


def _known(kinds: dict) -> None:
    if unknown := set(kinds) - set(CHUNKERS):
        raise ValueError(f"unknown kinds of sources: {', '.join(sorted(unknown))}; there are {', '.join(CHUNKERS)}")


def sources_from_files(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """doc_ord, text of each kind of source that has a path: folders of markup and of text files, JSON lines, CSV."""
    _known(paths)
    read = {
        "statutes": lambda p: readers.markdown(spark, p).select(F.col("path").alias("doc_ord"), "text"), "textbooks": lambda p: readers.textbooks(spark, p).select(F.col("title").alias("doc_ord"), "text"),
        "articles": lambda p: readers.articles(spark, p), "forum": lambda p: readers.forum_qa(spark, p),
    }
    found = {kind: cut(read[kind](path)) for kind, path in paths.items()}  # files are read and decoded once
    # records without a name of their own are ordered by what they are
    return {kind: df if "doc_ord" in df.columns else df.withColumn("doc_ord", F.md5("text")) for kind, df in found.items()}


def chunk_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """text, source, title, section, chunk_id of all ``sources`` (kind: doc_ord, text), numbered by kind, document (as text) and place."""
    _known(sources)
    cut_up = [chunk(sources[kind].withColumn("doc_ord", F.col("doc_ord").cast("string"))) for kind, chunk in CHUNKERS.items() if kind in sources]
    return chunking.number_chunks([cut(c) for c in cut_up])  # else the ranges' bounds and the rows would each need all chunks anew


def build(sources: dict[str, DataFrame], path: str, encode: Callable[[Column], Column], model: str, tokenizer=sparse.tokens, every: int | None = None) -> None:
    """Write the chunk table of ``sources`` and both indexes below ``path``.

    With ``every`` the vectors are encoded in groups of about so many chunks, committed one by one: a run
    that breaks off goes on after the last group when it is started again.
    """
    spark = next(iter(sources.values())).sparkSession
    with passing(spark):
        # what numbering has written goes before the indexes are built, and these read no JSON
        chunks = settle(spark, lambda: chunk_sources(sources))
        chunks.write.mode("overwrite").options(**{"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}).json(f"{path}/chunks")
        if every:
            vectors = providers.encode_in_groups(chunks, f"{path}/encoding", encode, model, every)
            dense.DenseIndex(vectors, dense.DenseIndex.describe(vectors, model)).save(f"{path}/dense")
        else:
            dense.DenseIndex.build(chunks, encode, model).save(f"{path}/dense")
        sparse.build(chunks.select("chunk_id", "text"), tokenizer).save(f"{path}/sparse")


def load(spark: SparkSession, path: str, encode: Callable[[Column], Column], tokenizer=sparse.tokens) -> Engine:
    """The engine over a folder that `build` has written; ``encode`` and ``tokenizer`` must be those of the build."""
    index = dense.DenseIndex.load(spark, f"{path}/dense")
    return Engine(readers.chunks(spark, f"{path}/chunks"), index.vectors, sparse.SparseIndex.load(spark, f"{path}/sparse"), encode, tokenizer=tokenizer)


def evaluate(engine: Engine, source: str, n: int = 200, k: int = 20, ks: list[int] = evaluation.KS) -> DataFrame:
    """method, hit_k, recall_k, mrr, n_queries: the four methods over a test set of ``n`` titles of a source's chunks.

    A chunk is relevant to a title if it bears it.
    """
    tests = cut(evaluation.build_test_set(engine.chunks, source, n, MIN_TITLE).select(F.xxhash64("query").alias("query_id"), "query", "relevant_ids"))
    queries, relevant = tests.select("query_id", "query"), tests.select("query_id", F.explode("relevant_ids").alias("chunk_id"))
    hits = {str(m): engine.retrieve(queries, k, m).select("query_id", "chunk_id", "rank") for m in METHODS}
    return evaluation.compare(hits, lambda h: evaluation.per_query(h, relevant, queries, ks), ks)
