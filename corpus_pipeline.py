"""A training-data pipeline over ``documents``: five stages, each one of the library's operators.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its output
is written as Parquet and read again as the next one's docs. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sieveworks.llm import decontaminate, lines, packing, simhash, toxicity
from sieveworks.llm.common import settle, table
from sieveworks.llm.queries import tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on ``labels`` of the documents at hand, scores below 0.5."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines leave the texts; a document of which nothing is left goes.

    Documents that were null, empty or blank from the start stay for the next stage.
    """
    return lines.dedup_lines(docs, keep_emptied=False)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies (5-word shingles, similarity 0.8): that with the least doc_id."""
    return simhash.keep_one(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no item of ``benchmark`` is found."""
    return decontaminate.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces of sequences of 2048 tokens: where each piece lies, and its ids' checksum."""
    return packing.pack_documents(docs, tokenizer(), with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", keep_one_of_each_group),
    ("benchmark decontamination", decontaminate_benchmark),
    ("best-fit packing", pack),
]

#: SQL can't express the classifier, the edit distances or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))  # a stage's own tables go with it
    return STAGES[-1][1](spark, docs, sf_dir)
