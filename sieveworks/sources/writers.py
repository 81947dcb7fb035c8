"""Sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import file_system, small_batches, writable


def chunks(df: DataFrame, path: str, json: bool = False) -> None:
    (df.write.mode("overwrite").json if json else df.write.mode("overwrite").parquet)(path)


def test_set(df: DataFrame, path: str) -> None:
    df.select("query", "relevant_ids").write.mode("overwrite").json(path)


def vectors(df: DataFrame, model: str, dimension: int, path: str) -> str:
    """Vectors and a one-row config below a folder named for the model."""
    folder = f"{path}/{model.replace('/', '_')}"
    df.write.mode("overwrite").parquet(f"{folder}/vectors")
    df.agg(F.count("*").alias("num_chunks")).select(F.lit(model).alias("model_name"), F.lit(dimension).alias("dimension"), "num_chunks").write.mode("overwrite").json(f"{folder}/config")
    return folder


def texts(df: DataFrame, path: str, *folders: str) -> None:
    """A text file for each row (value), in folders by the columns ``folders``; a null is an empty line, as in Spark's text sink.

    Tasks write through Arrow's file systems: Spark's sink spends 10 ms a file on a local disk, in processes that set its mode. A task that is
    tried again writes the same files anew.
    """
    path = writable(df.sparkSession, path)
    small_batches(df.sparkSession)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(path)
        part, n, made = TaskContext.get().partitionId(), 0, set()
        for batch in batches:
            for value, *at in zip(*(batch.column(c).to_pylist() for c in ("value", *folders)), strict=True):
                folder = "/".join([root, *(f"{c}={x}" for c, x in zip(folders, at, strict=True))])
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(f"{folder}/part-{part:05d}-{n:07d}.txt") as f:
                    f.write(f"{value or ''}\n".encode("utf-8", "surrogatepass"))
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    df.select("value", *folders).mapInArrow(put, "n long").agg(F.sum("n")).first()  # one row


def report(df: DataFrame, path: str, csv: bool = False) -> None:
    """A small report as one JSON or CSV file."""
    one = df.coalesce(1).write.mode("overwrite")
    one.option("header", True).csv(path) if csv else one.json(path)


def kept_and_removed(kept: DataFrame, removed: DataFrame, path: str) -> None:
    for name, df in (("kept", kept), ("removed", removed)):
        df.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/{name}")


def debug_and_clean(df: DataFrame, clean: list[str], path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/debug")
    df.select(*clean).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/clean")


#: Results of a file.
FILE_ROWS = 1000


def inference(results: DataFrame, path: str) -> None:
    """Files of one nested JSON object: a config, and at most FILE_ROWS of its results in order.

    ``results``: config (a struct), idx, question, ground_truth, generated_answer, contexts, use_rag.
    """
    fields = ("question", "ground_truth", "generated_answer", "contexts", "use_rag")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("idx", *fields))), lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    files = results.groupBy("config", F.floor(F.col("idx") / FILE_ROWS).alias("part")).agg(listed.alias("results"))
    files.select("config", "results").write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)
