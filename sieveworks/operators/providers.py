"""Where models plug in: encoders, pair scorers and generators as Arrow column functions.

A provider makes its callable once per Python worker. ``hash_encoder`` and ``overlap_score``
are deterministic stand-ins for tests and demonstrations; their results say nothing of quality.
"""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..storage import delete, exists, small_batches, spread
from .curation import remaining


def encoder(make: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 32) -> Callable[[Column], Column]:
    """Text column -> unit vectors; ``make()`` loads the model, and gives texts -> vectors."""

    @F.pandas_udf("array<float>")
    def encode(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in series:
            texts, out = s.fillna("").tolist(), []
            for i in range(0, len(texts), batch):
                v = np.asarray(model(texts[i : i + batch]), dtype=np.float64)
                n = np.linalg.norm(v, axis=1, keepdims=True)
                out += list(np.divide(v, n, out=np.zeros_like(v), where=n > 0).astype(np.float32))
            yield pd.Series(out, dtype=object)

    return lambda c: encode(c)


def pair_scorer(make: Callable[[], Callable[[list[tuple[str, str]]], list[float]]]) -> Callable[[Column, Column], Column]:
    """(query, text) columns -> score."""

    @F.pandas_udf("double")
    def score(series: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for q, t in series:
            yield pd.Series(model(list(zip(q.fillna(""), t.fillna(""), strict=True))), dtype="float64")

    return lambda q, t: score(q, t)


def generator(make: Callable[[], Callable[[str], str]], attempts: int = 3, pause: float = 1.0, in_flight: int = 1) -> Callable[[Column], Column]:
    """Prompt column -> struct(text, ok); a failing call is tried again after pause, 2 pause, 4 pause ...

    A task has at most ``in_flight`` calls open, so a job has that many for each core it runs on.
    """

    @F.pandas_udf("text string, ok boolean")
    def generate(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import time

        model = make()

        def one(prompt: str) -> tuple[str, bool]:
            error = ""
            for attempt in range(attempts):
                try:
                    return model(prompt), True
                except Exception as e:  # whatever the model raises is the answer's failure
                    error = f"FAIL: {e}"
                    if attempt + 1 < attempts:
                        time.sleep(pause * 2**attempt)
            return error, False

        with ThreadPoolExecutor(in_flight) as calls:
            for s in series:
                yield pd.DataFrame(list(calls.map(one, s)), columns=["text", "ok"])

    return lambda c: generate(c)


#: What a command that fails answers.
TIMED_OUT, BROKEN, RETURN_CODE, NOTHING = "OLLAMA_TIMEOUT", "OLLAMA_ERROR: {}", "OLLAMA_RC_{}: {}", "OLLAMA_EMPTY_STDOUT: {}"


def run_command(command: Sequence[str], prompt: str, timeout: float) -> tuple[str, bool]:
    """What ``command`` prints when it reads ``prompt``, stripped, and whether that is an answer.

    It isn't if the command takes longer than ``timeout`` seconds (it is killed then), can't be started, returns a
    code other than 0, or prints to its error stream only; the text says which. Bytes that aren't UTF-8 become U+FFFD.
    """
    try:
        done = subprocess.run(list(command), input=prompt, capture_output=True, timeout=timeout, encoding="utf-8", errors="replace")
    except subprocess.TimeoutExpired:
        return TIMED_OUT, False
    except Exception as e:  # whatever keeps a command from running is the answer's failure
        return BROKEN.format(e), False
    out, err = done.stdout.strip(), done.stderr.strip()
    if done.returncode:
        return RETURN_CODE.format(done.returncode, "\n".join(x for x in (out, err) if x)).strip(), False
    return (NOTHING.format(err), False) if err and not out else (out, True)


def command_generator(command: Sequence[str], timeout: float = 120, in_flight: int = 1) -> Callable[[Column], Column]:
    """Prompt column -> struct(text, ok): a process per prompt, which must be there on every worker.

    A task has at most ``in_flight`` processes at a time. Failures aren't tried again: the rows say so by
    ``ok``, and a job asks for them anew. A null prompt has a null text and isn't ok.
    """

    @F.pandas_udf("text string, ok boolean")
    def generate(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(in_flight) as calls:
            for s in series:
                yield pd.DataFrame(list(calls.map(lambda p: (None, False) if p is None else run_command(command, p, timeout), s)), columns=["text", "ok"])

    return lambda c: generate(c)


#: Rows of a file of texts that wait to be encoded.
PART = 16_384


def encode_in_groups(chunks: DataFrame, path: str, encode: Callable[[Column], Column], model: str, every: int = 5000) -> DataFrame:
    """chunk_id, embedding of ``chunks`` (chunk_id, text), encoded in groups of about ``every`` that are committed one by one below ``path``.

    A group's vectors are written first and its line in the manifest after them. A run that is broken
    off and started again with the same chunks and model keeps the groups that the manifest names and encodes
    the others; with other ones it starts afresh. When all are there they are written together to
    ``path``/vectors, and the groups and the manifest go. A finished table is encoded anew by the next call.
    """
    spark = chunks.sparkSession
    small_batches(spark)
    rows = chunks.select("chunk_id", "text")
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("chunk_id", "text").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("h")).first()
    groups = max(1, -(-total["n"] // every))
    of = f"{model}:{total['n']}:{total['h']}:{groups}"
    work, manifest = f"{path}/groups", f"{path}/manifest"
    done = {r["group"] for r in spark.read.json(manifest, "of string, group int").filter(F.col("of") == of).collect()} if exists(spark, manifest) else set()  # a line a group
    if not done:
        delete(spark, work)
        delete(spark, manifest)
    if not exists(spark, f"{work}/todo/_SUCCESS"):
        number = F.pmod(F.xxhash64("chunk_id", "text"), F.lit(groups)).cast("int").alias("group")
        # about PART rows of a group are a task and a file, however few the groups
        parts = max(1, -(-total["n"] // (groups * PART)))
        part = F.pmod(F.xxhash64("text", "chunk_id"), F.lit(parts))
        rows.select("chunk_id", "text", number).repartition(groups * parts, "group", part).write.mode("overwrite").partitionBy("group").parquet(f"{work}/todo")
    schema = rows.schema
    for g in range(groups):
        if g in done or not exists(spark, f"{work}/todo/group={g}"):
            continue
        todo = spread(spark.read.schema(schema).parquet(f"{work}/todo/group={g}"))
        todo.select("chunk_id", encode(F.col("text")).alias("embedding")).write.mode("overwrite").parquet(f"{work}/done/group={g}")
        spark.createDataFrame([(of, g)], "of string, group int").coalesce(1).write.mode("append").json(manifest)
    found = [f"{work}/done/group={g}" for g in range(groups) if exists(spark, f"{work}/done/group={g}")]
    vectors = spark.read.parquet(*found) if found else rows.select("chunk_id", encode(F.col("text")).alias("embedding"))
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    delete(spark, work)
    delete(spark, manifest)
    return spark.read.parquet(f"{path}/vectors")


def encode_missing(chunks: DataFrame, done: DataFrame, encode: Callable[[Column], Column]) -> DataFrame:
    """Vectors of the chunks that ``done`` lacks; identity is chunk_id and the text's hash, so a changed text counts as new."""
    small_batches(chunks.sparkSession)
    keyed = chunks.select("chunk_id", "text", F.xxhash64("text").alias("text_hash"))
    todo = keyed.join(done.select("chunk_id", "text_hash"), ["chunk_id", "text_hash"], "left_anti")
    return todo.select("chunk_id", "text_hash", encode(F.col("text")).alias("embedding"))


def hash_encoder(dimension: int = 64) -> Callable[[Column], Column]:
    """Stand-in encoder: signed word hashes summed into ``dimension`` places, as unit vectors."""

    def make() -> Callable[[list[str]], list[list[float]]]:
        import re
        import zlib

        import numpy as np

        word = re.compile(r"[^\W_]{2,}")

        def encode(texts: list[str]) -> list[list[float]]:
            out = []
            for t in texts:
                h = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in word.findall(t.lower())], dtype=np.int64)
                out.append(np.bincount(h % dimension, np.where(h >> 31, 1.0, -1.0), dimension).tolist())
            return out

        return encode

    return encoder(make)


def overlap_score(query: Column, text: Column) -> Column:
    """Stand-in scorer: share of the query's distinct words that the text has."""
    q = F.array_distinct(tokens(query))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, tokens(text))), F.size(q)), F.lit(0.0)).cast("double")


#: Scorers by name.
SCORERS = {"overlap": overlap_score}


def scorer(name: str) -> Callable[[Column, Column], Column]:
    """A scorer of the registry; an unknown name is an error before any row is read."""
    if name not in SCORERS:
        raise ValueError(f"unknown scorer {name!r}; there are {', '.join(sorted(SCORERS))}")
    return SCORERS[name]


__all__ = ["SCORERS", "scorer", "command_generator", "encode_in_groups", "encode_missing", "encoder", "generator", "hash_encoder", "overlap_score", "pair_scorer", "remaining"]
