"""Readers with explicit schemas. Paths may be files, folders or globs of any file system Spark knows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions import text as X
from ..operators.chunking import qa_text
from ..storage import matches, shared_folder, small_batches

#: The encodings tried in turn.
ENCODINGS = ("utf-8", "gbk", "gb18030")


#: What opening a file counts when files are dealt out to tasks, in bytes: Spark's own 4 MB make a task of every 32 small files.
OPEN_COST = 1 << 16


def _files(spark: SparkSession, path: str, glob: str, recursive: bool) -> DataFrame:
    """path, content of files; a folder that isn't there has none."""
    if not matches(spark, path):
        return spark.createDataFrame([], "path string, content binary")
    small_batches(spark)
    key = "spark.sql.files.openCostInBytes"
    held = spark.conf.get(key).lower().removesuffix("b")
    if not held.isdigit() or int(held) > OPEN_COST:
        spark.conf.set(key, str(OPEN_COST))
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    return (reader.option("recursiveFileLookup", "true") if recursive else reader).load(path).select("path", "content")


def markdown(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """path, text of all files ``glob`` below a folder, cleaned; files left empty go."""
    files = _files(spark, path, glob, True).select("path", X.clean_markdown(F.decode("content", "UTF-8")).alias("text"))
    return files.filter("text <> ''")


def articles(spark: SparkSession, path: str) -> DataFrame:
    """text of JSON lines with both ``input`` and ``answer``; blank and malformed lines go."""
    rows = spark.read.schema(S.ARTICLE).option("mode", "DROPMALFORMED").json(path)
    clean = rows.select(*[X.strip(F.coalesce(c, F.lit(""))).alias(c) for c in ("input", "answer")])
    return clean.filter("input <> '' and answer <> ''").select(F.concat_ws("\n", "input", "answer").alias("text"))


def decode_first(content: Column) -> Column:
    """Text of bytes in the first of ENCODINGS that reads them, else UTF-8 with the rest left out."""

    @F.pandas_udf("string")
    def decode(series: pd.Series) -> pd.Series:
        def one(b: bytes | None) -> str | None:
            if b is None:
                return None
            for name in ENCODINGS:
                try:
                    return b.decode(name)
                except UnicodeDecodeError:
                    continue
            return b.decode("utf-8", "ignore")

        return series.map(one)

    valid = F.is_valid_utf8(content.cast("string"))
    return F.coalesce(F.when(valid, content.cast("string")), decode(F.when(~valid, content)))  # a Python function is called for all rows: it gets the others' bytes alone


def _decoded(encoding: str) -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def decode(series: pd.Series) -> pd.Series:
        return series.map(lambda b: None if b is None else b.decode(encoding, "ignore").removesuffix("\n"))

    return lambda c: decode(c)


def textbooks(spark: SparkSession, path: str) -> DataFrame:
    """title, text of the ``*.txt`` in one folder; the text begins with the title in 【】."""
    name = F.regexp_extract(F.url_decode("path"), r"([^/]+)\.txt$", 1)
    rows = _files(spark, path, "*.txt", False).select(name.alias("title"), decode_first(F.col("content")).alias("body"))
    return rows.select("title", F.concat(F.lit("【"), "title", F.lit("】\n\n"), X.strip(F.col("body"))).alias("text"))


def probe_encoding(spark: SparkSession, path: str) -> str:
    """The first of ENCODINGS that reads the whole lines at the start of a text file, else UTF-8."""
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 1 << 16).alias("head")).first()
    start = bytes(head["head"]) if head else b""
    line = start[: start.rfind(b"\n") + 1] or start
    for name in ENCODINGS:
        try:
            line.decode(name)
        except UnicodeDecodeError:
            continue
        return name
    return "utf-8"


def forum_qa(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """title, text of a CSV with title, question and reply; rows without title or reply go.

    Without ``encoding`` the first lines tell which of ENCODINGS it is. Bytes that it doesn't read are left out.
    """
    encoding = (encoding or probe_encoding(spark, path)).lower()
    if encoding not in ("utf-8", "utf-8-sig"):  # others Spark's CSV reader doesn't know: the files, of which each is a row here, are written anew
        files = spark.read.format("binaryFile").load(path).select(_decoded(encoding)(F.col("content")).alias("value"))
        path = shared_folder(spark)
        files.write.text(path)
    rows = spark.read.schema(S.QA).options(header=True, multiLine=True, escape='"', enforceSchema=False).csv(path)
    rows = rows.select(*[F.replace(c, F.lit("\ufffd"), F.lit("")).alias(c) for c in rows.columns])
    clean = rows.select(*[X.strip(F.coalesce(c, F.lit(""))).alias(c) for c in ("title", "question", "reply")])
    return clean.filter("title <> '' and reply <> ''").select("title", qa_text(F.col("title"), F.col("question"), F.col("reply")).alias("text"))


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table from JSON lines; blank lines go."""
    return spark.read.schema(S.CHUNK).option("mode", "DROPMALFORMED").json(path).filter("text is not null")


def qa_test(spark: SparkSession, path: str) -> DataFrame:
    """question, ground_truth of a CSV with question and reply, rows with both."""
    rows = spark.read.options(header=True, multiLine=True, escape='"').csv(path)
    rows = require(rows, "question", "reply").select(*[X.strip(F.coalesce(c, F.lit(""))).alias(c) for c in ("question", "reply")])
    return rows.filter("question <> '' and reply <> ''").withColumnRenamed("reply", "ground_truth")


def require(df: DataFrame, *columns: str) -> DataFrame:
    """``df``, or an error if it lacks a column. A byte-order mark before the first name doesn't count."""
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def test_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.TEST_ITEM).json(path)


def keyed(spark: SparkSession, path: str, value: str) -> DataFrame:
    """id, value of JSON lines; of a repeated id the last line by file and place wins."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("n"))
    parsed = lines.select("f", "b", "n", F.get_json_object("value", "$.id").alias("id"), F.get_json_object("value", f"$['{value}']").alias(value)).filter("id is not null")
    return parsed.groupBy("id").agg(F.max_by(value, F.struct("f", "b", "n")).alias(value))


def reference_answers(spark: SparkSession, json_paths: list[str], jsonl_path: str | None = None) -> DataFrame:
    """question, answer of the first JSON file that is there, else of JSON lines."""
    for p in json_paths:
        if matches(spark, p):
            rows = spark.read.option("multiLine", True).schema("question string, reply string, answer string").json(p)
            return rows.select("question", F.coalesce("reply", "answer", F.lit("")).alias("answer"))
    rows = spark.read.schema("question string, query string, reply string, answer string").json(jsonl_path)
    return rows.select(F.coalesce("question", "query").alias("question"), F.coalesce("reply", "answer", F.lit("")).alias("answer"))


def result_files(spark: SparkSession, path: str, metrics: T.StructType = S.METRICS) -> DataFrame:
    """file and the metrics of JSON results, without files named detail or summary. Metrics that a file lacks are null."""
    rows = spark.read.schema(metrics).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return rows.withColumn("file", F.col("_metadata.file_name")).filter(~F.col("file").rlike("detail|summary"))


def inference_files(spark: SparkSession, path: str) -> DataFrame:
    """file, config, idx and the fields of a result: a row per result of inference outputs."""
    rows = spark.read.schema(S.INFERENCE_FILE).option("multiLine", True).json(path)
    each = rows.select(F.col("_metadata.file_name").alias("file"), "config", F.posexplode("results").alias("idx", "r"))
    return each.select("file", "config", "idx", "r.*")
