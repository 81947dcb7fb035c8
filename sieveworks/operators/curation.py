"""Dataset curation: cleaning, thresholds, expansion, preference pairs, resumable jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.prompts import BATCH_SIZE, batch_prompts
from ..storage import cut
from .fusion import top_with_ties

#: The keywords that mark a record as legal.
LEGAL_KEYWORDS = ["法", "条", "规定", "合同", "责任", "权利", "义务", "诉讼", "赔偿", "刑", "民", "侵权", "犯罪", "法院", "法律"]
MIN_KEEP, DEFAULT_SCORE = 500, 6
#: Fixed value: the reason of rows whose batch was never read.
DEFAULT_REASON = "API评分失败，默认保留"
#: Times a batch is asked at most.
ROUNDS = 3


def preclean(qa: DataFrame, min_question: int = 4, min_reply: int = 10) -> DataFrame:
    """question, reply: rows with both, exact repeats dropped before stripping, short ones after."""
    out = qa.select("question", "reply").dropna().dropDuplicates(["question", "reply"])
    out = out.select(X.strip(F.col("question")).alias("question"), X.strip(F.col("reply")).alias("reply"))
    return out.filter((F.length("question") >= min_question) & (F.length("reply") >= min_reply))


def exact_repeats_removed(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """``columns`` once per different value, with the least ``order`` of its rows."""
    return rows.groupBy(*columns).agg(F.min(order).alias(order))


def parse_batch_scores(answer: Column, size: Column) -> Column:
    """Array of struct(index, score, reason) from a batch's answer; null unless it has ``size`` entries."""
    bare = X.strip(F.regexp_replace(answer, "```(json)?", ""))
    got = F.from_json(bare, "array<struct<index:int,score:double,reason:string>>")
    return F.when(F.size(got) == size, got)


def score_rows(rows: DataFrame, batches: DataFrame) -> DataFrame:
    """rows (batch, pos) beside score and reason; batches: batch, answer. Rows of unread batches have DEFAULT_SCORE and DEFAULT_REASON.

    Scores belong to the row whose index they name, in whatever order the answer has them; of
    entries with one index that with the least score counts, and a row that no entry names has DEFAULT_SCORE.
    """
    sizes = rows.groupBy("batch").agg(F.count("*").alias("_n"))
    read = batches.join(sizes, "batch").withColumn("_s", F.explode(parse_batch_scores(F.col("answer"), F.col("_n"))))
    read = read.groupBy("batch", F.col("_s.index").alias("pos")).agg(F.min(F.struct(F.col("_s.score").alias("score"), F.col("_s.reason").alias("reason"))).alias("_s"))
    out = rows.join(read, ["batch", "pos"], "left")
    return out.withColumns({"score": F.coalesce("_s.score", F.lit(float(DEFAULT_SCORE))), "reason": F.when(F.col("_s").isNull(), DEFAULT_REASON).otherwise(F.col("_s.reason"))}).drop("_s")


def score_in_rounds(rows: DataFrame, ask: Callable[[DataFrame, int], DataFrame], rounds: int = ROUNDS, size: int = BATCH_SIZE) -> DataFrame:
    """rows (n, question, reply; n counts from 0) beside batch, pos, score and reason: scored in batches of ``size``.

    ``ask`` gives the prompts (batch, n, body) and the number of the round, and returns them with
    ``answer`` (null, or anything that can't be read as a list of n entries, is a failure). Only batches that
    weren't read are asked again, up to ``rounds`` times in all; each round is written before the next, so
    no model is called twice for one. What is left then has the default score.
    """
    prompts = cut(batch_prompts(rows, "n", size))
    read = None
    for number in range(rounds):
        answers = cut(ask(prompts, number).select("batch", "n", "answer"))
        good = answers.filter(parse_batch_scores(F.col("answer"), F.col("n")).isNotNull()).select("batch", "answer")
        read = good if read is None else read.unionByName(good)
        prompts = prompts.join(good.select("batch"), "batch", "left_anti")
        if number + 1 < rounds and not prompts.head(1):
            break
    placed = rows.withColumns({"batch": F.floor(F.col("n") / size), "pos": (F.col("n") % size).cast("int")})
    return score_rows(placed, read)


def keep_best(rows: DataFrame, n: int = MIN_KEEP) -> DataFrame:
    """Rows scoring at least the n-th best score, ties kept."""
    return top_with_ties(rows, "score", n)


def split_kept(rows: DataFrame, n: int = MIN_KEEP) -> tuple[DataFrame, DataFrame]:
    """(question, reply) kept and (question, reply, score, reason) removed."""
    edge = rows.select("score").orderBy(F.desc("score")).limit(n).agg(F.min("score").alias("_edge"))
    marked = rows.crossJoin(F.broadcast(edge))
    return marked.filter("score >= _edge").select("question", "reply"), marked.filter("score < _edge").select("question", "reply", "score", "reason")


def score_distribution(rows: DataFrame) -> DataFrame:
    return rows.groupBy("score").agg(F.count("*").alias("n")).orderBy("score")


def is_legal(instruction: Column, output: Column) -> Column:
    return F.concat(F.coalesce(instruction, F.lit("")), F.coalesce(output, F.lit(""))).rlike("|".join(LEGAL_KEYWORDS))


def expansion_targets(sft: DataFrame, limit: int = 500) -> DataFrame:
    return sft.filter(is_legal(F.col("instruction"), F.col("output")) & (F.length("output") < limit))


def accept_expansion(attempts: DataFrame) -> DataFrame:
    """idx, output: the first attempt (idx, attempt, original, output) that is long enough, else the last one."""
    good = F.length("output") >= F.greatest(F.length("original") * 1.3, F.lit(200))
    return attempts.groupBy("idx").agg(F.coalesce(F.min_by("output", F.when(good, F.col("attempt"))), F.max_by("output", "attempt")).alias("output"))


def remaining(todo: DataFrame, done: DataFrame, key: str = "idx") -> DataFrame:
    """What a resumed job still has to do."""
    return todo.join(done.select(key), key, "left_anti")


def resumable(todo: DataFrame, path: str, work: Callable[[DataFrame], DataFrame], key: str = "idx") -> DataFrame:
    """Append ``work`` of what is not yet in the Parquet table ``path``; the whole table."""
    spark = todo.sparkSession
    from pyspark.errors import AnalysisException

    try:
        todo = remaining(todo, spark.read.parquet(path), key)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    work(todo).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def override(rows: DataFrame, done: DataFrame, key: str = "idx", column: str = "output") -> DataFrame:
    """Rows with ``column`` replaced where ``done`` (key, value) has one."""
    return rows.join(done.select(key, F.col("value").alias("_v")), key, "left").withColumn(column, F.coalesce("_v", column)).drop("_v")


def preference_pairs(sft: DataFrame, chosen: DataFrame) -> DataFrame:
    """instruction, input, chosen, rejected: the generated answer against the record's own; rows without one go."""
    both = sft.join(chosen.select("idx", F.col("value").alias("chosen")), "idx").filter("chosen is not null")
    return both.select("instruction", F.coalesce("input", F.lit("")).alias("input"), "chosen", F.col("output").alias("rejected"))


def question_answer_pairs(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, question, reply: user turns with the assistant turn right after them."""
    u = conversations.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = conversations.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return u.join(a, ["conv_id", "turn"])
