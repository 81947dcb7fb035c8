"""Aggregates of judges' verdicts and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parsing as P
from .dense import cosine

NO_CONTEXT = "无参考文档"


def precision(answers: DataFrame, *by: str) -> DataFrame:
    """correct, total, precision for (answer, judgement): failed answers and unread verdicts don't count."""
    v = F.when(~P.failed_answer(F.col("answer")), P.agreement_verdict(F.col("judgement")))
    return _ratio(answers.withColumn("_v", v), *by)


def strict_precision(answers: DataFrame, *by: str) -> DataFrame:
    """The same over verdicts 正确 and 错误; ERROR doesn't count."""
    return _ratio(answers.withColumn("_v", P.correctness_verdict(F.col("judgement"))), *by)


def _ratio(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.coalesce(F.sum("_v"), F.lit(0)).alias("correct"), F.count("_v").alias("total"), F.coalesce(F.round(F.try_divide(F.sum("_v"), F.count("_v")), 4), F.lit(0.0)).alias("precision"))


def scoring(answers: DataFrame, *by: str) -> DataFrame:
    """avg_score, precision_pct, n over scores above 0 read from ``judgement``."""
    s = P.score_1_to_10(F.col("judgement"))
    rows = answers.withColumn("_s", F.when(s > 0, s))
    mean = F.coalesce(F.avg("_s"), F.lit(0.0))
    return rows.groupBy(*by).agg(F.round(mean, 4).alias("avg_score"), F.round(mean * 10, 2).alias("precision_pct"), F.count("_s").alias("n"))


def pairwise(a: DataFrame, b: DataFrame) -> DataFrame:
    """different, a_wins, b_wins for two judged runs (idx, judgement); ERROR counts as not right."""
    ok = lambda c: F.coalesce(P.correctness_verdict(F.col(c)), F.lit(0))
    both = a.select("idx", ok("judgement").alias("x")).join(b.select("idx", ok("judgement").alias("y")), "idx")
    return both.agg(F.count_if(F.col("x") != F.col("y")).alias("different"), F.count_if(F.col("x") > F.col("y")).alias("a_wins"), F.count_if(F.col("x") < F.col("y")).alias("b_wins"))


def with_reference(results: DataFrame, reference: DataFrame) -> DataFrame:
    """Results beside the reference answer to their question, empty if there is none (the last one wins)."""
    last = reference.groupBy("question").agg(F.max_by("answer", "line_no").alias("reference"))
    return results.join(last, "question", "left").withColumn("reference", F.coalesce("reference", F.lit("")))


def rewrite_verdicts(rows: DataFrame) -> DataFrame:
    """correct, wrong, skipped, accuracy for (success, text, verdict): 1, 0, else not read."""
    bad = ~F.coalesce("success", F.lit(False)) | P.failed_answer(F.col("text"))
    v = F.when(~bad, F.col("verdict"))
    right, wrong = F.count_if(v == 1), F.count_if(v == 0)
    return rows.agg(right.alias("correct"), wrong.alias("wrong"), (F.count("*") - right - wrong).alias("skipped"), F.coalesce(F.round(F.try_divide(right, right + wrong), 6), F.lit(0.0)).alias("accuracy"))


def status_summary(rows: DataFrame) -> DataFrame:
    """total, ok, rollback, fail, changed, with_keyword for rewrite records (status, changed, keyword)."""
    ok, back = F.col("status").startswith("OK"), F.col("status").startswith("BAD_RQ_ROLLBACK")
    return rows.agg(
        F.count("*").alias("total"), F.count_if(ok).alias("ok"), F.count_if(back).alias("rollback"), (F.count("*") - F.count_if(ok) - F.count_if(back)).alias("fail"),
        F.count_if("changed").alias("changed"), F.count_if(F.coalesce("keyword", F.lit("")) != "").alias("with_keyword"),
    )


def with_contexts(results: DataFrame) -> DataFrame:
    """Results whose missing contexts are the default 无参考文档."""
    none = F.coalesce(F.size("contexts"), F.lit(0)) <= 0
    return results.withColumn("contexts", F.when(none, F.array(F.lit(NO_CONTEXT))).otherwise(F.col("contexts")))


def answer_quality(results: DataFrame, statements: DataFrame, regenerated: DataFrame) -> DataFrame:
    """file, n, precision, answer_relevancy, faithfulness, answer_similarity: means over each file's results, to four places.

    ``results``: file, idx, use_rag, answer, judgement, and the vectors question_vector,
    answer_vector and gold_vector. ``statements``: file, idx, verdict (1 if the contexts support
    the answer's statement). ``regenerated``: file, idx, vector (of a question made from the
    answer). Relevancy is the mean cosine of a result's question with its regenerated ones,
    faithfulness its share of supported statements, which counts only where retrieval was used.
    """
    keys = ["file", "idx"]
    asked = regenerated.join(results.select(*keys, "question_vector"), keys)
    relevancy = asked.groupBy(*keys).agg(F.avg(cosine(F.col("question_vector"), F.col("vector"))).alias("relevancy"))
    faithful = statements.groupBy(*keys).agg(F.avg(F.col("verdict").cast("double")).alias("faithful"))
    verdict = F.when(~P.failed_answer(F.col("answer")), P.agreement_verdict(F.col("judgement")))
    rows = results.select(*keys, "use_rag", verdict.alias("v"), cosine(F.col("answer_vector"), F.col("gold_vector")).alias("similar"))
    rows = rows.join(relevancy, keys, "left").join(faithful, keys, "left")
    mean = lambda c: F.round(F.avg(c), 4)
    return rows.groupBy("file").agg(
        F.count("*").alias("n"), F.coalesce(F.round(F.try_divide(F.sum("v"), F.count("v")), 4), F.lit(0.0)).alias("precision"), mean("relevancy").alias("answer_relevancy"),
        mean(F.when(F.col("use_rag"), F.col("faithful"))).alias("faithfulness"), mean("similar").alias("answer_similarity"),
    )
