"""The question-rewriting job: two model answers a row, guarded; and label prediction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parsing as P
from ..functions import text as X


def _blank(q: Column) -> Column:
    return (q == "") | (F.lower(q) == "nan")


def _held(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns that later steps read but don't compute again (the optimizer puts no expression through a generator)."""
    row = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select("*", row.alias("_held")).select(*[c for c in df.columns if c not in columns], "_held.*")


def rewrite(rows: DataFrame) -> DataFrame:
    """id, question, rewritten, keyword, changed, ok, status for rows (id, question, first, second).

    ``first`` and ``second`` are struct(text, ok): the answer and the one after a retry. A row
    whose answers are both rejected keeps its question, with the first reason in its status.
    """
    q = X.strip(F.coalesce("question", F.lit("")))
    both = _held(rows.select("id", q.alias("question"), "first", "second"), a=P.rewrite_candidate(F.col("first.text")), b=P.rewrite_candidate(F.col("second.text")))
    both = _held(both, bad_a=P.rewrite_problem(F.col("a.question"), F.col("question")), bad_b=P.rewrite_problem(F.col("b.question"), F.col("question")))
    status = (
        F.when(_blank(F.col("question")), "EMPTY")
        .when(~F.col("first.ok"), "CALL_FAIL")
        .when(F.col("a").isNull(), "JSON_FAIL")
        .when(F.col("bad_a").isNull(), "OK")
        .when(~F.col("second.ok"), "RETRY_CALL_FAIL")
        .when(F.col("b").isNotNull() & F.col("bad_b").isNull(), "OK2")
        .otherwise(F.concat(F.lit("BAD_RQ_ROLLBACK:"), "bad_a"))
    )
    pick = F.when(F.col("s") == "OK", F.col("a")).when(F.col("s") == "OK2", F.col("b"))
    out = _held(both, s=status)
    out = _held(out, x=pick)
    new = F.coalesce("x.question", "question")
    return out.select(
        "id", "question", new.alias("rewritten"), F.coalesce("x.keyword", F.lit("")).alias("keyword"), (F.col("x").isNotNull() & (X.norm(new) != X.norm(F.col("question")))).alias("changed"),
        (~F.col("s").isin("CALL_FAIL", "RETRY_CALL_FAIL")).alias("ok"), F.regexp_replace("s", "^OK2$", "OK").alias("status"),
    )


def rewrite_small(rows: DataFrame) -> DataFrame:
    """The same with the looser guard, plain-text answers and the method in the status."""
    q = X.strip(F.coalesce("question", F.lit("")))
    clean = lambda x: F.struct(X.clean_sentence(x["question"], collapse=False).alias("question"), x["method"].alias("method"))
    both = rows.select("id", q.alias("question"), "first", "second")
    both = _held(both, a=P.extract_rewrite_small(F.col("first.text"), F.col("question")), b=P.extract_rewrite_small(F.col("second.text"), F.col("question")))
    both = _held(both, a=clean(F.col("a")), b=clean(F.col("b")))
    both = _held(both, bad_a=P.rewrite_problem_small(F.col("a.question"), F.col("question")), bad_b=P.rewrite_problem_small(F.col("b.question"), F.col("question")))
    status = (
        F.when(_blank(F.col("question")), "EMPTY")
        .when(~F.col("first.ok"), "CALL_FAIL")
        .when(F.col("a.question").isNull(), "PARSE_FAIL")
        .when(F.col("bad_a").isNull(), F.concat(F.lit("OK_"), "a.method"))
        .when(~F.col("second.ok"), "RETRY_CALL_FAIL")
        .when(F.col("b.question").isNotNull() & F.col("bad_b").isNull(), F.concat(F.lit("OK_"), "b.method", F.lit("_retry")))
        .otherwise(F.concat(F.lit("BAD_RQ_ROLLBACK:"), "bad_a"))
    )
    out = _held(both, status=status)
    new = F.when(F.col("status").rlike("^OK_.*_retry$"), F.col("b.question")).when(F.col("status").startswith("OK_"), F.col("a.question")).otherwise(F.col("question"))
    return out.select("id", "question", new.alias("rewritten"), (X.norm(new) != X.norm(F.col("question"))).alias("changed"), (~F.col("status").isin("CALL_FAIL", "RETRY_CALL_FAIL")).alias("ok"), "status")


def predict_labels(rows: DataFrame) -> DataFrame:
    """id, pred for rows (id, first, second, failed): strict labels of two attempts, then the fallback."""
    label = F.coalesce(P.extract_label_strict(F.col("first")), P.extract_label_strict(F.col("second")), F.lit(P.FALLBACK_LABEL))
    return rows.select("id", F.when(F.col("failed"), "ERROR").otherwise(label).alias("pred"))
