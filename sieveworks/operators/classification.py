"""Classification metrics over gold labels (id, label) and predictions (id, pred)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_by_id(rows: DataFrame, value: str, order: str) -> DataFrame:
    """One row per id: the value of its last row by ``order``."""
    return rows.groupBy("id").agg(F.max_by(value, order).alias(value))


def align(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    return gold.select("id", "label").join(predicted.select("id", "pred"), "id")


def coverage(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """total gold rows, aligned rows, missing rows (gold alone)."""
    both = gold.select("id").join(predicted.select("id", F.lit(1).alias("_in")), "id", "left")
    return both.agg(F.count("*").alias("total_gt"), F.count("_in").alias("aligned"), (F.count("*") - F.count("_in")).alias("missing"))


def accuracy(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count("*").alias("n"), F.sum((F.col("label") == F.col("pred")).cast("long")).alias("correct"), F.round(F.avg((F.col("label") == F.col("pred")).cast("double")), 6).alias("accuracy"))


def confusion(pairs: DataFrame, labels: list[str]) -> DataFrame:
    """A row per gold label, a column per prediction; pairs with any other label are left out."""
    inside = pairs.filter(F.col("label").isin(labels) & F.col("pred").isin(labels))
    rows = pairs.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    counts = inside.groupBy("label").agg(*[F.sum((F.col("pred") == x).cast("long")).alias(x) for x in labels])
    return rows.join(counts, "label", "left").na.fill(0)


def one_vs_rest(pairs: DataFrame, labels: list[str]) -> DataFrame:
    """label, tp, fp, fn, tn from the matrix over ``labels`` alone."""
    inside = pairs.filter(F.col("label").isin(labels) & F.col("pred").isin(labels))
    each = inside.select("label", "pred", F.explode(F.array(*[F.lit(x) for x in labels])).alias("class"))
    g, p = F.col("label") == F.col("class"), F.col("pred") == F.col("class")
    count = lambda c: F.sum(c.cast("long"))
    return each.groupBy(F.col("class").alias("label")).agg(count(g & p).alias("tp"), count(~g & p).alias("fp"), count(g & ~p).alias("fn"), count(~g & ~p).alias("tn"))


def class_report(pairs: DataFrame) -> DataFrame:
    """label, precision, recall, f1, support for every label in gold or prediction; 0 for 0 / 0."""
    gold = pairs.groupBy("label").agg(F.count("*").alias("support"), F.sum((F.col("label") == F.col("pred")).cast("long")).alias("tp"))
    named = pairs.groupBy(F.col("pred").alias("label")).agg(F.count("*").alias("predicted"))
    both = gold.join(named, "label", "full_outer").na.fill(0, ["support", "tp", "predicted"])
    p, r = F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    out = both.select("label", p.alias("precision"), r.alias("recall"), "support")
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def averages(pairs: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Macro and support-weighted precision, recall and F1; ``labels`` narrows the classes averaged."""
    rep = class_report(pairs)
    rep = rep if labels is None else rep.filter(F.col("label").isin(labels))
    cols = ["precision", "recall", "f1"]
    return rep.agg(
        *[F.round(F.avg(c), 6).alias(f"macro_{c}") for c in cols],
        *[F.round(F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")), F.lit(0.0)), 6).alias(f"weighted_{c}") for c in cols],
    )


def report_text(pairs: DataFrame) -> DataFrame:
    """label and a fixed-width line of its figures; after the classes accuracy, macro avg and weighted avg, over all rows."""
    report = class_report(pairs)
    line = lambda *c: F.format_string("%12.4f%12.4f%12.4f%12d", *c)
    classes = report.select("label", line("precision", "recall", "f1", "support").alias("line"))
    cols = ["precision", "recall", "f1"]
    total = F.sum("support")
    weighted = [F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), total), F.lit(0.0)) for c in cols]
    correct = F.coalesce(F.try_divide(F.sum(F.col("recall") * F.col("support")), total), F.lit(0.0))
    lines = {"accuracy": F.format_string("%24s%12.4f%12d", F.lit(""), correct, total), "macro avg": line(*[F.avg(c) for c in cols], total), "weighted avg": line(*weighted, total)}
    ends = report.agg(*[x.alias(name) for name, x in lines.items()], F.count("*").alias("_n")).filter("_n > 0")
    return classes.unionByName(ends.select(F.explode(F.create_map(*[c for name in lines for c in (F.lit(name), F.col(f"`{name}`"))])).alias("label", "line")))


def compare_models(results: DataFrame, focus: str) -> DataFrame:
    """model, accuracy, macro_f1, weighted_f1, focus_recall for pairs (model, label, pred)."""
    acc = results.groupBy("model").agg(F.avg((F.col("label") == F.col("pred")).cast("double")).alias("accuracy"))
    gold = results.groupBy("model", "label").agg(F.count("*").alias("support"), F.sum((F.col("label") == F.col("pred")).cast("long")).alias("tp"))
    named = results.groupBy("model", F.col("pred").alias("label")).agg(F.count("*").alias("predicted"))
    both = gold.join(named, ["model", "label"], "full_outer").na.fill(0, ["support", "tp", "predicted"])
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("support") + F.col("predicted")), F.lit(0.0))
    per = both.withColumn("f1", f1).groupBy("model").agg(
        F.round(F.avg("f1"), 6).alias("macro_f1"), F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 6).alias("weighted_f1"),
        F.round(F.max(F.when(F.col("label") == focus, F.coalesce(F.try_divide("tp", "support"), F.lit(0.0)))), 6).alias("focus_recall"),
    )
    return acc.join(per, "model").select("model", F.round("accuracy", 6).alias("accuracy"), "macro_f1", "weighted_f1", "focus_recall")
