"""Published counts, aggregated anew by the library's own operators."""

from pyspark.sql import functions as F

from sieveworks.operators import classification, judging

#: A published confusion matrix (rows: gold) and the figures that go with it.
LABELS = ["法律类", "违规类", "闲聊类"]
MATRIX = [[488, 309, 203], [3, 374, 123], [1, 6, 493]]
COUNTS = {"法律类": (488, 4, 512, 996), "违规类": (374, 315, 126, 1185), "闲聊类": (493, 326, 7, 1174)}
CLASSES = {"法律类": (0.991870, 0.488, 0.654155, 1000), "违规类": (0.542816, 0.748, 0.629100, 500), "闲聊类": (0.601954, 0.986, 0.747536, 500)}
MACRO, WEIGHTED = (0.712213, 0.740667, 0.676931), (0.782127, 0.6775, 0.671237)
#: Published verdicts of 519 answers each, and their precision.
VERDICTS = [("正确", "错误", 457, 0.8805), ("正确", "错误", 405, 0.7803), ("正确", "错误", 419, 0.8073), ("正确", "错误", 447, 0.8613)]
AGREEMENTS = [("一致", "不一致", 338, 0.6513), ("一致", "不一致", 334, 0.6435)]


def counted(spark, rows, schema):
    """Rows as often as their last field says."""
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("_i", "n")


def test_confusion_matrix(spark):
    cells = [(g, p, n) for g, row in zip(LABELS, MATRIX, strict=True) for p, n in zip(LABELS, row, strict=True)]
    pairs = counted(spark, cells, "label string, pred string, n int").withColumn("id", F.monotonically_increasing_id())
    a = classification.accuracy(pairs).first()
    assert (a.n, a.correct, a.accuracy) == (2000, 1355, 0.6775)
    assert {r["label"]: [r[c] for c in LABELS] for r in classification.confusion(pairs, LABELS).collect()} == dict(zip(LABELS, MATRIX, strict=True))
    assert {r.label: (r.tp, r.fp, r.fn, r.tn) for r in classification.one_vs_rest(pairs, LABELS).collect()} == COUNTS
    assert {r.label: (round(r.precision, 6), round(r.recall, 6), round(r.f1, 6), r.support) for r in classification.class_report(pairs).collect()} == CLASSES
    m = classification.averages(pairs).first()
    assert (m.macro_precision, m.macro_recall, m.macro_f1) == MACRO and (m.weighted_precision, m.weighted_recall, m.weighted_f1) == WEIGHTED


def test_verdicts(spark):
    rows = [(str(i), v, n) for i, (yes, no, right, _) in enumerate(VERDICTS) for v, n in ((yes, right), (no, 519 - right))]
    got = {r.run: (r.correct, r.total, r.precision) for r in judging.strict_precision(counted(spark, rows, "run string, judgement string, n int"), "run").collect()}
    assert got == {str(i): (right, 519, p) for i, (*_, right, p) in enumerate(VERDICTS)}
    rows = [(str(i), "an answer", v, n) for i, (yes, no, right, _) in enumerate(AGREEMENTS) for v, n in ((yes, right), (no, 519 - right))]
    got = {r.run: (r.correct, r.total, r.precision) for r in judging.precision(counted(spark, rows, "run string, answer string, judgement string, n int"), "run").collect()}
    assert got == {str(i): (right, 519, p) for i, (*_, right, p) in enumerate(AGREEMENTS)}
