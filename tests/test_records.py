"""Parsing, guards, rewriting, classification, judging, prompts, curation."""

import pytest
from pyspark.sql import functions as F

from sieveworks.functions import parsing as P
from sieveworks.functions import prompts as PR
from sieveworks.operators import classification as C
from sieveworks.operators import curation, judging, rewriting


def values(spark, f, rows):
    n = len(rows[0])
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{k} string" for k in range(n)))
    return [r.x for r in df.select("i", f(*[F.col(f"c{k}") for k in range(n)]).alias("x")).orderBy("i").collect()]


def test_strict_labels(spark):
    texts = ['{"label":"法律类"}', 'ok {"类型":"1"} x', '{"pred":"c"}', "答案是违规类", "R", "2", "A类", "", "“a”", '{"label":"x","pred":"0"}', None, '{"label": 1}', "say C now", "x 7"]
    want = ["法律类", "违规类", "闲聊类", "违规类", "违规类", "闲聊类", None, None, "法律类", "法律类", None, "违规类", "闲聊类", None]
    assert values(spark, P.extract_label_strict, [(t,) for t in texts]) == want


def test_lenient_labels(spark):
    assert values(spark, P.extract_label, [('{"类型": "闲聊类"}',), ("是法律类吧违规类",), ('{"类型": "别的"}',), ("",)]) == ["闲聊类", "法律类", "UNKNOWN", "UNKNOWN"]


def test_scores_and_verdicts(spark):
    assert values(spark, P.score_1_to_10, [("10",), ("10分",), ("8",), ("得分：10",), ("0",), ("无",)]) == [10, 10, 8, 1, 1, -1]
    assert values(spark, P.agreement_verdict, [("不一致",), ("一致",), ("嗯",)]) == [0, 1, None]
    assert values(spark, P.correctness_verdict, [("正确",), ("不正确错误",), ("错误",), ("ERROR",), ("嗯",), ("",), (None,)]) == [1, 0, 0, None, 0, None, None]


def test_balanced_json(spark):
    texts = ['x {"a": {"b": "}{"}} y }', '{"a": "q\\"}"} z', "{ open", "none", None, '{"a": "\\\\"} {', 'a \\{"b": 1} \\" }', '{\\"x}" } y', "{" * 3000 + "}" * 3000]
    assert values(spark, P.balanced_json, [(t,) for t in texts]) == ['{"a": {"b": "}{"}}', '{"a": "q\\"}"}', None, None, None, '{"a": "\\\\"}', '{"b": 1}', '{\\"x}" }', "{" * 3000 + "}" * 3000]


def test_rewrites_are_read(spark):
    texts = ['```json\n{"改写问题": " 怎么办？ ", "关键词": "合同"}\n```', '{"rewritten_question": "a", "keywords": "k"}', 'so: {"改写问题": "问？"} !', "nothing", '```\n{"x":1}\n``` {"改写问题": "乙"}']
    got = values(spark, P.extract_rewrite, [(t,) for t in texts])
    assert [(g.question, g.keyword) if g else None for g in got[:4]] == [("怎么办？", "合同"), ("a", "k"), ("问？", ""), None]
    small = values(spark, P.extract_rewrite_small, [('{"rewritten_question": "甲怎么办？"}', "q"), ("问题：x\n改写：劳动合同怎么签？", "q"), ("原话怎么说", "原话怎么说"), ("abc", "q")])
    assert [(g.question, g.method) for g in small] == [("甲怎么办？", "json"), ("劳动合同怎么签？", "plain"), (None, "none"), (None, "none")]


def test_guard(spark):
    old = "老板不给工资怎么办"
    new = ["拖欠工资如何维权？", "how怎么办？", "a_b工资？", "公司欠薪如何维权？", "小明工资如何追讨？", "根据法律规定怎么办？", "老板不给工资怎么办老板不给工资？", "", "abc", "工资怎么办", "老板小工资明？"]
    want = [None, "ENGLISH_MIXED", "SLUG_OR_UNDERSCORE", "SUBJECT_CHANGED(公司)", "FABRICATED_NAME", "PROMPT_LEAK(根据法律规定)", "TOO_LONG", "EMPTY_RQ", "NO_CHINESE", "NO_QUESTION_MARK", "FABRICATED_NAME"]
    got = values(spark, P.rewrite_problem, [(n, old) for n in new])
    assert got == want
    assert values(spark, P.added_characters, [("aabbc", "abx")]) == ["abc"]
    small = values(spark, P.rewrite_problem_small, [("请問？", old), ("工资？", "一二三四五六七八九十甲乙"), ("工资怎么办", old), ("工资怎么办？吗", old)])
    assert small == ["TRADITIONAL_CHINESE", "TOO_SHORT", "NO_QUESTION_MARK", None]
    assert values(spark, P.rewrite_problem_small, [("领導领？", "怎么办"), ("領导怎么办？", "怎么办"), ("题怎么办？", "怎么办"), ("題怎么办？", "怎么办")]) == [None, "TRADITIONAL_CHINESE", None, None]


def test_rewriting(spark):
    s = "id string, question string, first struct<text:string,ok:boolean>, second struct<text:string,ok:boolean>"
    good, bad = ('{"改写问题":"拖欠工资怎么办","关键词":"工资"}', True), ('{"改写问题":"公司欠薪？"}', True)
    q = "老板不给工资怎么办"
    rows = [("1", q, good, None), ("2", q, bad, good), ("3", q, bad, bad), ("4", " ", None, None), ("5", q, ("x", False), None), ("6", q, ("junk", True), None), ("7", q, bad, ("y", False)), ("8", "nan", None, None)]
    got = {r.id: r for r in rewriting.rewrite(spark.createDataFrame(rows, s)).collect()}
    assert [got[str(i)].status for i in range(1, 9)] == ["OK", "OK", "BAD_RQ_ROLLBACK:SUBJECT_CHANGED(公司)", "EMPTY", "CALL_FAIL", "JSON_FAIL", "RETRY_CALL_FAIL", "EMPTY"]
    assert got["1"].rewritten == "拖欠工资怎么办？" and got["1"].keyword == "工资" and got["1"].changed and got["3"].rewritten == q and not got["5"].ok
    small = {r.id: r.status for r in rewriting.rewrite_small(spark.createDataFrame([("1", q, ("拖欠工资怎么处理？", True), None), ("2", q, ("公司欠薪怎么办？", True), ('{"rewritten_question":"欠薪怎么办？"}', True)), ("3", q, ("x", True), None)], s)).collect()}
    assert small == {"1": "OK_plain", "2": "OK_json_retry", "3": "PARSE_FAIL"}
    labels = rewriting.predict_labels(spark.createDataFrame([("1", "嗯", "A", False), ("2", "", "", False), ("3", "A", "A", True)], "id string, first string, second string, failed boolean"))
    assert {r.id: r.pred for r in labels.collect()} == {"1": "法律类", "2": "闲聊类", "3": "ERROR"}


def pairs(spark):
    return spark.createDataFrame([("1", "L", "L"), ("2", "L", "ERROR"), ("3", "V", "V"), ("4", "C", "C")], "id string, label string, pred string")


def test_classification_by_hand(spark):
    p = pairs(spark)
    assert C.accuracy(p).first().accuracy == 0.75
    a = C.averages(p).first()
    assert (a.macro_f1, a.weighted_f1) == (0.666667, 0.833333) and C.averages(p, ["L", "V", "C"]).first().macro_f1 == 0.888889
    fn = {r.label: (r.tp, r.fp, r.fn, r.tn) for r in C.one_vs_rest(p, ["L", "V", "C"]).collect()}
    assert fn["L"] == (1, 0, 0, 2) and all(sum(v) == 3 for v in fn.values())
    assert {r.label: r.support for r in C.class_report(p).collect()}["L"] == 2
    assert {r.label: r.L for r in C.confusion(p, ["L", "V", "C"]).collect()} == {"L": 1, "V": 0, "C": 0}
    assert "0.6667" in {r.label: r.line for r in C.report_text(p).collect()}["L"]


def test_judging_by_hand(spark):
    rows = [("a", "一致"), ("b", "不一致"), ("", "一致"), ("TIMEOUT", "一致"), ("c", "?")]
    r = judging.precision(spark.createDataFrame(rows, "answer string, judgement string")).first()
    assert (r.correct, r.total, r.precision) == (1, 2, 0.5)
    none = judging.precision(spark.createDataFrame([], "answer string, judgement string")).first()
    assert (none.correct, none.total, none.precision) == (0, 0, 0.0)
    s = judging.scoring(spark.createDataFrame([("8",), ("无",), ("9分",)], "judgement string")).first()
    assert (s.avg_score, s.precision_pct, s.n) == (8.5, 85.0, 2)
    b = judging.with_contexts(spark.createDataFrame([([],), (["x"],), (None,)], "contexts array<string>")).collect()
    assert [r.contexts for r in b] == [["无参考文档"], ["x"], ["无参考文档"]]


def test_prompts(spark):
    df = spark.createDataFrame([("q", ["a", "b"]), ("q", [])], "q string, c array<string>")
    got = [r.p for r in df.select(PR.build_prompt(F.col("q"), F.col("c"), "{{x}} {contexts}|{question}", "none {question}").alias("p")).collect()]
    assert got == ["{x} [参考文档1] a\n\n[参考文档2] b|q", "none q"]
    with pytest.raises(KeyError):
        PR.render("{missing}", q=F.lit(1))
    with pytest.raises(ValueError):
        PR.render('{"a": {q}}', q=F.lit(1))
    m = spark.createDataFrame([([("user", "hi")],), ([("system", "s"), ("user", "u")],)], "m array<struct<role:string,content:string>>")
    chat = [r.x for r in m.select(PR.chat_template(F.col("m"), "sys").alias("x")).collect()]
    assert chat == ["<|im_start|>system\nsys<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n", "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nu<|im_end|>\n<|im_start|>assistant\n"]
    rows = spark.createDataFrame([(i, f"q{i}", f"r{i}") for i in range(7)], "pos long, question string, reply string")
    b = PR.batch_prompts(rows, "pos").orderBy("batch").collect()
    assert [r.n for r in b] == [5, 2] and b[1].body == "[0] 问题: q5\n回答: r5\n\n---\n\n[1] 问题: q6\n回答: r6"


def test_curation(spark, tmp_path):
    qa = spark.createDataFrame([(" 问题很长 ", "回答也足够长的一句话。"), (" 问题很长 ", "回答也足够长的一句话。"), ("短", "回答也足够长的一句话。"), (None, "x"), ("问题很长", "短")], "question string, reply string")
    assert [tuple(r) for r in curation.preclean(qa).collect()] == [("问题很长", "回答也足够长的一句话。")]
    rows = spark.createDataFrame([(0, 0, "a", "b"), (0, 1, "c", "d"), (1, 0, "e", "f")], "batch int, pos int, question string, reply string")
    answers = spark.createDataFrame([(0, '```json\n[{"index":1,"score":9,"reason":"x"},{"index":0,"score":3,"reason":"y"}]\n```'), (1, "[]")], "batch int, answer string")
    scored = curation.score_rows(rows, answers)
    assert {(r.question, r.score) for r in scored.collect()} == {("a", 3.0), ("c", 9.0), ("e", 6.0)}
    kept, removed = curation.split_kept(scored, 2)
    assert {r.question for r in kept.collect()} == {"c", "e"} and [r.question for r in removed.collect()] == ["a"]
    sft = spark.createDataFrame([("合同怎么签", "短"), ("天气", "晴"), ("合同", "长" * 600)], "instruction string, output string")
    assert [r.instruction for r in curation.expansion_targets(sft).collect()] == ["合同怎么签"]
    tries = spark.createDataFrame([(1, 1, "x", "a" * 250), (1, 2, "x", "b" * 300), (2, 1, "x", "c"), (2, 2, "x", "d")], "idx int, attempt int, original string, output string")
    assert {r.idx: r.output[0] for r in curation.accept_expansion(tries).collect()} == {1: "a", 2: "d"}
    todo, path = spark.range(5).withColumnRenamed("id", "idx"), str(tmp_path / "done")
    seen = []

    def work(df):
        seen.append(df.count())
        return df.withColumn("value", F.lit("v"))

    assert curation.resumable(todo.limit(2), path, work).count() == 2 and curation.resumable(todo, path, work).count() == 5 and seen == [2, 3]
