"""Hand-made expectations of the text functions and chunkers."""

import pytest
from pyspark.sql import functions as F

from sieveworks.functions import text as X
from sieveworks.operators import chunking as C


def one(spark, f, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


def chunks(spark, f, text, **more):
    out = f(spark.createDataFrame([(1, text)], "k int, text string"), ["k"], **more)
    return [(r.text, r.section) for r in out.orderBy("chunk_no").collect()]


STATUTE = "测试法\n（2020年通过）\n第一章 总则\n第一条 为了测试。\n第二条 适用范围。\n第二章 附则\n第三条 本法自公布之日起施行。"


def test_statute(spark):
    assert chunks(spark, C.split_statute, STATUTE) == [("测试法\n（2020年通过）", "序言"), ("第一条 为了测试。", "第一章 总则"), ("第二条 适用范围。", "第一章 总则"), ("第三条 本法自公布之日起施行。", "第二章 附则")]


def test_single_part_level(spark):
    t = "第一章 总则\n第一条 甲。"
    assert chunks(spark, C.split_statute, t) == [("第一条 甲。", "")]
    assert chunks(spark, C.split_statute, t, keep_single=True)[0][1] == "第一章 总则"


def test_nested_levels_and_long_articles(spark):
    t = "第一编 甲\n第一章 乙\n第一节 丙\n第一条 一。\n第二节 丁\n第二条 " + "长" * 30 + "。\n\n短。\n第二章 戊\n第三条 三。\n第二编 己\n第四条 四。"
    got = chunks(spark, C.split_statute, t, limit=20)
    assert got[0] == ("第一条 一。", "第一编 甲 > 第一章 乙 > 第一节 丙")
    assert ("第三条 三。", "第一编 甲 > 第二章 戊") in got and got[-1] == ("第四条 四。", "第二编 己")
    assert all(len(t) <= 20 for t, _ in got)


def test_book_drops_titles_and_headers(spark):
    t = "【书】\n\n第一章 甲\n\n正文一。\n\n第二章 乙\n\n正文二。"
    assert chunks(spark, C.split_book, t) == [("第一章 甲\n\n正文一。", "第一章 甲"), ("第二章 乙\n\n正文二。", "第二章 乙")]
    docs = spark.createDataFrame([(1, t), (2, "无题。")], "doc_ord int, text string")
    assert {(r.doc_ord, r.title) for r in C.book_chunks(docs).collect()} == {(1, "书"), (2, "未知教材")}


def test_heading_needs_white_space(spark):
    for t, n in (("甲\n第八章\n乙", 2), ("甲\n第八章乙", 1), ("甲\n第十条之一 乙", 1), ("甲\n第１章　乙", 2), ("甲\n第两章 乙", 1)):
        level = "article" if "条" in t else "chapter"
        assert len(one(spark, lambda c, level=level: X.split_at(c, X.heading(level)), t)) == n, t


@pytest.mark.parametrize(
    "text,want",
    [("甲乙。丙丁；戊己庚辛壬癸子丑。寅。", ["甲乙。丙丁；", "戊己庚辛壬癸", "子丑。", "寅。"]), ("  ", []), (" a ", [" a "]), ("abcdefg", ["abcdef", "g"]), ("", [])],
)
def test_sentence_packing(spark, text, want):
    assert one(spark, lambda c: X.split_by_sentences(c, 6), text) == want


def brute_pack(parts, limit, joint, oversize):
    out, cur = [], ""
    for p in parts:
        if len(cur) + len(p) + len(joint) <= limit:
            cur = cur + joint + p if cur and joint else cur + p
        else:
            if cur.strip():
                out.append(cur.strip())
            cur = ""
            if len(p) > limit:
                out += oversize(p)
            else:
                cur = p
    return out + ([cur.strip()] if cur.strip() else [])


def test_packing_against_a_loop(spark):
    import random
    import re

    rng = random.Random(3)
    texts = ["".join(rng.choice("ab 。；\n\n c") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    hard = lambda s, n: [x for x in (s[i : i + n].strip() for i in range(0, len(s), n)) if x]

    def sent(t, n):
        if len(t) <= n:
            return [t] if t.strip() else []
        return brute_pack(re.split("(?<=[。；])", t), n, "", lambda s: hard(s, n))

    def para(t, n):
        if len(t) <= n:
            return [t.strip()] if t.strip() else []
        return brute_pack([p.strip() for p in t.split("\n\n") if p.strip()], n, "\n\n", lambda s: sent(s, n))

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.split_by_sentences(F.col("t"), 9).alias("s"), X.merge_paragraphs(F.col("t"), 9).alias("p")).collect()
    for r in rows:
        assert r.s == sent(r.t, 9), r.t
        assert r.p == para(r.t, 9), r.t


def test_markdown(spark):
    assert one(spark, X.clean_markdown, "## 第一章 总则\n\n\n\n**第一条** 见[甲](u)<!-- x\n -->") == "第一章 总则\n\n第一条 见甲"
    assert one(spark, X.clean_markdown, " *a* __b__ _c_　") == "a b _c_"


def test_small_functions(spark):
    assert one(spark, X.clean_sentence, ' “怎么办？？"') == "怎么办？"
    assert one(spark, X.fix_question_mark, "怎么办") == "怎么办？"
    assert one(spark, X.clean_keyword, '"law，合同、责任"') == "合同"
    assert one(spark, X.clean_keyword, "'law'") == "law"
    assert one(spark, X.norm, " a　b\n") == "ab"
    assert one(spark, X.structure_context, "第一编 甲\nx\n第二章 乙\n第三节 丙") == "第一编 甲 > 第二章 乙 > 第三节 丙"
    assert one(spark, X.han_bigrams, "合同法 ab 条") == ["合同", "同法"]
    assert one(spark, X.tokens, "The the A b2 é_x") == ["the", "the", "b2"]


def test_qa_chunks(spark):
    rows = [(1, "问：甲\n答：短"), (2, "问：" + "题" * 60 + "\n补充：q\n答：" + "长" * 12), (3, "问：甲\n答：短\n" + "长" * 20), (4, "no mark")]
    got = C.qa_chunks(spark.createDataFrame(rows, "doc_ord int, text string")).collect()
    assert [(r.doc_ord, len(r.title)) for r in got] == [(2, 50)]


def test_chunk_numbers(spark):
    mk = lambda name, rows: spark.createDataFrame(rows, "doc_ord long, chunk_no int, text string").withColumns({"source": F.lit(name), "title": F.lit("t")})
    a = mk("a", [(9000, 0, "a2"), (1, 0, "a0"), (1, 3, "a1")]).withColumn("section", F.lit("s"))
    b = mk("b", [(0, 1, "b1"), (0, 0, "b0")])
    got = C.number_chunks([a, b]).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.text, r.section) for r in got] == [(0, "a0", "s"), (1, "a1", "s"), (2, "a2", "s"), (3, "b0", None), (4, "b1", None)]
