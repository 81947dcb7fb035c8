"""Readers, writers and the streaming extension on files of their own."""

import json

import pytest
from pyspark.sql import functions as F

from sieveworks.operators import providers
from sieveworks.plans.queries import table
from sieveworks.sources import readers, writers
from sieveworks.streaming.ingest import ingest


def write(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_markdown(spark, tmp_path):
    write(tmp_path / "m/a.md", "# 标题\n\n**甲**")
    write(tmp_path / "m/sub/b.md", "<!-- x -->")
    write(tmp_path / "m/c.txt", "no")
    assert [r.text for r in readers.markdown(spark, str(tmp_path / "m")).collect()] == ["标题\n\n甲"]
    assert readers.markdown(spark, str(tmp_path / "absent")).count() == 0


def test_articles(spark, tmp_path):
    p = write(tmp_path / "a.jsonl", '{"input": " 一 ", "answer": "二"}\n\nbroken {\n{"input": "x"}\n{"input": "", "answer": "y"}\n')
    assert [r.text for r in readers.articles(spark, p).collect()] == ["一\n二"]


def test_textbooks_in_any_encoding(spark, tmp_path):
    for name, enc in (("甲", "utf-8"), ("乙", "gbk"), ("丙", "gb18030")):
        write(tmp_path / f"t/{name}.txt", f"正文{name}" + ("㐀" if enc == "gb18030" else ""), enc)
    (tmp_path / "t/bad.txt").write_bytes("好".encode() + b"\xff\xff")
    got = {r.title: r.text for r in readers.textbooks(spark, str(tmp_path / "t")).collect()}
    assert got["甲"] == "【甲】\n\n正文甲" and got["乙"] == "【乙】\n\n正文乙" and got["丙"] == "【丙】\n\n正文丙㐀" and got["bad"] == "【bad】\n\n好"


def test_forum_and_test_csv(spark, tmp_path):
    p = write(tmp_path / "q.csv", 'title,question,reply\n甲,"多\n行",答复\n乙,,答\n,x,y\n丙,z,\n')
    assert sorted(r.text for r in readers.forum_qa(spark, p).collect()) == ["问：乙\n答：答", "问：甲\n补充：多\n行\n答：答复"]
    p = write(tmp_path / "t.csv", "﻿question,reply\na,b\nc,\n")
    assert [tuple(r) for r in readers.qa_test(spark, p).collect()] == [("a", "b")]
    with pytest.raises(ValueError):
        readers.qa_test(spark, write(tmp_path / "u.csv", "x,reply\n1,2\n"))
    assert readers.forum_qa(spark, write(tmp_path / "g.csv", "title,question,reply\n甲,,乙\n", "utf-16"), "UTF-16").first().title == "甲"


def test_json_files(spark, tmp_path):
    p = write(tmp_path / "k.jsonl", '{"id": "1", "pred": "a"}\n{"id": "2", "pred": "b"}\n{"id": "1", "pred": "c"}\n')
    assert {r.id: r.pred for r in readers.keyed(spark, p, "pred").collect()} == {"1": "c", "2": "b"}
    ref = write(tmp_path / "r.json", json.dumps([{"question": "q", "reply": "r"}, {"question": "p", "answer": "s"}]))
    assert {tuple(r) for r in readers.reference_answers(spark, [str(tmp_path / "no.json"), ref]).collect()} == {("q", "r"), ("p", "s")}
    lines = write(tmp_path / "r.jsonl", '{"query": "q", "answer": "a"}\n')
    assert [tuple(r) for r in readers.reference_answers(spark, [], lines).collect()] == [("q", "a")]
    for name in ("x.json", "x_detail.json"):
        write(tmp_path / "res" / name, json.dumps({"m": 1}))
    assert [r.file for r in readers.result_files(spark, str(tmp_path / "res")).collect()] == ["x.json"]
    write(tmp_path / "inf/a.json", json.dumps({"config": {"model": "m"}, "time": "1.0s", "results": [{"question": "q", "contexts": ["c"], "use_rag": True}]}))
    row = readers.inference_files(spark, str(tmp_path / "inf")).first()
    assert (row.file, row.config.model, row.contexts, row.use_rag) == ("a.json", "m", ["c"], True)


def test_writers(spark, tmp_path):
    t = spark.createDataFrame([("q", [1, 2])], "query string, relevant_ids array<long>")
    writers.test_set(t, str(tmp_path / "ts"))
    assert [tuple(r) for r in readers.test_set(spark, str(tmp_path / "ts")).collect()] == [("q", [1, 2])]
    c = spark.createDataFrame([("x", "s", "t", None, 0)], "text string, source string, title string, section string, chunk_id long")
    writers.chunks(c, str(tmp_path / "c"), json=True)
    assert readers.chunks(spark, str(tmp_path / "c")).collect() == c.collect()
    folder = writers.vectors(c.select("chunk_id"), "org/model", 3, str(tmp_path))
    assert folder.endswith("org_model") and spark.read.json(f"{folder}/config").first().num_chunks == 1
    writers.report(c, str(tmp_path / "r"), csv=True)
    writers.kept_and_removed(c.select("text"), c.select("text"), str(tmp_path / "kr"))
    writers.debug_and_clean(c, ["text"], str(tmp_path / "dc"))
    assert spark.read.option("header", True).csv(str(tmp_path / "dc/clean")).columns == ["text"]


def test_stream_ingests_each_file_once(spark, tmp_path, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    enc = providers.hash_encoder(8)
    docs.filter("doc_id % 2 = 0").write.parquet(src)
    ingest(spark, src, docs.schema, out, ck, enc).awaitTermination()
    n = spark.read.parquet(out).select("doc_id").distinct().count()
    docs.filter("doc_id % 2 = 1").write.mode("append").parquet(src)
    ingest(spark, src, docs.schema, out, ck, enc).awaitTermination()
    every = spark.read.parquet(out)
    assert every.select("doc_id").distinct().count() == docs.filter(F.length("text") > 0).count() > n
    assert every.groupBy("doc_id", "chunk_no").count().filter("count > 1").count() == 0


def test_many_small_files_are_few_tasks(spark, tmp_path):
    table = spark.createDataFrame([(f"line {i}\nü", i % 2) for i in range(400)] + [(None, 0)], "value string, folder int").repartition(3)
    writers.texts(table, str(tmp_path / "texts"), "folder")
    found = sorted((tmp_path / "texts").rglob("*.txt"))
    assert len(found) == 401 and sorted(p.read_text("utf-8") for p in found) == sorted([*[f"line {i}\nü\n" for i in range(400)], "\n"])
    assert {p.parent.name for p in found} == {"folder=0", "folder=1"}
    files = readers._files(spark, str(tmp_path / "texts"), "*.txt", True)
    assert files.rdd.getNumPartitions() <= 6 and files.count() == 401  # a task of every 32 files before
    assert readers.textbooks(spark, str(tmp_path / "texts/folder=*")).count() == 401 and readers.textbooks(spark, str(tmp_path / "none")).count() == 0
