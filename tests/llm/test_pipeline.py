import pytest

import corpus_pipeline
from sieveworks.llm import decontaminate, lines, packing, simhash, toxicity
from sieveworks.llm.common import cut, hot_join, repeated, shared_folder

from .util import docs, rows


def test_stages_take_effect(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    toxic, dedup, near, leaks, pack = [f for _, f in corpus_pipeline.STAGES]

    kept = cut(toxic(spark, table, sf_dir))
    model = toxicity.fit(table, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score_documents(table, model).collect() if r.score >= 0.5}
    assert bad and {r.doc_id for r in kept.collect()} == {r.doc_id for r in table.collect()} - bad

    less = cut(dedup(spark, kept, sf_dir))
    own = {r.doc_id: r.text for r in lines.dedup_lines(kept).collect()}
    assert {r.doc_id: r.text for r in less.collect()} == {d: t for d, t in own.items() if t}
    assert all(r.n_chars == len(r.text) for r in less.collect())

    one = cut(near(spark, less, sf_dir))
    assert sorted(r.doc_id for r in one.collect()) == sorted({r.component_id for r in simhash.near_duplicates(less).collect()})

    clean = cut(leaks(spark, one, sf_dir))
    leaked = {r.doc_id for r in decontaminate.find_leaks(one, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert leaked and {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect()} - leaked
    assert kept.columns == less.columns == one.columns == clean.columns == table.columns

    placed = pack(spark, clean, sf_dir)
    assert {r.doc_id for r in placed.collect()} == {r.doc_id for r in clean.collect()}
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert rows(corpus_pipeline.run(spark, sf_dir), *cols) == rows(placed, *cols)


def test_odd_documents_pass_every_stage(spark, sf_dir):
    long = " ".join(f"w{i}" for i in range(120_000))
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    table = [(1, None), (2, ""), (None, "alone without id"), (None, None), (None, item), (3, "a b c d"), (3, "a b c d"), (3, "zz yy xx"), (4, "a b c d"), (5, "x\ny\nz\nw"), (6, "x\ny\nz\nw"), (6, f"clean {long}"), (7, f"{item} leaks"), (7, "clean words")]
    some = docs(spark, table)
    for empty in (False, True):
        d = some.limit(0) if empty else some
        for _, stage in corpus_pipeline.STAGES:
            columns = d.columns
            d = cut(stage(spark, d, sf_dir))
            assert d.columns == columns or "sequence_id" in d.columns
        ids = sorted({(r.doc_id, r.ids_crc32) for r in d.filter("piece = 0").collect()}, key=str)
        assert [i for i, _ in ids] == ([] if empty else [1, 3, 3, 5, 6, 7, None])
    assert packing.LENGTH == 2048


def test_hot_keys_are_joined_whole(spark):
    left = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 1, id) as k")
    counted = left.groupBy("k").count().withColumnRenamed("count", "n").filter("k % 2 = 1")
    want = rows(left.join(counted, "k"), "id", "k", "n")
    for least in (0, 1, 500, 10_000):
        assert rows(hot_join(left, counted, "k", least), "id", "k", "n") == want
    assert hot_join(left, counted.limit(0), "k").count() == 0


def test_rows_are_repeated(spark):
    some = spark.createDataFrame([("a", 1), ("b", 40_000), ("c", 0)], "x string, n long")
    assert rows(repeated(some, "n").groupBy("x").count(), "x", "count") == [("a", 1), ("b", 40_000)]


def test_no_machine_local_folder_on_a_cluster(monkeypatch):
    class Context:
        master, applicationId = "spark://somewhere:7077", "app"
        getConf = lambda self: self
        get = lambda self, key: None
        getCheckpointDir = lambda self: None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        shared_folder(Session())
