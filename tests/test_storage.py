"""Tables that jobs write for themselves, and when they go."""

import pytest

from sieveworks import storage


def folder(spark):
    storage.shared_folder(spark)
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(storage.shared_folder(spark)).getParent()
    return {str(s.getPath().getName()) for s in own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(own)}


def test_settled_tables_leave_no_others(spark):
    storage.cut(spark.range(3))
    before = folder(spark)

    def inner():
        return storage.cut(storage.cut(spark.range(10)).filter("id > 3"))

    def outer():
        kept = storage.settle(spark, inner)
        assert len(folder(spark) - before) == 1
        return storage.cut(kept).selectExpr("id + 1 as id")

    out = storage.settle(spark, outer)
    assert sorted(r.id for r in out.collect()) == [5, 6, 7, 8, 9, 10] and len(folder(spark) - before) == 1

    def broken():
        storage.cut(spark.range(5))
        raise RuntimeError("half way")

    now = folder(spark)
    with pytest.raises(RuntimeError, match="half way"):
        storage.settle(spark, broken)
    assert folder(spark) == now and not storage._OPEN


def test_passing_tables_go(spark):
    storage.shared_folder(spark)
    before = folder(spark)
    with storage.passing(spark):
        assert storage.cut(spark.range(4)).count() == 4 and len(folder(spark) - before) == 1
    assert folder(spark) == before and not storage._OPEN


def test_a_saved_index_is_not_dealt_to_its_buckets(spark, tmp_path):
    from pyspark.sql import functions as F

    from sieveworks.operators import dense, sparse

    docs = spark.range(60).select(F.col("id").alias("chunk_id"), F.concat(F.lit("common words and "), F.col("id").cast("string"), F.lit("th")).alias("text")).repartition(6)
    index = sparse.build(docs)
    index.save(str(tmp_path / "sparse"), buckets=2)
    loaded = sparse.SparseIndex.load(spark, str(tmp_path / "sparse"))
    assert sorted(map(str, loaded.postings.collect())) == sorted(map(str, index.postings.select(loaded.postings.columns).collect()))
    assert len(list((tmp_path / "sparse/postings/bucket=0").glob("*.parquet"))) > 1  # one task wrote all of a bucket before
    asked = spark.range(1).select(F.raise_error(F.lit("encoded again")).cast("string").alias("model"))
    vectors = docs.select("chunk_id", dense.letter_encoder(F.col("text")).alias("embedding"))
    assert dense.DenseIndex(vectors, asked, "letters").save(str(tmp_path / "dense")).config.first()["num_chunks"] == 60


def test_texts_of_a_group_are_several_tasks(spark, tmp_path, monkeypatch):
    from sieveworks.operators import dense, providers

    chunks = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "chunk_id long, text string")
    monkeypatch.setattr(providers, "PART", 10, raising=False)
    monkeypatch.setattr(providers, "delete", lambda *a: None)
    assert providers.encode_in_groups(chunks, str(tmp_path), dense.letter_encoder, "letters", every=100).count() == 200
    assert all(len(list((tmp_path / f"groups/todo/group={g}").glob("*.parquet"))) > 3 for g in range(2))  # a file and a task a group before


def test_batches_are_bounded(spark):
    from sieveworks.operators import chunking, providers, sparse

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.createDataFrame([(1, "text")], "doc_ord long, text string")
    rows = docs.withColumnRenamed("doc_ord", "chunk_id")
    calls = [lambda: chunking.statute_chunks(docs), lambda: chunking.book_chunks(docs), lambda: chunking.article_chunks(docs), lambda: chunking.qa_chunks(docs), lambda: sparse.token_lists(rows)]
    for call in [*calls, lambda: providers.encode_missing(rows, rows.selectExpr("chunk_id", "xxhash64(text) as text_hash"), providers.hash_encoder(8))]:
        spark.conf.set(key, "10000")
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        call()
        assert int(spark.conf.get(key)) == storage.BATCH_ROWS and int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == storage.BATCH_BYTES
