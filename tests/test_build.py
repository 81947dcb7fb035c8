"""What building an index of source files costs: texts are looked through once, whatever becomes of them."""

import random
import re

from pyspark.sql import functions as F

from sieveworks.functions import text as X
from sieveworks.operators import chunking, dense, sparse
from sieveworks.plans import corpus
from sieveworks.sources import readers


def test_titles_are_found_before_texts_become_pieces(spark):
    docs = spark.createDataFrame([("1", " Titel\n" + "ein Satz。" * 300), ("2", ""), ("3", None)], "doc_ord string, text string")
    found = chunking.article_chunks(docs)
    assert {r.title for r in found.collect()} == {"Titel"}
    above, generate, _ = found._jdf.queryExecution().optimizedPlan().toString().partition("Generate")
    assert generate and "trim" not in above and "regexp" not in above  # each piece looked for the title in the whole text before


def test_building_reads_no_json(spark, tmp_path, monkeypatch):
    rows = [(str(i), f"第一章 总则\n第一条 text {i} of many words。\n" + "long sentence。" * 60) for i in range(6)]
    sources = {"statutes": spark.createDataFrame(rows, "doc_ord string, text string")}
    with monkeypatch.context() as m:
        m.setattr(readers, "chunks", None)  # both indexes parsed the chunk files before
        corpus.build(sources, str(tmp_path / "index"), dense.letter_encoder, "letters")
    engine = corpus.load(spark, str(tmp_path / "index"), dense.letter_encoder)
    ids = sorted(r.chunk_id for r in engine.chunks.collect())
    assert ids == list(range(len(ids))) and ids and sorted(r.chunk_id for r in engine.vectors.collect()) == ids
    assert {r.chunk_id for r in engine.index.postings.select("chunk_id").collect()} == set(ids)


def test_strip_is_that_of_the_pattern(spark):
    rng = random.Random(4)
    rows = [("".join(rng.choices(X.WHITE + "ab​᠎\x1c。😀", k=rng.randint(0, 9))),) for _ in range(3000)] + [(None,), ("",)]
    df = spark.createDataFrame(rows, "t string")
    assert df.filter(~X.strip(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+\z", ""))).count() == 0
    assert "regexp" not in df.select(X.strip(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()  # a pattern was before


def test_sentences_and_marks(spark):
    rng = random.Random(5)
    for _ in range(2000):
        t = "".join(rng.choices("ab。； \n", k=rng.randint(0, 40)))
        parts = re.split("(?<=[。；])", t)
        assert X.pack_sentences(t, 7) == ([t] if t.strip() and len(t) <= 7 else X._packed(parts, 7, "", lambda p: [x for i in range(0, len(p), 7) if (x := p[i : i + 7].strip())]))
    texts = ["第一条 a\n第二条 b", "x\n第三条 c", "条", " \n", "", None, "第1条 \n\n第2条 z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    pattern = X.heading("article")
    assert df.filter(~X.split_at(F.col("t"), pattern, "条").eqNullSafe(X.split_at(F.col("t"), pattern))).count() == 0


def test_lists_of_terms(spark):
    rows = [(1, "b a b c. A"), (2, None), (3, ""), (4, "x yy yy zz YY zz")]
    lists = sparse.token_lists(spark.createDataFrame(rows, "chunk_id long, text string").coalesce(1), lambda c: F.split(F.lower(c), r"[. ]+"))
    got = {r.chunk_id: (r.dl, r.terms, r.tfs) for r in lists.collect()}
    assert got == {1: (5, ["b", "a", "c"], [2, 2, 1]), 2: (0, [], []), 3: (1, [""], [1]), 4: (6, ["x", "yy", "zz"], [1, 3, 2])}
