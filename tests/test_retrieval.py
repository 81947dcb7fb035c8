"""Sparse and dense search, fusion, reranking, metrics, the engine."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveworks.operators import dense, evaluation, fusion, providers, sparse
from sieveworks.plans.engine import Engine, Method
from sieveworks.plans.experiments import expand


def hits(spark, ids, q=1):
    return spark.createDataFrame([(q, i, r + 1, 1.0 / (r + 1)) for r, i in enumerate(ids)], "query_id long, chunk_id long, rank int, score double")


def listed(df):
    return [r.chunk_id for r in df.orderBy("query_id", "rank").collect()]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "aa bb"), (2, "aa cc cc"), (3, "dd dd")], "chunk_id long, text string")
    q = spark.createDataFrame([(7, "aa cc")], "query_id long, query string")
    got = [(r.chunk_id, r.rank, r.score) for r in sparse.search(sparse.build(docs), q).orderBy("rank").collect()]
    assert got == [(2, 1, 0.724949), (1, 2, 0.06824)]


def test_bm25_against_a_loop(spark, tmp_path):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choices(words, weights=[30 - k for k in range(30)], k=rng.randint(0, 25)))) for i in range(80)]
    asked = [(i, " ".join(rng.choices(words + ["zz"], k=4))) for i in range(6)]
    df = Counter(w for _, t in docs for w in set(t.split()))
    raw = {w: math.log(80 - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    mean, avgdl = sum(raw.values()) / len(raw), sum(len(t.split()) for _, t in docs) / 80
    idf = {w: 0.25 * mean if x < 0 else x for w, x in raw.items()}
    want = []
    for q, text in asked:
        s = {}
        for d, t in docs:
            tf, dl = Counter(t.split()), len(t.split())
            s[d] = round(sum(idf.get(w, 0) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * dl / avgdl)) for w in text.split()), 6)
        want += [(q, d, r + 1, x) for r, (d, x) in enumerate([p for p in sorted(s.items(), key=lambda p: (-p[1], p[0])) if p[1] > 0][:5])]
    index = sparse.build(spark.createDataFrame(docs, "chunk_id long, text string"))
    index.save(str(tmp_path))
    got = sparse.search(sparse.SparseIndex.load(spark, str(tmp_path)), spark.createDataFrame(asked, "query_id long, query string"), 5)
    assert [tuple(r) for r in got.orderBy("query_id", "rank").collect()] == want


@pytest.mark.parametrize("kind", ["clusters", "sphere", "one vector", "lengths", "few"])
def test_cells_give_what_the_scan_gives(spark, kind, tmp_path):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 12))
    v = {
        "clusters": centres[rng.integers(0, 6, 900)] + 0.05 * rng.normal(size=(900, 12)), "sphere": (x := rng.normal(size=(500, 12))) / np.linalg.norm(x, axis=1, keepdims=True),
        "one vector": np.repeat(centres[:1], 400, 0), "lengths": rng.normal(size=(400, 12)) * rng.lognormal(0, 2, (400, 1)), "few": rng.normal(size=(3, 12)),
    }[kind]
    q = np.concatenate([v[:5] + 0.01 * rng.normal(size=v[:5].shape), rng.normal(size=(4, 12)), np.zeros((1, 12))])
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(9999, None)], "chunk_id long, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)] + [(77, None)], "query_id long, embedding array<double>")
    index = dense.CellIndex.build(vectors).save(str(tmp_path))
    for block in (100, dense.BLOCK):
        got = sorted(map(tuple, index.search(queries, 7, block).collect()))
        assert got == sorted(map(tuple, dense.search(vectors, queries, 7).collect())) and len(got) == len(q) * min(7, len(v))
    share = index.touched(queries.filter("query_id < 5"), 7).agg(F.sum("scanned") / F.sum("vectors")).first()[0]
    assert share < 0.4 if kind == "clusters" else share <= 1


def test_cells_of_nothing(spark):
    nothing = spark.createDataFrame([], "chunk_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert dense.CellIndex.build(nothing).search(q).count() == 0
    some = spark.createDataFrame([(1, [1.0, 0.0])], "chunk_id long, embedding array<float>")
    assert dense.CellIndex.build(some).search(q.limit(0)).count() == 0


def test_bm25_shards_and_pruning(spark):
    """Many shards and queries against sums over all postings; common terms are mostly left unread."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(400)], k=rng.randint(5, 60)))) for i in range(3000)] + [(5000, None), (5001, "")]
    queries = [(i, " ".join(rng.choices(words, k=5)) + " w0 w1 w2 w0") for i in range(12)] + [(90, ""), (91, "nowhere"), (92, None)]
    df, q = spark.createDataFrame(docs, "chunk_id long, text string"), spark.createDataFrame(queries, "query_id long, query string")
    index = sparse.build(df)
    stats, idf = index.stats.first(), {r.term: r.idf for r in index.idf.collect()}
    counts = [(i, Counter(t.split()), len(t.split())) for i, t in docs if t]
    want = []
    for i, text in queries:
        s = {d: round(sum(f * idf.get(w, 0) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * dl / stats["avgdl"])) for w, f in Counter((text or "").split()).items()), 6) for d, c, dl in counts}
        want += [(i, d, r + 1, x) for r, (d, x) in enumerate(sorted(((d, x) for d, x in s.items() if x > 0), key=lambda p: (-p[1], p[0]))[:6])]
    for shard in (100, 1500, sparse.SHARD):
        got = [tuple(r) for r in sparse.search(index, q, 6, shard=shard).orderBy("query_id", "rank").collect()]
        assert got == want
    costs = {r.query_id: (r.postings, r.read) for r in sparse.reading_share(index, q, 6).collect()}
    assert all(read <= postings for postings, read in costs.values()) and sum(r for _, r in costs.values()) < 0.6 * sum(p for p, _ in costs.values())


def test_dense_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dense, "ROWS", 3)
    rng = np.random.default_rng(2)
    v, q = rng.normal(size=(50, 8)).astype(np.float32), rng.normal(size=(7, 8)).astype(np.float32)
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "chunk_id long, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id long, embedding array<float>")
    s = np.round(q.astype(float) @ v.astype(float).T, 6)
    want = [(i, int(c)) for i in range(7) for c in np.lexsort((np.arange(50), -s[i]))[:4]]
    assert [(r.query_id, r.chunk_id) for r in dense.search(vectors, queries, 4).orderBy("query_id", "rank").collect()] == want
    assert dense.search(vectors, queries, 90).count() == 350 and dense.search(vectors, queries.limit(0), 4).count() == 0
    assert dense.search(vectors.limit(0), queries, 4).count() == 0


def test_fusion_by_hand(spark):
    a, b = hits(spark, [1, 2, 3]), hits(spark, [2, 4])
    u = fusion.union_merge(a, b).orderBy("rank").collect()
    assert [(r.chunk_id, r.retriever) for r in u] == [(1, "dense"), (2, "dense"), (3, "dense"), (4, "sparse")]
    f = [(r.chunk_id, round(r.score, 6)) for r in fusion.weighted_fusion(a, b).orderBy("rank").collect()]
    assert f == [(2, 0.016261), (1, 0.008197), (4, 0.008065), (3, 0.007937)]
    assert listed(fusion.weighted_fusion(hits(spark, [5, 6]), hits(spark, [7, 8]))) == [5, 7, 6, 8]
    assert listed(fusion.union_merge(a.limit(0), b)) == [2, 4] and listed(fusion.weighted_fusion(a, b.limit(0), 2)) == [1, 2]


def test_rerank_ties_keep_the_order(spark):
    texts = spark.createDataFrame([(i, "x y" if i == 3 else "x") for i in range(1, 5)], "chunk_id long, text string")
    q = spark.createDataFrame([(1, "xx")], "query_id long, query string")
    out = fusion.rerank(q, hits(spark, [2, 1, 3, 4]), texts, lambda q, t: F.length(t).cast("double"), 3)
    assert listed(out) == [3, 2, 1]


def test_threshold_keeps_ties(spark):
    df = spark.createDataFrame([(s,) for s in (9, 8, 7, 7, 6)], "score int")
    assert sorted(r.score for r in fusion.top_with_ties(df, "score", 3).collect()) == [7, 7, 8, 9]
    assert fusion.top_with_ties(df, "score", 50).count() == 5 and fusion.top_with_ties(df.limit(0), "score", 3).count() == 0


def test_metrics_by_hand(spark):
    rel = spark.createDataFrame([(1, c) for c in (3, 1, 5)] + [(2, 8)], "query_id long, chunk_id long")
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    got = {r.query_id: r for r in evaluation.per_query(hits(spark, [7, 3, 9, 1]), rel, q).collect()}
    assert (got[1].hit_1, got[1].hit_5, got[1].recall_1, got[1].rr) == (0, 1, 0, 0.5) and abs(got[1].recall_5 - 2 / 3) < 1e-12
    assert got[2].rr == 0 and got[3].hit_20 == 0 and got[3].recall_20 == 0
    row = evaluation.evaluate(hits(spark, [7, 3, 9, 1]), rel, q).first()
    assert row.n_queries == 3 and row.mrr == 0.166667
    assert evaluation.report(evaluation.compare({"m": hits(spark, [3])}, lambda h: evaluation.per_query(h, rel, q))).first().hit_1 == "0.3333"
    v = spark.createDataFrame([(1, 1, 1), (1, 2, 0), (1, 3, 1), (2, 1, 0)], "query_id long, k int, verdict int")
    assert {r.query_id: round(r.value, 6) for r in evaluation.context_precision(v).collect()} == {1: 0.833333, 2: 0.0}


def test_relevance_by_label_and_by_contained_title(spark):
    q = spark.createDataFrame([(1, "a", "law court"), (2, "b", "weather"), (3, None, "x")], "query_id long, label string, query string")
    c = spark.createDataFrame([(3, "a", "the law court sat"), (7, "b", "law"), (9, None, "weather law court"), (1, "a", "")], "chunk_id long, label string, text string")
    h = hits(spark, [7, 3, 9, 1]).unionByName(hits(spark, [7], 2)).unionByName(hits(spark, [9], 3))
    got = {(r.query_id, r.chunk_id): r.rel for r in evaluation.judged_by_label(h, q, c).collect()}
    assert got == {(1, 7): 0, (1, 3): 1, (1, 9): 0, (1, 1): 1, (2, 7): 1, (3, 9): 0}
    assert {r.query_id: r.n_rel for r in evaluation.sizes_by_label(q, c).collect()} == {1: 2, 2: 1}
    got = {(r.query_id, r.chunk_id): r.rel for r in evaluation.judged_by_title(h, q, c).collect()}
    assert got == {(1, 7): 0, (1, 3): 1, (1, 9): 1, (1, 1): 0, (2, 7): 0, (3, 9): 0}


def test_dense_blocks_of_any_size_agree(spark):
    rng = np.random.default_rng(5)
    v = [(i, rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(300)] + [(900, None)]
    vectors, queries = spark.createDataFrame(v, "chunk_id long, embedding array<double>"), spark.createDataFrame(v[::20], "query_id long, embedding array<double>")
    want = []
    for i, e in v[::20]:
        best = sorted((-round(float(np.dot(e, x)), 6), j) for j, x in v if x is not None)[:7] if e else []
        want += [(i, j, r, -s) for r, (s, j) in enumerate(best, 1)]
    for block in (3, 64, 10_000):
        assert sorted(map(tuple, dense.search(vectors, queries, 7, block).collect())) == sorted(want)
    assert dense.search(vectors.limit(0), queries, 7).count() == 0 and dense.search(vectors, queries.limit(0), 7).count() == 0


def test_dense_index_comes_back(spark, tmp_path):
    chunks = spark.createDataFrame([(i, t) for i, t in enumerate(["tree", "on", "", None])], "chunk_id long, text string")
    index = dense.DenseIndex.build(chunks, dense.letter_encoder, "letters").save(str(tmp_path))
    assert tuple(index.config.first()) == ("letters", 8, 4)
    assert {r.chunk_id: [round(x, 6) for x in r.embedding] for r in index.vectors.collect()}[0] == [0.816497, 0.408248, 0, 0, 0, 0, 0, 0.408248]


def test_engine_answers_many_queries_at_once(spark):
    docs = spark.createDataFrame([(i, t, "law", None) for i, t in enumerate(["contract duty owed", "theft crime court", "contract law court", "weather today"])], "chunk_id long, text string, source string, section string")
    encode = providers.hash_encoder(32)
    e = Engine(docs, docs.select("chunk_id", encode(F.col("text")).alias("embedding")), sparse.build(docs), encode)
    q = e.queries(["contract court", "weather"])
    for m in Method:
        out = e.retrieve(q, 3, m).collect()  # the first query's words are in half of the documents: their idf is 0
        assert {r.query_id for r in out} == ({1} if m is Method.SPARSE else {0, 1}) and max(r.rank for r in out) <= 3
    best = {r.query_id: r.chunk_id for r in e.search(q, 1).collect()}
    assert best == {0: 2, 1: 3}
    reply = {r.query_id: r.reply for r in e.reply(q, 2).collect()}
    assert reply[0].startswith("检索到 2 条相关法律规定：\n\n【法条 1】(相关度: 1.0000)\n来源: law\n内容: contract law court\n")
    assert "[参考文档1] weather today" in {r.query_id: r.prompt for r in e.prompts(q, 2).collect()}[1]
    assert e.status() == {"chunks": 4, "vectors": 4, "reranker": True}
    e.scorer = None
    assert e.search(q, 1).count() == 2
    with pytest.raises(ValueError):
        e.retrieve(q, 3, "RRF+Rerank")
    with pytest.raises(ValueError):
        e.retrieve(q, 3, "nonsense")


def test_providers(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "fail")], "chunk_id long, text string")
    enc = providers.encoder(lambda: lambda texts: [[len(t), 0.0] for t in texts], batch=2)
    assert {r.chunk_id: list(r.v) for r in df.select("chunk_id", enc(F.col("text")).alias("v")).collect()} == {1: [1.0, 0.0], 2: [0.0, 0.0], 3: [1.0, 0.0]}
    done = providers.encode_missing(df, spark.createDataFrame([], "chunk_id long, text_hash long"), enc)
    assert providers.encode_missing(df.replace("a", "changed"), done, enc).select("chunk_id").collect()[0][0] == 1

    def make():
        def call(prompt):
            if prompt == "fail":
                raise RuntimeError("down")
            return f"<{prompt}>"

        return call

    got = {r.chunk_id: r.g for r in df.filter("text is not null").select("chunk_id", providers.generator(make, 2, 0)(F.col("text")).alias("g")).collect()}
    assert got[1].text == "<a>" and got[1].ok and got[3].text == "FAIL: down" and not got[3].ok
    many = {r.g for r in spark.range(40).select(providers.generator(make, 1, 0, in_flight=8)(F.col("id").cast("string"))["text"].alias("g")).collect()}
    assert many == {f"<{i}>" for i in range(40)}
    assert providers.scorer("overlap") is providers.overlap_score
    with pytest.raises(ValueError):
        providers.scorer("none")
    s = providers.pair_scorer(lambda: lambda pairs: [float(len(a + b)) for a, b in pairs])
    assert df.filter("chunk_id = 1").select(s(F.col("text"), F.lit("xy")).alias("s")).first().s == 3.0


def test_experiment_plans(spark):
    models, rerankers = ["org/small", "org/large"], ["org/r1", "org/r2"]
    full = [tuple(r)[1:4] for r in expand(spark, "full", models, rerankers).orderBy("ord").collect()]
    assert len(full) == len(set(full)) == 7 and full[0] == ("Dense", "org/small", "")
    assert expand(spark, "reranker", models, rerankers).filter("reranker = 'org/r1'").first().tag == "RRF+Rerank_small_r1"
    with pytest.raises(ValueError):
        expand(spark, "x", models, rerankers)
