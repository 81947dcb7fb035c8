"""Numbers and running sums in order, and dictionary segmentation, against plain loops."""

import random
from itertools import combinations

import pytest

from sieveworks.functions import segment
from sieveworks.operators import running, sparse


@pytest.mark.parametrize("kind", ["sparse", "string", "one key"])
def test_numbers_follow_the_order(spark, kind):
    rng = random.Random(3)
    keys = {"sparse": [rng.randrange(-(1 << 62), 1 << 62) for _ in range(700)], "string": [f"k{rng.randrange(10**6)}" for _ in range(700)], "one key": [5] * 700}[kind]
    rows = [(k, i, "x") for i, k in enumerate(keys)] + [(None, -1, "x")]
    df = spark.createDataFrame(rows, f"k {'string' if kind == 'string' else 'long'}, i long, _part string").repartition(7)
    got = [(r.k, r.i) for r in running.number_rows(df, "k", "i").orderBy("n").collect()]
    assert got == sorted([(k, i) for k, i, _ in rows], key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1]))
    assert [r.n for r in running.number_rows(df, "k", "i").orderBy("n").collect()] == list(range(len(rows)))
    assert running.number_rows(df.limit(0), "k").count() == 0


def test_running_accuracy(spark):
    rng = random.Random(4)
    rows = [(i * 1000, rng.random() < 0.7, f"t{i}") for i in range(500)]
    out = running.running_accuracy(spark.createDataFrame(rows, "id long, correct boolean, text string").repartition(5), ["id"]).orderBy("id").collect()
    right = 0
    for n, ((i, correct, text), r) in enumerate(zip(rows, out, strict=True), 1):
        right += correct
        assert (r.id, r.text, r.done, r.right, r.accuracy) == (i, text, n, right, right / n)
    sums = running.running_sums(spark.createDataFrame([(1, 2.5), (2, None), (3, 1.0)], "k long, v double"), ["k"], {"s": "v"}).orderBy("k").collect()
    assert [r.s for r in sums] == [2.5, 2.5, 3.5]


def all_paths(run, costs, unknown):
    n = len(run)
    for r in range(n):
        for cuts in combinations(range(1, n), r):
            words = [run[a:b] for a, b in zip((0, *cuts), (*cuts, n), strict=True)]
            if all(len(w) == 1 or w in costs for w in words):
                yield sum(costs.get(w, unknown) for w in words), [-len(w) for w in words], words


def test_best_path_equals_all_segmentations():
    rng = random.Random(5)
    for _ in range(200):
        freq = {"".join(rng.choices("的一是不", k=rng.randint(1, 4))): rng.choice([1, 2, 2, 8, 50]) for _ in range(rng.randint(0, 14))}
        costs, unknown = segment.word_costs(freq)
        run = "".join(rng.choices("的一是不了", k=rng.randint(1, 9)))
        assert segment.best_path(run, costs, unknown, max(map(len, costs), default=1)) == min(all_paths(run, costs, unknown))[2]


def test_tokenizer_of_odd_texts_and_in_bm25(spark):
    lexicon = spark.createDataFrame([("合同", 50), ("合同", 10), ("合同法", 30), ("违约", 20), ("法", 5), ("", 9), (None, 3), ("零", 0)], "word string, freq long")
    cut = segment.dictionary_tokenizer(lexicon)
    texts = [(1, "合同法规定，违约责任"), (2, None), (3, ""), (4, "签合同ABC 12x_y z"), (5, "合同" * 40_000)]
    df = spark.createDataFrame(texts, "chunk_id long, text string")
    got = {r.chunk_id: r.w for r in df.select("chunk_id", cut(df.text).alias("w")).collect()}
    assert got[1] == ["合同法", "违约"] and got[2] == got[3] == [] and got[4] == ["合同", "ABC", "12x"] and got[5] == ["合同"] * 40_000
    index = sparse.build(df.filter("chunk_id < 5"), cut)
    q = spark.createDataFrame([(1, "违约的合同法"), (2, "合同")], "query_id long, query string")
    assert [(r.query_id, r.chunk_id) for r in sparse.search(index, q, 3, cut).orderBy("query_id", "rank").collect()] == [(1, 1), (2, 4)]
    with pytest.raises(ValueError, match="more than 2 words"):
        segment.dictionary_tokenizer(lexicon, limit=2)
