import random
from collections import defaultdict

import xxhash

from sieveworks.llm import simhash
from sieveworks.llm.queries import op2_simhash_near_dedup

from .util import docs


def brute_fingerprint(text):
    import re

    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(fps):
    """id -> least id reachable; fps: list of (id, fingerprint)."""
    root = {i: i for i, _ in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in fps:
        for j, b in fps:
            if i < j and (a ^ b).bit_count() <= 2:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in fps}


def test_golay_code_is_perfect():
    table = simhash.golay_indices()
    assert len(table) == 1 << 23 and (table >= 0).all() and int(table.max()) == 4095


def test_close_fingerprints_share_a_key():
    import numpy as np

    rng = random.Random(2)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 2):
            b ^= 1 << bit
        x, y = simhash.fuzzy_keys(np.array([a, b], dtype=np.uint64))
        assert set(x.tolist()) & set(y.tolist())
        assert 3 <= len(x) <= 18


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_components_of_crowded_and_sparse_fingerprints(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    fps = {centre} | {centre ^ 1 << b for b in range(20)} | {centre ^ (1 << a | 1 << b) for a in range(20) for b in range(a)}  # a full key
    chain = rng.getrandbits(64)
    for b in range(0, 40, 2):  # a long chain, two bits a step
        chain ^= 3 << b
        fps.add(chain)
    fps |= {rng.getrandbits(64) for _ in range(150)}
    order = sorted(fps)
    links = simhash.near_links(spark.createDataFrame([(signed(f),) for f in order], "fp long"))
    roots = {r.node: r.root for r in simhash.components(links).collect()}
    groups = defaultdict(set)
    for f in order:
        groups[roots.get(signed(f), signed(f))].add(f)
    want = defaultdict(set)
    for i, r in brute_components(list(enumerate(order))).items():
        want[r].add(order[i])
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_documents_against_brute_force(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op2_simhash_near_dedup(spark, sf_dir).collect()}
    fps = [(r.doc_id, brute_fingerprint(r.text)) for r in d]
    parts = brute_components(fps)
    assert got == {i: (f"{f:016x}", parts[i]) for i, f in fps}


def test_nulls_empties_repeats(spark):
    text = "éa b\x1cc d " * 5000
    out = simhash.near_duplicates(docs(spark, [(4, None), (2, ""), (9, " \t"), (7, text), (7, text), (5, text.upper()), (None, "x y z"), (1, "lonely words here now")])).collect()
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fp, r.component_id) for r in out)
    assert [(d, c) for d, _, c in got] == [(-1, None), (1, 1), (2, 2), (4, 2), (5, 5), (7, 7), (7, 7), (9, 2)]  # É isn't lower-cased
    assert [f for d, f, _ in got if d in (2, 4, 9)] == [0, 0, 0]
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_near_copies_are_linked_by_similarity(spark):
    import corpus_pipeline

    rng = random.Random(12)
    grams = lambda ws: {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}
    table, near = [], 0
    for k in range(150):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 300))]
        copy = list(words)
        for p in rng.sample(range(len(words)), rng.randint(1, max(1, len(words) // 35))):
            copy[p] = "other"
        a, b = grams(words), grams(copy)
        like = len(a & b) >= 0.8 * len(a | b)
        near += like
        table += [(2 * k, " ".join(words), like), (2 * k + 1, " ".join(copy), like)]
    d = docs(spark, [r[:2] for r in table])
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(d).collect()}
    linked = {i for i, _, _ in table if i % 2 and got[i] == i - 1}
    assert all(got[i] == i for i in got if i not in linked)
    want = {i for i, _, like in table if i % 2 and like}
    assert 20 < near < 140 and linked <= want and len(linked) >= 0.98 * len(want)
    kept = {r.doc_id for r in corpus_pipeline.keep_one_of_each_group(spark, d, "").collect()}
    assert kept == {i for i, _, _ in table} - linked


def test_near_copies_of_odd_rows_and_a_crowd(spark):
    words = [f"c{i}" for i in range(400)]
    crowd = [(100 + i, " ".join([*words[:i], "x", *words[i + 1 :]])) for i in range(120)]  # more than SMALL in a key
    out = simhash.near_duplicates(docs(spark, [(4, None), (2, ""), (9, " \t"), (7, "a b"), (7, "a b"), (5, "A  b"), (None, "x y z"), (1, "lonely words"), *crowd])).collect()
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id) for r in out if (r.doc_id or 0) < 100)
    assert got == [(-1, None), (1, 1), (2, 2), (4, 2), (5, 5), (7, 5), (7, 5), (9, 2)]
    assert {r.component_id for r in out if (r.doc_id or 0) >= 100} == {100}
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_pairs_within_a_crowd_of_one_template(spark):
    """300 pairs that share most of their text with all others, but only with each other enough; all are found."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**9)}"
    template = [word() for _ in range(180)]
    texts = []
    for _ in range(300):
        both = [word() for _ in range(6)]
        texts += [[*template, *both, *[word() for _ in range(18)]] for _ in range(2)]
    grams = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    like = lambda a, b: len(grams[a] & grams[b]) / len(grams[a] | grams[b])
    want = {(a, b) for a in range(600) for b in range(a) if like(a, b) >= 0.8}
    assert want == {(i, i - 1) for i in range(1, 600, 2)} and like(0, 2) > 0.75
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])).collect()}
    assert got == {i: i - i % 2 for i in range(600)}


def test_prefix_pairs_miss_none(spark):
    """Families of sets of many sizes, all with one root each, or with the roots of what is linked already."""
    rng = random.Random(4)
    sets, base = [], [rng.sample(range(3000), rng.randint(10, 120)) for _ in range(12)]
    for b in base:
        for _ in range(12):
            s = set(rng.sample(b, round(len(b) * rng.uniform(0.85, 1)))) | set(rng.sample(range(3000), rng.randint(0, len(b) // 8)))
            sets.append(s)
    like = {(a, b) for b in range(len(sets)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "fp long, s array<long>")
    alone = spark.createDataFrame([], "node long, root long")
    found = {tuple(r) for r in simhash._prefix_pairs(df, alone, 0.8).collect()}
    assert len(like) > 100 and like <= found
    roots = {i: min(j for j in range(12 * (i // 12), i + 1) if j % 2 == i % 2) for i in range(len(sets))}
    some = {tuple(r) for r in simhash._prefix_pairs(df, spark.createDataFrame(list(roots.items()), alone.schema), 0.8).collect()}
    assert {(a, b) for a, b in like if roots[a] != roots[b]} <= some and all(roots[a] != roots[b] for a, b in some)
