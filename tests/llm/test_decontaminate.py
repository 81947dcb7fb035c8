import random

import numpy as np

from sieveworks.llm import decontaminate as D

from .util import docs, rows

VOCABULARY = [f"w{i}" for i in range(3000)]


def brute_distance(a, b):
    """Least edits that turn ``a`` into a run of words of ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        p = rng.randrange(len(words))
        kind = rng.random()
        if kind < 0.34:
            words[p] = rng.choice(VOCABULARY)
        elif kind < 0.67:
            del words[p]
        else:
            words.insert(p, rng.choice(VOCABULARY))
    return words


def bits_of(hashes):
    bits = np.zeros(1 << (D.FILTER_BITS - 6), dtype=np.uint64)
    for h in hashes:
        place = h & ((1 << D.FILTER_BITS) - 1)
        bits[place >> 6] |= np.uint64(1 << (place & 63))
    return bits.view(np.int64)


def matches(items, texts):
    """What `verified` says of the windows whose keys the items have, by plain tables."""
    known = [(i, " ".join(w), D.hashed(" ".join(w))) for i, w in items]
    parts = [(D.segment_length(len(h)), len(h), at, s) for _, _, h in known for s, at in D.segments(h)]
    second = [int(D.placed(np.array([s]), n, at)[0]) for _, n, at, s in parts]
    lengths = {}
    for length in {p[0] for p in parts}:
        ns, ats = zip(*sorted({p[1:3] for p in parts if p[0] == length}), strict=True)
        lengths[length] = (np.array(ns), np.array(ats))
    first, second, keys = bits_of([p[3] for p in parts]), bits_of(second), {}
    for i, text, h in known:
        for key in D.window_keys(h[None])[0].tolist():
            keys.setdefault(key, set()).add((i, text))
    asked = []
    for t in texts:
        doc, met = D.hashed(t), {}
        for n, starts in D.windows_of(doc, lengths, first, second):
            for start, row in zip(starts.tolist(), D.window_keys(D.cut_windows(doc, n, starts)).tolist(), strict=True):
                for item in set().union(*(keys.get(k, ()) for k in row)):
                    met.setdefault(item, set()).add(start)
        asked.append([(*item, sorted(starts)) for item, starts in met.items()])
    return D.verified(texts, asked)


def test_words_are_told_apart_by_their_hashes():
    text = "Ab_c déjà-VU 12,5 ½ 漢字\n the THE x" + "y" * 5000 + " İ ẞß \ud800 a"
    words = D.words_of(text)
    h = D.hashed(text).tolist()
    assert len(h) == len(words) and len(set(h)) == len(set(words)) and min(h) >= 0
    assert dict(zip(words, h, strict=True)) == {w: D.hashed(w).tolist()[0] for w in words}
    assert len(D.hashed(None)) == len(D.hashed("")) == len(D.hashed(" _-")) == 0


def test_segments_and_filter(spark):
    for n in range(1, 400):
        parts = D.segments(np.arange(n))
        assert len(parts) == D.edits_allowed(n) + 1 and n // len(parts) <= D.LONGEST
        assert all(at + n // len(parts) <= n for _, at in parts)
    assert D.segments(np.arange(0)) == []
    hashes = [5, -1, 1 << 62, -(1 << 63), (1 << D.FILTER_BITS) + 63]
    bits = D._filter(spark.createDataFrame([(h,) for h in hashes], "h long"))
    mask = (1 << D.FILTER_BITS) - 1
    assert sum(int(x).bit_count() if x >= 0 else int(x + (1 << 64)).bit_count() for x in bits.tolist()) == len({h & mask for h in hashes})
    assert all(bits[(h & mask) >> 6] >> (h & mask & 63) & 1 for h in hashes)


def table(rng, n):
    return [(i, rng.choices(VOCABULARY, k=rng.randint(8, 60))) for i in range(n)]


def test_recall_at_every_share_of_edits():
    rng = random.Random(4)
    items = table(rng, 120)
    for share in (0, 0.1, 0.2):
        texts = [" ".join(rng.choices(VOCABULARY, k=rng.randint(0, 90)) + edited(rng, w, int(share * len(w) + 1e-9)) + rng.choices(VOCABULARY, k=rng.randint(0, 90))) for _, w in items]
        found = sum(i in {m[0] for m in got} for (i, _), got in zip(items, matches(items, texts), strict=True))
        assert found >= 0.97 * len(items)


def test_recall_of_long_items():
    rng = random.Random(10)
    for n, many in ((5, 60), (50, 60), (150, 40), (200, 40), (300, 30), (500, 16), (1000, 6)):
        items = [(i, rng.choices(VOCABULARY, k=n)) for i in range(many)]
        texts = [" ".join(rng.choices(VOCABULARY, k=30) + edited(rng, w, n // 5) + rng.choices(VOCABULARY, k=30)) for _, w in items]
        found = sum(i in {m[0] for m in got} for (i, _), got in zip(items, matches(items, texts), strict=True))
        assert found >= 0.97 * many


def test_no_match_beyond_the_limit():
    rng = random.Random(5)
    items = table(rng, 40)
    texts = [" ".join(edited(rng, w, int(0.45 * len(w)))) for _, w in items] + [" ".join(rng.choices(VOCABULARY, k=300)) for _ in range(40)]
    for t, got in zip(texts, matches(items, texts), strict=True):
        for item, _, n, e in got:
            assert brute_distance(items[item][1], D.words_of(t)) <= e <= D.edits_allowed(n)


def test_tables(spark):
    rng = random.Random(6)
    (_, a), (_, b), (_, c) = table(rng, 3)
    bench = spark.createDataFrame([(1, " ".join(a)), (2, "  ".join(b).upper()), (3, None), (4, ""), (5, "too short"), (7, "!"), (1, " ".join(a))], "item_id long, text string")
    long = " ".join(rng.choices(VOCABULARY, k=60_000) + b)
    d = docs(spark, [(10, f"x {' '.join(a)}! y"), (11, None), (12, ""), (13, "Far too, short"), (10, "clean words"), (None, "no leak"), (14, ", ".join(b)), (14, ", ".join(b)), (None, " ".join(a)), (15, long), (16, " ".join(c))])
    assert {r[:2] for r in rows(D.find_leaks(d, bench), "doc_id", "item_id")} == {(10, 1), (13, 5), (14, 2), (None, 1), (15, 2)}
    kept = D.keep_uncontaminated(d, bench)
    assert kept.columns == d.columns
    assert rows(kept.filter("doc_id <> 16 or doc_id is null"), "doc_id", "text") == sorted([(10, "clean words"), (11, None), (12, ""), (None, "no leak")], key=str)
    assert kept.filter("doc_id = 16").count() == 1
    assert D.find_leaks(docs(spark, []), bench).count() == 0
    assert D.find_leaks(d, bench.limit(0)).count() == 0


def test_an_item_of_the_commonest_words(spark):
    """Short items that hold a run that is everywhere, one text under many ids, and documents full of that run."""
    rng = random.Random(9)
    crowd = [(i, " ".join(["of", "the"] * 6 + rng.choices(VOCABULARY, k=20))) for i in range(400)]
    bench = [(k, " ".join(["of", "the", *rng.choices(VOCABULARY, k=rng.randint(3, 7))])) for k in range(60)] + [(100 + k, "of the one and only text here") for k in range(30)]
    held = [(1000 + k, f"{' '.join(rng.choices(VOCABULARY, k=9))} {t} tail") for k, t in bench[:60]] + [(5000, "so of the one and only text here")]
    got = {r[:2] for r in rows(D.find_leaks(docs(spark, crowd + held), spark.createDataFrame(bench, "item_id long, text string")), "doc_id", "item_id")}
    want = {(1000 + k, k) for k in range(60)} | {(5000, 100 + k) for k in range(30)}
    assert want <= got
    texts, items = dict(crowd + held), dict(bench)
    assert all(brute_distance(D.words_of(items[i]), D.words_of(texts[d])) <= D.edits_allowed(len(items[i].split())) for d, i in got)


def test_contained_items_are_all_found(spark, sf_dir):
    from sieveworks.llm.queries import op3_benchmark_decontamination

    got = {(r.doc_id, r.item_id) for r in op3_benchmark_decontamination(spark, sf_dir).collect()}
    padded = lambda t: f" {' '.join(D.words_of(t))} "
    bench = [(r.item_id, padded(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    want = {(d, i) for d, t in text.items() for i, b in bench if b in padded(t)}
    assert want <= got
    items = dict(bench)
    for d, i in got:
        assert brute_distance(items[i].split(), D.words_of(text[d])) <= D.edits_allowed(len(items[i].split()))
