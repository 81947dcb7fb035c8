"""The containment join against a loop over all pairs."""

import random

from sieveworks.operators import containment


def test_every_string_keeps_grams_that_its_texts_keep():
    rng = random.Random(1)
    for _ in range(300):
        string = "".join(rng.choices("abé😀 ", k=rng.randint(1, 200)))
        tier = min(len(string).bit_length() - 1, containment.TIERS)
        own = containment.minimizers(string, tier)
        text = "".join(rng.choices("abé", k=rng.randint(0, 90))) + string + "".join(rng.choices("abé", k=rng.randint(0, 90)))
        assert len(own) and set(own.tolist()) <= set(containment.minimizers(text, tier).tolist())


def test_containing_equals_all_pairs(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcde", k=rng.randint(1, 6)))
    texts = [(i, " ".join(word() for _ in range(rng.randint(0, 120)))) for i in range(150)] + [(200, None), (201, ""), (None, "abc abc"), (3, "abc abc")]
    whole = [t for _, t in texts if t]
    strings = []
    for i in range(200):
        t = rng.choice(whole)
        a = rng.randrange(len(t))
        strings.append((i, t[a : a + rng.choice([1, 2, 3, 5, 9, 15, 16, 31, 33, 64, 200])] + rng.choice(["", "", "", "z"])))
    strings += [(900, None), (901, ""), (None, "abc"), (902, "abc"), (902, "abc"), (903, "nowhere at all")]
    got = containment.containing(spark.createDataFrame(strings, "string_id long, string string"), spark.createDataFrame(texts, "text_id long, text string").repartition(5))
    want = [(i, j) for i, s in strings if s for j, t in texts if t and s in t]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_empty_tables(spark):
    strings, texts = spark.createDataFrame([(1, "a")], "string_id long, string string"), spark.createDataFrame([(1, "a")], "text_id long, text string")
    assert containment.containing(strings.limit(0), texts).count() == 0 and containment.containing(strings, texts.limit(0)).count() == 0


def test_only_texts_that_a_string_may_be_in_are_written(spark, monkeypatch):
    import hashlib

    from sieveworks.operators import containment

    written = []
    monkeypatch.setattr(containment, "cut", lambda df, cut=containment.cut: written.append(out := cut(df)) or out)
    held = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(300)]
    texts = spark.createDataFrame([*enumerate(held), (300, None)], "text_id long, text string")
    strings = spark.createDataFrame([(0, held[7][3:30]), (1, held[9]), (2, "nowhere at all"), (3, "")], "string_id long, string string")
    assert {tuple(r) for r in containment.containing(strings, texts).collect()} == {(0, 7), (1, 9)}
    assert all(w.count() < 300 for w in written if "text" in w.columns)  # all texts were written before


def test_what_is_written_grows_with_strings_and_hits(spark, monkeypatch):
    import hashlib

    written = []
    monkeypatch.setattr(containment, "cut", lambda df, cut=containment.cut: written.append(out := cut(df)) or out)
    held = ["".join(hashlib.sha256(f"{i}:{j}".encode()).hexdigest() for j in range(8)) for i in range(40)]
    strings = [(i, held[i][20 * j : 20 * j + 90]) for i in range(40) for j in range(5)] + [(900, held[0][:90])]
    got = containment.containing(spark.createDataFrame(strings, "string_id long, string string"), spark.createDataFrame([*enumerate(held), (50, held[7])], "text_id long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted((i, j) for i, s in strings for j, t in [*enumerate(held), (50, held[7])] if s in t)
    assert not any("text" in w.columns for w in written)  # texts were written, and then moved once for each of their strings
    assert [w.count() for w in written if "gram" in w.columns] == [200]  # all grams of strings were asked for before


def test_many_pairs_are_merged(spark, monkeypatch):
    monkeypatch.setattr(containment, "SMALL", 0)
    test_containing_equals_all_pairs(spark)
    test_empty_tables(spark)


def test_kept_grams_are_the_minimizers_of_each_tier():
    import numpy as np

    rng = random.Random(6)
    for _ in range(300):
        text, tiers = "".join(rng.choices("abé😀 ", k=rng.randint(1, 300))), sorted(rng.sample(range(containment.TIERS + 1), 3))
        every = np.unique(np.concatenate([containment.minimizers(text, t) for t in tiers]))
        assert set(containment._kept(text, tiers).view(np.int64).tolist()) == set(every.tolist())
        known = np.zeros(1 << (containment.FILTER_BITS - 3), dtype=np.uint8)
        for i in range(containment.PLACES):
            at = containment._place(every[::2].view(np.uint64), i)
            np.bitwise_or.at(known, at >> 3, (1 << (at & 7)).astype(np.uint8))
        assert containment._asked(every.view(np.uint64), known).view(np.int64).tolist() == sorted(every[::2].tolist(), key=lambda x: x % (1 << 64))
