"""Periodic runs against a search distance by distance."""

import hashlib
import random
from fractions import Fraction
from zlib import crc32

import numpy as np
import pytest

from sieveworks.llm import queries, runs

from .util import docs


def brute(words):
    """Every run, by all distances and places."""
    best = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q) and (i, j + q) not in best:
                best[i, j + q] = q
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in best.items())


def kept(words, found):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in found))


def some_texts(rnd, many):
    for _ in range(many):
        words = [rnd.choice("abcdefgh"[: rnd.randint(1, 8)]) for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 3)):
            unit = [rnd.choice("abcxyz") for _ in range(rnd.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 40, 64, 65]))]
            times = rnd.uniform(2.5, 6)
            words += (unit * 7)[: int(len(unit) * times)] + [rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 30))]
        yield words


def test_runs_equal_brute_force():
    texts = list(some_texts(random.Random(5), 400))
    for words, (found, collapsed) in zip(texts, runs.texts_runs([" ".join(w) for w in texts]), strict=True):
        want = brute(words)
        assert sorted(found) == want
        assert found == sorted(found, key=lambda r: (r[0], r[2]))
        assert collapsed == kept(words, want)
        assert runs.plain_runs(np.array([ord(w) for w in words])) == want


@pytest.mark.parametrize("size", [32, 256])
def test_transform_is_exact(size):
    rnd = np.random.default_rng(size)
    a, b = (rnd.integers(0, runs.PRIME, (3, size), dtype=np.uint64) for _ in range(2))
    got = runs.transform_back(runs.transform(a) * runs.transform(b) % np.uint64(runs.PRIME))
    for x, y, z in zip(a.tolist(), b.tolist(), got.tolist(), strict=True):
        assert z == [sum(x[i] * y[(k - i) % size] for i in range(size)) % runs.PRIME for k in range(size)]


def test_zero_mismatches_are_all_occurrences():
    rnd = np.random.default_rng(2)
    values = np.concatenate([rnd.integers(0, 2, 400).astype(np.uint64), np.zeros(200, np.uint64)])
    squares = np.concatenate([[np.uint64(0)], np.cumsum(values * values, dtype=np.uint64)])
    blocks = np.arange(0, 200, 8)
    at, q = runs.zero_mismatches(values, squares, blocks, 8, 1, 16)
    assert set(zip(at.tolist(), q.tolist(), strict=True)) == {(k, d) for k in blocks.tolist() for d in range(1, 16) if (values[k : k + 8] == values[k + d : k + d + 8]).all()}


def test_one_word_and_nested_texts_of_great_length():
    many = 60_000
    long = [["a"] * many, ["a", "b"] * (many // 2), (["a", "b"] * 50 + ["c"]) * (many // 101), [str(i) for i in range(many)], (["x"] * 30 + ["y"]) * 1000]
    found = [r for r, _ in runs.texts_runs([" ".join(w) for w in long])]
    assert found[0] == [(0, many, 1)] and found[1] == [(0, many, 2)] and found[3] == []
    n = many // 101 * 101
    assert (0, n, 101) in found[2] and len(found[2]) == 1 + many // 101
    assert (0, 31_000, 31) in found[4] and len(found[4]) == 1001


def test_texts_that_deceive_the_hashes_are_searched_plainly(monkeypatch):
    monkeypatch.setattr(runs._Words, "agree", lambda self, a, q, n: np.ones(len(a), dtype=bool))
    words = list("abcabcabd" * 3 + "xyz" * 9)
    assert runs.texts_runs([" ".join(words)])[0][0] == brute(words)


def planted(doc_id, text):
    words = (text or "").encode().split()
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return [w.decode() for w in words]


def test_query_equals_brute_force(spark, sf_dir):
    table = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.QUERIES["op13_periodic_runs"](spark, sf_dir).collect()}
    assert got.keys() == table.keys()
    short = [k for k, t in table.items() if len((t or "").split()) <= 1500]
    assert sum(got[k].n_runs > 0 for k in short) > 5
    for k in short:
        words, r = planted(k, table[k]), got[k]
        want = runs.plain_runs(np.unique(words, return_inverse=True)[1]) if words else []
        best = min(want, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
        milli = None if best[0] is None else 1000 * best[1] // best[2]
        text = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(want, key=lambda x: (x[0], x[2])))
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (text, kept(words, want))]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == (len(want), *best, milli, *digests), k


def test_odd_rows(spark):
    unit = " ".join(f"w{i}" for i in range(9))
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "a " * 23), (5, "a " * 24), (5, "a " * 24), (None, f"{unit}\n{unit}\t{unit}"), (6, " ".join([unit] * 3000)), (7, "é x " * 30)]
    out = runs.find_runs(docs(spark, rows))
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()), key=str)
    want = [(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 23, [], " ".join("a" * 23)), (5, 24, [(0, 24, 1)], "a"), (5, 24, [(0, 24, 1)], "a"), (None, 27, [(0, 27, 9)], unit), (6, 27_000, [(0, 27_000, 9)], unit), (7, 30, [(0, 30, 1)], "é x")]
    assert got == sorted(want, key=str)
    assert runs.find_runs(docs(spark, [])).count() == 0
