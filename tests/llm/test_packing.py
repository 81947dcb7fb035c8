import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from sieveworks.llm import packing
from sieveworks.llm.queries import op8_best_fit_packing, tokenizer

from .util import docs, rows


def test_two_replace_the_smallest():
    # 6 + 3 leaves 1; taking 3 out again lets 2 + 2 fill the gap of 4
    assert sorted(map(sorted, ([[6, 3, 2, 2][i] for i in b] for b in packing.best_two_fit([6, 3, 2, 2], 10)))) == [[2, 2, 6], [3]]


def test_every_piece_is_packed_once_and_tightly():
    rng = random.Random(12)
    for cap in (10, 100, 2048):
        lengths = [min(cap, 1 + int(rng.expovariate(3 / cap))) for _ in range(3000)]
        bins = packing.best_two_fit(lengths, cap)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in b) <= cap for b in bins)
        assert len(bins) <= 1.005 * sum(lengths) / cap + 2
    assert packing.best_two_fit([], 5) == [] and packing.best_two_fit([5, 5], 5) == [[0], [1]]


def test_fast_path_gives_the_same_ids():
    rng = random.Random(13)
    fast, slow = packing.encoder(*tokenizer()), packing.encoder(tokenizer()[0])
    pools = ["abc XYZ 012 .,!?'\n\t  ", "éàüßñØø «»·ª² ", "　漢字かな", "\x85\xa0\x1c\x1f​😀<|endoftext|>'s'RE"]
    for _ in range(2000):
        t = "".join(rng.choice(rng.choice(pools[: rng.randint(1, 4)])) for _ in range(rng.randint(0, 60)))
        assert fast(t) == slow(t)


def test_ids_are_those_of_a_plain_tokenizer():
    plain = Tokenizer.from_file(tokenizer()[0])
    for t in ("a <|endoftext|> b", "<|endoftext|>", "plain words, only", "漢字 <|endoftext|>é"):
        assert packing.encoder(*tokenizer())(t) == plain.encode(t, add_special_tokens=False).ids


def test_one_id_over_many_groups(spark):
    rows = [(None if i % 2 else 7, f"text {i} " * (i % 90)) for i in range(600)]
    pieces = packing.stored(packing.tokenize(docs(spark, rows), tokenizer()), False)
    placed = packing.place(pieces, group=50).collect()
    check(rows, placed)
    sizes = Counter(r.sequence_id >> 32 for r in placed)
    assert len(sizes) == 12 and max(sizes.values()) < 90


def check(table, placed, length=2048):
    """Contract of the packed pieces against a plain tokenizer."""
    plain = Tokenizer.from_file(tokenizer()[0])
    encode = lambda t: plain.encode(t, add_special_tokens=False).ids
    want = []
    for d, t in table:
        ids = np.array([*encode(t or ""), 0], dtype="<u4")
        start = 0
        for piece, n in enumerate(packing.cut_lengths(len(ids), length)):
            want.append((d, piece, start, n, zlib.crc32(ids[start : start + n].tobytes())))
            start += n
    got = [tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in placed]
    assert sorted(got, key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in placed:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= length
    return len(bins), sum(n for *_, n, _ in want)


def test_query(spark, sf_dir):
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    bins, total = check(table, op8_best_fit_packing(spark, sf_dir).collect())
    assert bins <= 1.05 * total / 2048 + 1


def test_odd_rows(spark):
    table = [(1, None), (2, ""), (3, "word " * 30_000), (4, "a"), (4, "a"), (None, "x y z"), (5, "<|endoftext|> " * 3), (6, "漢字" * 900)]
    placed = packing.pack_documents(docs(spark, table), tokenizer(), with_ids=False).collect()
    check(table, placed)
    full = packing.pack_documents(docs(spark, table), tokenizer()).collect()
    assert sorted(zlib.crc32(bytes(r.ids)) for r in full) == sorted(r.ids_crc32 for r in placed)
    assert packing.pack_documents(docs(spark, []), tokenizer()).count() == 0


@pytest.mark.parametrize("n,want", [(1, [1]), (2048, [2048]), (2049, [1, 2048]), (5000, [904, 2048, 2048])])
def test_cut_lengths(n, want):
    assert packing.cut_lengths(n) == want
