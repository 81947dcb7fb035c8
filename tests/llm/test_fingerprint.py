import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from sieveworks.llm.fingerprint import as_text, document_fingerprints, with_next

from .util import docs


def jaccard(a, b):
    a, b = Counter(a.lower().split()), Counter(b.lower().split())
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_edited_texts_and_likeness(spark):
    import random

    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.randint(40, 200))) for _ in range(60)]
    texts[7] = texts[3]
    out = {r.doc_id: r for r in document_fingerprints(docs(spark, [(i * 3, t) for i, t in enumerate(texts)])).collect()}
    assert len(out) == 60
    wrong = []
    for i, t in enumerate(texts):
        n = texts[(i + 1) % 60]
        edited = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        r = out[3 * i]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(t)
        wrong += [r.near_edited - jaccard(t, edited), r.near_next - jaccard(t, n)]
    assert abs(sum(wrong) / len(wrong)) < 0.03 and max(map(abs, wrong)) < 0.27
    assert out[21].fingerprint == out[9].fingerprint


def test_null_empty_repeated_and_long(spark):
    long = " ".join(f"x{i % 5000} é" for i in range(60_000))
    out = {r.doc_id: r for r in document_fingerprints(docs(spark, [(None, "a b"), (1, None), (2, ""), (3, "one"), (9, long)])).collect()}
    assert len(out) == 5
    assert out[1].n_chars == 0 and out[1].fingerprint == out[2].fingerprint == [-1] * 48
    assert out[1].near_next == 1.0  # both are empty
    assert out[9].edited_sha256 == hashlib.sha256((long[: len(long) - len(long) // 4] + "a b").encode()).hexdigest()  # null comes first
    assert document_fingerprints(docs(spark, [])).count() == 0


def test_no_row_is_lost(spark):
    table = [(1, "aaaa bbbb"), (1, "cccc dddd eeee"), (1, "cccc dddd eeee"), (1, "cccc dddd eeee"), (None, "x y z w"), (None, "k"), (2, "bbbb aaaa")]
    got = sorted((tuple(r) for r in document_fingerprints(docs(spark, table)).select("doc_id", "n_chars", "edited_sha256", "near_next").collect()), key=str)
    by = F.struct(F.col("doc_id").isNotNull(), "doc_id", F.xxhash64("text"))
    order = [(r.doc_id, r.text) for r in docs(spark, table).orderBy(by).collect()]
    want = []
    for (d, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        k = len(t) // 4
        want.append((d, len(t), hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest(), t == n))
    assert Counter(g[:3] for g in got) == Counter(w[:3] for w in want)
    assert sum(g[3] == 1.0 for g in got) >= 2


def test_sampler_against_a_plain_loop(spark):
    """Winners of every sample, from the same draws, for two texts and both fingerprints."""
    table = [(1, "a b b c c c d " * 3), (2, "b b e f c")]
    got = {r.doc_id: r for r in document_fingerprints(docs(spark, table)).collect()}
    words = spark.createDataFrame([(w,) for w in "abcdef"], "w string").select("w", F.xxhash64("w").alias("k"))
    draws = words.select("w", "k", *[F.xxhash64("k", F.lit(i)).alias(f"u{i}") for i in range(96)]).collect()
    unit = lambda x, shift: ((x % (1 << 64) >> shift & 0xFFFFF) + 0.5) / (1 << 20)
    for d, text in table:
        counts, want = Counter(text.split()), []
        for s in range(48):
            best = []
            for r in draws:
                if n := counts[r.w]:
                    g = -math.log(unit(r[f"u{2 * s}"], 44) * unit(r[f"u{2 * s}"], 24))
                    c = math.log(-math.log(unit(r[f"u{2 * s + 1}"], 44) * unit(r[f"u{2 * s + 1}"], 24)))
                    b = unit(r[f"u{2 * s}"], 4)
                    t = math.floor(math.log(n) / g + b)
                    best.append((c - g * (t - b + 1), (r[f"u{2 * s + 1}"] + t * 40503) & 0xFFFF))
            want.append(min(best)[1])
        assert list(got[d].fingerprint) == want


def test_one_document_follows_itself(spark):
    (r,) = document_fingerprints(docs(spark, [(5, "abcdefgh")])).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and r.near_next == 1.0


def test_next_over_many_ranges(spark):
    ids = spark.range(0, 3000, 7).withColumnRenamed("id", "i")
    got = {r.i: r.next_i for r in with_next(ids, ["i"]).collect()}
    want = list(range(0, 3000, 7))
    assert got == dict(zip(want, want[1:] + want[:1], strict=True))


def test_query_equals_a_plain_loop(spark, sf_dir):
    """The registered query: edited texts by hand, whose fingerprints are those of documents with such texts."""
    from sieveworks.llm.queries import op1_fingerprints

    table = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    df = op1_fingerprints(spark, sf_dir)
    kinds = dict(df.dtypes)
    assert [kinds[c] for c in ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")] == ["bigint", "string", "string", "string", "double", "double"]
    got = {r.doc_id: r for r in df.collect()}
    assert got.keys() == {d for d, _ in table} and len(got) == len(table)
    edited = {}
    for (d, text), (_, after) in zip(table, table[1:] + table[:1], strict=True):
        n = len(text) // 4
        edited[d] = text[: len(text) - n] + after[:n]
    again = {r.doc_id: r.fingerprint for r in document_fingerprints(docs(spark, list(edited.items()))).withColumn("fingerprint", as_text(F.col("fingerprint"))).collect()}
    words = lambda fp: [fp[i : i + 4] for i in range(0, len(fp), 4)]
    alike = lambda a, b: sum(x == y for x, y in zip(words(a), words(b), strict=True)) / len(words(a))
    for (d, text), (following, _) in zip(table, table[1:] + table[:1], strict=True):
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited[d].encode()).hexdigest())
        assert r.edited_fingerprint == again[d]
        assert abs(r.near_edited - alike(r.fingerprint, r.edited_fingerprint)) < 1e-9 and abs(r.near_next - alike(r.fingerprint, got[following].fingerprint)) < 1e-9
