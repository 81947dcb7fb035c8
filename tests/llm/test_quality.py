"""Quality rules: counts against a plain loop, rules against what the labels say."""

import re
from collections import Counter

import pytest

from sieveworks.llm import quality, queries

from .util import docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def failed(n_words, _, __, ___, n_repeat_words):
    return n_words < 20 or 100 * n_repeat_words > 30 * n_words


def test_odd_texts(spark):
    unit = "a b c d e f g h"
    texts = [None, "", " \t\n\x0b\x0c\r", "one", "é ñ # * $\n\né ñ # * $\n \nx|<>", f"{unit} {unit}", f"{unit} z {unit}", "a " * 40, unit, unit[:-2], "x" * 500_000, " ".join(map(str, range(60_000))), f"{' '.join(map(str, range(9000)))} " * 2, "\xa0 non\xa0breaking A B! ?\r\nA B! ?\r\n"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, texts[7])]
    got = sorted(((r.doc_id, *(r[c] for c in COUNTS)) for r in quality.text_statistics(docs(spark, rows)).collect()), key=str)
    assert got == sorted(((i, *counts(t)) for i, t in rows), key=str)
    assert quality.text_statistics(docs(spark, [])).count() == 0


def test_query_equals_a_plain_loop(spark, sf_dir):
    table = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    df = queries.QUERIES["op12_quality_rules"](spark, sf_dir)
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()
    got = {r.doc_id: r for r in df.collect()}
    assert got.keys() == table.keys()
    for k, r in got.items():
        want = counts(table[k])
        assert tuple(r[c] for c in COUNTS) == want and r.base_failed == failed(*want)
        assert r.kept == (r.rejected_by is None) and (not r.base_failed or r.rejected_by == "base")
    judged = [(labels[k], got[k].kept) for k in labels if k in got and not got[k].base_failed]
    assert sum(q == 1 and not kept for q, kept in judged) == 0


def labelled(spark, rows):
    """rows: (doc_id, quality, n_words, n_symbols, n_capitals)"""
    stats = spark.createDataFrame([(r[0], r[2], 5 * r[2], r[3], 0, r[4], 1, 0, r[2], 0) for r in rows], "doc_id long, n_words long, word_chars long, n_symbols long, n_marks long, n_capitals long, n_lines long, n_dup_lines long, n_distinct long, n_repeat_words long")
    return stats, spark.createDataFrame([(r[0], r[1], "x") for r in rows], "doc_id long, quality int, n_words string")


def test_rules_are_ordered_conjunctions(spark):
    """Two kinds of bad documents: many symbols, and long ones in capitals (short ones in capitals are good)."""
    rows = [(i, 1, 50 + i % 100, 0, 5 + i % 5) for i in range(400)]
    rows += [(1000 + i, 0, 50 + i % 100, 40, 5) for i in range(120)] + [(2000 + i, 0, 110 + i % 40, 0, 300) for i in range(60)] + [(3000 + i, 1, 50 + i % 40, 0, 300) for i in range(60)]
    stats, labels = labelled(spark, rows)
    rules = quality.learn_rules(stats, labels)
    assert [c.feature for c in rules[0]] == ["symbols_per_word"] and len(rules) == 2
    assert {c.feature for c in rules[1]} == {"words", "capitals"} and all(c.above for c in rules[1])
    judged = stats.join(labels.select("doc_id", "quality"), "doc_id").select("quality", quality.verdict(rules).alias("rule")).collect()
    assert all((r.rule is None) == (r.quality == 1) for r in judged)


def test_noise_makes_no_rule(spark):
    stats, labels = labelled(spark, [(i, i % 2, 50 + i * 7 % 11, 0, 5 + i * 3 % 13) for i in range(300)])
    assert quality.learn_rules(stats, labels) == []


@pytest.mark.parametrize("kept", ["none", "one kind", "contradictory"])
def test_odd_labels(spark, kept):
    stats, labels = labelled(spark, [(i, i % 2, 50, 40 * (i % 2), 5) for i in range(40)] + [(None, 0, 50, 90, 1)])
    some = {"none": labels.limit(0), "one kind": labels.filter("quality = 0"), "contradictory": labels.union(labels.selectExpr("doc_id", "1 - quality", "n_words"))}[kept]
    assert quality.learn_rules(stats, some) == []
    out = stats.select("doc_id", quality.verdict([]).alias("rule"))
    assert out.count() == 41 and out.filter("rule is not null").count() == 0


def test_held_out_documents(spark, sf_dir):
    """Rules learned from four fifths of the labels keep the good documents of the last fifth."""
    stats = quality.cut(quality.text_statistics(spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")))
    labels = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/labels.parquet")
    fold = "crc32(cast(cast(doc_id as string) as binary)) % 5"
    rules = quality.learn_rules(stats, labels.filter(f"{fold} <> 0"))
    judged = stats.filter(~quality.base_failed()).join(labels.filter(f"{fold} = 0").select("doc_id", "quality"), "doc_id")
    rows = judged.select("quality", quality.verdict(rules).alias("rule")).collect()
    assert sum(r.quality == 1 and r.rule is not None for r in rows) == 0 and any(r.quality == 0 for r in rows)
    assert sum(r.quality == 0 and r.rule is None for r in rows) <= 0.35 * sum(r.quality == 0 for r in rows)
