"""Jobs that go on where they were broken off, rounds of retries, commands, and plans of experiments."""

import os
import sys

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sieveworks.operators import curation, fusion, providers
from sieveworks.plans import experiments


def chunks(spark, n, more=""):
    return spark.createDataFrame([(i, f"text {i}{more}") for i in range(n)] + [(None, None)], "chunk_id long, text string")


def broken_encoder(flag):
    """Fails for texts with a 7 while the file ``flag`` is there; vectors are lengths."""

    @F.pandas_udf("array<float>")
    def encode(texts: pd.Series) -> pd.Series:
        if os.path.exists(flag) and any("7" in (t or "") for t in texts):
            raise RuntimeError("out of memory")
        return pd.Series([[float(len(t or ""))] for t in texts])

    return encode


def test_encoding_goes_on_after_the_last_group(spark, tmp_path):
    flag, path = tmp_path / "flag", str(tmp_path / "index")
    flag.touch()
    table = chunks(spark, 60)
    with pytest.raises(Exception, match="out of memory"):
        providers.encode_in_groups(table, path, broken_encoder(str(flag)), "m", every=10)
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "index/groups/done").rglob("part-*.parquet")}
    before, committed = files(), spark.read.json(f"{path}/manifest").count() if (tmp_path / "index/manifest").exists() else 0
    # a second broken run touches no group that is done
    with pytest.raises(Exception, match="out of memory"):
        providers.encode_in_groups(table, path, broken_encoder(str(flag)), "m", every=10)
    assert {k: v for k, v in files().items() if k in before} == before and len(before) >= committed
    flag.unlink()
    got = providers.encode_in_groups(table, path, broken_encoder(str(flag)), "m", every=10)
    assert sorted(map(str, got.collect())) == sorted(map(str, table.select("chunk_id", F.array(F.coalesce(F.length("text"), F.lit(0)).cast("float")).alias("embedding")).collect()))
    assert sorted(p.name for p in (tmp_path / "index").iterdir()) == ["vectors"]


def test_a_changed_table_or_model_starts_afresh(spark, tmp_path):
    flag, path = tmp_path / "flag", str(tmp_path / "index")
    flag.touch()
    with pytest.raises(Exception, match="out of memory"):
        providers.encode_in_groups(chunks(spark, 40), path, broken_encoder(str(flag)), "m", every=5)
    flag.unlink()
    got = providers.encode_in_groups(chunks(spark, 40, "!!"), path, broken_encoder(str(flag)), "m", every=5)
    assert {r.embedding[0] for r in got.collect()} == {0.0, 8.0, 9.0} and got.count() == 41
    assert providers.encode_in_groups(chunks(spark, 1).limit(0), path, broken_encoder(str(flag)), "m").count() == 0


def test_batches_are_asked_until_read(spark):
    rows = spark.createDataFrame([(i, f"q{i}", f"r{i}") for i in range(23)], "n long, question string, reply string")
    entry = lambda i, s: f'{{"index": {i}, "score": {s}, "reason": "x{i}"}}'
    full = {b: [entry(i, b + i) for i in range(5 if b < 4 else 3)] for b in range(5)}
    said = {
        (0, 0): "[" + ", ".join(reversed(full[0])) + "]", (0, 1): "[" + ", ".join(full[1][:4]) + "]", (1, 1): "```json\n[" + ", ".join(full[1]) + "]\n```", (0, 2): "sorry", (1, 2): None, (2, 2): "[" + ", ".join(full[2]) + "]",
        (0, 3): "[", (1, 3): "[]", (2, 3): "[1, 2]", (0, 4): "[" + ", ".join([full[4][0], full[4][0], full[4][2]]) + "]",
    }
    asked = []

    def ask(prompts, number):
        asked.append(sorted(r.batch for r in prompts.collect()))
        answers = spark.createDataFrame([(b, a) for (r, b), a in said.items() if r == number], "batch long, answer string")
        return prompts.join(answers, "batch", "left")

    got = {r.n: (r.score, r.reason) for r in curation.score_in_rounds(rows, ask).collect()}
    assert asked == [[0, 1, 2, 3, 4], [1, 2, 3], [2, 3]]
    default = (6.0, curation.DEFAULT_REASON)
    want = {i: (float(i // 5 + i % 5), f"x{i % 5}") for i in range(23)} | {i: default for i in range(15, 20)} | {21: default}
    assert got == want
    assert curation.score_in_rounds(rows.limit(0), lambda p, _: p.withColumn("answer", F.lit(""))).count() == 0


def test_commands_and_their_failures(spark, tmp_path):
    program = tmp_path / "model.py"
    program.write_text(
        "import sys, time\np = sys.stdin.read()\n"
        "if p == 'hang': time.sleep(30)\nif p == 'fail': print('part'); print('no', file=sys.stderr); sys.exit(4)\n"
        "if p == 'quiet': print('why', file=sys.stderr); sys.exit()\nif p == 'nothing': sys.exit()\nprint(' ', p[::-1], 'é ')\nprint('note', file=sys.stderr)\n"
    )
    command = [sys.executable, str(program)]
    prompts = ["hang", "fail", "quiet", "nothing", "hello", None]
    df = spark.createDataFrame([(p,) for p in prompts], "p string").coalesce(1)
    got = {r.p: (r.g.text, r.g.ok) for r in df.select("p", providers.command_generator(command, timeout=4, in_flight=3)(F.col("p")).alias("g")).collect()}
    assert got == {"hang": ("OLLAMA_TIMEOUT", False), "fail": ("OLLAMA_RC_4: part\nno", False), "quiet": ("OLLAMA_EMPTY_STDOUT: why", False), "nothing": ("", True), "hello": ("olleh é", True), None: (None, False)}
    text, ok = providers.run_command(["no-such-program-anywhere"], "x", 1)
    assert text.startswith("OLLAMA_ERROR: ") and not ok


def test_experiments_share_their_legs(spark):
    calls = []
    hits = lambda *ids: spark.createDataFrame([(1, i, r + 1, 1.0 / (r + 1)) for r, i in enumerate(ids)], "query_id long, chunk_id long, rank int, score double")

    def dense(model, k):
        calls.append((model, k))
        return hits(1, 2, 3) if model == "a/x" else hits(9)

    def sparse(k):
        calls.append(("BM25", k))
        return hits(3, 4)

    queries = spark.createDataFrame([(1, "q")], "query_id long, query string")
    texts = spark.createDataFrame([(i, str(i)) for i in range(10)], "chunk_id long, text string")
    from sieveworks.operators import evaluation

    relevant = spark.createDataFrame([(1, 4), (1, 9)], "query_id long, chunk_id long")
    plan = experiments.expand(spark, "full", ["a/x", "a/y"], ["by number"])
    scorer = lambda name: lambda q, t: t.cast("double")
    rows = experiments.run(plan, dense, sparse, scorer, queries, texts, lambda h: evaluation.per_query(h, relevant, queries, [1, 5]), k=20, ks=[1, 5]).orderBy("ord").collect()
    assert sorted(calls) == [("BM25", 20), ("a/x", 20), ("a/y", 20)]
    got = {r.tag: (r.hit_1, r.recall_5, r.mrr) for r in rows}
    assert got == {"Dense_x": (0, 0, 0), "BM25_x": (0, 0.5, 0.5), "Union_x": (0, 0.5, 0.25), "RRF_x": (0, 0.5, 0.25), "Dense_y": (1, 0.5, 1), "RRF+Rerank_x_by number": (1, 0.5, 1)}
    assert fusion.rerank  # what reranks them


def test_from_files_to_answers_on_the_command_line(spark, tmp_path, capsys):
    from sieveworks import __main__ as cli

    (tmp_path / "law/sub").mkdir(parents=True)
    (tmp_path / "law/a.md").write_text("# 合同法\n\n第一条 合同成立。\n\n第二条 当事人应当履行义务。\n")
    (tmp_path / "law/sub/b.md").write_text("**劳动法**\n\n第一条 劳动者享有休息的权利。\n")
    (tmp_path / "books").mkdir()
    (tmp_path / "books/民法教程.txt").write_bytes("第一章 总则\n\n民法调整平等主体之间的关系。".encode("gbk"))
    (tmp_path / "articles.jsonl").write_text('{"input": "什么是违约责任", "answer": "违约责任是违反合同的后果。"}\n{broken\n')
    (tmp_path / "forum.csv").write_bytes('title,question,reply\n离婚财产如何分割呢大家,"我想问, 怎么分",一般由双方协商处理，不成由法院判决。\n'.encode("gb18030"))
    kinds = {"statutes": "law", "textbooks": "books", "articles": "articles.jsonl", "forum": "forum.csv"}
    index = str(tmp_path / "index")
    assert cli.main(["build", index, *[f"{k}={tmp_path / p}" for k, p in kinds.items()]]) == 0
    chunks = [(r.source, r.title) for r in spark.read.json(f"{index}/chunks").orderBy("chunk_id").collect()]
    assert list(dict.fromkeys(chunks)) == [("statute", "合同法"), ("statute", "劳动法"), ("textbook", "民法教程"), ("article", "什么是违约责任"), ("law_qa", "离婚财产如何分割呢大家")]
    capsys.readouterr()
    assert cli.main(["search", index, "当事人应当履行义务", "2", "BM25"]) == 0
    assert "第二条 当事人应当履行义务" in capsys.readouterr().out
    assert cli.main(["evaluate", index, "law_qa", "5", "3"]) == 0
    said = capsys.readouterr().out
    assert all(f"|{m} " in said for m in ("Dense", "BM25", "Union", "RRF"))
    assert cli.main(["build", index]) == cli.main(["search"]) == cli.main([]) == 2
    with pytest.raises(ValueError, match="unknown kinds"):
        cli.main(["build", index, "poems=x"])
