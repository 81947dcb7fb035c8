"""The registered queries of the training-data operators: thin wrappers with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontaminate, fingerprint, language, lines, packing, quality, runs, sentences, simhash, toxicity, url_rules, warc
from .common import cut, held_out, table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint.document_fingerprints(table(spark, sf_dir, "documents"))
    return out.withColumns({c: fingerprint.as_text(F.col(c)) for c in ("fingerprint", "edited_fingerprint")})


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, similarity=None)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language.identify(docs, language.learn_profiles(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive(table(spark, sf_dir, "pages"))
    size = F.coalesce(F.octet_length("payload"), F.col("payload_bytes")).cast("long")
    digest = F.coalesce(F.sha1("payload"), F.col("payload_digest"))
    return records.select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lines.dedup_lines(docs.select("doc_id", "text"))


def tokenizer() -> tuple[str, str, str]:
    """Arguments of `packing.encoder`: the public vocabulary, as the installed package describes it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer(), with_ids=False)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.dedup_sentences(table(spark, sf_dir, "documents"))


#: host, path, verdict
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), rules)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    damaged = cut(conversations.damage(given))
    report = conversations.parse_conversations(damaged)
    digests = conversations.digest_rows(conversations.repaired_rows(damaged, report))
    every = given.select(F.col("conv_id").alias("conv")).distinct()  # some lose all of their rows
    same = lambda t: F.col("conv").eqNullSafe(t["conv_id"])
    out = every.join(report, same(report), "left").drop("conv_id").join(digests, same(digests), "left").drop("conv_id")
    out = out.withColumnRenamed("conv", "conv_id").fillna(0, [c for c in report.columns if c not in ("conv_id", "audit")])
    return out.withColumns({"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))})


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(runs.plant_runs(table(spark, sf_dir, "documents")))
    best = found.withColumn("best", runs.most_repeated(F.col("runs")))
    milli = F.expr("1000 * best.length div best.period")
    digests = [F.sha2(c, 256).alias(name) for c, name in ((runs.runs_text(F.col("runs")), "runs_sha256"), (F.col("collapsed"), "collapsed_sha256"))]
    return best.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli.alias("exponent_milli"), *digests)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_language_id": op4_language_id,
    "op5_warc": op5_warc,
    "op6_toxicity": op6_toxicity,
    "op7_line_dedup": op7_line_dedup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_quality_rules": op12_quality_rules,
    "op13_periodic_runs": op13_periodic_runs,
}

#: The places of the grammar, 1 to 4: at the start, after a system row, after a user row, after an answer. A cell is (c, a): cost and audit.
_ADD = "{{'c': {0}.c + {1}, 'a': {0}.a || '{2}'}}"
_INSERTED = (
    "[s[1], s[2], list_min([s[3], " + ", ".join(_ADD.format(f"s[{p}]", 5, "I") for p in (1, 2, 4)) + "]), list_min([s[4], " + _ADD.format("s[3]", 5, "I") + ", " + ", ".join(_ADD.format(f"s[{p}]", 10, "II") for p in (1, 2)) + "])]"
)
_KEPT = "{{'c': s[{0}].c + x.m + (x.k <> '{1}')::int, 'a': s[{0}].a || case when x.k = '{1}' then 'K' else 'R' end}}"
_NONE = "{'c': 1000000000::bigint, 'a': ''}"
_STEPPED = (
    "[" + _ADD.format("s[1]", 2, "D") + ", list_min([" + _ADD.format("s[2]", 2, "D") + f", case when x.k = 's' and not x.gone then {{'c': s[1].c + x.m, 'a': s[1].a || 'K'}} else {_NONE} end]), "
    "case when x.gone then " + _ADD.format("s[3]", 2, "D") + " else list_min([" + _ADD.format("s[3]", 2, "D") + ", " + ", ".join(_KEPT.format(p, "u") for p in (1, 2, 4)) + "]) end, "
    "case when x.gone then " + _ADD.format("s[4]", 2, "D") + " else list_min([" + _ADD.format("s[4]", 2, "D") + ", " + _KEPT.format(3, "a") + "]) end]"
)
_DUE = "case when s.p = 3 then 'assistant' else 'user' end"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLES: dict[str, str] = {
    "op5_warc": """
with p as (select page_id, coalesce(html, '') as body, strlen(coalesce(html, '')) as n from pages), f as (select *, max(page_id) over (partition by body) as first from p)
select page_id, n::bigint as payload_bytes, sha1(body) as payload_digest, case when n >= 1000 and page_id <> first then 'revisit' else 'response' end as record_type, case when n >= 1000 and page_id <> first then first end as refers_to from f
""",
    "op10_url_filter": f"""
with r(rule_host, rule_path, verdict) as (values {', '.join(map(str, URL_RULES))}),
a as (select page_id, url, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
b as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from a),
u as (select row_number() over () as k, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from b),
m as (select k, rule_host || rule_path as rule, verdict, row_number() over (partition by k order by length(rule_host) + length(rule_path) desc, length(rule_host) desc) as place
  from u join r on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from u left join (select * from m where place = 1) using (k)
""",
    "op11_conversation_repair": f"""
with tbl as materialized (select list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n)) as t),
o as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
f as (select o.*, xor(list_reduce([ord(x) for x in string_split(key, '')], lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295::bigint) % 20 as f from o, tbl),
d as (select conv_id, turn, case when f = 4 then 'user' else role end as role, case when f = 1 then '' when f = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case f when 0 then 0 when 3 then 2 else 1 end)) as copy from f),
n as (select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(coalesce(conv_id::varchar, chr(9)) || chr(10) || length(role) || chr(10) || role || chr(10) || text), copy) as i from d),
m as (select *, rtrim(text, {_SPACES}) as bare, row_number() over (partition by conv_id, role, text order by i) > 1 as again, lag(left(role, 1)) over (partition by conv_id order by i) as prior from n),
r as (select *, bare = '' as blank, bare <> '' and again as duplicate, bare <> '' and not again and right(bare, 1) not in ('.', '!', '?') as truncated from m),
g as materialized (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (duplicate) as duplicate, count(*) filter (truncated) as truncated,
  count(*) filter (prior is not null and prior || left(role, 1) not in ('su', 'ua', 'au')) as illegal, list(role order by i) as roles, list(text order by i) as texts,
  list({{'k': left(role, 1), 'm': case when truncated then 5 else 0 end, 'gone': blank or duplicate}} order by i) as rows from r group by conv_id),
a as (select g.*, list_reduce(rows, lambda s0, x: list_transform([s0], lambda s1: list_transform([{_INSERTED.replace('s[', 's1[')}], lambda s: {_STEPPED})[1])[1], [{{'c': 0::bigint, 'a': ''}}, {_NONE}, {_NONE}, {_NONE}]) as s from g),
e as (select * exclude (s), list_transform([{_INSERTED}], lambda z: list_min([z[1], z[4]]))[1] as best from a),
p as (select *, list_reduce(string_split(best.a, ''), lambda s, x: case when x = 'D' then {{'i': s.i + 1, 'p': s.p, 'o': s.o}}
  when x = 'K' then {{'i': s.i + 1, 'p': case left(roles[s.i], 1) when 's' then 2 when 'u' then 3 else 4 end, 'o': s.o || case when s.p > 1 then chr(10) else '' end || roles[s.i] || ':' || texts[s.i]}}
  else {{'i': s.i + (x = 'R')::int, 'p': case when s.p = 3 then 4 else 3 end, 'o': s.o || case when s.p > 1 then chr(10) else '' end || {_DUE} || ':' || case when x = 'R' then texts[s.i] else '' end}} end, {{'i': 1, 'p': 1, 'o': ''}}) as z from e)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(best.c, 0) as cost, coalesce(best.a, '') as audit, sha256(coalesce(z.o, '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join p on c.conv_id is not distinct from p.conv_id
""",
}
