"""The registered queries over the given tables, each beside the SQL that another engine can run.

Corpus: ``documents`` (doc_id as chunk_id). Queries: ``benchmark``. Vectors: ``embeddings``,
where vectors of one label are relevant to each other; as searches every vec_id divisible by 20
is asked against all vectors. Records: ``conversations`` (a user turn and the assistant turn after it).
Operators for Han text get whole texts of the tables whose letters `han` replaces by Han characters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import parsing as P
from ..functions import prompts as PR
from ..functions import text as X
from ..operators import chunking, classification, curation, dense, evaluation, fusion, judging, providers, running, sparse
from ..storage import cut, spread
from .engine import Engine

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "source"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


#: What `han` replaces, and by what: characters of which some spell words that the operators look for.
LATIN, HAN = "abcdefghijklmnopqrstuvwxyz.,", "的一是不了在人有我他这中大来上公司国到说小明請解析法？，"


def han(c: Column) -> Column:
    """A text with its letters replaced by Han characters."""
    return F.translate(F.lower(c), LATIN, HAN)


def han_sql(c: str) -> str:
    return f"translate(lower({c}), '{LATIN}', '{HAN}')"


# ---------------------------------------------------------------- text


@query(r"""
with t as (select page_id, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') x from pages),
a as (select page_id, regexp_replace(regexp_replace(x, '(?m)^#{1,6}\s+', '', 'g'), '\*\*(.+?)\*\*', '\1', 'g') x from t),
b as (select page_id, regexp_replace(regexp_replace(x, '__(.+?)__', '\1', 'g'), '\*(.+?)\*', '\1', 'g') x from a),
c as (select page_id, regexp_replace(regexp_replace(x, '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g') x from b)
select page_id, regexp_replace(x, '^\s+|\s+$', '', 'g') as text from c
""")
def clean_markup(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.clean_markdown(F.col("html")).alias("text"))


@query(r"select doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') as text, regexp_replace(text, '\s+', '', 'g') as bare from documents")
def strip_ws(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.strip(F.col("text")).alias("text"), X.norm(F.col("text")).alias("bare"))


@query("select source, count(*) as n, min(length(text)) as min_len, max(length(text)) as max_len, round(avg(length(text)), 6) as avg_len from documents group by source")
def length_stats(spark, sf_dir):
    return chunking.length_stats(corpus(spark, sf_dir), "source")


@query(r"""
with m as (select doc_id, text, regexp_matches(text, '(?m)^(The|De|Le|La|Der|Die) ') as hit,
  [regexp_replace(p, '^\s+|\s+$', '', 'g') for p in string_split(regexp_replace(text, '(?m)^(The|De|Le|La|Der|Die) ', chr(1) || '\1 ', 'g'), chr(1))] as parts from documents),
p as (select doc_id, case when hit then [x for x in parts if x <> ''] when regexp_matches(text, '^\s*$') then []::varchar[] else [text] end as parts from m)
select doc_id, unnest(generate_series(0, len(parts) - 1)) as part_no, unnest(parts) as part from p
""")
def regex_section_split(spark, sf_dir):
    parts = X.split_at(F.col("text"), "(?m)^(The|De|Le|La|Der|Die) ")
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(parts).alias("part_no", "part"))


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_FLUSH = f"case when {_STRIP.format('a.cur')} <> '' then list_append(a.out, {_STRIP.format('a.cur')}) else a.out end"


def _fold(parts: str, joint: str, oversize: str) -> str:
    """SQL of the greedy packing of a list of struct(cur, out)."""
    gap = len(joint)
    glue = f"case when a.cur = '' then x.cur else a.cur || chr(10) || x.cur end" if joint else "a.cur || x.cur"
    return f"""list_reduce({parts}, lambda a, x: case
      when length(a.cur) + length(x.cur) + {gap} <= 512 then {{'cur': {glue}, 'out': a.out}}
      when length(x.cur) <= 512 then {{'cur': x.cur, 'out': {_FLUSH}}}
      else {{'cur': '', 'out': list_concat({_FLUSH}, {oversize})}} end, {{'cur': '', 'out': []::varchar[]}})"""


_HARD = f"[p for p in [{_STRIP.format('substring(x.cur, (i * 512 + 1)::int, 512)')} for i in generate_series(0, (length(x.cur) - 1) // 512)] if p <> '']"
_SENTENCES = "[{'cur': s, 'out': []::varchar[]} for s in string_split(regexp_replace(%s, '([.;])', '\\1' || chr(1), 'g'), chr(1))]"
_DONE = f"case when {_STRIP.format('r.cur')} <> '' then list_append(r.out, {_STRIP.format('r.cur')}) else r.out end"
_WHOLE = "case when regexp_matches(text, '^\\s*$') then []::varchar[] else [{}] end"

_PACK_SQL = f"""
with f as (select doc_id, text, {_fold(_SENTENCES % 'text', '', _HARD)} as r from documents),
p as (select doc_id, case when length(text) <= 512 then {_WHOLE.format('text')} else {_DONE} end as parts from f)
select doc_id, unnest(generate_series(0, len(parts) - 1)) as chunk_no, unnest(parts) as chunk from p
"""


@query(_PACK_SQL)
def sentence_pack(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.posexplode(X.split_by_sentences(F.col("text"), 512, ".;")).alias("chunk_no", "chunk"))


_MERGE_SQL = f"""
with l as (select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from documents),
g as (select doc_id, text, k, {_STRIP.format('line')} as line from l),
s as (select doc_id, text, k, line, case when length(line) > 512 then {_fold(_SENTENCES % 'line', '', _HARD)} end as r from g where line <> ''),
d as (select doc_id, text, list({{'cur': line, 'out': case when r is null then []::varchar[] else {_DONE} end}} order by k) as parts from s group by doc_id, text),
f as (select doc_id, text, {_fold('parts', 'n', 'x.out')} as r from d),
p as (select doc_id, case when length(text) <= 512 then {_WHOLE.format(_STRIP.format('text'))} else {_DONE} end as parts from f)
select doc_id, unnest(generate_series(0, len(parts) - 1)) as chunk_no, unnest(parts) as chunk from p
"""


@query(_MERGE_SQL)
def paragraph_merge(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.posexplode(X.merge_paragraphs(F.col("text"), 512, ".;", "\n")).alias("chunk_no", "chunk"))


@query("""
with c as (select case lang when 'en' then 0 else 1 end as source_ord, lang, doc_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) as k from documents)
select text, case source_ord when 0 then 'english' else 'other' end as source, lang as title, row_number() over (order by source_ord, doc_id, k) - 1 as chunk_id from c
""")
def chunk_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lines = docs.select(F.col("doc_id").alias("doc_ord"), F.col("lang").alias("title"), F.posexplode(F.split("text", "\n")).alias("chunk_no", "text"))
    other = lines.filter("title <> 'en' or title is null").withColumns({"source": F.lit("other"), "section": F.lit(None).cast("string")})
    english = lines.filter("title = 'en'").withColumns({"source": F.lit("english"), "section": F.lit(None).cast("string")})
    return chunking.number_chunks([english, other]).select("text", "source", "title", "chunk_id")


@query(r"""
with t as (select doc_id, [w for w in string_split_regex(lower(text), '[^\p{L}\p{N}]+') if length(w) > 1] as w from documents)
select doc_id, len(w) as n_tokens, len(list_distinct(w)) as n_distinct, array_to_string(w, ' ') as tokens from t
""")
def tokenize(spark, sf_dir):
    w = X.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(w).alias("n_tokens"), F.size(F.array_distinct(w)).alias("n_distinct"), F.array_join(w, " ").alias("tokens"))


# ---------------------------------------------------------------- sparse search

_TOK = r"""
tok as materialized (select doc_id as chunk_id, [w for w in string_split_regex(lower(text), '[^\p{L}\p{N}]+') if length(w) > 1] as w from documents),
post as materialized (select term, chunk_id, count(*) as tf, any_value(dl) as dl from (select chunk_id, len(w) as dl, unnest(w) as term from tok) group by term, chunk_id),
stats as materialized (select count(*) as n, avg(len(w)) as avgdl from tok),
dfs as materialized (select term, count(*) as df from post group by term),
raw as materialized (select term, df, ln(n - df + 0.5::double) - ln(df + 0.5::double) as raw from dfs, stats),
mean as materialized (select avg(raw) as mean from raw),
idf as materialized (select term, df, case when raw < 0 then 0.25::double * mean else raw end as idf from raw, mean)
"""
_LETTERS = ", ".join(f"length(text) - length(replace(text, '{x}', ''))" for x in X.LETTERS)
_UNIT = "case when n > 0 then [x / n for x in v] else v end"
_BM25 = (
    _TOK
    + rf""",
q as (select item_id as query_id, unnest([w for w in string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+') if length(w) > 1]) as term from benchmark),
qf as materialized (select query_id, term, count(*) as qf from q group by query_id, term),
scored as (select query_id, chunk_id, round(sum(qf * idf * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / avgdl))), 6) as score
  from qf join idf using (term) join post using (term), stats group by query_id, chunk_id),
bm as materialized (select query_id, chunk_id, row_number() over (partition by query_id order by score desc, chunk_id) as rank, score from scored where score > 0),
dv as materialized (select chunk_id, {_UNIT} as v from (select chunk_id, v, sqrt(list_inner_product(v, v)) as n from (select doc_id as chunk_id, [{_LETTERS}]::double[] as v from documents))),
qv as materialized (select query_id, {_UNIT} as q from (select query_id, v, sqrt(list_inner_product(v, v)) as n from (select item_id as query_id, [{_LETTERS}]::double[] as v from benchmark))),
near as (select query_id, chunk_id, round(list_inner_product(q, v), 6) as score from qv, dv),
de as materialized (select query_id, chunk_id, row_number() over (partition by query_id order by score desc, chunk_id) as rank, score from near)
"""
)


def _index(spark, sf_dir) -> sparse.SparseIndex:
    return sparse.build(corpus(spark, sf_dir))


def _bm25(spark, sf_dir, k) -> DataFrame:
    return sparse.search(_index(spark, sf_dir), asked(spark, sf_dir), k)


def _letter_vectors(spark, sf_dir) -> DataFrame:
    return cut(corpus(spark, sf_dir).select("chunk_id", dense.letter_encoder(F.col("text")).alias("embedding")))


def _letters(spark, sf_dir, k) -> DataFrame:
    """A dense leg that SQL can follow: texts by how often they have some letters."""
    queries = asked(spark, sf_dir).select("query_id", dense.letter_encoder(F.col("query")).alias("embedding"))
    return dense.search(_letter_vectors(spark, sf_dir), cut(queries), k)


def _legs_of(spark, sf_dir, k: int = 20) -> tuple[DataFrame, DataFrame]:
    return _letters(spark, sf_dir, k), _bm25(spark, sf_dir, k)


@query(f"with {_TOK} select term, chunk_id, tf, dl from post")
def postings(spark, sf_dir):
    return sparse.postings(sparse.token_lists(corpus(spark, sf_dir)))


@query(f"with {_TOK} select term, df, round(idf, 6) as idf from idf")
def idf_floor(spark, sf_dir):
    lists = cut(sparse.token_lists(corpus(spark, sf_dir)))
    return sparse.idf(lists, sparse.corpus_stats(lists)).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"with {_BM25} select query_id, chunk_id, rank, score from bm where rank <= 10")
def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir, 10)


# ---------------------------------------------------------------- dense search

_DENSE = """
qv as (select vec_id as query_id, embedding as q, label from embeddings where vec_id % 20 = 0),
sc as (select query_id, vec_id as chunk_id, round(list_inner_product(q::double[], embedding::double[]), 6) as score from qv, embeddings),
de as (select query_id, chunk_id, row_number() over (partition by query_id order by score desc, chunk_id) as rank, score from sc),
sc2 as (select query_id, vec_id as chunk_id, round(list_inner_product([sign(x)::double for x in q], embedding::double[]), 6) as score from qv, embeddings),
d2 as (select query_id, chunk_id, row_number() over (partition by query_id order by score desc, chunk_id) as rank, score from sc2),
rel as (select query_id, vec_id as chunk_id from qv join embeddings e using (label))
"""


def _vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def _asked_vectors(spark, sf_dir) -> DataFrame:
    return _vectors(spark, sf_dir).filter("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")


def _dense(spark, sf_dir, k: int, signs: bool = False) -> DataFrame:
    """Whole vectors; ``signs`` makes another leg of them, in which a query is the signs of its numbers."""
    queries = _asked_vectors(spark, sf_dir)
    queries = queries.withColumn("embedding", F.transform("embedding", lambda x: F.signum(x.cast("double")))) if signs else queries
    return dense.search(_vectors(spark, sf_dir), queries, k)


def _measure(spark, sf_dir) -> Callable[[DataFrame], DataFrame]:
    """Hits -> hit, recall and reciprocal rank of each query, where a hit of the query's label is relevant."""
    queries, vectors = _asked_vectors(spark, sf_dir), _vectors(spark, sf_dir)
    return lambda hits: evaluation.measured(evaluation.judged_by_label(hits, queries, vectors), evaluation.sizes_by_label(queries, vectors), queries)


@query(f"with {_DENSE} select query_id, chunk_id, rank, score from de where rank <= 10")
def dense_topk(spark, sf_dir):
    return _dense(spark, sf_dir, 10)


@query("""
with e as (select vec_id, embedding::double[] as v from embeddings), n as (select vec_id, v, sqrt(list_inner_product(v, v)) as norm from e)
select vec_id, round(norm, 6) as norm, unnest(generate_series(0, 63)) as place, round(unnest(v) / norm, 6) as value from n
""")
def l2_normalize(spark, sf_dir):
    unit = dense.l2_normalise(F.col("embedding"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.round(dense.norm(F.col("embedding")), 6).alias("norm"), F.posexplode(unit).alias("place", "value"))
    return rows.withColumn("value", F.round("value", 6))


@query("""
with d as (select vec_id, label, unnest(generate_series(0, 63)) as place, unnest(embedding)::double as x from embeddings),
c as (select label, place, avg(x) as m from d group by label, place),
s as (select vec_id, sum(x * m) as xm, sum(x * x) as xx, sum(m * m) as mm from d join c using (label, place) group by vec_id)
select vec_id, round(xm / (sqrt(xx) * sqrt(mm)), 6) as similarity from s
""")
def cosine_to_label(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    mean = v.select("label", F.posexplode("embedding").alias("place", "x")).groupBy("label", "place").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = mean.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "m"))), lambda p: p["m"]).alias("centre"))
    return v.join(centre, "label").select("vec_id", F.round(dense.cosine(F.col("embedding"), F.col("centre")), 6).alias("similarity"))


# ---------------------------------------------------------------- fusion

_UNION = """
un as (select query_id, chunk_id, rank as o, score, 'dense' as retriever from a
  union all select b.query_id, b.chunk_id, b.rank + coalesce(n, 0), b.score, 'sparse' from b left join (select query_id, count(*) as n from a group by query_id) using (query_id)
  where not exists (select 1 from a where a.query_id = b.query_id and a.chunk_id = b.chunk_id))
"""


def _rrf(dw: float, sw: float) -> str:
    return f"""
legs as (select query_id, chunk_id, max(d) as d, max(s) as s from (select query_id, chunk_id, rank as d, null as s from a union all select query_id, chunk_id, null, rank from b) group by query_id, chunk_id),
fs as (select query_id, chunk_id, d, s, round(coalesce({dw}::double / (60 + d), 0) + coalesce({sw}::double / (60 + s), 0), 9) as score from legs),
fu as (select query_id, chunk_id, row_number() over (partition by query_id order by score desc, d nulls last, s nulls last) as rank, score from fs)
"""


_LEGS = _BM25 + ", a as (select * from de where rank <= 20), b as (select * from bm where rank <= 20)"


@query(f"with {_LEGS}, {_UNION} select query_id, chunk_id, row_number() over (partition by query_id order by o) as rank, score, retriever from un qualify rank <= 20")
def union_merge(spark, sf_dir):
    return fusion.union_merge(*_legs_of(spark, sf_dir), 20)


@query(f"with {_LEGS}, {_rrf(0.5, 0.5)} select query_id, chunk_id, rank, score, 'fusion' as retriever from fu where rank <= 20")
def rrf_fusion(spark, sf_dir):
    return fusion.weighted_fusion(*_legs_of(spark, sf_dir), 20)


@query(f"with {_LEGS}, {_rrf(0.3, 0.7)} select query_id, chunk_id, rank, score, 'fusion' as retriever from fu where rank <= 20")
def rrf_weighted(spark, sf_dir):
    return fusion.weighted_fusion(*_legs_of(spark, sf_dir), 20, dense_weight=0.3, sparse_weight=0.7)


_RERANK = (
    _LEGS
    + f", {_rrf(0.5, 0.5)}"
    + """,
qd as (select query_id, count(*) as n from qf group by query_id),
hitn as (select query_id, chunk_id, count(*) as m from fu join qf using (query_id) join post using (chunk_id, term) where rank <= 20 group by query_id, chunk_id),
rs as (select fu.query_id, fu.chunk_id, fu.rank as prior_rank, fu.score, round(coalesce(m, 0)::double / n, 6) as rerank_score
  from fu join qd using (query_id) left join hitn using (query_id, chunk_id) where fu.rank <= 20),
rr as (select *, row_number() over (partition by query_id order by rerank_score desc, prior_rank) as rank from rs)
"""
)


def _reranked(spark, sf_dir, k: int) -> DataFrame:
    fused = fusion.weighted_fusion(*_legs_of(spark, sf_dir), 20)
    return fusion.rerank(asked(spark, sf_dir), fused, corpus(spark, sf_dir), providers.overlap_score, k)


@query(f"with {_RERANK} select query_id, chunk_id, rank, score, rerank_score, prior_rank from rr where rank <= 10")
def rerank_topk(spark, sf_dir):
    return _reranked(spark, sf_dir, 10)


@query(f"""
with {_RERANK},
p as (select query_id, rank, '【法条 ' || rank || '】(相关度: ' || printf('%.4f', rerank_score) || ')' || chr(10) || '来源: ' || source || chr(10) || '内容: ' || text || chr(10) as p
  from rr join documents on doc_id = chunk_id where rank <= 3)
select query_id, '检索到 ' || count(*) || ' 条相关法律规定：' || chr(10) || chr(10) || string_agg(p, chr(10) order by rank) as reply from p group by query_id
""")
def multi_search(spark, sf_dir):
    """All queries answered and formatted in one plan."""
    hits = _reranked(spark, sf_dir, 3).join(corpus(spark, sf_dir), "chunk_id").withColumn("section", F.lit(None).cast("string"))
    return PR.format_hits(hits, asked(spark, sf_dir))


@query(f"""
with {_BM25}, c as (select query_id, string_agg('[参考文档' || rank || '] ' || text, chr(10) || chr(10) order by rank) as x from bm join documents on doc_id = chunk_id where rank <= 3 group by query_id)
select item_id as query_id, case when x is null then '请回答以下问题。' || chr(10) || chr(10) || '问题: ' || text || chr(10) || chr(10) || '回答:'
  else '请根据以下参考文档回答问题。' || chr(10) || chr(10) || '参考文档:' || chr(10) || x || chr(10) || chr(10) || '问题: ' || text || chr(10) || chr(10) || '回答:' end as prompt
from benchmark left join c on item_id = query_id
""")
def prompt_build(spark, sf_dir):
    hits = _bm25(spark, sf_dir, 3).join(corpus(spark, sf_dir), "chunk_id")
    listed = hits.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("contexts"))
    both = asked(spark, sf_dir).join(listed, "query_id", "left")
    return both.select("query_id", PR.build_prompt(F.col("query"), F.col("contexts")).alias("prompt"))


def hybrid_engine(spark: SparkSession, sf_dir: str, index: sparse.SparseIndex | None = None) -> Engine:
    """Both legs over the documents, with the stand-in encoder and scorer."""
    docs = corpus(spark, sf_dir).withColumn("section", F.lit(None).cast("string"))
    return Engine(docs, _letter_vectors(spark, sf_dir), index or sparse.build(docs), dense.letter_encoder)


@query(f"""
with {_RERANK} select query_id, rank, chunk_id, text, source, null::varchar as section, rerank_score as score from rr join documents on doc_id = chunk_id where rank <= 5
""")
def engine_search(spark, sf_dir):
    """Dense and sparse legs, fusion and reranking behind one call."""
    return hybrid_engine(spark, sf_dir).search(asked(spark, sf_dir), 5)


# ---------------------------------------------------------------- evaluation

_METRICS = """
per as (select qv.query_id, {cols}, coalesce(1.0::double / min(case when rel.chunk_id is not null then h.rank end), 0) as rr
  from qv join (select query_id, count(*) as n from rel group by query_id) z using (query_id)
  left join {hits} h on h.query_id = qv.query_id and h.rank <= 20 left join rel on rel.query_id = h.query_id and rel.chunk_id = h.chunk_id group by qv.query_id, n)
"""
_KS = (1, 5, 10, 20)
_COLS = ", ".join(f"(coalesce(sum(case when rel.chunk_id is not null and h.rank <= {k} then 1 end), 0) > 0)::int::double as hit_{k}, coalesce(sum(case when rel.chunk_id is not null and h.rank <= {k} then 1 end), 0)::double / n as recall_{k}" for k in _KS)
_MEANS = ", ".join(f"round(avg(hit_{k}), 6) as hit_{k}, round(avg(recall_{k}), 6) as recall_{k}" for k in _KS)


def _per(hits: str, name: str = "per") -> str:
    return _METRICS.replace("per as", f"{name} as").format(cols=_COLS, hits=hits)


def _measured(spark, sf_dir) -> DataFrame:
    return _measure(spark, sf_dir)(_dense(spark, sf_dir, 20))


@query(f"with {_DENSE}, {_per('de')} select query_id, " + ", ".join(f"hit_{k}" for k in _KS) + " from per")
def hit_at_k(spark, sf_dir):
    return _measured(spark, sf_dir).select("query_id", *[f"hit_{k}" for k in _KS])


@query(f"with {_DENSE}, {_per('de')} select query_id, " + ", ".join(f"round(recall_{k}, 6) as recall_{k}" for k in _KS) + " from per")
def recall_at_k(spark, sf_dir):
    return _measured(spark, sf_dir).select("query_id", *[F.round(f"recall_{k}", 6).alias(f"recall_{k}") for k in _KS])


@query(f"with {_DENSE}, {_per('de')} select round(avg(rr), 6) as mrr, count(*) as n_queries from per")
def mrr(spark, sf_dir):
    return _measured(spark, sf_dir).agg(F.round(F.avg("rr"), 6).alias("mrr"), F.count("*").alias("n_queries"))


@query(f"""
with {_DENSE}, a as (select * from de where rank <= 20), b as (select * from d2 where rank <= 20), {_UNION}, uu as (select query_id, chunk_id, row_number() over (partition by query_id order by o) as rank from un),
{_rrf(0.5, 0.5)}, {_per('de', 'p1')}, {_per('d2', 'p2')}, {_per('uu', 'p3')}, {_per('fu', 'p4')}
select 'Full' as method, {_MEANS}, round(avg(rr), 6) as mrr, count(*) as n_queries from p1 union all select 'Signs', {_MEANS}, round(avg(rr), 6), count(*) from p2
union all select 'Union', {_MEANS}, round(avg(rr), 6), count(*) from p3 union all select 'RRF', {_MEANS}, round(avg(rr), 6), count(*) from p4
""")
def method_comparison(spark, sf_dir):
    full, signs = cut(_dense(spark, sf_dir, 20)), cut(_dense(spark, sf_dir, 20, signs=True))  # each serves three methods
    methods = {"Full": full, "Signs": signs, "Union": fusion.union_merge(full, signs, 20), "RRF": fusion.weighted_fusion(full, signs, 20)}
    return evaluation.compare(methods, _measure(spark, sf_dir))


@query(f"""
with {_DENSE}, v as (select de.query_id, rank as k, (rel.chunk_id is not null)::int as v from de left join rel using (query_id, chunk_id) where rank <= 10),
p as (select query_id, v, sum(v) over (partition by query_id order by k)::double / k as p from v)
select query_id, round(coalesce(sum(p * v) / nullif(sum(v), 0), 0), 6) as context_precision, round(avg(v::double), 6) as supported from p group by query_id
""")
def context_precision(spark, sf_dir):
    hits = evaluation.judged_by_label(_dense(spark, sf_dir, 10), _asked_vectors(spark, sf_dir), _vectors(spark, sf_dir))
    v = cut(hits.select("query_id", F.col("rank").alias("k"), F.col("rel").alias("verdict")))
    cp = evaluation.context_precision(v).select("query_id", F.round("value", 6).alias("context_precision"))
    return cp.join(evaluation.supported_ratio(v).select("query_id", F.round("value", 6).alias("supported")), "query_id")


@query("""
with t as (select left(regexp_replace(string_split(text, chr(10))[1], '^\\s+|\\s+$', '', 'g'), 50) as query, doc_id from documents where source = 'src0'),
g as (select query, list_sort(list(doc_id)) as r from t where length(query) >= 10 group by query)
select query, array_to_string(r, ',') as relevant from g order by md5(query || ':42'), query limit 200
""")
def testset_build(spark, sf_dir):
    """A sample of 200 titles: the sampling is the feature."""
    titled = corpus(spark, sf_dir).withColumn("title", F.left(X.first_line(F.col("text")), F.lit(50)))
    return evaluation.build_test_set(titled, "src0").select("query", F.array_join(F.col("relevant_ids").cast("array<string>"), ",").alias("relevant"))


# ---------------------------------------------------------------- classification and judging

_PRED = """
pairs as (select labels.doc_id as id, case quality when 1 then 'good' else 'bad' end as label,
  case when length(text) < 200 then 'short' when regexp_matches(text, '[%#$&*|]') then 'bad' else 'good' end as pred from labels join documents using (doc_id))
"""


def _pairs(spark, sf_dir) -> DataFrame:
    gold = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("label"))
    rule = F.when(F.length("text") < 200, "short").when(F.col("text").rlike("[%#$&*|]"), "bad").otherwise("good")
    return classification.align(gold, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), rule.alias("pred")))


_LABELS = ["good", "bad"]


@query(f"with {_PRED} select count(*) as n, sum((label = pred)::int)::bigint as correct, round(avg((label = pred)::int), 6) as accuracy from pairs")
def accuracy(spark, sf_dir):
    return classification.accuracy(_pairs(spark, sf_dir))


@query("select (select count(*) from documents) as total_gt, count(*) as aligned, (select count(*) from documents) - count(*) as missing from labels")
def label_coverage(spark, sf_dir):
    ids = lambda t: table(spark, sf_dir, t).select(F.col("doc_id").alias("id"))
    return classification.coverage(ids("documents"), ids("labels"))


@query(f"""
with {_PRED}, l as (select unnest(['good', 'bad']) as label)
select label, coalesce(sum((pred = 'good')::int), 0)::bigint as good, coalesce(sum((pred = 'bad')::int), 0)::bigint as bad from l left join (select * from pairs where pred in ('good', 'bad')) using (label) group by label
""")
def confusion_matrix(spark, sf_dir):
    return classification.confusion(_pairs(spark, sf_dir), _LABELS)


@query(f"""
with {_PRED}, l as (select unnest(['good', 'bad']) as c), i as (select * from pairs where pred in ('good', 'bad'))
select c as label, sum((label = c and pred = c)::int)::bigint as tp, sum((label <> c and pred = c)::int)::bigint as fp, sum((label = c and pred <> c)::int)::bigint as fn, sum((label <> c and pred <> c)::int)::bigint as tn
from i, l group by c
""")
def one_vs_rest(spark, sf_dir):
    return classification.one_vs_rest(_pairs(spark, sf_dir), _LABELS)


_PRF = (
    _PRED
    + """,
g as (select label, count(*) as support, sum((label = pred)::int) as tp from pairs group by label), n as (select pred as label, count(*) as predicted from pairs group by pred),
j as (select coalesce(g.label, n.label) as label, coalesce(support, 0) as support, coalesce(tp, 0) as tp, coalesce(predicted, 0) as predicted from g full join n on g.label = n.label),
pr as (select label, coalesce(tp::double / nullif(predicted, 0), 0) as p, coalesce(tp::double / nullif(support, 0), 0) as r, support from j),
prf as (select label, p as precision, r as recall, support, coalesce(2 * p * r / nullif(p + r, 0), 0) as f1 from pr)
"""
)


@query(f"with {_PRF} select label, round(precision, 6) as precision, round(recall, 6) as recall, support, round(f1, 6) as f1 from prf")
def class_prf(spark, sf_dir):
    return classification.class_report(_pairs(spark, sf_dir)).select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall")], "support", F.round("f1", 6).alias("f1"))


@query(f"with {_PRF} select " + ", ".join(f"round(avg({c}), 6) as macro_{c}, round(sum({c} * support) / sum(support), 6) as weighted_{c}" for c in ("precision", "recall", "f1")) + " from prf")
def macro_weighted_f1(spark, sf_dir):
    return classification.averages(_pairs(spark, sf_dir))


@query(f"""
with {_PRED}, m as (select 'rule' as model, label, pred from pairs union all select 'constant', label, 'good' from pairs),
g as (select model, label, count(*) as support, sum((label = pred)::int) as tp from m group by model, label), n as (select model, pred as label, count(*) as predicted from m group by model, pred),
j as (select coalesce(g.model, n.model) as model, coalesce(g.label, n.label) as label, coalesce(support, 0) as support, coalesce(tp, 0) as tp, coalesce(predicted, 0) as predicted from g full join n on g.model = n.model and g.label = n.label),
f as (select *, coalesce(2.0::double * tp / nullif(support + predicted, 0), 0) as f1 from j),
a as (select model, round(avg((label = pred)::int), 6) as accuracy from m group by model)
select model, any_value(accuracy) as accuracy, round(avg(f1), 6) as macro_f1, round(sum(f1 * support) / sum(support), 6) as weighted_f1,
  round(max(case when label = 'bad' then coalesce(tp::double / nullif(support, 0), 0) end), 6) as focus_recall from f join a using (model) group by model
""")
def model_comparison(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    both = pairs.select(F.lit("rule").alias("model"), "label", "pred").union(pairs.select(F.lit("constant"), "label", F.lit("good")))
    return classification.compare_models(both, "bad")


@query("select user_id as id, arg_max(event_type, event_id) as pred from events group by user_id")
def last_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("pred"), "event_id")
    return classification.last_by_id(e, "pred", "event_id")


_JUDGED = """
jd as (select doc_id, source, text as answer, replace(replace(text, 'ber', '不一致'), 'er', '一致') as judgement, replace(replace(text, 'in', '正确'), 'ou', '错误') as checked,
  replace(text, 'an', '正确') as other from documents)
"""


def _judged(spark, sf_dir) -> DataFrame:
    """Documents as judges' replies: some of their syllables become the words that verdicts are read from."""
    swap = lambda c, old, new: F.replace(c, F.lit(old), F.lit(new))
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", "source", t.alias("answer"), swap(swap(t, "ber", "不一致"), "er", "一致").alias("judgement"), swap(swap(t, "in", "正确"), "ou", "错误").alias("checked"), swap(t, "an", "正确").alias("other"),
    )


@query(f"""
with {_JUDGED}, v as (select source, case when trim(answer) in ('', 'TIMEOUT', 'FAIL') then null when contains(judgement, '不一致') then 0 when contains(judgement, '一致') then 1 end as v from jd)
select source, coalesce(sum(v), 0)::bigint as correct, count(v) as total, coalesce(round(sum(v)::double / nullif(count(v), 0), 4), 0) as precision from v group by source
""")
def judge_precision(spark, sf_dir):
    return judging.precision(_judged(spark, sf_dir), "source")


@query(f"""
with {_JUDGED}, v as (select source, case when checked not in ('', 'ERROR') then (contains(checked, '正确') and not contains(checked, '错误'))::int end as v from jd)
select source, coalesce(sum(v), 0)::bigint as correct, count(v) as total, coalesce(round(sum(v)::double / nullif(count(v), 0), 4), 0) as precision from v group by source
""")
def judge_strict_precision(spark, sf_dir):
    return judging.strict_precision(_judged(spark, sf_dir).select("source", F.col("checked").alias("judgement")), "source")


@query(rf"""
with s as (select source, case when starts_with({_STRIP.format('text')}, '10') then 10 when not regexp_matches(text, '[0-9]') then -1 else greatest(1, regexp_extract(text, '[0-9]')::int) end as s from documents)
select source, coalesce(round(avg(s) filter (s > 0), 4), 0) as avg_score, coalesce(round(avg(s) filter (s > 0) * 10, 2), 0) as precision_pct, count(*) filter (s > 0) as n from s group by source
""")
def score_1to10(spark, sf_dir):
    return judging.scoring(table(spark, sf_dir, "documents").select("source", F.col("text").alias("judgement")), "source")


@query(f"""
with {_JUDGED}, o as (select (contains(checked, '正确') and not contains(checked, '错误'))::int as x, (contains(other, '正确') and not contains(other, '错误'))::int as y from jd)
select count(*) filter (x <> y) as different, count(*) filter (x > y) as a_wins, count(*) filter (x < y) as b_wins from o
""")
def pairwise_winloss(spark, sf_dir):
    rows = _judged(spark, sf_dir)
    return judging.pairwise(rows.select(F.col("doc_id").alias("idx"), F.col("checked").alias("judgement")), rows.select(F.col("doc_id").alias("idx"), F.col("other").alias("judgement")))


@query("""
with l as (select text as question, max(doc_id) as answer from documents group by text)
select conv_id, turn, coalesce(answer::varchar, '') as reference from conversations left join l on text = question
""")
def reference_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("text").alias("question"), F.col("doc_id").cast("string").alias("answer"), F.col("doc_id").alias("line_no"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("question"))
    return judging.with_reference(turns, docs).select("conv_id", "turn", "reference")


@query("""
with r as (select role <> 'system' as success, text, length(text) % 3 - 1 as verdict from conversations),
v as (select case when success and trim(text) not in ('', 'TIMEOUT', 'FAIL') then verdict end as v from r)
select count(*) filter (v = 1) as correct, count(*) filter (v = 0) as wrong, count(*) - count(*) filter (v in (0, 1)) as skipped, round(count(*) filter (v = 1)::double / count(*) filter (v in (0, 1)), 6) as accuracy from v
""")
def rewrite_verdicts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return judging.rewrite_verdicts(c.select((F.col("role") != "system").alias("success"), "text", (F.length("text") % 3 - 1).alias("verdict")))


# ---------------------------------------------------------------- parsing and guards

_OUT = """
o as (select doc_id, case length(text) % 8 when 0 then json_object('类型', '法律类', '理由', text)::varchar when 1 then text || '违规类' || text when 2 then text || ' {"label":"1"} ' || text
  when 3 then json_object('pred', 'c', '理由', text)::varchar when 4 then text || '闲聊类，不是法律类' else text end as out from documents)
"""


def _outputs(spark, sf_dir) -> DataFrame:
    """Documents as model output: whole texts around or inside an answer, or by themselves."""
    n, t = F.length("text") % 8, F.col("text")
    out = (
        F.when(n == 0, F.to_json(F.struct(F.lit("法律类").alias("类型"), t.alias("理由")))).when(n == 1, F.concat(t, F.lit("违规类"), t)).when(n == 2, F.concat(t, F.lit(' {"label":"1"} '), t))
        .when(n == 3, F.to_json(F.struct(F.lit("c").alias("pred"), t.alias("理由")))).when(n == 4, F.concat(t, F.lit("闲聊类，不是法律类"))).otherwise(t)
    )
    return table(spark, sf_dir, "documents").select("doc_id", out.alias("out"))


@query(f"""
with {_OUT}, j as (select doc_id, out, case when json_valid(out) then json_extract_string(out, '$.类型') end as f from o)
select doc_id, case when f in ('法律类', '违规类', '闲聊类') then f when regexp_matches(out, '法律类|违规类|闲聊类') then regexp_extract(out, '法律类|违规类|闲聊类') else 'UNKNOWN' end as label from j
""")
def label_extract(spark, sf_dir):
    return _outputs(spark, sf_dir).select("doc_id", P.extract_label(F.col("out")).alias("label"))


def _named_sql(v: str) -> str:
    return f"case when {v} in ('0', 'A', 'a', 'L', 'l', '法律类') then '法律类' when {v} in ('1', 'B', 'b', 'R', 'r', '违规类') then '违规类' when {v} in ('2', 'C', 'c', '闲聊类') then '闲聊类' end"


def _lone_sql(text: str, marks: str) -> str:
    return rf"regexp_extract({text}, '(^|[^\p{{L}}\p{{N}}_])([{marks}])($|[^\p{{L}}\p{{N}}_])', 2)"


_STRICT = f"""
t as (select doc_id, translate(out, '“”：', '"":') as t from o), b as (select doc_id, t, regexp_extract(t, '(?s)\\{{.*\\}}') as b from t),
f as (select doc_id, t, case when json_valid(b) then b end as b from b),
k as (select doc_id, t, [json_extract_string(b, '$.label'), json_extract_string(b, '$.类型'), json_extract_string(b, '$.pred'), json_extract_string(b, '$.category')] as fields from f),
strict as (select doc_id, coalesce({", ".join(_named_sql(f"fields[{i}]") for i in (1, 2, 3, 4))}, nullif(regexp_extract(t, '法律类|违规类|闲聊类'), ''),
  {_named_sql(_lone_sql("upper(t)", "ABC"))}, {_named_sql(_lone_sql("upper(t)", "LRC"))}, {_named_sql(_lone_sql("t", "0-2"))}) as label from k)
"""


@query(f"with {_OUT}, {_STRICT} select doc_id, coalesce(label, '') as label from strict")
def label_extract_strict(spark, sf_dir):
    return _outputs(spark, sf_dir).select("doc_id", F.coalesce(P.extract_label_strict(F.col("out")), F.lit("")).alias("label"))


@query("select event_id, props as object from events")
def json_repair(spark, sf_dir):
    noisy = F.concat(F.lit("Sure: "), "props", F.lit(' } and "more" {'))
    return table(spark, sf_dir, "events").select("event_id", P.balanced_json(noisy).alias("object"))


_PAIRS = f"""
rw as (select u.conv_id, u.turn, {han_sql("u.text")} as old, case u.turn % 3 when 0 then {han_sql("a.text")} when 1 then replace({han_sql("u.text")}, '的', '国') || '？' else {han_sql("u.text")} || '3-4' end as new
  from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 where u.role = 'user' and a.role = 'assistant')
"""
_SUBJECTS = " ".join(f"when not contains(old, '{x}') and contains(new, '{x}') then 'SUBJECT_CHANGED({x})'" for x in P.SUBJECTS)
_LEAKS = " ".join(f"when contains(new, '{x}') and not contains(old, '{x}') then 'PROMPT_LEAK({x})'" for x in P.LEAKS)
_ADDED = "list_reduce([c for c in string_split(old, '') if c <> ''], lambda a, c: case when contains(a, c) then left(a, instr(a, c) - 1) || substring(a, instr(a, c) + 1) else a end, new)"
_FIRST_RULES = "when coalesce(new, '') = '' then 'EMPTY_RQ' when not regexp_matches(new, '[\\x{4e00}-\\x{9fff}]') then 'NO_CHINESE' when regexp_matches(new, '[A-Za-z]{3,}') then 'ENGLISH_MIXED' when regexp_matches(new, '_|[A-Za-z0-9]+-[A-Za-z0-9]+') then 'SLUG_OR_UNDERSCORE'"
_GUARD = f"""case {_FIRST_RULES} when old <> '' and length(new) > length(old) * 1.5::double then 'TOO_LONG' {_SUBJECTS} when regexp_matches({_ADDED}, '{P.NAMES}') then 'FABRICATED_NAME'
  when not regexp_matches(regexp_replace(new, '\\s+$', ''), '[？?]$') then 'NO_QUESTION_MARK' {_LEAKS} end"""
_GUARD_SMALL = f"""case {_FIRST_RULES} when old <> '' and length(new) > length(old) * 3 then 'TOO_LONG' when length(old) > 10 and length(new) < length(old) * 0.3::double then 'TOO_SHORT' {_SUBJECTS}
  when regexp_matches(new, '[{P.TRADITIONAL}]') then 'TRADITIONAL_CHINESE' when not regexp_matches(new, '[？?]') then 'NO_QUESTION_MARK' end"""


def _rewrites(spark, sf_dir) -> DataFrame:
    """Whole questions in Han characters, and what a model might make of them."""
    qa, t = _qa(spark, sf_dir), F.col("turn") % 3
    old = han(F.col("question"))
    new = F.when(t == 0, han(F.col("reply"))).when(t == 1, F.concat(F.replace(old, F.lit("的"), F.lit("国")), F.lit("？"))).otherwise(F.concat(old, F.lit("3-4")))
    return qa.select("conv_id", "turn", old.alias("old"), new.alias("new"))


@query(f"with {_PAIRS} select conv_id, turn, {_GUARD_SMALL} as problem from rw")
def rewrite_guard(spark, sf_dir):
    return _rewrites(spark, sf_dir).select("conv_id", "turn", P.rewrite_problem_small(F.col("new"), F.col("old")).alias("problem"))


@query(f"with {_PAIRS} select conv_id, turn, {_GUARD} as problem from rw")
def rewrite_guard_strict(spark, sf_dir):
    return _rewrites(spark, sf_dir).select("conv_id", "turn", P.rewrite_problem(F.col("new"), F.col("old")).alias("problem"))


@query(rf"""
with k as (select doc_id, regexp_replace(regexp_replace(case when doc_id % 2 = 0 then {han_sql('text')} else text end, '["''“”‘’]', '', 'g'), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') as k from documents)
select doc_id, coalesce([x for x in string_split_regex(k, '[,，、\s\p{{Z}}\x{{85}}\x0b]+') if regexp_matches(x, '[\x{{4e00}}-\x{{9fff}}]')][1], k) as keyword from k
""")
def keyword_clean(spark, sf_dir):
    kw = F.when(F.col("doc_id") % 2 == 0, han(F.col("text"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", X.clean_keyword(kw).alias("keyword"))


# ---------------------------------------------------------------- prompts and curation

_QA = """
qa as (select u.conv_id, u.turn, u.text as question, a.text as reply from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 where u.role = 'user' and a.role = 'assistant')
"""


def _qa(spark, sf_dir) -> DataFrame:
    return curation.question_answer_pairs(table(spark, sf_dir, "conversations"))


@query(f"""
with {_QA}, n as (select *, row_number() over (order by conv_id, turn) - 1 as pos from qa),
b as (select pos // 5 as batch, pos % 5 as i, '[' || (pos % 5) || '] 问题: ' || question || chr(10) || '回答: ' || reply as x from n)
select batch, count(*)::int as n, string_agg(x, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by i) as body from b group by batch
""")
def batch_prompts(spark, sf_dir):
    rows = running.number_rows(_qa(spark, sf_dir), "conv_id", "turn")
    return PR.batch_prompts(rows.withColumnRenamed("n", "pos"), "pos")


@query("""
with t as (select conv_id, turn, role, text, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) as x from conversations)
select conv_id, case when arg_min(role, turn) = 'system' then '' else '<|im_start|>system' || chr(10) || 'You are a helpful assistant.<|im_end|>' || chr(10) end || string_agg(x, '' order by turn) as chat from t group by conv_id
""")
def chat_template(spark, sf_dir):
    return PR.conversation_text(table(spark, sf_dir, "conversations"))


@query("select min(doc_id) as doc_id, text from documents group by text")
def exact_dedup(spark, sf_dir):
    return curation.exact_repeats_removed(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"], "doc_id")


@query(rf"""
with {_QA}, d as (select distinct question, reply from qa where question is not null and reply is not null),
s as (select regexp_replace(question, '^\s+|\s+$', '', 'g') as question, regexp_replace(reply, '^\s+|\s+$', '', 'g') as reply from d) select question, reply from s where length(question) >= 4 and length(reply) >= 10
""")
def qa_preclean(spark, sf_dir):
    return curation.preclean(_qa(spark, sf_dir))


@query(f"""
with t as (select doc_id, {han_sql('source')} as instruction, {han_sql('text')} as output from documents)
select doc_id, regexp_matches(coalesce(instruction, '') || coalesce(output, ''), '法|条|规定|合同|责任|权利|义务|诉讼|赔偿|刑|民|侵权|犯罪|法院|法律') as legal,
  coalesce(regexp_matches(coalesce(instruction, '') || coalesce(output, ''), '法|条|规定|合同|责任|权利|义务|诉讼|赔偿|刑|民|侵权|犯罪|法院|法律') and length(output) < 500, false) as target from t
""")
def keyword_filter(spark, sf_dir):
    """Records with a legal keyword, and those of them that are to be expanded."""
    rows = table(spark, sf_dir, "documents").select("doc_id", han(F.col("source")).alias("instruction"), han(F.col("text")).alias("output"))
    targets = curation.expansion_targets(rows).select("doc_id", F.lit(True).alias("target"))
    return rows.select("doc_id", curation.is_legal(F.col("instruction"), F.col("output")).alias("legal")).join(targets, "doc_id", "left").withColumn("target", F.coalesce("target", F.lit(False)))


@query("select doc_id, score from (select doc_id, length(text) as score, rank() over (order by length(text) desc) as r from documents) where r <= 500")
def topn_with_ties(spark, sf_dir):
    return fusion.top_with_ties(table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("score")), "score", 500)


@query(f"""
with {_QA}, s as (select conv_id, turn, length(reply) % 10 + 1 as score from qa), k as (select *, rank() over (order by score desc) as r from s)
select score::double as score, count(*) filter (r <= 500) as kept, count(*) filter (r > 500) as removed from k group by score
""")
def quality_threshold(spark, sf_dir):
    rows = _qa(spark, sf_dir).select("question", "reply", (F.length("reply") % 10 + 1).cast("double").alias("score"), F.lit("").alias("reason"))
    edge = curation.keep_best(rows.select("score"), 500).groupBy("score").agg(F.count("*").alias("kept"))
    every = curation.score_distribution(rows).withColumnRenamed("n", "total")
    kept = F.coalesce("kept", F.lit(0))
    return every.join(edge, "score", "left").select("score", kept.alias("kept"), (F.col("total") - kept).alias("removed"))


@query(f"with {_QA} select question as instruction, '' as input, reply || ' indeed' as chosen, reply as rejected from qa where length(reply) >= 100")
def dpo_pairs(spark, sf_dir):
    sft, chosen = _sft(spark, sf_dir)
    return curation.preference_pairs(sft, chosen)


def _sft(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    idx = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    sft = _qa(spark, sf_dir).select(idx.alias("idx"), F.col("question").alias("instruction"), F.lit(None).cast("string").alias("input"), F.col("reply").alias("output"))
    return sft, sft.filter(F.length("output") >= 100).select("idx", F.concat("output", F.lit(" indeed")).alias("value"))


@query(f"with {_QA} select conv_id || ':' || turn as idx, question as instruction, case when length(reply) >= 100 then reply || ' indeed' else reply end as output from qa")
def sft_override(spark, sf_dir):
    sft, done = _sft(spark, sf_dir)
    return curation.override(sft, done).select("idx", "instruction", "output")


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def resume_antijoin(spark, sf_dir):
    return curation.remaining(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@query("""
with t as (select conv_id as idx, turn as attempt, text as output, 150 as original from conversations), g as (select *, length(output) >= greatest(original * 1.3::double, 200) as good from t)
select idx, coalesce(arg_min(output, attempt) filter (good), arg_max(output, attempt)) as output from g group by idx
""")
def accept_expansion(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("idx"), F.col("turn").alias("attempt"), F.col("text").alias("output"), F.repeat(F.lit("x"), F.lit(150)).alias("original"))
    return curation.accept_expansion(rows)


# ---------------------------------------------------------------- structural chunkers


def _as_statute(c: Column) -> Column:
    """A document's lines as numbered articles under chapters, so that the chunkers run on the given tables."""
    line = lambda x, i: F.concat(F.when(i % 6 == 0, F.concat(F.lit("第"), F.substring(F.lit("一二三四五六七八九十"), F.floor(i / 6).cast("int") % 10 + 1, F.lit(1)), F.lit("章 "), F.left(x, F.lit(8)), F.lit("\n"))).otherwise(""), F.lit("第"), (i + 1).cast("string"), F.lit("条 "), x)
    return F.array_join(F.transform(F.split(c, "\n"), line), "\n")


_AS_STATUTE = """
ln as (select doc_id, source, text, string_split(text, chr(10)) as l from documents),
st as (select doc_id, source, array_to_string([case when (i - 1) % 6 = 0 then '第' || substring('一二三四五六七八九十', ((i - 1) // 6 % 10 + 1)::int, 1) || '章 ' || left(l[i], 8) || chr(10) else '' end || '第' || i || '条 ' || l[i]
  for i in generate_series(1, len(l))], chr(10)) as body from ln)
"""
_NUM = "第[一二三四五六七八九十百千零\\d]+"


def _split_sql(text: str, mark: str) -> str:
    """SQL of the parts of ``text`` that begin at headings ``mark``."""
    pattern = f"(?m)^({_NUM}{mark}[\\s　])"
    parts = f"[{_STRIP.format('y')} for y in string_split(regexp_replace({text}, '{pattern}', chr(1) || '\\1', 'g'), chr(1)) if {_STRIP.format('y')} <> '']"
    return f"case when regexp_matches({text}, '{pattern}') then {parts} else [{text}] end"


_HEAD = f"case when regexp_matches(c, '^{_NUM}章[\\s　]') then {_STRIP.format('string_split(c, chr(10))[1]')} else '' end"
_PURE = f"(not contains(t, chr(10)) and regexp_matches(t, '^{_NUM}[编章节]\\s'))"


@query(f"""
with {_AS_STATUTE}, d as (select doc_id, {_STRIP.format("'法' || chr(10) || body")} as b from st),
cs as (select doc_id, {_split_sql('b', '章')} as cs from d), c as (select doc_id, unnest(cs) as c, generate_subscripts(cs, 1) as i from cs),
h as (select doc_id, i, c, {_HEAD} as h, {_split_sql('c', '条')} as ar from c), a as (select doc_id, i, h, unnest(ar) as a, generate_subscripts(ar, 1) as j from h),
p as (select doc_id, i, j, case when not regexp_matches(a, '^{_NUM}条[\\s　]') and h = '' then '序言' else h end as section,
  case when length(a) > 512 then [p for p in [{_STRIP.format('substring(a, (k * 512 + 1)::int, 512)')} for k in generate_series(0, (length(a) - 1) // 512)] if p <> ''] else [{_STRIP.format('a')}] end as ts from a),
t as (select doc_id, i, j, section, unnest(ts) as t, generate_subscripts(ts, 1) as k from p)
select doc_id as doc_ord, row_number() over (partition by doc_id order by i, j, k) - 1 as chunk_no, t as text, 'statute' as source, '法' as title, section from t where t <> '' and not {_PURE}
""")
def statute_split(spark, sf_dir):
    return chunking.statute_chunks(split_sources(spark, sf_dir)["statutes"])


def split_sources(spark, sf_dir) -> dict[str, DataFrame]:
    """doc_ord, text of the four kinds of sources, made of the given tables."""
    docs = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_ord"), "source", "text"))
    book = F.concat(F.lit("【"), "source", F.lit("】\n\n"), F.regexp_replace(_as_statute(F.col("text")), "\n", "\n\n"))
    qa = _qa(spark, sf_dir)
    reply = chunking.qa_text(F.substring_index("question", "\n", 1), F.col("question"), F.replace("reply", F.lit("."), F.lit("。")))
    return {
        "statutes": docs.select("doc_ord", F.concat(F.lit("法\n"), _as_statute(F.col("text"))).alias("text")), "textbooks": docs.select("doc_ord", book.alias("text")),
        "articles": docs.select("doc_ord", F.replace("text", F.lit("."), F.lit("。")).alias("text")), "forum": qa.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("doc_ord"), reply.alias("text")),
    }


_FOLD_BOOK = _fold("ps", "nn", _HARD).replace("chr(10)", "chr(10) || chr(10)")


@query(f"""
with {_AS_STATUTE}, d as (select doc_id, source, {_STRIP.format("'【' || source || '】' || chr(10) || chr(10) || replace(body, chr(10), chr(10) || chr(10))")} as b from st),
cs as (select doc_id, source, {_split_sql('b', '章')} as cs from d), c as (select doc_id, source, unnest(cs) as c, generate_subscripts(cs, 1) as i from cs),
h as (select doc_id, source, i, c, {_HEAD} as h, [{{'cur': {_STRIP.format('y')}, 'out': []::varchar[]}} for y in string_split(c, chr(10) || chr(10)) if {_STRIP.format('y')} <> ''] as ps from c),
f as (select doc_id, source, i, c, h, {_FOLD_BOOK} as r from h), p as (select doc_id, source, i, h, case when length(c) <= 512 then [c] else {_DONE} end as ts from f),
t as (select doc_id, source, i, h, unnest(ts) as t, generate_subscripts(ts, 1) as k from p)
select doc_id as doc_ord, row_number() over (partition by doc_id order by i, k) - 1 as chunk_no, t as text, 'textbook' as source, source as title, h as section from t
where t <> '' and not {_PURE} and not regexp_matches(t, '^【[^\n]+】$')
""")
def textbook_split(spark, sf_dir):
    return chunking.book_chunks(split_sources(spark, sf_dir)["textbooks"])


def _pieces_sql(rows: str, keep: str) -> str:
    """SQL of the sentence pieces (ends 。 and ；) of ``b`` in the rows of ``rows``, with the columns ``keep``."""
    listed = _SENTENCES.replace("[.;]", "[。；]") % "b"
    return f"""
pf as (select {keep}, b, {_fold(listed, '', _HARD)} as r from {rows}),
pp as (select {keep}, case when length(b) <= 512 then {_WHOLE.format('b').replace("text", "b")} else {_DONE} end as ts from pf),
pieces as (select {keep}, unnest(generate_series(0, len(ts) - 1)) as chunk_no, unnest(ts) as text from pp)
"""


@query(f"""
with b as (select doc_id, {_STRIP.format("replace(text, '.', '。')")} as b, {_STRIP.format("text")} as whole from documents), {_pieces_sql("b", "doc_id, whole")}
select doc_id as doc_ord, chunk_no, text, 'article' as source, replace(left({_STRIP.format('string_split(whole, chr(10))[1]')}, 50), '.', '。') as title, null::varchar as section from pieces
""")
def article_split(spark, sf_dir):
    return chunking.article_chunks(split_sources(spark, sf_dir)["articles"])


@query(f"""
with {_QA}, q as (select conv_id || ':' || turn as doc_ord, string_split(question, chr(10))[1] as title, question, replace(reply, '.', '。') as reply from qa),
b as (select doc_ord, left({_STRIP.format('title')}, 50) as title, string_split(reply, chr(10))[1] as answer, {_STRIP.format("'问：' || title || case when question <> '' then chr(10) || '补充：' || question else '' end || chr(10) || '答：' || reply")} as b from q),
k as (select * from b where length({_STRIP.format('answer')}) >= 10), {_pieces_sql("k", "doc_ord, title")}
select doc_ord, chunk_no, text, 'law_qa' as source, title, null::varchar as section from pieces
""")
def qa_split(spark, sf_dir):
    return chunking.qa_chunks(split_sources(spark, sf_dir)["forum"])
