"""Whole jobs, and reading and writing in every format, as registered queries beside their SQL.

Each query derives what it writes from the given tables, puts it into a shared folder, and reads it
back through the library's own readers. Models are stand-ins whose replies SQL can follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import parsing as P
from ..functions import prompts as PR
from ..functions import segment
from ..functions import text as X
from ..operators import classification, curation, dense, evaluation, fusion, judging, providers, rewriting, running, sparse
from ..sources import readers, writers
from ..storage import cut, shared_folder, spread
from . import corpus as corpora
from . import experiments
from .engine import Method
from .queries import (  # noqa: F401
    ORACLES, QUERIES,
    _AS_STATUTE, _BM25, _DENSE, _GUARD, _GUARD_SMALL, _MEANS, _NUM, _OUT, _PRED, _PRF, _QA, _RERANK, _STRICT, _STRIP, _UNION, _as_statute, _asked_vectors, _bm25, _dense, _measure, _outputs, _pairs, _per, _qa, _vectors,
    asked, corpus, han, han_sql, hybrid_engine, query, split_sources, table,
)


def _id() -> Column:
    return F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))


# ---------------------------------------------------------------- sources and sinks


@query(rf"""
select {_STRIP.format('source')} || chr(10) || {_STRIP.format('text')} as text from documents where {_STRIP.format('source')} <> '' and {_STRIP.format('text')} <> ''
""")
def read_articles(spark, sf_dir):
    """JSON lines with broken and blank ones between."""
    path = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    good = docs.select(F.to_json(F.struct(F.col("source").alias("input"), F.col("text").alias("answer"))).alias("value"))
    bad = docs.filter("doc_id % 7 = 0").select(F.explode(F.array(F.lit("{broken"), F.lit(" "), F.lit('{"input": "no answer"}'))))
    good.union(bad).write.text(path)
    return readers.articles(spark, path)


@query(ORACLES["clean_markup"].replace("select page_id, regexp_replace(x, '^\\s+|\\s+$', '', 'g') as text from c", "select regexp_replace(x, '^\\s+|\\s+$', '', 'g') as text from c where regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> ''"))
def read_markdown(spark, sf_dir):
    """Pages as markup files in folders, a file each."""
    path = shared_folder(spark)
    pages = table(spark, sf_dir, "pages").select(F.col("html").alias("value"), (F.col("page_id") % 4).alias("folder"))
    writers.texts(spread(pages), path, "folder")
    return readers.markdown(spark, path, "*.txt").select("text")


@query(rf"select {_STRIP.format('text')} as body from documents")
def read_textbooks(spark, sf_dir):
    """Documents as text files in one folder; their titles are the files' names."""
    path = shared_folder(spark)
    writers.texts(spread(table(spark, sf_dir, "documents").select(F.col("text").alias("value"))), path)
    return readers.textbooks(spark, path).select(F.replace("text", F.concat(F.lit("【"), "title", F.lit("】\n\n")), F.lit("")).alias("body"))


@query(rf"""
with {_QA}, t as (select string_split(question, chr(10))[1] as title, question, reply from qa)
select {_STRIP.format('title')} as title, '问：' || {_STRIP.format('title')} || chr(10) || '补充：' || {_STRIP.format('question')} || chr(10) || '答：' || {_STRIP.format('reply')} as text from t
where {_STRIP.format('title')} <> '' and {_STRIP.format('reply')} <> ''
""")
def read_forum(spark, sf_dir):
    path = shared_folder(spark)
    qa = _qa(spark, sf_dir).select(F.substring_index("question", "\n", 1).alias("title"), "question", "reply")
    qa.write.options(header=True, escape='"').csv(path)
    return readers.forum_qa(spark, path, "UTF-8")


@query(rf"with {_QA} select {_STRIP.format('question')} as question, {_STRIP.format('reply')} as ground_truth from qa where {_STRIP.format('question')} <> '' and {_STRIP.format('reply')} <> ''")
def read_qa_test(spark, sf_dir):
    path = shared_folder(spark)
    _qa(spark, sf_dir).select("question", "reply", "turn").write.options(header=True, escape='"').csv(path)
    return readers.qa_test(spark, path)


@query("select text, source, lang as title, null::varchar as section, doc_id as chunk_id from documents")
def read_chunks(spark, sf_dir):
    path = shared_folder(spark)
    docs = table(spark, sf_dir, "documents").select("text", "source", F.col("lang").alias("title"), F.lit(None).cast("string").alias("section"), F.col("doc_id").alias("chunk_id"))
    writers.chunks(docs, path, json=True)
    return readers.chunks(spark, path)


@query("""
with t as (select left(regexp_replace(string_split(text, chr(10))[1], '^\\s+|\\s+$', '', 'g'), 50) as query, doc_id from documents where source = 'src1'),
g as (select query, list_sort(list(doc_id)) as r from t where length(query) >= 10 group by query), s as (select query, r from g order by md5(query || ':42'), query limit 200)
select query, unnest(r) as chunk_id from s
""")
def read_test_set(spark, sf_dir):
    path = shared_folder(spark)
    titled = corpus(spark, sf_dir).withColumn("title", F.left(X.first_line(F.col("text")), F.lit(50)))
    writers.test_set(evaluation.build_test_set(titled, "src1"), path)
    return readers.test_set(spark, path).select("query", F.explode("relevant_ids").alias("chunk_id"))


@query("select user_id::varchar as id, arg_max(event_type, event_id) as pred from events group by user_id")
def read_keyed(spark, sf_dir):
    """Of a repeated id the last line wins: files and their lines are in the order of the events."""
    path = shared_folder(spark)
    e = table(spark, sf_dir, "events").repartitionByRange(8, "event_id").sortWithinPartitions("event_id")
    e.select(F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("pred")).write.json(path)
    return readers.keyed(spark, path, "pred")


@query(f"with {_QA}, r as (select question, max(reply) as answer from qa group by question) select conv_id, turn, coalesce(answer, '') as reference from conversations left join r on text = question")
def read_reference(spark, sf_dir):
    """The first JSON file isn't there, so the answers come from JSON lines; questions go by either name."""
    path = shared_folder(spark)
    qa = _qa(spark, sf_dir)
    odd = F.col("turn") % 2 == 1
    qa.select(F.when(odd, F.col("question")).alias("question"), F.when(~odd, F.col("question")).alias("query"), F.when(odd, F.col("reply")).alias("reply"), F.when(~odd, F.col("reply")).alias("answer")).write.json(path)
    known = readers.reference_answers(spark, [f"{path}-missing"], path).withColumn("line_no", F.col("answer"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("question"))
    return judging.with_reference(turns, known).select("conv_id", "turn", "reference")


@query(f"""
with {_PRED}, w as (select id, label = pred as correct from pairs)
select id, correct, count(*) over o as done, (sum(correct::int) over o)::bigint as "right", round((sum(correct::int) over o)::double / count(*) over o, 9) as accuracy from w window o as (order by id)
""")
def running_accuracy(spark, sf_dir):
    """Accuracy so far, after each judged row in order of id."""
    judged = _pairs(spark, sf_dir).select("id", (F.col("label") == F.col("pred")).alias("correct"))
    return running.running_accuracy(judged, ["id"]).withColumn("accuracy", F.round("accuracy", 9))


_LEXICON = rf"""
runs as materialized (select item_id, unnest(regexp_extract_all({han_sql('text')}, '[\x{{4e00}}-\x{{9fff}}]+')) as run from benchmark),
subs as (select substring(run, i + 1, l) as word from runs, unnest(range(length(run))) as a(i), unnest(range(1, 5)) as b(l) where i + l <= length(run)),
lex as materialized (select word, count(*) as freq from subs group by word having count(*) >= 3),
tot as (select ln(sum(freq)::double) as t from lex), costs as materialized (select word, round(1000000 * (t - ln(freq::double)))::bigint as cost from lex, tot)
"""
_SEGMENTED = rf"""
dr as materialized (select doc_id, unnest(l) as run, unnest(range(len(l))) as k from (select doc_id, regexp_extract_all({han_sql('text')}, '[\x{{4e00}}-\x{{9fff}}]+') as l from documents)),
r as materialized (select distinct run from dr),
e as (select run, i, l, case when cost is null and l = 1 then round(1000000 * t)::bigint else cost end as cost from (select run, i, l, substring(run, i + 1, l) as word from r, unnest(range(length(run))) as a(i), unnest(range(1, 5)) as b(l) where i + l <= length(run)) left join costs using (word), tot),
g as (select run, i, list(cost order by l) as cs from e group by run, i),
m as (select run, list(cs order by i) as cs, list(cs order by i desc) as back from g group by run),
b as (select run, cs, list_reduce(back, lambda acc, c: list_prepend(list_min([c[l] + acc[l] for l in range(1, len(c) + 1)]), acc), [0::bigint]) as best from m),
s as (select run, [list_max([l for l in range(1, len(cs[i]) + 1) if cs[i][l] + best[i + l] = best[i]]) for i in range(1, len(cs) + 1)] as step from b),
p as (select run, list_reduce(range(len(step)), lambda acc, i: case when acc[-1] = i then list_append(acc, i + step[i + 1]) else acc end, [0::bigint]) as ends from s),
w as materialized (select run, [x for x in [substring(run, (ends[j] + 1)::int, (ends[j + 1] - ends[j])::int) for j in range(1, len(ends))] if length(x) > 1] as words from p)
"""


@query(f"with {_LEXICON}, {_SEGMENTED}, o as (select doc_id, flatten(list(words order by k)) as words from dr join w using (run) group by doc_id) select doc_id, len(coalesce(words, []))::int as n, md5(array_to_string(coalesce(words, []), '/')) as digest from documents left join o using (doc_id)")
def han_segments(spark, sf_dir):
    """Whole texts cut into words of a lexicon (parts of the benchmark's words that stand three times) along the best path."""
    tokenizer = segment.dictionary_tokenizer(_lexicon(spark, sf_dir))
    words = table(spark, sf_dir, "documents").select("doc_id", tokenizer(han(F.col("text"))).alias("w")).select("doc_id", F.filter("w", lambda w: w.rlike(r"^[\x{4e00}-\x{9fff}]")).alias("w"))
    return words.select("doc_id", F.size("w").alias("n"), F.md5(F.array_join("w", "/")).alias("digest"))


def _lexicon(spark, sf_dir) -> DataFrame:
    run = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(han(F.col("text")), F.lit(r"[\x{4e00}-\x{9fff}]+"), F.lit(0))).alias("run"))
    ends = run.select("run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("i")).select("run", "i", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("l")).filter("i + l - 1 <= length(run)")
    return ends.groupBy(F.substring("run", F.col("i"), F.col("l")).alias("word")).agg(F.count("*").alias("freq")).filter("freq >= 3")


_TWO_METHODS = f"""
with {_DENSE}, {_per('de', 'p1')}, {_per('d2', 'p2')}, m as (select 'Full' as method, {_MEANS}, round(avg(rr), 6) as mrr, count(*) as n_queries from p1 union all select 'Signs', {_MEANS}, round(avg(rr), 6), count(*) from p2)
"""
_METRIC_NAMES = [f"{m}_{k}" for k in (1, 5, 10, 20) for m in ("hit", "recall")]


def _two_methods(spark, sf_dir) -> DataFrame:
    return evaluation.compare({"Full": _dense(spark, sf_dir, 20), "Signs": _dense(spark, sf_dir, 20, signs=True)}, _measure(spark, sf_dir))


@query(f"{_TWO_METHODS} select method, {', '.join(_METRIC_NAMES)}, mrr, n_queries from m")
def read_results(spark, sf_dir):
    """Reports of methods, a file each, beside one named summary, which isn't read."""
    path = shared_folder(spark)
    rows = cut(_two_methods(spark, sf_dir))
    writers.report(rows.filter("method = 'Full'"), f"{path}/full")
    writers.report(rows.filter("method = 'Signs'"), f"{path}/signs")
    return readers.result_files(spark, path).select("method", *_METRIC_NAMES, "mrr", "n_queries")


@query(f"{_TWO_METHODS} select method, {', '.join(f'printf({chr(39)}%.4f{chr(39)}, {c}) as {c}' for c in [*_METRIC_NAMES, 'mrr'])} from m")
def results_report(spark, sf_dir):
    return evaluation.report(_two_methods(spark, sf_dir)).select("method", *_METRIC_NAMES, "mrr")


@query(f"""
with {_PRF}, t as (select sum(support) as n, sum(recall * support) / sum(support) as acc, avg(precision) as mp, avg(recall) as mr, avg(f1) as mf, sum(precision * support) / sum(support) as wp, sum(f1 * support) / sum(support) as wf from prf)
select label, printf('%12.4f%12.4f%12.4f%12d', precision, recall, f1, support) as line from prf union all select 'accuracy', printf('%24s%12.4f%12d', '', acc, n::bigint) from t
union all select 'macro avg', printf('%12.4f%12.4f%12.4f%12d', mp, mr, mf, n::bigint) from t union all select 'weighted avg', printf('%12.4f%12.4f%12.4f%12d', wp, acc, wf, n::bigint) from t
""")
def class_report_text(spark, sf_dir):
    return classification.report_text(_pairs(spark, sf_dir))


# ---------------------------------------------------------------- indexes and the engine


@query(f"with {_BM25} select query_id, chunk_id, rank, score from de where rank <= 10")
def dense_index_search(spark, sf_dir):
    """A dense index built, saved, grouped into cells about pivots, saved and loaded again, and searched: cells that can't be near are skipped."""
    index = dense.DenseIndex.build(corpus(spark, sf_dir), dense.letter_encoder, "letters").save(shared_folder(spark))
    cells = dense.CellIndex.build(index.vectors).save(shared_folder(spark))
    return cells.search(asked(spark, sf_dir).select("query_id", dense.letter_encoder(F.col("query")).alias("embedding")), 10)


@query(f"with {_DENSE} select query_id, chunk_id, rank, score from de where rank <= 5")
def dense_cells(spark, sf_dir):
    """The pruned index over the vectors of real width."""
    return dense.CellIndex.build(_vectors(spark, sf_dir)).search(_asked_vectors(spark, sf_dir), 5)


@query(f"with {_BM25} select query_id, chunk_id, rank, score from bm where rank <= 10")
def sparse_index_search(spark, sf_dir):
    """A BM25 index built, saved in buckets by term, loaded and searched."""
    path = shared_folder(spark)
    sparse.build(corpus(spark, sf_dir)).save(path, buckets=8)
    return sparse.search(sparse.SparseIndex.load(spark, path), asked(spark, sf_dir), 10)


def build_index(chunks: DataFrame, path: str, encode, model: str) -> tuple[dense.DenseIndex, sparse.SparseIndex]:
    """Both indexes of chunks (chunk_id, text), written below ``path`` and read again."""
    vectors = dense.DenseIndex.build(chunks, encode, model).save(f"{path}/dense")
    sparse.build(chunks).save(f"{path}/sparse")
    return vectors, sparse.SparseIndex.load(chunks.sparkSession, f"{path}/sparse")


@query(f"""
with {_BM25} select 'letters' as model, {len(X.LETTERS)} as dimension, (select count(*) from documents) as num_chunks, (select count(*) from post) as postings, (select count(*) from idf) as terms,
  (select n from stats) as n, (select round(avgdl, 6) from stats) as avgdl
""")
def index_build(spark, sf_dir):
    """The job from chunks to both indexes, and what they hold."""
    vectors, index = build_index(corpus(spark, sf_dir), shared_folder(spark), dense.letter_encoder, "letters")
    counts = index.postings.agg(F.count("*").alias("postings")).crossJoin(index.idf.agg(F.count("*").alias("terms"))).crossJoin(index.stats.select("n", F.round("avgdl", 6).alias("avgdl")))
    return vectors.config.crossJoin(counts).select("model", "dimension", "num_chunks", "postings", "terms", "n", "avgdl")  # one row each


_KINDS = {"statutes": "statute_split", "textbooks": "textbook_split", "articles": "article_split", "forum": "qa_split"}


@query(
    "with s0 as (" + ORACLES["statute_split"] + "), s1 as (" + ORACLES["textbook_split"] + "), s2 as (" + ORACLES["article_split"] + "), s3 as (" + ORACLES["qa_split"] + "), every as ("
    + " union all ".join(f"select {i} as o, doc_ord::varchar as doc_ord, chunk_no, text, source, title, section from s{i}" for i in range(4))
    + ") select row_number() over (order by o, doc_ord, chunk_no) - 1 as chunk_id, text, source, title, section, " + f"{len(X.LETTERS)} as dimension, "
    + r"len(list_distinct([w for w in string_split_regex(lower(text), '[^\p{L}\p{N}]+') if length(w) > 1]))::bigint as terms from every"
)
def corpus_build(spark, sf_dir):
    """Four kinds of sources to one chunk table and both indexes, all written and read back: each chunk, its vector's width and its postings."""
    path = shared_folder(spark)
    corpora.build({kind: split_sources(spark, sf_dir)[kind] for kind in _KINDS}, path, dense.letter_encoder, "letters")
    engine = corpora.load(spark, path, dense.letter_encoder)
    terms = engine.index.postings.groupBy("chunk_id").agg(F.count("*").alias("terms"))
    both = engine.chunks.join(engine.vectors.select("chunk_id", F.size("embedding").alias("dimension")), "chunk_id").join(terms, "chunk_id", "left")
    return both.select("chunk_id", "text", "source", "title", "section", "dimension", F.coalesce("terms", F.lit(0)).alias("terms"))


_ENGINE_LEGS = _RERANK + f", {_UNION.replace('un as', 'un as materialized')}, uu as (select query_id, chunk_id, row_number() over (partition by query_id order by o) as rank from un)"


@query(f"""
with {_ENGINE_LEGS} select 'Dense' as method, query_id, chunk_id, rank from de where rank <= 20 union all select 'BM25', query_id, chunk_id, rank from bm where rank <= 20 union all select 'Union', query_id, chunk_id, rank from uu where rank <= 20
union all select 'RRF', query_id, chunk_id, rank from fu where rank <= 20 union all select 'RRF+Rerank', query_id, chunk_id, rank from rr where rank <= 20
""")
def engine_methods(spark, sf_dir):
    """Every retrieval method of the engine over a saved index."""
    path = shared_folder(spark)
    sparse.build(corpus(spark, sf_dir)).save(path, buckets=8)
    engine = hybrid_engine(spark, sf_dir, sparse.SparseIndex.load(spark, path))
    out = None
    for m in Method:
        hits = engine.retrieve(asked(spark, sf_dir), 20, m).select(F.lit(str(m)).alias("method"), "query_id", "chunk_id", "rank")
        out = hits if out is None else out.unionByName(hits)
    return out


#: The letters of a second stand-in encoder, and a plan's names for both and for the scorer.
_OTHER_LETTERS = "ldchumgp"
_MODELS, _RERANKERS = ["stand-in/letters", "stand-in/others"], ["overlap"]
_UNIT_SQL = "case when n > 0 then [x / n for x in v] else v end"
_OTHERS_SQL = f"""
ov as materialized (select chunk_id, {_UNIT_SQL} as v from (select chunk_id, v, sqrt(list_inner_product(v, v)) as n from (select doc_id as chunk_id, [{", ".join(f"length(text) - length(replace(text, '{x}', ''))" for x in _OTHER_LETTERS)}]::double[] as v from documents))),
oq as materialized (select query_id, {_UNIT_SQL} as q from (select query_id, v, sqrt(list_inner_product(v, v)) as n from (select item_id as query_id, [{", ".join(f"length(text) - length(replace(text, '{x}', ''))" for x in _OTHER_LETTERS)}]::double[] as v from benchmark))),
os as (select query_id, chunk_id, round(list_inner_product(q, v), 6) as score from oq, ov), od as (select query_id, chunk_id, row_number() over (partition by query_id order by score desc, chunk_id) as rank from os)
"""


@query(f"""
with {_ENGINE_LEGS}, {_OTHERS_SQL}, tq as (select item_id as query_id, array_to_string(string_split(text, ' ')[1:3], ' ') as title from benchmark),
rel as materialized (select query_id, doc_id as chunk_id from tq join documents on contains(text, title) where title <> ''), n as (select query_id, count(*) as n from rel group by query_id),
ex(ord, tag, method, model, reranker) as (values (0, 'Dense_letters', 'Dense', 'stand-in/letters', ''), (1, 'BM25_letters', 'BM25', 'stand-in/letters', ''), (2, 'Union_letters', 'Union', 'stand-in/letters', ''),
  (3, 'RRF_letters', 'RRF', 'stand-in/letters', ''), (5, 'Dense_others', 'Dense', 'stand-in/others', ''), (7, 'RRF+Rerank_letters_overlap', 'RRF+Rerank', 'stand-in/letters', 'overlap')),
h as (select 0 as ord, query_id, chunk_id, rank from de union all select 1, query_id, chunk_id, rank from bm union all select 2, query_id, chunk_id, rank from uu union all select 3, query_id, chunk_id, rank from fu
  union all select 5, query_id, chunk_id, rank from od union all select 7, query_id, chunk_id, rank from rr),
f as (select ord, query_id, {', '.join(f'count(*) filter (rank <= {k}) as c{k}' for k in (1, 5, 10, 20))}, 1.0::double / min(rank) as rr from h join rel using (query_id, chunk_id) where rank <= 20 group by ord, query_id)
select ord, tag, method, model, reranker, {', '.join(f'round(avg((coalesce(c{k}, 0) > 0)::int::double), 6) as hit_{k}, round(avg(coalesce(c{k}::double / n, 0)), 6) as recall_{k}' for k in (1, 5, 10, 20))}, round(avg(coalesce(rr, 0)), 6) as mrr, count(*) as n_queries
from ex cross join tq left join f using (ord, query_id) left join n using (query_id) group by ord, tag, method, model, reranker
""")
def experiment_runs(spark, sf_dir):
    """A full plan of experiments, a row each; each leg is retrieved once, whoever shares it."""
    docs, queries = corpus(spark, sf_dir), asked(spark, sf_dir)
    letters = dict(zip(_MODELS, (X.LETTERS, _OTHER_LETTERS), strict=True))
    encode = lambda model, c: dense.letter_encoder(F.col(c), letters[model]).alias("embedding")

    def near(model: str, k: int) -> DataFrame:
        return dense.search(cut(docs.select("chunk_id", encode(model, "text"))), cut(queries.select("query_id", encode(model, "query"))), k)

    relevant = cut(evaluation.relevant_by_title(queries.withColumn("query", F.array_join(F.slice(F.split("query", " "), 1, 3), " ")), docs))
    plan = experiments.expand(spark, "full", _MODELS, _RERANKERS)
    return experiments.run(plan, near, lambda k: _bm25(spark, sf_dir, k), providers.scorer, queries, docs, lambda hits: evaluation.per_query(hits, relevant, queries), k=20)


@query("select (select count(*) from documents) as chunks, (select count(*) from documents) as vectors, true as reranker")
def engine_status(spark, sf_dir):
    return spark.createDataFrame([hybrid_engine(spark, sf_dir).status()], "chunks long, vectors long, reranker boolean")


@query("""
with d as (select doc_id, text, string_split(text, chr(10))[1] as title from documents), q as (select doc_id as query_id, title from d where doc_id % 20 = 0 and title <> '')
select query_id, doc_id as chunk_id from q join d on contains(text, q.title)
""")
def title_contained(spark, sf_dir):
    """The relevance variant by containment: the titles divisible by 20 against the texts of all documents."""
    docs = table(spark, sf_dir, "documents")
    q = docs.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.substring_index("text", "\n", 1).alias("query"))
    return evaluation.relevant_by_title(q, spread(docs.select(F.col("doc_id").alias("chunk_id"), "text")))


@query(f"""
with {_BM25}, tq as (select item_id as query_id, array_to_string(string_split(text, ' ')[1:3], ' ') as title from benchmark),
rel as materialized (select query_id, doc_id as chunk_id from tq join documents on contains(text, title) where title <> ''), n as (select query_id, count(*) as n from rel group by query_id),
h as (select query_id, rank from bm join rel using (query_id, chunk_id) where rank <= 20), f as (select query_id, count(*) filter (rank <= 10) as f10, count(*) as f20, 1.0::double / min(rank) as rr from h group by query_id)
select query_id, (coalesce(f10, 0) > 0)::int::double as hit_10, round(coalesce(f20::double / n, 0), 6) as recall_20, round(coalesce(rr, 0), 6) as rr from tq left join n using (query_id) left join f using (query_id)
""")
def title_recall(spark, sf_dir):
    """BM25 hits measured by containment: of the documents that hold a query's first three words in a row, how many are found."""
    queries = asked(spark, sf_dir)
    relevant = evaluation.relevant_by_title(queries.withColumn("query", F.array_join(F.slice(F.split("query", " "), 1, 3), " ")), corpus(spark, sf_dir))
    rows = evaluation.per_query(_bm25(spark, sf_dir, 20), cut(relevant), queries, [10, 20])
    return rows.select("query_id", "hit_10", F.round("recall_20", 6).alias("recall_20"), F.round("rr", 6).alias("rr"))


@query("select user_id, event_id, event_type from events qualify row_number() over (partition by user_id, event_type order by event_id) = 1")
def keep_first(spark, sf_dir):
    return fusion.keep_first(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id", "event_type"], "event_id")


# ---------------------------------------------------------------- headings and sentences


@query(rf"""
with {_AS_STATUTE}, x as (select doc_id, body, regexp_extract(body, '(?m)^({_NUM}章\s[^\n]*)$', 1) as c from st)
select doc_id, {_STRIP.format('c')} as context, case when regexp_matches(body, '^{_NUM}章[\s　]') then {_STRIP.format('string_split(body, chr(10))[1]')} else '' end as header,
  not contains({_STRIP.format('string_split(body, chr(10))[1]')}, chr(10)) and regexp_matches({_STRIP.format('string_split(body, chr(10))[1]')}, '^{_NUM}[编章节]\s') as pure from x
""")
def headings(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", _as_statute(F.col("text")).alias("body"))
    return docs.select("doc_id", X.structure_context(F.col("body")).alias("context"), X.header_of(F.col("body"), "chapter").alias("header"), X.is_pure_header(F.substring_index("body", "\n", 1)).alias("pure"))


def _clean_sql(x: str, collapse: bool = True) -> str:
    bare = _STRIP.format(rf"""regexp_replace({_STRIP.format(x)}, '^["''“”‘’]+|["''“”‘’]+$', '', 'g')""")
    return f"regexp_replace({bare}, '[？?]{{2,}}', '？', 'g')" if collapse else bare


def _fixed_sql(x: str) -> str:
    return f"case when {x} = '' or regexp_matches({x}, '[？?]$') then {x} else {x} || '？' end"


@query(f"""
with t as (select conv_id, turn, '“ ' || {han_sql('text')} || case turn % 3 when 0 then '??' when 1 then '' else '？？"' end as t from conversations), c as (select conv_id, turn, {_clean_sql('t')} as c, {_clean_sql('t', False)} as kept from t)
select conv_id, turn, {_fixed_sql('c')} as question, kept from c
""")
def sentence_clean(spark, sf_dir):
    n = F.col("turn") % 3
    t = F.concat(F.lit("“ "), han(F.col("text")), F.when(n == 0, "??").when(n == 1, "").otherwise('？？"'))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.fix_question_mark(X.clean_sentence(t)).alias("question"), X.clean_sentence(t, collapse=False).alias("kept"))


# ---------------------------------------------------------------- rewriting

#: A model's two answers to each question: what SQL says they hold, and the answers themselves.
_ANSWERS = rf"""
an as (select conv_id || ':' || turn as id, {_STRIP.format(han_sql('question'))} as q, length(question) % 6 as n, turn, regexp_replace({_STRIP.format(han_sql('question'))}, '\s+', ' ', 'g') as line from qa),
xs as (select *, case n when 0 then replace(q, '的', '国') when 1 then '"' || q || '"' when 2 then q || '？？' when 5 then replace(q, '一', '公司') end as xa, replace(q, '是', '人') as xb from an)
"""


def _answers(spark, sf_dir, key: str) -> DataFrame:
    """id, question, first, second: JSON alone, within words, in a code block, or none at all; a failed call."""
    q = X.strip(han(F.col("question")))
    rows = _qa(spark, sf_dir).select(_id().alias("id"), q.alias("question"), (F.length("question") % 6).alias("n"), "turn")
    swap = lambda old, new: F.replace("question", F.lit(old), F.lit(new))
    n = F.col("n")
    x = F.when(n == 0, swap("的", "国")).when(n == 1, F.concat(F.lit('"'), "question", F.lit('"'))).when(n == 2, F.concat("question", F.lit("？？"))).otherwise(swap("一", "公司"))
    body = lambda c: F.to_json(F.struct(c.alias(key), F.lit("合同").alias("关键词")))
    line = F.regexp_replace("question", r"\s+", " ")
    first = F.when(n == 1, F.concat(F.lit("好的 "), body(x), F.lit(" }完"))).when(n == 2, F.concat(F.lit("```json\n"), body(x), F.lit("\n```"))).otherwise(body(x))
    first = F.when(n == 3, F.concat(F.lit("\n输出如下\n回答： "), F.replace(line, F.lit("一"), F.lit("二")), F.lit("\n"))).otherwise(first)
    return rows.select("id", "question", F.struct(first.alias("text"), (n != 4).alias("ok")).alias("first"), F.struct(body(swap("是", "人")).alias("text"), (F.col("turn") % 2 == 0).alias("ok")).alias("second"))


_MAIN = f"""
with {_QA}, {_ANSWERS}, c as (select *, {_fixed_sql(_clean_sql('xa'))} as a, {_fixed_sql(_clean_sql('xb'))} as b from xs),
g as (select *, (select {_GUARD} from (select a as new, q as old)) as bad_a, (select {_GUARD} from (select b as new, q as old)) as bad_b from c),
s as (select *, case when q = '' or lower(q) = 'nan' then 'EMPTY' when n = 4 then 'CALL_FAIL' when a is null then 'JSON_FAIL' when bad_a is null then 'OK' when turn % 2 <> 0 then 'RETRY_CALL_FAIL' when bad_b is null then 'OK2'
  else 'BAD_RQ_ROLLBACK:' || bad_a end as s from g),
main as (select id, q as question, case s when 'OK' then a when 'OK2' then b else q end as rewritten, case when s in ('OK', 'OK2') then '合同' else '' end as keyword,
  s in ('OK', 'OK2') and regexp_replace(case s when 'OK' then a else b end, '\\s+', '', 'g') <> regexp_replace(q, '\\s+', '', 'g') as changed, s not in ('CALL_FAIL', 'RETRY_CALL_FAIL') as ok, replace(s, 'OK2', 'OK') as status from s)
"""


@query(f"{_MAIN} select id, question, rewritten, keyword, changed, ok, status from main")
def rewrite_main(spark, sf_dir):
    return rewriting.rewrite(_answers(spark, sf_dir, "改写问题"))


@query(f"""
{_MAIN} select count(*) as total, count(*) filter (status like 'OK%') as ok, count(*) filter (status like 'BAD_RQ_ROLLBACK%') as rollback, count(*) filter (status not like 'OK%' and status not like 'BAD_RQ_ROLLBACK%') as fail,
  count(*) filter (changed) as changed, count(*) filter (keyword <> '') as with_keyword from main
""")
def status_summary(spark, sf_dir):
    return judging.status_summary(rewriting.rewrite(_answers(spark, sf_dir, "改写问题")))


@query(f"{_MAIN} select id, question, rewritten from main")
def rewrite_sinks(spark, sf_dir):
    """The rewriting job with its two sinks; the clean one is read back."""
    path = shared_folder(spark)
    writers.debug_and_clean(rewriting.rewrite(_answers(spark, sf_dir, "改写问题")), ["id", "question", "rewritten"], path)
    return spark.read.schema("id string, question string, rewritten string").options(header=True, multiLine=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{path}/clean")


_SMALL = f"""
with {_QA}, {_ANSWERS}, c as (select *, {_clean_sql("case when n = 3 then replace(line, '一', '二') else xa end", False)} as a0, {_clean_sql('xb', False)} as b from xs),
p as (select *, case when n = 3 and (not regexp_matches(a0, '[\\x{{4e00}}-\\x{{9fff}}]') or a0 = q or length(a0) < 4) then null else a0 end as a, case when n = 3 then 'plain' else 'json' end as method from c),
g as (select *, (select {_GUARD_SMALL} from (select a as new, q as old)) as bad_a, (select {_GUARD_SMALL} from (select b as new, q as old)) as bad_b from p),
s as (select *, case when q = '' or lower(q) = 'nan' then 'EMPTY' when n = 4 then 'CALL_FAIL' when a is null then 'PARSE_FAIL' when bad_a is null then 'OK_' || method when turn % 2 <> 0 then 'RETRY_CALL_FAIL' when bad_b is null then 'OK_json_retry'
  else 'BAD_RQ_ROLLBACK:' || bad_a end as status from g)
"""


@query(f"""
{_SMALL}, r as (select *, case when status = 'OK_json_retry' then b when status like 'OK%' then a else q end as rewritten from s)
select id, q as question, rewritten, regexp_replace(rewritten, '\\s+', '', 'g') <> regexp_replace(q, '\\s+', '', 'g') as changed, status not in ('CALL_FAIL', 'RETRY_CALL_FAIL') as ok, status from r
""")
def rewrite_small(spark, sf_dir):
    return rewriting.rewrite_small(_answers(spark, sf_dir, "rewritten_question"))


@query(f"""
with {_QA}, {_ANSWERS} select id, case when n not in (3, 4) then {_STRIP.format('xa')} end as question, case when n not in (3, 4) then '合同' end as keyword from xs where n <> 4
""")
def rewrite_extract(spark, sf_dir):
    got = P.extract_rewrite(F.col("first.text"))
    return _answers(spark, sf_dir, "改写问题").filter("first.ok").select("id", got["question"].alias("question"), got["keyword"].alias("keyword"))


@query(f"with {_OUT}, {_STRICT}, o2 as (select doc_id, label from strict) select doc_id as id, case when doc_id % 11 = 0 then 'ERROR' else coalesce(label, '闲聊类') end as pred from o2")
def intent_predict(spark, sf_dir):
    """Labels from two attempts, the first of which says nothing, and the fallback."""
    rows = _outputs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.lit("嗯").alias("first"), F.col("out").alias("second"), (F.col("doc_id") % 11 == 0).alias("failed"))
    return rewriting.predict_labels(rows)


@query("select conv_id, turn, '模板{x}：' || text || '（' || role || '）' as prompt from conversations")
def prompt_render(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", PR.render("模板{{x}}：{q}（{r}）", q=F.col("text"), r=F.col("role")).alias("prompt"))


@query("select doc_id, source || '-' || lang as tag from documents")
def experiment_tag(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", PR.model_tag(F.concat_ws("/", F.lit("org"), "lang", F.concat_ws("-", "source", "lang"))).alias("tag"))


# ---------------------------------------------------------------- curation jobs

_SCORED = rf"""
d as (select distinct question, reply from qa where question is not null and reply is not null),
st as (select {_STRIP.format('question')} as question, {_STRIP.format('reply')} as reply from d), k as (select * from st where length(question) >= 4 and length(reply) >= 10),
nb as (select *, (row_number() over (order by question, reply) - 1) // 5 as batch from k),
sc as (select question, reply, case when ok then (length(reply) % 10 + 1)::double else 6.0::double end as score, case when ok then 'n' || length(question) else 'API评分失败，默认保留' end as reason
  from (select *, list_contains([ascii(md5(batch || ':' || r)) % 3 for r in [0, 1, 2]], 2) as ok from nb))
"""


def _moody_scores(rows: DataFrame):
    """A stand-in model for batches: by batch and round it answers no list, one entry short, or all entries from last to first."""

    def ask(prompts: DataFrame, number: int) -> DataFrame:
        entry = F.struct((F.col("n") % 5).cast("int").alias("index"), (F.length("reply") % 10 + 1).alias("score"), F.concat(F.lit("n"), F.length("question").cast("string")).alias("reason"))
        whole = rows.groupBy(F.floor(F.col("n") / 5).alias("batch")).agg(F.sort_array(F.collect_list(entry), asc=False).alias("entries"))
        mood = F.ascii(F.md5(F.concat_ws(":", F.col("batch").cast("string"), F.lit(str(number))))) % 3
        listed = F.when(mood == 1, F.slice("entries", 1, F.size("entries") - 1)).otherwise(F.col("entries"))
        answer = F.when(mood == 0, "no list").otherwise(F.concat(F.lit("```json\n"), F.to_json(listed), F.lit("\n```")))
        return prompts.join(whole, "batch").withColumn("answer", answer)

    return ask


def _scored(spark, sf_dir) -> DataFrame:
    """question, reply, score, reason: cleaned pairs scored in batches of five and up to three rounds."""
    rows = running.number_rows(curation.preclean(_qa(spark, sf_dir)), "question", "reply")
    return curation.score_in_rounds(rows, _moody_scores(rows)).select("question", "reply", "score", "reason")


@query(f"with {_QA}, {_SCORED} select question, reply, score, reason from sc")
def batch_scores(spark, sf_dir):
    return _scored(spark, sf_dir)


@query(f"""
with {_QA}, {_SCORED}, r as (select *, rank() over (order by score desc) as r from sc) select question, reply, case when r > 500 then score end as score, case when r > 500 then reason end as reason, r <= 500 as kept from r
""")
def clean_job(spark, sf_dir):
    """The cleaning job from pairs to two sinks, both read back."""
    path = shared_folder(spark)
    kept, removed = curation.split_kept(cut(_scored(spark, sf_dir)))
    writers.kept_and_removed(kept, removed, path)
    read = lambda name, schema: spark.read.schema(schema).options(header=True, multiLine=True, escape='"').csv(f"{path}/{name}")
    both = read("kept", "question string, reply string").withColumn("kept", F.lit(True))
    return both.unionByName(read("removed", "question string, reply string, score double, reason string").withColumn("kept", F.lit(False)), allowMissingColumns=True).select("question", "reply", "score", "reason", "kept")


@query(f"""
with {_QA}, t as (select conv_id || ':' || turn as idx, {han_sql('question')} as instruction, {han_sql('reply')} as output from qa),
w as (select *, regexp_matches(instruction || output, '法|条|规定|合同|责任|权利|义务|诉讼|赔偿|刑|民|侵权|犯罪|法院|法律') and length(output) < 500 as wanted from t),
e as (select *, output || '增' as one, output || output || output as two from w)
select idx, instruction, case when not wanted then output when length(one) >= greatest(length(output) * 1.3::double, 200) then one else two end as output from e
""")
def expansion_job(spark, sf_dir):
    """Legal records are expanded in two attempts, resumed from a table of those done, and override the old ones."""
    sft = _qa(spark, sf_dir).select(_id().alias("idx"), han(F.col("question")).alias("instruction"), han(F.col("reply")).alias("output"))

    def expand(todo: DataFrame) -> DataFrame:
        tries = F.array(F.concat("output", F.lit("增")), F.concat("output", "output", "output"))
        attempts = todo.select("idx", F.col("output").alias("original"), F.posexplode(tries).alias("attempt", "output"))
        return curation.accept_expansion(attempts).withColumnRenamed("output", "value")

    path = shared_folder(spark)
    targets = curation.expansion_targets(sft)
    expand(targets.filter(F.crc32("idx") % 2 == 0)).write.parquet(path)  # a first run that got half way
    return curation.override(sft, curation.resumable(targets, path, expand)).select("idx", "instruction", "output")


# ---------------------------------------------------------------- inference and answer quality

_COS = "round(list_inner_product({0}, {1}) / (sqrt(list_inner_product({0}, {0})) * sqrt(list_inner_product({1}, {1}))), 12)"


def _letters_sql(c: str) -> str:
    return "[" + ", ".join(f"length({c}) - length(replace({c}, '{x}', ''))" for x in X.LETTERS) + "]::double[]"


@query(f"""
with {_RERANK}, c as (select query_id, string_agg('[参考文档' || rank || '] ' || text, chr(10) || chr(10) order by rank) as x, list(text order by rank) as l from rr join documents on doc_id = chunk_id where rank <= 3 group by query_id)
select b.item_id as idx, b.text as question, '答：' || ('请根据以下参考文档回答问题。' || chr(10) || chr(10) || '参考文档:' || chr(10) || x || chr(10) || chr(10) || '问题: ' || b.text || chr(10) || chr(10) || '回答:') as generated_answer, array_to_string(l, chr(1)) as contexts
from benchmark b join c on item_id = query_id
""")
def rag_inference(spark, sf_dir):
    """Retrieve, prompt, generate (the stand-in repeats its prompt), write nested results and read them again."""
    questions = asked(spark, sf_dir)
    prompts = hybrid_engine(spark, sf_dir).prompts(questions, 3)
    generate = providers.generator(lambda: "答：{}".format, attempts=1)
    rows = questions.join(prompts, "query_id").withColumn("g", generate(F.col("prompt")))
    config = F.struct(F.lit("org/echo").alias("model"), F.lit(True).alias("use_rag"), F.lit("RRF+Rerank").alias("retriever"), F.lit(3).alias("top_k"))
    results = rows.select(config.alias("config"), F.col("query_id").alias("idx"), F.col("query").alias("question"), F.lit("").alias("ground_truth"), F.col("g.text").alias("generated_answer"), "contexts", F.lit(True).alias("use_rag"))
    path = shared_folder(spark)
    writers.inference(results, path)
    found = readers.inference_files(spark, path).select("question", "generated_answer", F.array_join("contexts", "\x01").alias("contexts"))
    return found.join(questions.select(F.col("query_id").alias("idx"), F.col("query").alias("question")), "question").select("idx", "question", "generated_answer", "contexts")


@query(f"""
with {_QA}, r as (select 'f' || (conv_id % 3) as file, conv_id || ':' || turn as idx, conv_id % 3 <> 1 as use_rag, question, reply, replace(replace(reply, 'ber', '不一致'), 'er', '一致') as judgement,
  {_letters_sql('question')} as qv, {_letters_sql('reply')} as av, {_letters_sql("question || reply")} as gv from qa),
s as (select file, idx, avg(contains(x, 'the')::int::double) as faithful from (select file, idx, unnest(string_split(reply, '. ')) as x from r) group by file, idx),
q as (select file, idx, avg({_COS.format('qv', 'v')}) as relevancy from (select file, idx, qv, {_letters_sql('x')} as v from (select file, idx, qv, unnest([reply, reverse(question), upper(reply) || question]) as x from r)) group by file, idx),
v as (select r.*, case when contains(judgement, '不一致') then 0 when contains(judgement, '一致') then 1 end as v from r)
select file, count(*) as n, coalesce(round(sum(v)::double / nullif(count(v), 0), 4), 0) as precision, round(avg(relevancy), 4) as answer_relevancy, round(avg(faithful) filter (use_rag), 4) as faithfulness,
  round(avg({_COS.format('av', 'gv')}), 4) as answer_similarity from v left join q using (file, idx) left join s using (file, idx) group by file
""")
def answer_quality(spark, sf_dir):
    """The bundle of means over all inference files: a row each."""
    letters = lambda c: X.letter_counts(c)
    swap = F.replace(F.replace("reply", F.lit("ber"), F.lit("不一致")), F.lit("er"), F.lit("一致"))
    given = _qa(spark, sf_dir)
    kind = (F.col("conv_id") % 3).cast("string")
    config = F.struct(F.concat(F.lit("f"), kind).alias("model"), (kind != "1").alias("use_rag"), F.lit("RRF").alias("retriever"), F.lit(3).alias("top_k"))
    number = F.row_number().over(W.partitionBy(kind, F.crc32(_id()) % 64).orderBy("conv_id", "turn")) * 64 + F.crc32(_id()) % 64  # any number tells results apart
    results = given.select(config.alias("config"), number.alias("idx"), "question", F.col("reply").alias("ground_truth"), F.col("reply").alias("generated_answer"), F.array(_id()).alias("contexts"), (kind != "1").alias("use_rag"))
    path = shared_folder(spark)
    writers.inference(results, path)
    found = readers.inference_files(spark, path).withColumnRenamed("generated_answer", "reply")
    rows = found.select(F.col("config.model").alias("file"), F.col("contexts")[0].alias("idx"), "use_rag", "question", F.col("reply").alias("answer"), swap.alias("judgement"))
    results = rows.withColumns({"question_vector": letters(F.col("question")), "answer_vector": letters(F.col("answer")), "gold_vector": letters(F.concat("question", "answer"))})
    statements = rows.select("file", "idx", F.explode(F.split("answer", r"\. ")).alias("s")).select("file", "idx", F.contains("s", F.lit("the")).cast("int").alias("verdict"))
    again = F.array("answer", F.reverse("question"), F.concat(F.upper("answer"), "question"))
    regenerated = rows.select("file", "idx", F.explode(again).alias("q")).select("file", "idx", letters(F.col("q")).alias("vector"))
    return judging.answer_quality(results, statements, regenerated)


# ---------------------------------------------------------------- providers


def _letter_model():
    return lambda texts: [[float(t.count(x)) for x in X.LETTERS] for t in texts]


@query(f"""
with v as (select doc_id as chunk_id, {_letters_sql('text')} as v from documents), n as (select chunk_id, v, sqrt(list_inner_product(v, v)) as n from v)
select chunk_id, unnest(generate_series(0, {len(X.LETTERS) - 1})) as place, unnest([case when n > 0 then (x / n)::float else 0 end for x in v])::double as value from n where chunk_id % 2 = 1
""")
def provider_encode(spark, sf_dir):
    """A model behind the encoder interface, resumed: chunks that have a vector already aren't encoded again."""
    chunks = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text"))
    done = chunks.filter("chunk_id % 2 = 0").select("chunk_id", F.xxhash64("text").alias("text_hash"))
    fresh = providers.encode_missing(chunks, done, providers.encoder(_letter_model))
    return fresh.select("chunk_id", F.posexplode("embedding").alias("place", "value")).withColumn("value", F.col("value").cast("double"))


@query(f"""
with v as (select doc_id as chunk_id, {_letters_sql('text')} as v from documents), n as (select chunk_id, v, sqrt(list_inner_product(v, v)) as n from v)
select chunk_id, unnest(generate_series(0, {len(X.LETTERS) - 1})) as place, unnest([case when n > 0 then (x / n)::float else 0 end for x in v])::double as value from n
""")
def encode_groups(spark, sf_dir):
    """All chunks encoded in groups that are committed one by one."""
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    vectors = providers.encode_in_groups(chunks, shared_folder(spark), providers.encoder(_letter_model), "letters", every=max(1, chunks.count() // 3))
    return vectors.select("chunk_id", F.posexplode("embedding").alias("place", "value")).withColumn("value", F.col("value").cast("double"))


#: A program that answers with the first line it reads; q makes it fail, and z (without q) print to its error stream only.
_PROGRAM = ["sh", "-c", """IFS= read -r line; case "$line" in *q*) echo bad >&2; exit 3;; *z*) echo only >&2;; *) printf 're: %s\\n' "$line";; esac"""]


@query(f"""
with l as (select conv_id, turn, string_split(text, chr(10))[1] as line from conversations)
select conv_id, turn, case when contains(line, 'q') then 'OLLAMA_RC_3: bad' when contains(line, 'z') then 'OLLAMA_EMPTY_STDOUT: only' else {_STRIP.format("'re: ' || line")} end as reply, not contains(line, 'q') and not contains(line, 'z') as ok from l
""")
def provider_command(spark, sf_dir):
    """A command per prompt, with its failures told apart."""
    reply = providers.command_generator(_PROGRAM, timeout=60, in_flight=2)
    rows = spread(table(spark, sf_dir, "conversations")).withColumn("g", reply(F.col("text")))
    return rows.select("conv_id", "turn", F.col("g.text").alias("reply"), F.col("g.ok").alias("ok"))


@query("select item_id, doc_id, (length(b.text) + length(d.text))::double as score from benchmark b join documents d on d.doc_id = b.item_id")
def provider_score(spark, sf_dir):
    score = providers.pair_scorer(lambda: lambda pairs: [float(len(a) + len(b)) for a, b in pairs])
    both = table(spark, sf_dir, "benchmark").join(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body")), F.col("item_id") == F.col("doc_id"))
    return both.select("item_id", "doc_id", score(F.col("text"), F.col("body")).alias("score"))


def _moody_model():
    def call(prompt: str) -> str:
        if "q" in prompt:
            raise RuntimeError("no q")
        return prompt[::-1]

    return call


@query("select conv_id, turn, case when contains(text, 'q') then 'FAIL: no q' else reverse(text) end as reply, not contains(text, 'q') as ok from conversations")
def provider_generate(spark, sf_dir):
    """A model that fails on some prompts, tried twice."""
    reply = providers.generator(_moody_model, attempts=2, pause=0)
    rows = table(spark, sf_dir, "conversations").withColumn("g", reply(F.col("text")))
    return rows.select("conv_id", "turn", F.col("g.text").alias("reply"), F.col("g.ok").alias("ok"))
