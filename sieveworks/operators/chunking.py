"""Structural and sentence chunkers: one document in, chunks out, all in column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..storage import small_batches
from .running import number_rows

_LEVELS = ["part", "chapter", "section"]
PREAMBLE = "序言"


def _descend(parts: Column, level: str, keep_single: bool) -> Column:
    """Split structs (section, text) at a heading level; a level with one part is passed over.

    With ``keep_single`` its heading joins ``section`` all the same.
    """

    def named(outer: Column, cut: Column, t: Column) -> Column:
        head = X.header_of(t, level)
        adds = (head != "") & ((F.size(cut) > 1) | F.lit(keep_single))
        section = F.when(adds, F.concat_ws(" > ", F.when(outer["section"] != "", outer["section"]), head)).otherwise(outer["section"])
        return F.struct(section.alias("section"), t.alias("text"))

    # the array around the cut makes it a value, which no part computes anew
    each = lambda p: F.transform(F.array(X.split_at(p["text"], X.heading(level), X.LEVELS[level])), lambda cut: F.transform(cut, lambda t: named(p, cut, t)))[0]
    return F.flatten(F.transform(parts, each))


def _sections(docs: DataFrame, keep_single: bool) -> DataFrame:
    """``docs`` with ``parts``, an array of struct(section, text), by part, chapter and section."""
    out = docs.withColumn("parts", F.array(F.struct(F.lit("").alias("section"), F.col("text").alias("text"))))
    for level in _LEVELS:
        out = out.withColumn("parts", _descend(F.col("parts"), level, keep_single))
    return out


def _numbered(docs: DataFrame, carried: list[str], pieces: Column, drop: Callable[[Column], Column]) -> DataFrame:
    """A row per piece (struct of section and text) that isn't blank or to be dropped, numbered within its document."""
    bare = F.transform(pieces, lambda p: F.struct(p["section"].alias("section"), X.strip(p["text"]).alias("text")))
    kept = docs.select(*carried, F.posexplode(F.filter(bare, lambda p: (p["text"] != "") & ~drop(p["text"]))).alias("chunk_no", "p"))
    return kept.select(*carried, "p.section", "p.text", "chunk_no")


def _leaves(parts: Column, merged: Column) -> Column:
    """The sections of ``parts`` for each of their merged pieces: an array of struct(section, text)."""
    both = F.arrays_zip(parts.alias("part"), merged.alias("pieces"))
    return F.flatten(F.transform(both, lambda x: F.transform(x["pieces"], lambda t: F.struct(x["part"]["section"].alias("section"), t.alias("text")))))


def split_statute(docs: DataFrame, carried: list[str], limit: int = X.CHUNK_CHARS, keep_single: bool = False) -> DataFrame:
    """``carried`` columns, section, text, chunk_no: statutes by part, chapter and section, then by article.

    What precedes the first article has the section's headings, or ``序言`` if there are none;
    an article beyond ``limit`` goes by paragraphs; pieces that are a heading alone go. A document
    stays one row until its chunks are numbered: nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    article = X.heading("article").replace("(?mU)", "(?U)")

    def named(part: Column, t: Column) -> Column:
        section = F.when(~t.rlike(article) & (part["section"] == ""), PREAMBLE).otherwise(part["section"])
        return F.struct(section.alias("section"), t.alias("text"))

    articles = F.flatten(F.transform("parts", lambda p: F.transform(X.split_at(p["text"], X.heading("article"), X.LEVELS["article"]), lambda t: named(p, t))))
    rows = _sections(docs, keep_single).select(*carried, articles.alias("parts"))
    rows = rows.withColumn("merged", X.merge_each(F.transform("parts", lambda p: p["text"]), limit))
    return _numbered(rows, carried, _leaves(F.col("parts"), F.col("merged")), X.is_pure_header)


def split_book(docs: DataFrame, carried: list[str], limit: int = X.CHUNK_CHARS, keep_single: bool = False) -> DataFrame:
    """``carried`` columns, section, text, chunk_no: textbooks by the same levels, then by paragraphs; title lines go."""
    small_batches(docs.sparkSession)
    rows = _sections(docs, keep_single).select(*carried, "parts")
    rows = rows.withColumn("merged", X.merge_each(F.transform("parts", lambda p: X.strip(p["text"])), limit))
    return _numbered(rows, carried, _leaves(F.col("parts"), F.col("merged")), lambda t: X.is_pure_header(t) | t.rlike(r"\A【.+?】\z"))


def statute_chunks(docs: DataFrame, limit: int = X.CHUNK_CHARS) -> DataFrame:
    """Chunks of statutes (doc_ord, text): the first line is the title."""
    body = docs.select("doc_ord", X.strip(F.col("text")).alias("text")).filter("text <> ''").withColumn("title", X.first_line(F.col("text")))
    return split_statute(body, ["doc_ord", "title"], limit).select("doc_ord", "chunk_no", "text", F.lit("statute").alias("source"), "title", "section")


def book_chunks(docs: DataFrame, limit: int = X.CHUNK_CHARS) -> DataFrame:
    """Chunks of textbooks (doc_ord, text); the title stands in 【】 at the start."""
    name = F.regexp_extract("text", r"\A\s*【(.+?)】", 1)
    body = docs.select("doc_ord", X.strip(F.col("text")).alias("text"), F.coalesce(F.when(name != "", name), F.lit("未知教材")).alias("title")).filter("text <> ''")
    return split_book(body, ["doc_ord", "title"], limit).select("doc_ord", "chunk_no", "text", F.lit("textbook").alias("source"), "title", "section")


def article_chunks(docs: DataFrame, limit: int = X.CHUNK_CHARS) -> DataFrame:
    """Chunks of article records (doc_ord, text); the title is the first line's first 50 characters."""
    small_batches(docs.sparkSession)
    body = docs.select("doc_ord", X.strip(F.col("text")).alias("text"))
    # the title is found before the pieces become rows, else each of them would look for it in the whole text
    named = body.select("doc_ord", F.left(X.first_line(F.col("text")), F.lit(50)).alias("title"), X.split_by_sentences(F.col("text"), limit).alias("pieces"))
    return named.select("doc_ord", "title", F.posexplode("pieces").alias("chunk_no", "text")).select(
        "doc_ord", "chunk_no", "text", F.lit("article").alias("source"), "title", F.lit(None).cast("string").alias("section")
    )


def qa_text(title: Column, question: Column, reply: Column) -> Column:
    """问：title, 补充：question (if any), 答：reply, a line each."""
    return F.concat_ws("\n", F.concat(F.lit("问："), title), F.when(question != "", F.concat(F.lit("补充："), question)), F.concat(F.lit("答："), reply))


def qa_chunks(docs: DataFrame, limit: int = X.CHUNK_CHARS) -> DataFrame:
    """Chunks of forum answers (doc_ord, text); those whose first 答： line is under 10 characters go."""
    small_batches(docs.sparkSession)
    lines = F.split("text", "\n")
    of = lambda mark: F.coalesce(F.try_element_at(F.filter(lines, lambda x: x.startswith(mark)), F.lit(1)), F.lit(""))
    title = F.left(X.strip(F.regexp_replace(of("问："), "^问：", "")), F.lit(50))
    answer = X.strip(F.regexp_replace(of("答："), "^答：", ""))
    kept = docs.withColumn("title", title).filter(F.length(answer) >= 10)
    return kept.select("doc_ord", "title", F.posexplode(X.split_by_sentences(X.strip(F.col("text")), limit)).alias("chunk_no", "text")).select(
        "doc_ord", "chunk_no", "text", F.lit("law_qa").alias("source"), "title", F.lit(None).cast("string").alias("section")
    )


def number_chunks(sources: list[DataFrame]) -> DataFrame:
    """All sources (doc_ord, chunk_no, text, source, title, section) in order, with ``chunk_id`` counting from 0 by source, document and place."""
    every = None
    for i, s in enumerate(sources):
        s = s.withColumn("source_ord", F.lit(i))
        every = s if every is None else every.unionByName(s, allowMissingColumns=True)
    return number_rows(every, "source_ord", "doc_ord", "chunk_no").select("text", "source", "title", "section", F.col("n").alias("chunk_id"))


def length_stats(chunks: DataFrame, *by: str) -> DataFrame:
    n = F.length("text")
    return chunks.groupBy(*by).agg(F.count("*").alias("n"), F.min(n).alias("min_len"), F.max(n).alias("max_len"), F.round(F.avg(n), 6).alias("avg_len"))
