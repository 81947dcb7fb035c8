"""Prompts and replies as column expressions. Wordings are parameters; the formats are fixed."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How contexts are numbered and joined, how rows of a batch are, and the chat markers.
CONTEXT_MARK, CONTEXT_JOINT = "[参考文档%d] %s", "\n\n"
BATCH_MARK, BATCH_JOINT = "[%d] 问题: %s\n回答: %s", "\n\n---\n\n"
TURN = "<|im_start|>%s\n%s<|im_end|>\n"
GENERATE = "<|im_start|>assistant\n"
WITH_CONTEXT = "请根据以下参考文档回答问题。\n\n参考文档:\n{contexts}\n\n问题: {question}\n\n回答:"
WITHOUT_CONTEXT = "请回答以下问题。\n\n问题: {question}\n\n回答:"
SYSTEM = "You are a helpful assistant."
BATCH_SIZE = 5


def render(template: str, **values: Column) -> Column:
    """``template`` with its ``{name}`` fields filled in; doubled braces are plain ones.

    A field without a value, and a lone brace, are an error before any row is read.
    """
    parts: list[Column] = []
    for literal, field in re.findall(r"((?:[^{}]|\{\{|\}\})*)(\{\w+\}|$)", template):
        parts.append(F.lit(literal.replace("{{", "{").replace("}}", "}")))
        if field:
            parts.append(F.coalesce(values[field[1:-1]].cast("string"), F.lit("")))
    if re.search(r"[{}]", re.sub(r"\{\{|\}\}|\{\w+\}", "", template)):
        raise ValueError("a template's own braces must be doubled")
    return F.concat(*parts)


def number_contexts(contexts: Column) -> Column:
    return F.array_join(F.transform(contexts, lambda c, i: F.format_string(CONTEXT_MARK, i + 1, c)), CONTEXT_JOINT)


def build_prompt(question: Column, contexts: Column, with_context: str = WITH_CONTEXT, without: str = WITHOUT_CONTEXT) -> Column:
    """The prompt with numbered contexts, or the plain one if there are none."""
    none = F.coalesce(F.size(contexts), F.lit(0)) <= 0
    return F.when(none, render(without, question=question)).otherwise(render(with_context, question=question, contexts=number_contexts(contexts)))


def batch_prompts(rows: DataFrame, order: str, size: int = BATCH_SIZE) -> DataFrame:
    """batch, n, body for rows (order, question, reply): ``size`` rows in a prompt, numbered from 0.

    ``order`` counts the rows from 0, so a batch is a division and no window spans the table.
    """
    batch = F.floor(F.col(order) / size).alias("batch")
    item = F.struct((F.col(order) % size).cast("int").alias("i"), F.col("question").alias("q"), F.col("reply").alias("r"))
    listed = rows.groupBy(batch).agg(F.sort_array(F.collect_list(item)).alias("x"))
    return listed.select("batch", F.size("x").alias("n"), F.array_join(F.transform("x", lambda x: F.format_string(BATCH_MARK, x["i"], x["q"], x["r"])), BATCH_JOINT).alias("body"))


def chat_template(messages: Column, system: str = SYSTEM, generate: bool = True) -> Column:
    """Messages (array of struct(role, content)) in chat markup; a system turn comes first in any case."""
    turn = lambda m: F.format_string(TURN, m["role"], m["content"])
    first = F.when(F.coalesce(F.try_element_at(messages, F.lit(1))["role"], F.lit("")) == "system", F.lit("")).otherwise(F.format_string(TURN, F.lit("system"), F.lit(system)))
    return F.concat(first, F.array_join(F.transform(messages, turn), ""), F.lit(GENERATE if generate else ""))


def conversation_text(conversations: DataFrame, system: str = SYSTEM, generate: bool = False) -> DataFrame:
    """conv_id, chat: each conversation's turns in order."""
    m = F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return conversations.groupBy("conv_id").agg(m.alias("m")).select("conv_id", chat_template(F.col("m"), system, generate).alias("chat"))


def format_hits(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, reply: numbered hits (rank, source, section, text, rerank_score) under a header, or a notice of none."""
    where = F.concat(F.lit("来源: "), F.coalesce("source", F.lit("未知来源")), F.when(F.coalesce("section", F.lit("")) != "", F.concat(F.lit(" > "), "section")).otherwise(""))
    part = F.format_string("【法条 %d】(相关度: %.4f)\n%s\n内容: %s\n", F.col("rank"), F.bround(F.coalesce("rerank_score", F.lit(0.0)), 4), where, F.col("text"))
    listed = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", part.alias("p")))).alias("x"))
    body = F.concat(F.format_string("检索到 %d 条相关法律规定：\n\n", F.size("x")), F.array_join(F.transform("x", lambda p: p["p"]), "\n"))
    nothing = F.concat(F.lit("未找到与「"), F.col("query"), F.lit("」相关的法律条文。"))
    return queries.select("query_id", "query").join(listed, "query_id", "left").select("query_id", F.coalesce(body, nothing).alias("reply"))


def model_tag(model: Column) -> Column:
    """The last part of a model's path-like name."""
    return F.element_at(F.split(model, "/"), -1)
