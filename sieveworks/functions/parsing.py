"""Column functions that read labels, verdicts, scores and JSON out of model output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import HAN, clean_keyword, clean_sentence, fix_question_mark, normalise_quotes, once, strip

#: The labels, and the short forms that stand for them.
LABELS = ["法律类", "违规类", "闲聊类"]
DIGITS = {"0": "法律类", "1": "违规类", "2": "闲聊类"}
ABC = {"A": "法律类", "B": "违规类", "C": "闲聊类"}
LRC = {"L": "法律类", "R": "违规类"}
LABEL_KEYS = ["label", "类型", "pred", "category"]
FALLBACK_LABEL = "闲聊类"
QUESTION_KEYS = ["改写问题", "rewritten_question"]
KEYWORD_KEYS = ["关键词", "keywords", "keyword"]
SKIP_PREFIXES = ["问题", "原问题", "用户问题", "输出", "json", "```"]


def _lookup(c: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def json_text(c: Column, key: str) -> Column:
    """The value of a top-level key as text; null if there is none or ``c`` is no JSON."""
    return F.get_json_object(c, f"$['{key}']")


def extract_label(c: Column) -> Column:
    """Lenient: the JSON field 类型 if it is a label, else the first label in the text, else UNKNOWN."""
    field = strip(json_text(strip(c), "类型"))
    found = F.regexp_extract(c, "|".join(LABELS), 0)
    return F.when(field.isin(LABELS), field).when(found != "", found).otherwise("UNKNOWN")


def extract_label_strict(c: Column) -> Column:
    """A ladder: JSON field in any short form, label in the text, a lone A-C, a lone L/R/C, a lone 0-2; else null.

    A rung looks at the text only if those above have found nothing, and the lone marks only if there is any.
    """
    alone = lambda marks: rf"(?<![\p{{L}}\p{{N}}_])([{marks}])(?![\p{{L}}\p{{N}}_])"
    lone = lambda s, marks: F.regexp_extract(s, alone(marks), 1)
    named = lambda v: F.coalesce(_lookup(v, DIGITS), _lookup(F.upper(v), {**LRC, **ABC}), F.when(v.isin(LABELS), v))
    short = lambda body, key: once(strip(json_text(body, key)), named)
    fields = lambda body: F.when(body != "", F.coalesce(*[short(body, key) for key in LABEL_KEYS]))
    anywhere = lambda t: once(F.regexp_extract(t, "|".join(LABELS), 0), lambda x: F.when(x != "", x))

    def marks(t: Column) -> Column:
        upper = lambda u: F.coalesce(_lookup(lone(u, "ABC"), ABC), _lookup(lone(u, "LRC"), {**LRC, "C": ABC["C"]}))
        return F.when(t.rlike(alone("ABCLRabclr0-2")), F.coalesce(once(F.upper(t), upper), _lookup(lone(t, "0-2"), DIGITS)))

    braces = lambda t: F.when(F.contains(t, F.lit("{")), F.regexp_extract(t, r"(?s)\{.*\}", 0)).otherwise("")
    return once(normalise_quotes(F.coalesce(c, F.lit(""))), lambda t: F.coalesce(once(braces(t), fields), anywhere(t), marks(t)))


def balanced_json(c: Column) -> Column:
    """The first balanced ``{...}`` of a text, braces in JSON strings not counted; null without one.

    The text is read in tokens, which are a backslash with what follows it, a mark, or a run of
    anything else; a fold over them carries depth, string state and place.
    """
    text = F.substring(c, F.instr(c, "{"), F.length(c))
    tokens = F.regexp_extract_all(text, F.lit(r"""(?s)\\.|[{}"\\]|[^{}"\\]+"""), 0)
    state = lambda depth, string, n, end: F.struct(depth.alias("depth"), string.alias("string"), n.alias("n"), end.alias("end"))
    start = state(F.lit(0), F.lit(False), F.lit(0), F.lit(0))

    def step(s: Column, token: Column) -> Column:
        # a backslash is an escape within strings only
        mark = F.when(~s["string"] & token.startswith("\\"), F.substring(token, 2, 1)).otherwise(token)
        string = s["string"] != (mark == '"')
        depth = s["depth"] + F.when(~s["string"] & (mark == "{"), 1).when(~s["string"] & (mark == "}"), -1).otherwise(0)
        n = s["n"] + F.length(token)
        closed = ~s["string"] & (mark == "}") & (depth == 0)
        return F.when(s["end"] > 0, s).otherwise(state(depth, string, n, F.when(closed, n).otherwise(0)))

    end = F.aggregate(tokens, start, step, lambda s: s["end"])
    return F.when((F.instr(c, "{") > 0) & (end > 0), F.substring(text, F.lit(1), end))


def _first_text(c: Column, keys: list[str]) -> Column:
    """The first of these JSON fields that isn't blank, stripped."""
    values = F.transform(F.array(*[json_text(c, k) for k in keys]), strip)
    return F.try_element_at(F.filter(values, lambda v: v != ""), F.lit(1))


def _fields(c: Column) -> Column:
    """struct(question, keyword) of a JSON object; null unless it has a question."""
    keyword = F.coalesce(_first_text(c, KEYWORD_KEYS), F.lit(""))
    return once(_first_text(c, QUESTION_KEYS), lambda q: F.when(q.isNotNull(), F.struct(q.alias("question"), keyword.alias("keyword"))))


def _from_json(c: Column, read: Callable[[Column], Column]) -> Column:
    """``read`` of the first code block that has something, of the whole text, or of its first balanced object."""
    blocks = F.regexp_extract_all(c, F.lit(r"(?is)```(?:json|jsonc)?\s*(.*?)\s*```"), 1)
    places = F.concat(blocks, F.array(c), F.array(balanced_json(c)))
    return F.try_element_at(F.filter(F.transform(places, read), lambda x: x.isNotNull()), F.lit(1))


def extract_rewrite(c: Column) -> Column:
    """struct(question, keyword) from the first code block that has them, the whole text, or its first balanced object."""
    return _from_json(c, _fields)


def extract_plain(c: Column, original: Column) -> Column:
    """The first line that can be a rewritten question: Han text, no echo, at least 4 characters."""
    bare = F.transform(F.split(strip(c), "\n"), strip)
    skip = "^(" + "|".join(SKIP_PREFIXES) + ")"
    kept = F.filter(bare, lambda x: (x != "") & ~F.lower(x).rlike(skip))
    lines = F.transform(kept, lambda x: clean_sentence(F.regexp_replace(x, r"(?U)^(改写|答|回答)[：:]\s*", ""), collapse=False))
    return F.try_element_at(F.filter(lines, lambda x: x.rlike(HAN) & (x != strip(original)) & (F.length(x) >= 4)), F.lit(1))


def extract_rewrite_small(c: Column, original: Column) -> Column:
    """struct(question, method): from JSON (rewritten_question), else a plain line, else none."""
    read = lambda x: _first_text(x, ["rewritten_question"])
    found = F.array(F.struct(_from_json(c, read).alias("question"), F.lit("json").alias("method")), F.struct(extract_plain(c, original).alias("question"), F.lit("plain").alias("method")))
    none = F.struct(F.lit(None).cast("string").alias("question"), F.lit("none").alias("method"))
    return F.coalesce(F.try_element_at(F.filter(found, lambda x: x["question"].isNotNull()), F.lit(1)), none)


#: Fixed values of the guard: subjects that must not appear, invented names, leaks of the prompt.
SUBJECTS = ["公司", "我司", "我等", "本公司", "本司"]
NAMES = "小[明红刚丽]|张[三某]|李[四某]|王[五某]"
LEAKS = ["解析", "解释：", "根据法律规定", "核心问题", "改写为", "这个问题"]
LATIN, SLUG = "[A-Za-z]{3,}", "_|[A-Za-z0-9]+-[A-Za-z0-9]+"
#: Sample of traditional characters that a rewrite must not have.
TRADITIONAL = "國無與這開對樣請問領讓條件網絡處則該證驗權利義務視察報告調查評估條款規定協議經濟財產資產"


def added_characters(new: Column, old: Column) -> Column:
    """``new`` less one occurrence of each character of ``old``: the multiset difference, in order."""

    def drop(left: Column, ch: Column) -> Column:
        at = F.position(ch, left)
        return F.when(at > 0, F.concat(F.substring(left, F.lit(1), at - 1), F.substring(left, at + 1, F.length(left)))).otherwise(left)

    return F.aggregate(F.filter(F.split(old, ""), lambda x: x != ""), new, drop)


def rewrite_problem(new: Column, old: Column) -> Column:
    """The first reason to reject a rewritten question, null if there is none."""
    added = added_characters(new, old)
    out = (
        F.when(F.coalesce(new, F.lit("")) == "", "EMPTY_RQ")
        .when(~new.rlike(HAN), "NO_CHINESE")
        .when(new.rlike(LATIN), "ENGLISH_MIXED")
        .when(new.rlike(SLUG), "SLUG_OR_UNDERSCORE")
        .when((old != "") & (F.length(new) > F.length(old) * 1.5), "TOO_LONG")
    )
    for s in SUBJECTS:
        out = out.when(~old.contains(s) & new.contains(s), f"SUBJECT_CHANGED({s})")
    out = out.when(added.rlike(NAMES), "FABRICATED_NAME").when(~strip(new).rlike("[？?]$"), "NO_QUESTION_MARK")
    for s in LEAKS:
        out = out.when(new.contains(s) & ~old.contains(s), f"PROMPT_LEAK({s})")
    return out


def rewrite_problem_small(new: Column, old: Column) -> Column:
    """The looser guard for small models."""
    out = (
        F.when(F.coalesce(new, F.lit("")) == "", "EMPTY_RQ")
        .when(~new.rlike(HAN), "NO_CHINESE")
        .when(new.rlike(LATIN), "ENGLISH_MIXED")
        .when(new.rlike(SLUG), "SLUG_OR_UNDERSCORE")
        .when((old != "") & (F.length(new) > F.length(old) * 3), "TOO_LONG")
        .when((F.length(old) > 10) & (F.length(new) < F.length(old) * 0.3), "TOO_SHORT")
    )
    for s in SUBJECTS:
        out = out.when(~old.contains(s) & new.contains(s), f"SUBJECT_CHANGED({s})")
    return out.when(new.rlike(f"[{TRADITIONAL}]"), "TRADITIONAL_CHINESE").when(~new.rlike("[？?]"), "NO_QUESTION_MARK")


def rewrite_candidate(output: Column) -> Column:
    """struct(question, keyword) of one model answer, cleaned, with its question mark; null if unreadable."""
    clean = lambda got: F.struct(once(clean_sentence(got["question"]), fix_question_mark).alias("question"), clean_keyword(got["keyword"]).alias("keyword"))
    return once(extract_rewrite(output), lambda got: F.when(got.isNotNull(), clean(got)))


def agreement_verdict(c: Column) -> Column:
    """1 for 一致, 0 for 不一致 (looked for first), null if neither is there."""
    return F.when(c.contains("不一致"), 0).when(c.contains("一致"), 1)


def correctness_verdict(c: Column) -> Column:
    """1 if 正确 is there and 错误 isn't, else 0; null for ERROR and no answer, which no count includes."""
    return F.when(c.isNull() | c.isin("", "ERROR"), F.lit(None).cast("int")).otherwise((c.contains("正确") & ~c.contains("错误")).cast("int"))


def score_1_to_10(c: Column) -> Column:
    """10 if the text begins with 10, else its first digit, at least 1; -1 without a digit."""
    digit = F.regexp_extract(c, r"\d", 0)
    return F.when(strip(c).startswith("10"), 10).when(digit == "", -1).otherwise(F.greatest(F.lit(1), digit.try_cast("int")))


def failed_answer(c: Column) -> Column:
    """Answers that no judge counts."""
    return F.coalesce(strip(c), F.lit("")).isin("", "TIMEOUT", "FAIL")
