"""Column functions for cleaning and splitting text.

Regular expressions use Java's Unicode classes ``(?U)``, so that white space and digits mean
the same as in other Unicode-aware engines (an ideographic space is white space). Lengths are
code points. All functions keep null as null.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The numerals of headings, and the four heading levels of statutes, from the top.
NUMERALS = "一二三四五六七八九十百千零"
LEVELS = {"part": "编", "chapter": "章", "section": "节", "article": "条"}
CHUNK_CHARS = 512
SENTENCE_ENDS = "。；"
PARAGRAPH_BREAK = "\n\n"
#: Unicode's white space, which is what ``(?U)\\s`` matches.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def heading(level: str) -> str:
    """Pattern of a heading at a line's start; white space must follow it."""
    return rf"(?mU)^第[{NUMERALS}\d]+{LEVELS[level]}[\s　]"


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)`` with ``c`` computed once, however often ``f`` names it."""
    return F.transform(F.array(c), f)[0]


def strip(c: Column) -> Column:
    """Trim all Unicode white space at both ends. (A pattern would be tried at every character.)"""
    return F.btrim(c, F.lit(WHITE))


#: What is cleaned from markup, in this order, and what takes its place.
CLEANED = [
    (r"(?s)<!--.*?-->", ""),
    (r"(?mU)^#{1,6}\s+", ""),
    (r"\*\*(.+?)\*\*", "$1"),
    (r"__(.+?)__", "$1"),
    (r"\*(.+?)\*", "$1"),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"\n{3,}", "\n\n"),
]


def clean_markdown(c: Column) -> Column:
    """Drop comments and heading marks, unwrap emphasis and links, squeeze blank lines, strip."""
    for pattern, to in CLEANED:
        c = F.regexp_replace(c, pattern, to)
    return strip(c)


def split_at(c: Column, pattern: str, mark: str | None = None) -> Column:
    """Parts that begin where ``pattern`` matches (multi-line patterns), stripped, blank ones dropped.

    The part before the first match stays if it isn't blank. A text without a match comes back
    as it is, or as no part if it is blank. ``mark`` is a string that stands in every match: texts without it aren't searched.
    """
    bare = pattern.split(")", 1)[1] if pattern.startswith("(?") else pattern
    flags = pattern[: len(pattern) - len(bare)]
    whole = F.when(c.rlike(r"(?U)\S"), F.array(c)).otherwise(F.array().cast("array<string>"))
    blank = lambda parts: F.filter(F.transform(parts, strip), lambda p: p != "")
    # several raw parts mean a match; the pattern is looked for only if there is one
    cut = F.transform(F.array(F.split(c, f"{flags}(?={bare})")), lambda raw: F.when((F.size(raw) > 1) | raw[0].rlike(pattern), blank(raw)).otherwise(whole))
    return F.when(c.isNotNull(), cut[0] if mark is None else F.when(F.contains(c, F.lit(mark)), cut[0]).otherwise(whole))


def _packed(parts: Iterable[str], limit: int, joint: str, oversize: Callable[[str], list[str]]) -> list[str]:
    """Greedy packing: parts are appended to a piece while it stays within ``limit``.

    A part that is too long by itself goes through ``oversize``. Time is linear in the text.
    """
    out: list[str] = []
    held: list[str] = []
    size = 0

    def flush() -> None:
        nonlocal size
        out.extend(x for x in [joint.join(held).strip()] if x)
        held.clear()
        size = 0

    for part in parts:
        if size + len(part) + len(joint) <= limit:
            size += len(part) + (len(joint) if held else 0)
            held.append(part)
            continue
        flush()
        if len(part) <= limit:
            held.append(part)
            size = len(part)
        else:
            out += oversize(part)
    flush()
    return out


def pack_sentences(text: str | None, limit: int = CHUNK_CHARS, ends: str = SENTENCE_ENDS) -> list[str] | None:
    """`split_by_sentences` of one text."""
    if text is None or len(text) <= limit:
        return None if text is None else [text] if text.strip() else []
    hard = lambda part: [x for i in range(0, len(part), limit) if (x := part[i : i + limit].strip())]
    end = re.escape(ends)
    return _packed(re.findall(f"[^{end}]*[{end}]|[^{end}]+", text), limit, "", hard)


def pack_paragraphs(text: str | None, limit: int = CHUNK_CHARS, ends: str = SENTENCE_ENDS, joint: str = PARAGRAPH_BREAK) -> list[str] | None:
    """`merge_paragraphs` of one text."""
    if text is None or len(text) <= limit:
        return None if text is None else [x for x in [text.strip()] if x]
    paragraphs = (p for x in text.split(joint) if (p := x.strip()))
    return _packed(paragraphs, limit, joint, lambda p: pack_sentences(p, limit, ends))


def split_by_sentences(c: Column, limit: int = CHUNK_CHARS, ends: str = SENTENCE_ENDS) -> Column:
    """Pieces of at most ``limit`` code points, packed from sentences that end in one of ``ends``.

    A text within the limit is its own piece, unstripped (none if blank); a sentence beyond it
    is cut hard, and its rest joins no other sentence. An Arrow function: a fold in built-in ones
    would copy all pieces found so far at every sentence.
    """

    @F.arrow_udf("array<string>")
    def pack(texts: pa.Array) -> pa.Array:
        return pa.array([pack_sentences(t, limit, ends) for t in texts.to_pylist()], pa.list_(pa.string()))

    return pack(c)


def merge_paragraphs(c: Column, limit: int = CHUNK_CHARS, ends: str = SENTENCE_ENDS, joint: str = PARAGRAPH_BREAK) -> Column:
    """Pieces of at most ``limit`` code points, packed from paragraphs; longer ones go by sentences."""

    @F.arrow_udf("array<string>")
    def pack(texts: pa.Array) -> pa.Array:
        return pa.array([pack_paragraphs(t, limit, ends, joint) for t in texts.to_pylist()], pa.list_(pa.string()))

    return pack(c)


def merge_each(texts: Column, limit: int = CHUNK_CHARS) -> Column:
    """`merge_paragraphs` of every text of an array that is over ``limit``; the others as they are, and not sent to Python: an array of arrays."""

    @F.arrow_udf("array<array<string>>")
    def pack(lists: pa.Array) -> pa.Array:
        return pa.array([None if x is None else [pack_paragraphs(t, limit) for t in x] for x in lists.to_pylist()], pa.list_(pa.list_(pa.string())))

    long = F.transform(texts, lambda t: F.when(F.length(t) > limit, t))
    return F.transform(F.arrays_zip(texts.alias("text"), pack(long).alias("pieces")), lambda x: F.coalesce(x["pieces"], F.array(x["text"])))


def first_line(c: Column) -> Column:
    return strip(F.substring_index(c, "\n", 1))


def header_of(c: Column, level: str) -> Column:
    """The first line of a text that begins with a heading of ``level``, else empty."""
    return F.when(c.rlike(heading(level).replace("(?mU)", "(?U)")), first_line(c)).otherwise("")


def is_pure_header(c: Column) -> Column:
    """A single line that is a heading and no more."""
    return (F.instr(strip(c), "\n") == 0) & strip(c).rlike(rf"(?U)^第[{NUMERALS}\d]+[编章节]\s")


def structure_context(c: Column) -> Column:
    """The first part, chapter and section headings of a text, joined by `` > ``."""
    lines = [F.regexp_extract(c, rf"(?mU)^(第[{NUMERALS}\d]+{LEVELS[k]}\s[^\n]*)$", 1) for k in ("part", "chapter", "section")]
    return F.concat_ws(" > ", *[F.when(x != "", strip(x)) for x in lines])


def norm(c: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(c, r"(?U)\s+", "")


#: The quotes that are trimmed from model output.
QUOTES = "\"'“”‘’"


def clean_sentence(c: Column, collapse: bool = True) -> Column:
    """Trim quotes at both ends; runs of question marks become one full-width mark."""
    c = strip(F.regexp_replace(strip(c), f"^[{QUOTES}]+|[{QUOTES}]+$", ""))
    return F.regexp_replace(c, "[？?]{2,}", "？") if collapse else c


def fix_question_mark(c: Column) -> Column:
    return F.when((c == "") | c.rlike("[？?]$"), c).otherwise(F.concat(c, F.lit("？")))


HAN = r"[\x{4e00}-\x{9fff}]"


def clean_keyword(c: Column) -> Column:
    """Without quotes; the first of its parts that has a Han character, else all of it."""
    bare = strip(F.regexp_replace(c, f"[{QUOTES}]", ""))
    parts = F.filter(F.split(bare, r"(?U)[,，、\s]+"), lambda p: p.rlike(HAN))
    return F.coalesce(F.try_element_at(parts, F.lit(1)), bare)


def normalise_quotes(c: Column) -> Column:
    """Curly double quotes and the full-width colon in their ASCII forms, stripped; single quotes stay."""
    return strip(F.translate(c, "“”：", '"":'))


def tokens(c: Column) -> Column:
    """Lower-cased words of at least two letters or digits, in order, repeats kept."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 1)


def han_bigrams(c: Column) -> Column:
    """Overlapping pairs of Han characters: a tokenizer for text without spaces."""
    runs = F.filter(F.split(c, r"[^\x{4e00}-\x{9fff}]+"), lambda r: F.length(r) > 1)
    return F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))


#: The letters that `letter_counts` counts.
LETTERS = "etaoinsr"


def letter_counts(c: Column, letters: str = LETTERS) -> Column:
    """How often a text has each of ``letters``, as an array of doubles (lower case counts, null is empty)."""
    text = F.coalesce(c, F.lit(""))
    return F.array(*[((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(x), F.lit("")))) / F.lit(len(x.encode()))).cast("double") for x in letters])
