"""Conversation structure repair by weighted interval parsing (CYK).

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``. The grammar's
nonterminals are pairs (p, r) of places in that pattern: *from p to r*. In Chomsky normal form

    (p, r) -> (p, q) (q, r)      for every place q in between,
    (p, r) -> one row, kept, given another role, or deleted,
    (p, r) -> inserted rows only (the closure of insertions, part of every row's cells).

A span's cells hold, for each nonterminal, the least (cost, audit): audit is the edits' initials,
Keep, Rerole, Delete, Insert. Cells of a span come from those of its two parts. A derivation of
(p, r) passes some place q wherever its span is split, so one split of a span tells as much as all
of them do, and the chart needs only spans of 1, 2, 4, 8, ... rows, bottom-up by length: n spans and not n^2.
(Audits of equal cost in one cell are never a prefix of one another, since what the longer has more
would be inserted rows, which cost; so the least of a whole is made of the least of its parts.)

Rows are parsed without their texts. They are dealt by ranges of (conversation, turn), which split a
conversation however long, each range parses its piece of a conversation, and the pieces' cells,
which are one row a range, are combined in order. The texts move once, to meet the audit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_join, partitions, small_batches

#: Costs of the edits, and of a truncated row that isn't deleted.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Places: at the start, after a system row, after a user row (an answer is due), after an answer.
START, SYSTEM, ASKED, ANSWERED = range(4)
STEPS = {(START, "s"): SYSTEM, (START, "u"): ASKED, (SYSTEM, "u"): ASKED, (ASKED, "a"): ANSWERED, (ANSWERED, "u"): ASKED}
ENDS = (START, ANSWERED)
ROLES = {"u": "user", "a": "assistant"}
#: The nonterminals that derive anything, and for each the pairs of nonterminals that it may be split into.
PAIRS = [(p, r) for p in range(4) for r in range(4) if p == r and p < ASKED or p < r or (p >= ASKED and r >= ASKED)]
RULES = [[(PAIRS.index((p, q)), PAIRS.index((q, r))) for q in range(4) if (p, q) in PAIRS and (q, r) in PAIRS] for p, r in PAIRS]
#: Rows of the least spans, whose cells are remembered.
LEAF = 8
_WHITE = " \t\n\x0b\x0c\r"
#: Kinds of rows: the initial (other ones than s, u and a: ``o``), in upper case if the row is truncated; ``x`` must go.
GONE, OTHER = "x", "o"
#: The cost, in a table, of what can't be derived.
NEVER = -1
CELLS = "costs array<bigint>, audits array<string>"
PIECE = f"conv_id string, piece int, first string, last string, illegal bigint, first_turn bigint, last_turn bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, {CELLS}"

Cells = tuple[tuple[int, str] | None, ...]


def _combine(x: Cells, y: Cells) -> Cells:
    """The cells of a span from those of its two parts."""
    out = []
    for ways in RULES:
        best = None
        for i, j in ways:
            a, b = x[i], y[j]
            if a is not None and b is not None:
                cost = a[0] + b[0]
                if best is None or cost < best[0] or cost == best[0] and a[1] + b[1] < best[1]:
                    best = (cost, a[1] + b[1])
        out.append(best)
    return tuple(out)


def _cells(found: dict[tuple[int, int], tuple[int, str]]) -> Cells:
    return tuple(found.get(pair) for pair in PAIRS)


@lru_cache
def _inserted() -> Cells:
    """The cells of a span without rows: insertions only, closed under repetition."""
    one = {(p, p): (0, "") for p in range(4)} | {(p, r): (INSERT, "I") for (p, role), r in STEPS.items() if role in ROLES}
    cells = _cells(one)
    while (more := _combine(cells, cells)) != cells:
        cells = more
    return cells


@lru_cache
def _row(kind: str) -> Cells:
    """The cells of one row with any insertions around it."""
    found = {(p, p): (DELETE, "D") for p in range(4)}
    if kind != GONE:
        more = TRUNCATED if kind.isupper() else 0
        for (p, role), r in STEPS.items():
            edits = [(more, "K")] if role == kind.lower() else []
            edits += [(REROLE + more, "R")] if role in ROLES else []
            if edits:
                found[p, r] = min(edits)
    return _combine(_combine(_inserted(), _cells(found)), _inserted())


@lru_cache(maxsize=1 << 16)
def _span(kinds: str) -> Cells:
    if len(kinds) < 2:
        return _row(kinds) if kinds else _inserted()
    half = 1 << (len(kinds) - 1).bit_length() - 1
    return _combine(_span(kinds[:half]), _span(kinds[half:]))


def _up(cells: list[Cells]) -> Cells:
    """The cells of the whole of consecutive spans: pairs, pairs of pairs, and so on."""
    while len(cells) > 1:
        cells = [_combine(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0] if cells else _inserted()


def chart(kinds: str) -> Cells:
    """The cells of a whole span of rows, one character of ``kinds`` each."""
    return _up([_span(kinds[i : i + LEAF]) for i in range(0, len(kinds), LEAF)])


def cheapest(cells: Cells) -> tuple[int, str]:
    """The least (cost, audit) of a whole conversation."""
    return min(c for (p, r), c in zip(PAIRS, cells, strict=True) if p == START and r in ENDS and c is not None)


def _legal(before: str, after: str) -> bool:
    return before + after in ("su", "ua", "au")


def _rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without nulls of role and text, and ``same``, which tells (conv_id, role, text) from others (128 bits)."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    named = F.concat_ws("\n", F.coalesce(F.col("conv_id").cast("string"), F.lit("\t")), F.length(role).cast("string"), role, text)
    return conversations.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.unhex(F.md5(named)).alias("same"))


def _last_mark(text: Column) -> Column:
    return F.substring(F.rtrim(text, F.lit(_WHITE)), -1, 1)


def parse_conversations(conversations: DataFrame) -> DataFrame:
    """A row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    ``conversations``: conv_id, turn, role, text; other columns are not looked at. Rows are taken by
    turn (null ones first), those of one turn by role and a hash of the text, so repeated rows lie
    side by side. A null role or text is one space; a null conv_id is a conversation like any other.
    Each row has one fault at most: ``blank`` (nothing but white space, empty texts too),
    ``duplicate`` (role and text stood earlier), ``truncated`` (the last character that isn't white
    space is none of ``.!?``). Blank and duplicate rows must be deleted. ``gaps`` counts the turns
    that miss between the least and the greatest, ``illegal`` the adjacent rows whose initials are not su, ua or au.
    ``audit`` is the ASCII-least of the cheapest. Texts of any length are looked at whole. An empty
    table gives no rows. Conversations of any number of rows are split over tasks; a row of the
    result holds one letter per row of its conversation.
    """
    spark = conversations.sparkSession
    small_batches(spark)
    text = F.col("text")
    blank = F.length(F.rtrim(text, F.lit(_WHITE))) == 0
    keyed = _rows(conversations).select("conv_id", "turn", "role", "same", blank.alias("blank"), (~blank & ~_last_mark(text).isin(".", "!", "?")).alias("cut_off"))
    # equal rows of one turn are one row with their number, so nothing below has a key with many of them
    keyed = cut(keyed.groupBy("conv_id", "turn", "role", "same", "blank", "cut_off").agg(F.count("*").alias("n")))
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    recur = cut(keyed.groupBy("same").agg(F.min(when).alias("first"), F.count("*").alias("n")).filter("n > 1"))
    later = hot_join(keyed.select("same", "turn", when.alias("when")), recur, "same").filter(F.col("when") > F.col("first"))
    later = later.select(F.col("same").alias("_same"), F.col("turn").alias("_turn"), F.lit(True).alias("later"))
    marked = keyed.join(later, (F.col("_same") == F.col("same")) & F.col("_turn").eqNullSafe(F.col("turn")), "left").withColumn("later", F.coalesce("later", F.lit(False)))
    initial = F.substring("role", 1, 1)
    kind = F.when(F.col("blank") | F.col("later"), GONE).otherwise(F.when(initial.isin("s", "u", "a"), initial).otherwise(OTHER))
    order = ["conv_id", "turn", "role", "same"]
    ranged = marked.select(*order, initial.alias("initial"), "blank", "later", "cut_off", kind.alias("kind"), "n").repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    schema = PIECE.replace("conv_id string", f"conv_id {conversations.schema['conv_id'].dataType.simpleString()}")
    pieces = cut(ranged.drop("same", "role").mapInArrow(_parse_pieces, schema))

    out = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"

    @F.pandas_udf(out)
    def whole(groups: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_assemble(list(g)) for g in groups], columns=[x.split()[0] for x in out.split(", ")])

    parts = F.struct(*[c for c in pieces.columns if c != "conv_id"])
    grouped = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(parts)).alias("parts"))  # a row per range at most
    return cut(grouped.select("conv_id", whole("parts").alias("w")).select("conv_id", "w.*"))


def _parse_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per conversation of a range: the cells of the rows that lie in it, and what counting needs."""
    piece, now, conv, kind_of = TaskContext.get().partitionId(), None, None, None
    names = ["conv_id", *[x.strip().split(" ")[0] for x in PIECE.split(", ")[1:]]]

    def finished() -> dict:
        cells = chart("".join(now.pop("kinds")))
        return {"conv_id": conv, "piece": piece} | now | {"costs": [NEVER if c is None else c[0] for c in cells], "audits": ["" if c is None else c[1] for c in cells]}

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        columns = {k: [r[k] for r in rows] for k in names}
        text, whole = pa.string(), pa.int64()
        kinds = {"conv_id": kind_of, "piece": pa.int32(), "first": text, "last": text, "costs": pa.list_(whole), "audits": pa.list_(text)}
        return pa.RecordBatch.from_arrays([pa.array(columns[k], kinds.get(k, whole)) for k in names], names)

    for batch in batches:
        kind_of, done = batch.schema.field("conv_id").type, []
        columns = batch.to_pydict()
        for c, turn, initial, blank, later, cut_off, kind, n in zip(*(columns[k] for k in ("conv_id", "turn", "initial", "blank", "later", "cut_off", "kind", "n")), strict=True):
            if now is None or c != conv:
                if now is not None:
                    done.append(finished())
                conv = c
                now = {"first": initial, "last": None, "illegal": 0, "first_turn": turn, "last_turn": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "kinds": []}
            if now["last"] is not None:
                now["illegal"] += not _legal(now["last"], initial)
            now["illegal"] += (n - 1) * (not _legal(initial, initial))
            now["last"] = initial
            if turn is not None and turn != now["last_turn"]:
                now["first_turn"] = turn if now["first_turn"] is None else now["first_turn"]
                now["last_turn"], now["turns"] = turn, now["turns"] + 1
            now["blank"] += n * blank
            now["duplicate"] += 0 if blank else n if later else n - 1
            now["truncated"] += cut_off and not later
            now["kinds"].append((kind.upper() if cut_off and not later else kind) + GONE * (n - 1))
        if done:
            yield batch_of(done)
    if now is not None:
        yield batch_of([finished()])


def _assemble(parts: list) -> tuple:
    """The report of a conversation from its pieces, in order."""
    counts = {k: sum(p[k] for p in parts) for k in ("illegal", "turns", "blank", "duplicate", "truncated")}
    least = last_turn = before = None
    for p in parts:
        counts["illegal"] += before is not None and not _legal(before, p["first"])
        before = p["last"]
        if p["turns"]:
            counts["turns"] -= p["first_turn"] == last_turn
            least, last_turn = p["first_turn"] if least is None else least, p["last_turn"]
    cost, audit = cheapest(_up([tuple(None if c == NEVER else (int(c), a) for c, a in zip(p["costs"], p["audits"], strict=True)) for p in parts]))
    gaps = 0 if least is None else last_turn - least + 1 - counts["turns"]
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], counts["illegal"], cost, audit


def repaired_rows(conversations: DataFrame, report: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit (K, R or I), role, text: the rows of the repaired conversations.

    ``report`` is that of `parse_conversations` for the same rows. The rows of a conversation come
    together and in order, in one task, which streams them and holds one batch and one audit at a time.
    """
    spark = conversations.sparkSession
    small_batches(spark)
    rows = _rows(conversations).select("conv_id", F.lit(1).alias("step"), "turn", "role", "same", "text")
    none = lambda c: F.lit(None).cast(rows.schema[c].dataType).alias(c)
    audits = report.select("conv_id", F.lit(0).alias("step"), none("turn"), none("role"), none("same"), F.col("audit").alias("text"))
    both = audits.unionAll(rows).repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "step", "turn", "role", "same")
    kind = conversations.schema["conv_id"].dataType.simpleString()
    return both.drop("same", "turn").mapInArrow(_apply_audits, f"conv_id {kind}, place bigint, edit string, role string, text string")


def _apply_audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, audit, at, place, where, kind_of, out = None, "", 0, 0, START, None, []

    def add(edit: str, role: str | None, text: str) -> None:
        """One row more; rows that are given a role get the one that is due."""
        nonlocal place, where
        initial = role[0] if role else "a" if where == ASKED else "u"
        where = STEPS[where, initial]
        out.append((conv, place, edit, role or ROLES[initial], text))
        place += 1

    def inserted() -> None:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            add("I", None, "")
            at += 1

    def taken() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 5
        out.clear()
        types = [kind_of, pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", "place", "edit", "role", "text"])

    for batch in batches:
        kind_of = batch.schema.field("conv_id").type
        columns = batch.to_pydict()
        for c, step, role, text in zip(*(columns[k] for k in ("conv_id", "step", "role", "text")), strict=True):
            if step == 0:
                inserted()  # what follows the last row of the conversation before
                conv, audit, at, place, where = c, text, 0, 0, START
                continue
            inserted()
            if audit[at] != "D":
                add(audit[at], role if audit[at] == "K" else None, text)
            at += 1
        yield taken()
    inserted()
    if out:
        yield taken()


def digest_rows(repaired: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: of the ``role:text`` of a conversation's rows, newline-joined, as `repaired_rows` hands them out.

    SHA-256 is one chain over all of a conversation, so its texts pass one task, a batch at a time.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, running, kind_of = None, None, None
        for batch in batches:
            kind_of, done = batch.schema.field("conv_id").type, []
            columns = batch.to_pydict()
            for c, place, role, text in zip(*(columns[k] for k in ("conv_id", "place", "role", "text")), strict=True):
                if place == 0:
                    done += [(conv, running.hexdigest())] if running else []
                    conv, running = c, sha256()
                running.update(f"{chr(10) if place else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], kind_of), pa.array([h for _, h in done])], ["conv_id", "repaired_sha256"])
        if running:
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind_of), pa.array([running.hexdigest()])], ["conv_id", "repaired_sha256"])

    return repaired.mapInArrow(hashed, f"conv_id {repaired.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """``conversations`` with the faults that the op11 query plants, by crc32 of ``conv_id:turn`` (nulls: one space) modulo 20.

    0 drops the row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats it, 4 makes the role user.
    """
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", some("conv_id"), some("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(some("text"), ".!?", "")).otherwise(some("text"))
    times = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)
    out = conversations.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(some("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("_each"))
    return out.drop("_each")
