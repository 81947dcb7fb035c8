"""Conversation repair against a plain loop over damaged rows and a shortest-path search."""

import hashlib
import random
from itertools import product
from zlib import crc32

import pytest

from sieveworks.llm import conversations as C
from sieveworks.llm import queries

WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, cost long, audit string, kind string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        some = lambda x: " " if x is None else str(x)
        d = crc32(f"{some(conv)}:{some(turn)}".encode()) % 20
        role, text = "user" if d == 4 else some(role), some(text)
        text = "" if d == 1 else text.translate(str.maketrans("", "", ".!?")) if d == 2 else text
        out += [(conv, turn, role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def search(rows, marks):
    """(cost, audit, repaired rows) by relaxing (row, place) states, with insertions as steps of their own."""
    step = lambda place, initial: {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((place, initial))
    now = {"": (0, "", ())}
    for i in range(len(rows) + 1):
        for _ in range(4):  # insertions
            for place, (cost, audit, kept) in list(now.items()):
                for role in ("user", "assistant"):
                    if (to := step(place, role[0])) is not None:
                        new = (cost + 5, audit + "I", (*kept, (role, "")))
                        if to not in now or new[:2] < now[to][:2]:
                            now[to] = new
        if i == len(rows):
            break
        (role, text), mark, after = rows[i], marks[i], {}
        for place, (cost, audit, kept) in now.items():
            ways = [(place, cost + 2, "D", kept)]
            if mark not in ("blank", "duplicate"):
                more = 5 * (mark == "truncated")
                ways += [(step(place, role[:1]), cost + more, "K", (*kept, (role, text)))]
                ways += [(step(place, r[0]), cost + more + 1, "R", (*kept, (r, text))) for r in ("user", "assistant")]
            for to, c, edit, k in ways:
                if to is not None and (to not in after or (c, audit + edit) < after[to][:2]):
                    after[to] = (c, audit + edit, k)
        now = after
    return min((now[p] for p in ("", "a") if p in now), key=lambda x: x[:2])


def expected(rows, originals):
    out = []
    for conv in dict.fromkeys(originals):
        mine = [r for r in rows if r[0] == conv]
        text = [(r[2], r[3]) for r in mine]
        marks = faults(text)
        turns = {r[1] for r in mine} - {None}
        cost, audit, kept = search(text, marks)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(text, text[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out.append((conv, gaps, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"), illegal, cost, audit, digest))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("pad", ["s", "u", "a"])
def test_cells_equal_a_search_over_all_short_conversations(pad):
    texts = {"o": ("tool", "x."), "x": ("user", "")} | {r: (n, f"{r}.") for r, n in (("s", "system"), ("u", "user"), ("a", "assistant"))}
    for kinds in product("suaSUAoOx", repeat=3):
        kinds = (pad, *kinds)
        rows = [(texts[k.lower()][0], "" if k == "x" else f"{i}{'' if k.isupper() else '.'}") for i, k in enumerate(kinds)]
        assert C.cheapest(C.chart("".join(kinds))) == search(rows, faults(rows))[:2], kinds


def test_dyadic_spans_equal_all_splits():
    rnd = random.Random(1)
    for _ in range(40):
        kinds = "".join(rnd.choices("suaSUAoOx", [1, 6, 6, 1, 1, 1, 1, 1, 2], k=rnd.randint(0, 40)))
        cells = {(i, i + 1): C._row(k) for i, k in enumerate(kinds)}
        for n in range(2, len(kinds) + 1):
            for i in range(len(kinds) - n + 1):
                split = [C._combine(cells[i, m], cells[m, i + n]) for m in range(i + 1, i + n)]
                cells[i, i + n] = tuple(min((x for x in c if x is not None), default=None) for c in zip(*split, strict=True))
        whole = cells.get((0, len(kinds)), C._inserted())
        assert C.chart(kinds) == whole


def test_query_equals_a_plain_loop(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    left = sorted(damaged(rows), key=lambda r: (r[0], r[1]))
    got = [tuple(r) for r in queries.QUERIES["op11_conversation_repair"](spark, sf_dir).select(COLUMNS).collect()]
    assert sorted(got, key=str) == expected(left, [r[0] for r in rows])


def both(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    report = C.parse_conversations(df)
    digests = {r.conv_id: r.repaired_sha256 for r in C.digest_rows(C.repaired_rows(df, report)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return sorted(((*r, digests.get(r[0], empty)) for r in report.select(COLUMNS[:-1]).collect()), key=str)


def test_odd_rows(spark):
    rows = [
        (1, None, None, None), (1, None, "user", "first."), (1, 4, "assistant", "x" * 300_000), (1, 9, "", "role is empty!"),
        (2, 0, "user", "same."), (2, 0, "user", "same."), (2, 3, "user", "same."), (2, 4, "assistant", " "), (3, None, "system", " \t\r\n\x0b\x0c"),
        (None, 1, "system", "s!"), (None, 2, "assistant", "a?  \n"), (4, 5, "tool", "t."), (5, 1, "system", "alone."),
    ]
    rows = sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or " "))
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert both(spark, rows) == expected(plain, [r[0] for r in rows])
    assert both(spark, []) == []


def test_one_conversation_holds_most_rows(spark):
    """Split over several ranges; its most frequent row stands thousands of times."""
    rnd = random.Random(3)
    rows = [(7, t, rnd.choice(["user", "assistant", "assistant", "system"]), rnd.choice(["ok.", "yes", f"t{t}.", f"t{t}"])) for t in range(3000)]
    rows += [(7, 1500, "user", "ok.")] * 2000 + [(i, t, ("user", "assistant")[t % 2], f"{i} {t}.") for i in range(20, 60) for t in range(4)]
    rows = sorted(rows, key=lambda r: (r[0], r[1], r[2]))
    assert both(spark, rows) == expected(rows, [r[0] for r in rows])


def test_repaired_rows_are_well_formed(spark, sf_dir):
    left = C.damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    convs = {}
    for r in C.repaired_rows(left, C.parse_conversations(left)).collect():
        convs.setdefault(r.conv_id, []).append(r)
    for mine in convs.values():
        mine.sort(key=lambda r: r.place)
        roles = [r.role[0] for r in mine]
        roles = roles[1:] if roles[0] == "s" else roles
        assert roles == ["u", "a"] * (len(roles) // 2) and roles
        assert all(r.text == "" for r in mine if r.edit == "I")

