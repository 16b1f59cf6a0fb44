import hashlib
import heapq
import random
import re
import zlib

import pytest

from panelcast.llm import conversations
from panelcast.llm.conversations import audited, repair

SCHEMA = "conv_id long, turn long, role string, text string, audit string, cost string, edit string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        fate = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def faults(rows):
    found, seen = [], set()
    for _, role, text in rows:
        plain = re.sub(r"[\x20\x09-\x0D]", "", text)
        found.append("blank" if not plain else "duplicate" if (role, text) in seen else "truncated" if plain[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def cheapest(rows, kinds):
    """All ways to edit, the cheapest first and of equal ones the first in ASCII: no states, only the pattern."""
    pattern = re.compile("(s?(ua)+)?")
    part = re.compile("(s?(ua)*u?)?")
    queue = [(0, "", 0, "", ())]
    while queue:
        cost, audit, at, initials, lines = heapq.heappop(queue)
        if at == len(rows) and pattern.fullmatch(initials):
            return cost, audit, lines
        more = []
        if at < len(rows):
            _, role, text = rows[at]
            more.append((4, "D", at + 1, initials, lines))
            if kinds[at] not in ("blank", "duplicate"):
                stay = 3 if kinds[at] == "truncated" else 0
                more.append((stay, "K", at + 1, initials + (role[:1] or "?"), (*lines, f"{role}:{text}")))
                more += [(3 + stay, "R", at + 1, initials + r[0], (*lines, f"{r}:{text}")) for r in ("user", "assistant")]
        more += [(3, "I", at, initials + r[0], (*lines, f"{r}:")) for r in ("user", "assistant")]
        for price, letter, to, roles, kept in more:
            if part.fullmatch(roles):
                heapq.heappush(queue, (cost + price, audit + letter, to, roles, kept))


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        left = damaged([r for r in rows if r[0] == conv])
        kinds = faults(left)
        turns = [t for t, _, _ in left if t is not None]
        initials = [r[:1] for _, r, _ in left]
        cost, audit, lines = cheapest(left, kinds)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def found(spark, rows):
    got = audited(table(spark, rows))
    assert got.columns[0] == "conv_id"
    return {r.conv_id: tuple(r)[1:] for r in got.collect()}


def test_against_all_ways_to_edit(spark):
    rnd = random.Random(3)
    rows = []
    for conv in range(60):
        for turn in sorted(rnd.sample(range(9), rnd.randint(1, 6))):
            rows.append((conv, turn, rnd.choice(["user", "assistant", "assistant", "system", "tool", None, ""]), rnd.choice(["Yes.", "No!", "cut off", "", " \t\n", "é?  \n", None, "Yes."])))
    assert found(spark, rows) == brute(rows)


def test_awkward_rows(spark):
    rows = [
        (None, 1, "user", "No id."), (None, None, "assistant", "Neither."), (2, None, "user", "a."), (2, None, "user", "a."), (2, None, "user", "b."),
        (3, 5, "user", "x" * 200_000 + "."), (3, 6, "assistant", "same."), (3, 6, "assistant", "same."), (3, 9, "user", "same."), (4, 2**60 + 1, "user", "\U0001F600 é!"),
        (4, 2**60 + 3, "assistant", "ok."), (-5, -3, "system", "s."),
    ]
    rows += [(100 + i, 0, "user", "Only turn.") for i in range(60)]
    got = found(spark, rows)
    assert got == brute(rows)
    gone = [c for c in got if c is not None and not damaged([r for r in rows if r[0] == c])]
    assert gone and all(got[c] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for c in gone)


def test_no_rows(spark):
    assert audited(table(spark, [])).collect() == []
    assert repair(table(spark, []).select("conv_id", "turn", "role", "text")).collect() == []


@pytest.mark.parametrize("spool", [1000, 32_000_000])
def test_one_long_conversation_in_small_memory(spark, monkeypatch, spool):
    monkeypatch.setattr(conversations, "SPOOL_BYTES", spool)
    held = conversations._Conversation()
    rnd = random.Random(4)
    rows = [(t, rnd.choice(["user", "assistant", "tool"]), f"text {t}", rnd.choice(["", "", "blank", "truncated"])) for t in range(3000)]
    for t, role, text, fault in reversed(rows):
        held.add(t, role, text, fault)
    edits = list(held.edits())
    assert [(t, r, x, f or "") for _, f, _, t, r, _, x in edits if t is not None] == rows
    assert sum(e[2] for e in edits) == held.costs[0]
    assert re.fullmatch("(s?(ua)+)?", "".join(e[5][0] for e in edits if e[0] != "D"))
    held.start()
    assert list(held.edits()) == []


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hello."), (1, 2, "user", "Again."), (1, 3, "assistant", "Hello."), (1, 4, "assistant", "Hello."), (1, 5, "assistant", " ")]
    got = [(r.edit, r.fault, r.role, r.text) for r in repair(table(spark, rows)).orderBy("seq").collect()]
    assert got == [("K", None, "user", "Hello."), ("I", None, "assistant", ""), ("K", None, "user", "Again."), ("K", None, "assistant", "Hello."), ("D", "duplicate", "assistant", "Hello."), ("D", "blank", "assistant", " ")]
