"""Repair of conversations: the cheapest edits that make turns alternate.

Rows are sent to tasks by conversation and sorted there from the last turn to the first. A stream over
the Arrow batches carries the costs of what is still to come for each state of the role pattern, and
keeps per row one byte of back pointers (two bits a state) with the row itself in a spool, which lies in
memory up to ``SPOOL_BYTES`` and in an unnamed file of the task beyond. At a conversation's first row
the spool is read backwards, that is from the first turn on, and the edits follow the pointers.

A conversation is one sequence: its edits depend on all its turns, so one task streams it, whatever its
length, in bounded memory. What needs memory for all of a conversation's texts, telling repeated ones,
is an aggregation of digests before the stream.

The role pattern is ``(s?(ua)+)?`` over the roles' first characters. States: nothing yet, after a system
turn, after a user turn, after an assistant turn. Each state admits one inserted or changed role.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SPOOL_BYTES = 32_000_000
OUT_BYTES = 4_000_000
# Costs of edits and of a truncated turn that stays
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
LETTERS = "DIKR"
# next state by state and role initial
STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
# role that each state admits as an inserted or changed one, and the state after it
WANTED = ("user", "user", "assistant", "user")
AFTER = (2, 2, 3, 2)
# costs and letters after the last row; a state that accepts ends there
END = (0, 6, 3, 0)
END_LETTER = ("", "I", "I", "")
FAULTS = ("blank", "duplicate", "truncated")
REPAIRED = "edit string, fault string, cost long, turn long, was_role string, role string, text string"
_TAIL = struct.Struct("<iiqBBB")


def _transition(costs: tuple, initial: str, fault: str) -> tuple[tuple, int]:
    """Costs from each state with one more row ahead, and the letters chosen, two bits a state.

    Of equal costs the letter that is first in ASCII counts. Inserted turns come before the row.
    """
    stay = TRUNCATED if fault == "truncated" else 0
    free = fault not in ("blank", "duplicate")
    best = []
    for q in range(4):
        found = [(DELETE + costs[q], 0)]
        if free and initial in STEP[q]:
            found.append((stay + costs[STEP[q][initial]], 2))
        if free:
            found.append((REROLE + stay + costs[AFTER[q]], 3))
        best.append(min(found))
    whole = list(best)
    # two turns inserted one after the other lead back to the same role, so one round settles states 2 and 3
    for q in (2, 3, 0, 1):
        onward = best[AFTER[q]] if q > 1 else whole[AFTER[q]]
        whole[q] = min(whole[q], (INSERT + onward[0], 1))
    return tuple(c for c, _ in whole), sum(letter << (2 * q) for q, (_, letter) in enumerate(whole))


class _Conversation:
    """The rows of one conversation, taken from the last to the first."""

    def __init__(self) -> None:
        self.spool = tempfile.SpooledTemporaryFile(max_size=SPOOL_BYTES)  # noqa: SIM115
        self.known: dict = {}
        self.size = 0
        self.start()

    def start(self) -> None:
        if self.size > SPOOL_BYTES:
            self.spool.close()
            self.spool = tempfile.SpooledTemporaryFile(max_size=SPOOL_BYTES)  # noqa: SIM115
        self.spool.seek(0)
        self.spool.truncate()
        self.size, self.costs = 0, END

    def add(self, turn: int | None, role: str, text: str, fault: str) -> None:
        low = min(self.costs)
        at = (tuple(c - low for c in self.costs), role[:1], fault)
        if at not in self.known:
            # few: costs of states differ by at most some inserted turns
            self.known[at] = _transition(*at)
        costs, letters = self.known[at]
        self.costs = tuple(c + low for c in costs)
        r, t = role.encode(), text.encode()
        self.size += self.spool.write(r + t + _TAIL.pack(len(r), len(t), turn or 0, turn is None, ("", *FAULTS).index(fault), letters))

    def rows(self) -> Iterator[tuple[int | None, str, str, str, int]]:
        """turn, role, text, fault and letters from the first turn on."""
        end = self.size
        while end:
            self.spool.seek(end - _TAIL.size)
            nr, nt, turn, missing, fault, letters = _TAIL.unpack(self.spool.read(_TAIL.size))
            end -= _TAIL.size + nr + nt
            self.spool.seek(end)
            body = self.spool.read(nr + nt)
            yield None if missing else turn, body[:nr].decode(), body[nr:].decode(), ("", *FAULTS)[fault], letters

    def edits(self) -> Iterator[tuple]:
        """Rows of ``REPAIRED`` in order."""
        q = 0

        def insert() -> tuple:
            return "I", None, INSERT, None, None, WANTED[q], ""

        for turn, role, text, fault, letters in self.rows():
            while LETTERS[(letters >> (2 * q)) & 3] == "I":
                yield insert()
                q = AFTER[q]
            letter = LETTERS[(letters >> (2 * q)) & 3]
            now, cost = role, TRUNCATED if fault == "truncated" else 0
            if letter == "D":
                cost = DELETE
            elif letter == "K":
                q = STEP[q][role[0]]
            else:
                now, cost, q = WANTED[q], cost + REROLE, AFTER[q]
            yield letter, fault or None, cost, turn, role, now, text
        while END_LETTER[q]:
            yield insert()
            q = AFTER[q]


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text; role and text not null) with ``_blank``, ``_truncated`` and
    ``_again``: whether the conversation has the same role and text at an earlier turn. Copies at the
    same turn lie side by side in the sorted stream, which tells them itself."""
    ends = F.rtrim(F.col("text"), F.lit(SPACES))
    marked = rows.withColumns({"_blank": ends == "", "_truncated": ~F.right(ends, F.lit(1)).isin(".", "!", "?")})
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    marked = marked.withColumn("_digest", F.when(~F.col("_blank"), digest))
    at = F.struct("turn")
    seen = marked.where("_digest is not null").groupBy("conv_id", "_digest").agg(F.min(at).alias("_first"), F.max(at).alias("_latest"))
    # only texts that occur at several turns; where they are few Spark sends them along
    seen = seen.where("_first < _latest").select(F.col("conv_id").alias("_conv"), F.col("_digest").alias("_same"), "_first")
    joined = marked.join(seen, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_digest") == F.col("_same")), "left")
    return joined.withColumn("_again", F.coalesce(F.col("_first") < at, F.lit(False))).drop("_conv", "_same", "_first", "_digest")


def repair(rows: DataFrame) -> DataFrame:
    """Every row of a conversation in order with its edit, and the inserted turns.

    ``rows`` has conv_id (any type), turn, role and text; other columns are ignored. Result: conv_id, seq
    (0, 1, .. within the conversation), edit (K keep, R change the role, D delete, I insert), fault (blank,
    duplicate, truncated or null), cost, turn, was_role, role, text. Deleted rows are marked, not left out.
    The edits are the cheapest ones that bring the roles into the pattern, blank and repeated turns being
    deleted; of equally cheap ones the first in ASCII. Rows lie in order within the partitions of the
    result, and no conversation is divided between partitions.

    Null roles and texts count as one space, which no pattern admits as a role. Turns sort nulls first;
    rows of equal turn by role, then text. Rows without conv_id form one conversation. No rows: no result.
    """
    # ids as text, so that any type, and whole numbers beside nulls, come through pandas unchanged
    plain = rows.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")))
    order = ["conv_id", F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("text").desc()]
    ready = faults(plain).repartition("conv_id").sortWithinPartitions(*order)
    ready = ready.select("conv_id", F.coalesce("turn", F.lit(0)).alias("turn"), F.col("turn").isNull().alias("_unnumbered"), "role", "text", "_blank", "_truncated", "_again")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, out, size = _Conversation(), [], 0
        pending: tuple | None = None

        def settle(before: tuple | None) -> None:
            # the row before it in order is known only now
            _, turn, unnumbered, role, text, blank, truncated, again = pending
            repeated = again or (before is not None and before[1:5] == pending[1:5])
            fault = "blank" if blank else "duplicate" if repeated else "truncated" if truncated else ""
            current.add(None if unnumbered else turn, role, text, fault)

        def frame() -> pd.DataFrame:
            made = dict(zip(["conv_id", "seq", *(c.split()[0] for c in REPAIRED.split(", "))], zip(*out)))
            # beside nulls pandas would turn whole numbers into floating ones
            return pd.DataFrame({**made, "turn": pd.array(made["turn"], dtype="Int64")})

        def finish() -> Iterator[pd.DataFrame]:
            nonlocal out, size
            for seq, line in enumerate(current.edits()):
                out.append((pending[0], seq, *line))
                size += 64 + len(line[-1])
                if size > OUT_BYTES:
                    yield frame()
                    out, size = [], 0
            current.start()

        for pdf in frames:
            for row in zip(*(pdf[c].tolist() for c in pdf.columns)):
                if pending is not None:
                    same = row[0] == pending[0]
                    settle(row if same else None)
                    if not same:
                        yield from finish()
                pending = row
        if pending is not None:
            settle(None)
            yield from finish()
            if out:
                yield frame()

    made = ready.mapInPandas(run, f"conv_id string, seq long, {REPAIRED}")
    return made.withColumn("conv_id", F.col("conv_id").cast(rows.schema["conv_id"].dataType))


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with faults set by the checksum of conversation and turn."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    hurt = rows.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), fate.alias("_fate")).where("_fate <> 0")
    text = F.when(F.col("_fate") == 1, "").when(F.col("_fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_fate") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_fate") == 3, 2).otherwise(1)))
    return hurt.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def summary(repaired: DataFrame) -> DataFrame:
    """One row per conversation of ``repair``'s result: gaps in the turns, faults, illegal neighbours
    before the repair, the cost, the edits' letters, and the digest of the repaired turns.

    Streams the rows where ``repair`` left them, without a shuffle.
    """
    ids = repaired.schema["conv_id"].dataType
    plain = repaired.withColumns({"conv_id": F.col("conv_id").cast("string"), "turn": F.coalesce("turn", F.lit(0)), "_unnumbered": F.col("turn").isNull()})
    names = ("conv_id", "seq", "edit", "fault", "cost", "turn", "_unnumbered", "was_role", "role", "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: list[tuple] = []
        conv = low = high = last = digest = audit = None
        distinct = illegal = cost = 0
        before: str | None = None
        counts: dict[str, int] = {}

        def close() -> None:
            if digest is not None:
                gaps = 0 if low is None else high - low + 1 - distinct
                done.append((conv, gaps, *(counts[f] for f in FAULTS), illegal, cost, b"".join(audit).decode(), digest.hexdigest()))

        def frame() -> pd.DataFrame:
            return pd.DataFrame(done, columns=["conv_id", *(c.split()[0] for c in SUMMARY.split(", "))])

        for pdf in frames:
            for c, seq, edit, fault, price, turn, unnumbered, was, role, text in zip(*(pdf[n].tolist() for n in names)):
                if seq == 0:
                    close()
                    conv, low, high, last, before, first = c, None, None, None, None, True
                    distinct = illegal = cost = 0
                    counts, audit, digest = dict.fromkeys(FAULTS, 0), [], hashlib.sha256()
                cost += price
                audit.append(edit.encode())
                if len(audit) > 4096:
                    audit = [b"".join(audit)]
                if fault:
                    counts[fault] += 1
                if edit != "I":
                    if not unnumbered:
                        low, high = turn if low is None else low, turn
                        distinct, last = distinct + (turn != last), turn
                    if before is not None and before + was[:1] not in ("su", "ua", "au"):
                        illegal += 1
                    before = was[:1]
                if edit != "D":
                    digest.update((("" if first else "\n") + f"{role}:{text}").encode())
                    first = False
            if len(done) > 10_000:
                yield frame()
                done = []
        close()
        if done:
            yield frame()

    return plain.select(*names).mapInPandas(run, f"conv_id string, {SUMMARY}").withColumn("conv_id", F.col("conv_id").cast(ids))


def audited(rows: DataFrame) -> DataFrame:
    """``summary`` of the repair of the damaged ``rows``, with a row of zeros, an empty audit and the
    digest of nothing for conversations that have no rows left."""
    found = summary(repair(damage(rows))).withColumnRenamed("conv_id", "_conv")
    every = rows.select("conv_id").distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")

    def filled(c: str, kind: str) -> Column:
        value = F.col(c)
        if kind == "long":
            return F.coalesce(value, F.lit(0).cast("long")).alias(c)
        return F.coalesce(value, F.lit("" if c == "audit" else hashlib.sha256().hexdigest())).alias(c)

    return joined.select("conv_id", *(filled(*c.split()) for c in SUMMARY.split(", ")))
