"""Conversations brought into the grammar (system?) (user assistant)+ by the cheapest edits: Dijkstra over turns and grammar states."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space at the end of a text, after which its last character stands.
BLANKS = " \t\n\x0b\x0c\r"
#: Costs of edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Grammar states: nothing yet, after the system, the user, the assistant; and where each goes with a user's or an assistant's turn.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
_ANSWER = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_ENDS = (EMPTY, ASSISTANT)


class Audit:
    """A string of edits that grows at its end. Equal strings of one pool are one object, and two are compared in steps that grow as the logarithm of their length."""

    __slots__ = ("before", "edit", "length", "jump", "pool")

    def __init__(self, before: Audit | None = None, edit: str = "", pool: dict | None = None):
        self.before, self.edit, self.pool = before, edit, {} if pool is None else pool
        self.length = before.length + 1 if before else 0
        if before is None:
            self.jump = self
        else:
            far = before.jump
            self.jump = far.jump if before.length - far.length == far.length - far.jump.length else before

    def plus(self, edit: str) -> Audit:
        key = (id(self), edit)
        found = self.pool.get(key)
        if found is None:
            found = self.pool[key] = Audit(self, edit, self.pool)
        return found

    def first(self, length: int) -> Audit:
        a = self
        while a.length > length:
            a = a.jump if a.jump.length >= length else a.before
        return a

    def __lt__(self, other: Audit) -> bool:
        n = min(self.length, other.length)
        a, b = self.first(n), other.first(n)
        if a is b:
            return self.length < other.length
        while a.before is not b.before:
            a, b = (a.jump, b.jump) if a.jump is not b.jump else (a.before, b.before)
        return a.edit < b.edit

    def __str__(self) -> str:
        edits, a = [], self
        while a.before is not None:
            edits.append(a.edit)
            a = a.before
        return "".join(reversed(edits))


def cheapest_edits(initials: str, faults: str) -> tuple[int, str]:
    """Cost and audit of the cheapest edits of turns with these role initials and faults (b, d, t, or - for none).

    Edits are K keep, R give the role that the grammar asks for, D delete (a must for b and d), I insert such a turn; the role of R and I is user or
    assistant and follows from the state before it, so the audit alone tells the repaired turns. A node is (turn, state); the queue holds
    (cost, audit, node), so the first accepting end that comes out has the least cost and of those the least audit. Inserting leads to a
    node that a path of at most two inserts reaches more cheaply than one that goes round, so the lattice is finite.
    """
    n, done = len(initials), set()
    queue: list[tuple[int, Audit, int, int]] = [(0, Audit(), 0, EMPTY)]
    while queue:
        cost, audit, i, state = heapq.heappop(queue)
        if i == n and state in _ENDS:
            return cost, str(audit)
        if (i, state) in done:
            continue
        done.add((i, state))
        answer = _ANSWER[state]
        if (i, answer) not in done:
            heapq.heappush(queue, (cost + INSERT, audit.plus("I"), i, answer))
        if i < n:
            heapq.heappush(queue, (cost + DELETE, audit.plus("D"), i + 1, state))
            if faults[i] not in "bd":
                stays = cost + TRUNCATED * (faults[i] == "t")
                heapq.heappush(queue, (stays + REROLE, audit.plus("R"), i + 1, answer))
                after = SYSTEM if initials[i] == "s" and state == EMPTY else answer if initials[i] == _ROLE[answer][0] else None
                if after is not None:
                    heapq.heappush(queue, (stays, audit.plus("K"), i + 1, after))
    raise AssertionError("deleting every turn is always a way")


def repaired(roles: list[str], texts: list[str], audit: str) -> list[tuple[str, str]]:
    """Role and text of the turns that an audit leaves."""
    out: list[tuple[str, str]] = []
    state, i = EMPTY, 0
    for edit in audit:
        answer = _ANSWER[state]
        if edit == "I":
            out.append((_ROLE[answer], ""))
            state = answer
            continue
        if edit != "D":
            state = SYSTEM if edit == "K" and state == EMPTY and roles[i][:1] == "s" else answer
            out.append((roles[i] if edit == "K" else _ROLE[answer], texts[i]))
        i += 1
    return out


def with_fault(turns: DataFrame) -> DataFrame:
    """Add fault to conv_id, turn, role, text: b blank, t truncated (the last character that isn't white space ends no sentence), or -; duplicates are marked where turns meet."""
    last = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    return turns.withColumn("fault", F.when(last == "", "b").when(~last.isin(".", "!", "?"), "t").otherwise("-"))


def repair(turns: DataFrame) -> DataFrame:
    """One row for each conversation of turns (conv_id, turn, role, text), repaired into (system?) (user assistant)+ or nothing.

    Columns: conv_id, n_turns, gaps (turn numbers missing between the least and the greatest; nulls don't count), blank, duplicate (role and text of an earlier turn),
    truncated (each turn has its first fault only), illegal (neighbours other than system user, user assistant, assistant user), cost and audit of
    cheapest_edits(), and turns (array of role, text), what is left. Turns stand in order of turn, nulls first, then role, then text, so rows that share a number have a
    fixed order; repeated rows are duplicates. Null roles and texts count as empty; a null conv_id is a conversation of its own; other columns are
    dropped. An empty table gives an empty table. A conversation is one row of the result and so has to fit into one task, as its audit does; nothing else is gathered.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_fault(rows).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "fault"))).alias("rows"))
    conv_type = turns.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(_repair_batches, f"conv_id {conv_type}, n_turns long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, turns array<struct<role:string,text:string>>")


_COUNTS = ("n_turns", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def _repair_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[str, list[int]] = {c: [] for c in _COUNTS}
        audits, left = [], []
        for rows in batch.column("rows"):
            rows = rows.as_py()
            roles, texts, seen, faults = [r["role"] for r in rows], [r["text"] for r in rows], set(), []
            for r in rows:
                key = (r["role"], r["text"])
                faults.append(r["fault"] if r["fault"] == "b" else "d" if key in seen else r["fault"])
                seen.add(key)
            initials = [r[:1] or "-" for r in roles]
            numbers = {r["turn"] for r in rows} - {None}
            cost, audit = cheapest_edits("".join(initials), "".join(faults))
            illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
            gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
            for c, v in zip(_COUNTS, (len(rows), gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost)):
                counts[c].append(v)
            audits.append(audit)
            left.append([{"role": r, "text": t} for r, t in repaired(roles, texts, audit)])
        columns = [batch.column("conv_id"), *[pa.array(counts[c], pa.int64()) for c in _COUNTS], pa.array(audits, pa.string()), pa.array(left, _TURNS)]
        yield pa.RecordBatch.from_arrays(columns, names=["conv_id", *_COUNTS, "audit", "turns"])


def text_of(turns: Column) -> Column:
    """role:text of every turn, each on a line of its own."""
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
