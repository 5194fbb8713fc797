"""Repair of conversation structure by Knuth's lightest derivations.

A conversation should read ``(s?(ua)+)?`` by the first letters of its roles.
What is known about it are items: that a turn is there, and that the turns
before one are edited so that the output ends in a certain state.  Edits are
deductions from items to items; each adds to a cost and appends a letter to an
audit.  An agenda pops the item of the least ``(cost, audit)``, whose value is
then final (Knuth, 1977), until the goal is popped.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
#: Turns that one agenda works on; longer conversations go on from its final items.
SEGMENT = 64
#: Agenda results a task remembers by the letters and faults of the turns.
REMEMBERED = 50_000
#: Rows of a result batch.
BATCH = 4096

#: The output state after a role's first letter: nothing yet, after system, after user, after assistant.
_NEXT = {("-", "s"): "s", ("-", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
_ENDS = ("-", "a")
_ROLE = {"u": "user", "a": "assistant"}
FAULTS = {"blank": "b", "duplicate": "d", "truncated": "t"}

EDITS_SCHEMA = "conv_id {id}, step long, edit string, cost long, turn long, was string, fault string, role string, text string"
REPORT_SCHEMA = "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

Value = tuple[int, str]


def deductions(item: tuple, turns: list[tuple[str, str]], closing: bool) -> Iterator[tuple[tuple, tuple, int, str]]:
    """``(antecedents, consequent, cost, letter)`` of every deduction that uses ``item``.

    Items are ``("turn", i, "")``, ``("done", i, state)`` and ``("goal", n, "")``.
    A turn is its role's first letter and its fault's letter.
    """
    kind, i, state = item
    if kind == "turn":
        for before in ("-", "s", "u", "a"):
            yield from _edits(("done", i, before), item, turns[i])
    elif kind == "done":
        for x in "ua":
            if (state, x) in _NEXT:
                yield (item,), ("done", i, _NEXT[state, x]), INSERT_COST, INSERT
        if i < len(turns):
            yield from _edits(item, ("turn", i, ""), turns[i])
        elif closing and state in _ENDS:
            yield (item,), ("goal", i, ""), 0, ""


def _edits(done: tuple, turn: tuple, own: tuple[str, str]) -> Iterator[tuple[tuple, tuple, int, str]]:
    (letter, fault), (_, i, state) = own, done
    yield (done, turn), ("done", i + 1, state), DELETE_COST, DELETE
    if fault in "bd":
        return
    more = TRUNCATED_COST if fault == "t" else 0
    if (state, letter) in _NEXT:
        yield (done, turn), ("done", i + 1, _NEXT[state, letter]), more, KEEP
    for x in "ua":
        if (state, x) in _NEXT:
            yield (done, turn), ("done", i + 1, _NEXT[state, x]), REROLE_COST + more, REROLE


def lightest(seeds: dict[str, Value], turns: list[tuple[str, str]], closing: bool) -> dict[str, Value]:
    """Final values after the last turn: of the goal, as ``{"": value}``, or of each output state.

    Every deduction adds its antecedents' costs and joins their audits in order,
    so a consequent is never lighter than an antecedent, and a lighter
    antecedent never makes a heavier consequent: two audits of one item and
    cost edit the same turns, so neither is the beginning of the other.
    """
    agenda: list[tuple[int, str, tuple]] = [(0, "", ("turn", i, "")) for i in range(len(turns))]
    agenda += [(cost, audit, ("done", 0, state)) for state, (cost, audit) in seeds.items()]
    heapq.heapify(agenda)
    final: dict[tuple, Value] = {}
    while agenda:
        cost, audit, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = (cost, audit)
        if item[0] == "goal":
            return {"": (cost, audit)}
        for antecedents, consequent, more, letter in deductions(item, turns, closing):
            if consequent not in final and all(a in final for a in antecedents):
                values = [final[a] for a in antecedents]
                heapq.heappush(agenda, (sum(v[0] for v in values) + more, "".join(v[1] for v in values) + letter, consequent))
    return {state: final["done", len(turns), state] for state in "-sua" if ("done", len(turns), state) in final}


def worth(live: dict[str, Value]) -> dict[str, Value]:
    """States that can still lie on the lightest way.

    What can follow ``s`` can follow ``a`` as well; what can follow nothing can
    do so too once its system turn, if it keeps one, is deleted.
    """
    if "a" not in live:
        return live
    after = live["a"][0]
    bound = {"-": after + DELETE_COST, "s": after}
    return {q: v for q, v in live.items() if q not in bound or v[0] <= bound[q]}


class _Conversation:
    """Reads a conversation's turns in order and gives its edits as soon as all live ways agree on them."""

    def __init__(self, memory: dict):
        self.memory = memory
        self.live: dict[str, Value] = {"-": (0, "")}
        self.state, self.step = "-", 0
        self.turns: list[tuple] = []
        self.fresh = 0

    def add(self, turn: tuple) -> Iterator[tuple]:
        if self.fresh == SEGMENT:
            yield from self.solve(False)
        self.turns.append(turn)
        self.fresh += 1

    def close(self) -> Iterator[tuple]:
        yield from self.solve(True)

    def solve(self, closing: bool) -> Iterator[tuple]:
        new = self.turns[len(self.turns) - self.fresh :]
        shape = "".join(t[4] + t[5] for t in new)
        # values are remembered without what all live ways share
        least = min(c for c, _ in self.live.values())
        key = (shape, closing, tuple((q, c - least, w) for q, (c, w) in self.live.items()))
        found = self.memory.get(key)
        if found is None:
            seeds = {q: (c - least, w) for q, (c, w) in self.live.items()}
            found = lightest(seeds, [(shape[k], shape[k + 1]) for k in range(0, len(shape), 2)], closing)
            if len(self.memory) >= REMEMBERED:
                self.memory.clear()
            if len(shape) <= 2 * SEGMENT:
                self.memory[key] = found
        self.live = worth({q: (c + least, w) for q, (c, w) in found.items()})
        self.fresh = 0
        agreed = os.path.commonprefix([w for _, w in self.live.values()])
        self.live = {q: (c, w[len(agreed) :]) for q, (c, w) in self.live.items()}
        yield from self.edits(agreed)

    def edits(self, letters: str) -> Iterator[tuple]:
        """``(step, edit, cost, turn, was, fault, role, text)`` of the agreed letters."""
        at = 0
        for edit in letters:
            cost = {KEEP: 0, REROLE: REROLE_COST, DELETE: DELETE_COST, INSERT: INSERT_COST}[edit]
            if edit == INSERT:
                turn = was = fault = None
                role, text = self.expected(), ""
            else:
                turn, was, text, fault, letter, _ = self.turns[at]
                at += 1
                role = was if edit == KEEP else None if edit == DELETE else self.expected()
                text = None if edit == DELETE else text
                cost += TRUNCATED_COST if fault == "truncated" and edit != DELETE else 0
                if edit == KEEP:
                    self.state = _NEXT[self.state, letter]
            if edit in (REROLE, INSERT):
                self.state = _NEXT[self.state, role[0]]
            yield self.step, edit, cost, turn, was, fault, role, text
            self.step += 1
        self.turns = self.turns[at:]

    def expected(self) -> str:
        """The role that a changed or new turn takes here."""
        return _ROLE["a" if self.state == "u" else "u"]


def _editing(id_type: pa.DataType):
    fields = [("conv_id", id_type), ("step", pa.int64()), ("edit", pa.string()), ("cost", pa.int64()), ("turn", pa.int64()), ("was", pa.string()), ("fault", pa.string()), ("role", pa.string()), ("text", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict = {}
        out: list[tuple] = []
        open_id, conversation = None, None

        def packed():
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*out), fields)], [n for n, _ in fields])

        def closed():
            before = conversation.step
            out.extend((open_id, *e) for e in conversation.close())
            if before == 0 and conversation.step == 0:
                out.append((open_id, 0, *[None] * 7))

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "present", "turn", "role", "text", "fault", "letter", "fault_letter")]
            for conv_id, present, turn, role, text, fault, letter, fault_letter in zip(*columns):
                if conversation is None or conv_id != open_id:
                    if conversation is not None:
                        closed()
                    open_id, conversation = conv_id, _Conversation(memory)
                if present:
                    out.extend((open_id, *e) for e in conversation.add((turn, role, text, fault, letter, fault_letter)))
                if len(out) >= BATCH:
                    yield packed()
                    out.clear()
        if conversation is not None:
            closed()
        if out:
            yield packed()

    return run


def turn_faults(turns: DataFrame) -> DataFrame:
    """``turns`` with ``fault``: blank, duplicate, truncated (the first that holds) or null; ``seen`` numbers equal turns."""
    equal = Window.partitionBy("conv_id", "present", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    fault = (
        F.when(last == "", F.lit("blank"))
        .when(F.col("seen") > 1, F.lit("duplicate"))
        .when(~last.isin(".", "!", "?"), F.lit("truncated"))
    )
    return turns.withColumn("seen", F.row_number().over(equal)).withColumn("fault", fault)


def repair(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: Column | None = None) -> DataFrame:
    """``(conv_id, step, edit, cost, turn, was, fault, role, text)``: the lightest edits of each conversation, in order.

    ``K`` keeps a turn for 0, ``R`` makes it a user or assistant turn for 3,
    ``D`` deletes it for 4 (blank and repeated turns must go), ``I`` puts in an
    empty user or assistant turn for 3; a truncated turn that stays costs 3
    more.  Of the edits of least cost the audit (their letters) that sorts
    first is taken.  ``role`` and ``text`` are those of the repaired turn, null
    for a deleted one; ``was`` is the role before, null for a new one.

    Turns are read by ``turn_col``, nulls first, turns of equal number by role
    and text.  Null roles and texts become one space.  A null id is a
    conversation of its own, as is every other id.  A conversation none of whose
    rows is ``present`` has one row with null ``edit``.  Repeated rows are
    repeated turns.  Columns other than the four are not read.  An empty table
    gives no rows.

    A conversation is one shuffle key, since its edits depend on their order;
    it is sorted by Spark, which spills, and streamed: the task holds the turns
    of ``SEGMENT`` and those on which the live ways do not yet agree, never the
    conversation.  Rows of a conversation come out one after the other.
    """
    space = F.lit(" ")
    plain = turns.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(role_col, space).alias("role"),
        F.coalesce(text_col, space).alias("text"), (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("present"),
    )
    judged = turn_faults(plain.repartition("conv_id"))
    first = F.substring("role", 1, 1)
    letter = F.when(first.isin("s", "u", "a"), first).otherwise("x")
    coded = F.coalesce(F.substring("fault", 1, 1), F.lit("."))
    ready = judged.withColumns({"letter": letter, "fault_letter": coded})
    ready = ready.sortWithinPartitions(F.col("conv_id"), F.col("turn").asc_nulls_first(), "role", "text", "seen")
    id_type = plain.schema["conv_id"].dataType
    return ready.mapInArrow(_editing(to_arrow_type(id_type)), EDITS_SCHEMA.format(id=id_type.simpleString()))


def report(edits: DataFrame) -> DataFrame:
    """One row per conversation of ``repair``: what was wrong with it, the edits' cost and letters, the repaired text's SHA-256.

    ``gaps`` counts missing turn numbers, ``illegal`` neighbouring turns whose
    roles do not follow each other.  The repaired turns are hashed as
    ``role:text`` lines one after the other, so nothing is gathered; only the
    letters grow with the conversation.
    """
    id_type = edits.schema["conv_id"].dataType
    return edits.mapInArrow(_reporting(to_arrow_type(id_type)), REPORT_SCHEMA.format(id=id_type.simpleString()))


def _reporting(id_type: pa.DataType):
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    kinds = [id_type, *[pa.int64()] * 6, pa.string(), pa.string()]
    legal = {"su", "ua", "au"}

    class Tally:
        def __init__(self, conv_id):
            self.conv_id, self.cost, self.letters, self.hash, self.any = conv_id, 0, [], hashlib.sha256(), False
            self.count = {"blank": 0, "duplicate": 0, "truncated": 0}
            self.low = self.high = self.last_turn = self.last_role = None
            self.turns = self.illegal = 0

        def add(self, edit, cost, turn, was, fault, role, text):
            self.cost += cost
            self.letters.append(edit)
            if edit != INSERT:
                if turn is not None:
                    self.low = turn if self.low is None else self.low
                    self.turns += turn != self.last_turn
                    self.high = self.last_turn = turn
                if fault:
                    self.count[fault] += 1
                if self.last_role is not None and self.last_role + was[:1] not in legal:
                    self.illegal += 1
                self.last_role = was[:1]
            if role is not None:
                self.hash.update((("\n" if self.any else "") + role + ":" + text).encode())
                self.any = True

        def row(self):
            gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
            return self.conv_id, gaps, *self.count.values(), self.illegal, self.cost, "".join(self.letters), self.hash.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, out = None, []

        def packed():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "edit", "cost", "turn", "was", "fault", "role", "text")]
            for conv_id, edit, *rest in zip(*columns):
                if tally is None or conv_id != tally.conv_id:
                    if tally is not None:
                        out.append(tally.row())
                    tally = Tally(conv_id)
                if edit is not None:
                    tally.add(edit, *rest)
            if len(out) >= BATCH:
                yield packed()
                out.clear()
        if tally is not None:
            out.append(tally.row())
        if out:
            yield packed()

    return run
