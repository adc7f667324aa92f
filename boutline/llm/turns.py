"""Conversation repair: the cheapest edits that make a conversation follow its grammar, by a Viterbi pass with coalescing survivors.

The grammar is an optional opening ``s`` (system) turn and then ``u``, ``a`` pairs (user, assistant), by the initials of the roles; four
states follow it. Rows stream by in order. For every state the cheapest path so far survives, ties to the path whose edit letters come
first in ASCII. Paths are nodes of one tree that point back to their parents and count their references: a node no survivor leads
to goes at once, and where all survivors share a first edit, it is final and its text leaves the tree. A state that another one can replace at no
cost in any continuation is given up. So a task holds the
undecided part of one conversation, however long that is. Two tied paths are compared letter by letter back to where they part.

Letters: K keep (0), R rerole to user or assistant (2), D delete (3), I insert an empty user or assistant turn (2). Blank and repeated turns must
go; a truncated turn (last character that is not a blank is none of ``.!?``) costs 1 if it stays.

A digest of the repaired text has to read it in order, so a conversation is one task's stream; only repeats need all of its turns at once, and
those are found beforehand: the first place of every (role, text) is an aggregate over all tasks and joins the stream as a marker row before
its turn. Turns that are alike in all columns are one row with a count.

Defined cases: a null role or text is one space; null turns come first; turns of one number go by role, then text (its first 64
characters, then its hash); a null conversation is a conversation of its own; repeated rows repeat a turn; an empty table gives an empty
result. Other columns are never read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1  # costs
FAR = 1 << 60
LEGAL = ("su", "ua", "au")
SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURN = "at long, edit string, turn long, role string, text string"


class _Node:
    """One edit of a path, or ``count`` deletions in a row: ``up`` is the edit before, ``refs`` counts the edits after it and the survivors
    that end here, ``depth`` the letters up to here."""

    __slots__ = ("up", "op", "count", "depth", "refs", "turn", "role", "text")

    def __init__(self, up, op, turn, role, text):
        self.up, self.op, self.turn, self.role, self.text = up, op, turn, role, text
        self.depth = up.depth + 1 if up is not None else 0
        self.count = self.refs = 1


def _first(a: _Node, a_op: str, b: _Node, b_op: str) -> bool:
    """Whether path ``a`` and then ``a_op`` comes before path ``b`` and then ``b_op``; an op may be empty. Runs of deletions stay runs."""
    x, y = [(a_op, 1)] if a_op else [], [(b_op, 1)] if b_op else []
    while a is not b:
        da, db = a.depth, b.depth
        if da >= db:
            x.append((a.op, a.count))
            a = a.up
        if db >= da:
            y.append((b.op, b.count))
            b = b.up
    while x and y:
        (p, m), (q, n) = x.pop(), y.pop()
        if p != q:
            return p < q
        if m > n:
            x.append((p, m - n))
        elif n > m:
            y.append((q, n - m))
    return bool(y)


class Survivors:
    """Cheapest path into each state: 0 nothing yet, 1 after s, 2 after u, 3 after a. ``emit(node)`` gets the final edits in order."""

    def __init__(self, emit):
        self.emit = emit
        self.root = _Node(None, "", None, None, None)
        self.node = [self.root, None, None, None]
        self.cost = [0, FAR, FAR, FAR]
        self.wait = self.every = 16

    def _add(self, up: _Node, op: str, turn=None, role=None, text=None) -> _Node:
        up.refs += 1
        return _Node(up, op, turn, role, text)

    @staticmethod
    def _drop(node: _Node | None) -> None:
        while node is not None:
            node.refs -= 1
            if node.refs:
                return
            node = node.up

    def _open(self) -> None:
        """Insertions between two turns."""
        cost, node = self.cost, self.node
        for state, before, role in ((2, (0, 1, 3), "user"), (3, (2,), "assistant")):
            best, up, op = cost[state], node[state], ""
            for q in before:
                value = cost[q] + INSERT
                if value < best or (value == best and value < FAR and _first(node[q], "I", up, op)):
                    best, up, op = value, node[q], "I"
            if op:
                new = self._add(up, "I", None, role, "")
                self._drop(node[state])
                cost[state], node[state] = best, new

    def turn(self, number, role: str, text: str, forced: bool, cut: bool) -> None:
        self._open()
        cost, node = self.cost, self.node
        new_cost, new_node = [c + DELETE if c < FAR else FAR for c in cost], [None] * 4
        if forced:
            for q in range(4):
                if cost[q] < FAR:
                    new_node[q] = self._add(node[q], "D")
        else:
            initial, stay = role[:1], CUT if cut else 0
            as_user = ("K", stay, role) if initial == "u" else ("R", stay + REROLE, "user")
            as_assistant = ("K", stay, role) if initial == "a" else ("R", stay + REROLE, "assistant")
            opens = (0,) if initial == "s" else ()
            for state, before, (op, price, name) in ((0, (), as_user), (1, opens, ("K", stay, role)), (2, (0, 1, 3), as_user), (3, (2,), as_assistant)):
                best, up, letter = new_cost[state], node[state], "D"
                for q in before:
                    value = cost[q] + price
                    if value < best or (value == best and value < FAR and _first(node[q], op, up, letter)):
                        best, up, letter = value, node[q], op
                if best < FAR:
                    new_cost[state] = best
                    new_node[state] = self._add(up, "D") if letter == "D" else self._add(up, op, number, name, text)
        # what state 3 can still do, 1 can do no cheaper, and 0 by at most one deletion (of an s turn) cheaper; 2 is an insertion away from 3
        reach = min(new_cost[3], new_cost[2] + INSERT)
        for state, slack in ((1, 0), (0, DELETE)):
            if new_node[state] is not None and new_cost[state] > reach + slack:
                self._drop(new_node[state])
                new_cost[state], new_node[state] = FAR, None
        for old in node:
            self._drop(old)
        self.cost, self.node = new_cost, new_node
        self.wait -= 1
        if not self.wait:
            self._settle()

    def _settle(self) -> None:
        """Emit the edits all survivors share and make runs of deletions one node. A walk costs the undecided length, so the next one waits as
        long as what is left."""
        path = []
        for tip in self.node:
            if tip is None:
                continue
            path, at = [], tip
            while at is not self.root:
                path.append(at)
                up = at.up
                while at.op == "D" and up.op == "D" and up.refs == 1 and up is not self.root:
                    at.count += up.count
                    at.up = up = up.up
                at = up
        while path and self.root.refs == 1:
            self._advance(path.pop())
        self.wait = max(self.every, len(path))

    def _advance(self, node: _Node) -> None:
        self.emit(node)
        node.up, node.text, self.root = None, None, node

    def undecided(self) -> int:
        """Nodes on the longest path, beyond the edits that are final."""
        most = 0
        for at in self.node:
            length = 0
            while at is not None and at is not self.root:
                length, at = length + 1, at.up
            most = max(most, length)
        return most

    def end(self) -> int:
        self._open()
        a, b = self.cost[0], self.cost[3]
        state = 3 if b < a or (a == b and _first(self.node[3], "", self.node[0], "")) else 0  # state 3 is always in reach
        path, at = [], self.node[state]
        while at is not self.root:
            path.append(at)
            at = at.up
        while path:
            self._advance(path.pop())
        return self.cost[state]


class _Conversation:
    """Counts and digest of one conversation as its rows stream by; ``turns`` collects the final edits if wanted."""

    def __init__(self, conv, turns: list | None):
        self.conv, self.turns = conv, turns
        self.low = self.high = self.last = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = self.rows = 0
        self.initial = None
        self.audit, self.hash, self.lines, self.edits = bytearray(), hashlib.sha256(), 0, 0
        self.paths = Survivors(self._final)

    def _final(self, node: _Node) -> None:
        self.audit += node.op.encode() * node.count
        if node.op != "D":
            self.hash.update((f"\n{node.role}:{node.text}" if self.lines else f"{node.role}:{node.text}").encode())
            self.lines += 1
        if self.turns is not None:
            self.turns += [(self.conv, self.edits + i, node.op, node.turn, node.role, node.text) for i in range(node.count)]
        self.edits += node.count

    def add(self, number, role: str, text: str, copies: int, first: bool) -> None:
        if number is not None and number != self.last:
            self.distinct += 1
            self.low = number if self.low is None else self.low
            self.high = self.last = number
        core, initial = text.rstrip(BLANKS), role[:1]
        blank, cut = not core, bool(core) and core[-1] not in ".!?"
        for copy in range(copies):
            repeat = not blank and (copy > 0 or not first)
            if self.rows and self.initial + initial not in LEGAL:
                self.illegal += 1
            self.blank += blank
            self.duplicate += repeat
            self.truncated += cut and not repeat
            self.initial, self.rows = initial, self.rows + 1
            self.paths.turn(number, role, text, blank or repeat, cut)

    def row(self) -> tuple:
        cost = self.paths.end() if self.rows else 0
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, self.audit.decode(), self.hash.hexdigest())


def _stream(schema: pa.Schema, wanted: str, flush: int = 4096):
    def run(batches):
        now, first, out = None, False, []
        for batch in batches:
            for conv, turn, role, text, n, kind in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if now is None or conv != now.conv:
                    if now is not None:
                        done = now.row()
                        if wanted == "summary":
                            out.append(done)
                    now, first = _Conversation(conv, out if wanted == "turns" else None), False
                if kind == 1:
                    first = True
                elif kind == 2:
                    now.add(turn, role, text, n, first)
                    first = False
                if len(out) >= flush:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out.clear()
        if now is not None:
            done = now.row()
            if wanted == "summary":
                out.append(done)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def _in_order(conversations: DataFrame, every: DataFrame | None) -> DataFrame:
    """Turns with their counts, markers of first places and of conversations that may have no turns, each conversation in one sorted stream."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    alike = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    same = [F.substring("text", 1, 64).alias("head"), F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g")]
    turns = alike.select("conv_id", "turn", "role", *same, "text", "n", F.lit(2).alias("kind"))
    # the smallest turn, nulls first, of every role and text
    least = F.when(F.count(F.lit(1)) > F.count("turn"), F.lit(None)).otherwise(F.min("turn")).cast("long")
    firsts = turns.groupBy("conv_id", "role", "head", "h", "g").agg(least.alias("turn"))
    none: list[Column] = [F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("n")]
    together = turns.unionByName(firsts.select("conv_id", "turn", "role", "head", "h", "g", *none, F.lit(1).alias("kind")))
    if every is not None:
        known = every.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
        empty = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("head", "string"), ("h", "long"), ("g", "long"))]
        together = together.unionByName(known.select("conv_id", *empty, *none, F.lit(0).alias("kind")))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "head", "h", "g", "kind"]
    return together.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "n", "kind")


def repair(conversations: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """One row per conversation: faults, the cost and letters of the cheapest repair and the digest of the repaired ``role:text`` lines.

    ``every`` names conversations (``conv_id``) that get a row even without turns.
    """
    schema = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])
    return _in_order(conversations, every).mapInArrow(_stream(schema, "summary"), f"conv_id long, {SUMMARY}")


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """The edits themselves, in order: conv_id, ``at`` (from 0), ``edit`` and, unless deleted, the turn's number, role and text."""
    schema = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    return _in_order(conversations, None).mapInArrow(_stream(schema, "turns"), f"conv_id long, {TURN}")
