"""Conversation repair against every edit sequence tried out, and the memory of the survivors."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

from boutline.llm import q_turns as Q
from boutline.llm import turns as T

SCHEMA = "conv_id long, turn long, role string, text string, n long, kind int, h long, head string, copy int"
GRAMMAR = re.compile(r"(s?(ua)+)?")
BLANKS = " \t\n\x0b\x0c\r"


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        core = text.rstrip(BLANKS)
        if not core:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def tried_out(rows):
    """(cost, letters, lines) by listing every edit sequence cheap enough, with at most two insertions between turns."""
    found = faults(rows)
    best = None

    def walk(i, cost, letters, lines):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows):
            if GRAMMAR.fullmatch("".join(x[:1] for x in lines)) is not None and (best is None or (cost, letters) < best[:2]):
                best = (cost, letters, lines)
        inserted = len(letters) - len(letters.rstrip("I"))
        if inserted < 2:
            for role in ("user", "assistant"):
                walk(i, cost + 2, letters + "I", lines + [role + ":"])
        if i < len(rows):
            _, role, text = rows[i]
            walk(i + 1, cost + 3, letters + "D", lines)
            if found[i] not in ("blank", "duplicate"):
                more = 1 if found[i] == "truncated" else 0
                walk(i + 1, cost + more, letters + "K", lines + [f"{role}:{text}"])
                for new in ("user", "assistant"):
                    walk(i + 1, cost + more + 2, letters + "R", lines + [f"{new}:{text}"])

    # deleting everything is always possible, so nothing dearer needs listing
    best = (3 * len(rows), "D" * len(rows), [])
    walk(0, 0, "", [])
    return best


def expected(rows):
    numbers = [t for t, _, _ in rows if t is not None]
    found = faults(rows)
    initials = [r[:1] for _, r, _ in rows]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    cost, letters, lines = tried_out(rows) if rows else (0, "", [])
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, 2, 3, "x", 4) for r in rows], SCHEMA).repartition(parts)


def collected(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def random_rows(seed, conversations=60, most=5):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(conversations), None]:
        for _ in range(rng.randrange(1, most + 1)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", ""])
            text = rng.choice(["Yes.", "No", "Why?", "", " \t", "Go on!", "and", "a.b!c?"])
            rows.append((conv, rng.choice([None, 0, 1, 2, 3, 5]), role, text))
    return rows


def test_repair_equals_every_sequence_tried_out(spark):
    rows = random_rows(3)
    got = collected(T.repair(frame(spark, rows)))
    for conv in {r[0] for r in rows}:
        mine = in_order([r[1:] for r in rows if r[0] == conv])
        assert got[conv] == expected(mine), mine
    assert got.keys() == {r[0] for r in rows}


def test_damage_and_whole_query(spark, tmp_path):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant"]) if t % 3 else ["user", "assistant"][t % 2], f"Text {c}-{t}. More? Yes!") for c in range(120) for t in range(rng.randrange(1, 6))]
    rows += [(500, None, None, None), (None, None, "user", "Hm."), (None, 3, "assistant", "Ok.")]
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = collected(Q.op12_repair_conversations(spark, str(tmp_path)))

    def text_of(v):
        return " " if v is None else str(v)

    for conv in {r[0] for r in rows}:
        left = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = text_of(role), text_of(text)
            kind = zlib.crc32(f"{text_of(c)}:{text_of(turn)}".encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            left += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        assert got[conv] == expected(in_order(left))
    assert len(got) == len({r[0] for r in rows})


def test_turns_rebuild_the_digest_and_the_letters(spark):
    rows = random_rows(8, 40, 7)
    whole = {r["conv_id"]: r for r in T.repair(frame(spark, rows)).collect()}
    edits: dict = {}
    for r in T.repaired_turns(frame(spark, rows)).collect():
        edits.setdefault(r["conv_id"], []).append(r)
    for conv, summary in whole.items():
        mine = sorted(edits.get(conv, []), key=lambda r: r["at"])
        assert [r["at"] for r in mine] == list(range(len(mine)))
        assert "".join(r["edit"] for r in mine) == summary["audit"]
        lines = "\n".join(f"{r['role']}:{r['text']}" for r in mine if r["edit"] != "D")
        assert hashlib.sha256(lines.encode()).hexdigest() == summary["repaired_sha256"]


def test_a_long_conversation_is_decided_as_it_streams():
    rng = random.Random(2)
    out = []
    paths = T.Survivors(lambda node: out.append(node.op * node.count))
    longest = 0
    for i in range(20_000):
        role = rng.choice(["user", "assistant", "tool"])
        paths.turn(i, role, f"t{i}.", rng.random() < 0.1, rng.random() < 0.1)
        longest = max(longest, paths.undecided())
    assert longest < 400 and len("".join(out)) > 19_000
    paths.end()
    assert len("".join(out).replace("I", "")) == 20_000


def test_copies_without_end_and_nothing_but_deletions():
    out = []
    paths = T.Survivors(lambda node: out.append(node.op * node.count))
    paths.turn(0, "user", "Hi.", False, False)
    for _ in range(5_000):
        paths.turn(0, "user", "Hi.", True, False)
    assert paths.undecided() < 100
    assert paths.end() == 3 * 5_000 + 2 and "".join(out) == "K" + "D" * 5_000 + "I"


def test_empty_table_and_conversations_without_turns(spark):
    none = frame(spark, [(1, 0, "user", "x")]).filter("conv_id > 5")
    assert T.repair(none).collect() == []
    got = collected(T.repair(none, every=frame(spark, [(7, 0, "user", "x"), (None, 0, "user", "x")])))
    empty = hashlib.sha256(b"").hexdigest()
    assert got == {c: (0, 0, 0, 0, 0, 0, "", empty) for c in (7, None)}
