"""Source mixing against apportionment seat by seat and a plain division of the targets."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from boutline.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, size long, h long, key string, target double, n long"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, 2, "x", 0.5, 3) for r in rows], SCHEMA).repartition(parts)


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, limit=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    whole, full = share * sum(sizes.values()), set()
    while True:
        left = whole - sum(limit * sizes[s] for s in full)
        spread = sum(weight[s] for s in names if s not in full)
        above = {s for s in names if s not in full and weight[s] * left / spread > limit * sizes[s]} if spread else set()
        if not above:
            return {s: limit * sizes[s] if s in full else weight[s] * left / spread for s in names}
        full |= above


def seat_by_seat(claims, most, seats):
    quota = dict.fromkeys(claims, 0)
    for _ in range(seats):
        best = max((p for p in claims if quota[p] < most[p]), key=lambda p: (claims[p] / (2 * quota[p] + 1), [-ord(c) for c in p]))
        quota[best] += 1
    return quota


@pytest.mark.parametrize("seed", range(4))
def test_seats_go_to_the_highest_quotients(spark, seed):
    rng = random.Random(seed)
    groups = {g: {f"p{i:02d}": float(rng.choice([1, 3, 3, 50, rng.randrange(1, 3000)])) for i in range(rng.choice([1, 4, 25]))} for g in range(4)}
    rows, want = [], {}
    for g, claims in groups.items():
        most = {p: rng.randrange(1, 60) for p in claims}
        seats = rng.randrange(0, sum(most.values()) + 1)
        rows += [(g, p, c, most[p], seats) for p, c in claims.items()]
        want |= {(g, p): q for p, q in seat_by_seat(claims, most, seats).items()}
    df = spark.createDataFrame(rows, "g int, party string, claim double, most long, seats long")
    got = {(r["g"], r["party"]): r["quota"] for r in M.sainte_lague(df, ["g"], "party").collect()}
    assert got == want
    one = df.filter("g = 2").drop("g")
    assert {(2, r["party"]): r["quota"] for r in M.sainte_lague(one, [], "party").collect()} == {k: v for k, v in want.items() if k[0] == 2}


def corpus(seed=2, docs=150):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 400))) + rng.choice(["", "\n", " "]), rng.choice(["b", "a", "ä", "Z", None, "hot", "hot", "hot"])) for i in range(docs)]
    return rows + [(None, "x y", None), (1, None, "a"), (7, "", "empty"), (7, "", "empty")] + [(9, "one two three four five", "hot")] * 40


def test_targets_sizes_and_what_is_taken(spark):
    rows = corpus()
    got = M.mix(frame(spark, rows), block_tokens=4, shard_tokens=1000).collect()
    assert len(got) == len(rows)

    def words(text):
        return len([w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w])

    assert sorted(r["size"] for r in got) == sorted(words(t) for _, t, _ in rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += words(t)
    want = plain_targets(sizes)
    taken, shards = defaultdict(int), defaultdict(set)
    for r in got:
        s = r["source"]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["taken"] == r["passes"] * r["size"] + sum(b - a for a, b in r["spans"])
        assert all(0 <= a < b <= r["size"] for a, b in r["spans"])
        taken[s] += r["taken"]
        shards[s].add(r["shard"])
    assert len(shards["hot"]) > 3
    for s in sizes:
        # half a block by rounding, and the last block of a shard may be short
        assert abs(taken[s] - want[s]) <= 4 * (len(shards[s]) + 1)
    again = M.mix(frame(spark, rows, 7), block_tokens=4, shard_tokens=1000).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_a_row_that_repeats_is_laid_out_in_parts(spark, monkeypatch):
    monkeypatch.setattr(M, "COPIES", 16)
    rows = [(5, "a b c", "s")] * 100 + [(i, "d e f g", "t") for i in range(50)]
    got = M.mix(frame(spark, rows), block_tokens=2, shard_tokens=60).collect()
    hot = [r for r in got if r["source"] == "s"]
    assert len(hot) == 100 and len({r["shard"] for r in hot}) > 1
    assert sum(r["taken"] for r in hot) == pytest.approx(hot[0]["target"], abs=12)


def test_sources_without_words_and_empty_tables(spark):
    got = M.mix(frame(spark, [(1, None, "a"), (2, " \n", None)])).collect()
    assert [(r["size"], r["source_size"], r["target"], r["taken"]) for r in got] == [(0, 0, 0.0, 0)] * 2
    assert M.mix(frame(spark, [(1, "x", "a")]).filter("doc_id > 5")).collect() == []


def test_no_python_in_the_plan(spark):
    plan = M.mix(frame(spark, corpus()))._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan
