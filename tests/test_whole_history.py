"""Histories longer than a block, played without blocks where connected players are few."""

from __future__ import annotations

import pytest
from helpers import contest_rows, contests
from pyspark.sql import functions as F

from boutline.operators import ratings as R
from boutline.operators import scan
from boutline.session import StepTable

NAMES = ["candidate_id", "seq", "pre", "opp_pre", "post", "opp_post"]


def _copies(n):
    rows = contest_rows(40, players=6, seed=11)
    return [(r[0] + len(rows) * i, r[1], r[2], f"{r[3]}_{i}", f"{r[4]}_{i}", *r[5:]) for i in range(n) for r in rows]


@pytest.mark.parametrize("few", [2, 14])
def test_long_histories_of_small_groups_need_no_blocks(spark, monkeypatch, few):
    steps = []
    monkeypatch.setattr(StepTable, "add", lambda self, df, add=StepTable.add: steps.append(1) or add(self, df))
    cands = [{"k": 20.0 + 5 * i} for i in range(few)]
    c = contests(spark, _copies(20))
    want = sorted(map(tuple, R.rate(c, cands).select(*NAMES).collect()))
    for store in (True, False):
        got = R.rate_vectors(c, cands, block_rows=100, store=store)
        assert sorted(map(tuple, scan.unfold(got).select(*NAMES).collect())) == want
    assert not steps
    # one group of more players than the bound: blocks as before
    joined = contests(spark, [*_copies(20), *[(10_000 + i, *_copies(1)[-1][1:3], f"p0_{i}", f"p1_{i + 1}", *_copies(1)[-1][5:]) for i in range(19)]])
    want = sorted(map(tuple, R.rate(joined, cands).select(*NAMES).collect()))
    assert sorted(map(tuple, R.rate(joined, cands, block_rows=100).select(*NAMES).collect())) == want and steps


@pytest.mark.parametrize("rows", [5, 10_000])
def test_players_are_connected_over_the_whole_history(spark, monkeypatch, rows):
    monkeypatch.setattr(scan, "BLOCK_ROWS", 7)
    # chains that cross the ranges of seq, a player against himself, and pairs in no order
    pairs = [(i * 7919 % 501, f"a{i}", f"a{i + 1}") for i in range(60)] + [(i * 31 % 503, f"b{i}", f"b{(i * i) % 17}") for i in range(40)] + [(900, "solo", "solo")]
    c = spark.createDataFrame(pairs, "seq long, player string, opponent string").repartition(5)
    named = {r["_who"]: r for r in scan.connected_players(c, rows).collect()}
    who = {r["p"]: r["h"] for r in c.select(F.explode(F.array("player", "opponent")).alias("p")).distinct().select("p", F.xxhash64("p").alias("h")).collect()}
    up = {p: p for p in who}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for _, a, b in pairs:
        up[top(a)] = top(b)
    groups = {}
    for p in who:
        groups.setdefault(top(p), set()).add(who[p])
    assert len(named) == len(who)
    for members in groups.values():
        assert {named[h]["_part"] for h in members} == {min(members)}
    assert sum(r["n"] for r in named.values()) == 2 * len(pairs)


def test_documents_join_nothing_per_candidate(spark, monkeypatch):
    from boutline.operators import bets as K
    from boutline.operators import documents as D
    from boutline.operators import metrics as M
    from boutline.operators import oos as O
    from boutline.operators import sweep as Z

    c = contests(spark, contest_rows(150, players=5, seed=9, per_day=6))
    a = c.filter("seq % 5 <> 0").select((F.col("seq") * 2).alias("odds_seq"), "day", "player", "opponent", (F.col("seq") * 7.0 - 300).alias("american"))
    b = c.filter("seq % 3 <> 0").select((F.col("seq") * 2 + 1).alias("odds_seq"), "day", F.col("opponent").alias("player"), F.col("player").alias("opponent"), (300 - F.col("seq") * 7.0).alias("american"))
    odds, cands = a.unionByName(b), [{"k": 32.0}, {"k": 90.0, "w_ko": 1.1}]
    # per candidate, as it was
    rated = R.rate(c, cands, carry=["result", "is_draw"])
    bets, names = K.bet_records(rated, c, odds, Z.KEYS), ["candidate_id", "seq", "bet_won", "profit", "prob"]
    hold = K.decided(c.filter("seq > 120"))
    frozen = O.frozen_at(c.filter("seq <= 100"), hold)
    vectors = D._counted_vectors(c, odds, cands, False, False, frozen)
    assert vectors.count() < c.count() and "candidate_id" not in vectors.columns
    got = sorted(map(tuple, Z.flagged_bets(vectors).select(*names).collect()))
    assert got == sorted(map(tuple, bets.select(*names).collect())) and len(got) > 20
    names = ["candidate_id", "seq", "result", "prob", "diff", "bouts", "opp_bouts"]
    want = K.scored(rated, c).join(R.bout_counts(c).select("seq", "bouts", "opp_bouts"), "seq").select(*names)
    assert sorted(map(tuple, D._scored(vectors).select(*names).collect())) == sorted(map(tuple, want.collect()))
    outside = O.oos_accuracy(O.compare_frozen(hold, frozen, vectors, len(cands)))
    assert sorted(map(tuple, outside.collect())) == sorted(map(tuple, O.oos_accuracy(O.oos_grid(c.filter("seq <= 100"), hold, cands, match=False)).collect()))
    # falls over slices of days and of crowded days
    want = {r[0]: r[1] for r in M.max_drawdown(bets, Z.KEYS).select("candidate_id", "max_drawdown").collect()}
    assert {r[0]: round(r[1], 6) for r in M.deepest_drawdown(bets, Z.KEYS).collect()} == {k: round(v, 6) for k, v in want.items()}


def test_forests_keep_the_nodes_of_rows(spark, monkeypatch):
    import random

    from pyspark.ml.classification import RandomForestClassifier

    from boutline.operators import models as ML

    rng = random.Random(3)
    rows = [(i, float(i % 3 > 0), *[rng.gauss(i % 3, 1.0) for _ in ML.FEATURES]) for i in range(200)]
    table = spark.createDataFrame(rows, "seq long, result double, " + ", ".join(f"{f} double" for f in ML.FEATURES))
    fits = []
    fit = RandomForestClassifier.fit
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, *a: fits.append((self.getNumTrees(), self.getSeed(), self.getCacheNodeIds())) or fit(self, *a))
    got = {}
    for most in (10**9, 500):
        monkeypatch.setattr(ML, "NODE_IDS", most)
        got[most] = {r["seq"]: r["prob"] for r in ML.ensemble(table, table.filter("seq < 60"), trees=5, rounds=2).collect()}
    # every tree is fitted once, and no fit keeps more numbers than it may
    assert fits == [(5, 42, True), (3, 42, True), (2, 43, True)]
    assert all(len(g) == 60 and all(0.0 <= p <= 1.0 for p in g.values()) for g in got.values())
    assert all(abs(got[500][s] - p) < 0.34 for s, p in got[10**9].items())
    assert sum(ML.forest_sizes(26_000_000, 100)) == 100
