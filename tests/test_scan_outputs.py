"""What the scan writes: only outputs that are asked for, and between blocks only vectors that are read again."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from helpers import contest_rows, contests
from pyspark.sql import functions as F

from boutline.operators import history as H
from boutline.operators import oos as O
from boutline.operators import ratings as R
from boutline.operators import scan
from boutline.operators import sweep as Z
from boutline.session import StepTable

CANDS = [{"k": 32.0}, {"k": 90.0, "w_ko": 1.1}, {"k": 150.0, "use_method": 0.0}]


def test_pairs_are_connected_by_numbers():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 400, 250), rng.integers(0, 400, 250)
    up = list(range(400))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, y in zip(a, b):
        x, y = top(x), top(y)
        up[max(x, y)] = min(x, y)
    assert scan._roots(a, b, 400).tolist() == [top(x) for x in range(400)]
    # names never reach the task that connects them: the pairs are 64-bit hashes
    out = scan._bin_rows(64, [])(pd.DataFrame({"_pa": [5, -7], "_pb": [6, 2**60], "n": [1, 1]}))
    assert out["_who"].dtype == np.int64 and sorted(out.groupby("_bin")["_who"].apply(sorted)) == [[-7, 2**60], [5, 6]]


def _any_order(bin_rows):
    """``bin_rows`` with its input rows in another order at every call, as a shuffle over several executors delivers them."""

    def wrapped(*args):
        run = bin_rows(*args)
        return lambda pairs: run(pairs.sample(frac=1.0).reset_index(drop=True))

    return wrapped


@pytest.mark.parametrize("keyed", [False, True])
def test_blocks_do_not_depend_on_the_order_of_rows(spark, monkeypatch, keyed):
    # equal copies of one history: groups of players of equal weight, which only their order could tell apart
    rows = contest_rows(40, players=6, seed=11)
    n = len(rows)
    copies = [(r[0] + n * i, r[1], r[2], f"{r[3]}_{i}", f"{r[4]}_{i}", *r[5:]) for i in range(20) for r in rows]
    c = contests(spark, copies)
    keys = ["league"] if keyed else []
    if keyed:
        c = c.withColumn("league", F.lit(1))
    names = ["candidate_id", "seq", "pre", "opp_pre", "post", "opp_post"]
    want = sorted(map(tuple, R.rate(c, CANDS, keys=keys).select(*names).collect()))
    # contests and vectors of a block look their bins up separately, so both must find the same ones
    monkeypatch.setattr(scan, "_bin_rows", _any_order(scan._bin_rows))
    got = sorted(map(tuple, R.rate(c, CANDS, keys=keys, block_rows=200).select(*names).collect()))
    assert got == want


@pytest.mark.parametrize("few", [3, 14])
def test_only_wanted_outputs_are_written(spark, monkeypatch, few):
    steps = []
    monkeypatch.setattr(StepTable, "add", lambda self, df, add=StepTable.add: steps.append(add(self, df)) or steps[-1])
    c = contests(spark, contest_rows(90, players=30, seed=8)).withColumn("_w", F.col("seq") % 4 == 0)
    cands = [{"k": 20.0 + 5 * i} for i in range(few)]
    full = {r["seq"]: r for r in R.rate_vectors(c, cands).collect()}
    some = R.rate_vectors(c, cands, carry=["_w"], block_rows=20, emit={"order": "_w", "post": "_w"})
    got = {r["seq"]: r for r in some.collect()}
    assert set(got) == {s for s in full if s % 4 == 0} and "pre" not in some.columns
    for s, r in got.items():
        assert r["post"] == full[s]["post"]
        assert r["order"] == [(x > y) - (x < y) for x, y in zip(full[s]["pre"], full[s]["opp_pre"])]
    assert len(steps) > 2
    # the last block hands nothing on, and a player's vector is written once for each block it is read in
    assert steps[-1].filter("_next is not null").count() == 0
    handed = [r for s in steps for r in s.filter("_next is not null").select("player", "_next").collect()]
    assert handed and len(handed) == len(set(handed))


@pytest.mark.parametrize("rows", [25, 1000])
def test_frozen_vectors_equal_as_of_ratings(spark, monkeypatch, rows):
    monkeypatch.setattr(O, "rate_vectors", lambda *a, **k: R.rate_vectors(*a, block_rows=rows, **k))
    c = contests(spark, contest_rows(80, players=12, seed=2))
    # a holdout inside the training days: ratings are those of strictly earlier days, and one name is unknown
    hold = c.filter("seq > 50").withColumn("player", F.when(F.col("seq") % 9 == 0, "nobody").otherwise(F.col("player")))
    names = ["candidate_id", "seq", "rating", "opp_rating", "correct"]
    want = sorted(map(tuple, O.oos_predictions(R.rate(c, CANDS), c, hold, CANDS, min_bouts=0, match=False).select(*names).collect()))
    got = sorted(map(tuple, O.oos_grid(c, hold, CANDS, match=False).select(*names).collect()))
    assert got == want and any(r[2] == 1500.0 for r in got)


def test_grid_accuracy_counts_what_predictions_count(spark):
    from boutline.operators import bets as K

    c = contests(spark, contest_rows(120, players=8, seed=6))
    cut = F.lit("2020-08-01").cast("timestamp_ntz")
    p = K.predictions(R.rate(c, CANDS, carry=["result", "is_draw", "played_at"]), c)
    want = p.groupBy("candidate_id").agg(F.avg("correct").alias("a"), F.avg(F.when(F.col("played_at") > cut, F.col("correct"))).alias("l"), F.count_if(F.col("played_at") > cut).alias("n"))
    got = Z.grid_accuracy(c, CANDS, cut, F.col("played_at")).select("candidate_id", "accuracy", "later_accuracy", "later_rows")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("lookback", [None, 100])
def test_candidate_bets_equal_bet_records(spark, lookback):
    from boutline.operators import bets as K

    c = contests(spark, contest_rows(150, players=5, seed=9, per_day=6))
    # some prices miss on one side, some on both
    a = c.filter("seq % 5 <> 0").select((F.col("seq") * 2).alias("odds_seq"), "day", "player", "opponent", (F.col("seq") * 7.0 - 300).alias("american"))
    b = c.filter("seq % 3 <> 0").select((F.col("seq") * 2 + 1).alias("odds_seq"), "day", F.col("opponent").alias("player"), F.col("player").alias("opponent"), (300 - F.col("seq") * 7.0).alias("american"))
    odds = a.unionByName(b)
    names = ["candidate_id", "seq", "day", "bet_on", "bet_won", "american", "decimal", "stake", "payout", "profit", "prob"]
    want = K.bet_records(R.rate(c, CANDS, carry=["result", "is_draw"]), c, odds, Z.KEYS, lookback).select(*names)
    mine = Z.candidate_bets(c, odds, CANDS, lookback)
    got = sorted(map(tuple, mine.select(*names).collect()))
    assert got == sorted(map(tuple, want.collect())) and len(got) > 20
    # nothing is joined per candidate: the rows are unfolded after the last join
    plan = mine._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.split("MapInArrow")[0]


def _copies(spark, n):
    rows = contest_rows(40, players=6, seed=11)
    return contests(spark, [(r[0] + len(rows) * i, r[1], r[2], f"{r[3]}_{i}", f"{r[4]}_{i}", *r[5:]) for i in range(n) for r in rows])


def test_bins_are_dealt_evenly_and_arrays_are_never_null(spark):
    # nulls in an array column make Spark's Arrow writer quadratic in a batch, and hashed bins gave some tasks a multiple of others
    c = _copies(spark, 64)
    scanned = R.vector_scan(c, CANDS, decay=True)
    who = scanned.rows.select(F.explode(F.array("player", "opponent")).alias("who")).distinct()
    state = who.filter(F.col("who").contains("_1")).withColumn("vector", F.array(*[F.lit(1500.0)] * len(CANDS)))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for given in (None, state):
        rows = scanned.dealt(scanned.rows, given, who.withColumn("_next", F.lit(1))).withColumn("_task", F.spark_partition_id())
        seen = rows.select("_task", "_bin", *[F.col(x).isNull().cast("int").alias(x) for x in ("_r", "_fa", "_fb", "_ba", "_bb")]).toPandas()
        assert seen[["_r", "_fa", "_fb", "_ba", "_bb"]].to_numpy().sum() == 0
        per_task = seen.groupby("_task")["_bin"].nunique()
        assert (seen.groupby("_bin")["_task"].nunique() == 1).all() and seen["_bin"].nunique() == 64
        assert len(per_task) == min(tasks, 64) and per_task.max() == -(-64 // tasks)


@pytest.mark.parametrize("block_rows", [10_000, 100])
def test_only_the_outputs_asked_for_are_rated(spark, block_rows):
    c = _copies(spark, 8)
    every = R.rate(c, CANDS, block_rows=block_rows)
    for names in (["pre", "opp_pre"], ["post", "opp_post"]):
        some = R.rate(c, CANDS, block_rows=block_rows, emit=dict.fromkeys(names))
        assert not {"pre", "opp_pre", "post", "opp_post"} - set(names) & set(some.columns)
        by = ["candidate_id", "seq", *names]
        assert sorted(map(tuple, some.select(*by).collect())) == sorted(map(tuple, every.select(*by).collect()))
    hist = H.history(some, ["candidate_id"])
    want = H.history(every, ["candidate_id"]).drop("pre")
    assert sorted(map(tuple, hist.collect())) == sorted(map(tuple, want.collect()))


def test_diagnostic_records_carry_one_label_through_the_scan(spark, monkeypatch):
    from boutline.plans import diagnostics as PD
    from boutline.sources.tables import Tables

    carried = []
    rate = R.rate
    monkeypatch.setattr(R, "rate", lambda *a, **k: carried.append(k["carry"]) or rate(*a, **k))
    rows = PD.records(Tables(spark, "/root/testdata/sf0.001"))
    assert carried == [["result", "is_draw", "played_at", "method"]]
    assert {r["method"] for r in rows.select("method").distinct().collect()} <= {"KO/TKO", "Submission", "Unanimous Decision", "Split Decision", "Majority Decision", "Other"}
