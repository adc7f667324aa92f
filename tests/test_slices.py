"""Slices that follow the rows: a key with most rows in one month or day spreads over tasks, with the same answers."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boutline.operators import history as H
from boutline.operators import metrics as M
from boutline.operators import prefix as P
from boutline.operators import trends as T

DAY = dt.date(2024, 5, 1)


@pytest.fixture()
def small_slices(monkeypatch):
    monkeypatch.setattr(P, "SLICE_ROWS", 100)
    monkeypatch.setattr(P.sliced, "__defaults__", (100,))


def hot_rows(n=3000, seed=1, days=3):
    """A third of all rows belong to one player; everything happens in a few days of one month."""
    rng = random.Random(seed)
    return [(("hot" if i % 3 == 0 else f"p{rng.randrange(40)}"), DAY + dt.timedelta(days=rng.randrange(days)), i, rng.choice([-1.0, 0.5, 2.0])) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "who string, day date, seq long, profit double").repartition(5)


def test_crowded_slices_are_cut_and_stay_in_order(spark):
    df = frame(spark, hot_rows())
    cut = P.sliced(df, ["who"], P.month_slice("day"), P.place("day", "seq"), 100)
    sizes = {(r["who"], r["_slice"]): r["count"] for r in cut.groupBy("who", "_slice").count().collect()}
    hot = [n for (who, _), n in sizes.items() if who == "hot"]
    assert sum(hot) == 1000 and len(hot) >= 8 and max(hot) <= 200
    assert all(sum(1 for w, _ in sizes if w == who) == 1 for who in {w for w, _ in sizes} if who != "hot")
    ends = cut.filter("who = 'hot'").groupBy("_slice").agg(F.min(F.struct("day", "seq")).alias("a"), F.max(F.struct("day", "seq")).alias("b")).orderBy("_slice").collect()
    assert all(x["b"] < y["a"] for x, y in zip(ends, ends[1:]))
    assert cut.count() == 3000


def test_hot_player_spreads_over_tasks(spark, small_slices):
    df = frame(spark, hot_rows())
    cut = P.sliced(df, ["who"], P.month_slice("day"), P.place("day", "seq"))
    tasks = cut.repartition(16, "who", "_slice").withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert max(r["count"] for r in tasks) < 700  # one task would hold 1000 or more


def test_running_values_equal_one_window(spark, small_slices):
    df = frame(spark, hot_rows())
    w = W.partitionBy("who").orderBy("day", "seq")
    want = df.select("who", "seq", F.sum("profit").over(w).alias("s"), (F.row_number().over(w) - 1).alias("n"), F.max("profit").over(w.rowsBetween(W.unboundedPreceding, -1)).alias("m"))
    got = P.running(df, ["who"], P.month_slice("day"), ["day", "seq"], {"s": ("sum", F.col("profit"))})
    got2 = P.running(df, ["who"], P.month_slice("day"), ["day", "seq"], {"n": ("count", F.lit(1)), "m": ("max", F.col("profit"))}, inclusive=False)
    a = sorted(map(tuple, want.collect()))
    b = {(r["who"], r["seq"]): r["s"] for r in got.collect()}
    c = {(r["who"], r["seq"]): (r["n"], r["m"]) for r in got2.collect()}
    assert len(a) == len(b) == 3000
    for who, seq, s, n, m in a:
        assert b[who, seq] == pytest.approx(s) and c[who, seq] == (n, m)


def test_one_busy_day_in_parts_for_drawdown_and_average(spark, small_slices):
    rows = hot_rows(1500, 4, days=1)
    df = frame(spark, rows)
    values, peak, total = {}, None, 0.0
    for _, _, seq, profit in sorted(rows, key=lambda r: r[2]):
        total += profit
        peak = total if peak is None else max(peak, total)
        values[seq] = peak - total
    got = {r["seq"]: r["drawdown"] for r in M.drawdown_series(df).collect()}
    assert got == pytest.approx(values)
    longest = now = 0
    for s in sorted(values):
        now = now + 1 if values[s] > 0 else 0
        longest = max(longest, now)
    assert M.max_drawdown(df).first()["duration"] == longest
    average, want = None, {}
    for _, _, seq, profit in sorted(rows, key=lambda r: r[2]):
        average = profit if average is None else 2 / 11 * profit + (1 - 2 / 11) * average
        want[seq] = average
    assert {r["seq"]: r["ema"] for r in T.exponential_average(df, "profit", 10).collect()} == pytest.approx(want)


def test_as_of_with_a_hot_player_and_crowded_days(spark, small_slices):
    rows = hot_rows(2000, 6)
    known = frame(spark, rows).select(F.col("who").alias("player"), "day", "seq", F.lit(0).alias("side"), F.col("profit").alias("post"))
    probes = frame(spark, rows).select(F.col("who").alias("player"), "day", "seq")
    got = {(r["player"], r["seq"]): r["rating"] for r in H.as_of(probes, known, ["player"], {"rating": F.col("post")}, ["seq", "side"]).collect()}
    last: dict = {}
    for who, day, seq, profit in rows:
        last.setdefault(who, {}).setdefault(day, []).append((seq, profit))
    for who, day, seq, _ in rows:
        earlier = [d for d in last[who] if d < day]
        assert got[who, seq] == (max(last[who][max(earlier)])[1] if earlier else None)


@pytest.mark.parametrize("distinct", [1, 7, 5000])
def test_exact_quantiles_read_only_the_bands_around_the_ranks(spark, distinct):
    rng = random.Random(distinct)
    values = [float(rng.randrange(distinct)) / 3 for _ in range(6000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").repartition(4)
    qs = [0.0, 0.1, 0.5, 0.801, 1.0]
    got = P.exact_quantiles(df, "x", qs, rows=50).first()
    assert [got[f"q{i}"] for i in range(5)] == pytest.approx(np.quantile(values, qs).tolist())
    assert P.exact_quantiles(df.filter("x > 1e9"), "x", [0.5]).first().q0 is None


def test_bands_with_more_cuts_than_one_line(spark):
    cuts = [float(i) for i in range(3 * P._CUTS + 5)]
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.5, 1023.0, 1023.5, 1024.0, 2048.2, 3076.0, 9e9)], "x double")
    got = [r["b"] for r in df.withColumn("b", P._band(cuts, "x")).collect()]
    assert got == [sum(c < v for c in cuts) for v in (-1.0, 0.0, 0.5, 1023.0, 1023.5, 1024.0, 2048.2, 3076.0, 9e9)]


def test_auc_with_many_distinct_scores(spark):
    rng = random.Random(3)
    rows = [(rng.random(), float(rng.random() < 0.5)) for _ in range(800)]
    wins = sum((a > b) + 0.5 * (a == b) for a, r in rows if r for b, s in rows if not s)
    pos = sum(r for _, r in rows)
    df = spark.createDataFrame(rows, "prob double, result double")
    assert M.auc(df).first()["auc"] == pytest.approx(wins / (pos * (len(rows) - pos)))


def test_last_values_reach_back_over_slices(spark, small_slices):
    rows = [(w, d, s, None if s % 7 == 0 else p) for w, d, s, p in hot_rows(1500, 8)]
    df = frame(spark, rows)
    got = {(r["who"], r["seq"]): r["last"] for r in P.last_values(df, ["who"], P.month_slice("day"), ["day", "seq"], F.col("profit"), 3).collect()}
    seen: dict = {}
    for who, day, seq, profit in sorted(rows, key=lambda r: (r[1], r[2])):
        before = seen.setdefault(who, [])
        assert got[who, seq] == before[-3:]
        before.append(profit)
    assert len(got) == 1500


def test_careers_equal_a_walk_through_the_contests(spark):
    from helpers import contest_rows, contests

    from boutline.operators import models as ML
    from boutline.sources.contests import FLAGS

    rows = contest_rows(80, players=6)
    stats = {x: (F.col("seq") * (3 + i) % 11 + 1) for i, x in enumerate(ML.STATS)}
    c = contests(spark, rows).withColumns(stats | {f"opp_{x}": F.col("seq") * (5 + i) % 13 + 1 for i, x in enumerate(ML.STATS)} | {"minutes": F.col("seq") % 5 + 1})
    got = {r["seq"]: r for r in ML.careers(c).collect()}
    past: dict = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        seq, players, result = r[0], (r[3], r[4]), r[5]
        finish = any(v == "1" and f in ("ko", "subw") for f, v in zip(FLAGS, r[13:]))
        own = [[seq * (3 + i) % 11 + 1 for i in range(5)], [seq * (5 + i) % 13 + 1 for i in range(5)]]
        for side in (0, 1):
            h, p = past.get(players[side], []), ("", "opp_")[side]
            row = got[seq]
            if not h:
                assert row[p + "win_rate"] is None and row[p + "recent_win_rate"] is None
                continue
            total = lambda k, rows_=h: sum(x[k] for x in rows_)
            assert row[p + "win_rate"] == pytest.approx(total("won") / len(h))
            assert row[p + "sigstr_pm"] == pytest.approx(total("sig") / total("minutes"))
            assert row[p + "str_def"] == pytest.approx(1 - total("other_sig") / total("other_att"))
            assert row[p + "recent_win_rate"] == pytest.approx(sum(x["won"] for x in h[-3:]) / len(h[-3:]))
            assert row[p + "recent_sigstr_pm"] == pytest.approx(sum(x["sig"] for x in h[-3:]) / sum(x["minutes"] for x in h[-3:]))
            assert row[p + "finish_rate"] == pytest.approx(total("finished") / len(h))
        for side in (0, 1):
            won = float(result == (1.0, 0.0)[side])
            past.setdefault(players[side], []).append(
                {"won": won, "finished": won * finish, "sig": own[side][0], "minutes": seq % 5 + 1, "other_sig": own[1 - side][0], "other_att": own[1 - side][1]}
            )


def test_without_hot_keys_one_window_is_enough(spark):
    rng = random.Random(4)
    rows = [(f"p{rng.randrange(400)}", DAY + dt.timedelta(days=rng.randrange(200)), i, rng.choice([-1.0, 0.5, 2.0, None])) for i in range(4000)]
    df, hot = frame(spark, rows), frame(spark, hot_rows())
    assert P.uncrowded(df, ["who"]) and not P.uncrowded(hot, ["who"]) and not P.uncrowded(df, ["who"], 5) and not P.uncrowded(df, [])
    spec = {"s": ("sum", F.col("profit")), "n": ("count", F.lit(1)), "m": ("max", F.col("profit")), "l": ("min", F.col("profit"))}
    order = ["day", "seq"]

    def both(table):
        out = P.running(table, ["who"], P.month_slice("day"), order, spec, inclusive=False)
        return P.last_values(out, ["who"], P.month_slice("day"), order, F.col("profit"), 3)

    whole = both(df)
    assert "Join" not in whole._jdf.queryExecution().executedPlan().toString()
    # the same table with the few rows of one player that make it hot: the sliced form must agree on all others
    mixed = df.unionByName(frame(spark, [("hot", DAY, 10_000 + i, 1.0) for i in range(1500)]))
    assert "Join" in both(mixed)._jdf.queryExecution().executedPlan().toString()
    want = sorted(map(str, both(mixed).filter("who <> 'hot'").collect()))
    assert sorted(map(str, whole.collect())) == want and len(want) == 4000
