import datetime as dt
import random

import pytest

from boutline.operators import metrics as M
from boutline.operators import resample as B
from boutline.operators import trends as TR
from boutline.operators.prefix import exact_quantiles, month_slice, running
from pyspark.sql import functions as F

D = dt.date(2023, 1, 1)


def scored(spark, p, y):
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(p, y)], "prob double, result double")


def bets(spark, profits, step=11):
    return spark.createDataFrame([(D + dt.timedelta(days=i * step), i, float(x), 1.0, int(x > 0), 0.6) for i, x in enumerate(profits)], "day date, seq long, profit double, stake double, bet_won int, prob double")


def test_ece(spark):
    assert M.expected_calibration_error(scored(spark, [0.1, 0.1, 0.5, 0.5, 0.9, 0.9], [0, 0, 0, 1, 1, 1]), bins=3).first()["ece"] == pytest.approx(0.0667, abs=1e-4)
    assert M.expected_calibration_error(scored(spark, [0.9] * 4 + [0.1] * 2, [0] * 4 + [1] * 2), bins=3).first()["ece"] == pytest.approx(0.9)


def test_auc(spark):
    assert M.auc(scored(spark, [0.1, 0.2, 0.8, 0.9], [0, 0, 1, 1])).first()["auc"] == 1.0
    assert M.auc(scored(spark, [0.1, 0.2], [1, 1])).first()["auc"] is None
    rng = random.Random(3)
    p = [round(rng.random(), 2) for _ in range(200)]
    y = [int(rng.random() < q) for q in p]
    pairs = [(a > b) + 0.5 * (a == b) for a, u in zip(p, y) if u for b, v in zip(p, y) if not v]
    assert M.auc(scored(spark, p, y)).first()["auc"] == pytest.approx(sum(pairs) / len(pairs))


def test_drawdown_by_hand(spark):
    r = M.max_drawdown(bets(spark, [1, 1, 1, -2, 1])).first()  # cumulative 1, 2, 3, 1, 2
    assert (r["max_drawdown"], r["duration"]) == (2.0, 2)
    assert r["drawdown_pct"] == pytest.approx(66.67, abs=0.01)
    assert M.max_drawdown(bets(spark, [1, 1, 1, 1, 1])).first()["max_drawdown"] == 0.0


def test_drawdown_brute_force(spark):
    rng = random.Random(5)
    x = [rng.choice([-1.0, 0.5, 1.5, 0.9]) for _ in range(90)]
    cum, peak, best, at, run, longest = 0.0, None, -1.0, None, 0, 0
    for v in x:
        cum = round(cum + v, 9)
        peak = cum if peak is None else max(peak, cum)
        dd = peak - cum
        if dd > best:
            best, at = dd, peak
        run = run + 1 if dd > 0 else 0
        longest = max(longest, run)
    r = M.max_drawdown(bets(spark, x, 3)).first()
    assert (r["max_drawdown"], r["duration"]) == (pytest.approx(best), longest)
    assert r["drawdown_pct"] == (pytest.approx(best / at * 100) if at > 0 else None)


def test_deciles_and_value_bets(spark):
    b = spark.createDataFrame([(0.55, 0.5, 1.0, 1), (0.65, -1.0, 1.0, 0), (0.75, 0.3, 1.0, 1)], "prob double, profit double, stake double, bet_won int")
    got = {r["decile"]: round(r["roi"], 6) for r in M.roi_by_decile(b).collect()}
    assert got == {"50-60%": 50.0, "60-70%": -100.0, "70-80%": 30.0}
    v = scored(spark, [0.6, 0.7, 0.4, 0.8], [1, 1, 0, 1]).withColumn("implied", F.lit(0.5))
    assert M.value_bets(v).first()["value_bets"] == 3


def test_roi_over_days(spark):
    b = bets(spark, [1, 1]).withColumns({"payout": F.lit(2.0)})
    last = M.roi_over_time(b, "day").orderBy(F.col("period").desc()).first()
    assert (last["cum_profit"], last["cum_wagered"], last["cum_roi"]) == (2.0, 2.0, 100.0)


def test_running_matches_a_plain_pass_with_a_hot_key(spark):
    rng = random.Random(2)
    rows = [(i, "hot" if i % 3 else f"k{i % 5}", D + dt.timedelta(days=i // 4), rng.randint(-5, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "seq long, who string, day date, v int")
    spec = {"s": ("sum", F.col("v")), "c": ("count", F.lit(1)), "m": ("max", F.col("v")), "n": ("min", F.col("v"))}
    for inclusive in (True, False):
        got = {r["seq"]: (r["s"], r["c"], r["m"], r["n"]) for r in running(df, ["who"], month_slice("day"), ["day", "seq"], spec, inclusive).collect()}
        seen = {}
        for seq, who, _, v in rows:
            vals = seen.setdefault(who, [])
            use = vals + [v] if inclusive else list(vals)
            want = (sum(use), len(use), max(use), min(use)) if use else (None, 0, None, None)
            assert got[seq] == want
            vals.append(v)


def test_quantiles(spark):
    rng = random.Random(1)
    x = sorted(round(rng.gauss(0, 3), 1) for _ in range(101))
    df = spark.createDataFrame([(v,) for v in x], "x double")
    r = exact_quantiles(df, "x", [0.0, 0.25, 0.5, 0.83, 1.0]).first()
    for got, q in zip(r, (0.0, 0.25, 0.5, 0.83, 1.0)):
        pos = 100 * q
        lo = int(pos)
        want = x[lo] + (x[min(lo + 1, 100)] - x[lo]) * (pos - lo)
        assert got == pytest.approx(want)


def test_exponential_average_across_blocks(spark):
    rng = random.Random(9)
    x = [float(rng.random() < 0.6) for _ in range(400)]
    df = spark.createDataFrame([(i, D + dt.timedelta(days=i), v) for i, v in enumerate(x)], "seq long, day date, v double")
    got = [r["ema"] for r in TR.exponential_average(df, "v", 6).orderBy("seq").collect()]
    y, want = None, []
    for v in x:
        y = v if y is None else 2 / 7 * v + 5 / 7 * y
        want.append(y)
    assert got == pytest.approx(want, abs=1e-12)


def test_bootstrap_draws_without_replacement(spark):
    b = bets(spark, [0.5] * 60, 2)
    for size in (10, 30):  # drawn positions, then ranked positions
        got = B.bootstrap_rows(b, size, 5).groupBy("replicate").agg(F.count("seq").alias("n"), F.countDistinct("seq").alias("d")).collect()
        assert len(got) == 5 and all(r["n"] == r["d"] == size for r in got)


def test_swing_pairs(spark):
    rois = spark.createDataFrame([(i, v) for i, v in enumerate([0.0, 10.0, 30.0, 33.4])], "replicate int, roi double")
    assert B.swing_pairs(rois, 23.4).first()["pairs"] == 3
