import datetime as dt

import pytest
from helpers import contest_rows, contests

from boutline.operators import bets as K
from boutline.operators import history as H
from boutline.operators import oos as O
from boutline.operators import ratings as R
from boutline.operators import splits as X
from boutline.operators import sweep as Z
from boutline.sources import contests as C
from pyspark.sql import functions as F

D = dt.date(2024, 1, 1)
RATED = "seq long, day date, player string, opponent string, result double, is_draw boolean, pre double, opp_pre double, post double, opp_post double, candidate_id int"


def rated(spark, rows):
    return spark.createDataFrame([(i, D + dt.timedelta(days=d), a, b, r, r == 0.5, float(p), float(q), p + 10.0, q - 10.0, 0) for i, (d, a, b, r, p, q) in enumerate(rows)], RATED)


def odds(spark, rows):
    return spark.createDataFrame([(i, D + dt.timedelta(days=d), a, b, o) for i, (d, a, b, o) in enumerate(rows)], "odds_seq long, day date, player string, opponent string, american double")


HISTORY = [(0, "A", "B", 1.0, 1500.0, 1500.0), (10, "A", "B", 1.0, 1520.0, 1480.0), (20, "A", "B", 0.5, 1530.0, 1470.0)]


def test_bet_on_higher_rating_with_its_price(spark):
    r = rated(spark, HISTORY)
    got = K.bet_records(r, r, odds(spark, [(10, "A", "B", -200.0), (10, "B", "A", 150.0), (20, "A", "B", 100.0)])).collect()
    assert [(b["bet_on"], b["american"], b["decimal"], b["profit"]) for b in got] == [("A", -200.0, 1.5, 0.5)]


def test_price_policies(spark):
    r = rated(spark, HISTORY[:2])
    mirrored = odds(spark, [(10, "B", "A", 150.0)])
    assert K.bet_records(r, r, mirrored).count() == 0
    assert K.bet_records(r, r, mirrored, fallback="mirror").first()["american"] == 150.0
    assert K.bet_records(r, r, odds(spark, [(10, "A", "B", None)])).count() == 0
    last = odds(spark, [(10, "A", "B", -110.0), (10, "A", "B", -300.0)])
    assert K.bet_records(r, r, last).first()["american"] == -300.0
    with pytest.raises(ValueError):
        K.bet_records(r, r, last, fallback="other")


def test_early_dedup_hides_the_mirror_row(spark):
    rows = [(0, "A", "B", 1.0, 1500.0, 1500.0), (5, "A", "B", 1.0, 1510.0, 1510.0), (5, "B", "A", 0.0, 1400.0, 1510.0)]
    r = rated(spark, rows)
    prices = odds(spark, [(5, "A", "B", 100.0), (5, "B", "A", -120.0)])
    assert K.bet_records(r, r, prices, dedup="early").count() == 0
    assert K.bet_records(r, r, prices, dedup="late").count() == 1


def test_debuts_are_not_bet_on(spark):
    r = rated(spark, [(0, "A", "B", 1.0, 1600.0, 1500.0), (9, "A", "C", 1.0, 1600.0, 1500.0)])
    assert K.bet_records(r, r, odds(spark, [(0, "A", "B", 100.0), (9, "A", "C", 100.0)])).count() == 0


def test_as_of_is_strict(spark):
    r = rated(spark, HISTORY)
    got = {x["seq"]: x["rating"] for x in O.ratings_as_of(r.select("seq", "day", "player", "opponent"), H.history(r)).collect()}
    assert got == {0: None, 1: 1510.0, 2: 1530.0}


def test_names(spark):
    roster = spark.createDataFrame([("José Aldo",), ("Mateusz Rębecki",), ("Anna Maria Lopez",)], "player string")
    names = spark.createDataFrame([("jose aldo",), ("MATEUSZ REBECKI",), ("Anna Lopez",), ("Nobody",), ("Ann Other",)], "name string")
    got = {r["name"]: (r["matched"], r["how"]) for r in H.match_names(names, roster).collect()}
    assert got == {
        "jose aldo": ("José Aldo", "exact"), "MATEUSZ REBECKI": ("Mateusz Rębecki", "exact"), "Anna Lopez": ("Anna Maria Lopez", "ends"),
        "Nobody": ("Nobody", "none"), "Ann Other": ("Ann Other", "none"),
    }


def test_layoff_ignores_the_same_day(spark):
    r = rated(spark, [(0, "A", "B", 1.0, 1, 1), (30, "A", "B", 1.0, 1, 1), (30, "A", "C", 1.0, 1, 1)])
    got = {x["seq"]: (x["layoff"], x["opp_layoff"]) for x in H.layoff_days(r.select("seq", "day", "player", "opponent")).collect()}
    assert got == {0: (None, None), 1: (30, 30), 2: (30, None)}


def test_month_steps_stay_clamped():
    d = X.add_months(dt.date(2020, 1, 31), 1)
    assert d == dt.date(2020, 2, 29) and X.add_months(d, 1) == dt.date(2020, 3, 29)
    assert [X.parse_offset(x) for x in ("6M", "1Y", " 2m ")] == [6, 12, 2]
    for bad in ("6D", "M", ""):
        with pytest.raises(ValueError):
            X.parse_offset(bad)


def test_splits(spark):
    days = [dt.date(2020 + m // 12, m % 12 + 1, 28) for m in range(36) for _ in range(4)]
    c = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "seq long, day date")
    grow = [r["train_rows"] for r in X.report(c, X.make_splits(c, 6, "expanding", 6)).orderBy("split_id").collect()]
    assert grow == sorted(grow) and len(set(grow)) == len(grow)
    roll = X.report(c, X.make_splits(c, 6, "rolling", 6)).collect()
    assert {r["train_rows"] for r in roll} == {24}
    assert all(r["train_end"] < r["val_start"] for r in roll)
    with pytest.raises(ValueError):
        X.make_splits(c, 6, "sliding")
    assert X.make_splits(c.limit(0)) == []


def test_split_windows_agree_with_scans_per_split(spark):
    """An expanding split's frozen rating equals the last rating of a scan over its training rows alone."""
    c = contests(spark, contest_rows(90))
    splits = X.make_splits(c, 2, "expanding", 3)
    o = c.select(F.col("seq").alias("odds_seq"), "day", "player", "opponent", F.lit(-120.0).alias("american"))
    fast = X.split_bets(c, o, [{"k": 32.0}], splits, "expanding")
    slow = X.split_bets(c, o, [{"k": 32.0}], splits, "rolling")  # scans each split's own training rows
    key = lambda df: sorted((r["split_id"], r["seq"], r["bet_on"], round(r["diff"], 9)) for r in df.collect())
    assert key(fast) == key(slow) and len(key(fast)) > 5


def test_expanding_splits_join_contests_not_candidates(spark):
    """Prices fall back on the mirrored row as for rolling windows, and no join stands above the rows per candidate."""
    c = contests(spark, contest_rows(90))
    splits = X.make_splits(c, 2, "expanding", 3)
    price = F.when(F.col("seq") % 5 == 0, 0.0).when(F.col("seq") % 5 != 1, -120.0 - F.col("seq"))
    rows = c.select((F.col("seq") * 2).alias("odds_seq"), "day", "player", "opponent", price.alias("american"))
    mirror = c.filter("seq % 3 = 0").select((F.col("seq") * 2 + 1).alias("odds_seq"), "day", F.col("opponent").alias("player"), F.col("player").alias("opponent"), (100.0 + F.col("seq")).alias("american"))
    o, candidates = rows.unionAll(mirror), [{"k": 32.0}, {"k": 200.0, "w_ko": 1.9}]
    fast, slow = (X.split_bets(c, o, candidates, splits, w) for w in ("expanding", "rolling"))
    key = lambda df: sorted((r["candidate_id"], r["split_id"], r["seq"], r["bet_on"], r["bet_won"], r["american"], round(r["profit"], 9)) for r in df.collect())
    assert key(fast) == key(slow) and len(key(fast)) > 10 and {r[5] > 0 for r in key(fast)} == {True, False}
    plan = fast._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert min(i for i, line in enumerate(plan) if "Generate" in line) < min(i for i, line in enumerate(plan) if "Join" in line)


def test_training_and_holdout_bets_share_one_scan(spark):
    """The bets are those of a scan per candidate whose rows are joined, and no join stands above the rows per candidate."""
    c = contests(spark, contest_rows(90))
    cut = c.agg(F.date_sub(F.max("day"), 30)).first()[0]
    train, hold = c.filter(F.col("day") <= F.lit(cut)), c.filter(F.col("day") > F.lit(cut)).withColumn("player", F.when(F.col("seq") % 4 == 0, F.upper("player")).otherwise(F.col("player")))
    side = F.col("seq") % 3
    o = c.filter(side < 2).select(F.col("seq").alias("odds_seq"), "day", F.when(side == 0, F.col("player")).otherwise(F.col("opponent")).alias("player"), F.when(side == 0, F.col("opponent")).otherwise(F.col("player")).alias("opponent"), (-120.0 - F.col("seq")).alias("american"))
    candidates = [{"k": 32.0}, {"k": 200.0, "w_ko": 1.9}]
    inside, outside = Z.train_and_holdout_bets(train, hold, o, candidates, 300)
    rated = R.rate(train, candidates, carry=["result", "is_draw"])
    key = lambda df: sorted((r["candidate_id"], r["seq"], r["bet_on"], r["bet_won"], r["american"], round(r["diff"], 9), round(r["profit"], 9)) for r in df.collect())
    assert key(outside) == key(O.oos_bets(rated, train, hold, o, candidates)) and key(outside)
    assert key(inside) == key(K.bet_records(rated, train, o, ["candidate_id"], 300)) and key(inside)
    plan = outside._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert min(i for i, line in enumerate(plan) if "Generate" in line) < min(i for i, line in enumerate(plan) if "Join" in line)


def test_cleaning(spark):
    raw = spark.createDataFrame([("2024-01-05T10:00:00Z", "A", "B", " 1", "0", "0"), ("bad", "C", "D", "n/a", None, "1")], "DATE string, player string, opponent string, result string, win string, loss string")
    rows = C.clean_contests(raw).orderBy("player").collect()
    assert (rows[0]["day"], rows[0]["result"], rows[0]["is_draw"]) == (dt.date(2024, 1, 5), 1.0, True)
    assert (rows[1]["day"], rows[1]["result"], rows[1]["is_draw"], rows[1]["ko"]) == (None, None, False, None)
    with pytest.raises(ValueError):
        C.clean_contests(raw.drop("DATE"))
    assert C.time_column(spark.range(1).withColumn("TIMESTAMP", F.lit(1))) == "TIMESTAMP"


def test_holdout_file(spark, tmp_path):
    path = tmp_path / "h.csv"
    path.write_text("date,fighter,opp_fighter,result,avg_odds, opp_avg_odds\r\n2024-02-03,Łuk,B,1, +200, -250\r\n2024-02-03,C,D,0, 195,-210\r\n", encoding="utf-8", newline="")
    rows = C.clean_holdout(C.read_csv_text(spark, str(path))).orderBy("opponent").collect()
    assert [(r["american"], r["opp_american"], r["result"]) for r in rows] == [(200.0, -250.0, 1.0), (195.0, -210.0, 0.0)]
    assert rows[0]["player"] == "Łuk"
