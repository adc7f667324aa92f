"""Splits by interval lookup: positions, no copies of contests, and the same bets as scanning every split on its own."""

from __future__ import annotations

import datetime as dt

import pytest
from helpers import contest_rows
from helpers import contests as table
from pyspark.sql import functions as F

from boutline.operators import splits as X


def test_interval_of_with_gaps_and_edges(spark):
    bounds = [("2020-01-01", "2020-02-01"), ("2020-02-01", "2020-02-02"), ("2020-03-01", "2020-04-01"), ("2021-01-01", "2021-06-01"), ("2021-06-01", "2021-07-01")]
    days = [dt.date(2019, 12, 31) + dt.timedelta(days=i) for i in range(620)]
    df = spark.createDataFrame([(d,) for d in [*days, None]], "day date")
    for n in range(len(bounds) + 1):
        got = df.select("day", X.interval_of(F.col("day"), bounds[:n]).alias("i")).collect()
        want = {d: next((i for i, (a, b) in enumerate(bounds[:n]) if a <= str(d) < b), None) for d in days} | {None: None}
        assert {r.day: r.i for r in got} == want
    with pytest.raises(ValueError):
        X.interval_of(F.col("day"), [("2020-01-01", "2020-02-01"), ("2020-01-15", "2020-03-01")])


@pytest.mark.parametrize("window", ["expanding", "rolling"])
def test_windows_hold_what_tagging_gives_without_copies(spark, window):
    c = table(spark, contest_rows(200, hot="p1"))
    splits = X.make_splits(c, 3, window, 3)
    assert len(splits) > 3
    tagged = {(r.seq, r.split_id, r.val_start) for r in X.tag(c, splits).filter(F.col("side") == "val").collect()}
    found = X.window_rows(c, splits, "val_start", "val_end")
    assert {(r.seq, r.split_id, r.val_start) for r in found.collect()} == tagged
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    if window == "rolling":
        train = {(r.seq, r.split_id) for r in X.tag(c, splits).filter(F.col("side") == "train").collect()}
        assert {(r.seq, r.split_id) for r in X.window_rows(c, splits, "train_start", "val_start").collect()} == train
