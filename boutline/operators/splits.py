"""Time splits: boundaries are a few rows computed on the driver, contests are tagged without a join."""

from __future__ import annotations

import calendar
import datetime as dt
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import history as H
from .bets import attach_prices, both_prices, decided, first_per_pair, picks, price_table, settle, vector_bets
from .oos import FROZEN, flag_frozen, frozen_at, latest_for_both, with_frozen
from .ratings import rate, rate_vectors, with_candidates

MIN_TRAIN_ROWS = 10


def add_months(d: dt.date, months: int) -> dt.date:
    """Calendar month step with the day clamped to the month's end."""
    y, m = divmod(d.year * 12 + d.month - 1 + months, 12)
    return dt.date(y, m + 1, min(d.day, calendar.monthrange(y, m + 1)[1]))


def parse_offset(text: str) -> int:
    """Months in ``'6M'`` or ``'1Y'``."""
    t = text.strip().upper()
    unit = {"M": 1, "Y": 12}.get(t[-1:])
    if unit is None or not t[:-1].strip().lstrip("+-").isdigit():
        raise ValueError(f"unsupported offset {text!r}; use 'NM' or 'NY'")
    return int(t[:-1]) * unit


def _candidate_splits(first: dt.date, last: dt.date, months: int, window: str, min_train_months: int) -> list[dict]:
    out, start = [], add_months(first, min_train_months)
    while start < last:
        end = add_months(start, months)
        train = first if window == "expanding" else add_months(start, -months)
        out.append({"split_id": len(out), "train_start": str(train), "val_start": str(start), "val_end": str(end)})
        start = end
    return out


def split_table(splits: list[dict]) -> Column:
    return F.from_json(F.lit(json.dumps(splits)), "array<struct<split_id:int,train_start:date,val_start:date,val_end:date>>")


def tag(contests: DataFrame, splits: list[dict]) -> DataFrame:
    """One row per contest and split it belongs to, with ``split_id``, ``side`` (train or val) and ``val_start``."""
    mine = F.filter(split_table(splits), lambda s: (F.col("day") >= s["train_start"]) & (F.col("day") < s["val_end"]))
    return (
        contests.withColumn("_s", F.explode(mine))
        .withColumns(
            {"split_id": F.col("_s.split_id"), "val_start": F.col("_s.val_start"), "side": F.when(F.col("day") < F.col("_s.val_start"), "train").otherwise("val")}
        )
        .drop("_s")
    )


def report(contests: DataFrame, splits: list[dict]) -> DataFrame:
    """First and last day and rows of each side of each split. Days are counted before they are replicated to splits."""
    per_day = contests.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    val = F.col("side") == "val"
    return (
        tag(per_day, splits)
        .groupBy("split_id")
        .agg(
            F.min(F.when(~val, F.col("day"))).alias("train_start"),
            F.max(F.when(~val, F.col("day"))).alias("train_end"),
            F.coalesce(F.sum(F.when(~val, F.col("n"))), F.lit(0)).alias("train_rows"),
            F.min(F.when(val, F.col("day"))).alias("val_start"),
            F.max(F.when(val, F.col("day"))).alias("val_end"),
            F.coalesce(F.sum(F.when(val, F.col("n"))), F.lit(0)).alias("val_rows"),
        )
    )


def make_splits(contests: DataFrame, months: int = 6, window: str = "expanding", min_train_months: int = 6) -> list[dict]:
    """Consecutive validation windows of ``months`` months; those without validation rows or with fewer than ten training rows
    are skipped. The result has one entry per window, so it fits the driver whatever the table's size."""
    if window not in ("expanding", "rolling"):
        raise ValueError(f"window must be 'expanding' or 'rolling', not {window!r}")
    if months < 1:
        raise ValueError("months must be at least 1")
    first, last = contests.agg(F.min("day"), F.max("day")).first()
    if first is None:
        return []
    drafts = _candidate_splits(first, last, months, window, min_train_months)
    if not drafts:
        return []
    rows = {r["split_id"]: r for r in report(contests, drafts).collect()}
    kept = [d for d in drafts if d["split_id"] in rows and rows[d["split_id"]]["val_rows"] > 0 and rows[d["split_id"]]["train_rows"] >= MIN_TRAIN_ROWS]
    return [{**d, "split_id": i} for i, d in enumerate(kept)]


def make_splits_by_offset(contests: DataFrame, offset: str, window: str = "expanding", min_train_periods: int = 1) -> list[dict]:
    months = parse_offset(offset)
    return make_splits(contests, months, window, months * min_train_periods)


def interval_of(day: Column, bounds: list[tuple[str, str]]) -> Column:
    """Position of the half-open interval that holds ``day``, null outside all of them.

    The intervals are sorted and do not overlap, so the answer is a binary search, written as a balanced tree of comparisons.
    """
    if any(b > c for (_, b), (c, _) in zip(bounds, bounds[1:])):
        raise ValueError("intervals overlap or are not sorted")

    def at(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return F.when(day < F.lit(bounds[lo][1]).cast("date"), F.lit(lo))
        mid = (lo + hi) // 2
        return F.when(day < F.lit(bounds[mid][0]).cast("date"), at(lo, mid)).otherwise(at(mid, hi))

    if not bounds:
        return F.lit(None).cast("int")
    return F.when(day >= F.lit(bounds[0][0]).cast("date"), at(0, len(bounds)))


def window_rows(contests: DataFrame, splits: list[dict], start: str, end: str) -> DataFrame:
    """Contests inside the splits' [start, end) windows with ``split_id`` and ``val_start``. Windows that follow each other hold a row once
    at most, so none is copied; a row in several windows that overlap (training by an expanding window) has one row for each."""
    ordered = sorted(splits, key=lambda s: s[start])
    if any(a[end] > b[start] for a, b in zip(ordered, ordered[1:])):
        every = F.filter(split_table(ordered), lambda s: (F.col("day") >= s[start]) & (F.col("day") < s[end]))
        return contests.withColumn("_s", F.explode(every)).withColumns({"split_id": F.col("_s.split_id"), "val_start": F.col("_s.val_start")}).drop("_s")
    found = contests.withColumn("_at", interval_of(F.col("day"), [(s[start], s[end]) for s in ordered])).filter(F.col("_at").isNotNull())
    split = F.get(split_table(ordered), F.col("_at"))
    return found.withColumns({"split_id": split["split_id"], "val_start": split["val_start"]}).drop("_at")


def split_bets(contests: DataFrame, odds: DataFrame, candidates: list[dict], splits: list[dict], window: str = "expanding") -> DataFrame:
    """Bets of every candidate on every validation window with ratings frozen at its start.

    Expanding windows share one scan: the frozen rating is the last one before the window's start, because a rating before a day never
    depends on later contests. Which contest that is and both sides' prices depend on the contest alone and are looked up once for all
    candidates, before the scan, which returns the vectors asked for. Rolling windows start empty and follow each other, so a contest trains
    one split only; the scan is keyed by split.
    """
    keys = ["candidate_id", "split_id"]
    rows = contests.select("seq", "day", "player", "opponent", "result", "is_draw")
    val = first_per_pair(decided(window_rows(rows, splits, "val_start", "val_end")), ["split_id"])
    if window == "expanding":
        return _expanding_bets(contests, val, odds, candidates)
    cards = with_candidates(val, candidates).drop("c")
    train = window_rows(contests, splits, "train_start", "val_start").drop("val_start")
    faced = latest_for_both(cards, H.latest_ratings(H.history(rate(train, candidates, keys=["split_id"]), keys), keys), keys)
    known = faced.filter(F.col("rating").isNotNull() & F.col("opp_rating").isNotNull()).withColumns({"pre": F.col("rating"), "opp_pre": F.col("opp_rating")})
    return settle(attach_prices(picks(known), price_table(odds), "mirror"))


def _expanding_bets(contests: DataFrame, val: DataFrame, odds: DataFrame, candidates: list[dict]) -> DataFrame:
    """Bets on validation contests, each in one split, with the ratings before its ``val_start``; nothing is joined per candidate."""
    priced = both_prices(val, price_table(odds)).filter(F.col("_price").isNotNull() | F.col("_opp_price").isNotNull())
    known = materialize(priced)
    frozen = materialize(frozen_at(contests, known, "val_start"))
    vectors = rate_vectors(flag_frozen(contests, frozen), candidates, carry=["_own", "_opp"], emit=FROZEN)
    return vector_bets(with_frozen(known, frozen, vectors).filter(F.col("rating").isNotNull() & F.col("opp_rating").isNotNull()))


def split_roi(bets: DataFrame, candidates: list[dict], splits: list[dict]) -> DataFrame:
    """ROI per candidate and split; a split without bets has an ROI of zero."""
    grid = bets.sparkSession.createDataFrame([(c, s["split_id"]) for c in range(len(candidates)) for s in splits], "candidate_id int, split_id int")
    g = bets.groupBy("candidate_id", "split_id").agg(
        F.count(F.lit(1)).alias("bets"), F.sum("stake").alias("wagered"), F.sum("profit").alias("profit"), F.sum("bet_won").alias("wins")
    )
    zero = {"bets": F.coalesce("bets", F.lit(0)), "wagered": F.coalesce("wagered", F.lit(0.0)), "profit": F.coalesce("profit", F.lit(0.0)), "wins": F.coalesce("wins", F.lit(0))}
    return g.join(F.broadcast(grid), ["candidate_id", "split_id"], "right").withColumns(zero).withColumn(
        "roi", F.coalesce(F.try_divide(F.col("profit"), F.col("wagered")) * 100.0, F.lit(0.0))
    )


def split_statistics(rois: DataFrame) -> DataFrame:
    """Mean and sample deviation of the splits' ROI per candidate (zero with one split)."""
    return rois.groupBy("candidate_id").agg(
        F.avg("roi").alias("mean"),
        F.when(F.count(F.lit(1)) > 1, F.stddev_samp("roi")).otherwise(0.0).alias("std"),
        F.count(F.lit(1)).alias("splits"),
        F.sum("bets").alias("bets"),
        F.array_sort(F.collect_list(F.struct("split_id", "roi"))).alias("per_split"),
    )
