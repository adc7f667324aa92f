"""Rolling backtests, resampling and event samples. Randomness is the order of a hash, so every run and engine agrees."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..session import materialize
from . import bets as K
from .prefix import day_slice, running
from .sweep import best_of


def hash_text(*parts) -> Column:
    """Hash of the parts joined with bars; ordering by it shuffles rows reproducibly."""
    return F.md5(F.concat_ws("|", *[S.col(p).cast("string") for p in parts]))


def hash_number(*parts) -> Column:
    return F.conv(F.substring(hash_text(*parts), 1, 12), 16, 10).cast("long")


def replicates(df_or_spark, n: int, name: str = "replicate") -> DataFrame:
    return df_or_spark.range(n).select(F.col("id").cast("int").alias(name))


# --- rolling backtest ---


def backward_windows(first: dt.date, last: dt.date, window_days: int, step_days: int, n: int, warmup_days: int = 365) -> list[dict]:
    out = []
    for i in range(n):
        end = last - dt.timedelta(days=i * step_days)
        start = end - dt.timedelta(days=window_days)
        if start < first + dt.timedelta(days=warmup_days):
            break
        out.append({"window_num": i + 1, "start": str(start), "stop": str(end)})
    return out


def _windows(rows: list[dict]) -> Column:
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<window_num:int,start:date,stop:date>>")


def rolling_backtest(
    bets: DataFrame, contests: DataFrame, odds: DataFrame, window_days: int = 90, step_days: int = 30, n_windows: int = 10, train_days: int = 90
) -> DataFrame:
    """ROI of each candidate before and inside windows stepping back from the last day.

    Ratings never depend on later contests, so the bets of one scan serve all windows; only sums per day are replicated to windows.
    """
    first, last = contests.agg(F.min("day"), F.max("day")).first()
    windows = backward_windows(first, last, window_days, step_days, n_windows)
    each = F.explode(_windows(windows)).alias("w")
    inside = (F.col("day") >= F.col("w.start")) & (F.col("day") < F.col("w.stop"))
    before = F.col("day") < F.col("w.start")
    per_day = contests.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("priced"))
    odds_day = odds.groupBy("day").agg(F.lit(0).cast("long").alias("n"), F.count(F.lit(1)).alias("priced"))
    sizes = (
        per_day.unionByName(odds_day)
        .select("*", each)
        .groupBy(F.col("w.window_num").alias("window_num"))
        .agg(
            F.sum(F.when(before, F.col("n")).otherwise(0)).alias("train_fights"),
            F.sum(F.when(inside, F.col("n")).otherwise(0)).alias("test_fights"),
            F.sum(F.when(inside, F.col("priced")).otherwise(0)).alias("test_odds"),
            F.max(F.when(before & (F.col("n") > 0), F.col("day"))).alias("train_last"),
            F.max(F.when((before | inside) & (F.col("n") > 0), F.col("day"))).alias("test_last"),
        )
        .filter((F.col("train_fights") >= 100) & (F.col("test_fights") >= 10) & (F.col("test_odds") >= 5))
    )
    daily = bets.groupBy("candidate_id", "day").agg(F.sum("stake").alias("stake"), F.sum("profit").alias("profit"))
    spread = daily.select("*", each).withColumn("window_num", F.col("w.window_num")).join(F.broadcast(sizes), "window_num")
    in_train = before & (F.col("day") > F.date_sub("train_last", train_days))
    in_test = inside & (F.col("day") > F.date_sub("test_last", window_days))
    roi = lambda c: F.coalesce(F.try_divide(F.sum(F.when(c, F.col("profit"))), F.sum(F.when(c, F.col("stake")))) * 100.0, F.lit(0.0))
    g = spread.groupBy("window_num", "train_fights", "test_fights", "candidate_id").agg(roi(in_train).alias("train_roi"), roi(in_test).alias("test_roi"))
    return best_of(g.withColumn("roi_drop", F.col("train_roi") - F.col("test_roi")), "train_roi", ["window_num"])


# --- bootstraps ---


def sample_days(days: DataFrame, n_replicates: int, size: int, seed: int) -> DataFrame:
    """``size`` days without replacement per replicate: the smallest hashes. Both sides are bounded, by the calendar and by ``n``."""
    rows = days.select("day", F.explode(F.sequence(F.lit(0), F.lit(n_replicates - 1))).alias("replicate"))
    w = W.partitionBy("replicate").orderBy(hash_text(F.lit(seed), "replicate", "day"), "day")
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= size).drop("_n")


def bootstrap_dates(bets: DataFrame, odds: DataFrame, size: int, n_replicates: int, seed: int = 42, min_odds: int = 10) -> DataFrame:
    """ROI per replicate over sampled price days. Bets are summed per day first, so replication costs days, not bets."""
    odds_day = odds.groupBy("day").agg(F.count(F.lit(1)).alias("odds_rows"))
    bets_day = bets.groupBy("day").agg(F.sum("stake").alias("stake"), F.sum("profit").alias("profit"))
    table = odds_day.join(bets_day, "day", "left")
    drawn = sample_days(odds_day.select("day"), n_replicates, size // 3, seed)
    g = drawn.join(table, "day").groupBy("replicate").agg(F.sum("odds_rows").alias("odds_rows"), F.sum("stake").alias("stake"), F.sum("profit").alias("profit"))
    return g.filter(F.col("odds_rows") >= min_odds).select("replicate", F.coalesce(F.try_divide("profit", "stake") * 100.0, F.lit(0.0)).alias("roi"))


def distribution(rois: DataFrame, given: float | None = None) -> DataFrame:
    """Spread of the replicates' ROI; one value per replicate, so exact percentiles are cheap."""
    out = rois.agg(
        F.count(F.lit(1)).alias("n"), F.avg("roi").alias("mean"), F.stddev_pop("roi").alias("sd"), F.percentile("roi", F.lit(0.05)).alias("p5"),
        F.percentile("roi", F.lit(0.95)).alias("p95"), F.min("roi").alias("low"), F.max("roi").alias("high"),
    )
    if given is None:
        return out
    return out.withColumn("z", F.when(F.col("sd") > 0, (F.lit(given) - F.col("mean")) / F.col("sd")).otherwise(0.0))


def eligible_bets(rated: DataFrame, source: DataFrame, odds: DataFrame) -> DataFrame:
    """Bets where equal ratings count as a bet on the opponent; needs the chosen side's own price."""
    df = K.with_prior_history(K.first_per_pair(K.decided(rated)), source)
    up = F.col("pre") > F.col("opp_pre")
    chosen = df.withColumns(
        {
            "bet_on": F.when(up, F.col("player")).otherwise(F.col("opponent")),
            "bet_against": F.when(up, F.col("opponent")).otherwise(F.col("player")),
            "bet_won": F.when(up, F.col("result") == 1.0).otherwise(F.col("result") == 0.0).cast("int"),
        }
    )
    return K.settle(K.attach_prices(chosen, K.price_table(odds)))


def bootstrap_rows(rows: DataFrame, size: int, n_replicates: int, seed: int = 42) -> DataFrame:
    """``size`` rows without replacement per replicate.

    Rows get a position (day, seq). A replicate draws hashed positions, one after another, and keeps the first ``size`` distinct ones: the
    same rule for any number of rows, and work of replicates x size. Draws are added until every replicate has its rows.
    """
    base = materialize(rows)
    n = base.count()
    if n < size:
        raise ValueError(f"{n} rows are too few to draw {size}")
    numbered = running(base, [], day_slice("day"), ["day", "seq"], {"pos": ("count", F.lit(1))}, inclusive=False)
    reps = F.explode(F.sequence(F.lit(0), F.lit(n_replicates - 1))).alias("replicate")
    tries = 4 * size + 64
    while True:
        drawn = rows.sparkSession.range(tries).select(F.col("id").alias("j"), reps).withColumn("pos", hash_number(F.lit(seed), "replicate", "j") % n)
        first = materialize(drawn.groupBy("replicate", "pos").agg(F.min("j").alias("_o")))
        if first.groupBy("replicate").count().agg(F.min("count")).first()[0] >= size:
            break
        tries *= 2
    w = W.partitionBy("replicate").orderBy("_o", "pos")
    picked = first.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= size).select("replicate", "pos")
    return numbered.join(picked, "pos")


def roi_per_replicate(drawn: DataFrame) -> DataFrame:
    return drawn.groupBy("replicate").agg((F.sum("profit") / F.sum("stake") * 100.0).alias("roi"))


def swing_pairs(rois: DataFrame, swing: float) -> DataFrame:
    """Pairs of replicates at least ``swing`` apart, counted with a range frame instead of a pair list."""
    scale = 10**9  # whole units: a range frame needs them
    w = W.orderBy("_r").rangeBetween(W.unboundedPreceding, -round(swing * scale))
    g = rois.withColumn("_r", F.round(F.col("roi") * scale).cast("long")).withColumn("far", F.count(F.lit(1)).over(w)).agg(F.sum("far").alias("pairs"), F.count(F.lit(1)).alias("n"))
    return g.select("pairs", (F.try_divide(F.col("pairs"), F.col("n") * (F.col("n") - 1) / 2) * 100.0).alias("share"))


# --- event samples ---


def sampled_days(bets: DataFrame, n: int, seed: int) -> DataFrame:
    return bets.select("day").distinct().orderBy(hash_text(F.lit(seed), "day"), "day").limit(n)


def bet_detail(bets: DataFrame, rated: DataFrame, odds: DataFrame, books: list[str], label: Column) -> DataFrame:
    """Each bet with both sides' ratings before and after, method, round and every book's price of the chosen side."""
    # last stored row of a pair and day speaks for it, seen from its own player's side
    stored = (
        rated.select("day", "player", "opponent", "seq", "pre", "post", "opp_pre", "opp_post", label.alias("method"), "round")
        .groupBy(F.least("player", "opponent").alias("_a"), F.greatest("player", "opponent").alias("_b"), "day")
        .agg(*[F.max_by(c, "seq").alias(f"_{c}") for c in ("player", "pre", "post", "opp_pre", "opp_post", "method", "round")])
    )
    b = bets.select("seq", "day", "bet_on", "bet_against", "bet_won", "diff", "prob", "american", "decimal", "stake", "payout", "profit")
    keyed = b.withColumns({"_a": F.least("bet_on", "bet_against"), "_b": F.greatest("bet_on", "bet_against")}).join(stored, ["_a", "_b", "day"], "left")
    same = F.col("_player") == F.col("bet_on")
    side = lambda own, other: F.when(same, F.col(own)).otherwise(F.col(other))
    out = keyed.withColumns(
        {
            "on_pre": side("_pre", "_opp_pre"), "on_post": side("_post", "_opp_post"), "against_pre": side("_opp_pre", "_pre"), "against_post": side("_opp_post", "_post"),
            "method": F.col("_method"), "round": F.col("_round"),
        }
    )
    out = out.withColumns({"on_change": F.col("on_post") - F.col("on_pre"), "against_change": F.col("against_post") - F.col("against_pre")})
    priced = out.join(first_prices(odds, books), ["_a", "_b", "day"], "left").select("*", *[F.col(f"_price.{b}").alias(b) for b in books])
    return priced.drop(*[c for c in priced.columns if c.startswith("_")])


def first_prices(odds: DataFrame, columns: list[str]) -> DataFrame:
    """Prices of the first odds row of each unordered pair and day, nulls included, as a struct column ``_price``."""
    return odds.groupBy(F.least("player", "opponent").alias("_a"), F.greatest("player", "opponent").alias("_b"), "day").agg(
        F.min_by(F.struct(*columns), "odds_seq").alias("_price")
    )


def unbet(rated: DataFrame, source: DataFrame, bets: DataFrame, odds: DataFrame) -> DataFrame:
    """Eligible contests of a day without a bet on either side, and why."""
    shown = K.first_per_pair(rated)
    valid = K.with_prior_history(K.decided(shown), source)
    pair = lambda a, b: [F.least(a, b).alias("_a"), F.greatest(a, b).alias("_b"), "day"]
    keyed = valid.select("*", F.least("player", "opponent").alias("_a"), F.greatest("player", "opponent").alias("_b"))
    left = keyed.join(bets.select(*pair("bet_on", "bet_against")).distinct(), ["_a", "_b", "day"], "left_anti")
    priced = left.join(first_prices(odds, ["american"]), ["_a", "_b", "day"], "left")
    price = F.col("_price.american")
    reason = S.first_match([(price.isNull() | (price == 0), F.lit("no_price")), (F.col("pre") == F.col("opp_pre"), F.lit("equal_ratings"))], "price_not_matched")
    return priced.withColumns({"american": price, "reason": reason}).drop("_a", "_b", "_price")


def event_summary(bets: DataFrame, others: DataFrame) -> DataFrame:
    g = bets.groupBy("day").agg(
        F.count(F.lit(1)).alias("bets"), F.sum("bet_won").alias("won"), F.sum("stake").alias("wagered"), F.sum("payout").alias("payout")
    )
    n = others.groupBy("day").agg(F.count(F.lit(1)).alias("unbet"))
    return g.join(n, "day", "left").select(
        "day", "bets", "won", (F.col("bets") - F.col("won")).alias("lost"), "wagered", "payout", (F.col("payout") - F.col("wagered")).alias("profit"),
        ((F.col("payout") - F.col("wagered")) / F.col("wagered") * 100.0).alias("roi"), F.coalesce("unbet", F.lit(0)).alias("unbet"),
    )


