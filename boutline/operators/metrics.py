"""Accuracy, calibration, ROI and risk metrics. Every function aggregates per ``keys`` (a candidate, a split, nothing)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import buckets as B
from ..functions import scalar as S
from ..session import materialize
from .prefix import day_slice, place, running, sliced, value_slices

PICK_EPS = 1e-15
BET_EPS = 1e-10
PERIODS = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}


def period_name(period: str, day="day") -> Column:
    """Sortable text of the period a day falls in."""
    d = S.col(day)
    if period == "quarter":
        return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))
    return F.date_format(d, PERIODS[period])


def hit(prob="prob", actual="result") -> Column:
    return ((S.col(prob) > 0.5).cast("double") == S.col(actual)).cast("double")


def accuracy_after(pred: DataFrame, cutoff) -> DataFrame:
    """Overall accuracy, accuracy after a cutoff (column or literal timestamp) and the number of later rows."""
    late = F.col("played_at") > cutoff
    return pred.agg(F.avg("correct").alias("accuracy"), F.avg(F.when(late, F.col("correct"))).alias("later_accuracy"), F.count_if(late).alias("later_rows"))


def probability_metrics(scored: DataFrame, keys: list[str] = (), eps: float = PICK_EPS) -> DataFrame:
    return scored.groupBy(*keys).agg(
        F.avg(hit()).alias("accuracy"),
        F.avg(S.log_loss_term("prob", "result", eps)).alias("log_loss"),
        F.avg(S.brier_term("prob", "result")).alias("brier"),
        F.count(F.lit(1)).alias("n"),
    )


def roi_summary(bets: DataFrame, keys: list[str] = ()) -> DataFrame:
    won = F.col("bet_won").cast("double")
    return bets.groupBy(*keys).agg(
        (F.try_divide(F.sum("profit"), F.sum("stake")) * 100.0).alias("roi"),
        F.avg(won).alias("accuracy"),
        F.avg(S.log_loss_term("prob", won, BET_EPS)).alias("log_loss"),
        F.avg(S.brier_term("prob", won)).alias("brier"),
        F.sum("stake").alias("wagered"),
        F.sum("payout").alias("returned"),
        F.sum("profit").alias("profit"),
        F.count(F.lit(1)).alias("bets"),
    )


def daily(bets: DataFrame, keys: list[str] = ()) -> DataFrame:
    return bets.groupBy(*keys, "day").agg(
        F.sum("stake").alias("stake"), F.sum("profit").alias("profit"), F.sum("bet_won").alias("wins"), F.count(F.lit(1)).alias("bets")
    )


def roi_extended(bets: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Trend, Sharpe and range of the daily ROI. Windows run over one row per calendar day."""
    w = W.partitionBy(*keys).orderBy("day")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    d = daily(bets, keys).withColumns(
        {
            "roi": F.col("profit") / F.col("stake") * 100.0,
            "cum_roi": F.sum("profit").over(upto) / F.sum("stake").over(upto) * 100.0,
            "x": (F.row_number().over(w) - 1).cast("double"),
        }
    )
    days = F.count(F.lit(1))
    sd = F.stddev_samp("roi")
    return d.groupBy(*keys).agg(
        F.when(days >= 2, F.regr_slope("cum_roi", "x")).alias("trend"),
        F.when((days >= 2) & (sd > 0), F.avg("roi") / sd * math.sqrt(52)).alias("sharpe"),
        F.min("roi").alias("min_roi"),
        F.max("roi").alias("max_roi"),
        (F.sum("wins") / F.sum("bets")).alias("win_rate"),
        F.sum("bets").alias("bets"),
        F.sum("stake").alias("wagered"),
        F.sum("profit").alias("profit"),
    )


def roi_over_time(bets: DataFrame, period: str, keys: list[str] = ()) -> DataFrame:
    g = bets.groupBy(*keys, period_name(period).alias("period")).agg(
        F.sum("stake").alias("wagered"),
        F.sum("payout").alias("returned"),
        F.sum("profit").alias("profit"),
        F.sum("bet_won").alias("wins"),
        F.count(F.lit(1)).alias("bets"),
        F.avg("prob").alias("mean_prob"),
    )
    w = W.partitionBy(*keys).orderBy("period").rowsBetween(W.unboundedPreceding, 0)
    cum = {f"cum_{c}": F.sum(c).over(w) for c in ("wagered", "returned", "profit", "wins", "bets")}
    return g.withColumns({"roi": F.col("profit") / F.col("wagered") * 100.0, "accuracy": F.col("wins") / F.col("bets"), **cum}).withColumn(
        "cum_roi", F.col("cum_profit") / F.col("cum_wagered") * 100.0
    )


def period_counts(over_time: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return over_time.agg(
        n.alias("periods"),
        F.count_if(F.col("profit") > 0).alias("profitable"),
        F.count_if(F.col("profit") < 0).alias("losing"),
        (F.avg((F.col("profit") > 0).cast("double")) * 100.0).alias("profitable_share"),
        (F.avg((F.col("profit") < 0).cast("double")) * 100.0).alias("losing_share"),
    )


def first_and_last(over_time: DataFrame, n: int) -> DataFrame:
    """The first and the last ``n`` periods of a period table."""
    a = F.row_number().over(W.orderBy("period"))
    z = F.row_number().over(W.orderBy(F.col("period").desc()))
    return over_time.withColumns({"from_start": a, "from_end": z}).filter((F.col("from_start") <= n) | (F.col("from_end") <= n))


def compare_books(odds: DataFrame, books: list[str]) -> DataFrame:
    """How well each book's prices predict results: first usable row of each pair and day counts, per book."""
    from ..sources.contests import books_long

    long = books_long(odds.select("odds_seq", "day", "player", "opponent", "result", *books), books)
    usable = long.filter(F.col("result").isin(0.0, 1.0) & F.col("day").isNotNull() & F.col("price").isNotNull())
    w = W.partitionBy("book", F.least("player", "opponent"), F.greatest("player", "opponent"), "day").orderBy("odds_seq")
    first = usable.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") == 1)
    p = first.withColumn("decimal", S.decimal_odds("price")).filter(F.col("decimal") > 1).withColumn("prob", 1.0 / F.col("decimal"))
    return probability_metrics(p, ["book"], BET_EPS)


def best_books(compared: DataFrame) -> DataFrame:
    return compared.agg(
        F.max_by("book", F.struct("accuracy", "book")).alias("best_accuracy"),
        F.min_by("book", F.struct("log_loss", "book")).alias("best_log_loss"),
        F.min_by("book", F.struct("brier", "book")).alias("best_brier"),
    )


def calibration_bins(scored: DataFrame, keys: list[str] = (), bins: int = 10) -> DataFrame:
    return (
        scored.withColumn("bin", B.left_closed_bin("prob", bins))
        .groupBy(*keys, "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("prob").alias("mean_prob"), F.avg("result").alias("win_rate"), F.avg(hit()).alias("accuracy"))
    )


def with_empty_bins(binned: DataFrame, bins: int = 10) -> DataFrame:
    """All bins of a table without keys, empty ones with zero rows."""
    every = binned.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(binned), "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def expected_calibration_error(scored: DataFrame, keys: list[str] = (), bins: int = 10) -> DataFrame:
    b = calibration_bins(scored, keys, bins)
    gap = F.col("n") * F.abs(F.col("mean_prob") - F.col("win_rate"))
    return b.groupBy(*keys).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def calibration_line(scored: DataFrame, keys: list[str] = ()) -> DataFrame:
    return scored.groupBy(*keys).agg(F.regr_slope("result", "prob").alias("slope"), F.regr_intercept("result", "prob").alias("intercept")).withColumns(
        {"overconfident": (F.col("slope") < 0.9).cast("int"), "underconfident": (F.col("slope") > 1.1).cast("int")}
    )


def calibration_all(scored: DataFrame, keys: list[str]) -> DataFrame:
    keys = list(keys)
    p = probability_metrics(scored, keys, BET_EPS).select(*keys, "log_loss", "brier", "n")
    return p.join(expected_calibration_error(scored, keys), keys).join(calibration_line(scored, keys), keys)


def auc(scored: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Exact area under the ROC curve by rank sums over distinct scores; null with one class only."""
    counted = materialize(scored.groupBy(*keys, "prob").agg(F.sum("result").alias("pos"), F.sum(1.0 - F.col("result")).alias("neg")))
    ranked = running(counted, list(keys), value_slices(counted, "prob"), ["prob"], {"below": ("sum", F.col("neg"))}, inclusive=False)
    wins = F.sum(F.col("pos") * (F.coalesce("below", F.lit(0.0)) + F.col("neg") / 2.0))
    return ranked.groupBy(*keys).agg(F.try_divide(wins, F.sum("pos") * F.sum("neg")).alias("auc"))


def precision_recall(scored: DataFrame, keys: list[str] = (), threshold: float = 0.5) -> DataFrame:
    fav = F.col("prob") > threshold
    won = F.col("result") == 1.0
    both = (F.count_if(fav) > 0) & (F.count_if(~fav) > 0) & (F.count_if(won) > 0) & (F.count_if(~won) > 0)
    return scored.groupBy(*keys).agg(
        F.when(both, F.avg(F.when(fav, F.col("result")))).alias("favorite_precision"),
        F.when(both, F.count_if(fav & won) / F.count_if(won)).alias("favorite_recall"),
        F.when(both, F.count_if(fav)).otherwise(0).alias("favorites"),
        F.when(both, F.avg(F.when(~fav, 1.0 - F.col("result")))).alias("underdog_precision"),
        F.when(both, F.count_if(~fav)).otherwise(0).alias("underdogs"),
    )


def confidence_separation(scored: DataFrame, keys: list[str] = ()) -> DataFrame:
    a, b = F.avg(F.when(F.col("result") == 1.0, F.col("prob"))), F.avg(F.when(F.col("result") == 0.0, F.col("prob")))
    return scored.groupBy(*keys).agg(a.alias("winners"), b.alias("losers"), (a - b).alias("separation"))


def decile_label(bin_index: Column) -> Column:
    return F.concat((bin_index * 10).cast("string"), F.lit("-"), ((bin_index + 1) * 10).cast("string"), F.lit("%"))


def roi_by_decile(bets: DataFrame, keys: list[str] = ()) -> DataFrame:
    g = (
        bets.withColumn("bin", B.right_closed_decile("prob"))
        .groupBy(*keys, "bin")
        .agg(
            F.count(F.lit(1)).alias("bets"),
            (F.sum("profit") / F.sum("stake") * 100.0).alias("roi"),
            F.avg(F.col("bet_won").cast("double")).alias("win_rate"),
            F.sum("stake").alias("wagered"),
        )
    )
    w = W.partitionBy(*keys)
    best = F.max_by("bin", F.struct("roi", -F.col("bin"))).over(w)
    worst = F.min_by("bin", F.struct("roi", "bin")).over(w)
    return g.withColumns({"decile": decile_label(F.col("bin")), "is_best": (F.col("bin") == best).cast("int"), "is_worst": (F.col("bin") == worst).cast("int")})


def drawdown_series(bets: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Cumulative profit, its running peak and the drawdown after each bet, in (day, seq) order.

    Two-level: inside a day (or part of a crowded one) with a window, across these with one total row each. The running peak starts at the first
    value, so a first loss is not a drawdown.
    """
    keys = list(keys)
    rows = sliced(bets.select(*keys, "day", "seq", "profit"), keys, day_slice("day"), place("day", "seq"))
    w = W.partitionBy(*keys, "_slice").orderBy("day", "seq").rowsBetween(W.unboundedPreceding, 0)
    local = rows.withColumn("_local", F.sum("profit").over(w)).withColumn("_top", F.max("_local").over(w))
    totals = local.groupBy(*keys, "_slice").agg(F.sum("profit").alias("_sum"), F.max("_local").alias("_high"))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carry = totals.withColumn("_carry", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)))
    carry = carry.withColumn("_peak", F.max(F.round(F.col("_carry") + F.col("_high"), 9)).over(before)).select(*keys, "_slice", "_carry", "_peak")
    joined = local.join(carry, [*keys, "_slice"])
    value = F.round(F.col("_carry") + F.col("_local"), 9)
    peak = F.greatest(F.round(F.col("_carry") + F.col("_top"), 9), F.coalesce("_peak", F.lit(float("-inf"))))
    return joined.withColumns({"value": value, "peak": peak}).select(*keys, "day", "seq", "value", "peak", (F.col("peak") - F.col("value")).alias("drawdown"))


def deepest_drawdown(bets: DataFrame, keys: list[str] = ()) -> DataFrame:
    """``max_drawdown`` of ``max_drawdown`` alone. No series is written: a slice is summed up by its total, its highest and lowest value and its own
    deepest fall, and a fall over slices is from the highest value before a slice to the lowest in it."""
    keys = list(keys)
    rows = sliced(bets.select(*keys, "day", "seq", "profit"), keys, day_slice("day"), place("day", "seq"))
    w = W.partitionBy(*keys, "_slice").orderBy("day", "seq").rowsBetween(W.unboundedPreceding, 0)
    local = rows.withColumn("_local", F.sum("profit").over(w)).withColumn("_top", F.max("_local").over(w))
    parts = local.groupBy(*keys, "_slice").agg(
        F.sum("profit").alias("_sum"), F.max("_local").alias("_high"), F.min("_local").alias("_low"), F.max(F.col("_top") - F.col("_local")).alias("_fall")
    )
    # one row per slice
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carried = parts.withColumn("_carry", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)))
    carried = carried.withColumn("_peak", F.max(F.col("_carry") + F.col("_high")).over(before))
    return carried.groupBy(*keys).agg(F.round(F.max(F.greatest("_fall", F.col("_peak") - F.col("_carry") - F.col("_low"))), 9).alias("max_drawdown"))


def max_drawdown(bets: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Largest drawdown, its share of the peak at the first time it is reached, and the longest stretch below a peak."""
    keys = list(keys)
    series = materialize(drawdown_series(bets, keys))
    under = F.col("drawdown") > 0
    marked = running(series, keys, day_slice("day"), ["day", "seq"], {"peaks": ("sum", (~under).cast("long"))})
    # a stretch is the run of rows after the same number of peaks
    runs = marked.groupBy(*keys, "peaks").agg(F.count_if(under).alias("length"))
    longest = runs.groupBy(*keys).agg(F.max("length").alias("duration"))
    # day and seq order the first maximum
    first = F.min_by("peak", F.struct(-F.col("drawdown"), F.col("day"), F.col("seq")))
    depth = series.groupBy(*keys).agg(F.max("drawdown").alias("max_drawdown"), first.alias("peak"))
    depth = depth.withColumn("drawdown_pct", F.when(F.col("peak") > 0, F.col("max_drawdown") / F.col("peak") * 100.0)).drop("peak")
    if keys:
        return depth.join(longest, keys)
    return depth.withColumn("_one", F.lit(0)).join(F.broadcast(longest.withColumn("_one", F.lit(0))), "_one").drop("_one")


def sharpe_by_period(bets: DataFrame, period: str, keys: list[str] = ()) -> DataFrame:
    d = daily(bets, keys).withColumns({"roi": F.col("profit") / F.col("stake") * 100.0, "period": period_name(period)})
    sd = F.stddev_samp("roi")
    g = d.groupBy(*keys, "period").agg(
        (F.try_divide(F.sum("profit"), F.sum("stake")) * 100.0).alias("roi"),
        F.when((F.count(F.lit(1)) >= 2) & (sd > 0), F.avg("roi") / sd).alias("sharpe"),
        F.sum("bets").alias("bets"),
    )
    w = W.partitionBy(*keys)
    return g.withColumn("stability", F.when(F.count("sharpe").over(w) >= 2, F.stddev_pop("sharpe").over(w)))


def value_bets(priced: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Rows whose probability beats the implied one."""
    value = F.col("prob") > F.col("implied")
    edge = F.when(value, F.col("prob") - F.col("implied"))
    return priced.groupBy(*keys).agg(
        F.count_if(value).alias("value_bets"),
        F.avg(F.when(value, hit())).alias("accuracy"),
        F.avg(edge).alias("mean_edge"),
        F.coalesce(F.sum(edge), F.lit(0.0)).alias("total_edge"),
        F.avg(value.cast("double")).alias("share"),
    )


def kelly_summary(bets: DataFrame, keys: list[str] = ()) -> DataFrame:
    k = S.kelly_fraction("prob", "decimal")
    return bets.withColumn("kelly", k).groupBy(*keys).agg(
        F.avg("kelly").alias("mean_kelly"),
        (F.avg((F.col("kelly") > 0).cast("double")) * 100.0).alias("positive_share"),
        F.max("kelly").alias("max_kelly"),
        F.min("kelly").alias("min_kelly"),
    )
