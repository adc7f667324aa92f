"""Smoothed accuracy series and yearly fits."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..session import materialize
from .prefix import day_slice, running


def exponential_average(df: DataFrame, value: str, span: float, order: list[str] = ("day", "seq"), name: str = "ema") -> DataFrame:
    """Exponential moving average over the whole ordered table: first value as start, then y = a x + (1 - a) y.

    The recurrence is linear, so it splits: rows get positions, positions form blocks of L rows, each block computes its own weighted
    sum with a window, and takes what earlier blocks left over from the last row of the block before. L is chosen so that (1 - a)^L is
    below the precision of a double; what lies two blocks back is therefore exactly nothing, and no sequential pass is needed.
    """
    a = 2.0 / (span + 1.0)
    keep = 1.0 - a
    length = max(1, math.ceil(41.5 / -math.log(keep))) if 0.0 < keep < 1.0 else 1
    numbered = running(df, [], day_slice("day"), list(order), {"_pos": ("count", F.lit(1))}, inclusive=False)
    i = F.col("_pos") % length
    weight = F.when(F.col("_pos") == 0, 1.0).otherwise(a)
    blocked = materialize(numbered.withColumns({"_block": F.floor(F.col("_pos") / length), "_i": i, "_x": weight * F.col(value) * F.pow(F.lit(keep), -i)}))
    w = W.partitionBy("_block").orderBy("_pos").rowsBetween(W.unboundedPreceding, 0)
    local = blocked.withColumn("_own", F.sum("_x").over(w) * F.pow(F.lit(keep), F.col("_i")))
    left = blocked.groupBy("_block").agg((F.sum("_x") * F.pow(F.lit(keep), F.max("_i"))).alias("_left"))
    left = left.select((F.col("_block") + 1).alias("_block"), "_left")
    return (
        local.join(left, "_block", "left")
        .withColumn(name, F.col("_own") + F.coalesce("_left", F.lit(0.0)) * F.pow(F.lit(keep), F.col("_i") + 1))
        .drop("_block", "_pos", "_i", "_x", "_own", "_left")
    )


def monthly_forecast(pred: DataFrame, span: float = 6) -> DataFrame:
    """Monthly accuracy, its smoothed value, the forecast it gave for the month and the error. Windows run over months."""
    m = pred.groupBy(F.trunc("day", "month").alias("day")).agg(F.avg("correct").alias("accuracy"))
    e = exponential_average(m, "accuracy", span, ["day"])
    e = e.withColumn("forecast", F.lag("ema").over(W.orderBy("day"))).withColumn("error", F.abs(F.col("forecast") - F.col("accuracy")))
    return e.withColumn("mae", F.avg("error").over(W.partitionBy()))


def yearly_fit(pred: DataFrame, target: int = 2026) -> DataFrame:
    """Accuracy per year with the fitted line and its value in the target year (two years at least)."""
    y = pred.groupBy(F.year("day").alias("year")).agg(F.avg("correct").alias("accuracy"), F.count(F.lit(1)).alias("n"))
    alls = W.partitionBy()
    x = F.col("year").cast("double")
    several = F.count(F.lit(1)).over(alls) >= 2
    slope, at0 = F.regr_slope("accuracy", x).over(alls), F.regr_intercept("accuracy", x).over(alls)
    y = y.withColumns({"slope": F.when(several, slope), "intercept": F.when(several, at0)})
    return y.withColumns({"fitted": F.col("slope") * F.col("year") + F.col("intercept"), "projected": F.col("slope") * target + F.col("intercept")})


def accuracy_by_confidence(scored: DataFrame) -> DataFrame:
    """Accuracy per band of the player's winning probability, from one half upwards."""
    p = F.col("prob")
    edges = (0.6, 0.7, 0.8, 0.9)
    band = F.when((p >= 0.5) & (p < 1.0), S.first_match([(p < e, F.lit(f"{e - 0.1:.1f}-{e:.1f}")) for e in edges], "0.9-1.0"))
    hit = ((p > 0.5).cast("double") == F.col("result")).cast("double")
    return scored.withColumn("band", band).filter(F.col("band").isNotNull()).groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"))
