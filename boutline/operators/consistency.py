"""How stable accuracy is across rating tiers, methods, periods and experience."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import buckets as B
from ..functions import scalar as S
from .metrics import hit, period_name

FLAG_RANGE = 0.05
DEGRADING_SLOPE = -0.005


def dimensions(period: str = "month") -> dict[str, Column]:
    """Bucket column of each dimension; needs ``diff``, method flags, ``day`` and bout counts."""
    return {
        "elo_tier": B.rating_tier("diff"),
        "method": S.method_label_by_ones(),
        "time_period": period_name(period),
        "experience_gap": B.experience_gap("bouts", "opp_bouts"),
        "opp_experience": B.opponent_experience("opp_bouts"),
    }


def by_bucket(scored: DataFrame, dims: dict[str, Column], keys: list[str] = ()) -> DataFrame:
    """All dimensions in one pass: each row is tagged with its bucket per dimension and one group-by counts them all."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), b.alias("bucket")) for n, b in dims.items()])).alias("d")
    return (
        scored.select(*keys, "prob", "result", pairs)
        .groupBy(*keys, F.col("d.dimension").alias("dimension"), F.col("d.bucket").alias("bucket"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(hit()).alias("accuracy"),
            F.avg("prob").alias("mean_prob"),
            F.avg("result").alias("win_rate"),
            F.avg(S.brier_term("prob", "result")).alias("brier"),
        )
    )


def spread(buckets: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Population variance and range over non-empty buckets of each dimension, trend over periods, and the flag."""
    w = W.partitionBy(*keys, "dimension").orderBy("bucket")
    x = (F.row_number().over(w) - 1).cast("double")
    several = F.count("accuracy") > 1
    g = buckets.filter(F.col("n") > 0).withColumn("x", x).groupBy(*keys, "dimension").agg(
        F.when(several, F.var_pop("accuracy")).alias("variance"),
        F.when(several, F.max("accuracy") - F.min("accuracy")).alias("range"),
        F.when(F.count("accuracy") >= 3, F.regr_slope("accuracy", "x")).alias("slope"),
        F.count("accuracy").alias("buckets"),
    )
    timed = F.col("dimension") == "time_period"
    flag = F.when(timed, F.col("slope") < DEGRADING_SLOPE).otherwise(F.when(F.col("range") > 0, F.col("range") > FLAG_RANGE))
    return g.withColumn("slope", F.when(timed, F.col("slope"))).withColumn("flag", flag.cast("int"))


def with_spread(buckets: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Bucket rows with their dimension's spread, by windows over these few rows, so that what is below is computed once."""
    alls = W.partitionBy(*keys, "dimension")
    x = (F.row_number().over(alls.orderBy("bucket")) - 1).cast("double")
    numbered = buckets.filter(F.col("n") > 0).withColumn("x", x)
    n, timed = F.count("accuracy").over(alls), F.col("dimension") == "time_period"
    reach = F.when(n > 1, F.max("accuracy").over(alls) - F.min("accuracy").over(alls))
    slope = F.when(timed & (n >= 3), F.regr_slope("accuracy", "x").over(alls))
    out = numbered.withColumns({"variance": F.when(n > 1, F.var_pop("accuracy").over(alls)), "range": reach, "slope": slope})
    flag = F.when(timed, F.col("slope") < DEGRADING_SLOPE).otherwise(F.when(F.col("range") > 0, F.col("range") > FLAG_RANGE))
    return out.withColumn("flag", flag.cast("int")).drop("x")


def overall(spreads: DataFrame, keys: list[str] = ()) -> DataFrame:
    flags = F.array_join(F.array_sort(F.collect_list(F.when(F.col("flag") == 1, F.col("dimension")))), ",")
    return spreads.groupBy(*keys).agg(F.avg("variance").alias("consistency_variance"), flags.alias("flags"))
